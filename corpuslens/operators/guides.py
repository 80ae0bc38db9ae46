"""Searching and combining guides (rule documents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.functions.scoring import lookup
from corpuslens.operators.joins import union_distinct_ids, with_mandatory
from corpuslens.operators.strings import substring_matches
from corpuslens.sources.store import pin, spread

OPTIONAL = {"api_type": "string", "scope": "string", "design_system": "string", "utility_library": "string",
            "mandatory": "array<string>"}
KEYWORD_POINTS = {"tag": 15, "summary": 10, "content": 5}


def _library_points(name: str) -> Column:
    """40 for the guide of that library, 35 for a tag, 25 for a mention."""
    wanted, low = F.col(f"r.{name}"), F.lower(F.col(f"r.{name}"))
    return (F.when(wanted.isNull(), 0)
            .when((F.col("g.id") == wanted) | (F.col("g.id") == F.concat(wanted, F.lit("-guide"))), 40)
            .when(F.exists("g.tags", lambda t: F.contains(F.lower(t), low)), 35)
            .when(F.contains(F.lower("g.summary"), low) | F.contains(F.lower("g.content"), low), 25).otherwise(0))


def keyword_points(words: DataFrame, guides: DataFrame) -> DataFrame:
    """Points of every guide a keyword occurs in: (keyword, id, points)."""
    texts = guides.select("id", F.explode(F.concat(
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("field"), F.lower(t).alias("hay"))),
        F.array(F.struct(F.lit("summary").alias("field"), F.lower("summary").alias("hay")),
                F.struct(F.lit("content").alias("field"), F.lower("content").alias("hay"))))).alias("x")).select("id", "x.*")
    lowered = words.select("keyword", F.lower("keyword").alias("needle")).distinct()
    hits = substring_matches(lowered, texts, "needle", "hay", ["id", "field"])
    per_field = hits.join(lowered, "needle").select("keyword", "id", "field").distinct()
    return per_field.groupBy("keyword", "id").agg(F.sum(lookup(F.col("field"), KEYWORD_POINTS)).alias("points"))


def search_guides(requests: DataFrame, guides: DataFrame, k: int | None = 10,
                  request_key: str = "request_id") -> DataFrame:
    """Best k guides per request (None: all): (request, rank, id, score).

    ``requests``: key, keywords, and optionally api_type, scope,
    design_system, utility_library, mandatory (ids). An api type admits only
    its own guides and those for any; mandatory guides score 1000.

    Requests are reduced to distinct forms. Apart from keywords a guide's score
    is the same for every request with equal options, so a guide without a
    keyword hit can only be in the answer when it is among the first k for
    those options; hits come from an equi join on the keyword.
    """
    for name, kind in OPTIONAL.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    options = ["api_type", "scope", "design_system", "utility_library"]
    req = requests.select(request_key, *options, F.array_sort(F.array_distinct("keywords")).alias("keywords"),
                          F.coalesce("mandatory", F.array().cast("array<string>")).alias("mandatory"))
    req = pin(req.withColumns({
        "profile": F.sha2(F.to_json(F.struct(*options)), 256),
        "sig": F.sha2(F.to_json(F.struct(*options, "keywords", "mandatory")), 256)}), "requests")
    sigs = req.select("sig", "profile", "keywords", "mandatory").dropDuplicates(["sig"])
    profiles = req.select("profile", *options).dropDuplicates(["profile"])

    # scores are kept in tenths, as integers, so that equal scores are equal;
    # the api type gate is an equi join, "" stands for a request without one
    gates = profiles.select("*", F.explode(F.when(F.col("api_type").isNull(), F.array(F.lit("")))
                            .otherwise(F.array_distinct(F.array("api_type", F.lit("any"))))).alias("gate")).alias("r")
    doors = guides.select("*", F.explode(F.array(F.lit(""), F.col("api_type"))).alias("gate")).alias("g")
    base = (F.when(F.col("r.api_type").isNull(), 0).otherwise(30)
            + F.when(F.col("r.scope") == F.col("g.scope"), 20).otherwise(0)
            + _library_points("design_system") + _library_points("utility_library")) * 10 + F.col("g.priority")
    admitted = gates.join(doors, F.col("r.gate") == F.col("g.gate")).select("r.profile", "g.id", base.alias("base"))
    # mandatory guides are added below; a request may name k more that lead here
    leaders = admitted.join(guides.filter("mandatory").select("id"), "id", "left_anti")
    if k is not None:
        named = sigs.agg(F.max(F.size("mandatory"))).first()[0] or 0
        first = Window.partitionBy("profile").orderBy(F.desc("base"), "id")
        leaders = leaders.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + named)

    words = sigs.select("sig", "profile", F.explode("keywords").alias("keyword"))
    hits = (words.join(keyword_points(words, guides), "keyword")
            .groupBy("sig", "profile", "id").agg(F.sum("points").alias("points"))
            .join(admitted, ["profile", "id"]).select("sig", "id", (F.col("base") + F.col("points") * 10).alias("score")))
    calm = sigs.join(leaders, "profile").select("sig", "id", F.col("base").alias("score"))
    scored = hits.unionByName(calm).groupBy("sig", "id").agg(F.max("score").alias("score"))
    # among equal scores the first k ids are enough
    asked = sigs.select("sig", F.explode("mandatory").alias("id")).join(guides.select("id"), "id", "left_semi")
    must = asked.select("sig", "id").union(with_mandatory(sigs.select("sig"), guides, k).select("sig", "id")).distinct()
    ranked = scored.join(must, ["sig", "id"], "left_anti").unionByName(must.select("sig", "id", F.lit(10000).alias("score")))
    order = Window.partitionBy("sig").orderBy(F.desc("score"), "id")
    best = ranked.withColumn("rank", F.row_number().over(order))
    best = best if k is None else best.filter(F.col("rank") <= k)
    return req.select(request_key, "sig").join(best, "sig").select(
        request_key, "rank", "id", (F.col("score") / 10).alias("score"))


def combine_guides(wanted: DataFrame, guides: DataFrame, request_key: str = "request_id") -> DataFrame:
    """Guides that survive combination, per request in reading order.

    ``wanted``: request, id, position. Mandatory guides are added in front.
    Order: scope, priority, newest version, then place. A guide is dropped if
    it excludes one already kept or requires one that was not requested. That
    rule is sequential within a request, so it runs as a fold over the
    request's own (short) list.
    """
    # places of mandatory guides are alike: ids decide below
    auto = with_mandatory(wanted.select(request_key).distinct(), guides).withColumn("position", F.lit(0))
    ids = union_distinct_ids(auto, wanted.select(request_key, "id", "position"), request_key)
    facts = guides.select("id", "scope", "priority", "version", "requires", "excludes")
    rows = ids.join(facts, "id").select(request_key, F.struct(
        (-lookup(F.col("scope"), R.SCOPE_RANK, 0)).alias("s"), (-F.col("priority")).alias("p"),
        # newest first: versions are YYYY.MM.DD
        (-F.coalesce(F.regexp_replace("version", r"\.", "").try_cast("bigint"), F.lit(0))).alias("v"), F.col("rank").alias("o"),
        "id", "requires", "excludes").alias("g"))
    lists = rows.groupBy(request_key).agg(F.array_sort(F.collect_list("g")).alias("gs")).withColumn(
        "requested", F.transform("gs", lambda g: g["id"]))
    none = F.array().cast("array<string>")

    def step(kept: Column, g: Column) -> Column:
        blocked = F.exists(g["excludes"], lambda x: F.array_contains(kept, x))
        lacking = F.exists(g["requires"], lambda x: ~F.array_contains(F.col("requested"), x))
        return F.when(blocked | lacking, kept).otherwise(F.concat(kept, F.array(g["id"])))

    kept = lists.select(request_key, F.posexplode(F.aggregate("gs", none, step)).alias("position", "id"))
    return kept.join(guides.select("id", "scope", "priority", "version"), "id").select(
        request_key, F.col("position").cast("bigint").alias("position"), "id", "priority", "version", "scope")


def combined_text(kept: DataFrame, guides: DataFrame, request_key: str = "request_id",
                  max_chars: int | None = None) -> DataFrame:
    """One text per request: headed guide contents, in order, split by rules."""
    part = F.concat(F.lit("# "), "summary", F.lit("\n\n"), "content")
    parts = kept.join(guides.select("id", part.alias("part")), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda x: x["part"]), "\n\n---\n\n")
    out = parts.groupBy(request_key).agg(text.alias("combined"), F.count(F.lit(1)).alias("n_guides"))
    return out if max_chars is None else out.withColumn("combined", F.substring("combined", 1, max_chars))


def guides_for(requests: DataFrame, guides: DataFrame, max_guides: int | None = None,
               max_chars: int | None = None, request_key: str = "request_id") -> DataFrame:
    """Search, keep the first ``max_guides`` if given, combine, and cut the text to ``max_chars`` if given."""
    if max_guides is None:
        return whole_guides_for(requests, guides, max_chars, request_key)
    found = pin(search_guides(requests, guides, max_guides, request_key), "found")
    kept = combine_guides(found.select(request_key, "id", F.col("rank").alias("position")), guides, request_key)
    return combined_text(kept, guides, request_key, max_chars)


def request_forms(requests: DataFrame, guides: DataFrame, request_key: str) -> tuple[DataFrame, DataFrame]:
    """(request, ask, forms) and (form, options, keywords): requests by what decides their guides.

    A keyword that occurs in no guide decides nothing, so requests with the same options and the same other keywords are
    of one form. A request key that occurs in several rows has the forms of all of them; ``ask`` is equal for equal forms.
    """
    options = [c for c in OPTIONAL if c in requests.columns]
    rows = pin(requests.select(F.monotonically_increasing_id().alias("_row"), request_key, *options, "keywords"),
               "request-rows")
    words = rows.select("_row", F.explode("keywords").alias("keyword"))
    distinct = pin(words.select("keyword").distinct(), "request-words")
    telling = pin(keyword_points(distinct, guides).select("keyword").distinct(), "telling-words")
    held = words.join(telling, "keyword").groupBy("_row").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    formed = rows.drop("keywords").join(held, "_row", "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    formed = pin(formed.select(request_key, *options, "keywords", F.sha2(F.to_json(F.struct(
        *options, "keywords")), 256).alias("form")), "request-forms")
    asked = formed.groupBy(request_key).agg(F.array_sort(F.collect_set("form")).alias("forms"))
    return (pin(asked.withColumn("ask", F.sha2(F.concat_ws(",", "forms"), 256)), "asks"),
            formed.select("form", *options, "keywords").dropDuplicates(["form"]))


def whole_guides_for(requests: DataFrame, guides: DataFrame, max_chars: int | None = None,
                     request_key: str = "request_id") -> DataFrame:
    """All guides found, combined, as one text per request.

    Search and combination run once for equal requests, and what moves are places of guides, not texts: one answer may
    hold every guide, so the guides as a whole go to each task, which puts the texts together as it returns them.
    """
    asked, forms = request_forms(requests, guides, request_key)
    found = pin(search_guides(forms, guides, None, "form"), "found")
    asks = asked.select("ask", "forms").dropDuplicates(["ask"]).select("ask", F.explode("forms").alias("form"))
    kept = combine_guides(asks.join(found, "form").select("ask", "id", F.col("rank").alias("position")), guides, "ask")
    part = F.concat(F.lit("# "), "summary", F.lit("\n\n"), "content")
    book = guides.agg(F.array_sort(F.collect_list(F.struct("id", part.alias("part")))).alias("book"))
    numbers = book.select(F.posexplode("book").alias("no", "g")).select("no", "g.id")
    places = pin(kept.join(numbers, "id").groupBy("ask").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("position", "no"))), lambda x: x["no"]).alias("places")), "places")
    texts = book.select(F.transform("book", lambda g: g["part"])).scalar()
    text = F.array_join(F.transform("places", lambda n: F.get("_texts", n)), "\n\n---\n\n")
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    return spread(asked.select(request_key, "ask")).join(places, "ask").withColumn("_texts", texts).select(
        request_key, text.alias("combined"), F.size("places").cast("bigint").alias("n_guides"))


def metadata_requests(meta: DataFrame, request_key: str = "doc_id", k_methods: int | None = None) -> DataFrame:
    """Guide requests of metadata rows: their keywords and api type."""
    c = F.col
    return meta.select(request_key, "api_type", X.metadata_keywords(
        c("patterns"), c("frameworks"), c("api_type"), c("features"), c("api_methods"), c("entities"),
        c("complexity"), c("error_handling"), k_methods).alias("keywords"))
