"""Recommending records for requests by keywords, roles, entities and scores.

Bulk requests meet the corpus through signatures. Scores depend only on a
record's role and keywords (or its eight scores), so records with the same
signature tie and only the first k ids of each can ever be returned. The
corpus is reduced to those ids by one grouped top-k, requests are reduced to
their distinct forms, and the two small sides are joined. Nothing is dropped
that could be in an answer, and a keyword that a third of all records carry
costs k rows per signature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.operators.strings import substring_pairs
from corpuslens.sources.store import pin

ANY = "*"


def _first_k(df: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def _lowered(values: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(values, F.lower)))


def recommend(requests: DataFrame, corpus: DataFrame, k: int = 5, request_key: str = "request_id",
              key: str = "doc_id", role: str = "file_role") -> DataFrame:
    """Best k records per request by keyword overlap: (request, rank, record, similarity).

    ``requests``: key, keywords, role (null: any), entities (empty: any).
    ``corpus``: key, role, keywords, entities. Entities filter by substring;
    a record without any requested keyword is not returned.
    """
    req = requests.select(request_key, F.col(role).alias("want_role"), _lowered("keywords").alias("wanted"),
                          _lowered("entities").alias("want_entities"))
    req = pin(req.withColumn("sig", F.sha2(F.to_json(F.struct("want_role", "wanted", "want_entities")), 256)), "requests")
    sigs = req.select("sig", "want_role", "wanted", F.when(F.size("want_entities") > 0, F.col("want_entities"))
                      .otherwise(F.array(F.lit(ANY))).alias("want_entities")).distinct()
    anchors = sigs.select("sig", "want_role", "wanted", F.explode("want_entities").alias("entity"))

    cases = corpus.select(key, role, _lowered("keywords").alias("present"), _lowered("entities").alias("own"))
    group = [role, "present"]
    everything = _first_k(cases.select(key, *group), group, k, key).withColumn("entity", F.lit(ANY))
    by_entity = _first_k(cases.select(key, *group, F.explode("own").alias("own_entity")), [*group, "own_entity"], k, key)
    match = substring_pairs(anchors.filter(F.col("entity") != ANY), by_entity, "entity", "own_entity")
    named = _first_k(by_entity.join(match, "own_entity").select(key, *group, "entity").distinct(),
                     [*group, "entity"], k, key)
    pool = everything.select(key, *group, "entity").unionByName(named)

    # postings by entity, role and keyword: a request meets only records that hold one of its words
    words = substring_pairs(sigs.select(F.explode("wanted").alias("word")),
                            cases.select(F.explode("present").alias("held")), "word", "held")
    asked = (anchors.select("sig", "entity", F.coalesce("want_role", F.lit(ANY)).alias("role_key"),
                            F.size("wanted").alias("n_wanted"), F.explode("wanted").alias("word")).join(words, "word"))
    posted = pool.select(key, "entity", F.explode(F.array(F.col(role), F.lit(ANY))).alias("role_key"), "present").select(
        key, "entity", "role_key", F.explode("present").alias("held"))
    hits = asked.join(posted, ["entity", "role_key", "held"]).select("sig", key, "n_wanted", "word").distinct()
    scored = hits.groupBy("sig", key, "n_wanted").agg(
        (F.count(F.lit(1)) / F.greatest("n_wanted", F.lit(1))).alias("similarity")).drop("n_wanted")
    order = Window.partitionBy("sig").orderBy(F.desc("similarity"), key)
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return req.select(request_key, "sig").join(best, "sig").select(request_key, "rank", key, "similarity")


def draft_requests(drafts: DataFrame, path: str = "draft_path", text: str = "content",
                   request_key: str = "request_id", description: str = "description") -> DataFrame:
    """Requests read from draft files: first TODO hint, role hint, path entities, keywords."""
    p = F.col(path)
    df = drafts.withColumns({"target": F.get(X.todo_hints(F.col(text)), F.lit(0)), "_low": F.lower(description)})
    return df.select(request_key, X.role_hint(p).alias("file_role"), X.path_entities(p).alias("entities"),
                     X.request_keywords(F.col("_low"), F.col("target")).alias("keywords"))


def recommend_drafts(drafts: DataFrame, corpus: DataFrame, k: int = 5, **columns) -> DataFrame:
    return recommend(draft_requests(drafts, **columns), corpus, k)


def infer_api(hits: DataFrame, by: str = "request_id") -> DataFrame:
    """API type of the first hit, in rank order, that gives one away; else any."""
    k = F.col("keywords")
    verdict = (F.when(F.exists("api_methods", lambda m: F.contains(m, F.lit("grpc"))) | F.array_contains(k, "grpc"), "grpc")
               .when(F.array_contains(k, "rest") | F.array_contains(k, "openapi"), "openapi"))
    return (hits.select(by, "rank", verdict.alias("v")).groupBy(by)
            .agg(F.coalesce(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("rank"))), F.lit("any")).alias("api_type")))


def important_dimensions(text: Column, words=R.DIMENSION_WORDS, k: int = 3,
                         default=R.DEFAULT_DIMENSIONS) -> Column:
    """Up to k dimensions with most dictionary words in the (lower-cased) text."""
    counted = [F.struct((-reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in ws])).alias("n"),
                        F.lit(i).alias("o"), F.lit(d).alias("d")) for i, (d, ws) in enumerate(words)]
    hits = F.filter(F.array_sort(F.array(*counted)), lambda x: x["n"] < 0)
    return F.when(F.size(hits) > 0, F.transform(F.slice(hits, 1, k), lambda x: x["d"])).otherwise(
        F.array(*[F.lit(d) for d in default]))


def score_signatures(cases: DataFrame, n: int, key: str = "doc_id", role: str = "file_role") -> DataFrame:
    """Distinct (role, eight scores) with how many records share them and the first n ids."""
    group = [role, *R.DIMENSIONS]
    slim = cases.select(key, *group)
    counts = slim.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    ids = _first_k(slim, group, n, key).groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return counts.join(ids, group).select(
        role, F.array(*R.DIMENSIONS).alias("scores"), "n", "ids")


def dimension_lists(pool: DataFrame, n: int) -> DataFrame:
    """The first n signatures of every (role_key, dimension), best score first, ties by first id.

    At most n rows for each of them, whatever the size of the corpus; Spark cuts the lists before the exchange.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col("scores")[i].alias("score"))
                      for i, d in enumerate(R.DIMENSIONS)])
    rows = pool.select("role_key", F.explode(pairs).alias("p"), "scores", "ids").select("role_key", "p.*", "scores", "ids")
    return _first_k(rows.filter("score IS NOT NULL"), ["role_key", "dimension"], n, F.desc("score"), F.col("ids")[0])


def _best_tenth(forms: DataFrame, pool: DataFrame, picked, n: int, key: str) -> DataFrame:
    """(form, top_score, key): the n best of the best tenth by mean of each form (form, role_key, dimensions, total).

    Where the tenth ends is found in two steps: by whole points of the mean, then by the steps of the one point that
    is cut. So no window holds more than the points of a form, or the steps within one.
    """
    rows = forms.join(pool, "role_key").withColumn("picked", picked("scores")).select(
        "form", "total", F.array_max("picked").alias("top_score"), "n", "ids",
        F.try_divide(F.aggregate("picked", F.lit(0.0), lambda a, x: a + x), F.size("picked")).alias("mean"))
    rows = rows.filter("mean IS NOT NULL").withColumn("point", F.floor("mean"))
    points = rows.groupBy("form", "point").agg(F.sum("n").alias("held"), F.first("total").alias("total"))
    above = Window.partitionBy("form").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.ceil(F.col("total") * 0.1) - F.coalesce(F.sum("held").over(above), F.lit(0))
    points = pin(points.withColumn("room", room).filter("room > 0").select("form", "point", "held", "room"), "points")
    whole = rows.join(points.filter("held <= room").select("form", "point"), ["form", "point"])
    whole = whole.select("form", "top_score", F.explode("ids").alias(key))
    cut = rows.join(points.filter("held > room").select("form", "point", "room"), ["form", "point"])
    step = ["form", "mean", "top_score"]
    steps = cut.groupBy(*step).agg(F.sum("n").alias("n"), F.first("room").alias("room"))
    before = Window.partitionBy("form").orderBy(F.desc("mean"), F.desc("top_score")).rowsBetween(
        Window.unboundedPreceding, -1)
    steps = steps.withColumn("left", F.col("room") - F.coalesce(F.sum("n").over(before), F.lit(0))).filter("left > 0")
    tail = cut.select(*step, F.explode("ids").alias(key)).join(steps.select(*step, "left"), step)
    within = Window.partitionBy(*step).orderBy(key)
    tail = tail.withColumn("_n", F.row_number().over(within)).filter((F.col("_n") <= n) & (F.col("_n") <= F.col("left")))
    return _first_k(whole.unionByName(tail.select("form", "top_score", key)), ["form"], n, F.desc("top_score"), key)


def best_practice(requests: DataFrame, signatures: DataFrame, n: int = 3, min_score: float = 75, dynamic: bool = True,
                  request_key: str = "request_id", key: str = "doc_id", role: str = "file_role") -> DataFrame:
    """Best n records per request in its dimensions: (request, rank, record, top_score, excellent_in).

    ``requests``: key, dimensions, role (null: any). The threshold drops to
    the larger of 110 % of and 10 above the lowest mean when that mean is below
    ``min_score``. Without a record above it, the best tenth by mean score
    stands in. Ties go by top score, then id. A request without known
    dimensions gets nothing.

    Lists of the corpus sorted by each dimension are read to depth n: a record
    that is among a form's n best by its highest score is among the n best of the
    list of that dimension. So a form reads n signatures for each of its dimensions. The whole
    corpus is only read for forms that no list lifts over their threshold, once
    for each role and set of dimensions.
    """
    req = requests.select(request_key, F.coalesce(role, F.lit(ANY)).alias("role_key"), "dimensions")
    req = pin(req.withColumn("sig", F.concat_ws("|", "role_key", F.array_join("dimensions", ","))), "requests")
    sigs = req.select("sig", "role_key", "dimensions").distinct()
    signatures = pin(signatures, "signatures")
    pool = signatures.select(F.explode(F.array_distinct(F.array(F.col(role), F.lit(ANY)))).alias("role_key"), "scores", "n", "ids")
    means = pool.groupBy("role_key").agg(
        F.sum("n").alias("total"),
        *[(F.sum(F.col("scores")[i] * F.col("n")) / F.sum("n")).alias(f"m{i}") for i in range(len(R.DIMENSIONS))])
    means = means.select("role_key", "total", F.array(*[f"m{i}" for i in range(len(R.DIMENSIONS))]).alias("means"))
    place = F.create_map(*[x for i, d in enumerate(R.DIMENSIONS) for x in (F.lit(d), F.lit(i))])

    def picked(values: str) -> Column:
        return F.transform("dimensions", lambda d: F.get(F.col(values), place[d]))

    lowest = F.array_min(picked("means"))
    lowered = F.greatest(lowest * 1.1, lowest + 10)
    threshold = F.when(F.lit(dynamic) & (lowest < min_score), lowered).otherwise(F.lit(float(min_score)))
    goal = pin(sigs.join(means, "role_key").withColumn("threshold", threshold).select(
        "sig", "role_key", "dimensions", "total", "threshold",
        F.concat_ws("|", "role_key", F.array_join(F.array_sort("dimensions"), ",")).alias("form")), "goals")
    # a signature that several lists of a form hold is met once: by its list of the form's first best dimension
    met = (goal.select("sig", "role_key", "dimensions", "threshold", F.explode(F.array_distinct("dimensions")).alias("dimension"))
           .join(dimension_lists(pool, n), ["role_key", "dimension"]).withColumn("picked", picked("scores"))
           .withColumn("top_score", F.array_max("picked")).filter("score = top_score AND score >= threshold")
           .filter(F.col("dimension") == F.get("dimensions", F.array_position("picked", F.col("top_score")).cast("int") - 1)))
    names = F.transform(
        F.filter(F.arrays_zip("dimensions", "picked"), lambda z: z["picked"] >= F.col("threshold")), lambda z: z["dimensions"])
    best = met.select("sig", "top_score", names.alias("excellent_in"), F.explode("ids").alias(key))
    if dynamic:
        best = pin(_first_k(best, ["sig"], n, F.desc("top_score"), key), "above")
        lost = goal.join(best.select("sig").distinct(), "sig", "left_anti")
        forms = pin(lost.groupBy("form").agg(*[F.first(c).alias(c) for c in ("role_key", "total")],
                                             F.array_sort(F.first("dimensions")).alias("dimensions")), "forms")
        tenth = _best_tenth(forms, pool, picked, n, key)
        best = best.unionByName(lost.select("sig", "form", F.col("dimensions").alias("excellent_in")).join(tenth, "form").drop("form"))
    order = Window.partitionBy("sig").orderBy(F.desc("top_score"), key)
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return req.select(request_key, "sig").join(best, "sig").select(request_key, key, "top_score", "excellent_in", "rank")
