"""Similar pages and files to reuse, for a whole table of requests.

The score of a case depends on its signature alone: category, api type, design system, frameworks, tags and whether
its total is high. So the corpus is reduced to signatures with their first k ids, requests to their distinct forms, and
forms meet signatures by a threshold algorithm made of equi joins. A signature is listed under a key for every way in
which its category, api type and design system can earn points; a form probes the keys that earn it points. A key with
k cases proves that the k-th best answer scores at least what the key earns, and a key whose best possible score is
below that is not read. What is read of a key is its first k ids, and the signatures that share a framework or a tag
with the form: any other case of the key has k cases before it that score no less.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.functions.scoring import half_up
from corpuslens.operators.joins import alias_groups
from corpuslens.sources.store import pin

KEY = ["key_category", "key_api", "key_design", "key_total"]
HIGH_TOTAL = 85
MOST = 100          # scores are cut here
NEEDLES = 256       # features looked for in one copy of a text

# --- fixed values: points of a match, and of a criterion that is not set
CATEGORY_EXACT, CATEGORY_ALIKE, CATEGORY_UNSET = 35, 20, 15
API_SAME, API_MIXED, API_UNSET = 25, 15, 10
DESIGN_SAME, DESIGN_UNSET = 20, 8
FRAMEWORKS, FRAMEWORKS_UNSET = 15, 6
TAGS, TAGS_UNSET = 5, 2
TOTAL_HIGH = 5


def _text(column: str) -> Column:
    """Null for a criterion that is null or empty."""
    return F.when(F.length(column) > 0, F.col(column))


def _groups(value: Column) -> Column:
    """Alias groups of a category, worked out once for each signature or form."""
    return F.coalesce(alias_groups(value), F.array().cast("array<string>"))


def _set(column: str) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(column))), F.array().cast("array<string>"))


def signatures(cases: DataFrame, k: int, key: str = "id", min_total: float | None = None) -> DataFrame:
    """Distinct signatures with their first ``k`` ids. Ids beyond are cut before the shuffle."""
    if min_total:
        # an unscored case is not held to the minimum
        cases = cases.filter((F.coalesce("total_score", F.lit(0.0)) == 0) | (F.col("total_score") >= min_total))
    df = cases.select(
        F.col(key).alias("id"), F.lower("category").alias("category"), "api_type", "design_system",
        _set("frameworks").alias("frameworks"), _set("tags").alias("tags"),
        F.coalesce(F.col("total_score") >= HIGH_TOTAL, F.lit(False)).alias("high"))
    parts = F.struct("category", "api_type", "design_system", "frameworks", "tags", "high")
    df = df.select("id", parts.alias("case"), F.sha2(F.to_json(parts), 256).alias("signature"))
    w = Window.partitionBy("signature").orderBy("id")
    # dense_rank: a repeated id takes one place
    return (df.withColumn("_n", F.dense_rank().over(w)).filter(F.col("_n") <= k)
            .groupBy("signature").agg(F.first("case").alias("case"), F.array_sort(F.collect_set("id")).alias("ids"))
            .withColumn("case", F.col("case").withField("groups", _groups(F.col("case.category")))))


def _listed(sigs: DataFrame) -> DataFrame:
    """Every key of every signature; ``*`` stands for any value, ``!`` for any that is not null."""
    def same(column: str) -> Column:
        return F.concat(F.lit("="), F.col(f"case.{column}"))

    groups = F.transform("case.groups", lambda g: F.concat(F.lit("~"), g))
    keys = [F.concat(F.array_compact(F.array(F.lit("*"), same("category"))), groups),
            F.array_compact(F.array(F.lit("*"), F.when(F.col("case.api_type").isNotNull(), F.lit("!")), same("api_type"))),
            F.array_compact(F.array(F.lit("*"), same("design_system"))),
            F.array_compact(F.array(F.lit("*"), F.when(F.col("case.high"), F.lit("high"))))]
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(kv[1])), zip(KEY, keys), sigs)


def forms_of(requests: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(requests as key and form, distinct forms). A null or empty criterion is not set; nulls in lists do not count."""
    lists = {c: F.coalesce(F.array_compact(c), F.array().cast("array<string>")) for c in ("frameworks", "tags")}
    parts = F.struct(F.lower(_text("category")).alias("category"), _text("api_type").alias("api_type"),
                     _text("design_system").alias("design_system"), *[v.alias(c) for c, v in lists.items()])
    own = requests.select(F.col(key).alias("request"), parts.alias("want"))
    own = own.withColumn("form", F.sha2(F.to_json("want"), 256))
    forms = own.groupBy("form").agg(F.first("want").alias("want"))
    return own.select("request", "form"), forms.withColumn(
        "want", F.col("want").withField("groups", _groups(F.col("want.category"))))


def _probes(forms: DataFrame) -> DataFrame:
    """Keys of every form with ``least``, what a case of the key scores at least, and ``most``, what it may score."""
    w = F.col("want")

    def option(value: Column, points: int) -> Column:
        return F.struct(value.alias("value"), F.lit(points).alias("points"))

    def options(column: str, unset: int, chosen: Column) -> Column:
        return F.when(w[column].isNull(), F.array(option(F.lit("*"), unset))).otherwise(
            F.concat(chosen, F.array(option(F.lit("*"), 0))))

    def same(column: str) -> Column:
        return F.concat(F.lit("="), w[column])

    alike = F.transform(w["groups"], lambda g: option(F.concat(F.lit("~"), g), CATEGORY_ALIKE))
    mixed = F.when(w["api_type"] == "mixed", F.lit("!")).otherwise(F.lit("=mixed"))
    keys = [options("category", CATEGORY_UNSET, F.concat(F.array(option(same("category"), CATEGORY_EXACT)), alike)),
            options("api_type", API_UNSET, F.array(option(same("api_type"), API_SAME), option(mixed, API_MIXED))),
            options("design_system", DESIGN_UNSET, F.array(option(same("design_system"), DESIGN_SAME))),
            F.array(option(F.lit("high"), TOTAL_HIGH), option(F.lit("*"), 0))]
    df = reduce(lambda d, kv: d.withColumn(kv[0], F.explode(kv[1])), zip(KEY, keys), forms)
    no_frameworks, no_tags = F.size(w["frameworks"]) == 0, F.size(w["tags"]) == 0
    least = (sum((F.col(c)["points"] for c in KEY[1:]), F.col(KEY[0])["points"])
             + F.when(no_frameworks, FRAMEWORKS_UNSET).otherwise(0) + F.when(no_tags, TAGS_UNSET).otherwise(0))
    more = F.when(no_frameworks, 0).otherwise(FRAMEWORKS) + F.when(no_tags, 0).otherwise(TAGS)
    return df.select("form", "want", *[F.col(c)["value"].alias(c) for c in KEY],
                     F.least(least, F.lit(MOST)).alias("least"), F.least(least + more, F.lit(MOST)).alias("most"))


def points(want: Column, case: Column) -> tuple[Column, Column]:
    """(score, reasons) of a signature for a form."""
    parts: list[tuple[Column, Column]] = []

    def add(criterion: Column, unset: int, earned: Column, reason: Column) -> None:
        earned = F.coalesce(earned, F.lit(0))
        parts.append((F.when(criterion, earned).otherwise(unset), F.when(criterion & (earned > 0), reason)))

    exact = F.coalesce(case["category"] == want["category"], F.lit(False))
    alike = F.arrays_overlap(case["groups"], want["groups"])
    add(want["category"].isNotNull(), CATEGORY_UNSET, F.when(exact, CATEGORY_EXACT).when(alike, CATEGORY_ALIKE),
        F.when(exact, F.lit("category exact")).otherwise(F.lit("category partial")))
    mixed = (case["api_type"] == "mixed") | ((want["api_type"] == "mixed") & case["api_type"].isNotNull())
    add(want["api_type"].isNotNull(), API_UNSET,
        F.when(case["api_type"] == want["api_type"], API_SAME).when(mixed, API_MIXED), F.lit("api type"))
    add(want["design_system"].isNotNull(), DESIGN_UNSET,
        F.when(case["design_system"] == want["design_system"], DESIGN_SAME), F.lit("design system"))
    for name, weight, unset in (("frameworks", FRAMEWORKS, FRAMEWORKS_UNSET), ("tags", TAGS, TAGS_UNSET)):
        shared = F.size(F.array_intersect(case[name], want[name]))
        add(F.size(want[name]) > 0, unset, half_up(F.lit(weight) * (shared / F.nullif(F.size(want[name]), F.lit(0)))),
            F.lit(name))
    add(F.lit(True), 0, F.when(case["high"], TOTAL_HIGH), F.lit("quality"))
    score = F.least(reduce(lambda a, b: a + b, [p for p, _ in parts]), F.lit(MOST)).cast("bigint")
    return score, F.array_compact(F.array(*[r for _, r in parts]))


def _ranked(found: DataFrame, forms: DataFrame, k: int, min_score: int) -> DataFrame:
    """Best ``k`` ids of each form among (form, signature, case, ids); a signature may come by several keys."""
    once = found.groupBy("form", "signature").agg(
        F.first("case").alias("case"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    score, reasons = points(F.col("want"), F.col("case"))
    scored = (once.join(forms, "form").withColumns({"match_score": score, "match_reasons": reasons})
              .filter(F.col("match_score") >= min_score)
              .select("form", "signature", "case", "match_score", "match_reasons", F.explode("ids").alias("id")))
    # an id stored with two signatures counts with the better one
    own = Window.partitionBy("form", "id").orderBy(F.desc("match_score"), "signature")
    best = Window.partitionBy("form").orderBy(F.desc("match_score"), "id")
    return (scored.withColumn("_n", F.row_number().over(own)).filter("_n = 1")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("_n"))


def form_matches(forms: DataFrame, sigs: DataFrame, k: int = 10, min_score: int = 40) -> DataFrame:
    """Best ``k`` ids of each form: form, rank, id, match_score, match_reasons."""
    sigs, probes = pin(sigs, "signatures"), pin(_probes(forms), "probes")
    listed = pin(_listed(sigs).join(probes.select(*KEY).distinct(), KEY, "left_semi"), "listed")
    # a key that holds k cases bounds the k-th best score from below
    full = listed.groupBy(*KEY).agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") >= k)
    floor = probes.join(full, KEY).groupBy("form").agg(F.max("least").alias("floor"))
    open_keys = (probes.join(floor, "form", "left")
                 .filter(F.col("most") >= F.greatest(F.coalesce("floor", F.lit(0)), F.lit(min_score))).drop("floor"))
    first = Window.partitionBy(*KEY).orderBy("id")
    heads = (listed.select(*KEY, "signature", F.explode("ids").alias("id"))
             .withColumn("_n", F.dense_rank().over(first)).filter(F.col("_n") <= k)
             .groupBy(*KEY, "signature").agg(F.collect_set("id").alias("ids"))
             .join(sigs.select("signature", "case"), "signature"))
    seen = pin(open_keys.join(heads, KEY).select("form", "signature", "case", "ids"), "seen")
    # the k-th score of those is a better bound for the keys that are searched by framework and tag
    kth = (_ranked(seen, forms, k, min_score).filter(F.col("rank") == k)
           .select("form", F.col("match_score").alias("kth")))
    searched = (open_keys.join(kth, "form", "left")
                .filter((F.col("most") > F.col("least")) & (F.col("most") >= F.coalesce("kth", F.lit(min_score)))))

    def elements(of: Column) -> Column:
        def named(name: str) -> Column:
            return F.transform(of[name], lambda v: F.concat(F.lit(f"{name}="), v))
        return F.explode(F.array_distinct(F.concat(named("frameworks"), named("tags"))))

    wanted = searched.select("form", *KEY, elements(F.col("want")).alias("element"))
    held = listed.select(*KEY, "signature", "case", "ids", elements(F.col("case")).alias("element"))
    shared = wanted.join(held, [*KEY, "element"]).select("form", "signature", "case", "ids")
    return _ranked(seen.unionByName(shared), forms, k, min_score).select(
        "form", "rank", "id", "match_score", "match_reasons")


def similar_bulk(cases: DataFrame, requests: DataFrame, k: int = 10, min_score: int = 40,
                 min_total: float | None = None, key: str = "request_id") -> DataFrame:
    """Best ``k`` cases for each request: ``key``, rank (from 1), id, match_score, match_reasons.

    ``requests`` have category, api_type, design_system, frameworks and tags; each row is answered, repeated keys as
    often as they occur. Ties go to the smaller id. No cases or no requests give no rows.
    """
    own, forms = forms_of(requests, key)
    best = form_matches(pin(forms, "forms"), signatures(cases, k, min_total=min_total), k, min_score)
    return own.join(best, "form").select(F.col("request").alias(key), "rank", "id", "match_score", "match_reasons")


def _bonus(page: Column, file_category: Column) -> Column:
    """Points of a file's category on a page of category ``page``."""
    def by(order: list[str]) -> Column:
        at = F.array_position(F.array(*[F.lit(c) for c in order]), file_category)
        return F.when(at == 0, 5).otherwise(F.greatest(F.lit(5), 35 - at * 5))

    out = by(R.DEFAULT_PRIORITIES)
    for name, order in R.FILE_PRIORITIES.items():
        out = F.when(page == name, by(order)).otherwise(out)
    return out


def recommend_pages(cases: DataFrame, files: DataFrame, analyses: DataFrame, k: int = 15, min_relevance: int = 30,
                    sources: int = 5, key: str = "request_id", file_key: str = "doc_id") -> DataFrame:
    """Files to reuse for each page: ``key``, rank, file key, case_id, path, file_category, relevance.

    ``analyses`` have category, api_type, design_system, frameworks and features. Each page takes the files of its
    ``sources`` most similar cases, keeps the best per category and name, and of these the best ``k``. Only files of
    chosen cases are read, each text once for every 256 features that are looked for in its case.
    """
    own, forms = forms_of(analyses.withColumn("tags", F.col("features")), key)
    forms = pin(forms, "forms")
    chosen = pin(form_matches(forms, signatures(cases, sources), sources, 35)
                 .select("form", F.col("id").alias("case_id"), "match_score")
                 .join(forms.select("form", F.col("want.category").alias("page"),
                                    F.transform("want.tags", F.lower).alias("features")), "form"), "chosen")
    wanted = chosen.select("case_id", F.explode("features").alias("feature")).distinct()
    blocks = (wanted.withColumn("block", F.floor(F.row_number().over(
        Window.partitionBy("case_id").orderBy("feature")) / NEEDLES))
        .groupBy("case_id", "block").agg(F.collect_list("feature").alias("features")))
    hay = F.lower(F.concat_ws("\n", "content", "path", "purpose"))
    held = (files.select(file_key, "case_id", hay.alias("hay")).join(blocks, "case_id")
            .select(file_key, F.explode(F.filter("features", lambda f: F.contains(F.col("hay"), f))).alias("feature")))
    pairs = chosen.select("form", "case_id", F.explode("features").alias("feature")).join(
        files.select(file_key, "case_id"), "case_id")
    hits = (pairs.join(held, [file_key, "feature"]).groupBy("form", file_key).agg(F.count(F.lit(1)).alias("hits")))
    lines = X.line_count(F.col("content"))
    scored = files.select(
        file_key, "case_id", "path", X.file_category(F.col("path")).alias("file_category"),
        X.base_name(F.col("path")).alias("file_name"),
        F.when(lines.between(50, 500), 10).when(lines > 500, 5).otherwise(0).alias("size"))
    share = F.coalesce(F.col("hits"), F.lit(0)) / F.nullif(F.size("features"), F.lit(0))
    total = (half_up(F.col("match_score") * 0.4) + _bonus(F.col("page"), F.col("file_category")) + F.col("size")
             + F.coalesce(half_up(F.lit(20) * share), F.lit(0)))
    ranked = (chosen.join(scored, "case_id").join(hits, ["form", file_key], "left")
              .withColumn("relevance", F.least(total, F.lit(100)).cast("bigint"))
              .filter(F.col("relevance") >= min_relevance))
    order = [F.desc("relevance"), "case_id", "path", file_key]
    name = Window.partitionBy("form", "file_category", "file_name").orderBy(*order)
    best = (ranked.withColumn("_n", F.row_number().over(name)).filter("_n = 1")
            .withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy(*order)))
            .filter(F.col("rank") <= k))
    return own.join(best, "form").select(
        F.col("request").alias(key), "rank", file_key, "case_id", "path", "file_category", "relevance")
