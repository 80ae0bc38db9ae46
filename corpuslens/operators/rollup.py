"""Rolling file metadata up to projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import rules as R, scoring as S
from corpuslens.functions.text import contains_any

LIST_FIELDS = ["frameworks", "patterns", "dependencies", "components_used", "composables_used",
               "entities", "api_methods"]
SINGLE_FIELDS = ["category", "complexity", "api_type", "design_system", "utility_library",
                 "error_handling", "type_definitions"]
DOMINANT = {"api_type": "none", "design_system": None, "utility_library": None}


def _score_features() -> list[str]:
    return sorted({R.feature_name(t[1]) for terms in R.PROJECT_SCORE_TERMS.values() for t in terms if t[0] != "base"})


def _reason_flags() -> list[str]:
    return [f for f in _score_features() if R.COUNTED.get(f, ("",))[0] == "excellent"]


def project_values(meta: DataFrame, by: str = "project", order: str = "doc_id") -> DataFrame:
    """Distinct values per project and field, with files, lines and first occurrence.

    One explode feeds one aggregation for all fields. Rows stay long, so a
    project with millions of distinct values is many rows, never one array,
    and partial aggregation folds repeats before the shuffle.
    """
    def one(field: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(field).alias("field"), value.cast("string").alias("value")))

    def many(field: str) -> Column:
        return F.transform(F.array_distinct(F.col(field)),
                           lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    def reason(needles: list[str]) -> Column:
        return F.exists("excellent_reasons", lambda r: contains_any(F.lower(r), needles))

    flags = [one(f, F.when(F.col("is_excellent") & reason(R.COUNTED[f][1]), F.lit("yes")))
             for f in _reason_flags()]
    pairs = F.concat(*[one(f, F.col(f)) for f in SINGLE_FIELDS], *[many(f) for f in LIST_FIELDS],
                     one("excellent", F.when(F.col("is_excellent"), F.lit("yes"))), *flags)
    rows = meta.select(by, F.col(order).alias("ord"), "lines_of_code",
                       F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p"))
    return (rows.groupBy(by, F.col("p.field").alias("field"), F.col("p.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("files"), F.sum("lines_of_code").alias("lines"),
                 F.min("ord").alias("first_seen")))


def project_rollup(values: DataFrame, by: str = "project") -> DataFrame:
    """One row per project from ``project_values``: counts, dominant values, levels."""
    field, n = F.col("field"), F.col("files")

    def files_with(f: str, *wanted: str) -> Column:
        return F.coalesce(F.sum(F.when((field == f) & F.col("value").isin(*wanted), n)), F.lit(0))

    def distinct(f: str) -> Column:
        return F.count_if(field == f)

    def histogram(f: str) -> Column:  # category and complexity come from closed lists
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(field == f, F.struct("value", "files")))))

    index = S.level_index(F.col("value"))
    dominant = {f: F.max(F.when(field == f, F.struct(n, -F.col("first_seen"), F.col("value"))))["value"]
                for f in DOMINANT}
    counts = {name: distinct(name) for name in LIST_FIELDS}
    for name in _score_features():
        f, needles = R.COUNTED.get(name, ("excellent", []))
        if f != "excellent":
            counts[name] = F.count_if((field == f) & contains_any(F.col("value"), needles))
    for name in _reason_flags():
        counts[name] = files_with(name, "yes")
    return (values.groupBy(by).agg(
        F.sum(F.when(field == "complexity", n)).alias("total_files"),
        F.sum(F.when(field == "complexity", F.col("lines"))).alias("total_lines_of_code"),
        distinct("category").alias("categories"),
        histogram("category").alias("files_by_category"),
        histogram("complexity").alias("complexity_distribution"),
        F.sum(F.when(field == "complexity", n * index)).alias("_level_sum"),
        *[F.coalesce(c, F.lit(DOMINANT[f])).alias(f) for f, c in dominant.items()],
        files_with("error_handling", "comprehensive").alias("files_with_good_error_handling"),
        files_with("type_definitions", "excellent", "good").alias("files_with_good_types"),
        files_with("excellent", "yes").alias("excellent_files"),
        F.max(F.when((field == "frameworks") & (F.col("value") == "pinia"), 2)
              .when((field == "frameworks") & (F.col("value") == "vuex"), 1)).alias("_state"),
        *[c.alias(name) for name, c in counts.items()])
        .withColumns({
            "complexity": S.level_name(S.half_up(F.col("_level_sum") / F.col("total_files"))),
            "state_library": F.when(F.col("_state") == 2, "pinia").when(F.col("_state") == 1, "vuex").otherwise("none")})
        .drop("_level_sum", "_state"))


def project_features(rollup: DataFrame) -> DataFrame:
    """Add the ratios and flags the project score terms use."""
    files = F.col("total_files")
    return rollup.withColumns({
        "has_api": F.col("api_type") != "none",
        "has_design_system": F.col("design_system").isNotNull(),
        "has_utility_library": F.col("utility_library").isNotNull(),
        "excellent_ratio": F.col("excellent_files") / files,
        "good_error_ratio": F.col("files_with_good_error_handling") / files,
        "good_type_ratio": F.col("files_with_good_types") / files})


def build_exemplars(rollup: DataFrame) -> DataFrame:
    """Scored projects that the save rule keeps, with the rule's reason."""
    scored = project_features(rollup).select("*", *S.project_scores()).withColumns({
        "total_score": S.weighted_total(), "excellent_in": S.excellent_in()})
    decided = scored.withColumn("decision", S.save_decision(F.col("total_score"), F.col("excellent_in")))
    return decided.filter("decision.should_save").withColumn("scoring_version", F.lit(R.SCORING_VERSION))


def project_score(meta: DataFrame, by: str = "project") -> DataFrame:
    """Single score per project: mean of file scores plus three ratios; tier histogram."""
    rows = meta.withColumn("_score", S.single_score()).withColumn("_tier", S.tier(F.col("_score")))
    n = F.count(F.lit(1))
    agg = rows.groupBy(by).agg(
        n.alias("files"), F.avg("_score").alias("mean"),
        (F.count_if("is_excellent") / n * 20).alias("e"),
        (F.count_if(F.col("error_handling") == "comprehensive") / n * 10).alias("h"),
        (F.count_if(F.col("type_definitions").isin("excellent", "good")) / n * 10).alias("q"),
        *[F.count_if(F.col("_tier") == t).alias(f"tier_{t}") for t in ("S", "A", "B", "C", "D")])
    overall = F.greatest(F.lit(0.0), S.capped(F.col("mean") + F.col("e") + F.col("h") + F.col("q")))
    parts = {"overall": overall, "average": F.col("mean"), "excellent": F.col("e"),
             "error_handling": F.col("h"), "type_quality": F.col("q")}
    return agg.select(by, "files", *[S.half_up(c).cast("bigint").alias(name) for name, c in parts.items()],
                      *[f"tier_{t}" for t in ("S", "A", "B", "C", "D")])


def dominant(df: DataFrame, by: str, value: str, order: str, default: str | None = "none") -> DataFrame:
    """Most frequent value per group; the one seen first wins ties.

    Two partial aggregations instead of a window: a hot group arrives as one
    row per distinct value.
    """
    counted = df.groupBy(by, value).agg(
        F.count(F.col(value)).alias("n"), F.min(order).alias("first_seen"))
    best = F.max(F.when(F.col("n") > 0, F.struct("n", (-F.col("first_seen")).alias("o"), F.col(value).alias("v"))))
    return counted.groupBy(by).agg(best.alias("best")).select(
        by, F.coalesce("best.v", F.lit(default)).alias("dominant"), F.coalesce("best.n", F.lit(0)).alias("n"))


def average_level(df: DataFrame, by: str, level: str) -> DataFrame:
    """Mean ordinal level per group, rounded back to a level."""
    return df.groupBy(by).agg(F.avg(S.level_index(F.col(level))).alias("mean")).select(
        by, S.level_name(S.half_up(F.col("mean"))).alias("average_level"))


def text_stats(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.sum("lines_of_code").alias("total_lines_of_code"),
        F.count_if(F.col("error_handling") == "comprehensive").alias("files_with_good_error_handling"),
        F.count_if(F.col("type_definitions").isin("excellent", "good")).alias("files_with_good_types"))


def corpus_summary(scored: DataFrame, score: str = "total_score", path: str = "path",
                   k: int = 5, excellent_from: int = 85) -> DataFrame:
    """One row: files, mean score, excellent files and the top k paths.

    The top k is its own bounded query and enters as a scalar subquery.
    """
    top = (scored.select(path, score).orderBy(F.desc(score), path).limit(k)
           .agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(path).alias("p")))).alias("t"))
           .select(F.transform("t", lambda x: x["p"])))
    return scored.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_score"),
        F.count_if(F.col(score) >= excellent_from).alias("excellent_files"),
    ).withColumn("top_files", top.scalar())


def top_files(scored: DataFrame, k: int, score: str = "total_score", key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def explode_snippets(df: DataFrame, snippets: str = "snippets", min_score: float | None = 85) -> DataFrame:
    """One row per snippet, those below ``min_score`` dropped."""
    rows = df.select("*", F.explode(snippets).alias("snippet")).drop(snippets)
    return rows if min_score is None else rows.filter(F.col("snippet.score") >= min_score)
