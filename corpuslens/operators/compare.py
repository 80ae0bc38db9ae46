"""Comparing projects with exemplars and listing the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import rules as R, scoring as S
from corpuslens.functions.scoring import half_up, lookup

PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}


def compare(pairs: DataFrame, rollup: DataFrame, missing: DataFrame) -> DataFrame:
    """One row per (project, exemplar): counts of missing values and quality gaps in points.

    ``missing``: counts from ``joins.missing_counts``, or the long rows of ``joins.anti_join_missing``.
    """
    n = F.col("n") if "n" in missing.columns else F.lit(1)
    lacking = missing.groupBy("project", "exemplar").agg(
        *[F.coalesce(F.sum(F.when(F.col("field") == f, n)), F.lit(0)).alias(name) for f, name in
          (("patterns", "missing_patterns"), ("api_methods", "unused_methods"), ("components_used", "unused_components"))])

    def side(prefix: str, key: str) -> DataFrame:
        share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.greatest(F.col("total_files"), F.lit(1))
        level = F.coalesce("complexity", F.lit("medium"))
        return rollup.select(F.col("project").alias(key), level.alias(f"{prefix}_complexity"),
                             S.level_index(level).alias(f"{prefix}_level"),
                             share("files_with_good_error_handling").alias(f"{prefix}_errors"),
                             share("files_with_good_types").alias(f"{prefix}_types"))

    def gap(name: str) -> Column:
        return half_up((F.col(f"e_{name}") - F.col(f"p_{name}")) * 100).cast("bigint")

    zero = ["missing_patterns", "unused_methods", "unused_components"]
    return (pairs.select("project", "exemplar").join(side("p", "project"), "project").join(side("e", "exemplar"), "exemplar")
            .join(lacking, ["project", "exemplar"], "left")
            .select("project", "exemplar", F.col("p_complexity").alias("project_complexity"),
                    F.col("e_complexity").alias("exemplar_complexity"),
                    (F.col("p_level") - F.col("e_level")).cast("bigint").alias("complexity_difference"),
                    gap("errors").alias("error_handling_gap"), gap("types").alias("type_quality_gap"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in zero]))


def _todo(rule: int, name, reason: Column, files: list[str] | Column, loc: Column, priority) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    paths = files if isinstance(files, Column) else F.array(*[F.lit(f) for f in files])
    return F.struct(F.lit(rule).alias("rule_no"), wrap(name).alias("todo"), reason.alias("reason"), paths.alias("files"),
                    loc.cast("bigint").alias("loc"), wrap(priority).alias("priority"))


def gap_todos(compared: DataFrame, missing: DataFrame) -> DataFrame:
    """To-dos of every pair, high priority first, then rule, then pattern."""
    c = F.col
    levels = F.concat(F.lit(" ("), c("project_complexity"), F.lit(" against "), c("exemplar_complexity"), F.lit(")"))
    points = lambda name: F.concat(F.lit("behind by "), c(name).cast("string"), F.lit(" points"))

    def rule(number: int, reason: Column, times: Column | None = None) -> Column:
        todo, files, loc, priority = R.GAP_RULES[number]
        return _todo(number, todo, reason, files, F.lit(loc) if times is None else times * loc, priority)

    rules = F.array_compact(F.array(
        F.when(c("error_handling_gap") > 20, rule(2, points("error_handling_gap"))),
        F.when(c("type_quality_gap") > 20, rule(3, points("type_quality_gap"))),
        F.when(c("complexity_difference") > 1, rule(4, F.concat(F.lit("more complex"), levels))),
        F.when(c("unused_methods") > 0, rule(
            5, F.concat(c("unused_methods").cast("string"), F.lit(" more api methods in the exemplar")), c("unused_methods"))),
        F.when(c("unused_components").between(1, 10), rule(
            6, F.concat(c("unused_components").cast("string"), F.lit(" components of the exemplar unused"))))))
    by_rule = compared.select("project", "exemplar", F.explode(rules).alias("t")).select("project", "exemplar", "t.*")
    p = F.col("value")
    capital = F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2), F.length(p)))
    file = F.coalesce(lookup(p, R.PATTERN_FILES), F.concat(F.lit("composables/use"), capital, F.lit(".ts")))
    by_pattern = missing.filter("field = 'patterns'").select("project", "exemplar", _todo(
        1, F.concat(F.lit("add-"), p, F.lit("-pattern")), F.concat(F.lit("the exemplar uses the "), p, F.lit(" pattern")),
        F.array(file), lookup(p, R.PATTERN_LOC, 20), lookup(p, R.PATTERN_PRIORITY, "low")).alias("t")
    ).select("project", "exemplar", "t.*")
    return (by_rule.unionByName(by_pattern).withColumn("priority_rank", lookup(F.col("priority"), PRIORITY_RANK))
            .orderBy("project", "exemplar", "priority_rank", "rule_no", "todo"))


def reference_files(meta: DataFrame, k: int = 3, order: str = "doc_id") -> DataFrame:
    """Best k files per project for error handling and for types, by single score."""
    kinds = F.array_compact(F.array(F.when(F.col("error_handling") == "comprehensive", F.lit("error-handling")),
                                    F.when(F.col("type_definitions") == "excellent", F.lit("types"))))
    rows = meta.withColumn("score", S.single_score()).select(
        "project", F.explode(kinds).alias("kind"), "path", order, "score", S.tier(F.col("score")).alias("tier"))
    w = Window.partitionBy("project", "kind").orderBy(F.desc("score"), order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
