"""Similar pages and the files worth reusing from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.functions.scoring import half_up
from corpuslens.operators.joins import category_match


def match_score(criteria: dict) -> tuple[Column, Column]:
    """(score, reasons) of a case against the criteria; unset criteria give a little credit."""
    parts: list[tuple[Column, Column]] = []  # points, reason or null

    def add(points: Column, reason: Column) -> None:
        parts.append((points, F.when(points > 0, reason)))

    unset = F.lit(None).cast("string")
    if criteria.get("category"):
        match = category_match(F.col("category"), F.lit(criteria["category"]))
        add(F.when(match == "exact", 35).when(match == "partial", 20).otherwise(0), F.concat_ws(" ", F.lit("category"), match))
    else:
        parts.append((F.lit(15), unset))
    if criteria.get("api_type"):
        wanted = criteria["api_type"]
        mixed = (F.col("api_type") == "mixed") | (F.lit(wanted == "mixed") & F.col("api_type").isNotNull())
        add(F.when(F.col("api_type") == wanted, 25).when(mixed, 15).otherwise(0), F.lit("api type"))
    else:
        parts.append((F.lit(10), unset))
    if criteria.get("design_system"):
        add(F.when(F.col("design_system") == criteria["design_system"], 20).otherwise(0), F.lit("design system"))
    else:
        parts.append((F.lit(8), unset))
    for name, weight, neutral in (("frameworks", 15, 6), ("tags", 5, 2)):
        wanted = criteria.get(name)
        if wanted:
            shared = F.size(F.array_intersect(F.array_distinct(name), F.array(*[F.lit(w) for w in wanted])))
            add(half_up(F.lit(weight) * (shared / F.lit(len(wanted)))), F.lit(name))
        else:
            parts.append((F.lit(neutral), unset))
    add(F.when(F.col("total_score") >= 85, 5).otherwise(0), F.lit("quality"))
    score = F.least(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p, _ in parts]), F.lit(100)).cast("bigint")
    return score, F.array_compact(F.array(*[r for _, r in parts]))


def similar(cases: DataFrame, criteria: dict, min_score: int = 40, k: int = 10, min_total: float | None = None) -> DataFrame:
    """Best k cases for the criteria; one pass and a bounded top-k."""
    score, reasons = match_score(criteria)
    df = cases.withColumns({"match_score": score, "match_reasons": reasons}).filter(F.col("match_score") >= min_score)
    if min_total:
        # an unscored case is not held to the minimum
        df = df.filter((F.coalesce("total_score", F.lit(0.0)) == 0) | (F.col("total_score") >= min_total))
    return df.orderBy(F.desc("match_score"), "id").limit(k)


def category_bonus(file_category: Column, page_category: str | None) -> Column:
    order = R.FILE_PRIORITIES.get((page_category or "").lower(), R.DEFAULT_PRIORITIES)
    at = F.array_position(F.array(*[F.lit(c) for c in order]), file_category)
    return F.when(at == 0, 5).otherwise(F.greatest(F.lit(5), 35 - at * 5))


def file_points(files: DataFrame, analysis: dict, text: str = "content") -> DataFrame:
    """Add file_category and points: category, features and size. Narrow.

    Needs path, purpose and the text; everything that reads the text is done
    here, before any join.
    """
    df = files.withColumns({"file_category": X.file_category(F.col("path")), "_lines": X.line_count(F.col(text))})
    score = category_bonus(F.col("file_category"), analysis.get("category"))
    features = analysis.get("features") or []
    if features:
        df = df.withColumn("_hay", F.lower(F.concat_ws("\n", text, "path", "purpose")))
        hits = reduce(lambda a, b: a + b, [F.contains("_hay", F.lit(f.lower())).cast("int") for f in features])
        score = score + half_up(F.lit(20) * (hits / F.lit(len(features))))
    size = F.when(F.col("_lines").between(50, 500), 10).when(F.col("_lines") > 500, 5).otherwise(0)
    return df.withColumn("points", score + size).drop("_lines", "_hay")


def relevance(files: DataFrame, pages: DataFrame, analysis: dict, text: str = "content", keep_text: bool = False) -> DataFrame:
    """Files of the pages with file_category and relevance (at most 100).

    ``files``: case_id, path, purpose and the text; ``pages``: case_id and
    match_score. The text stays behind unless asked for.
    """
    scored = file_points(files, analysis, text)
    joined = (scored if keep_text else scored.drop(text)).join(pages, "case_id")
    total = half_up(F.col("match_score") * 0.4) + F.col("points")
    return joined.withColumn("relevance", F.least(total, F.lit(100)).cast("bigint")).drop("points")


def keep_best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row per key in the given order; hot keys are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def recommend_page(cases: DataFrame, files: DataFrame, analysis: dict, k: int = 15, min_relevance: int = 30) -> DataFrame:
    """Files to reuse for a page: five similar cases, relevant files, best per name, top k.

    ``files`` carries ``case_id``, path, content and purpose.
    """
    criteria = {c: analysis.get(c) for c in ("category", "api_type", "design_system", "frameworks")}
    criteria["tags"] = analysis.get("features")
    sources = similar(cases, criteria, min_score=35, k=5).select(
        F.col("id").alias("case_id"), F.col("project").alias("source_project"), "match_score")
    # the five cases come first: only their files are read as text
    chosen = files.join(sources.select("case_id"), "case_id", "left_semi")
    ranked = relevance(chosen, sources, analysis, keep_text=True).filter(F.col("relevance") >= min_relevance)
    ranked = ranked.withColumn("file_name", X.base_name(F.col("path")))
    best = keep_best(ranked, ["file_category", "file_name"], F.desc("relevance"), "case_id", "path")
    return best.orderBy(F.desc("relevance"), "case_id", "path").limit(k)


def group_ordered(files: DataFrame, order=R.FILE_CATEGORY_ORDER, category: str = "file_category") -> DataFrame:
    """Rows sorted by the fixed category order, with the category's place."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(category))
    return files.withColumn("category_place", place).orderBy("category_place", F.desc("relevance"), "path")
