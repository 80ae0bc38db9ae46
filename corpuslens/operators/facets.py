"""Posting tables, facet search and record search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import ArrayType

from corpuslens.functions import rules as R


def facet_postings(df: DataFrame, facets: dict[str, str], key: str = "id") -> DataFrame:
    """Long posting table (facet, term, id): one explode over all facets.

    Write it with ``partitionBy("facet")``; a popular term is many rows, not
    one long list.
    """
    def entries(facet: str, column: str) -> Column:
        values = F.col(column) if isinstance(df.schema[column].dataType, ArrayType) else F.array(F.col(column))
        return F.transform(F.array_distinct(F.array_compact(values)),
                           lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("term")))

    pairs = F.concat(*[entries(f, c) for f, c in facets.items()])
    return df.select(F.explode(pairs).alias("p"), key).select("p.facet", "p.term", key)


def facet_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("facet", "term").agg(F.count(F.lit(1)).alias("n"))


def facet_stats(postings: DataFrame) -> DataFrame:
    """Totals, distinct projects and tags, cases per dimension and per grade (zeros kept)."""
    counts = facet_counts(postings)
    spark = postings.sparkSession
    closed = [("excellence", d) for d in R.DIMENSIONS] + [("grade", g) for g, _ in R.GRADES] + [("grade", "poor")]
    zeros = spark.createDataFrame([(f, t, 0) for f, t in closed], "facet STRING, term STRING, n BIGINT")
    fixed = (counts.filter(F.col("facet").isin("excellence", "grade")).unionByName(zeros)
             .groupBy("facet", "term").agg(F.sum("n").alias("n")))
    totals = counts.agg(
        F.coalesce(F.sum(F.when(F.col("facet") == "project", F.col("n"))), F.lit(0)).alias("cases"),
        F.count_if(F.col("facet") == "project").alias("projects"),
        F.count_if(F.col("facet") == "tag").alias("tags"))
    return fixed.unionByName(
        totals.unpivot([], ["cases", "projects", "tags"], "term", "n")
        .select(F.lit("total").alias("facet"), "term", F.col("n").cast("bigint").alias("n")))


def search_facets(postings: DataFrame, cases: DataFrame, key: str = "id", project: str | None = None,
                  excellent: list[str] | None = None, tags: list[str] | None = None, grade: str | None = None,
                  min_total: float | None = None) -> DataFrame:
    """Cases in every requested facet; terms inside a facet are alternatives.

    Without any filter all cases come back. Each facet is a pruned scan of the
    posting table and a left semi join.
    """
    wanted = {"project": [project] if project else None, "excellence": excellent, "tag": tags,
              "grade": [grade] if grade else None}
    found = cases
    if min_total is not None:
        found = found.filter(F.coalesce("total_score", F.lit(0)) >= min_total)
    for facet, terms in wanted.items():
        if terms:
            found = semi_join_facet(found, postings, facet, terms, key)
    return found


def semi_join_facet(cases: DataFrame, postings: DataFrame, facet: str, terms: list[str], key: str = "id") -> DataFrame:
    hits = postings.filter((F.col("facet") == facet) & F.col("term").isin(terms)).select(key)
    return cases.join(hits, key, "left_semi")


def intersect_facets(postings: DataFrame, wanted: dict[str, list[str]], key: str = "id") -> DataFrame:
    """Ids found in every requested facet."""
    sets = [postings.filter((F.col("facet") == f) & F.col("term").isin(ts)).select(key) for f, ts in wanted.items()]
    return reduce(lambda a, b: a.intersect(b), sets)


def _any_contains(values: str, wanted: list[str]) -> Column:
    def one(word: str) -> Column:
        return F.exists(values, lambda v: F.contains(F.lower(v), F.lit(word.lower())))
    return reduce(lambda a, b: a | b, [one(w) for w in wanted])


def search_files(df: DataFrame, project: str | None = None, file_type: str | None = None, role: str | None = None,
                 keywords: list[str] | None = None, keywords_all: list[str] | None = None,
                 min_scores: dict[str, float] | None = None, entities: list[str] | None = None,
                 components: list[str] | None = None, methods: list[str] | None = None,
                 limit: int | None = None, order: str = "doc_id") -> DataFrame:
    """Conjunction of filters; list filters match substrings of elements, case ignored.

    Scalar filters come first: they can reach the scan, the list filters cannot.
    """
    for column, value in (("project", project), ("file_type", file_type), ("file_role", role)):
        if value:
            df = df.filter(F.col(column) == value)
    for dimension, least in (min_scores or {}).items():
        df = df.filter(F.col(dimension) >= least)
    if keywords:
        df = df.filter(_any_contains("keywords", keywords))
    for word in keywords_all or []:
        df = df.filter(_any_contains("keywords", [word]))
    for column, wanted in (("entities", entities), ("components_used", components), ("api_methods", methods)):
        if wanted:
            df = df.filter(_any_contains(column, wanted))
    return df.orderBy(order).limit(limit) if limit else df


# shortcuts: a limit keeps the first rows in id order
def by_keywords(df: DataFrame, *words: str, limit: int | None = None) -> DataFrame:
    return search_files(df, keywords=list(words), limit=limit)


def by_function(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    return search_files(df, keywords=[name], limit=limit)


def by_min_score(df: DataFrame, dimension: str, least: float, limit: int | None = None) -> DataFrame:
    return search_files(df, min_scores={dimension: least}, limit=limit)


def by_role(df: DataFrame, role: str, project: str | None = None, limit: int | None = None) -> DataFrame:
    return search_files(df, project=project, role=role, limit=limit)


def by_entity(df: DataFrame, entity: str, limit: int | None = None) -> DataFrame:
    return search_files(df, entities=[entity], limit=limit)


def recommended_code(df: DataFrame, function: str, role: str | None = None, entities: list[str] | None = None,
                     limit: int | None = None) -> DataFrame:
    return search_files(df, keywords=[function], role=role, entities=entities, limit=limit)


def search_exact(df: DataFrame, project: str | None = None, category: str | None = None,
                 tags: list[str] | None = None) -> DataFrame:
    """Equality on project and category, any of the tags."""
    for column, value in (("project", project), ("category", category)):
        if value:
            df = df.filter(F.col(column) == value)
    return df.filter(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags]))) if tags else df


def score_ranges(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Per-dimension bounds; rows without a score drop out."""
    for dimension, (low, high) in ranges.items():
        df = df.filter(F.col(dimension).isNotNull())
        if low is not None:
            df = df.filter(F.col(dimension) >= low)
        if high is not None:
            df = df.filter(F.col(dimension) <= high)
    return df


def rank_cases(df: DataFrame, key: str = "id") -> DataFrame:
    """Total first, then excellent dimensions, then legacy tier, then name; unscored last."""
    tiers = {"S": 5, "A": 4, "B": 3, "C": 2, "D": 1}
    legacy = F.coalesce(*[F.when(F.col("legacy_tier") == t, n) for t, n in tiers.items()], F.lit(0))
    return df.orderBy(
        F.desc_nulls_last("total_score"),
        F.desc(F.when(F.col("total_score").isNotNull(), F.size("excellent_in")).otherwise(0)),
        F.desc(legacy), "project", key)


def first_match(df: DataFrame, order: str = "id", **equal: str) -> DataFrame:
    """First record that equals all given values, projected by the caller."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df.orderBy(order).limit(1)


def load_one(df: DataFrame, value, key: str = "id") -> Row:
    """The record with that key; a missing one is an error."""
    row = df.filter(F.col(key) == value).first()
    if row is None:
        raise KeyError(f"no record with {key} = {value!r}")
    return row


def by_keys(df: DataFrame, keys: DataFrame, key: str = "id", found: str = "found") -> DataFrame:
    """Bulk point lookup: every key comes back, ``found`` tells whether it exists."""
    return keys.join(df.withColumn(found, F.lit(True)), key, "left").withColumn(
        found, F.coalesce(found, F.lit(False)))

