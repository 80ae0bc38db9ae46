"""Joins and set operations between records, requests, guides and projects.

No side is hinted: the optimizer broadcasts what it measures to be small and
shuffles (and splits skewed partitions) otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import rules as R


def join_postings(postings: DataFrame, cases: DataFrame, key: str = "id") -> DataFrame:
    """Posting ids resolved to records."""
    return postings.join(cases, key)


def join_guides_by_id(requests: DataFrame, guides: DataFrame, ids: str = "wanted", key: str = "request_id") -> DataFrame:
    """Guides a request names, in the order it names them; unknown ids drop out.

    ``position`` counts all named ids from 1; a repeated id counts at its first place.
    """
    wanted = requests.select(key, F.posexplode(ids).alias("position", "id"))
    first = wanted.groupBy(key, "id").agg((F.min("position") + 1).cast("bigint").alias("position"))
    return first.join(guides, "id")


def first_with_value(df: DataFrame, by: str, values: str, order: str, path: str) -> DataFrame:
    """First file (in ``order``) of each group that has a value: (by, value, path)."""
    return (df.select(by, F.explode(F.array_distinct(values)).alias("value"), order, path)
            .groupBy(by, "value").agg(F.min_by(F.struct(order, path), order).alias("_f"))
            .select(by, "value", f"_f.{order}", f"_f.{path}"))


def pick_exemplar(projects: DataFrame, exemplars: DataFrame, on: str = "api_type", order: str = "project") -> DataFrame:
    """First exemplar (in ``order``) that shares the project's ``on`` value."""
    first = exemplars.groupBy(on).agg(F.min_by("project", order).alias("exemplar"))
    return projects.join(first, on)


def alias_groups(value: Column, aliases=R.CATEGORY_ALIASES) -> Column:
    """Names of the alias groups a category belongs to, by substring either way."""
    low = F.lower(value)

    def member(key: str, words: list[str]) -> Column:
        tests = [F.contains(low, F.lit(w)) | F.contains(F.lit(w), low) for w in [key, *words]]
        return F.when(reduce(lambda a, b: a | b, tests), F.lit(key))

    return F.array_compact(F.array(*[member(k, w) for k, w in aliases]))


def category_match(actual: Column, target: Column) -> Column:
    """exact, partial (a shared alias group) or none."""
    return (F.when(F.lower(actual) == F.lower(target), "exact")
            .when(F.arrays_overlap(alias_groups(actual), alias_groups(target)), "partial").otherwise("none"))


def join_category_alias(pages: DataFrame, targets: DataFrame, category: str = "category", target: str = "target") -> DataFrame:
    """Pages with every target category they match, exactly or by alias group.

    Groups are worked out once per distinct value, so the theta join becomes
    two equi joins: distinct values on a group name, then pages on the value.
    """
    def grouped(df: DataFrame, column: str) -> DataFrame:
        names = F.concat(F.array(F.concat(F.lit("="), F.lower(column))), alias_groups(F.col(column)))
        return df.select(column).distinct().select(column, F.explode(names).alias("_g"))

    exact = F.lower(category) == F.lower(target)
    matches = (grouped(pages, category).join(grouped(targets, target), "_g")
               .select(category, target, F.when(exact, "exact").otherwise("partial").alias("match")).distinct())
    return pages.join(matches, category)


def anti_join_completed(projects: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return projects.join(completed.select(key), key, "left_anti")


def anti_join_missing(pairs: DataFrame, values: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Exemplar values its paired project lacks: (project, exemplar, field, value).

    ``values``: (project, field, value), long; nothing is gathered into arrays.
    """
    if fields:
        values = values.filter(F.col("field").isin(fields))
    offered = pairs.select("project", "exemplar").join(
        values.select(F.col("project").alias("exemplar"), "field", "value"), "exemplar")
    own = values.select("project", "field", "value")
    return offered.join(own, ["project", "field", "value"], "left_anti")


def missing_counts(pairs: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """How many exemplar values each paired project lacks: (project, exemplar, field, n).

    The exemplar's values less those the project has too. The project's own rows meet the exemplar's by equality, so
    the work follows the projects' values and an exemplar of many projects is not repeated for each.
    """
    values = values.filter(F.col("field").isin(fields))
    offered = pairs.select("project", "exemplar").join(
        values.groupBy(F.col("project").alias("exemplar"), "field").agg(F.count(F.lit(1)).alias("offered")), "exemplar")
    own = pairs.select("project", "exemplar").join(values.select("project", "field", "value"), "project")
    theirs = values.select(F.col("project").alias("exemplar"), "field", "value")
    shared = (own.join(theirs, ["exemplar", "field", "value"]).groupBy("project", "exemplar", "field")
              .agg(F.count(F.lit(1)).alias("shared")))
    return offered.join(shared, ["project", "exemplar", "field"], "left").select(
        "project", "exemplar", "field", (F.col("offered") - F.coalesce("shared", F.lit(0))).alias("n"))


def except_patterns(pairs: DataFrame, values: DataFrame, field: str = "patterns") -> DataFrame:
    """Set form for one field: exemplar rows of every pair EXCEPT the project's own rows."""
    pairs, values = pairs.select("project", "exemplar"), values.filter(F.col("field") == field)
    theirs = pairs.join(values.select(F.col("project").alias("exemplar"), "field", "value"), "exemplar")
    own = pairs.join(values.select("project", "field", "value"), "project")
    columns = ["project", "exemplar", "field", "value"]
    return theirs.select(*columns).subtract(own.select(*columns))


def missing_values(wanted: Column, present: Column) -> Column:
    """Array form, for rows that already hold both (short) lists."""
    return F.array_except(wanted, present)


def union_mandatory(scored: DataFrame, mandatory: DataFrame, key: str = "id") -> DataFrame:
    """Mandatory rows pre-empt scored rows with the same key; score 1000."""
    first = mandatory.withColumn("score", F.lit(1000.0))
    return scored.join(mandatory.select(key), key, "left_anti").unionByName(first.select(*scored.columns))


def with_mandatory(requests: DataFrame, guides: DataFrame, first: int | None = None) -> DataFrame:
    """``requests`` with each guide that always applies (``id``), or with the ``first`` of them by id.

    The result has requests x guides rows by its meaning. Requests are dealt over slots and the mandatory guides
    copied to each, so that they meet in an equi join that every task has a share of.
    """
    spread = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    must = guides.filter("mandatory").select("id").distinct()
    if first is not None:
        must = must.orderBy("id").limit(first)
    copies = must.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = requests.withColumn("_slot", F.pmod(F.xxhash64(*requests.columns), F.lit(spread)).cast("int"))
    return dealt.join(copies, "_slot").drop("_slot")


def union_distinct_ids(first: DataFrame, second: DataFrame, by: str = "request_id", key: str = "id",
                       order: str = "position") -> DataFrame:
    """Ids of both inputs per request, each once, at its earliest place."""
    both = (first.select(by, key, F.lit(0).alias("_s"), order)
            .unionByName(second.select(by, key, F.lit(1).alias("_s"), order)))
    return both.groupBy(by, key).agg(F.min(F.struct("_s", order)).alias("rank"))


def union_keywords(requests: DataFrame, hits: DataFrame, by: str = "request_id") -> DataFrame:
    """Request keywords together with the keywords and patterns of its hits, long and distinct."""
    own = requests.select(by, F.explode("keywords").alias("keyword"))
    found = hits.select(by, F.explode(F.concat("keywords", "patterns")).alias("keyword"))
    return own.unionByName(found).distinct()
