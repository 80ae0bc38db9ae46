"""Substring conditions on list columns, answered from an index of distinct terms.

Three written tables: grams (field, gram, term) of the distinct terms, and postings (field, bucket, term, key). A
needle meets terms on the piece of it that fewest terms have, is looked up in those terms, and only the postings of
terms that hold it are joined. Records are not read until their keys are known, and no record's lists are scanned.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.operators.strings import GRAM, _grams
from corpuslens.sources.store import write_table

BUCKETS = 32        # folders of a field's postings, by a hash of the term


class TermIndex(NamedTuple):
    grams: DataFrame        # field, gram, term
    postings: DataFrame     # field, bucket, term, key
    key: str


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings_of(records: DataFrame, fields: dict[str, str], key: str = "id") -> DataFrame:
    """(field, term, key), terms lower-cased; null lists and null elements give no row, repeats one."""
    def entries(field: str, column: str) -> Column:
        values = F.array_distinct(F.transform(F.array_compact(column), F.lower))
        return F.coalesce(F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("term"))),
                          F.array().cast("array<struct<field:string,term:string>>"))

    pairs = F.concat(*[entries(f, c) for f, c in fields.items()])
    return records.select(key, F.explode(pairs).alias("p")).select("p.field", "p.term", key)


def build_index(records: DataFrame, fields: dict[str, str], key: str = "id") -> TermIndex:
    """Index of the list columns ``fields`` (name in the index: column). Texts of terms are cut once per distinct term."""
    rows = postings_of(records, fields, key).withColumn("bucket", _bucket(F.col("term")))
    postings = write_table(rows, "term-postings", ["field", "bucket"])
    terms = postings.select("field", "term").distinct()
    grams = write_table(terms.select("field", "term", F.explode(_grams(F.col("term"))).alias("gram")), "term-grams", ["field"])
    return TermIndex(grams, postings, key)


def terms_with(needles: DataFrame, index: TermIndex) -> DataFrame:
    """Distinct (field, needle, term) of the terms that hold the needle, case ignored; an empty needle is in every term.

    ``needles``: field, needle.
    """
    asked = needles.select("field", "needle", F.lower("needle").alias("low")).filter("needle IS NOT NULL").distinct()
    size = F.least(F.length("low"), F.lit(GRAM))
    pieces = asked.filter(F.length("low") > 0).select(
        "field", "needle", "low", F.explode(F.filter(_grams(F.col("low")), lambda g: F.length(g) == size)).alias("gram"))
    counts = index.grams.join(pieces.select("field", "gram").distinct(), ["field", "gram"], "left_semi").groupBy(
        "field", "gram").agg(F.count(F.lit(1)).alias("n"))
    # a piece that no term has makes the needle a miss: it must come out as the rarest
    rarest = (pieces.join(counts, ["field", "gram"], "left").groupBy("field", "needle", "low")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    held = (rarest.join(index.grams, ["field", "gram"]).filter(F.contains("term", F.col("low")))
            .select("field", "needle", "term"))
    every = (asked.filter(F.length("low") == 0).select("field", "needle")
             .join(index.postings.select("field", "term").distinct(), "field"))
    return held.unionByName(every)


def matching(conditions: DataFrame, index: TermIndex) -> DataFrame:
    """(request, key) of the records that meet a request's conditions.

    ``conditions``: request, part, field, needle. Rows of one part are alternatives; all parts must hold. A request
    without conditions is not in the result, for it asks nothing of the lists.
    """
    asked = conditions.select("request", "part", "field", "needle").distinct()
    wanted = asked.join(terms_with(asked.select("field", "needle"), index), ["field", "needle"])
    # two needles of a part may hold in one term
    wanted = wanted.select("request", "part", "field", "term").distinct().withColumn("bucket", _bucket(F.col("term")))
    parts = asked.groupBy("request").agg(F.count_distinct("part").alias("parts"))
    met = (wanted.join(index.postings, ["field", "bucket", "term"]).select("request", index.key, "part").distinct()
           .groupBy("request", index.key).agg(F.count(F.lit(1)).alias("met")))
    return met.join(parts, "request").filter("met = parts").select("request", index.key)


def search_files(records: DataFrame, index: TermIndex, project: str | None = None, file_type: str | None = None,
                 role: str | None = None, keywords: list[str] | None = None, keywords_all: list[str] | None = None,
                 min_scores: dict[str, float] | None = None, entities: list[str] | None = None,
                 components: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """``facets.search_files`` with its list conditions answered by the index.

    The index has the fields keywords, entities, components and methods.
    """
    for column, value in (("project", project), ("file_type", file_type), ("file_role", role)):
        if value:
            records = records.filter(F.col(column) == value)
    for dimension, least in (min_scores or {}).items():
        records = records.filter(F.col(dimension) >= least)
    parts = [(f, ws) for f, ws in (("keywords", keywords), ("entities", entities), ("components", components),
                                   ("methods", methods)) if ws] + [("keywords", [w]) for w in keywords_all or []]
    if not parts:
        return records
    rows = [(0, i, f, w) for i, (f, ws) in enumerate(parts) for w in ws]
    asked = records.sparkSession.createDataFrame(rows, "request int, part int, field string, needle string")
    return records.join(matching(asked, index).select(index.key), index.key, "left_semi")
