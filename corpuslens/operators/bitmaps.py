"""Facet postings as bitmaps over dense record numbers.

Records are numbered in key order without gaps. A term's postings are bitmaps of 32 768 records each (Spark's bitmap
functions), so OR inside a facet, AND across facets and counts are bitwise work by block; keys are looked up at the
end, for the records found. A popular term is many blocks, never one long list, and a block of a rare term is mostly
zeros, which parquet packs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.sources.store import pin, write_table

BITS = 8 * 4096     # records in one of Spark's bitmaps


def record_numbers(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, number) with numbers from 0 without gaps, in key order; nulls are left out, repeats count once.

    Rows are numbered inside sorted ranges, and ranges are moved on by the sizes of those before them: only one row
    per range meets in one task.
    """
    ranged = (records.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(key)
              .sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    local = pin(ranged.select(key, F.shiftright("_at", 33).alias("_range"),
                              F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "places")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = (local.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
             .select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    return local.join(moved, "_range").select(key, (F.col("_before") + F.col("_place")).alias("number"))


def facet_bitmaps(postings: DataFrame, numbers: DataFrame, key: str = "id") -> DataFrame:
    """(facet, term, block, bits): one bitmap per term and block of records; repeated postings set one bit."""
    at = F.col("number") + 1        # Spark's buckets and places count from one
    return (postings.join(numbers, key)
            .groupBy("facet", "term", F.bitmap_bucket_number(at).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")))


def write_bitmaps(postings: DataFrame, records: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(bitmaps by facet, numbers) as written tables: a facet's search prunes to its folder."""
    numbers = write_table(record_numbers(records, key), "numbers")
    return write_table(facet_bitmaps(postings, numbers, key), "bitmaps", ["facet"]), numbers


def counts(bitmaps: DataFrame) -> DataFrame:
    """Records per facet and term, from bit counts."""
    return bitmaps.groupBy("facet", "term").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def matching(bitmaps: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(block, bits) of the records that have, for every facet, one of its terms. At least one facet is wanted."""
    tests = [(F.col("facet") == f) & F.col("term").isin(ts) for f, ts in wanted.items()]
    each = (bitmaps.filter(reduce(lambda a, b: a | b, tests)).groupBy("block", "facet")
            .agg(F.bitmap_or_agg("bits").alias("bits")))
    return (each.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
            .filter((F.col("_n") == len(wanted)) & (F.bitmap_count("bits") > 0)).drop("_n"))


def how_many(found: DataFrame) -> DataFrame:
    """One row: n, the records in the bitmaps."""
    return found.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def keys_of(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """Keys of the records in the bitmaps. Only bytes that hold a record are unfolded."""
    octets = F.transform(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)),
                         lambda i: F.struct(i.alias("i"), F.hex(F.substring("bits", i + 1, F.lit(1))).alias("h")))
    held = found.select("block", F.explode(F.filter(octets, lambda o: o["h"] != "00")).alias("o"))
    value = F.conv("o.h", 16, 10).cast("int")
    held = held.withColumn("value", value).select("block", "o.i", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(7)),
        lambda j: F.floor(F.col("value") / F.pow(F.lit(2), j)) % 2 == 1)).alias("j"))
    number = (F.col("block") - 1) * BITS + F.col("i") * 8 + F.col("j")
    return held.select(number.alias("number")).join(numbers, "number").drop("number")


def search(bitmaps: DataFrame, numbers: DataFrame, records: DataFrame, key: str = "id", project: str | None = None,
           excellent: list[str] | None = None, tags: list[str] | None = None, grade: str | None = None,
           min_total: float | None = None) -> DataFrame:
    """Records in every requested facet, as ``facets.search_facets`` finds them; without any facet all records."""
    wanted = {"project": [project] if project else None, "excellence": excellent, "tag": tags,
              "grade": [grade] if grade else None}
    wanted = {f: ts for f, ts in wanted.items() if ts}
    if min_total is not None:
        records = records.filter(F.coalesce("total_score", F.lit(0)) >= min_total)
    if not wanted:
        return records
    return records.join(keys_of(matching(bitmaps, wanted), numbers), key, "left_semi")
