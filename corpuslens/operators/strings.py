"""Exact substring joins without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct pieces of one to GRAM characters, in time linear in the text."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")

    def of_length(c: Column, n: int) -> Column:
        starts = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(c, i + j) for j in range(n)]))

    # the characters are bound once, not split again for every piece
    return F.get(F.transform(F.array(characters), lambda c: F.array_distinct(
        F.concat(*[of_length(c, n) for n in range(1, GRAM + 1)]))), F.lit(0))


def substring_matches(needles: DataFrame, hays: DataFrame, needle: str, hay: str, keys: list[str]) -> DataFrame:
    """Distinct (needle, keys) of the texts that hold the needle.

    A text that holds a needle holds the needle's pieces of three characters (all of it, if it is shorter). Needles
    meet texts on the piece that fewest texts have; what they meet is then looked up in the text itself. Texts do
    not travel with the pieces, only their keys do. Empty needles match nothing.
    """
    n = needles.select(F.col(needle).alias("_needle")).distinct().filter(F.length("_needle") > 0)
    pieces = hays.select(*keys, F.explode(_grams(F.col(hay))).alias("_gram"))
    counts = pieces.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.length("_needle"), F.lit(GRAM))
    own = n.select("_needle", F.explode(F.filter(_grams(F.col("_needle")), lambda g: F.length(g) == size)).alias("_gram"))
    rarest = own.join(counts, "_gram").groupBy("_needle").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    met = (rarest.join(pieces, "_gram").groupBy(*keys).agg(F.collect_set("_needle").alias("_needles"))
           .select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_needles"))
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    held = hays.join(met, same).select(*keys, F.explode(F.filter(
        "_needles", lambda x: F.contains(F.col(hay), x))).alias("_needle"))
    return held.select(F.col("_needle").alias(needle), *keys).distinct()


def substring_pairs(needles: DataFrame, hays: DataFrame, needle: str, hay: str) -> DataFrame:
    """Distinct (needle, hay) with the needle inside the hay, for short hays such as names, which are their own key."""
    short = hays.select(F.col(hay).alias("_hay")).distinct()
    return substring_matches(needles, short, needle, "_hay", ["_hay"]).select(needle, F.col("_hay").alias(hay))
