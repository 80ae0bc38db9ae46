"""Temperature mixing of sources to target weights, as budgeted block permutations.

A source's weight is its token share to a power below one, normalised. The
power is bisected until the weights meet a target entropy or the repetition
limit. Each pass over a source is a permutation of its documents by a keyed
hash; the last pass stops at the source's token budget. Running sums are taken
in two levels (hash ranges, then rows of a range), so no source is one group.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuslens.llm.common import text_of, word_count
from corpuslens.sources.store import write_table

RANGE_BITS = 10   # hash ranges of a pass: 2 ** RANGE_BITS
PROBES = 32       # exponents tried at once; each round narrows the bracket by as much
ROUNDS = 7


class Mix(NamedTuple):
    weights: DataFrame     # source, tokens, weight, budget, passes, rest
    rows: DataFrame        # source, doc_id, _text, tokens


def count_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(text).alias("_text"), word_count(text).alias("tokens"))


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None,
             budget: float | None) -> float:
    """The smallest exponent in [0, 1] that meets the limits, to about 1e-10.

    ``shares``: share (positive, sum 1) and tokens per source. ``target_entropy`` is a fraction of the largest
    entropy; the exponent lowers until the mix is as even as that, but not beyond the repetition limit. With an
    exponent of 1 the weights are the token shares. Only PROBES rows of sums come to the driver in a round.
    """
    if target_entropy is None and max_repeats is None:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / PROBES
        probe = F.lit(low) + F.col("_i") * F.lit(step)
        power = F.pow("share", "_x")
        sums = (shares.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(PROBES)))).withColumn("_x", probe)
                .groupBy("_i").agg(F.max("_x").alias("x"), F.sum(power).alias("z"),
                                   F.sum(power * F.log("share")).alias("l"), F.count("*").alias("n"),
                                   F.max(power / F.col("tokens")).alias("most"),
                                   F.min(power / F.col("tokens")).alias("least"))
                .orderBy("_i").collect())
        best = high
        for s in sums:
            repeats = s.most / s.least if budget is None else s.most * budget / s.z
            # ln z - x * sum(p^x ln p) / z
            entropy = _ln(s.z) - s.x * s.l / s.z
            too_often = max_repeats is not None and repeats > max_repeats * (1 + 1e-12)
            too_even = target_entropy is not None and s.n > 1 and entropy > target_entropy * _ln(s.n)
            if not too_often and not too_even:
                best = s.x
                break
        low, high = max(0.0, best - step), best
    return high


def _ln(x: float) -> float:
    from math import log
    return log(x)


def weigh(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
          budget: int | None = None, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> Mix:
    """Weights and token budgets per source.

    Without ``budget`` the smallest one is taken in which every source is passed at least once, so that no document
    is lost. A null source is a source of its own. A source without tokens has weight 0 and is passed once.
    """
    spark = docs.sparkSession
    rows = write_table(count_tokens(docs, id_col, text_col, source_col), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    sums = write_table(sums, "mix-sources")
    share = sums.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    x = exponent(share, target_entropy, max_repeats, budget) if total else 1.0
    top = share.agg(F.sum(F.pow("share", F.lit(x))).alias("z"),
                    F.min(F.pow("share", F.lit(x)) / F.col("tokens")).alias("least")).first()
    z, least = top.z or 1.0, top.least or 1.0
    whole = float(budget) if budget is not None else z / least
    weight = F.when(F.col("tokens") > 0,
                    F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x)) / F.lit(z)).otherwise(F.lit(0.0))
    # half a token is added against rounding of whole passes
    spent = F.floor(F.col("weight") * F.lit(whole) + F.lit(0.5)).cast("long")
    weights = (sums.withColumn("exponent", F.lit(x)).withColumn("weight", weight).withColumn("budget", spent)
               .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")))
                           .otherwise(F.lit(1)).cast("int"))
               .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens"))
                           .otherwise(F.lit(0)).cast("long")))
    return Mix(write_table(weights, "mix-weights"), rows)


def _order(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col("doc_id").cast("string"), F.col("_text"))


def placements(mix: Mix, seed: int = 42) -> DataFrame:
    """One row per pass (``epoch`` from 1) and document of it, with the tokens of the pass before it (``before``)."""
    weights = mix.weights.select(F.col("source").alias("_source"), "passes", "rest", "weight",
                                 F.col("tokens").alias("_all"))
    copies = (mix.rows.join(weights, F.col("source").eqNullSafe(F.col("_source")))
              .filter("passes + if(rest > 0, 1, 0) > 0")
              .withColumn("epoch", F.explode(F.expr("sequence(1, passes + if(rest > 0, 1, 0))")))
              .withColumn("_key", _order(F.col("epoch"), seed))
              .withColumn("_range", F.shiftright("_key", 64 - RANGE_BITS).cast("int")).drop("_source"))
    pass_key = ["source", "epoch"]
    sums = copies.groupBy(*pass_key, "_range").agg(F.sum("tokens").alias("_sum"))
    below = sums.select(
        F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("_range").alias("_r"),
        (F.sum("_sum").over(W.partitionBy(*pass_key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
         ).alias("_below"))
    met = copies.join(below, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e"))
                      & (F.col("_range") == F.col("_r")))
    running = F.sum("tokens").over(W.partitionBy(*pass_key, "_range").orderBy("_key", "doc_id", "_text")
                                   .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (met.withColumn("before", F.coalesce("_below", F.lit(0)) + running - F.col("tokens"))
            .filter((F.col("epoch") <= F.col("passes")) | (F.col("before") + F.col("tokens") <= F.col("rest")))
            .select("source", "doc_id", "_text", "tokens", "epoch", "before", "weight", "passes", "_all", "_key"))


def schedule(mix: Mix, block_tokens: int = 200_000, seed: int = 42) -> DataFrame:
    """The training order: (block, position) per copy of a document.

    A block takes each source's weight times ``block_tokens`` from its passes; within a block the copies are
    permuted. Documents of sources without tokens cost nothing: they are dealt over all blocks by hash. Positions
    count from 0.
    """
    placed = placements(mix, seed)
    through = (F.col("epoch") - 1) * F.col("_all") + F.col("before")
    blocks = max(1, int((mix.weights.agg(F.sum("budget")).first()[0] or 0) // block_tokens))
    block = F.when(F.col("weight") > 0, F.floor(through / (F.col("weight") * F.lit(float(block_tokens))))
                   ).otherwise(F.pmod(F.xxhash64(F.lit("block"), "_key"), F.lit(blocks))).cast("long")
    out = placed.withColumn("block", block).withColumn("_at", F.xxhash64(F.lit(seed), F.col("block"), F.col("_key")))
    place = F.row_number().over(W.partitionBy("block").orderBy("_at", "source", "doc_id", "_text", "epoch")) - 1
    return out.withColumn("position", place.cast("long")).select(
        "doc_id", "source", "tokens", "epoch", "block", "position", "weight")


def mix_documents(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
                  budget: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns as they are.

    Texts stay where they are: the last, partial pass is a prefix of the permutation, so one cut per source tells
    every row how many copies of it there are.
    """
    mix = weigh(docs, target_entropy, max_repeats, budget, id_col, text_col, source_col)
    last = placements(mix, seed).filter("epoch > passes")
    cuts = last.groupBy("source").agg(F.max(F.struct("_key", "doc_id", "_text")).alias("_cut"))
    # written, so that its size is known before any text moves: one row per source
    plan = write_table(mix.weights.select(F.col("source").alias("_source"), "passes")
                       .join(cuts.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
                       .select("_source", "passes", "_cut"), "mix-plan")
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                      F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("doc_id"),
                      F.xxhash64(text_of(f"`{text_col}`")).alias("_text"))
    met = row.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    place = F.struct(_order(F.col("passes") + 1, seed).alias("_key"), F.col("doc_id"), F.col("_text"))
    copies = F.col("passes") + F.when(F.col("_cut").isNotNull() & (place <= F.col("_cut")), 1).otherwise(0)
    return (met.withColumn("_n", copies).filter("_n > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select(*[F.col("_row").getField(c).alias(c) for c in names]))
