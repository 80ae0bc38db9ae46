"""Balanced shards by histogram sort.

Documents are ordered by a hash of their text, then by row. Cuts between
shards are found on exact sums: every round counts bytes and rows below a set
of candidate keys, over all partitions, and narrows each cut's interval, until
the cut is within tolerance of its target. Rows are then exchanged once.
Equal texts share a hash, so a group of copies lies in one shard unless it is
too heavy for the tolerance; only then does a cut go through it, by row.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from corpuslens.llm.common import partitions, text_of
from corpuslens.sources.store import write_table

PROBES = 64         # candidate keys per open cut and round
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Cut(NamedTuple):
    """Rows with (key, row) < (key, row) of the cut lie below it."""
    key: int
    row: int


def shard_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, _key, _row) of every document; size is its UTF-8 bytes plus 8.

    ``_row`` numbers the rows, so that rows of equal texts can be told apart. It is written with them.
    """
    text = text_of(text_col)
    return write_table(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_key"),
        F.monotonically_increasing_id().alias("_row")), "shard-keys")


def _between(low: int, high: int, n: int) -> list[int]:
    """Up to ``n`` keys spread over the open interval (low, high)."""
    span = high - low
    n = min(n, span - 1)
    return sorted({low + span * i // (n + 1) for i in range(1, n + 1)})


def bins_of(keys: np.ndarray, ids: np.ndarray, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of cuts (sorted by key, then row) at or below each row."""
    if not len(keys):
        return np.zeros(len(key), dtype=np.int64)
    at = np.searchsorted(keys, key, side="left")
    tied = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key))
    for k in np.unique(key[tied]):      # a cut at the row's own key lies below the row if its row number does
        own = tied[key[tied] == k]
        start, end = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
        at[own] = start + np.searchsorted(ids[start:end], row[own], side="right")
    return at


def sums_below(rows: DataFrame, probes: list[Cut]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe (sorted). Partitions send one pair of sums per interval of probes."""
    keys = np.array([p.key for p in probes], dtype=np.int64)
    ids = np.array([p.row for p in probes], dtype=np.int64)

    def bins(batches):
        size, count = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        for b in batches:
            k, r = b["_key"].to_numpy(), b["_row"].to_numpy()
            at = bins_of(keys, ids, k, r)
            np.add.at(size, at, b["size"].to_numpy())
            np.add.at(count, at, 1)
        got = np.flatnonzero(count)
        yield pd.DataFrame({"bin": got, "bytes": size[got], "n": count[got]})

    found = (rows.select("_key", "_row", "size").mapInPandas(bins, "bin long, bytes long, n long")
             .groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect())
    size, count = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    for f in found:
        size[f.bin], count[f.bin] = f.bytes, f.n
    # a row in bin i lies below the probes i, i + 1, ...
    return np.cumsum(size)[:-1], np.cumsum(count)[:-1]


def find_cuts(rows: DataFrame, targets: list[tuple[str, float]], slack: dict[str, float]) -> list[Cut]:
    """A cut per target ("bytes" or "rows", sum below it), within ``slack`` of it or as near as rows allow.

    A cut's interval narrows over the hash first. When it has come down to one hash value whose rows weigh more
    than the slack allows, it narrows on over the row numbers of that value.
    """
    last_row = rows.agg(F.max("_row")).first()[0]
    cuts: list[Cut | None] = [None] * len(targets)
    # open intervals: below ``low`` lies at most the target, below ``high`` more
    low = [Cut(LOW, -1)] * len(targets)
    high = [Cut(HIGH, HIGH)] * len(targets)
    low_sum, high_sum = [0.0] * len(targets), [float("inf")] * len(targets)
    while any(c is None for c in cuts):
        probes: set[Cut] = set()
        for lo, hi in {(low[i], high[i]) for i, c in enumerate(cuts) if c is None}:
            if hi.key - lo.key > 1:
                probes.update(Cut(k, -1) for k in _between(lo.key, hi.key, PROBES))
            elif hi.key != lo.key:      # rows of hash lo.key from lo.row on
                probes.update(Cut(lo.key, r) for r in _between(lo.row, last_row + 1, PROBES))
            else:
                probes.update(Cut(lo.key, r) for r in _between(lo.row, hi.row, PROBES))
        order = sorted(probes)
        below = dict(zip(("bytes", "rows"), sums_below(rows, order) if order else ([], [])))
        for i, (what, target) in enumerate(targets):
            if cuts[i] is not None:
                continue
            sums = np.asarray(below[what], dtype=float)
            moved = False
            inside = [j for j, p in enumerate(order) if low[i] < p < high[i]]
            for j in inside:
                moved = True
                if sums[j] <= target:
                    low[i], low_sum[i] = order[j], sums[j]
                else:
                    high[i], high_sum[i] = order[j], sums[j]
                    break
            best, off = (low[i], target - low_sum[i])
            if high_sum[i] - target < off:
                best, off = high[i], high_sum[i] - target
            whole = low[i].row == -1 and high[i].row in (-1, HIGH) and high[i].key - low[i].key <= 1
            narrow = whole and high[i].key - low[i].key == 1 and low_sum[i] == high_sum[i]
            if off <= slack[what] or narrow or not moved:
                cuts[i] = best
    return cuts


def shard(docs: DataFrame, shards: int, tolerance: float = 0.01, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Shards near equal in bytes: doc_id, size, text_crc32, shard, slot.

    Shards are numbered from 0, slots of a shard from 0 without gaps. A cut may be off by ``tolerance`` of a shard's
    bytes to keep equal texts together, or by a document where one weighs more. Null and empty texts weigh 8 bytes;
    null or repeated ids are rows like others. With fewer documents than shards some shards stay empty; an empty
    table gives no rows. Every shard is dealt as many bins of about equal row counts, whose rows are numbered apart,
    so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    rows = shard_keys(docs, id_col, text_col)
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bins = max(4 * partitions(spark), 4 * shards)
    targets = [("bytes", total.bytes * i / shards) for i in range(1, shards)]
    targets += [("rows", total.n * i / bins) for i in range(1, bins)]
    slack = {"bytes": tolerance * total.bytes / shards, "rows": 0.25 * total.n / bins}
    cuts = find_cuts(rows, targets, slack)
    ends = sorted(cuts[:shards - 1])
    edges = sorted(set(cuts))
    counts = np.diff(np.concatenate([[0], sums_below(rows, edges)[1], [total.n]]))
    keys = np.array([c.key for c in edges], dtype=np.int64)
    ids = np.array([c.row for c in edges], dtype=np.int64)
    owner = [sum(e <= low for e in ends) for low in [Cut(LOW, -1), *edges]]
    first, seen = [], {}
    for o, n in zip(owner, counts):
        first.append(seen.get(o, 0))
        seen[o] = seen.get(o, 0) + int(n)

    @F.pandas_udf("_bin long, shard int, _first long")
    def place(key: pd.Series, row: pd.Series) -> pd.DataFrame:
        at = bins_of(keys, ids, key.to_numpy(), row.to_numpy())
        return pd.DataFrame({"_bin": at, "shard": np.asarray(owner, dtype=np.int32)[at],
                             "_first": np.asarray(first)[at]})

    placed = rows.select("doc_id", "size", "text_crc32", "_key", "_row", place("_key", "_row").alias("_p")).select(
        "doc_id", "size", "text_crc32", "_key", "_row", "_p.*")
    slot = F.col("_first") + F.row_number().over(W.partitionBy("_bin").orderBy("_key", "_row")) - 1
    return placed.withColumn("slot", slot.cast("long")).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id",
                 files_per_shard: int = 16) -> None:
    """The documents in one folder per shard, in slot order; ids must be unique."""
    found = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    (docs.join(found, docs[id_col].eqNullSafe(F.col("_id"))).drop("_id")
     .repartitionByRange(files_per_shard * (1 + (placed.agg(F.max("shard")).first()[0] or 0)), "shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
