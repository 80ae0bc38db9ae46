"""Exact inner-product top-k over a bit-sliced index.

Vectors become integers per component. A block of rows is stored as bitmaps,
one per component and bit. A query adds the slices its own bits select, at
their weights, with carry-save adders on whole bitmaps; the sum is again a
stack of bitmaps. The best rows are found from its most significant slice
downward, and rows tied at the boundary are settled by id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuslens.sources.store import write_table

BLOCK_ROWS = 1 << 16
QUERY_ROWS = 128
SCALE = 256


def finite(vector: Column) -> Column:
    """Whether a vector is present, not empty, and has only finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, codes, dim): floor(scale * x) of every component; ids are unique, a repeated one has its greatest codes."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    codes = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return (rows.filter(F.col("id").isNotNull() & finite(F.col("v"))).select("id", codes.alias("codes"))
            .groupBy("id").agg(F.max("codes").alias("codes")).withColumn("dim", F.size("codes")))


def slice_block(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps (slices, words) of a block, its least codes, and its bits per component.

    Codes are stored from the component's least code up, so that slices are unsigned.
    """
    low = codes.min(axis=0)
    lifted = codes.astype(np.uint64) - low.astype(np.uint64)[None, :]
    bits = np.array([int(x).bit_length() for x in lifted.max(axis=0)], dtype=np.int64)
    words = (len(codes) + 63) // 64
    out = np.zeros((int(bits.sum()), words * 8), dtype=np.uint8)
    at = 0
    for d, n in enumerate(bits):
        for b in range(n):
            packed = np.packbits(((lifted[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[at, :len(packed)] = packed
            at += 1
    return out.view(np.uint64), low, bits


def add_slices(slices: np.ndarray, low: np.ndarray, bits: np.ndarray, query: np.ndarray) -> tuple[list, int]:
    """The query's scores of a block as bitmaps by weight, and the constant to add.

    A negative factor takes the complement of the slices: -f * x = f * (2^bits - 1 - x) - f * (2^bits - 1).
    """
    start = np.concatenate([[0], np.cumsum(bits)])
    pending: dict[int, list[int]] = {}
    flip = np.zeros(len(slices), dtype=bool)
    constant = 0
    for d, q in enumerate(query.tolist()):
        constant += q * int(low[d])
        if q < 0:
            flip[start[d]:start[d + 1]] = True
            constant += q * ((1 << int(bits[d])) - 1)
        factor, j = abs(q), 0
        while factor:
            if factor & 1:
                for b in range(int(bits[d])):
                    pending.setdefault(b + j, []).append(int(start[d]) + b)
            factor >>= 1
            j += 1
    source = np.where(flip[:, None], ~slices, slices)
    planes: list[np.ndarray | None] = []
    carried: list[np.ndarray] = []
    weight = 0
    while weight in pending or carried or any(w > weight for w in pending):
        stack = ([source[pending[weight]]] if weight in pending else []) + carried
        carried = []
        if not stack:
            planes.append(None)
            weight += 1
            continue
        rows = np.concatenate(stack) if len(stack) > 1 else stack[0]
        while len(rows) > 2:                 # carry-save: three bitmaps become a sum and a carry
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n:2 * n], rows[2 * n:3 * n]
            half = a ^ b
            carried.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * n:]])
        if len(rows) == 2:
            carried.append((rows[0] & rows[1])[None, :])
            rows = (rows[0] ^ rows[1])[None, :]
        planes.append(rows[0])
        weight += 1
    return planes, constant


def best_rows(planes: list, words: int, allowed: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` highest sums; of rows tied at the boundary, those that come first."""
    sure, maybe = np.zeros(words, dtype=np.uint64), allowed.copy()
    for plane in reversed(planes):
        if plane is None:
            continue
        high = maybe & plane
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            maybe = high
        else:
            sure = sure | high
            maybe = maybe & ~plane
            if n == k:
                maybe = np.zeros_like(maybe)
                break
    found = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    tied = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))
    return np.concatenate([found, tied[:max(0, k - len(found))]])


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index as a written table: a row per block of vectors of one length, with about ``block_rows`` vectors."""
    n = rows.count()
    blocks = max(1, math.ceil(n / block_rows))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        slices, low, bits = slice_block(np.stack(pdf["codes"].to_numpy()))
        return pd.DataFrame([{"dim": key[0], "block": key[1], "n": len(pdf),
                              "ids": pdf["id"].to_numpy(np.int64).tobytes(), "slices": slices.tobytes(),
                              "low": low.tobytes(), "bits": bits.tobytes()}])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return write_table(dealt.groupBy("dim", "block").applyInPandas(
        build, "dim int, block int, n int, ids binary, slices binary, low binary, bits binary"), "bit-index")


def top_k(index: DataFrame, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every query (id, codes, dim), without its own id.

    Blocks of queries meet blocks of the index; a pair of blocks returns at most ``k`` rows a query. Scores are
    exact; one beyond 64 bits is shown as the nearest long.
    """
    parts = max(1, math.ceil(queries.count() / query_rows))
    # index rows are few and large: each goes out once per part of the queries
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = index.select(F.col("dim").alias("q_dim"), F.col("block").alias("q_block")).distinct()
    right = (queries.withColumn("q_part", F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(parts)).cast("int"))
             .join(blocks, F.col("dim") == F.col("q_dim")).select("id", "codes", "q_dim", "q_block", "q_part"))

    def search(blocks_of: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, b in blocks_of.iterrows():
            ids = np.frombuffer(b["ids"], dtype=np.int64)
            bits = np.frombuffer(b["bits"], dtype=np.int64)
            low = np.frombuffer(b["low"], dtype=np.int64)
            words = (len(ids) + 63) // 64
            slices = np.frombuffer(b["slices"], dtype=np.uint64).reshape(int(bits.sum()), words)
            exists = np.zeros(words * 8, dtype=np.uint8)
            packed = np.packbits(np.ones(len(ids), dtype=np.uint8), bitorder="little")
            exists[:len(packed)] = packed
            for qid, codes in zip(asked["id"], asked["codes"]):
                planes, constant = add_slices(slices, low, bits, np.asarray(codes, dtype=np.int64))
                allowed = exists.view(np.uint64).copy()
                own = int(np.searchsorted(ids, qid))
                if own < len(ids) and ids[own] == qid:
                    allowed[own // 64] &= ~np.uint64(1 << (own % 64))
                for row in best_rows(planes, words, allowed, k).tolist():
                    word, bit = row // 64, row % 64
                    score = constant + sum(((int(p[word]) >> bit) & 1) << w for w, p in enumerate(planes)
                                           if p is not None)
                    out.append((qid, int(ids[row]), min(max(score, -(1 << 63)), (1 << 63) - 1)))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("dim", "block", "part").cogroup(right.groupBy("q_dim", "q_block", "q_part")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` best other rows of every row that ``is_query`` selects (a condition on ``id``).

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; only vectors
    of equal length meet. Ties go to the smaller id; with fewer than ``k`` candidates all are returned. A repeated
    id counts once, with its greatest vector. Other columns are ignored.
    """
    rows = write_table(quantise(vectors, id_col, vector_col), "codes")
    return top_k(build_index(rows, block_rows), rows.filter(is_query), k, query_rows)
