"""Vector codes by a codebook for each part, nearest entries found with pivots (LAESA).

Vectors of integers are cut into equal parts; every part position has a
codebook. The distances of a part to a few fixed pivots are computed once and
written beside the vector. In a round the distances of the pivots to the
entries bound every part's distance to every entry from below, by the triangle
inequality: entries are tried in the order of these bounds, and only those that
the best distance so far does not rule out are evaluated, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslens.llm.bitsliced import finite
from corpuslens.sources.store import write_table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 8
CHUNK_ROWS = 4096
FIRST = 8       # entries of the lowest bounds, which every part tries at once


class Codebook(NamedTuple):
    entries: np.ndarray     # parts x entries x width, integers
    pivots: np.ndarray      # parts x pivots x width: fixed


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of two equally shaped sets of integer points."""
    apart = a - b
    return np.einsum("...w,...w->...", apart, apart)


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points far from each other: each next one has the largest distance to those before."""
    chosen = [0]
    near = squares(points, points[:1])
    while len(chosen) < min(n, len(points)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(points, points[chosen[-1]][None]))
    return points[chosen]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squares(points, p[None]) for p in pivots], axis=-1).astype(np.float64))


def nearest(x: np.ndarray, far: np.ndarray, entries: np.ndarray, entry_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of every part's nearest entry, the lower index of equally near ones.

    ``far`` and ``entry_far`` are distances to the pivots. A bound that rounding may have raised is lowered by more
    than that, so an entry is left out only when it is truly farther.
    """
    n, k = len(x), len(entries)
    low = np.zeros((k, n))
    for p in range(far.shape[1]):
        np.maximum(low, np.abs(entry_far[:, p, None] - far[None, :, p]), out=low)
    slack = 1e-14 * (far.max(initial=0.0) + entry_far.max(initial=0.0))
    bound = np.square(np.maximum(low - slack, 0.0)) * (1 - 1e-12)
    # each part's own first entries
    rows, width = np.arange(n), min(FIRST, k)
    which = np.argpartition(bound, width - 1, axis=0)[:width]
    distance = squares(entries[which], x[None])
    best = distance.min(axis=0, initial=np.iinfo(np.int64).max)
    index = np.where(distance == best, which, k).min(axis=0, initial=k)
    bound[which, rows[None]] = np.inf
    # then entry by entry, the promising ones first, for the parts that may be nearer to it
    for e in np.argsort(bound.min(axis=1, initial=np.inf)).tolist():
        rows = np.flatnonzero(bound[e] <= best)
        if len(rows):
            apart = squares(x[rows], entries[e][None])
            nearer = (apart < best[rows]) | ((apart == best[rows]) & (e < index[rows]))
            best[rows[nearer]], index[rows[nearer]] = apart[nearer], e
    return index, best


def assign(vectors: np.ndarray, far: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) per vector and part; ``far``: vectors x parts x pivots."""
    parts, _, width = book.entries.shape
    index, distance = (np.zeros((len(vectors), parts), dtype=np.int64) for _ in range(2))
    for part in range(parts):
        entry_far = pivot_distances(book.entries[part], book.pivots[part])
        for s in range(0, len(vectors), CHUNK_ROWS):
            x = vectors[s:s + CHUNK_ROWS, part * width:(part + 1) * width]
            index[s:s + CHUNK_ROWS, part], distance[s:s + CHUNK_ROWS, part] = nearest(
                x, far[s:s + CHUNK_ROWS, part], book.entries[part], entry_far)
    return index, distance


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([*column, np.zeros(0)]).astype(np.int64).reshape(len(column), width)


def _far(column: pd.Series, book: Codebook) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), *book.pivots.shape[:2])


def whole_numbers(vector: Column, scale: int, width: int, limit: int) -> Column:
    """floor(scale * x) of every component, held within ``limit``, and zeros up to ``width`` components."""
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))).cast("long"), F.lit(limit)),
                                                     F.lit(-limit)).cast("int"))
    return F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size(vector)))


def part_sums(table: DataFrame, book: Codebook) -> DataFrame:
    """(part, entry, n, sums): the parts nearest to every entry, added up; each task folds its own first."""
    parts, entries, width = book.entries.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            vectors = _matrix(b["x"], parts * width)
            index, _ = assign(vectors, _far(b["far"], book), book)
            for part in range(parts):
                np.add.at(sums[part], index[:, part], vectors[:, part * width:(part + 1) * width])
                n[part] += np.bincount(index[:, part], minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            yield pd.DataFrame({"part": part, "entry": entry, "n": n[part, entry], "sums": list(sums[part, entry])})

    folded = table.select("x", "far").mapInPandas(add, "part long, entry long, n long, sums array<long>")
    return folded.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def improved(book: Codebook, sums: DataFrame) -> Codebook:
    """Every used entry becomes the mean of its parts, rounded down; at most parts x entries rows are collected."""
    entries = book.entries.copy()
    for r in sums.collect():
        entries[r.part, r.entry] = [s // r.n for s in r.sums]
    return book._replace(entries=entries)


def digest(book: Codebook) -> str:
    return sha256(",".join(map(str, book.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             pivots: int = PIVOTS) -> tuple[DataFrame, Codebook | None]:
    """((id, code, error, label_error), the codebook) of every vector without null or non-finite components.

    Components become floor(scale * x). A codebook starts as its part of the vectors with the smallest ids (null ids
    come last, rows that repeat an id by their components), ``entries`` of them or all; every round assigns all parts
    to their nearest entries (squared distance, ties to the lower index) and moves the used entries to the mean of
    their parts, rounded down. ``code`` has two hex digits a part, ``error`` is the squared distance summed over
    parts, ``label_error`` that summed over the rows of a label, null labels together, at most 2^63 - 1. Vectors
    shorter than the longest, empty ones too, count as filled up with zeros, to a multiple of ``parts`` components.
    Components are held within isqrt(2^63 / components) / 2 (for 64 of them 2^27) so that every sum is exact. An
    empty table gives no rows and no codebook.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    v = F.col(vector_col).cast("array<double>")
    kind = vectors.schema[id_col].dataType
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
            .filter(F.col("v").isNotNull()).filter(finite(F.col("v")) | (F.size("v") == 0)))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        empty = T.StructType([T.StructField(id_col, kind), T.StructField("code", T.StringType()),
                              T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType())])
        return vectors.sparkSession.createDataFrame([], empty), None
    width = max(1, -(-longest // parts))
    limit = math.isqrt(((1 << 63) - 1) // (width * parts)) // 2
    rows = rows.select("id", "label", whole_numbers(F.col("v"), scale, width * parts, limit).alias("x"))
    first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    start = np.array([r.x for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    book = Codebook(start, np.stack([choose_pivots(p, pivots) for p in start]))

    @F.pandas_udf("binary")
    def measure(x: pd.Series) -> pd.Series:
        points = _matrix(x, parts * width).reshape(len(x), parts, width)
        far = np.stack([pivot_distances(points[:, p], book.pivots[p]) for p in range(parts)], axis=1)
        return pd.Series([row.tobytes() for row in far], dtype=object)

    table = write_table(rows.withColumn("far", measure("x")), "laesa-vectors")
    for _ in range(rounds):
        book = improved(book, part_sums(table, book))

    @F.pandas_udf("code string, error long")
    def encode(x: pd.Series, far: pd.Series) -> pd.DataFrame:
        index, distance = assign(_matrix(x, parts * width), _far(far, book), book)
        return pd.DataFrame({"code": [c.tobytes().hex() for c in index.astype(np.uint8)], "error": distance.sum(axis=1)})

    coded = write_table(table.select("id", "label", encode("x", "far").alias("c")).select("id", "label", "c.*"),
                        "laesa-codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), book
