"""Vector similarity and hybrid retrieval.

Top-k runs as blocks: requests are dealt into blocks of bounded size and the
corpus into splits of bounded size; every block meets every split, which scores
with one matrix product and keeps the best k per request, and a window merges
these short lists. No request/record pair is ever a row, and no split returns
more than k rows per request, however large or skewed the corpus is. The plan
is the same for any number of requests, and none of them passes the driver.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 4096  # requests in a block
SPLIT_ROWS = 1 << 16  # records in a split
MATRIX_CELLS = 2_000_000  # request × record scores held at once in a task
VECTOR_CELLS = 1 << 22  # numbers in a block or split where vectors alone count
TILE = 1024, 4096, 512  # requests and records scored at once, and records for a first bound
TASKS = 6  # pairs of blocks and splits per core, at least
PAIR_ROWS = 1 << 16  # pairs scored in double precision at once


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; empty, zero or unequal vectors give 0."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def squares(v: Column) -> Column:
        return total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(squares(a)) * F.sqrt(squares(b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, dot / norm).otherwise(F.lit(0.0))


def overlap(wanted: Column, present: Column) -> Column:
    """Share of the wanted keywords found as substrings of present ones."""
    hit = F.size(F.filter(wanted, lambda k: F.exists(present, lambda p: F.contains(F.lower(p), F.lower(k)))))
    return hit / F.greatest(F.size(wanted), F.lit(1))


def dimension_report(df: DataFrame, vector: str = "embedding", expected: int | None = None) -> DataFrame:
    """Records per vector length; ``mismatch`` marks lengths other than expected."""
    counts = df.groupBy(F.size(vector).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
    return counts if expected is None else counts.withColumn("mismatch", F.col("dimension") != expected)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows × dim unit vectors, usable mask) of a list column, without Python loops."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    usable = sizes == dim
    out = np.zeros((len(sizes), dim))
    picked = column.filter(pa.array(usable))
    if dim and len(picked):
        flat = picked.flatten().to_numpy(zero_copy_only=False).astype("float64")
        out[usable] = flat.reshape(-1, dim)
    norms = np.linalg.norm(out, axis=1)
    np.divide(out, norms[:, None], out=out, where=norms[:, None] > 0)
    return out, usable


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id; dropped rows are -inf."""
    kept = np.flatnonzero(np.isfinite(scores))
    if len(kept) > k:
        cut = np.partition(scores[kept], len(kept) - k)[len(kept) - k]
        kept = kept[scores[kept] >= cut]
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def _nearest(asked: np.ndarray, records: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(requests, records, scores) by position: the best k records per request, ties by position.

    Products in single precision leave out what cannot be among the best, by a bound on their error; the others are
    scored in double precision, rounded to nine places.
    """
    slack = 2e-9 + 4 * (asked.shape[1] + 8) * 2.0 ** -24
    asked_32, records_32 = asked.astype("float32"), records.astype("float32")
    n, found = len(records), []
    for a in range(0, len(asked), TILE[0]):
        q, q_32 = asked[a:a + TILE[0]], asked_32[a:a + TILE[0]]
        bound = np.full(len(q), -np.inf, dtype="float32")
        if n > k:
            first = q_32 @ records_32[:max(TILE[2], k)].T
            bound = np.partition(first, first.shape[1] - k, axis=1)[:, first.shape[1] - k] - np.float32(2 * slack)
        rows, places, scores = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
        for b in range(0, n, TILE[1]):
            near = q_32 @ records_32[b:b + TILE[1]].T
            row, place = np.divmod(np.flatnonzero(near >= bound[:, None]), near.shape[1])
            place += b
            exact = [np.einsum("ij,ij->i", q[row[i:i + PAIR_ROWS]], records[place[i:i + PAIR_ROWS]])
                     for i in range(0, len(row), PAIR_ROWS)]
            rows, places = np.concatenate([rows, row]), np.concatenate([places, place])
            scores = np.concatenate([scores, *[np.floor(x * 1e9 + 0.5) / 1e9 for x in exact]])
            order = np.lexsort((places, -scores, rows))
            counts = np.bincount(rows, minlength=len(q))
            starts = np.cumsum(counts) - counts
            order = order[np.arange(len(order)) - starts[rows[order]] < k]
            rows, places, scores = rows[order], places[order], scores[order]
            counts = np.minimum(counts, k)
            full = np.flatnonzero(counts == k)
            kth = scores[np.cumsum(counts)[full] - 1] - slack
            bound[full] = np.maximum(bound[full], kth.astype("float32"))
        found.append((rows + a, places, scores))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=int),) * 2 + (np.zeros(0),)


def _alike(units: np.ndarray) -> np.ndarray:
    """Per row the number of its vector among the distinct ones, in the order of their first rows."""
    raw = np.ascontiguousarray(units).view(np.dtype((np.void, units.shape[1] * units.itemsize))).ravel()
    first, number = np.unique(raw, return_index=True, return_inverse=True)[1:]
    return np.argsort(np.argsort(first))[number]


def _nearest_of_split(asked: pa.Table, records: pa.Table, request_key: str, key: str, vector: str, k: int):
    """(request keys, record keys, scores) of the best k records per request by cosine alone."""
    sizes = asked["vector"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    nothing = pa.nulls(0, asked.schema.field(request_key).type), pa.nulls(0, records.schema.field(key).type), np.zeros(0)
    if not dim:
        return nothing
    units, usable = _matrix(asked["vector"], dim)
    mine = np.flatnonzero(usable & np.isfinite(units).all(axis=1))
    units = units[mine]
    others, _ = _matrix(records[vector], dim)   # one of another length scores 0
    present = records[vector].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    theirs = np.flatnonzero(present & np.isfinite(others).all(axis=1))
    if not len(mine) or not len(theirs):
        return nothing
    # in the order of their ids; of equal vectors only the first k can be in an answer
    ids = np.asarray(records[key].to_pylist())
    theirs = theirs[np.argsort(ids[theirs], kind="stable")]
    alike = _alike(others[theirs])
    order = np.argsort(alike, kind="stable")
    counts = np.bincount(alike)
    nth = np.empty(len(order), dtype=int)
    nth[order] = np.arange(len(order)) - (np.cumsum(counts) - counts)[alike[order]]
    theirs = theirs[nth < k]
    # equal requests are answered once
    form = _alike(units)
    which = np.unique(form, return_index=True)[1]
    rows, places, scores = _nearest(units[which], others[theirs], k)
    counts = np.bincount(rows, minlength=len(which))
    starts = np.cumsum(counts) - counts
    repeat = counts[form]
    take = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(starts[form], repeat)
    return (asked[request_key].combine_chunks().take(pa.array(np.repeat(mine, repeat))),
            records[key].combine_chunks().take(pa.array(theirs[places[take]])), scores[take])


class _Block:
    """Bounded set of requests as arrays."""

    def __init__(self, rows: pa.Table, key: str, filters: list[str]):
        col = lambda n, default=None: rows[n].to_pylist() if n in rows.column_names else [default] * rows.num_rows
        self.keys, self.key_type = col(key), rows.schema.field(key).type
        vectors = col("vector")
        self.dim = max((len(v) for v in vectors if v), default=0)
        self.has_vector = np.array([bool(v) and len(v) == self.dim for v in vectors], dtype=bool)
        q = np.array([v if h else np.zeros(self.dim) for v, h in zip(vectors, self.has_vector)], dtype="float64")
        q = q.reshape(len(vectors), self.dim)
        norms = np.linalg.norm(q, axis=1, keepdims=True)
        self.matrix = np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)
        self.keywords = [[w.lower() for w in ws or []] for ws in col("keywords", [])]
        self.words = sorted({w for ws in self.keywords for w in ws})
        place = {w: i for i, w in enumerate(self.words)}
        self.wanted = np.zeros((len(self.keys), len(self.words)))
        for i, ws in enumerate(self.keywords):
            for w in set(ws):
                self.wanted[i, place[w]] = 1.0
        self.n_words = np.maximum([len(set(ws)) for ws in self.keywords], 1)
        self.filters = {f: col(f) for f in filters}
        self.entities = [[e.lower() for e in es or []] for es in col("entities", [])]


def _contains_matrix(lists: list, words: list[str]) -> np.ndarray:
    """rows × words: does some element of the row contain the word."""
    cache: dict[str, np.ndarray] = {}
    out = np.zeros((len(lists), len(words)), dtype=bool)
    for i, items in enumerate(lists):
        for item in items if items is not None else ():
            hit = cache.get(item)
            if hit is None:
                low = item.lower()
                hit = cache[item] = np.array([w in low for w in words], dtype=bool)
            out[i] |= hit
    return out


def _score_batch(block: _Block, batch: pa.Table, weights, vector: str, keyword_only_weight: float):
    """(scores requests × rows with dropped rows -inf, candidate mask, vector mask)."""
    n = batch.num_rows
    ok = np.ones((len(block.keys), n), dtype=bool)
    for name, wanted in block.filters.items():
        codes, values = pd.factorize(np.array(batch[name].to_pylist(), dtype=object))
        place = {v: i for i, v in enumerate(values)}
        asked = np.array([-2 if v is None else place.get(v, -3) for v in wanted])   # -2: any
        ok &= (asked[:, None] == -2) | (asked[:, None] == codes[None, :])
    if any(block.entities):
        words = sorted({e for es in block.entities for e in es})
        place = {w: i for i, w in enumerate(words)}
        holds = _contains_matrix(batch["entities"].to_pylist(), words)
        for r, es in enumerate(block.entities):
            if es:
                ok[r] &= holds[:, [place[e] for e in es]].any(axis=1)
    units, usable = _matrix(batch[vector], block.dim)
    present = batch[vector].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    shared = np.zeros((len(block.keys), n))
    if block.words:
        hits = _contains_matrix(batch["keywords"].to_pylist(), block.words).astype("float64")
        shared = (block.wanted @ hits.T) / block.n_words[:, None]
    similar = block.matrix @ units.T if block.dim else np.zeros((len(block.keys), n))
    with_vector = block.has_vector[:, None] & present[None, :]
    score = np.where(with_vector, similar * weights[0] + shared * weights[1], shared * keyword_only_weight)
    score = np.where(with_vector | (shared > 0), score, -np.inf)
    score = np.where(block.has_vector[:, None], score, np.where(shared > 0, shared, -np.inf))
    return np.where(ok, score, -np.inf), ok, with_vector


def _grid(requests: DataFrame, corpus: DataFrame, vector: str, block_rows: int, alone: bool) -> tuple[int, int]:
    """Number of blocks and of splits.

    Each request is sent to every split and each record to every block, so where vectors alone count both are as large
    as a task can hold, but several times more pairs of them than there are cores.
    """
    spark = corpus.sparkSession
    if not alone:
        splits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(corpus.count() / SPLIT_ROWS))
        return max(1, math.ceil(requests.count() / block_rows)), splits

    def measured(df: DataFrame, column: str, most: int) -> tuple[int, int]:
        n, width = df.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
        return n, max(1, math.ceil(n / max(1, min(most, VECTOR_CELLS // max(width or 1, 1)))))

    (asked, blocks), (records, splits) = measured(requests, "vector", block_rows), measured(corpus, vector, SPLIT_ROWS)
    while blocks * splits < TASKS * spark.sparkContext.defaultParallelism and max(asked / blocks, records / splits) > 256:
        if asked / blocks > records / splits:
            blocks += 1
        else:
            splits += 1
    return blocks, splits


def hybrid(requests: DataFrame, corpus: DataFrame, k: int = 5, weights: tuple[float, float] = (0.7, 0.3),
           request_key: str = "request_id", key: str = "id", vector: str = "embedding", filters: tuple[str, ...] = (),
           keyword_only_weight: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best k records per request by weighted cosine and keyword overlap.

    ``requests``: key, vector, and optionally keywords, entities and the
    ``filters`` columns (null means any). ``corpus``: key, vector column, and
    the same lists and filter columns. A record without a vector scores half
    its overlap and needs some; when no candidate of a request has a vector,
    or the request has none, overlap alone counts. Ranks go by scores rounded to
    nine places, so that they do not hang on how blocks were cut. A request key
    that occurs twice is asked once.
    """
    wanted = [c for c in (request_key, "vector", "keywords", "entities", *filters) if c in requests.columns]
    lists = [c for c in ("keywords", "entities") if c in wanted]
    columns = list(dict.fromkeys([key, vector, *lists, *filters]))
    out_schema = (f"{request_key} {requests.schema[request_key].dataType.simpleString()}, "
                  f"{key} {corpus.schema[key].dataType.simpleString()}, similarity DOUBLE, any_vector BOOLEAN, scale DOUBLE")

    scale = 1.0 / keyword_only_weight
    alone = not lists and not filters and weights == (1.0, 0.0)     # vectors alone count

    def best_of_split(asked: pa.Table, records: pa.Table) -> pa.Table:
        if alone:
            found = _nearest_of_split(asked, records, request_key, f"c_{key}", f"c_{vector}", k)
            return pa.table({request_key: found[0], key: found[1], "similarity": pa.array(found[2]),
                             "any_vector": pa.array(np.ones(len(found[2]), dtype=bool)),
                             "scale": pa.array(np.full(len(found[2]), scale))})
        block = _Block(asked, request_key, list(filters))
        records = records.rename_columns([c.removeprefix("c_") for c in records.column_names])
        n = len(block.keys)
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n
        seen_vector = np.zeros(n, dtype=bool)
        step = max(1, MATRIX_CELLS // max(n, 1))
        for part in (records.slice(i, step) for i in range(0, records.num_rows, step)):
            score, ok, with_vector = _score_batch(block, part, weights, vector, keyword_only_weight)
            score = np.floor(score * 1e9 + 0.5) / 1e9
            seen_vector |= (ok & with_vector).any(axis=1)
            part_ids = np.asarray(part[key].to_pylist())
            for r in range(n):
                top = _best(score[r], part_ids, k)
                if len(top):
                    found = part_ids[top], score[r][top]
                    if best[r] is not None:
                        found = tuple(np.concatenate(x) for x in zip(best[r], found))
                        keep = _best(found[1], found[0], k)
                        found = found[0][keep], found[1][keep]
                    best[r] = found
        hits = [(r, b) for r, b in enumerate(best) if b is not None]
        rows = np.repeat([r for r, _ in hits], [len(b[0]) for _, b in hits]).astype(int)
        return pa.table({
            request_key: pa.array([block.keys[r] for r in rows], block.key_type),
            key: pa.array([i for _, b in hits for i in b[0].tolist()], records.schema.field(key).type),
            "similarity": pa.array(np.concatenate([b[1] for _, b in hits]) if hits else np.zeros(0)),
            "any_vector": pa.array(seen_vector[rows]),
            "scale": pa.array(np.where(block.has_vector[rows], scale, 1.0))})

    blocks, splits = _grid(requests, corpus, vector, block_rows, alone)
    asked = (requests.select(*wanted).dropDuplicates([request_key])
             .withColumn("_length", F.coalesce(F.size("vector"), F.lit(-1)))
             .withColumn("_block", F.pmod(F.xxhash64(request_key), F.lit(blocks)).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    left = asked.withColumn("_split", every)
    places = (asked.select(F.col("_length").alias("c_length"), F.col("_block").alias("c_block")).distinct()
              .withColumn("c_split", every))
    right = (corpus.select(*[F.col(c).alias(f"c_{c}") for c in columns])
             .withColumn("c_split", F.pmod(F.xxhash64(f"c_{key}"), F.lit(splits)).cast("int")).join(places, "c_split"))
    merged = left.groupBy("_length", "_block", "_split").cogroup(
        right.groupBy("c_length", "c_block", "c_split")).applyInArrow(best_of_split, out_schema)
    per_request = Window.partitionBy(request_key)
    best = per_request.orderBy(F.desc("similarity"), key)
    ranked = merged.withColumn("any_vector", F.max("any_vector").over(per_request)).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    similarity = F.when(F.col("any_vector"), F.col("similarity")).otherwise(F.col("similarity") * F.col("scale"))
    return ranked.select(request_key, "rank", key, similarity.alias("similarity"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, request_key: str = "request_id", key: str = "id",
          vector: str = "embedding", block_rows: int = SPLIT_ROWS) -> DataFrame:
    """Best k vectors per query by cosine (queries: key, vector)."""
    columns = corpus.filter(F.col(vector).isNotNull())
    return hybrid(queries.select(request_key, "vector"), columns, k, (1.0, 0.0), request_key, key, vector,
                  block_rows=block_rows)


def embed(df: DataFrame, text: str, encode=None, dim: int = 64, out: str = "embedding", load=None) -> DataFrame:
    """Add a vector per text by ``encode(list[str]) -> list[vector | None]``.

    ``load() -> encode`` instead makes the encoder once per task, for models.
    Runs in Arrow batches, as parallel as the input is partitioned. A batch
    that fails is retried text by text, and a text that fails is left null.
    The default encoder needs no model: hashed word counts, unit length.
    """
    given = encode or (lambda texts: hashed_counts(texts, dim))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = load() if load else given

        def one(value):
            try:
                return fn([value])[0]
            except Exception:
                return None

        for texts in batches:
            values = texts.tolist()
            try:
                yield pd.Series([None if v is None else np.asarray(v, dtype="float32") for v in fn(values)], dtype=object)
            except Exception:
                yield pd.Series([one(v) for v in values], dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def hashed_counts(texts: list[str], dim: int) -> list[np.ndarray | None]:
    place = functools.cache(lambda word: int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim)
    out: list[np.ndarray | None] = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        v = np.zeros(dim, dtype="float64")
        for word in text.lower().split():
            v[place(word)] += 1.0
        norm = np.linalg.norm(v)
        out.append(v / norm if norm else v)
    return out
