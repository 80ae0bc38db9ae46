"""Near-duplicate vectors by product quantisation.

Unit vectors go to inverted lists by their nearest coarse centroid; the rest
is coded subspace by subspace. A vector probes its own list and every list
near enough to its own for a vector within the distance to lie there, looks up
distances to codes in tables, and the pairs the codes cannot rule out are
compared exactly. Lists meet in blocks of bounded size, and a pair of blocks
returns counts of links and a spanning set of them, never the pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm.bitsliced import finite
from corpuslens.llm.components import components
from corpuslens.sources.store import write_table

SAMPLE_ROWS = 8192      # vectors the quantiser is fitted on
LISTS = 64
SUBSPACES = 16
CODES = 64
BLOCK_ROWS = 1024       # rows of a list in one block
PROBE_ROWS = 4096       # vectors that probe a block at once


class Quantiser(NamedTuple):
    centroids: np.ndarray           # lists x dim
    books: list[np.ndarray]         # per subspace: codes x width
    edges: np.ndarray               # where subspaces begin

    def nearest(self, units: np.ndarray) -> np.ndarray:
        return _nearest(units, self.centroids)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each decoded vector is from its own."""
        codes = np.empty((len(rest), len(self.books)), dtype=np.uint8)
        off = np.zeros(len(rest))
        for m, book in enumerate(self.books):
            part = rest[:, self.edges[m]:self.edges[m + 1]]
            codes[:, m] = _nearest(part, book)
            off += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(off)

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Per subspace: squared distance of each vector to each code."""
        return [((rest[:, self.edges[m]:self.edges[m + 1], None] - book.T[None]) ** 2).sum(axis=1)
                for m, book in enumerate(self.books)]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None] - 2 * points @ centres.T).argmin(axis=1)


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES,
        seed: int = 7) -> Quantiser:
    rng = np.random.default_rng(seed)
    centroids = _means(sample, min(lists, len(sample)), rng)
    rest = sample - centroids[_nearest(sample, centroids)]
    dim = sample.shape[1]
    edges = np.unique(np.linspace(0, dim, min(subspaces, dim) + 1).astype(int))
    books = [_means(rest[:, a:b], min(codes, len(rest)), rng) for a, b in zip(edges[:-1], edges[1:])]
    return Quantiser(centroids, books, edges)


def _units(vectors, dim: int) -> np.ndarray:
    """Unit vectors; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class key, one row per class of equal vectors of a label: node, label, v, copies).

    The node of a class is its smallest id. Rows that cannot link have a null class.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(v)
              & F.exists(v, lambda x: x != F.lit(0.0)))
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
        F.when(usable, F.xxhash64(F.col(label_col).cast("string"), v)).alias("_h1"),
        F.when(usable, F.xxhash64(F.lit("class"), F.col(label_col).cast("string"), v)).alias("_h2"),
        F.when(usable, v).alias("v"))
    grouped = (rows.filter("_h1 IS NOT NULL").groupBy("_h1", "_h2", "label")
               .agg(F.min("id").cast("long").alias("node"), F.first("v").alias("v"), F.count("*").alias("copies")))
    return rows.select("id", "_h1", "_h2"), grouped


def index_vectors(unique: DataFrame, quantiser: Quantiser, dim: int) -> DataFrame:
    """Every class in its list: unit vector, codes, and how far the decoded vector is off."""
    def encode(batches):
        for b in batches:
            units = _units(b["v"].to_numpy(), dim)
            own = quantiser.nearest(units)
            codes, off = quantiser.encode(units - quantiser.centroids[own])
            yield pd.DataFrame({
                "_h1": b["_h1"], "_h2": b["_h2"], "label": b["label"], "node": b["node"], "copies": b["copies"],
                "list": own.astype(np.int32), "unit": [u.tobytes() for u in units],
                "codes": [c.tobytes() for c in codes], "off": off})

    return unique.mapInPandas(encode, "_h1 long, _h2 long, label string, node long, copies long, list int, "
                                      "unit binary, codes binary, off double")


def probes(index: DataFrame, quantiser: Quantiser, radius: float, spread: float | None) -> DataFrame:
    """(label, list, ...) for every list a vector probes.

    A vector within ``radius`` can only lie in a list when the plane between that list and the vector's own is
    within ``radius``: all these lists are probed, which is exact. A ``spread`` probes less far and loses links: only
    planes within spread * radius / sqrt(dimensions), the mean move towards a plane times ``spread`` if differences
    are even over all dimensions, which those of vectors of low rank are not.
    Of two lists the vectors of the lower one probe the higher, so each pair is met once.
    """
    centres = quantiser.centroids
    reach = radius if spread is None else min(radius, spread * radius / np.sqrt(centres.shape[1]))
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))

    def near(batches):
        for b in batches:
            units = np.stack([np.frombuffer(u) for u in b["unit"]]) if len(b) else np.zeros((0, centres.shape[1]))
            own = b["list"].to_numpy()
            far = (centres ** 2).sum(axis=1)[None] - 2 * units @ centres.T
            gap = far - far[np.arange(len(b)), own][:, None]
            ok = gap <= 2 * reach * apart[own] + 1e-9       # for rounding
            ok &= np.arange(len(centres))[None] >= own[:, None]
            row, target = np.nonzero(ok)
            yield pd.DataFrame({"label": b["label"].to_numpy()[row], "list": target.astype(np.int32),
                                "node": b["node"].to_numpy()[row], "copies": b["copies"].to_numpy()[row],
                                "own": own[row].astype(np.int32), "unit": b["unit"].to_numpy()[row]})

    return index.select("label", "list", "node", "copies", "unit").mapInPandas(
        near, "label string, list int, node long, copies long, own int, unit binary")


def linked(index: DataFrame, asked: DataFrame, quantiser: Quantiser, cosine: float,
           block_rows: int = BLOCK_ROWS, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """(node, n, root): links of a node found in a pair of blocks, and the smallest node it is joined with there."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    key = ["label", "list"]
    blocks = index.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    parts = asked.groupBy(*key).agg(F.ceil(F.count("*") / probe_rows).cast("int").alias("parts"))
    plan = write_table(blocks.join(parts, key), "probe-plan")
    left = (index.join(plan, key)
            .withColumn("block", F.expr("pmod(xxhash64('block', node), blocks)").cast("int"))
            .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
            .select(*key, "block", "part", "node", "copies", "unit", "codes", "off"))
    right = (asked.join(plan, key)
             .withColumn("part", F.expr("pmod(xxhash64('part', node), parts)").cast("int"))
             .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select(*[F.col(c).alias(f"q_{c}") for c in [*key, "block", "part"]], "node", "copies", "unit", "own"))
    full = [*key, "block", "part"]

    def search(key_of: tuple, members: pd.DataFrame, askers: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(askers):
            return pd.DataFrame({"node": [], "n": [], "root": []})
        at = int(key_of[1])
        y = np.stack([np.frombuffer(u) for u in members["unit"]])
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in members["codes"]])
        y_node, y_copies = members["node"].to_numpy(), members["copies"].to_numpy()
        limit = (radius + members["off"].to_numpy() + 1e-6) ** 2
        x_node, x_copies = askers["node"].to_numpy(), askers["copies"].to_numpy()
        inside = askers["own"].to_numpy() == at
        found_x, found_y = [], []
        for begin in range(0, len(askers), 256):
            end = min(begin + 256, len(askers))
            x = np.stack([np.frombuffer(u) for u in askers["unit"].iloc[begin:end]])
            tables = quantiser.tables(x - quantiser.centroids[at][None])
            far = np.zeros((end - begin, len(y)), dtype=np.float32)
            for m, table in enumerate(tables):
                far += table.astype(np.float32)[:, codes[:, m]]
            ok = far <= limit[None]
            # within a list each pair is met once
            ok &= ~inside[begin:end, None] | (x_node[begin:end, None] < y_node[None])
            i, j = np.nonzero(ok)
            if len(i):
                same = np.concatenate([np.einsum("ij,ij->i", x[i[s:s + 65536]], y[j[s:s + 65536]])
                                       for s in range(0, len(i), 65536)]) >= cosine
                found_x.append(i[same] + begin)
                found_y.append(j[same])
        if not found_x:
            return pd.DataFrame({"node": [], "n": [], "root": []})
        i, j = np.concatenate(found_x), np.concatenate(found_y)
        nodes = np.concatenate([x_node, y_node])
        n = np.concatenate([np.bincount(i, weights=y_copies[j], minlength=len(x_node)),
                            np.bincount(j, weights=x_copies[i], minlength=len(y_node))]).astype(np.int64)
        # a vector may be both asker and member: its two places start with one root and are joined by it
        root = nodes.copy()
        a, b = i, j + len(x_node)
        while True:
            low = np.minimum(root[a], root[b])
            was = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (root == was).all():
                break
        some = n > 0
        return pd.DataFrame({"node": nodes[some], "n": n[some], "root": root[some]})

    return (left.groupBy(*full).cogroup(right.groupBy(*[f"q_{c}" for c in full]))
            .applyInPandas(search, "node long, n long, root long"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", lists: int = LISTS, sample_rows: int = SAMPLE_ROWS,
                    spread: float | None = None) -> DataFrame:
    """Per row: its id, n_links, component_id and kept.

    Vectors of one label link when their cosine is at least ``cosine``. A null label, a null id and a vector that is
    null, empty, zero or holds null or non-finite components links with nothing and is its own component. A shorter
    vector counts as filled up with zeros. Equal vectors of a label are one class, counted by their copies, and are
    searched once; rows that repeat an id share its node. An empty table gives no rows. The quantiser is fitted on
    the ``sample_rows`` classes with the smallest hashes; every class is indexed. All links are found unless a
    ``spread`` is given (see ``probes``).
    """
    rows, unique = classes(vectors, id_col, vector_col, label_col)
    unique = write_table(unique, "vector-classes")
    dim = unique.agg(F.max(F.size("v"))).first()[0]
    kind = vectors.schema[id_col].dataType
    if dim is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    sample = unique.orderBy(F.xxhash64("_h1"), "_h2").limit(sample_rows).select("v").collect()
    quantiser = fit(_units([r.v for r in sample], dim), lists)
    index = write_table(index_vectors(unique, quantiser, dim), "vector-index")
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    asked = probes(index, quantiser, radius, spread)
    found = write_table(linked(index, asked, quantiser, cosine), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("_n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = (index.select("_h1", "_h2", "node", "copies").join(counts, "node", "left")
                 .join(joined, "node", "left")
                 .select("_h1", "_h2", (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "node").alias("component_id")))
    return (rows.join(per_class, ["_h1", "_h2"], "left")
            .select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", F.col("id").cast("long")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
