import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import bitsliced, quantised
from corpuslens.llm.components import components
from tests_llm_helpers import components_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_components_match_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == components_of(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k, is_query):
    codes = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            c = [math.floor(256 * float(np.float32(x))) for x in v]
            codes[i] = max(codes.get(i, c), c)
    out = []
    for q in codes:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(codes[q], codes[i])), i) for i in codes
                          if i != q and len(codes[i]) == len(codes[q]))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_bit_slices_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 0, 0, 1]) * rng.random() * 3 for _ in range(6)], 0) for i in range(300)]
    rows += [(400 + i, [0.5, -0.25, 0.0, 1.0, -1.0, 0.125], 1) for i in range(30)]      # ties
    rows += [(600, None, 0), (601, [], 0), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0),
             (603, [float("nan")] * 6, 0), (604, [float("inf")] * 6, 0), (None, [1.0] * 6, 0),
             (605, [1.0, 2.0], 0), (610, [2.0, 1.0], 0), (405, [0.5, 9.0, 0.0, 1.0, -1.0, 0.125], 1), (0, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("codes", F.lit(1)).withColumn("id", F.lit("x"))
    got = bitsliced.search(df, F.col("id") % 5 == 0, k=7, block_rows=70, query_rows=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 7, lambda q: q % 5 == 0)


def test_bit_slices_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, -2.0], 0), (5, [1.0, -2.0], 0), (7, [0.0, 0.0], 0)], SCHEMA)
    got = bitsliced.search(df, F.col("id") % 5 == 0, k=9)
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 1, 5, 327680), (0, 2, 7, 0), (5, 1, 0, 327680), (5, 2, 7, 0)]
    assert bitsliced.search(df.limit(0), F.col("id") % 5 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e30], 0), (1, [1e30], 0)], SCHEMA)
    assert bitsliced.search(big, F.col("id") == 0).first().score == (1 << 63) - 1


def brute_links(rows, cosine):
    units = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        u = np.zeros(16)
        if ok:
            u[:len(v)] = np.array(v, dtype=np.float32)
            u /= np.linalg.norm(u)
        units.append(u if ok else None)
    links, n = [], Counter()
    for a, (i, _, la) in enumerate(rows):
        for b in range(a):
            j, _, lb = rows[b]
            if units[a] is not None and units[b] is not None and la == lb and units[a] @ units[b] >= cosine:
                links.append((i, j))
                n[a] += 1
                n[b] += 1
    return n, links


def check_near(got, rows, cosine=0.93):
    n, links = brute_links(rows, cosine)
    root = components_of(links, {i for i, *_ in rows if i is not None})
    want = Counter((i, n[a], root.get(i), i is None or root[i] == i) for a, (i, *_) in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == want


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for group in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((at, (centre + rng.normal(size=16) * 0.09).tolist(), int(group % 3)))
            at += 1
    rows += [(at + i, rows[i % 7][1], rows[i % 7][2]) for i in range(300)]      # a third are exact copies
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1),
             (2004, [1.0, None], 1), (2005, [1.0], 1), (2006, [3.0], 1), (None, rows[0][1], 0), (2007, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(9)).withColumn("v", F.lit("x"))
    # probing as far as the cut allows finds every pair
    check_near(quantised.near_duplicates(df, lists=8, spread=100.0), rows)


def test_recall_with_fewer_probes(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(400, 32))
    rows = [(i, (centres[i % 400] + rng.normal(size=32) * 0.15).tolist(), 0) for i in range(1200)]
    u = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    n = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in quantised.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] <= n[i] for i in got)
    assert sum(got.values()) >= 0.99 * n.sum() > 0


def test_large_group_of_near_vectors_over_blocks(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(2500)]
    got = quantised.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2499, 0)}
    assert quantised.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def low_rank_vectors(rng, n, dim, rank, first=0):
    basis = np.linalg.qr(rng.normal(size=(dim, rank)))[0].T
    return [(first + i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(n, rank)) @ basis)]


def brute_counts(rows, cosine=0.93):
    u = np.zeros((len(rows), max(len(v) for _, v, _ in rows)))
    for i, (_, v, _) in enumerate(rows):
        u[i, :len(v)] = np.array(v, dtype=np.float32)
    u /= np.linalg.norm(u, axis=1)[:, None]
    n = (u @ u.T >= cosine).sum(axis=1) - 1
    return {i: int(k) for (i, _, _), k in zip(rows, n)}


def test_no_link_is_lost_between_vectors_of_low_rank(spark):
    rng = np.random.default_rng(12)
    rows = low_rank_vectors(rng, 1500, 256, 4)
    want = brute_counts(rows)
    got = {r.vec_id: r.n_links for r in quantised.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(want.values()) > 1000 and got == want


def test_one_long_vector_loses_no_link(spark):
    rng = np.random.default_rng(13)
    hot = low_rank_vectors(rng, 500, 16, 3)
    other = [(500 + i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(1000, 16)))]
    rows = hot + other + [(9000, rng.normal(size=256).tolist(), 0)]
    want = brute_counts(rows)
    got = {r.vec_id: r.n_links for r in quantised.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(want.values()) > 1000 and got == want
