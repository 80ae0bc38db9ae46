"""Top-k retrieval against brute force on small random data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import rules as R
from corpuslens.operators import recommend as C, vectors as V
from corpuslens.operators.strings import substring_pairs

WORDS = ["search", "list", "form", "table", "rest", "grpc", "modal"]


def overlap(wanted, present):
    hit = sum(any(w.lower() in p.lower() for p in present) for w in wanted)
    return hit / max(len(wanted), 1)


def test_substring_pairs(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    needles = [word(rnd.randint(1, 6)) for _ in range(30)] + [""]
    hays = [word(rnd.randint(1, 12)) for _ in range(40)] + ["", "é" * 3]
    got = substring_pairs(spark.createDataFrame([(n,) for n in needles], "n STRING"),
                          spark.createDataFrame([(h,) for h in hays], "h STRING"), "n", "h")
    want = {(n, h) for n in needles for h in hays if n and n in h}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def make_corpus(rnd, n):
    roles = ["page", "store", "api"]
    return [(i, rnd.choice(roles), rnd.sample(WORDS, rnd.randint(0, 3)), rnd.sample(["UserDto", "Order", "CartItem", "Menu"], rnd.randint(0, 2)))
            for i in range(n)]


def make_requests(rnd, n):
    return [(f"r{i}", rnd.choice(["page", "store", None]), rnd.sample(WORDS + ["sea"], rnd.randint(0, 3)),
             rnd.choice([[], ["user"], ["item", "ord"], ["nothing"]])) for i in range(n)]


def matches(request, case):
    _, role, _, entities = request[:4]
    return (role is None or role == case[1]) and (not entities or any(e in o.lower() for e in entities for o in case[3]))


CASES = "doc_id BIGINT, file_role STRING, keywords ARRAY<STRING>, entities ARRAY<STRING>"
REQUESTS = "request_id STRING, file_role STRING, keywords ARRAY<STRING>, entities ARRAY<STRING>"


def test_recommend(spark):
    rnd = random.Random(2)
    corpus, requests = make_corpus(rnd, 120), make_requests(rnd, 40)
    got = C.recommend(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(corpus, CASES), 5)
    want = []
    for r in requests:
        scored = [(-overlap(r[2], c[2]), c[0]) for c in corpus if matches(r, c) and overlap(r[2], c[2]) > 0]
        want += [(r[0], rank + 1, i) for rank, (_, i) in enumerate(sorted(scored)[:5])]
    assert sorted((r.request_id, r["rank"], r.doc_id) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("block_rows", [1000, 4])
@pytest.mark.parametrize("share_with_vector", [0.6, 0.0])
def test_hybrid(spark, block_rows, share_with_vector):
    rnd = random.Random(3)
    gen = np.random.default_rng(3)
    corpus = [(*c, gen.normal(size=6).tolist() if rnd.random() < share_with_vector else None) for c in make_corpus(rnd, 80)]
    corpus += [(1000, "page", ["form"], ["Order"], [1.0, 2.0]), (1001, "page", ["form"], ["Order"], [0.0] * 6)] if share_with_vector else []
    requests = [(*r, None if i % 5 == 0 else gen.normal(size=2 if i % 7 == 0 else 6).tolist()) for i, r in enumerate(make_requests(rnd, 20))]
    got = V.hybrid(spark.createDataFrame(requests, REQUESTS + ", vector ARRAY<DOUBLE>"),
                   spark.createDataFrame(corpus, CASES + ", embedding ARRAY<FLOAT>").repartition(5),
                   4, key="doc_id", filters=("file_role",), block_rows=block_rows)

    def cosine(a, b):
        b = np.asarray(b, dtype="float32").astype("float64")
        if len(a) != len(b) or not np.linalg.norm(b):
            return 0.0
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    want = {}
    for r in requests:
        cand = [c for c in corpus if matches(r, c)]
        any_vector = r[4] is not None and any(c[4] is not None for c in cand)
        rows = []
        for c in cand:
            o = overlap(r[2], c[2])
            if any_vector and c[4] is not None:
                rows.append((0.7 * cosine(r[4], c[4]) + 0.3 * o, c[0]))
            elif o > 0:
                rows.append((o * (0.5 if any_vector else 1.0), c[0]))
        want[r[0]] = [round(s, 6) for s, _ in sorted(rows, key=lambda x: (-x[0], x[1]))[:4]]
    found = {}
    for row in got.orderBy("request_id", "rank").collect():
        found.setdefault(row.request_id, []).append(round(row.similarity, 6))
    assert found == {k: v for k, v in want.items() if v}


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), ([], [])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_embedding_failures_stay_with_their_text(spark):
    def encode(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "t STRING").coalesce(1)
    got = {r.t: r.embedding for r in V.embed(df, "t", encode).collect()}
    assert got == {"a": [1.0], "bad": None, "ccc": [3.0]}


def test_default_embedding_is_a_unit_vector(spark):
    r = V.embed(spark.createDataFrame([("red blue red",), ("",)], "t STRING"), "t", dim=16).collect()
    norms = [sum(x * x for x in row.embedding) for row in r]
    assert norms == pytest.approx([1.0, 0.0])


@pytest.mark.parametrize("seed,spread", [(1, 100), (2, 100), (3, 6), (4, 2)])
def test_best_practice(spark, seed, spread):
    """Small spreads leave no record above the threshold, so the best tenth stands in."""
    rnd = random.Random(seed)
    cases = [(i, rnd.choice(["page", "store"]), *[float(40 + rnd.randint(0, spread) // 2) for _ in R.DIMENSIONS]) for i in range(70)]
    requests = [(f"r{i}", rnd.choice(["page", "store", None]), rnd.sample(R.DIMENSIONS, rnd.randint(1, 3))) for i in range(15)]
    df = spark.createDataFrame(cases, "doc_id BIGINT, file_role STRING, " + ", ".join(f"{d} DOUBLE" for d in R.DIMENSIONS))
    got = C.best_practice(spark.createDataFrame(requests, "request_id STRING, file_role STRING, dimensions ARRAY<STRING>"),
                          C.score_signatures(df, 3))
    want = []
    for key, role, dims in requests:
        at = [R.DIMENSIONS.index(d) + 2 for d in dims]
        cand = [c for c in cases if role is None or c[1] == role]
        lowest = min(sum(c[i] for c in cand) / len(cand) for i in at)
        threshold = max(lowest * 1.1, lowest + 10) if lowest < 75 else 75
        kept = [c for c in cand if any(c[i] >= threshold for i in at)]
        if not kept:
            order = sorted(cand, key=lambda c: (-sum(c[i] for i in at) / len(at), -max(c[i] for i in at), c[0]))
            kept = order[:-(-len(cand) // 10)]
        best = sorted(kept, key=lambda c: (-max(c[i] for i in at), c[0]))[:3]
        want += [(key, rank + 1, c[0]) for rank, c in enumerate(best)]
    assert sorted((r.request_id, r["rank"], r.doc_id) for r in got.collect()) == sorted(want)


def test_best_practice_reads_short_lists(spark):
    """One of the lists is the whole corpus tied at the top; unknown and no dimensions give no rows or no error."""
    cols = "doc_id BIGINT, file_role STRING, " + ", ".join(f"{d} DOUBLE" for d in R.DIMENSIONS)
    first, second, *others = R.DIMENSIONS
    cases = [(i, "page", 100.0, i / 4, *[100.0 if i == 399 else 50.0 for _ in others]) for i in range(400)]
    signatures = C.score_signatures(spark.createDataFrame(cases, cols), 3)
    pool = signatures.withColumnRenamed("file_role", "role_key")
    lists = C.dimension_lists(pool, 3)
    assert {r.dimension: r["count"] for r in lists.groupBy("dimension").count().collect()} == {d: 3 for d in R.DIMENSIONS}
    assert "WindowGroupLimit" in lists._jdf.queryExecution().executedPlan().toString()
    requests = [("both", "page", [second, first]), ("second", None, [second]), ("other", "page", [others[0]]),
                ("unknown", "page", ["?"]), ("mixed", "page", ["?", second]), ("none", "page", []), ("role", "?", [first])]
    got = C.best_practice(spark.createDataFrame(requests, "request_id STRING, file_role STRING, dimensions ARRAY<STRING>"), signatures)
    found = {}
    for r in got.orderBy("request_id", "rank").collect():
        found.setdefault(r.request_id, []).append((r.doc_id, r.top_score, r.excellent_in))
    assert found == {
        "both": [(0, 100.0, [first]), (1, 100.0, [first]), (2, 100.0, [first])],
        "second": [(399, 99.75, [second]), (398, 99.5, [second]), (397, 99.25, [second])],
        "other": [(399, 100.0, [others[0]])],
        "mixed": [(399, 99.75, [second]), (398, 99.5, [second]), (397, 99.25, [second])]}


def test_important_dimensions_default(spark):
    df = spark.createDataFrame([("nothing known",), ("error retry and a pinia store",)], "t STRING")
    got = [r[0] for r in df.select(C.important_dimensions(F.col("t"))).collect()]
    assert got[0] == ["structure", "apiConnection"] and got[1][:2] == ["errorHandling", "stateManagement"]


def test_infer_api_takes_the_first_telling_hit(spark):
    rows = [("a", 1, ["x"], []), ("a", 2, ["rest"], []), ("a", 3, ["grpc"], []), ("b", 1, [], ["grpc.get"]), ("c", 1, [], [])]
    df = spark.createDataFrame(rows, "request_id STRING, rank INT, keywords ARRAY<STRING>, api_methods ARRAY<STRING>")
    assert {r.request_id: r.api_type for r in C.infer_api(df).collect()} == {"a": "openapi", "b": "grpc", "c": "any"}
