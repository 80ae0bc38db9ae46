"""Joins, comparison and catalogue on hand-made rows."""

from pyspark.sql import functions as F

from corpuslens.operators import joins as J, migrate as H, packages as P, vectors as V
from corpuslens.operators.strings import substring_matches


def test_missing_counts_are_the_counts_of_missing_values(spark):
    pairs = spark.createDataFrame([("p", "e"), ("q", "e"), ("e", "e")], "project STRING, exemplar STRING")
    values = spark.createDataFrame(
        [("e", "patterns", v) for v in "abc"] + [("p", "patterns", "a"), ("p", "patterns", "z"), ("e", "api_methods", "m"),
                                                  ("q", "api_methods", "m")], "project STRING, field STRING, value STRING")
    fields = ["patterns", "api_methods"]
    counts = {(r.project, r.field): r.n for r in J.missing_counts(pairs, values, fields).collect()}
    assert counts == {("p", "patterns"): 2, ("p", "api_methods"): 1, ("q", "patterns"): 3, ("q", "api_methods"): 0,
                      ("e", "patterns"): 0, ("e", "api_methods"): 0}
    rows = J.anti_join_missing(pairs, values, fields).groupBy("project", "field").count().collect()
    assert {(r.project, r.field): r["count"] for r in rows} == {k: n for k, n in counts.items() if n}


def test_guide_places_count_all_named_ids(spark):
    requests = spark.createDataFrame([(1, ["a", "b", "a", "x", "c"])], "request_id INT, wanted ARRAY<STRING>")
    guides = spark.createDataFrame([("a",), ("b",), ("c",)], "id STRING")
    got = J.join_guides_by_id(requests, guides).collect()
    assert sorted((r.position, r.id) for r in got) == [(1, "a"), (2, "b"), (5, "c")]


def test_a_use_is_counted_once(spark):
    meta = spark.createDataFrame([("p", ["Box"], ["useLocale", "useOther"])],
                                 "project STRING, components_used ARRAY<STRING>, composables_used ARRAY<STRING>")
    catalog = spark.createDataFrame([("one", "function", "i18n", "useLocale"), ("two", "function", "i18n", "useLocale"),
                                     ("one", "component", "layout", "Box")],
                                    "library STRING, kind STRING, slot STRING, name STRING")
    got = {(r.kind, r.library, r.uses) for r in P.catalog_enrich(meta, catalog).collect()}
    assert got == {("component", "one", 1), ("function", "ambiguous", 1), ("function", "unknown", 1)}


def test_repeated_plain_ids_do_not_multiply_stamped_ones(spark):
    rows = [("a-1700000000000", "2024-01-02"), ("a", "2024-01-01"), ("a", "2024-01-03")]
    df = spark.createDataFrame(rows, "old_id STRING, analyzed_at STRING")
    got = H.migrate_ids(df).filter("status = 'migrated'").collect()
    assert [(r.new_id, r.writes) for r in got] == [("a", False)]


def test_top_k_is_the_same_for_any_number_of_blocks(spark):
    vectors = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)]
    corpus = spark.createDataFrame(vectors, "id LONG, embedding ARRAY<FLOAT>")
    asked = corpus.filter("id < 20").select(F.col("id").alias("request_id"), F.col("embedding").alias("vector"))
    twice = asked.union(asked.filter("id = 3"))
    results = [sorted(map(tuple, V.top_k(asks, corpus, 4, block_rows=n).collect()))
               for asks, n in ((asked, 4096), (asked, 3), (twice, 7))]
    assert results[0] == results[1] == results[2] and len(results[0]) == 80


def test_substrings_of_long_texts_by_key(spark):
    long = "x" * 500_000 + "needle" + "y" * 500_000
    hays = spark.createDataFrame([(1, "a", long), (1, "b", "Nee dle"), (2, "a", "日本語 😀 n"), (3, "a", ""), (4, "a", None)],
                                 "id INT, field STRING, hay STRING")
    needles = spark.createDataFrame([(n,) for n in ("needle", "n", "本語", "😀", "", "eed", "xyz", "日本語 😀")], "needle STRING")
    got = {(r.needle, r.id, r.field) for r in substring_matches(needles, hays, "needle", "hay", ["id", "field"]).collect()}
    texts = {(r.id, r.field): r.hay or "" for r in hays.collect()}
    assert got == {(n.needle, *k) for n in needles.collect() for k, t in texts.items() if n.needle and n.needle in t}


def test_top_k_of_odd_vectors_matches_brute_force(spark, monkeypatch):
    """Equal, zero, broken, short and missing vectors; tiles of a few rows; scores that differ below single precision."""
    import numpy as np
    rng = np.random.default_rng(8)
    vectors = [list(map(float, rng.normal(size=8).round(1))) for _ in range(60)]
    vectors += [vectors[0]] * 9 + [[2 * x for x in vectors[0]]] * 3 + [[0.0] * 8] * 7 + [[1.0, 2.0]] * 3 + [[]] * 2 + [None] * 3
    close = np.array(vectors[1])
    vectors += [list(map(float, close + 1e-5 * rng.normal(size=8))) for _ in range(40)]
    vectors += [[float("nan")] + [1.0] * 7, [None] + [1.0] * 7]
    rows = [(f"v{i:03}", v) for i, v in enumerate(rng.permutation(np.array(vectors + [0], dtype=object)[:-1]).tolist())]

    def score(a, b):
        if not a or b is None or any(x is None or x != x for x in [*a, *b]):
            return None
        if len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        a, b = np.array(a), np.array(b)
        return float(np.floor(a @ b / np.linalg.norm(a) / np.linalg.norm(b) * 1e9 + 0.5) / 1e9)

    want = set()
    for i, a in rows:
        found = sorted((-s, j) for j, b in rows if (s := score(a, b)) is not None)[:5]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    corpus = spark.createDataFrame(rows, "id STRING, embedding ARRAY<DOUBLE>")
    asks = corpus.select(F.col("id").alias("request_id"), F.col("embedding").alias("vector"))
    for tile, cells in (((7, 11, 3), 200), ((1024, 4096, 512), 1 << 22)):
        monkeypatch.setattr(V, "TILE", tile)
        monkeypatch.setattr(V, "VECTOR_CELLS", cells)
        got = {tuple(r) for r in V.top_k(asks, corpus, 5).collect()}
        assert {g[:3] for g in got} == {w[:3] for w in want}
        assert {g[:3]: round(g[3], 8) for g in got} == {w[:3]: round(w[3] + 0.0, 8) for w in want}


def test_copies_of_vectors_do_not_grow_with_the_shuffle_partitions(spark):
    vectors = spark.range(3000).select(F.col("id").alias("request_id"), F.col("id"), F.array(F.rand(1), F.rand(2)).alias("vector"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        plan = V.top_k(vectors.select("request_id", "vector"), vectors.select("id", F.col("vector").alias("embedding")), 3)
        text = plan._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "sequence(0, " in text and "sequence(0, 599" not in text
