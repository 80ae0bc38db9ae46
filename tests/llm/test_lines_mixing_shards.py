import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from corpuslens.llm import lines, mixing, sharding

SCHEMA = "doc_id long, text string, source string"


def docs_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def random_docs(n=120, seed=3):
    rng = random.Random(seed)
    pool = ["Same line", " same LINE\t", "other", "", "  ", "Ünïque É", "hot"]
    out = []
    for i in range(n):
        text = "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {rng.random()}"
                         for _ in range(rng.randint(1, 90)))
        out.append((i, None if i % 17 == 0 else text, "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None))
    return out


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def expected_lines(rows, min_docs, keep_first):
    places = defaultdict(list)
    for i, text, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line_key(line):
                places[line_key(line)].append((i, pos))
    gone = set()
    for found in places.values():
        if len({i for i, _ in found}) >= min_docs:
            gone.update(sorted(found)[1:] if keep_first else found)
    return {i: ([x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone], len((t or "").split("\n")))
            for i, t, *_ in rows}


@pytest.mark.parametrize("min_docs,keep_first", [(10, False), (2, True), (1, True)])
def test_lines_match_brute_force(spark, min_docs, keep_first):
    rows = random_docs()
    want = expected_lines(rows, min_docs, keep_first)
    got = lines.drop_lines(docs_of(spark, rows), min_docs=min_docs, keep_first=keep_first).collect()
    assert len(got) == len(rows)
    for r in got:
        kept, n = want[r.doc_id]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), n, n - len(kept))


def test_lines_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x\nx", "a"), (None, "x\ny", "a"), (None, "x\nz", "a"), (3, "x\nx", "a")]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS keep", "2 AS n_lines", "'c' AS _id", "4 AS `a.b`")
    got = lines.drop_lines(docs, min_docs=3, keep_first=False)
    assert got.columns == ["doc_id", "text", "source", "keep", "_id", "a.b", "n_lines", "n_dropped"]
    # the two equal rows of id 3 are one document; the null ids have other texts, so they are two
    assert sorted((r.text, r.n_dropped) for r in got.collect()) == [
        ("", 0), ("", 0), ("", 2), ("", 2), ("y", 1), ("z", 1)]
    assert lines.drop_lines(docs.limit(0), min_docs=2).count() == 0


def test_long_document_with_many_lines(spark):
    text = "\n".join(["dup"] + [f"line {i}" for i in range(30_000)] + ["dup"])
    got = lines.drop_lines(docs_of(spark, [(1, text, "s"), (2, "dup", "s")]), min_docs=2).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped) for r in got] == [(30_002, 1), (1, 1)]
    assert hashlib.sha256(got[0].text.encode()).hexdigest() == hashlib.sha256(text[:-4].encode()).hexdigest()


def check_shards(got, rows, shards):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for s, own in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in own) == list(range(len(own)))
    assert Counter((r.doc_id, r.size) for r in got) == Counter(
        (i, len((t or "").encode()) + 8) for i, t, *_ in rows)
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_shards_are_even_and_keep_copies(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["copy one", "copy two é"]) if i % 10 == 0 else "x" * rng.randint(0, 200), "s")
            for i in range(3000)]
    got = sharding.shard(docs_of(spark, rows), shards=6, tolerance=0.1).collect()
    sizes = check_shards(got, rows, 6)
    mean = sum(sizes.values()) / 6
    assert max(abs(x - mean) for x in sizes.values()) < 0.12 * mean + 210
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    assert max(map(len, groups.values())) == 1


def test_group_heavier_than_a_shard_is_split(spark):
    rows = [(i, "the same text" if i < 900 else f"text {i}", "s") for i in range(1200)]
    got = sharding.shard(docs_of(spark, rows), shards=8).collect()
    sizes = check_shards(got, rows, 8)
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 8 + 21


def test_shard_edges(spark):
    rows = [(None, None, "s"), (1, "", "s"), (1, "", "s"), (2 ** 60 + 1, "x" * 100_000, "s")]
    check_shards(sharding.shard(docs_of(spark, rows), shards=3).collect(), rows, 3)
    assert sharding.shard(docs_of(spark, []), shards=3).count() == 0


def test_written_shards_hold_the_texts_in_slot_order(spark, tmp_path):
    rows = [(i, f"text {i % 50} " * (i % 7), "s") for i in range(200)]
    docs = docs_of(spark, rows)
    placed = sharding.shard(docs, shards=4)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t, _ in rows}
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}


def best_exponent(tokens, target, repeats):
    total = sum(tokens)
    p = [t / total for t in tokens]

    def ok(x):
        w = [v ** x for v in p]
        z = sum(w)
        entropy = -sum(v / z * math.log(v / z) for v in w)
        rates = [v / t for v, t in zip(w, tokens)]
        return max(rates) / min(rates) <= repeats and entropy <= target * math.log(len(p))
    low, high = 0.0, 1.0
    if ok(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


@pytest.mark.parametrize("target,repeats", [(1.0, 2.0), (0.9, 50.0)])
def test_mix_matches_brute_force(spark, target, repeats):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 40), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    mix = mixing.weigh(docs_of(spark, rows), target_entropy=target, max_repeats=repeats)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    names = sorted(tokens)
    x = best_exponent([tokens[s] for s in names], target, repeats)
    w = {s: (tokens[s] / sum(tokens.values())) ** x for s in names}
    z = sum(w.values())
    budget = max(tokens[s] / (w[s] / z) for s in names)
    got = {r.source: r for r in mix.weights.collect()}
    for s in names:
        assert got[s].weight == pytest.approx(w[s] / z, rel=1e-6)
        assert abs(got[s].budget - w[s] / z * budget) <= 1
    placed = mixing.schedule(mix, block_tokens=500).collect()
    taken = Counter()
    for r in placed:
        taken[r.source] += r.tokens
    for s in names:     # the last pass stops at the last document that fits
        assert got[s].budget - 40 < taken[s] <= got[s].budget
        passes = Counter(r.doc_id for r in placed if r.source == s)
        assert set(passes) == {i for i, _, o in rows if o == s}
        assert max(passes.values()) - min(passes.values()) <= 1
    by = defaultdict(list)
    for r in placed:
        by[r.block].append(r)
    assert all(sorted(r.position for r in own) == list(range(len(own))) for own in by.values())
    assert sorted(by) == list(range(len(by)))
    for own in list(by.values())[:-1]:
        assert abs(sum(r.tokens for r in own) - 500) <= 40 * len(names)


def test_mixed_documents_are_the_schedule(spark):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else None) for i in range(90)] + [(500, "", "empty"), (501, None, "empty")]
    docs = docs_of(spark, rows).selectExpr("*", "doc_id * 2 AS passes", "'k' AS _key")
    got = mixing.mix_documents(docs, max_repeats=1.6)
    assert got.columns == docs.columns
    want = mixing.schedule(mixing.weigh(docs, max_repeats=1.6))
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in want.collect())
    assert {r.doc_id for r in got.collect()} == {i for i, *_ in rows}
    assert mixing.mix_documents(docs.limit(0), max_repeats=2.0).count() == 0


def test_mix_with_a_budget_stops_there(spark):
    rows = [(i, "a b c d", "x" if i < 80 else "y") for i in range(100)] + [(7, "a b c d", "x")]
    mix = mixing.weigh(docs_of(spark, rows), budget=100)
    taken = Counter()
    for r in mixing.schedule(mix).collect():
        taken[r.source] += r.tokens
    assert taken == {"x": 80, "y": 20}      # budgets 80.2 and 19.8, rounded to whole tokens


def test_documents_without_tokens_are_dealt_over_all_blocks(spark):
    rows = [(i, "one two three four five six seven eight nine ten", "full") for i in range(50)]
    rows += [(1000 + i, None if i % 2 else " ", "bare") for i in range(600)]
    mix = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.schedule(mix, block_tokens=50).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    bare = Counter(r.block for r in got if r.source == "bare")
    assert len(bare) == 10 and max(bare.values()) < 120
    for block in bare:
        assert sorted(r.position for r in got if r.block == block) == list(range(sum(r.block == block for r in got)))
    assert mixing.schedule(mixing.weigh(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0
