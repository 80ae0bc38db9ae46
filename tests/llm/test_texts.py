import gc
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import language_model, minhash, pieces, quality, toxicity
from tests_llm_helpers import components_of

SCHEMA = "doc_id long, text string"


def shingle_set(text, size):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t, *_ in rows]
    links = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if i is not None and j is not None
             and x and y and 100 * len(x & y) >= percent * len(x | y)]
    return components_of(links, {i for i, _ in sets if i is not None}), dict(sets)


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return " ".join(out)


def near_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 6)):
            rows.append(edited(words, rng, rng.randint(0, max(1, len(words) // 25))))
    rows += ["Same COPY of a text"] * 25 + ["same copy OF a\ttext"] * 5
    rng.shuffle(rows)
    rows = [(3 * i, t) for i, t in enumerate(rows)]
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "two words"), (9005, "TWO  words"), (9006, "É é É é"),
                   (9007, "é É É é"), (None, "Same COPY of a text"), (0, rows[0][1])]


@pytest.mark.parametrize("size,percent", [(4, 80), (5, 80), (2, 60)])
def test_near_documents_match_brute_force(spark, size, percent):
    rows = near_rows()
    root, sets = brute_groups(rows, size, percent)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("id", F.lit("x"))
    got = minhash.near_duplicates(docs, size=size, percent=percent, rows=5 if percent == 80 else 3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) if r.doc_id is not None else True
        assert (r.component_id, r.kept) == ((root[r.doc_id], root[r.doc_id] == r.doc_id) if r.doc_id is not None
                                            else (None, True))


def test_links_that_miss_the_first_member_are_found(spark):
    """A chain: neighbours link, ends do not, so stars around the smallest id are not enough."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i:] + [f"n{k}" for k in range(8 * i)])) for i in range(12)]
    root, _ = brute_groups(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(
        spark.createDataFrame(rows, SCHEMA), size=4).collect()}
    assert got == root and set(root.values()) == {0}


def test_strays_meet_over_many_partitions(spark):
    """Chains of one bucket each, in partitions that are not put together: most links are between strays."""
    rows = []
    for chain in range(6):
        words = [f"c{chain}w{i}" for i in range(400)]
        rows += [(100 * chain + i, " ".join(words[8 * i:] + [f"c{chain}n{k}" for k in range(8 * i)])) for i in range(12)]
    root, sets = brute_groups(rows, 4, 80)
    assert set(root.values()) == {0, 100, 200, 300, 400, 500}
    held = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(rows, SCHEMA)
        sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "doc_id long, n_shingles int")
        signed = docs.join(sizes, "doc_id").select(
            F.col("doc_id").alias("node"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "n_shingles",
            F.array(F.floor(F.col("doc_id") / 100)).alias("bands"))
        found = minhash.links(docs, signed, "doc_id", "text", 4, 80).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert components_of([(r.a, r.b) for r in found], root) == root


def test_repeated_id_with_two_texts_and_strays_in_its_bucket(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(300)]
    # chains of neighbours that link, around the first text of id 0, and strays just below the limit
    rows = [(0, " ".join(words)), (0, " ".join(f"z{i}" for i in range(40))), (0, "")]
    rows += [(10 + i, edited(words, rng, 12 + i % 6)) for i in range(40)]
    rows += [(100 + i, edited([f"z{k}" for k in range(40)], rng, 1)) for i in range(10)]
    # an id that joins two groups, and shares the set of a smaller id
    rows += [(200, "some quite other text here"), (201, "some quite other text here"), (201, "and one more of them at last"),
             (202, "and one more of them at last"), (203, ""), (203, None)]
    root, sets = brute_groups(rows, 4, 80)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4, rows=3).collect()
    assert len(got) == len(rows) and len(set(root.values())) > 5
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, c, i == c) for i, c in root.items()}


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 1 << 62, 300, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[:200], rng.integers(0, 1 << 62, 100, dtype=np.int64).astype(np.uint64)])
        x, y = minhash.super_minhash([a, b], 160)
        errors.append((x == y).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.042
    # every slot is a minimum over the set: a set's signature is the least of its parts' signatures
    parts = minhash.super_minhash([a[:50], a[50:], a, a[:1]], 64)
    assert (parts[2] <= np.minimum(parts[0], parts[1])).all()
    assert (minhash.super_minhash([a], 64)[0] == parts[2]).all()


def test_signature_is_the_least_offer_of_every_step():
    """Against SuperMinHash done one element at a time, without stopping early."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 70):
        elements = rng.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64)
        slots, want = 24, [1 << 70] * 24
        for e in elements:
            order = list(range(slots))
            for j in range(slots):
                draw = minhash.mixed(np.array([e + np.uint64((2 * j + 1) * minhash.GOLDEN % (1 << 64))]))
                k = j + int(minhash.mixed(draw ^ np.uint64(minhash.GOLDEN))[0] % np.uint64(slots - j))
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], (j << 56) | int(draw[0]) >> 8)
        assert minhash.super_minhash([elements], slots)[0].tolist() == want


def test_language_model_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "ÉTÉ", "on", f"w{rng.randrange(60)}"])
                         for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(None, "the cat"), (3, None), (3, "cat\x0bsat"), (2 ** 60 + 1, "the " * 5000)]
    tokens = [[bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (t or "").encode().split()] + [b""]
              for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    one, two = Counter(), Counter()
    for w, h in zip(tokens, held):
        if not h:
            one.update(w)
            two.update(zip([b""] + w, w))
    n, v = sum(one.values()), len(one)
    want = []
    for (i, _), w, h in zip(rows, tokens, held):
        p = [(one[x] + 1) / (n + v + 1) for x in w]
        base = sum(map(math.log10, p))
        score = sum(math.log10((two[a, b] + 50 * q) / (one[a] + 50)) for a, b, q in zip([b""] + w, w, p))
        want.append((i, h, len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).repartition(3)
    got = language_model.score(docs, language_model.held_out_seventh(), smoothing=50.0, block_bytes=700, buckets=5)
    rounded = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
               for r in got.collect()]
    assert Counter(rounded) == Counter(want)
    assert language_model.score(docs.limit(0), language_model.held_out_seventh()).count() == 0


def test_model_is_a_distribution():
    """Probabilities after a state sum to one over the known words and one unknown."""
    counts = np.array([4.0, 3.0, 2.0, 1.0])     # end first
    n, v, s = counts.sum(), len(counts), 7.0
    p = np.append((counts + 1) / (n + v + 1), 1 / (n + v + 1))
    after = np.array([1.0, 0, 2, 0, 0])
    assert ((after + s * p) / (after.sum() + s)).sum() == pytest.approx(1.0)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    return lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta."] + [f"x{rng.randrange(3000)}y"] * 30)
                              for _ in range(n))


def test_quality_finds_faults_without_labels(spark, prose):
    rows = []
    for i in range(400):
        n = 30 + i % 90
        text = prose(n)
        fault = i % 8
        if fault == 1:
            text = " ".join(w + "###" for w in text.split())
        elif fault == 2:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif fault == 3:
            text = " | ".join(text.split())
        elif fault == 4:
            text = " ".join(w for w in text.split()[:6] for _ in range(12))
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, prose(3000)), (902, prose(40)), (None, prose(40))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("old")).withColumn("_t", F.lit(1))
    got = quality.classify(docs)
    assert got.columns == ["doc_id", "text", "_t", "score", "votes_bad", "kept"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        bad = r.doc_id in (900, 901) or (r.doc_id is not None and r.doc_id < 400 and r.doc_id % 8 in (1, 2, 3, 4))
        assert r.kept == (not bad), r
    assert quality.classify(docs.limit(0)).count() == 0


def test_quality_estimates_accuracies():
    rng = np.random.default_rng(1)
    n, m = 20_000, len(quality.LABELLERS)
    fault = np.where(rng.random(n) < 0.85, -1, rng.integers(0, 3, n))
    votes = np.where(rng.random((n, m)) < 0.004, quality.BAD, quality.GOOD)
    for j in range(3):
        votes[fault == j, j] = np.where(rng.random((fault == j).sum()) < 0.8, quality.BAD, quality.GOOD)
    votes[rng.random((n, m)) < 0.1] = quality.SILENT
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    good = model.posterior(patterns)[inverse.ravel()] >= 0.5
    spotted = (votes == quality.BAD).any(axis=1)
    assert (good == ~spotted)[fault >= 0].mean() > 0.95
    assert good[fault < 0].mean() > 0.96


def toxic_rows(prose):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        text, y = prose(60), int(i % 6 == 0)
        if y:
            w = text.split()
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["nitwit", "Dunce,", "zorbling", "zorbler"]))
            text = " ".join(w)
        elif i % 6 == 1:
            text = text + " nitwit bird"        # an exception phrase
        rows.append((i, text, y))
    return rows


def test_toxicity_on_held_out_rows(spark, prose):
    rows = toxic_rows(prose)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (None, "x"), (0, "x y")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3000, 1), (5, None), (None, 1)],
                                   "doc_id long, toxic int")
    got = toxicity.classify(docs.withColumn("score", F.lit("old")), labels).collect()
    assert len(got) == len(rows) + 4
    y = {i: y for i, _, y in rows}
    text = {i: t for i, t, _ in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in y and r.text == text[r.doc_id]:
            assert r.predicted == y[r.doc_id], r
        elif r.text in (None, ""):
            assert r.predicted == 0


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" dunce ": 2.0, " zorb": 3.0, " nitwit ": 1.0}, [" nitwit bird "], [])
    a = lexicon.automaton()
    assert sorted(toxicity.hits(a, toxicity.fold("Dunce! a Dуnce dυnce dunсе ZORBLING z0rb unzorb")).values()) == [
        2.0, 2.0, 2.0, 3.0, 3.0]
    assert toxicity.hits(a, toxicity.fold("the nitwit bird")) == {}
    assert list(toxicity.hits(a, toxicity.fold("a N1TW​IT, bird-less nitwit")).values()) == [1.0]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.classify(docs, none).collect()] == [0, 0]
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.classify(docs, one).collect()] == [0, 0]
    assert toxicity.classify(docs.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def small_vocabulary():
    rng = random.Random(1)
    found = {c: (i, -float(rng.randint(5, 9))) for i, c in enumerate("abc▁")}
    for w in ["ab", "bc", "abc", "▁a", "▁ab", "ca", "aa", "aaa", "bca", "▁▁"]:
        found[w] = (len(found), -float(rng.randint(3, 12)))
    return pieces.Vocabulary.of(found, list(range(100, 356)))


def segmentations(v, word):
    if not word:
        return [((), 0.0)]
    out = []
    for j in range(1, len(word) + 1):
        got = v.pieces.get(word[:j])
        if got is not None:
            ids, s = (got[0],), got[1]
        elif j == 1:
            ids, s = tuple(v.unknown_ids(word[0])), v.unknown_score
        else:
            continue
        out += [(ids + rest, s + t) for rest, t in segmentations(v, word[j:])]
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
def test_n_best_match_all_segmentations(small_vocabulary, k):
    rng = random.Random(k)
    coder = pieces.Encoder(small_vocabulary)
    for _ in range(150):
        text = "".join(rng.choice("abcdé \n▁") for _ in range(rng.randint(0, 9)))
        every = segmentations(small_vocabulary, pieces.normal(text))
        scores = dict(every)
        got = coder.encode(text, k)
        assert [s for _, s in got] == sorted((s for _, s in every), reverse=True)[:k]
        assert len({tuple(ids.tolist()) for ids, _ in got}) == len(got)
        for ids, s in got:
            assert scores[tuple(ids.tolist())] == s
            assert coder.decode(ids) == text


def test_pieces_round_trip(spark):
    v = pieces.Vocabulary.read(pieces.MODEL)
    texts = [None, "", " ", "  two  spaces ", "▁ sign", "日本\n\t\r\x00 é́ 😀", "x" * 3000, "word " * 30_000]
    rows = [(None if i == 3 else 2 ** 60 + i, t) for i, t in enumerate(texts)] + [(5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash"))
    coded = pieces.encode(docs, v, k=3)
    back = pieces.decode(coded, v).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    for r in back:
        assert r.n_pieces == len(r.ids) and all(s <= r.score for s in r.others)
    assert pieces.encode(docs.limit(0), v).count() == 0
    # every further segmentation decodes to the same text and is told apart by its ids
    every = pieces.encode(docs, v, k=3, whole=True).select("doc_id", "ids", "others", F.posexplode("other_ids"))
    again = pieces.decode(every, v, "col").collect()
    assert Counter((r.doc_id, r.text) for r in again if r.pos == 0) == Counter((i, t or "") for i, t in rows if t)
    value = {i: s for i, s in v.pieces.values()}
    for r in again:
        assert r.col != r.ids and len(r.others) > r.pos
        if all(i in value for i in r.col):
            assert abs(sum(value[i] for i in r.col) - r.others[r.pos]) < 1e-6 * len(r.col)


@pytest.fixture(scope="module")
def signs_vocabulary():
    rng = random.Random(2)
    found = {c: (i, -float(rng.randint(5, 9))) for i, c in enumerate("ab²,.(_▁")}
    for w in ["ab", "ba", "▁a", "▁(", "(a", ".a", "²,", "),", ",.", "._", "b_", "b_a", "▁ab", "▁▁"]:
        found[w] = (len(found), -float(rng.randint(3, 12)))
    return pieces.Vocabulary.of(found, list(range(100, 356)))


def test_pieces_are_cut_before_signs_that_no_piece_joins(signs_vocabulary):
    coder = pieces.Encoder(signs_vocabulary)
    coder.encode("ab ab, ab,. ab. b_a ²,")
    # a cut word is learnt once, whatever follows it; "b_" and "²," are in pieces, so nothing is cut there
    assert {"▁ab", ",", ",.", ".", "▁b_a", "▁²,"} == set(coder.words)
    for word in ("ab", ",", "b_a", "²,", "▁(a"):
        assert "".join(coder.split(word)) == pieces.SPACE + word.replace("▁", pieces._ESCAPED)


@pytest.mark.parametrize("k", [1, 2, 4])
@pytest.mark.parametrize("cache", [3, pieces.CACHE])
def test_groups_of_texts_match_all_segmentations(signs_vocabulary, k, cache):
    rng = random.Random(k)
    coder = pieces.Encoder(signs_vocabulary, cache=cache)
    for _ in range(20):
        texts = ["".join(rng.choice("aabb²,.(_) é\n") for _ in range(rng.randint(0, 8))) for _ in range(8)]
        for text, got in zip(texts, coder.encode_all(texts, k), strict=True):
            every = segmentations(signs_vocabulary, pieces.normal(text))
            scores = dict(every)
            assert [s for _, s in got] == sorted((s for _, s in every), reverse=True)[:k]
            assert len({tuple(ids.tolist()) for ids, _ in got}) == len(got)
            for ids, s in got:
                assert scores[tuple(ids.tolist())] == s and coder.decode(ids) == text
    assert coder.encode_all([], k) == []


@pytest.mark.parametrize("size", [1, 3, 16])
def test_blocks_of_a_text_hold_its_words(signs_vocabulary, monkeypatch, size):
    rng = random.Random(size)
    coder = pieces.Encoder(signs_vocabulary)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", size)
    for _ in range(300):
        text = "".join(rng.choice("ab²,.(_▁   é\n") for _ in range(rng.randint(0, 60)))
        blocks = list(coder.blocks(text))
        assert [w for words in blocks for w in words] == coder.split(text)
        assert not any(pieces._BREAK.search("".join(words), size) for words in blocks)


def test_memory_of_many_groups_is_bounded(small_vocabulary):
    rng = random.Random(5)
    coder = pieces.Encoder(small_vocabulary)
    rest, peaks = [" ".join(["abc"] * 250_000)], []     # and one long text
    gc.collect()
    gc.disable()        # what a group leaves goes without the collector, which numpy's arrays seldom start
    tracemalloc.start()
    try:
        for _ in range(6):
            texts = [" ".join("".join(rng.choices("abc", k=11)) for _ in range(400)) for _ in range(200)] + rest
            rest = []
            tracemalloc.reset_peak()
            coded = coder.encode_all(texts, 2)
            peaks.append(tracemalloc.get_traced_memory()[1] / 2 ** 20)
            assert [coder.decode(x[0][0]) for x in coded] == texts
            del coded
    finally:
        tracemalloc.stop()
        gc.enable()
    assert max(peaks) < 65, peaks     # 91 with the words of earlier groups


def test_trie_knows_every_piece(signs_vocabulary, small_vocabulary):
    for v in (signs_vocabulary, small_vocabulary, pieces.Vocabulary.read(pieces.MODEL)):
        trie = pieces.Trie(v)
        for piece, (i, score) in list(v.pieces.items())[::37]:
            state = np.zeros(1, dtype=np.int64)
            for c in piece:
                on, state = trie.step(state, trie.letter[[ord(c)]])
                assert len(on) == 1
            assert trie.id[state] == i and trie.score[state] == score
            assert not len(trie.step(state, np.zeros(1, dtype=np.int32))[0])


def test_toxicity_sample_is_bounded_though_ids_repeat(spark):
    docs = [(1, f"text {i}") for i in range(400)] + [(i, f"own {i}") for i in range(2, 60)] + [(2, "own 2")] * 30
    labels = [(i, i % 2) for i in range(1, 60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", 100)
    assert got.count() == 100
    whole = [r.text for r in toxicity.labelled(docs, labels, "doc_id", "text", "toxic", 10_000).collect()]
    assert len(whole) == len(set(whole)) > 400


def test_toxicity_hits_outside_many_exceptions():
    lexicon = toxicity.Lexicon({" bad ": 2.0}, [" bad apple ", " not bad "], [0.0] * 4)
    text = toxicity.fold("bad apple not bad " * 20000 + "bad luck")
    assert list(toxicity.hits(lexicon.automaton(), text).values()) == [2.0]
