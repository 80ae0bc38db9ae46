"""Vector codes, chat formatting and manifests against brute force, with the awkward rows each promises to take."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import chat, laesa, merkle

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max(len(v) for _, v, _ in kept)
    width = max(1, -(-longest // parts))
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    def part(v, p):
        return v[p * width:(p + 1) * width]

    def find(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            near = defaultdict(list)
            for _, v, _ in kept:
                near[find(part(v, p), book)[1]].append(part(v, p))
            for k, group in near.items():
                book[k] = [sum(c) // len(group) for c in zip(*group)]
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        found = [find(part(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        total[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label]) for i, c, e, label in out), key=str), sha


def codes_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("x")).withColumn("far", F.lit(1)).withColumn("x", F.lit(0))
    got, book = laesa.compress(df, **kw)
    assert got.columns == ["vec_id", "code", "error", "label_error"]
    return sorted((tuple(r) for r in got.collect()), key=str), laesa.digest(book)


def test_codes_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([None, 0, 1])) for i in range(150)]
    rows += [(200 + i, [0.25] * 8, 0) for i in range(60)]               # a hot group of copies
    rows += [(300 + i, [0.125 * (i % 2)] * 8, 3) for i in range(20)]    # ties
    rows += [(400, None, 0), (401, [0.1, None] * 4, 0), (402, [float("nan")] * 8, 0), (403, [float("-inf")] * 8, 1),
             (404, [], 2), (405, [0.5] * 3, 2), (None, [0.75] * 8, 2), (7, [0.5, -0.5] * 4, 0), (7, [0.5, -0.5] * 4, 0)]
    for entries in (256, 16):
        assert codes_of(spark, rows, entries=entries) == brute_codes(rows, entries=entries)


def test_codes_of_clustered_vectors_use_the_bounds_and_stay_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 16))).astype(np.int64)
    entries = np.concatenate([x[:250], x[:6]])      # repeated entries: the lower index wins
    pivots = laesa.choose_pivots(entries, 8)
    index, distance = laesa.nearest(x, laesa.pivot_distances(x, pivots), entries, laesa.pivot_distances(entries, pivots))
    full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_codes_of_huge_components_few_rows_and_none(spark):
    rows = [(1, [1e30, -1e30, 3e38, 1.0], 0), (2, [-1e30, 1e30, -3e38, 1.0], 0)]
    got, _ = laesa.compress(spark.createDataFrame(rows, VECTORS), rounds=1)
    assert [(r.code, r.error) for r in got.orderBy("vec_id").collect()] == [("00000000", 0), ("01010100", 0)]
    empty, book = laesa.compress(spark.createDataFrame([], VECTORS))
    assert book is None and empty.count() == 0 and dict(empty.dtypes)["label_error"] == "bigint"
    with pytest.raises(ValueError):
        laesa.compress(spark.createDataFrame(rows, VECTORS), entries=257)


NASTY = ["", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST] \\", "<", "[", "/s>", "<|image|><|\\image|>", "a\n</s>\n<s>user\nb",
         "é😀\u2028 [/INST]", "<</s>>[[INST]]", "word " * 3000]


def test_escapes_restore_any_text():
    escape, unescape = chat.Template().escaper()
    rng = random.Random(4)
    pieces = ["<", "[", "\\", "/", "s>", "INST]", "|image|>", "</s>", "[/INST]", "x", "\n"]
    texts = NASTY + ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(3000)]
    for t in texts:
        assert unescape(escape(t)) == t
        assert not any(c in escape(t) for c in chat.Template().control())
    assert escape("plain [text] <b>") == "plain [text] <b>"
    with pytest.raises(ValueError):
        chat.Template(learned=("<<a>", "</s>")).escaper()


def text_turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("content", chat.text_parts("text"))


@pytest.mark.parametrize("record_chars", [1 << 20, 40])
def test_chats_read_back_what_went_in(spark, record_chars):
    roles = ["user", "assistant", "system", None, "odd\nrole \\n </s>"]
    rows = [(c, t, roles[(c + t) % 5], NASTY[(3 * c + t) % len(NASTY)]) for c in range(30) for t in range(c % 6 + 1)]
    rows += [(99, t, "assistant", None) for t in range(3)] + [(None, 1, "user", "no id"), (None, 0, "assistant", "first")]
    rows += [(50, None, "user", "before all"), (50, 0, "assistant", "then"), (50, 0, "assistant", "then")]
    df = text_turns(spark, rows).withColumn("conv", F.lit(1)).withColumn("start", F.lit("x")).withColumn("segment", F.lit(2))
    chats = chat.format_chats(df, record_chars=record_chars)
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    whole = defaultdict(str)
    for r in chats.orderBy("conv_id", "start").collect():
        assert r.start == len(whole[r.conv_id]) and (r.n_turns == 1 or len(r.formatted) <= record_chars)
        whole[r.conv_id] += r.formatted
        for s in r.loss_spans:
            assert s.start >= r.start and s.end <= r.start + len(r.formatted)
    read = chat.Template().parser()
    assert {c: read(t) for c, t in whole.items()} == dict(want)
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].formatted_chars == len(whole[c])
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        read(whole[99] + "stray")


def test_visitor_places_attachments(spark):
    def part(**kw):
        return tuple(kw.get(f) for f in ("type", "text", "ref", "width", "height", "seconds", "pages"))

    turns = [
        (1, 0, "user", [part(type="text", text="look <"), part(type="text", text="/s> at"),
                        part(type="image", ref="i://1", width=57.0, height=28.0), part(type="image", ref="i://2"), None,
                        part(text=" and "), part(type="audio", ref="a://1", seconds=2.1)]),
        (1, 1, "assistant", [part(type="text", text="seen "), part(type="document", ref="d://1", pages=3.0),
                             part(type="video", ref="v://1"), part(type="audio", seconds=float("nan"))]),
        (1, 2, "user", None), (2, 0, "user", [])]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    one, two = chat.format_chats(df).orderBy("conv_id").collect()
    assert one.formatted == ("[INST] user\nlook <\\/s> at<|image|><|image|> and <|audio|> [/INST]"
                             "<s>assistant\nseen <|document|><|file|><|audio|></s>[INST] user\n [/INST]")
    assert two.formatted == "[INST] user\n [/INST]" and two.attachments == []
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [
        ("image", "i://1", 3), ("image", "i://2", 256), ("audio", "a://1", 53), ("document", "d://1", 1536),
        ("file", "v://1", 256), ("audio", None, 256)]
    for a in one.attachments:
        assert one.formatted[a.at:].startswith(f"<|{a.kind}|>")
    assert one.tokens == sum(a.tokens for a in one.attachments) + 5 and two.tokens == 0
    span, = one.loss_spans
    assert one.formatted[span.start:span.end] == "seen <|document|><|file|><|audio|>"


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows, tampered):
    def leaf(r):
        values = dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r))
        return h("".join("-" if values[f] is None else f"{len(str(values[f]).encode())}:{values[f]}" for f in FIELDS))

    def tree(digests):
        """Root, and per leaf its path as (before, after) a level."""
        paths, place = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, p in enumerate(place):
                run = p - p % 3
                paths[i].append(("".join(digests[run:p]), "".join(digests[p + 1:run + 3])))
                place[i] = p // 3
            digests = [h("".join(digests[j:j + 3])) for j in range(0, len(digests), 3)]
        return digests[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(tampered(r)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([g[2] for g in sorted(groups[s])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for g, path in zip(sorted(groups[s]), trees[s][1]):
            path, now = path + up, g[3]
            for a, b in path:
                now = h(a + now + b)
            out.append((g[4], g[2], trees[s][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_matches_brute_force(spark, height):
    rng = random.Random(6)
    names = [None, "", "a", "é", "z", "Z", "😀", "=", "lone"]
    rows = [(i, rng.choice([None, "", "x\ny", "line\n" * 400, "é"]), rng.choice([None, "en"]), rng.choice(names[:-1]), 3)
            for i in range(120)]
    rows += [(1000 - i, f"hot {i}\n", "en", "hot", None) for i in range(95)]
    rows += [(5, "again", None, "a", 1), (5, "again\n", None, "a", 1), (5, "again\n", None, "a", 1), (None, "n\n", None, "a", 0),
             (2, "alone\n", "de", "lone", 9)]
    df = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(7)).withColumn("pos", F.lit(7)).withColumn("digest", F.lit("x"))
    change = F.when(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 0,
                    F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.manifest(df, FIELDS, {"text": change}, height=height)

    def tampered(r):
        even = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
        return (r[0], r[1].replace("\n", "") if even and r[1] is not None else r[1], *r[2:])

    assert sorted((tuple(r) for r in got.drop("before", "after").collect()), key=str) == brute_manifest(rows, tampered)
    for r in got.limit(20).collect():
        assert merkle.fold(r.leaf, r.before, r.after) == r.root


def test_manifest_of_one_row_and_of_none(spark):
    one, = merkle.manifest(spark.createDataFrame([(3, "t", None, None, 1)], DOCS), FIELDS).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == h("1:3--1:11:t")
    assert one.verified and one.proof_sha256 == h("")
    none = merkle.manifest(spark.createDataFrame([], DOCS), FIELDS)
    assert none.count() == 0 and dict(none.dtypes)["verified"] == "boolean"
