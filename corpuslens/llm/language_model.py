"""Language-model scores by a weighted backoff automaton.

The model is a bigram model with Dirichlet smoothing. As an automaton, a state
is the last token; an arc is a bigram seen in training, with its smoothed log
probability; a state's failure arc carries its backoff weight to the root,
whose arcs are the smoothed unigrams. A text is one path from left to right.

The automaton of the whole corpus never exists in one place. Texts are cut
into blocks; a block asks for the counts of the tokens and bigrams it holds,
packed by ranges of their hashes; a range adds up what all blocks report and
answers each block; a block then has the part of the automaton its own texts
can walk. Memory follows the block, and no token is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import partitions, remainder, text_of
from corpuslens.llm.minhash import GOLDEN, mixed
from corpuslens.sources.store import write_table

BLOCK_BYTES = 8 << 20       # text in a block; a longer text is a block of its own
SMOOTHING = 200.0           # weight of the unigrams in a state, in tokens
END = b""                   # the end token: no word is empty


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T if len(flat) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, len(data) // size)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(hashes: np.ndarray) -> bytes:
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def encode_blocks(docs: DataFrame, id_col: str, text_col: str, held_out, block_bytes: int) -> DataFrame:
    """A row per block: its documents, and its tokens as numbers of the block's own vocabulary (0 is the end)."""
    def encode(batches):
        part, made = TaskContext.get().partitionId(), 0
        vocabulary: dict[bytes, int] = {END: 0}
        ids, held, lengths, tokens, size = [], [], [], [], 0

        def block():
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))
            return pd.DataFrame([{"block": (part << 24) + made, "ids": ids, "held": held,
                                  "lengths": pack(np.array(lengths, dtype=np.int64)),
                                  "tokens": pack(np.concatenate(tokens)), "vocabulary": hashes.tobytes()}])

        for b in batches:
            for doc, h, text in zip(b["id"], b["held"], b["text"]):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                number = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                number.append(0)
                ids.append(doc)
                held.append(bool(h))
                lengths.append(len(number))
                tokens.append(np.array(number, dtype=np.int32))
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    made += 1
                    vocabulary = {END: 0}
                    ids, held, lengths, tokens, size = [], [], [], [], 0
        if ids:
            yield block()

    # ids travel as strings: pandas has no integers with nulls
    rows = docs.select(F.col(id_col).cast("string").alias("id"), held_out.alias("held"),
                       text_of(text_col).alias("text"))
    return rows.mapInPandas(encode, "block long, ids array<string>, held array<boolean>, lengths binary, "
                                    "tokens binary, vocabulary binary")


class Block:
    """Tokens, bigrams and their hashes of one block, in the order of their hashes."""

    def __init__(self, row):
        self.lengths = unpack(row["lengths"], np.int64)
        self.tokens = unpack(row["tokens"], np.int32).astype(np.int64)
        self.train = np.repeat(~np.asarray(row["held"], dtype=bool), self.lengths)
        hashes = np.frombuffer(row["vocabulary"], dtype=np.uint64)
        order = np.argsort(hashes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.hashes = hashes[order]             # of tokens
        self.end = int(rank[0])
        self.tokens = rank[self.tokens]
        # a text begins in the state after an end
        self.before = np.concatenate([[self.end], self.tokens[:-1]])
        keys, inverse = np.unique(self.before * len(order) + self.tokens, return_inverse=True)
        pair = mixed(self.hashes[keys // len(order)] * np.uint64(GOLDEN) + self.hashes[keys % len(order)])
        order = np.argsort(pair)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pairs = pair[order]                # of bigrams
        self.pair = rank[inverse]               # bigram at each token


def ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, hashes and training counts of tokens and bigrams) for every range of hashes."""
    def report(batches):
        for b in batches:
            for _, row in b.iterrows():
                k = Block(row)
                parts = {}
                for name, hashes, at in (("token", k.hashes, k.tokens), ("pair", k.pairs, k.pair)):
                    counts = np.bincount(at[k.train], minlength=len(hashes)).astype(np.uint32)
                    edges = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                    parts[name] = [(pack_sorted(hashes[i:j]), pack(counts[i:j]))
                                   for i, j in zip(edges[:-1], edges[1:])]
                yield pd.DataFrame({
                    "bucket": np.arange(buckets, dtype=np.int32), "block": row["block"],
                    "tokens": [p[0] for p in parts["token"]], "token_counts": [p[1] for p in parts["token"]],
                    "pairs": [p[0] for p in parts["pair"]], "pair_counts": [p[1] for p in parts["pair"]]})

    return blocks.mapInPandas(report, "bucket int, block long, tokens binary, token_counts binary, "
                                      "pairs binary, pair_counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """(bucket, block, totals) in the order asked; block -1 holds the range's token and type counts."""
    def totals(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[bytes], int, int]:
        if not hashes:
            return [], 0, 0
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        summed = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        return ([pack(x) for x in np.split(summed[inverse], ends)], int(summed.sum()), int((summed > 0).sum()))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        token, n, types = totals([unpack_sorted(x) for x in pdf["tokens"]],
                                 [unpack(x, np.uint32) for x in pdf["token_counts"]])
        pair, _, _ = totals([unpack_sorted(x) for x in pdf["pairs"]],
                            [unpack(x, np.uint32) for x in pdf["pair_counts"]])
        out = pd.DataFrame({"bucket": key[0], "block": pdf["block"], "tokens": token, "pairs": pair,
                            "n": 0, "types": 0})
        return pd.concat([out, pd.DataFrame([{"bucket": key[0], "block": -1, "tokens": b"", "pairs": b"",
                                              "n": n, "types": types}])])

    return asked.groupBy("bucket").applyInPandas(
        add, "bucket int, block long, tokens binary, pairs binary, n long, types long")


def walk(k: Block, token_counts: np.ndarray, pair_counts: np.ndarray, n: int, types: int,
         smoothing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: log10 probability on the path, log10 probability at the root, and whether it is known."""
    root = np.log10((token_counts + 1.0) / (n + types + 1.0))
    failure = np.log10(smoothing / (token_counts + smoothing))
    state, arc = k.before, pair_counts[k.pair]
    seen = np.log10((arc + smoothing * 10.0 ** root[k.tokens]) / (token_counts[state] + smoothing))
    return np.where(arc > 0, seen, failure[state] + root[k.tokens]), root[k.tokens], token_counts[k.tokens] > 0


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", smoothing: float = SMOOTHING,
          block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the documents that ``held_out`` does not select. Tokens are runs of non-space characters with A-Z
    lower-cased, then one end. A token v is followed by w with probability (c(v, w) + s * p(w)) / (c(v) + s), where
    p(w) = (c(w) + 1) / (N + V + 1) also covers an unknown word and s is ``smoothing``; texts start after an end.
    ``base_score`` sums log10 p(w), ``score`` the model's log10 probabilities. A null text is empty and scores its
    end; null and repeated ids are rows like others; an empty table gives no rows. Without training documents every
    token has probability 1. ``buckets`` ranges of hashes share the counts (default: the shuffle partitions).
    """
    buckets = buckets or partitions(docs.sparkSession)
    blocks = write_table(encode_blocks(docs, id_col, text_col, held_out, block_bytes), "lm-blocks")
    answers = write_table(answer(ask(blocks, buckets)), "lm-counts")
    whole = answers.filter("block = -1").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).first()
    n, types = whole.n or 0, whole.types or 0

    def apply(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        found = found.sort_values("a_bucket")
        for _, row in rows.iterrows():
            k = Block(row)
            token_counts = np.concatenate([unpack(x, np.int64) for x in found["a_tokens"]])
            pair_counts = np.concatenate([unpack(x, np.int64) for x in found["a_pairs"]])
            path, base, known = walk(k, token_counts, pair_counts, n, types, smoothing)
            starts = np.concatenate([[0], np.cumsum(k.lengths)[:-1]])
            out.append(pd.DataFrame({
                "id": row["ids"], "held_out": row["held"], "n_tokens": k.lengths,
                "n_known": np.add.reduceat(known.astype(np.int64), starts), "train_tokens": n,
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(path, starts)}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: [] for c in ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    replies = answers.filter("block >= 0").select(
        F.col("block").alias("a_block"), F.col("bucket").alias("a_bucket"), F.col("tokens").alias("a_tokens"),
        F.col("pairs").alias("a_pairs"))
    return blocks.groupBy("block").cogroup(replies.groupBy("a_block")).applyInPandas(
        apply, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double").select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out",
                                      "n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out_seventh(id_col: str = "doc_id"):
    return remainder(F.col(id_col), 7) == 2
