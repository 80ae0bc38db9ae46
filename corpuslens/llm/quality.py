"""Quality by a weak-label model.

Heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns (as many rows as patterns, not
documents) estimates without labels how often each labeller is right. Posterior
labels of a bounded sample then train a linear scorer of hashed features,
which scores every document, also where the labellers are silent.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import text_of
from corpuslens.llm.linear import fit_sparse, sigmoid
from corpuslens.sources.store import write_table

SAMPLE_ROWS = 20_000    # documents the scorer is fitted on
DIM = 1 << 13           # hashed features

GOOD, BAD, SILENT = 1, 0, 2

#: Measure, and the values up to which it votes good and from which it votes bad.
LABELLERS = [
    ("symbols", 0.01, 0.05),        # share of characters that are neither letters, digits, spaces nor punctuation
    ("capitals", 0.15, 0.5),        # share of letters that are capitals
    ("shouts", 0.05, 0.3),          # exclamation marks per word
    ("wordless", 0.05, 0.2),        # share of words without a letter or digit
    ("commonest", 0.12, 0.25),      # share of the commonest word
    ("repeats", 0.45, 0.7),         # share of words that occurred before, beyond what the length explains
    ("run_on", 0.05, 0.3),          # share of words equal to the word before
    ("same_lines", 0.2, 0.5),       # share of lines that occurred before
]


class _Shapes(dict):
    """Characters by kind: capital A, letter a, digit 0, space; punctuation and signs stay."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        out = ("A" if kind == "Lu" else "a" if kind[0] in "LM" else "0" if kind[0] == "N"
               else " " if kind[0] in "ZC" else chr(code))
        self[code] = out
        return out


SHAPES = _Shapes()
_RUN = re.compile(r"(.)\1+", re.S)
_MANY, _SOME = 20, 8    # words (or letters) from which shares say something; words from which repetition at once does


def _measure(text: str) -> tuple[dict[str, float], Counter, int]:
    words = text.split()
    n = len(words)
    if not n:
        return {}, Counter(), 0
    shape = text.translate(SHAPES)
    size = len(shape)
    space, letters, capitals = shape.count(" "), shape.count("a"), shape.count("A")
    plain = space + letters + capitals + shape.count("0") + sum(shape.count(c) for c in ".,;:!?'\"()-")
    shapes = Counter(_RUN.sub(r"\1", shape).split())
    found = {"symbols": (size - plain) / max(1, size - space),
             "shouts": shape.count("!") / n,
             "wordless": sum(c for s, c in shapes.items() if not ("a" in s or "A" in s or "0" in s)) / n}
    if letters + capitals >= _MANY:
        found["capitals"] = capitals / (letters + capitals)
    if n >= _MANY:
        counts = Counter(words)
        found["commonest"] = max(counts.values()) / n
        # natural text has about n ** 0.8 different words or more; share of that which is missing
        found["repeats"] = max(0.0, 1.0 - len(counts) / n ** 0.8)
    if n >= _SOME:
        found["run_on"] = sum(map(str.__eq__, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) >= 4:
        found["same_lines"] = 1.0 - len(set(lines)) / len(lines)
    return found, shapes, n


def votes(found: dict[str, float]) -> list[int]:
    return [SILENT if name not in found else GOOD if found[name] <= good else BAD if found[name] >= bad else SILENT
            for name, good, bad in LABELLERS]


def _bucket(name: str) -> int:
    return 1 + xxhash.xxh3_64_intdigest(name) % (DIM - 1)


def features(found: dict[str, float], shapes: Counter, n: int, buckets: dict[str, int]) -> dict[int, float]:
    """Hashed features of one text: the share of each word shape, and each measure in steps."""
    out: dict[int, float] = {0: 1.0}

    def add(name: str, value: float) -> None:
        at = buckets.get(name)
        if at is None:
            if len(buckets) > 200_000:
                buckets.clear()
            at = buckets[name] = _bucket(name)
        out[at] = out.get(at, 0.0) + value

    for s, c in shapes.items():
        add(f"w {s}", (c / n) ** 0.5)
    for name, value in found.items():
        add(f"m {name} {min(20, int(value * 20))}", 1.0)
    add(f"n {min(12, n.bit_length())}", 0.3)
    return out


class Model(NamedTuple):
    shares: np.ndarray      # of the classes: good, then bad by each labeller's fault
    bad: np.ndarray         # classes x labellers: probability that a vote is bad
    weights: np.ndarray     # of hashed features

    def memberships(self, patterns: np.ndarray) -> np.ndarray:
        """Patterns x classes: posterior probabilities. A silent labeller says nothing."""
        like = np.log(self.shares)[None] + (patterns == BAD) @ np.log(self.bad).T \
            + (patterns == GOOD) @ np.log1p(-self.bad).T
        like = np.exp(like - like.max(axis=1, keepdims=True))
        return like / like.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self.memberships(patterns)[:, 0]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, held: float = 0.01,
             trust: float = 5.0) -> Model:
    """Class shares and vote probabilities of each labeller, by expectation maximisation.

    A labeller looks for one fault, and a bad document passes the labellers of other faults. So bad documents are a
    class per fault, within which votes are taken as independent: its labeller starts as nine times in ten right,
    the others as seldom alarmed, and all as hardly ever alarmed by good documents. Every class of faults gets
    ``held`` of the documents as prior counts of that kind, so that a labeller that never votes keeps its start; the
    good class gets ``trust`` times the documents, since otherwise it could take in a fault that one labeller sees.
    """
    m = patterns.shape[1]
    start = np.full((m + 1, m), 0.1)
    start[0] = 0.005
    start[np.arange(1, m + 1), np.arange(m)] = 0.9
    shares = np.concatenate([[0.8], np.full(m, 0.2 / m)])
    model, total = Model(shares, start, np.zeros(0)), max(float(counts.sum()), 1.0)
    is_bad, votes_cast = patterns == BAD, patterns != SILENT
    prior = np.concatenate([[trust], np.full(m, held)])[:, None] * total
    for _ in range(rounds):
        weight = model.memberships(patterns) * counts[:, None]
        shares = weight.sum(axis=0) + 1.0
        bad = (weight.T @ is_bad + prior * start) / (weight.T @ votes_cast + prior)
        moved = np.abs(bad - model.bad).max()
        model = Model(shares / shares.sum(), bad, model.weights)
        if moved < 1e-9:
            break
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Vote counts over all documents; the scorer on the ``sample_rows`` documents with the smallest hashes."""
    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                found, _, n = _measure(text)
                if n:
                    seen[bytes(votes(found))] += 1
        yield pd.DataFrame({"pattern": list(seen), "n": list(seen.values())})

    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    # at most 3 ** labellers rows
    found = (texts.select("text").mapInPandas(count, "pattern binary, n long")
             .groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect())
    if not found:
        return Model(np.ones(1), np.full((1, len(LABELLERS)), 0.5), np.zeros(DIM))
    patterns = np.array([list(r.pattern) for r in found])
    model = estimate(patterns, np.array([r.n for r in found], dtype=float))
    # a bounded table of hashes; documents that share the last hash with others come along
    order = F.xxhash64(F.lit("quality"), F.col("_id").cast("string"))
    ends = texts.select(order.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]

    def describe(batches):
        buckets: dict[str, int] = {}
        for b in batches:
            rows = [_measure(t) for t in b["text"]]
            rows = [r for r in rows if r[2]]
            x = [features(*r, buckets) for r in rows]
            yield pd.DataFrame({"pattern": [bytes(votes(r[0])) for r in rows],
                                "i": [np.array(list(f), dtype=np.int64) for f in x],
                                "v": [np.array(list(f.values())) for f in x]})

    rows = (texts.filter(order <= F.lit(ends)).select("text")
            .mapInPandas(describe, "pattern binary, i array<long>, v array<double>").limit(sample_rows).collect())
    good = model.posterior(np.array([list(r.pattern) for r in rows]).reshape(len(rows), len(LABELLERS)))
    weights = fit_sparse([(np.array(r.i), np.array(r.v)) for r in rows], good, DIM)
    return model._replace(weights=weights)


def score(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1, higher is better), votes_bad and kept; other columns pass through.

    Whole texts are scored. A text without words has no features and is not kept, with a score of 0. Columns named
    score, votes_bad or kept are replaced.
    """
    weights = model.weights

    @F.pandas_udf("score double, votes_bad int")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        buckets: dict[str, int] = {}
        for texts in batches:
            scores, bad = [], []
            for text in texts:
                found, shapes, n = _measure(text)
                bad.append(votes(found).count(BAD) if n else 0)
                z = sum(weights[i] * v for i, v in features(found, shapes, n, buckets).items()) if n else -np.inf
                scores.append(float(sigmoid(np.float64(z))) if n else 0.0)
            yield pd.DataFrame({"score": scores, "votes_bad": np.array(bad, dtype=np.int32)})

    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "votes_bad", "kept")]
    scored = docs.select(F.struct(*names).alias("_row"), apply(text_of(f"`{text_col}`")).alias("_s"))
    return scored.select("_row.*", "_s.*").withColumn("kept", F.col("score") >= at_least)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """Fit on ``docs`` and score them. A null text counts as empty; repeated rows and ids are rows like others; an
    empty table gives no rows."""
    return score(docs, fit(docs, id_col, text_col), text_col, at_least)
