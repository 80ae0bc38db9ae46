"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digits or signs that stand for
letters, and makes everything else a space. Entries are whole words or
beginnings of words; their weights are log ratios of how often they occur in
toxic and in other training texts. Phrases that hold a hit but occur only in
texts that are not toxic are exceptions. A text's hits, alone and over its
length, go through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import remainder, text_of
from corpuslens.llm.linear import fit_dense, sigmoid
from corpuslens.sources.store import write_table

TRAIN_ROWS = 20_000     # labelled documents the lexicon is learned from
BROADCAST_ROWS = 1_000_000
ENTRIES = 4_000         # entries kept, by strength of evidence
PER_TEXT = 5            # uses of an entry that count in one text, so that no text speaks for many
STARTS = range(3, 9)    # lengths of beginnings of words

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "α": "a", "ε": "e", "ο": "o",
    "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class Fold(dict):
    """Translation table of folding, filled as characters are met."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in STAND_INS:
            out = STAND_INS[c]
        else:
            low = unicodedata.normalize("NFKC", c).lower()
            low = LOOK_ALIKES.get(low, low)
            category = unicodedata.category(c)
            if category in ("Mn", "Cf"):        # joined marks and invisible signs
                out = None
            else:
                out = "".join(x for x in low if x.isalpha()) or " "
        self[code] = out
        return out


FOLD = Fold()


def fold(text: str | None) -> str:
    return " " + " ".join((text or "").translate(FOLD).split()) + " "


class Lexicon(NamedTuple):
    weights: dict[str, float]   # " word " or " beginning"
    exceptions: list[str]       # " two words "
    curve: list[float]          # intercept and factors of ``measures``

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def hits(automaton, folded: str) -> dict[int, float]:
    """Weight of the best entry at each word that has one and is not in an exception."""
    if not len(automaton):
        return {}
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            spared.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    at = sorted(best) if spared else []
    for start, end in spared:
        for k in range(bisect_left(at, start), bisect_left(at, end)):
            best.pop(at[k], None)
    return best


def measures(found: dict[int, float], n_words: int) -> list[float]:
    total = sum(found.values())
    return [np.log1p(total), total / (n_words + 10.0), max(found.values(), default=0.0)]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
             train_rows: int) -> DataFrame:
    """(text, y) of at most ``train_rows`` labelled training rows, those with the smallest hashes of id and text.

    A row that repeats an id and its text counts once; a repeated label counts as toxic if any is. Rows meet their
    labels by id and a hash of the text; texts come only to those taken.
    """
    train = labels.filter(F.col(label_col).isNotNull() & (remainder(F.col(id_col), 5) != 0))
    known = train.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    text = text_of(text_col)
    taken = (docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t")).join(known, "_id").distinct()
             .orderBy(F.xxhash64("_id", "_t"), "_id", "_t").limit(train_rows))
    taken = write_table(taken, "toxic-rows")
    if train_rows <= BROADCAST_ROWS:    # three numbers a row
        taken = F.broadcast(taken)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), text.alias("text"))
    met = rows.join(taken, ["_id", "_t"]).groupBy("_id", "_t").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    return write_table(met.select("text", "y"), "toxic-sample")


def _features(folded: str):
    for word in folded.split():
        yield f" {word} "
        for n in STARTS:
            if len(word) >= n:
                yield f" {word[:n]}"


def learn(sample: DataFrame, entries: int = ENTRIES, min_docs: int = 4, min_weight: float = 1.0,
          min_evidence: float = 30.0) -> Lexicon:
    """Lexicon and curve from (text, y); counts are summed per partition before they are shuffled.

    ``min_evidence`` is the least toxic count times weight of an entry; chance alone rarely reaches it.
    """
    def count(batches):
        uses, docs, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                found = {f: min(n, PER_TEXT) for f, n in Counter(_features(fold(text))).items()}
                uses[y].update(found)
                docs[y].update(found.keys())
                total[y] += sum(n for f, n in found.items() if f[-1] == " ")
        rows = [("", total[1], total[0], 0)]
        rows += [(f, uses[1][f], uses[0][f], docs[1][f]) for f in docs[1]]
        # entries must occur in toxic texts; the rest of the clean counts is needed only where another part has them
        rows += [(f, 0, n, 0) for f, n in uses[0].items() if f not in docs[1]]
        yield pd.DataFrame(rows, columns=["f", "toxic", "clean", "docs"])

    counts = (sample.mapInPandas(count, "f string, toxic long, clean long, docs long").groupBy("f")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("docs").alias("docs")))
    counts = write_table(counts.filter((F.col("docs") >= min_docs) | (F.col("f") == "")), "toxic-counts")
    whole = counts.filter("f = ''").first()
    if whole is None or not whole.toxic or not whole.clean:
        share = 0.0 if whole is None or not whole.toxic else 1.0
        return Lexicon({}, [], [35.0 if share else -35.0, 0.0, 0.0, 0.0])
    weight = (F.log((F.col("toxic") + 0.5) / F.lit(whole.toxic + 1.0))
              - F.log((F.col("clean") + 0.5) / F.lit(whole.clean + 1.0)))
    strength = F.col("toxic") * F.col("w")
    found = (counts.filter("f <> ''").withColumn("w", weight).filter((F.col("w") >= min_weight) & (strength >= min_evidence))
             .orderBy(strength.desc(), "f").limit(entries).select("f", "w").collect())
    lexicon = Lexicon({r.f: float(r.w) for r in found}, [], [])

    def phrases(batches):
        automaton, seen = lexicon.automaton(), Counter()
        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                folded = fold(text)
                own = set()
                for at in hits(automaton, folded):
                    end = folded.index(" ", at + 1)
                    if at:
                        own.add(folded[folded.rindex(" ", 0, at):end + 1])
                    after = folded.find(" ", end + 1)
                    if after > 0:
                        own.add(folded[at:after + 1])
                seen.update((p, int(y)) for p in own)
        yield pd.DataFrame([(p, y, n) for (p, y), n in seen.items()], columns=["p", "y", "n"])

    spared = (sample.mapInPandas(phrases, "p string, y int, n long").groupBy("p")
              .agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"),
                   F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"))
              .filter("clean >= 5 AND toxic = 0").orderBy(F.desc("clean"), "p").limit(entries).collect())
    lexicon = lexicon._replace(exceptions=[r.p for r in spared])

    def measure(batches):
        automaton = lexicon.automaton()
        for b in batches:
            folded = [fold(t) for t in b["text"]]
            yield pd.DataFrame({"x": [measures(hits(automaton, t), t.count(" ") - 1) for t in folded], "y": b["y"]})

    rows = sample.mapInPandas(measure, "x array<double>, y int").collect()
    curve = fit_dense(np.array([r.x for r in rows]), np.array([r.y for r in rows], dtype=float))
    return lexicon._replace(curve=curve.tolist())


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted and n_hits, from whole texts; null counts as empty.

    Columns of those names are replaced.
    """
    @F.pandas_udf("score double, predicted int, n_hits long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for texts in batches:
            found, x = [], []
            for text in texts:
                folded = fold(text)
                got = hits(automaton, folded)
                found.append(len(got))
                x.append(measures(got, folded.count(" ") - 1))
            s = sigmoid(curve[0] + np.array(x).reshape(len(texts), len(curve) - 1) @ curve[1:])
            yield pd.DataFrame({"score": s, "predicted": (s >= 0.5).astype(np.int32),
                                "n_hits": np.array(found, dtype=np.int64)})

    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted", "n_hits")]
    scored = docs.select(F.struct(*names).alias("_row"), apply(text_of(f"`{text_col}`")).alias("_s"))
    return scored.select("_row.*", "_s.*")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every document; learn from labelled rows whose crc32(id as text) mod 5 is not 0.

    Without labels of both kinds every document scores near 0 (or near 1, if all labels are toxic). Null labels are
    not used. An empty table gives no rows; repeated rows are scored alike.
    """
    lexicon = learn(labelled(docs, labels, id_col, text_col, label_col, train_rows))
    return (score(docs, lexicon, text_col)
            .withColumn("held_out", remainder(F.col(id_col), 5) == 0))
