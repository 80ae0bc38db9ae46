"""SentencePiece encoding and decoding with exact N-best segmentations.

A text is a lattice of vocabulary pieces. Forward Viterbi gives the best score
up to every position; those scores are exact heuristics for an A* search that
walks back from the end and meets the segmentations in order of score. No piece
reaches from one word into the next, or from a letter to a sign that follows
letters in no piece, so such parts are segmented apart and kept in a bounded
cache; only the parts with the smallest loss for their second choice can matter
to the N best of a text. The texts of a group are put together from the cache's
arrays at once and travel as Arrow arrays.

The vocabulary file gives pieces and their scores; this is the lattice
(maximum score) segmentation, for every kind of model file.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslens.llm.common import text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 150_000             # words kept per worker
GROUP_CHARS = 1 << 20       # text segmented at once
BLOCK_CHARS = 1 << 16       # text that is a list of words at once
LEARN_CHARS = 1 << 15       # of new words of one length, learnt at once
# Fixed value: what an unknown character costs beyond the worst piece.
UNKNOWN = 10.0
_NEVER = -float("inf")
_BREAK = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Vocabulary(NamedTuple):
    pieces: dict[str, tuple[int, float]]
    bytes: list[int]            # ids of the 256 byte pieces, or empty
    unknown: int                # id used where there are no byte pieces
    unknown_score: float
    longest: int
    crossing: bool              # whether a piece reaches from one word into the next

    @staticmethod
    def of(pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int = 0) -> Vocabulary:
        worst = min((s for _, s in pieces.values()), default=0.0)
        return Vocabulary(pieces, byte_ids, unknown, worst - UNKNOWN, max(map(len, pieces), default=1),
                          any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces))

    @staticmethod
    def read(path: str) -> Vocabulary:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[p] = (i, model.get_score(i))
        return Vocabulary.of(pieces, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [],
                             model.unk_id())

    def unknown_ids(self, character: str) -> list[int]:
        return [self.bytes[b] for b in _raw(character)] if self.bytes else [self.unknown]

    def names(self) -> dict[int, bytes]:
        """What each id decodes to, with spaces as they are in the text; other ids decode to nothing."""
        out = defaultdict(bytes, {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.pieces.items()})
        out.update({i: bytes([b]) for b, i in enumerate(self.bytes)})
        return out


class Lattice:
    """Arcs of one word and the best scores to and from every position."""

    def __init__(self, vocabulary: Vocabulary, word: str):
        self.n = n = len(word)
        self.arcs: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]  # by end: begin, ...
        pieces, longest = vocabulary.pieces, vocabulary.longest
        for i in range(n):
            known = False
            for j in range(i + 1, min(n, i + longest) + 1):
                got = pieces.get(word[i:j])
                if got is not None:
                    known = known or j == i + 1
                    self.arcs[j].append((i, got[1], (got[0],)))
            if not known:
                self.arcs[i + 1].append((i, vocabulary.unknown_score, tuple(vocabulary.unknown_ids(word[i]))))
        self.forward = [0.0] * (n + 1)
        self.back: list[tuple | None] = [None] * (n + 1)
        for j in range(1, n + 1):
            best = -float("inf")
            for arc in self.arcs[j]:
                s = self.forward[arc[0]] + arc[1]
                # ties go to the longer last piece
                if s > best or (s == best and arc[0] < self.back[j][0]):
                    best, self.back[j] = s, arc
            self.forward[j] = best

    def n_best(self, k: int) -> list[tuple[list[int], float]]:
        """The ``k`` best segmentations, best first, by A* from the end with the forward scores as heuristic."""
        heap = [(-self.forward[self.n], 0, self.n, 0.0, None)]
        pushed, out = 1, []
        while heap and len(out) < k:
            _, _, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((ids, done))
                continue
            # the arc of the best path goes first among equals, so the first answer is the Viterbi path
            for arc in sorted(self.arcs[at], key=lambda a: a is not self.back[at]):
                heapq.heappush(heap, (-(self.forward[arc[0]] + arc[1] + done), pushed, arc[0], done + arc[1],
                                      (arc[2], path)))
                pushed += 1
        return out


def _raw(character: str) -> bytes:
    """Bytes of a character; a space sign set apart by ``normal`` is itself again."""
    return SPACE.encode() if character == _ESCAPED else character.encode("utf-8", "surrogatepass")


_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ESCAPED = "\udfff"     # no text holds a lone surrogate: stands for a space sign that was in the text


def normal(text: str) -> str:
    """The text with a leading space, and spaces as space signs. A space sign in the text is set apart."""
    return SPACE + text.replace(SPACE, _ESCAPED).replace(" ", SPACE)


def word_pattern(vocabulary: Vocabulary) -> re.Pattern:
    """Words with the spaces before them, cut between a letter and an ASCII sign where no piece holds the two in this
    order; line ends and the like stand alone if no piece holds them."""
    before = defaultdict(set)
    for piece in vocabulary.pieces:
        for a, b in zip(SPACE + piece, piece):
            before[b].add(a)
    alone = re.escape("".join(c for c in "\n\t\r\x0b\x0c" + _ESCAPED if c not in before) or _ESCAPED)
    signs = [c for c in _SIGNS if not any(a.isascii() and a.isalnum() for a in before[c])]
    if not signs:
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]")
    joined_on = re.escape("".join(sorted({a for c in signs for a in before[c] if a.isalnum()})))
    sign, letter = f"[{re.escape(''.join(signs))}]", f"[^\\W_{joined_on}]"
    rest = f"[^{SPACE}{alone}{sign[1:]}"
    return re.compile(f"{SPACE}*+(?:{sign}*+{rest}++(?:(?<!{letter}){sign}++{rest}*+)*+|{sign}++)|{SPACE}+|[{alone}]")


class Trie:
    """The pieces as arrays: a walk advances many positions of many words by one character at a time."""

    def __init__(self, vocabulary: Vocabulary):
        children: list[dict[str, int]] = [{}]
        entry: list[tuple[int, float]] = [(-1, _NEVER)]
        for piece, found in vocabulary.pieces.items():
            at = 0
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    entry.append((-1, _NEVER))
                at = children[at][c]
            entry[at] = found
        letters = sorted({c for piece in vocabulary.pieces for c in piece})
        self.letter = np.zeros(0x110000, dtype=np.int32)      # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: i + 1 for i, c in enumerate(letters)}
        # a state's steps lie in one array, as far from the state's base as the letter's number; a slot has one owner
        width, steps = len(letters) + 1, len(children)
        used = bytearray(2 * (steps + width))
        self.base = np.zeros(steps, dtype=np.int64)
        owner, to = np.full(len(used), -1, dtype=np.int64), np.zeros(len(used), dtype=np.int64)
        for at in sorted((i for i, c in enumerate(children) if c), key=lambda i: -len(children[i])):
            marks = [number[c] for c in children[at]]
            slot = width + at * 2654435761 % (2 * steps)
            while True:
                slot = used.find(0, slot)
                base = slot - marks[0]
                if slot < 0 or base + width > len(used):        # no room: twice as long
                    more = bytearray(len(used))
                    used, slot = used + more, len(used)
                    owner, to = np.append(owner, np.full(len(more), -1)), np.append(to, np.zeros(len(more), dtype=np.int64))
                elif any(used[base + m] for m in marks):
                    slot += 1
                else:
                    break
            self.base[at] = base
            for m, next_ in zip(marks, children[at].values()):
                used[base + m], owner[base + m], to[base + m] = 1, at, next_
        self.owner, self.to = owner, to
        self.id = np.array([i for i, _ in entry], dtype=np.int32)
        self.score = np.array([s for _, s in entry])

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which go on, their states)"""
        at = self.base[state] + letter
        on = np.flatnonzero(self.owner[at] == state)
        return on, self.to[at[on]]


class Rows:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype=dtype), 0

    def add(self, more) -> None:
        n = self.n + len(more)
        if n > len(self.data):
            self.data = np.append(self.data[:self.n], np.zeros(n, dtype=self.data.dtype))
        self.data[self.n:n] = more
        self.n = n


def joined(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``begins``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Segments texts word by word; without ``ranked`` only the best segmentation can be asked for."""

    def __init__(self, vocabulary: Vocabulary, ranked: bool = True, cache: int = CACHE):
        self.vocabulary, self.ranked, self.limit = vocabulary, ranked, cache
        names = vocabulary.names()
        ordered = [names[i] for i in range(max(names, default=0) + 1)] + [b""]      # the last: ids without a name
        self.letters = np.frombuffer(b"".join(ordered) or b" ", dtype=np.uint8)
        self.sizes = np.array([len(n) for n in ordered], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.trie, self.pattern = Trie(vocabulary), word_pattern(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}         # their numbers, in the rows below
        self.choices: dict[tuple[str, int], list[tuple[list[int], float]]] = {}     # best segmentations of some
        self.ids, self.begin, self.size = Rows(np.int32), Rows(np.int64), Rows(np.int64)
        self.score, self.loss = Rows(float), Rows(float)        # loss of the second choice

    def keep(self, words: list[str], ids, sizes, scores, losses) -> None:
        self.words.update(zip(words, range(self.size.n, self.size.n + len(words))))
        self.begin.add(self.ids.n + np.cumsum(sizes) - sizes)
        for rows, more in ((self.ids, ids), (self.size, sizes), (self.score, scores), (self.loss, losses)):
            rows.add(more)

    def keep_one(self, word: str) -> None:
        """One word, for those that are long or hold unknown characters."""
        two = Lattice(self.vocabulary, word).n_best(2 if self.ranked else 1)
        loss = two[0][1] - two[1][1] if len(two) > 1 else -_NEVER
        self.keep([word], two[0][0], np.array([len(two[0][0])]), [two[0][1]], [loss])

    def learn(self, words) -> None:
        """Put new words into the cache, those of one length together."""
        by_length = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        for n, group in by_length.items():
            width = min(2048, max(64, LEARN_CHARS // n))
            for begin in range(0, len(group), width):
                self._learn(n, group[begin:begin + width])

    def _learn(self, n: int, words: list[str]) -> None:
        longest = min(self.vocabulary.longest, n)
        if n > 64 or not len(self.vocabulary.pieces):
            for w in words:
                self.keep_one(w)
            return
        m = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(m, n).T
        letter = self.trie.letter[np.ascontiguousarray(codes)].ravel()      # by position, then word
        score = np.full((longest, n, m), _NEVER)            # of the piece of a length that begins at a position
        ids = np.full((longest, n, m), -1, dtype=np.int32)
        at = np.arange(n * m)
        state = np.zeros(n * m, dtype=np.int64)
        for size in range(longest):
            on, state = self.trie.step(state, letter[at + size * m])
            at = at[on]
            score[size].reshape(-1)[at] = self.trie.score[state]
            ids[size].reshape(-1)[at] = self.trie.id[state]
            inside = np.flatnonzero(at < (n - size - 1) * m)
            at, state = at[inside], state[inside]
            if not len(at):
                longest = size + 1
                break
        plain = (ids[0] >= 0).all(axis=0)                   # every character is a piece
        forward, size_of = np.zeros((n + 1, m)), np.zeros((n + 1, m), dtype=np.int64)
        s, better = np.empty(m), np.empty(m, dtype=bool)
        for end in range(1, n + 1):
            best = forward[end]
            best[:] = _NEVER
            for size in range(min(longest, end), 0, -1):    # ties stay with the longer last piece
                np.add(forward[end - size], score[size - 1, end - size], out=s)
                np.greater(s, best, out=better)
                np.maximum(s, best, out=best)
                np.copyto(size_of[end], size, where=better)
        taken = np.full((n, m), -1, dtype=np.int32)         # id of the piece that begins at a position
        on_best = np.zeros((longest, n, m), dtype=bool)
        column, end = np.arange(m)[plain], np.full(int(plain.sum()), n)
        while len(column):
            size = size_of[end, column]
            end = end - size
            taken[end, column] = ids[size - 1, end, column]
            on_best[size - 1, end, column] = True
            column, end = column[end > 0], end[end > 0]
        loss = np.full(m, -_NEVER)
        if self.ranked:
            rest, second = np.full((n + 1, m), _NEVER), np.full(m, _NEVER)
            rest[n] = 0.0
            other = np.empty(m)                             # best from a position on, but for the best one's piece
            for i in range(n - 1, -1, -1):
                other[:] = _NEVER
                for size in range(1, min(longest, n - i) + 1):
                    np.add(score[size - 1, i], rest[i + size], out=s)
                    np.maximum(rest[i], s, out=rest[i])
                    np.putmask(s, on_best[size - 1, i], _NEVER)
                    np.maximum(other, s, out=other)
                np.maximum(second, forward[i] + other, out=second)
            loss[plain] = np.maximum(0.0, forward[n][plain] - second[plain])
        self.keep([w for w, ok in zip(words, plain.tolist()) if ok], taken.T[taken.T >= 0],
                  (taken >= 0).sum(axis=0)[plain], forward[n][plain], loss[plain])
        for i in np.flatnonzero(~plain).tolist():
            self.keep_one(words[i])

    def split(self, text: str) -> list[str]:
        whole = normal(text)
        return [whole] if self.vocabulary.crossing else self.pattern.findall(whole)

    def blocks(self, text: str) -> Iterator[list[str]]:
        """``split`` in lists of bounded size: no word goes on at a space that follows another character."""
        if self.vocabulary.crossing or len(text) < BLOCK_CHARS:
            yield self.split(text)
            return
        whole, begin = normal(text), 0
        while begin < len(whole):
            cut = _BREAK.search(whole, begin + BLOCK_CHARS)
            end = cut.start() if cut else len(whole)
            yield self.pattern.findall(whole, begin, end)
            begin = end

    def numbered(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, the number in that list of every word of the texts, words of each text)"""
        # numbered as they come; small, and so fast to search; it does not hold itself, and so goes with its words at once
        distinct: dict[str, int] = defaultdict(count().__next__)
        found, counts = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):        # of a word's occurrences only the number stays
            for words in self.blocks(text):
                found.append(np.fromiter(map(distinct.__getitem__, words), dtype=np.int32, count=len(words)))
                counts[i] += len(words)
        return list(distinct), np.concatenate(found), counts

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """The words' numbers in the cache, which learns those that are new."""
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > self.limit:
            self.forget()
            new = distinct
        self.learn(new)
        return np.fromiter(map(self.words.__getitem__, distinct), dtype=np.int64, count=len(distinct))

    def n_best(self, word: str, k: int) -> list[tuple[list[int], float]]:
        if (word, k) not in self.choices:
            self.choices[word, k] = Lattice(self.vocabulary, word).n_best(k)
        return self.choices[word, k]

    def encode(self, text: str, k: int = 1) -> list[tuple[np.ndarray, float]]:
        """The ``k`` best segmentations of the text, as ids and scores; fewer if there are fewer."""
        return self.encode_all([text], k)[0]

    def encode_all(self, texts: list[str], k: int = 1) -> list[list[tuple[np.ndarray, float]]]:
        """``encode`` of every text."""
        if not texts:
            return []
        words, found, counts = self.numbered(texts)
        number = self.numbers(words)[found]
        sizes, score, loss = self.size.data[number], self.score.data[number], self.loss.data[number]
        ids = self.ids.data[joined(self.begin.data[number], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes)])        # where a word's ids begin
        ends = np.cumsum(counts)
        begins = ends - counts
        if k == 2:      # the first word of those with the smallest loss
            least = np.flatnonzero(loss == np.repeat(np.minimum.reduceat(loss, begins), counts))
            least = least[np.searchsorted(least, begins)].tolist()
        out = []
        for i, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist())):
            best = ids[at[begin]:at[end]], sum(score[begin:end].tolist())
            # only the k - 1 words with the smallest losses can take another choice among the k best
            few = ([] if k <= 1 else [least[i]] if k == 2 else
                   heapq.nsmallest(k - 1, range(begin, end), loss.__getitem__))
            options = {w: self.n_best(words[found[w]], k) for w in few if loss[w] < -_NEVER}
            totals: list[tuple[float, dict[int, int]]] = [(best[1], {})]
            for w, choices in options.items():
                totals = sorted(((s + c[1] - choices[0][1], picked | ({w: n} if n else {}))
                                 for s, picked in totals for n, c in enumerate(choices)),
                                key=lambda t: (-t[0], sorted(t[1].items())))[:k]
            out.append([])
            for s, picked in totals:
                if not picked:
                    out[-1].append(best)
                    continue
                parts, done = [], at[begin]
                for w, n in sorted(picked.items()):
                    parts += [ids[done:at[w]], np.array(options[w][n][0], dtype=np.int32)]
                    done = at[w + 1]
                out[-1].append((np.concatenate([*parts, ids[done:at[end]]]), s))
        return out

    def decode(self, ids) -> str:
        """The text of the ids; unknown ids decode to nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.sizes) - 1), ids, len(self.sizes) - 1)
        raw = self.letters[joined(self.begins[ids], self.sizes[ids])].tobytes()
        text = raw.decode("utf-8", "surrogatepass" if b"\xed" in raw else "replace")
        return text[1:] if text.startswith(" ") else text


def encoder_for(parts: tuple, ranked: bool, name: str) -> Encoder:
    """The worker's encoder, kept from task to task in a module of its own: functions reach a worker as copies, and
    what belongs to them does not outlive a task."""
    kept = sys.modules.setdefault("_corpuslens_worker", types.ModuleType("_corpuslens_worker")).__dict__
    if kept.get("name") != (name, ranked):
        kept["name"], kept["encoder"] = (name, ranked), Encoder(Vocabulary(*parts), ranked)
    return kept["encoder"]


def encode(docs: DataFrame, vocabulary: Vocabulary, k: int = 1, id_col: str = "doc_id",
           text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, ids, n_pieces, score, others, decoded_sha256) of every whole text, and other_ids if ``whole``.

    ``ids`` is the best segmentation, ``others`` the scores of the next ``k - 1`` best (fewer if there are fewer), and
    ``other_ids`` their ids.
    ``decoded_sha256`` is of the text that the ids decode to, which is the text itself if the vocabulary has byte
    pieces. A null text counts as empty; an empty text is its leading space. Repeated rows are encoded alike; an
    empty table gives no rows; other columns are left out.
    """
    name = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))     # as large as the vocabulary

    def lists(of: list[np.ndarray], kind) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, of)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, dtype=kind), *of])))

    def apply(batches):
        coder = encoder_for(shared.value, k > 1, name)
        for b in batches:
            begin = 0
            while begin < len(b):       # groups of bounded size
                texts, size = [], 0
                while begin + len(texts) < len(b) and size < GROUP_CHARS:
                    texts.append(b["text"][begin + len(texts)].as_py())
                    size += len(texts[-1])
                coded = coder.encode_all(texts, k)
                best = [x[0] for x in coded]
                digests = [hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()
                           for ids, _ in best]
                columns = {"id": b["id"].slice(begin, len(texts)), "ids": lists([ids for ids, _ in best], np.int32),
                           "n_pieces": pa.array([len(ids) for ids, _ in best], pa.int64()),
                           "score": pa.array([s for _, s in best], pa.float64()),
                           "others": lists([np.array([s for _, s in x[1:]], dtype=float) for x in coded], float),
                           "decoded_sha256": pa.array(digests, pa.string())}
                if whole:
                    ends = np.cumsum([0, *(len(x) - 1 for x in coded)]).astype(np.int32)
                    columns["other_ids"] = pa.ListArray.from_arrays(
                        ends, lists([ids for x in coded for ids, _ in x[1:]], np.int32))
                yield pa.RecordBatch.from_pydict(columns)
                begin += len(texts)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ints = T.ArrayType(T.IntegerType())
    made = (T.StructType().add("id", docs.schema[id_col].dataType).add("ids", ints).add("n_pieces", "long")
            .add("score", "double").add("others", T.ArrayType(T.DoubleType())).add("decoded_sha256", "string"))
    coded = rows.mapInArrow(apply, made.add("other_ids", T.ArrayType(ints)) if whole else made)
    return coded.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""
    name = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        coder = encoder_for(shared.value, False, name)
        return pd.Series([None if i is None else coder.decode(i) for i in ids], dtype=object)

    return encoded.withColumn(out_col, text(F.col(ids_col)))
