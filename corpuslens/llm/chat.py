"""Chat formatting of turns with typed content parts.

A visitor flattens the parts of a turn: texts as they are, with control strings
escaped, and images, audio and documents as placeholders in their order, each
recorded with its reference and the number of tokens that it expands to. Turns
are formatted one by one wherever they lie; only then they move to their
conversations, whose turns stream past in order. A record holds whole turns up to
a bounded size, so that a conversation of any length is never in memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import text_of

RECORD_CHARS = 1 << 20

PART = ("struct<type: string, text: string, ref: string, width: double, height: double, seconds: double, "
        "pages: double>")
ATTACHMENTS = "array<struct<kind: string, ref: string, at: long, tokens: long>>"
SPANS = "array<struct<start: long, end: long>>"


class Expansion(NamedTuple):
    """Tokens that placeholders expand to; an attachment of unknown size counts as ``unknown``."""
    patch: int = 28                 # an image has a token for every patch x patch pixels begun
    per_second: float = 25.0        # audio
    per_page: int = 512             # documents
    unknown: int = 256


class Template(NamedTuple):
    """Marks of turns. A turn is its opening mark, its role, a line break, its content and its closing mark."""
    learned: tuple[str, str] = ("<s>", "</s>")              # of turns under the loss mask
    given: tuple[str, str] = ("[INST] ", " [/INST]")        # of all others
    learned_roles: tuple[str, ...] = ("assistant",)
    placeholders: tuple[str, ...] = ("image", "audio", "document", "file")

    def placeholder(self, kind: str) -> str:
        return f"<|{kind}|>"

    def control(self) -> list[str]:
        """Strings that only the template may write."""
        marks = [m.strip() for m in (*self.learned, *self.given)]
        return marks + [self.placeholder(k) for k in self.placeholders]

    def escaper(self) -> tuple[Callable[[str], str], Callable[[str], str]]:
        """(escape, unescape): a control string gets a backslash after its first character, and so does one that has
        some there already, so that taking one away restores any text."""
        control = self.control()
        if any(c[0] in c[1:] or "\\" in c for c in control):
            raise ValueError("a control string may not hold its first character again, or a backslash")
        plain = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in control))
        marked = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in control))
        return (lambda text: plain.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text),
                lambda text: marked.sub(lambda m: m[0][0] + m[0][2:], text))

    def parser(self) -> Callable[[str], list[tuple[str, str]]]:
        """Reads whole turns back: (role, text) each, placeholders as they are."""
        unescape = self.escaper()[1]
        kinds = [f"{re.escape(a)}([^\n]*)\n(.*?){re.escape(b)}" for a, b in (self.learned, self.given)]
        turn = re.compile("|".join(kinds), re.DOTALL)

        def read(formatted: str) -> list[tuple[str, str]]:
            out, at = [], 0
            while at < len(formatted):
                found = turn.match(formatted, at)
                if not found:
                    raise ValueError(f"no turn at character {at}")
                role, body = found.group(1, 2) if found[1] is not None else found.group(3, 4)
                out.append((_plain_role(unescape(role)), unescape(body)))
                at = found.end()
            return out

        return read


def _line_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


class Flattener:
    """Visits the parts of one turn in order; afterwards ``text``, ``attachments`` and ``tokens`` tell what it saw.

    Neighbouring texts are joined before they are escaped: a control string cut in two is one all the same.
    """

    WORD = re.compile(r"[^\x20\x09-\x0D]+")     # fixed value: words of the data contracts

    def __init__(self, template: Template, expansion: Expansion, escape: Callable[[str], str]):
        self.template, self.expansion, self.escape = template, expansion, escape
        self.out: list[str] = []
        self.open: list[str] = []
        self.length = self.tokens = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}", self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        self.open.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        sides = [_number(part["width"]), _number(part["height"])]
        patches = [math.ceil(s / self.expansion.patch) for s in sides if s]
        self._attach("image", part, patches[0] * patches[1] if len(patches) == 2 else None)

    def visit_audio(self, part: dict) -> None:
        seconds = _number(part["seconds"])
        self._attach("audio", part, seconds and math.ceil(seconds * self.expansion.per_second))

    def visit_document(self, part: dict) -> None:
        pages = _number(part["pages"])
        self._attach("document", part, pages and math.ceil(pages) * self.expansion.per_page)

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, None)

    def _attach(self, kind: str, part: dict, tokens: int | None) -> None:
        self._close()
        tokens = tokens or self.expansion.unknown
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.length, "tokens": tokens})
        self._write(self.template.placeholder(kind))
        self.tokens += tokens

    def _close(self) -> None:
        text = "".join(self.open)
        self.open = []
        self.tokens += len(self.WORD.findall(text))
        self._write(self.escape(text))

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        self._close()
        return "".join(self.out)


def _number(value) -> float | None:
    """A positive finite number, or None."""
    return float(value) if value is not None and 0 < value < math.inf else None


def text_parts(column: str) -> Column:
    """A text as a list of one text part; null as an empty text."""
    fields = [f.split(":")[0].strip() for f in PART[len("struct<"):-1].split(",")]
    given = {"type": F.lit("text"), "text": text_of(column)}
    return F.array(F.struct(*[given.get(f, F.lit(None)).alias(f) for f in fields])).cast(f"array<{PART}>")


def format_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, content_col: str, template: Template,
                 expansion: Expansion) -> DataFrame:
    """(conv, turn, segment, loss_from, loss_to, attachments, tokens) per turn; nothing moves for it.

    The loss span (of the content, in characters of the segment) is null where nothing is learned; ``at`` of an
    attachment is its place in the segment.
    """
    escape = template.escaper()[0]

    @F.pandas_udf(f"segment string, loss_from long, loss_to long, attachments {ATTACHMENTS}, tokens long")
    def formatted(roles: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for role, content in zip(roles, contents):
            opening, closing = template.learned if role in template.learned_roles else template.given
            head = f"{opening}{escape(_line_role(role))}\n"
            seen = Flattener(template, expansion, escape)
            for part in content if content is not None else ():
                if part is not None:
                    seen.visit(part)
            text = seen.text
            learned = role in template.learned_roles
            rows.append((head + text + closing, len(head) if learned else None, len(head) + len(text) if learned else None,
                         [a | {"at": a["at"] + len(head)} for a in seen.attachments], seen.tokens))
        out = pd.DataFrame(rows, columns=["segment", "loss_from", "loss_to", "attachments", "tokens"])
        return out.astype({"loss_from": "Int64", "loss_to": "Int64"})

    return turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"),
                        formatted(text_of(role_col), F.col(content_col).cast(f"array<{PART}>")).alias("f")
                        ).select("conv", "turn", "f.*")


def records(segments: DataFrame, record_chars: int = RECORD_CHARS) -> DataFrame:
    """(conv, record, start, formatted, n_turns, loss_spans, attachments, tokens): a conversation's turns in order.

    Places count from the start of the conversation, ``start`` is the record's. A partition's rows stream past, sorted.
    """
    columns = ["conv", "record", "start", "formatted", "n_turns", "loss_spans", "attachments", "tokens"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv: object = records      # no conversation yet
        held: list[str] = []
        size = record = start = tokens = 0
        spans: list[dict] = []
        attached: list[dict] = []

        def close() -> tuple:
            return conv, record, start, "".join(held), len(held), spans, attached, tokens

        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if held and (row.conv != conv or size + len(row.segment) > record_chars):
                    out.append(close())
                    record, start = record + 1, start + size
                    held, spans, attached, size, tokens = [], [], [], 0, 0
                if row.conv != conv:
                    conv, record, start = row.conv, 0, 0
                at = start + size
                if not pd.isna(row.loss_from):
                    spans.append({"start": at + int(row.loss_from), "end": at + int(row.loss_to)})
                attached.extend({**a, "at": a["at"] + at} for a in row.attachments)
                held.append(row.segment)
                size += len(row.segment)
                tokens += row.tokens
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([close()], columns=columns)

    ordered = segments.repartition("conv").sortWithinPartitions("conv", "turn", "segment")
    return ordered.select("conv", "segment", "loss_from", "loss_to", "attachments", "tokens").mapInPandas(
        join, f"conv string, record long, start long, formatted string, n_turns long, loss_spans {SPANS}, "
              f"attachments {ATTACHMENTS}, tokens long")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 content_col: str = "content", template: Template = Template(), expansion: Expansion = Expansion(),
                 record_chars: int = RECORD_CHARS) -> DataFrame:
    """Records of formatted conversations: conv_id, record, start, formatted, n_turns, loss_spans, attachments, tokens.

    ``content`` is a list of parts (PART). Turns go by ``turn``, null first, rows that repeat one by their formatted
    text; rows with a null conversation are one conversation of that id. A null role counts as empty, a null or empty
    content as no text, a part without a type as text, one of an unknown type as a file; null parts are passed over.
    A record has turns of up to ``record_chars`` characters, or one turn that has more; records of a conversation
    concatenate to its formatted text. ``tokens`` counts words of texts and what the placeholders expand to. An empty
    table gives no rows. Further columns are not read.
    """
    kind = turns.schema[conv_col].dataType
    segments = format_turns(turns, conv_col, turn_col, role_col, content_col, template, expansion)
    out = records(segments, record_chars)
    return out.select(F.col("conv").cast(kind).alias(conv_col), *out.columns[1:])


def read_back(chats: DataFrame, conv_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """Per conversation, from its records: n_turns, turns_sha256 (role, line break, text, line break of every turn),
    loss_chars and loss_sha256 (text under the loss mask, unescaped), formatted_chars, n_attachments and tokens.

    Records stream past in order; a conversation's digests are carried from one to the next.
    """
    kind = chats.schema[conv_col].dataType
    read, unescape = template.parser(), template.escaper()[1]
    columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments",
               "tokens"]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv: object = read_back
        turns, learned = sha256(), sha256()
        n = chars = loss = attached = tokens = 0

        def close() -> tuple:
            return conv, n, turns.hexdigest(), loss, learned.hexdigest(), chars, attached, tokens

        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row.conv != conv:
                    if conv is not read_back:
                        out.append(close())
                    conv, turns, learned = row.conv, sha256(), sha256()
                    n = chars = loss = attached = tokens = 0
                for role, text in read(row.formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in row.loss_spans:
                    text = unescape(row.formatted[span["start"] - row.start:span["end"] - row.start])
                    learned.update(text.encode())
                    loss += len(text)
                chars += len(row.formatted)
                attached += len(row.attachments)
                tokens += row.tokens
            if out:
                yield pd.DataFrame(out, columns=columns)
        if conv is not read_back:
            yield pd.DataFrame([close()], columns=columns)

    ordered = chats.withColumn("conv", F.col(conv_col).cast("string"))
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "start")
    out = ordered.select("conv", "start", "formatted", "loss_spans", "attachments", "tokens").mapInPandas(
        digest, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                "formatted_chars long, n_attachments long, tokens long")
    return out.select(F.col("conv").cast(kind).alias(conv_col), *columns[1:])
