"""Annotations from a model's JSON replies: the whole record of a file, field by field, and cases built from it.

A reply is read as far as it can be: prose and fences around its object are
passed over, a cut or malformed object still gives the fields that stand in it,
and a field of the wrong type costs only itself. What a reply leaves out comes
from the file's own columns or from defaults, and every fault is listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import rules as R, scoring as S, text as X
from corpuslens.operators import vectors as V
from corpuslens.operators.incremental import extract_features
from corpuslens.sources.store import write_table

Replier = Callable[[list[str], list[str]], list[str]]

# --- fixed values: levels of a record, and what holds where a reply or one of its fields is missing
LEVELS = {"complexity": R.COMPLEXITY_LEVELS, "reusability": list(R.SINGLE_REUSE), "error_handling": list(R.SINGLE_ERROR),
          "type_definitions": list(R.SINGLE_TYPES), "api_type": ["grpc", "openapi", "rest", "none"]}
UNSAID = {"complexity": "medium", "reusability": "medium", "error_handling": "basic", "type_definitions": "basic"}
FAILED = {"complexity": "low", "reusability": "low", "error_handling": "none", "type_definitions": "poor"}
LISTS = ["patterns", "frameworks", "api_methods", "dependencies", "composables_used", "components_used", "entities",
         "features", "excellent_reasons", "excellent_patterns"]
FLAGS = ["has_documentation", "has_loading_states", "has_error_states", "is_excellent"]
LIBRARIES = {"design_system": R.DESIGN_SYSTEM_PATTERNS, "utility_library": R.UTILITY_PATTERNS}
BINDINGS = {"name": "string", "component": "string", "has_watch": "boolean", "has_validation": "boolean",
            "has_type_definition": "boolean"}


_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'     # a JSON text, matched without going back


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def ask(df: DataFrame, fn: Replier, path: str = "path", text: str = "content", batch_size: int = 64,
        max_chars: int | None = None) -> DataFrame:
    """``df`` with ``reply`` and ``reply_error``; all other columns stay outside Python.

    ``fn(paths, texts)`` gets up to ``batch_size`` files. When a call fails its files are asked one by one; one that
    still fails has a null reply and the error. ``max_chars`` cuts what is sent; by default whole texts are.
    """
    def attempt(paths: list[str], texts: list[str]) -> list[tuple]:
        try:
            replies = list(fn(paths, texts))
            if len(replies) != len(paths):
                raise ValueError(f"{len(replies)} replies for {len(paths)} files")
            return [(r, None) for r in replies]
        except Exception as e:
            if len(paths) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [row for p, t in zip(paths, texts) for row in attempt([p], [t])]

    @F.pandas_udf("reply string, reply_error string")
    def replies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, texts in batches:
            paths, texts, rows = paths.tolist(), texts.tolist(), []
            for i in range(0, len(paths), batch_size):
                rows += attempt(paths[i:i + batch_size], [t[:max_chars] for t in texts[i:i + batch_size]])
            yield pd.DataFrame(rows, columns=["reply", "reply_error"], dtype=object)

    said = replies(F.coalesce(path, F.lit("")), F.coalesce(text, F.lit("")))
    return df.withColumn("_said", said).select(*df.columns, "_said.reply", "_said.reply_error")


def _value(name: str) -> Column:
    """Raw text of a field: from the object, or from what stands of it."""
    keys = [camel(name)] + ([name] if camel(name) != name else [])
    standing = F.regexp_extract("reply", rf'"(?:{"|".join(keys)})"\s*:\s*({_TEXT}|\[[^\[\]"]*+(?:{_TEXT}[^\[\]"]*+)*+\]|[-+.\w]++)', 1)
    plain = F.when(standing.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), standing, F.lit("]")), "array<string>"), F.lit(0))
                   ).otherwise(F.nullif(F.nullif(standing, F.lit("")), F.lit("null")))
    return F.when(F.col("_object").isNotNull(), F.coalesce(*[F.col("_object")[k] for k in keys])).otherwise(plain)


def _fault(name: str, wrong: Column, problem: str) -> Column:
    return F.when(wrong, F.lit(f"{name}: {problem}"))


def _bound(value: Column) -> Column:
    """The value as one computation: without it the optimizer would repeat a struct's fields wherever they are read."""
    return F.get(F.transform(F.array(value), lambda v: v), F.lit(0))


def read_replies(df: DataFrame, path: str = "path", text: str = "content", out: str = "record") -> DataFrame:
    """``df`` (with reply, reply_error) plus ``out``: the record's fields and ``errors``.

    Levels outside their range, flags that are not true or false and lists that are none are faults and take the
    default; a lone text in place of a list becomes its only member, and is listed too. A field that the reply leaves
    out is no fault. The category comes from the path, line counts from the text, and libraries that the reply does
    not name are looked for in the text. A reply with no readable field counts as failed.
    """
    names = [*LEVELS, *LISTS, *FLAGS, *LIBRARIES, "v_model_bindings"]
    found = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    staged = (df.withColumn("_object", F.from_json(found, "map<string,string>"))
              .withColumn("_raw", _bound(F.struct(*[_value(n).alias(n) for n in names]))))
    raw = {n: F.trim(F.col(f"_raw.{n}")) for n in names}
    failed = F.col("_failed")
    staged = staged.withColumn("_failed", F.coalesce(*[F.col(f"_raw.{n}") for n in names]).isNull())
    fields: dict[str, Column] = {
        "category": F.when(F.col(path).endswith(".vue") & F.contains(F.col(text), F.lit("<template")), "component")
        .otherwise(X.annotation_category(F.col(path)))}
    faults = [F.when(F.col("reply").isNull(), F.concat(F.lit("reply: "), F.coalesce("reply_error", F.lit("none"))))
              .when(F.col("_object").isNull(), F.when(failed, F.lit("reply: no object")).otherwise(F.lit("reply: cut or malformed")))]
    for n, levels in LEVELS.items():
        said = F.lower(raw[n])
        unsaid = F.when(failed, F.lit(FAILED.get(n))).otherwise(F.lit(UNSAID.get(n)))
        fields[n] = F.when(said.isin(levels), said).otherwise(unsaid)
        faults.append(_fault(n, raw[n].isNotNull() & ~said.isin(levels), "not a level"))
    for n in LISTS:
        is_list = raw[n].startswith("[")
        members = F.when(is_list, F.from_json(raw[n], "array<string>")).when(raw[n] != "", F.array(raw[n]))
        fields[n] = F.filter(F.coalesce(members, F.array().cast("array<string>")), lambda m: m.isNotNull() & (F.trim(m) != ""))
        faults.append(_fault(n, raw[n].isNotNull() & (~is_list | members.isNull()), "not a list"))
    for n in FLAGS:
        said = F.lower(raw[n])
        fields[n] = F.coalesce(said == "true", F.lit(False))
        faults.append(_fault(n, raw[n].isNotNull() & ~said.isin("true", "false"), "not a flag"))
    for n, patterns in LIBRARIES.items():
        fields[n] = F.coalesce(F.nullif(raw[n], F.lit("")), X.detect_library(F.col(text), patterns))
    shape = ", ".join(f"{camel(k)}: {v}" for k, v in BINDINGS.items())
    bindings = F.from_json(raw["v_model_bindings"], f"array<struct<{shape}>>")
    as_named = F.transform(bindings, lambda b: F.struct(
        *[(F.coalesce(b[camel(k)], F.lit(False)) if v == "boolean" else b[camel(k)]).alias(k) for k, v in BINDINGS.items()]))
    empty = F.array().cast(f"array<struct<{', '.join(f'{k}: {v}' for k, v in BINDINGS.items())}>>")
    fields["v_model_bindings"] = F.coalesce(as_named, empty)
    faults.append(_fault("v_model_bindings", raw["v_model_bindings"].isNotNull() & bindings.isNull(), "not a list"))
    for n, block in (("template_lines", "template"), ("script_lines", "script")):
        fields[n] = F.when(fields["category"] == "component", X.line_count(X.split_block(F.col(text), block)))
    fields["lines_of_code"] = X.line_count(F.col(text))
    fields["errors"] = F.array_compact(F.array(*faults))
    record = _bound(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return staged.withColumn(out, record).select(*[c for c in df.columns if c not in ("reply", "reply_error", out)], out)


def annotate_records(df: DataFrame, fn: Replier, path: str = "path", text: str = "content", out: str = "record",
                     **options) -> DataFrame:
    """``df`` with the annotator's whole record of every file."""
    return read_replies(ask(df, fn, path, text, **options), path, text, out)


def record_scores(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with the eight scores of its records; null where the record is."""
    fields = ["complexity", "api_type", "api_methods", "frameworks", "patterns", "error_handling", "type_definitions",
              "reusability", "is_excellent"]
    apart = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                      *[F.col(f"{record}.{f}").alias(f) for f in fields])
    scored = apart.select("_row", *S.annotation_scores())
    there = F.col("_row")[record].isNotNull()
    return scored.select("_row.*", *[F.when(there, F.col(d)).alias(d) for d in R.DIMENSIONS])


def annotated_cases(files: DataFrame, fn: Replier | None = None, encode=None, now: Column | None = None,
                    tag_keywords: int = 5, **options) -> DataFrame:
    """Cases in one flow: features, the annotator's record, scores, summary sentence, vector and stamps.

    Scores come from the record; without an annotator from the text. ``encode`` is as in ``vectors.embed``; a text
    it fails on has a null vector, and the case is built all the same.
    """
    df = extract_features(files)
    if fn is None:
        df = df.withColumn("patterns", F.array().cast("array<string>")).select("*", *S.fallback_scores(text=F.col("content")))
    else:
        # written, so that no file is asked twice, whatever reads the cases or is lost
        df = record_scores(write_table(annotate_records(df, fn, **options), "annotated-files"))
        extra = F.array_compact(F.array(
            F.when(F.col("record.is_excellent"), F.lit("excellent")),
            F.when(F.col("record.api_type").isin("grpc", "rest"), F.col("record.api_type"))))
        df = df.withColumns({"keywords": F.array_distinct(F.concat("keywords", extra)), "patterns": F.col("record.patterns")})
    stamp = F.current_timestamp() if now is None else now
    summary = X.embedding_text(F.col("file_role"), keywords=F.col("keywords"), api_methods=F.col("api_methods"),
                               components=F.col("components_used"), composables=F.col("composables_used"),
                               patterns=F.col("patterns"), entities=F.col("entities"))
    df = df.withColumns({
        "total_score": S.weighted_total(), "excellent_in": S.excellent_in(), "scoring_version": F.lit(R.SCORING_VERSION),
        "summary": summary, "tags": F.concat(F.array("file_type", "file_role"), F.slice("keywords", 1, tag_keywords)),
        "created_at": stamp, "updated_at": stamp, "analyzed_at": stamp})
    return V.embed(df.withColumn("grade", S.grade(F.col("total_score"))), "summary", encode).drop("low")
