"""Running a model, or any callable, over files in parallel batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpuslens.functions import rules as R, text as X

Annotator = Callable[[list[str], list[str]], list[dict]]

ANNOTATION_SCHEMA = ("category STRING, complexity STRING, reusability STRING, error_handling STRING, "
                     "type_definitions STRING, lines_of_code BIGINT, is_excellent BOOLEAN")
# --- fixed values: what a file gets when its annotation fails
ANNOTATION_DEFAULT = {"category": "other", "complexity": "low", "reusability": "low", "error_handling": "none",
                      "type_definitions": "poor", "lines_of_code": None, "is_excellent": False}

CLASSIFY_SCHEMA = "has_api BOOLEAN, has_components BOOLEAN, worth_deep_analysis BOOLEAN, estimated_complexity STRING"
CLASSIFY_DEFAULT = {"has_api": False, "has_components": False, "worth_deep_analysis": False, "estimated_complexity": "low"}


def rule_annotations(df: DataFrame, key: str = "doc_id", path: str = "path", text: str = "content") -> DataFrame:
    """Annotations without a model, as columns: key, the fields of ANNOTATION_SCHEMA, and ``error`` (null)."""
    has = lambda needle: F.contains(F.col(text), F.lit(needle))
    guarded, lines = has("try") & has("catch"), X.line_count(F.col(text))
    return df.select(
        key, X.annotation_category(F.col(path)).alias("category"), X.complexity(lines).alias("complexity"),
        F.when(has("export "), "high").otherwise("low").alias("reusability"),
        F.when(guarded & has("throw"), "comprehensive").when(guarded, "basic").otherwise("none").alias("error_handling"),
        F.when(has("interface "), "good").otherwise("poor").alias("type_definitions"), lines.alias("lines_of_code"),
        (guarded & has("interface ")).alias("is_excellent"), F.lit(None).cast("string").alias("error"))


def annotate(df: DataFrame, fn: Annotator, schema: str = ANNOTATION_SCHEMA, default: dict = ANNOTATION_DEFAULT,
             key: str = "doc_id", path: str = "path", text: str = "content", batch_size: int = 64,
             max_chars: int | None = None) -> DataFrame:
    """One annotation row per file: key, the schema's fields, and ``error``.

    ``fn(paths, texts)`` is called with up to ``batch_size`` files at a time in
    every task. When a call fails its files are tried one by one, and a file
    that still fails gets the default row with the error: one bad file costs
    neither its batch nor the job. What can be told without the annotator
    (category from the path, lines from the text) is in the default row, where
    the schema has those fields. ``max_chars`` cuts what is sent to a model
    with a prompt limit; by default whole texts are sent.
    """
    fields = [part.split()[0] for part in schema.split(",")]
    key_type = df.schema[key].dataType.simpleString()
    derived = {f: c for f, c in (("category", X.annotation_category(F.col(path))),
                                 ("lines_of_code", X.line_count(F.col(text)))) if f in fields}
    told = [f"_{f}" for f in derived]

    def attempt(paths: list[str], texts: list[str], known: list[dict]) -> list[dict]:
        try:
            rows = fn(paths, texts)
            if len(rows) != len(paths):
                raise ValueError(f"{len(rows)} annotations for {len(paths)} files")
            return [{f: r.get(f, default.get(f)) for f in fields} | {"error": None} for r in rows]
        except Exception as e:
            if len(paths) == 1:
                return [{f: default.get(f) for f in fields} | known[0] | {"error": f"{type(e).__name__}: {e}"}]
            return [row for p, t, k in zip(paths, texts, known) for row in attempt([p], [t], [k])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text] if max_chars is None else pdf[text].str.slice(0, max_chars)
            rows: list[dict] = []
            known = pdf[told].rename(columns=lambda c: c[1:]).to_dict("records")
            for i in range(0, len(pdf), batch_size):
                part = slice(i, i + batch_size)
                rows += attempt(pdf[path].iloc[part].tolist(), texts.iloc[part].tolist(), known[part])
            out = pd.DataFrame(rows, columns=[*fields, "error"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return df.select(key, path, text, *[c.alias(f"_{f}") for f, c in derived.items()]).mapInPandas(run, f"{key} {key_type}, {schema}, error STRING")


def _category(path: str) -> str:
    for name, needle in (("composable", "composables"), ("api", "/api/"), ("utility", "utils"), ("page", "pages")):
        if needle in path:
            return name
    return "other"


def _level(lines: int) -> str:
    return next((name for name, bound in R.COMPLEXITY_BOUNDS if lines < bound), "very-high")


def rule_annotator(paths: list[str], texts: list[str]) -> list[dict]:
    """The rules of ``rule_annotations`` in a caller's form, to wrap or to test with."""
    out = []
    for path, text in zip(paths, texts):
        lines = text.count("\n") + 1
        guarded = "try" in text and "catch" in text
        out.append({
            "category": _category(path), "complexity": _level(lines), "lines_of_code": lines,
            "reusability": "high" if "export " in text else "low",
            "error_handling": "comprehensive" if guarded and "throw" in text else "basic" if guarded else "none",
            "type_definitions": "good" if "interface " in text else "poor",
            "is_excellent": guarded and "interface " in text})
    return out


def quick_classify(df: DataFrame, fn: Annotator | None = None, key: str = "doc_id", path: str = "path",
                   text: str = "content", **options) -> DataFrame:
    """Cheap pre-filter by a caller's function, by default by rules, as columns."""
    if fn is not None:
        return annotate(df, fn, CLASSIFY_SCHEMA, CLASSIFY_DEFAULT, key=key, path=path, text=text, **options)
    has = lambda needle: F.contains(F.col(text), F.lit(needle))
    api, lines = has("client.") | has("axios") | has("fetch("), X.line_count(F.col(text))
    return df.select(key, api.alias("has_api"), has("<El").alias("has_components"),
                     (api & (lines >= 12)).alias("worth_deep_analysis"), X.complexity(lines).alias("estimated_complexity"),
                     F.lit(None).cast("string").alias("error"))


def worth_annotating(df: DataFrame, classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """Files the pre-filter lets through to the full annotation."""
    return df.join(classified.filter("worth_deep_analysis").select(key), key, "left_semi")
