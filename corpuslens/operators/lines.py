"""Line-level search and link checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.text import base_name, glob_to_regex

MARKDOWN_LINK = r"\[[^\]]+\]\(([^)]+)\)"


def grep_lines(df: DataFrame, needle: str, definition: str, usage: str, text: str = "text",
               k_definitions: int | None = None, k_usages: int | None = None, preview: int | None = None) -> DataFrame:
    """Texts with the needle: their definition and usage lines and a preview, all or the first few. Narrow."""
    lines = F.split(F.col(text), "\n")
    found = df.filter(F.contains(F.col(text), F.lit(needle))).withColumn("_lines", lines)
    comment = r"^\s*//"

    def first(values, k: int | None):
        return values if k is None else F.slice(values, 1, k)

    return found.withColumns({
        "definitions": first(F.filter("_lines", lambda x: x.rlike(definition)), k_definitions),
        "usages": first(F.filter("_lines", lambda x: x.rlike(usage) & ~x.rlike(comment)), k_usages),
        "preview": F.array_join(first(F.col("_lines"), preview), "\n"),
    }).drop("_lines")


def extract_links(df: DataFrame, key: str, text: str = "text", pattern: str = MARKDOWN_LINK) -> DataFrame:
    """Links per line: external and anchor-only ones dropped, anchors cut off."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line_text"))
    links = rows.select(key, (F.col("pos") + 1).cast("bigint").alias("line"),
                        F.posexplode(F.regexp_extract_all("line_text", F.lit(pattern), F.lit(1))).alias("nth", "raw"))
    kept = links.filter(~F.col("raw").rlike(r"^(https?://|#)"))
    return kept.select(key, "line", F.col("nth").cast("bigint").alias("nth"),
                       F.regexp_replace("raw", "#.*$", "").alias("target"))


def broken_links(links: DataFrame, listing: DataFrame, base: Column | None = None) -> DataFrame:
    """Links whose normalised target is not in ``listing`` (column ``path``)."""
    target = F.regexp_replace("target", r"^(\./|/)", "")
    full = target if base is None else F.concat(base, target)
    known = listing.select(F.regexp_replace("path", r"^(\./|/)", "").alias("_path")).distinct()
    return links.withColumn("_path", full).join(known, "_path", "left_anti").drop("_path")


def glob_files(listing: DataFrame, pattern: str | None, recursive: bool = True, path: str = "path",
               root: str = "") -> DataFrame:
    """Files whose base name matches ``*``/``?``; only the root's own files unless recursive."""
    df = listing.withColumn("name", base_name(F.col(path)))
    if pattern:
        df = df.filter(F.col("name").rlike(glob_to_regex(pattern)))
    if not recursive:
        df = df.filter(~F.contains(F.substr(F.col(path), F.lit(len(root) + 1)), F.lit("/")))
    return df
