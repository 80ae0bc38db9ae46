"""Reading file trees and rule documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuslens.functions import rules as R


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing (path, size, relative path); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size"), relative_path(F.col("path"), root).alias("relative_path"))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; the scheme that Spark puts in front is ignored."""
    plain = F.regexp_replace(path, "^[a-zA-Z0-9]+:/*", "/")
    bare = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    return F.substr(plain, F.lit(len(bare) + 1))


def read_text_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Whole files as text with their path below ``root``; of other extensions only names are listed, never contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(any_case) + "}")
    raw = reader.load(root)
    return raw.select(relative_path(F.col("path"), root).alias("relative_path"),
                      F.col("content").cast("string").alias("content"))


def source_files(files: DataFrame, folders: list[str] | None = R.SCAN_FOLDERS,
                 extensions: list[str] = R.SCAN_EXTENSIONS, exclude: list[str] = ("node_modules",),
                 skip_hidden: bool = True, cap: int | None = None, project_depth: int = 1) -> DataFrame:
    """Source files of every project in a tree of text files.

    ``files`` has ``relative_path``; its first ``project_depth`` segments are
    the project. ``cap`` keeps the first files per project in folder order, as
    a scan budget; by default all files are kept.
    """
    rel = F.col("relative_path")
    project = F.substring_index(rel, "/", project_depth)
    inner = F.substr(rel, F.length(project) + 2)
    df = files.withColumns({"project": project, "path": inner})
    df = df.filter(F.lower(rel).rlike(r"\.(" + "|".join(extensions) + ")$"))
    for name in exclude:
        df = df.filter(~F.array_contains(F.split("path", "/"), name))
    if skip_hidden:
        df = df.filter(~F.col("path").rlike(r"(^|/)\."))
    if folders is not None:
        top = F.substring_index("path", "/", 1)
        df = df.filter(top.isin(folders) & F.contains("path", F.lit("/")))
    if cap is not None:
        rank = F.array_position(F.array(*[F.lit(f) for f in folders or []]), F.substring_index("path", "/", 1))
        order = Window.partitionBy("project").orderBy(rank, "path")
        df = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")
    return df.select("project", "path", *[c for c in files.columns if c not in ("project", "path")])


def package_sources(files: DataFrame, project_depth: int = 1) -> DataFrame:
    """Library sources: other extensions, other excluded folders, any folder, no cap."""
    return source_files(files, None, R.PACKAGE_EXTENSIONS, R.PACKAGE_EXCLUDES, skip_hidden=False,
                        project_depth=project_depth)


def front_matter(df: DataFrame, text: str = "content") -> DataFrame:
    """Split ``---`` front matter off: ``meta`` (key → raw value) and ``body``.

    Texts without front matter drop out. Values stay text here; ``typed`` gives
    them their types.
    """
    unix = F.regexp_replace(F.col(text), "\r\n", "\n")
    df = df.withColumn("_t", unix).filter(F.col("_t").rlike(r"^---\n[\s\S]+?\n---"))
    head = F.regexp_extract("_t", r"^---\n([\s\S]+?)\n---", 1)
    lines = F.filter(F.split(head, "\n"),
                     lambda x: (F.trim(x) != "") & ~x.startswith("#") & F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("k"),
        F.trim(F.substr(x, F.length(F.substring_index(x, ":", 1)) + 2)).alias("v")))
    # a repeated key keeps its last value
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(
        k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    body = F.trim(F.regexp_replace("_t", r"^---\n[\s\S]+?\n---\n", ""))
    return df.withColumns({"meta": F.map_from_entries(last), "body": F.btrim(body, F.lit(" \n\t"))}).drop("_t")


def value_type(value: Column) -> Column:
    """Type a front-matter value is read as, by the first rule that fits."""
    quoted = value.rlike("^\".*\"$") | value.rlike("^'.*'$")
    return (F.when(value.isin("true", "false"), "boolean").when(value.rlike(r"^\[.*\]$"), "list")
            .when(value.rlike(r"^\d+$"), "integer").when(quoted, "quoted").otherwise("string"))


def unquoted(value: Column) -> Column:
    return F.when(value_type(value) == "quoted", F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def as_list(value: Column) -> Column:
    items = F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.trim(x))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def typed_guides(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """Guide rows from front matter: id, scope, tags, priority and the rest."""
    m = lambda key: F.col("meta")[key]
    return df.select(
        unquoted(m("id")).alias("id"), unquoted(m("scope")).alias("scope"), unquoted(m("apiType")).alias("api_type"),
        as_list(m("tags")).alias("tags"), m("priority").try_cast("int").alias("priority"),
        unquoted(m("version")).alias("version"), as_list(m("requires")).alias("requires"),
        as_list(m("excludes")).alias("excludes"), unquoted(m("summary")).alias("summary"),
        F.coalesce(m("mandatory") == "true", F.lit(False)).alias("mandatory"),
        F.col("body").alias("content"), F.col(path).alias("file_path"))


def read_guides(spark: SparkSession, root: str) -> DataFrame:
    """Every ``.md`` file with front matter below ``root``."""
    texts = read_text_files(spark, root, ["md"]).filter(F.col("relative_path").endswith(".md"))
    return typed_guides(front_matter(texts))
