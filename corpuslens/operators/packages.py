"""Manifests, project discovery, package inventories and catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.functions.text import contains_any, first_match

MANIFEST_SCHEMA = "name STRING, dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>"


def parse_manifests(df: DataFrame, json: str = "json") -> DataFrame:
    """Add ``packages`` (names, runtime first) and ``versions`` (dev wins)."""
    empty = F.create_map().cast("map<string,string>")
    df = df.withColumn("_m", F.from_json(json, MANIFEST_SCHEMA))
    deps, dev = (F.coalesce(F.col("_m")[k], empty) for k in ("dependencies", "devDependencies"))
    runtime_only = F.map_filter(deps, lambda k, v: ~F.map_contains_key(dev, k))
    return (df.withColumn("readable", F.col("_m").isNotNull() & F.coalesce(
                F.col("_m.name"), F.col("_m.dependencies").cast("string"),
                F.col("_m.devDependencies").cast("string")).isNotNull())
            .withColumn("packages", F.array_distinct(F.concat(F.map_keys(deps), F.map_keys(dev))))
            .withColumn("versions", F.map_concat(runtime_only, dev))
            .drop("_m"))


def dependencies(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per manifest and package."""
    return parsed.select(*keys, F.explode("versions").alias("package", "version"))


def manifest_api_type(parsed: DataFrame) -> DataFrame:
    """Add api_type, api_packages and confidence from the dependency names."""
    p = F.col("packages")
    grpc = F.filter(p, lambda d: contains_any(d, R.GRPC_PACKAGES))
    openapi = F.filter(p, lambda d: contains_any(d, R.OPENAPI_PACKAGES))
    rest = F.filter(p, lambda d: d.isin(R.REST_PACKAGES))
    has_grpc, has_openapi, has_rest = (F.size(x) > 0 for x in (grpc, openapi, rest))
    api_type = first_match([("mixed", has_grpc & has_openapi), ("grpc", has_grpc),
                            ("openapi", has_openapi), ("rest", has_rest)], F.lit("unknown"))
    confidence = first_match([("high", has_grpc | has_openapi), ("medium", has_rest)], F.lit("low"))
    return parsed.withColumns({
        "api_type": api_type, "confidence": confidence,
        "api_packages": F.filter(p, lambda d: contains_any(d, R.GRPC_PACKAGES + R.OPENAPI_PACKAGES)
                                 | d.isin(R.REST_PACKAGES))})


def manifest_libraries(parsed: DataFrame, systems=R.KNOWN_DESIGN_SYSTEMS,
                       utilities=R.KNOWN_UTILITIES) -> DataFrame:
    """Add detected design systems (exact) and utilities (substring), first one recommended."""
    p = F.col("packages")
    return (parsed
            .withColumns({"design_systems": F.filter(p, lambda d: d.isin(systems)),
                          "utilities": F.filter(p, lambda d: contains_any(d, utilities))})
            .withColumns({"design_system": F.get("design_systems", F.lit(0)),
                          "utility_library": F.get("utilities", F.lit(0))}))


def discover_projects(parsed: DataFrame, any_of=R.PROJECT_MARKERS) -> DataFrame:
    """Project roots: depth 1, else depth 2 unless the parent is a project itself.

    Needs ``path`` and ``depth``; hidden folders are skipped.
    """
    marked = parsed.filter(
        F.arrays_overlap("packages", F.array(*[F.lit(m) for m in any_of])) & ~F.col("path").rlike(r"(^|/)\."))
    top = marked.filter("depth = 1")
    nested = marked.filter("depth = 2").withColumn("parent", F.substring_index("path", "/", 1))
    parents = top.select(F.col("path").alias("parent"))
    return top.select("path", "depth").unionByName(
        nested.join(parents, "parent", "left_anti").select("path", "depth"))


def name_components(files: DataFrame, modules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exported component names: alias, else directory prefix, else file name.

    ``files``: key, project, path. ``modules``: key, project, content. Both
    lookups are equi joins on (project, name) or (project, path segment).
    """
    blocks = F.regexp_extract_all("content", F.lit(r"addComponentsDir\s*\(\s*\{([^}]+)\}\s*\)"), F.lit(1))
    quoted = F.regexp_extract_all(F.regexp_extract("block", r"path:\s*resolve\(([^)]*)\)", 1),
                                  F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    prefixes = (modules.select("project", F.col(key).alias("m"), F.posexplode(blocks).alias("pos", "block"))
                .select("project", F.struct("m", "pos").alias("ord"),
                        F.lower(F.element_at(F.nullif(quoted, F.array().cast("array<string>")), -1)).alias("segment"),
                        F.regexp_extract("block", r"prefix:\s*[\"'](\w+)[\"']", 1).alias("prefix"))
                .filter("segment IS NOT NULL AND prefix <> ''")
                .groupBy("project", "segment")
                .agg(F.min("ord").alias("first"), F.max_by("prefix", "ord").alias("prefix")))
    exports = F.regexp_extract_all("content", F.lit(r"export\s*\{([^}]+)\}"), F.lit(1))
    items = F.flatten(F.transform(exports, lambda b: F.split(b, ",")))
    pair = r"(\w+)\s+as\s+(\w+)"
    aliases = (modules.select("project", F.col(key).alias("m"), F.posexplode(items).alias("pos", "item"))
               .filter(F.col("item").rlike(pair))
               .groupBy("project", F.regexp_extract("item", pair, 1).alias("file_name"))
               .agg(F.max_by(F.regexp_extract("item", pair, 2), F.struct("m", "pos")).alias("alias")))
    named = files.select(key, "project", "path",
                         F.regexp_replace(X.base_name(F.col("path")), r"\.(vue|tsx?)$", "").alias("file_name"))
    segments = named.select(key, "project", F.explode(F.array_distinct(F.split(F.lower("path"), r"[/\\]"))).alias("segment"))
    by_dir = (segments.join(prefixes, ["project", "segment"])
              .groupBy(key).agg(F.min_by("prefix", "first").alias("prefix")))
    return (named.join(aliases, ["project", "file_name"], "left").join(by_dir, key, "left")
            .withColumn("name", F.coalesce("alias", F.concat("prefix", "file_name"), "file_name"))
            .select(key, "project", "path", "file_name", "name"))


def package_components(meta: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """Components of each package, last file wins per name, and its name patterns."""
    parts = (meta.filter((F.col("category") == "component") | F.contains("path", F.lit("/components/")))
             .select(key, "features").join(names.select(key, "project", "name"), key))
    items = (parts.groupBy("project", "name")
             .agg(F.max(F.struct(F.col(key), F.array_join("features", ", ").alias("description"))).alias("last"))
             .select("project", F.lit("component").alias("kind"), "name",
                     X.component_category(F.col("name")).alias("category"),
                     F.concat(F.lit("<"), "name", F.lit(" />")).alias("usage"),
                     F.col("last.description").alias("description"), F.col(f"last.{key}").alias(key)))
    prefix = X.name_prefix(F.col("name"))
    patterns = (items.select("project", prefix.alias("prefix")).filter("prefix IS NOT NULL").distinct()
                .select("project", F.lit("pattern").alias("kind"),
                        F.concat("prefix", F.lit(r"[A-Z]\w+")).alias("name"), F.lit(None).cast("string").alias("category"),
                        F.lit(None).cast("string").alias("usage"), F.lit(None).cast("string").alias("description"),
                        F.lit(None).cast("bigint").alias(key)))
    return items.unionByName(patterns)


def package_functions(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """``use*`` files and api methods of composable and utility files, last file wins."""
    parts = meta.filter(F.col("category").isin("composable", "utility"))
    file_name = F.regexp_replace(X.base_name(F.col("path")), r"\.(ts|js)$", "")
    used = F.concat(F.when(file_name.startswith("use"), F.array(file_name)).otherwise(F.array().cast("array<string>")),
                    F.col("api_methods"))
    rows = parts.select(key, "project", "patterns", file_name.alias("file_name"), F.posexplode(used).alias("pos", "name"))
    # a method that shares its file's name is written after the file's own entry
    return (rows.groupBy("project", "name")
            .agg(F.max(F.struct(key, "pos", "patterns", "file_name")).alias("last"))
            .select("project", "name", X.function_category(F.col("name"), F.col("last.patterns")).alias("category"),
                    F.when((F.col("last.pos") == 0) & (F.col("last.file_name") == F.col("name")),
                           F.concat(F.lit("const result = "), "name", F.lit("()")))
                    .otherwise(F.concat("name", F.lit("()"))).alias("usage"),
                    F.col(f"last.{key}").alias(key)))


def package_worklist(packages: DataFrame, mode: str = "unanalyzed", kind: str | None = None) -> DataFrame:
    """Packages to analyse; a hybrid package belongs to both kinds."""
    df = packages if mode == "all" else packages.filter(~F.col("analyzed"))
    return df if kind is None else df.filter(F.col("type").isin(kind, "hybrid"))


def catalogue(spark: SparkSession, entries=R.CATALOGUE) -> DataFrame:
    return spark.createDataFrame(R.catalogue_rows(entries), "library STRING, kind STRING, slot STRING, name STRING")


def catalog_enrich(meta: DataFrame, catalog: DataFrame) -> DataFrame:
    """Uses per project and catalogue slot; items not in the catalogue count as unknown.

    A name that the catalogue lists more than once is counted once, as ambiguous.

    Uses are counted per (project, kind, name) before the lookup join, so a
    component that fills a third of the corpus is one row there.
    """
    def uses(column: str, kind: str) -> DataFrame:
        return meta.select("project", F.lit(kind).alias("kind"), F.explode(column).alias("name"))

    counted = (uses("components_used", "component").unionByName(uses("composables_used", "function"))
               .groupBy("project", "kind", "name").agg(F.count(F.lit(1)).alias("n")))
    several = F.count(F.lit(1)) > 1
    known = catalog.groupBy("kind", "name").agg(
        *[F.when(several, "ambiguous").otherwise(F.first(c)).alias(c) for c in ("library", "slot")])
    return (counted.join(known, ["kind", "name"], "left")
            .groupBy("project", "kind", F.coalesce("library", F.lit("unknown")).alias("library"),
                     F.coalesce("slot", F.lit("unknown")).alias("slot"))
            .agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("names")))
