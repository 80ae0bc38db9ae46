"""Queries: derived columns over paths and text."""

from pyspark.sql import Column, functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.operators import lines as L, packages as P
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.registry import query


def joined(values: Column, sep: str = ",") -> Column:
    """Sorted distinct list as one string, comparable across engines."""
    return F.array_join(F.array_sort(F.array_distinct(values)), sep)


FILES = ("files",)
META = ("file_meta",)


@query("file_id", f"SELECT id AS page_id, {Q.FILE_ID.replace('path', 'url_path')} AS file_id FROM cases", ("cases",))
def _(t):
    return t.cases.select(F.col("id").alias("page_id"), X.file_id(F.col("project"), F.col("url_path")).alias("file_id"))


@query("file_type", f"SELECT doc_id, path, {Q.FILE_TYPE} AS file_type FROM files", FILES)
def _(t):
    return t.files.select("doc_id", "path", X.file_type(F.col("path")).alias("file_type"))


@query("file_role", f"SELECT doc_id, {Q.file_role('path')} AS file_role, {Q.file_role('path', True)} AS strict_role "
                    "FROM files", FILES)
def _(t):
    p = F.col("path")
    return t.files.select("doc_id", X.file_role(p).alias("file_role"), X.file_role(p, strict=True).alias("strict_role"))


_low = "lower(path)"
CATEGORY_10 = Q.case([
    ("page", f"{Q.has_dir(_low, 'pages')} OR contains({_low}, '.page.')"),
    ("shared-component", f"({Q.has_dir(_low, 'components')} OR {_low} LIKE '%.vue') AND {Q.any_of(_low, ['common', 'shared'])}"),
    ("component", f"{Q.has_dir(_low, 'components')} OR {_low} LIKE '%.vue'"),
    ("composable", f"{Q.has_dir(_low, 'composables')} OR contains({_low}, 'use')"),
    ("api", f"{Q.has_dir(_low, 'api')} OR {Q.has_dir(_low, 'server')}"),
    ("type", f"{Q.has_dir(_low, 'types')} OR {_low} LIKE '%.d.ts'"),
    ("store", f"{Q.has_dir(_low, 'stores')} OR {Q.has_dir(_low, 'store')}"),
    ("utility", f"{Q.has_dir(_low, 'utils')} OR {Q.has_dir(_low, 'helpers')}"),
    ("service", Q.has_dir(_low, "services")),
], "other")


@query("file_category_10", f"SELECT doc_id, {CATEGORY_10} AS category FROM files", FILES)
def _(t):
    return t.files.select("doc_id", X.file_category(F.col("path")).alias("category"))


@query("file_category_5", "SELECT doc_id, " + Q.case([
    ("composable", "contains(path, 'composables')"), ("api", "contains(path, '/api/')"),
    ("utility", "contains(path, 'utils')"), ("page", "contains(path, 'pages')")], "other") + " AS category FROM files", FILES)
def _(t):
    return t.files.select("doc_id", X.annotation_category(F.col("path")).alias("category"))


@query("keyword_tags", f"SELECT doc_id, {Q.joined('keywords')} AS keywords, len(keywords) AS n_keywords FROM features",
       FILES, Q.FEATURES)
def _(t):
    low = t.files.select("doc_id", F.lower("content").alias("low"))
    tagged = low.select("doc_id", X.tag(F.col("low")).alias("k"))
    return tagged.select("doc_id", joined(F.col("k")).alias("keywords"), F.size("k").cast("bigint").alias("n_keywords"))


REQUEST_TAGS = Q.tags("low", R.REQUEST_RULES, [])
REQUESTS = {
    "req0": "SELECT *, lower(description) AS low FROM requests",
    "req": f"SELECT *, list_distinct(list_concat({REQUEST_TAGS}, {Q.present(['target_function'])})) AS keywords FROM req0",
}


@query("request_keywords", f"SELECT request_id, {Q.joined('keywords')} AS keywords FROM req", ("requests",), REQUESTS)
def _(t):
    low = t.requests.withColumn("low", F.lower("description"))
    return low.select("request_id", joined(X.request_keywords(F.col("low"), F.col("target_function"))).alias("keywords"))


@query("todo_hints", "SELECT doc_id, coalesce(array_to_string(flatten(list_transform("
       "regexp_extract_all(content, '(?i)TODO[:\\s]+([^\\n]+)'), lambda s: "
       + Q.present([f"CASE WHEN {Q.any_of('lower(s)', n)} THEN {Q.lit(k)} END" for k, n in R.TODO_RULES])
       + ")), ','), '') AS hints FROM files", FILES)
def _(t):
    return t.files.select("doc_id", F.array_join(X.todo_hints(F.col("content")), ",").alias("hints"))


@query("path_entities", "SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_transform("
       "string_split(path, '/'), lambda s: regexp_replace(s, '\\.(vue|ts|tsx|js)$', '')), "
       "lambda s: s <> 'index' AND length(s) > 2), lambda s: upper(s[1]) || s[2:]), "
       "lambda s: s NOT IN ('Pages', 'Components', 'Composables', 'Stores')), ',') AS entities FROM files", FILES)
def _(t):
    return t.files.select("doc_id", F.array_join(X.path_entities(F.col("path")), ",").alias("entities"))


@query("path_role_hint", "SELECT request_id, " + Q.case(
    [(r, f"contains(draft_path, {Q.lit(n)})") for r, n in reversed(R.ROLE_HINTS)], "page") + " AS last_hint, "
    + Q.case([(r, f"contains(draft_path, {Q.lit(n)})") for r, n in R.ROLE_HINTS], "page") + " AS first_hint FROM requests",
    ("requests",))
def _(t):
    p = F.col("draft_path")
    return t.requests.select("request_id", X.role_hint(p).alias("last_hint"), X.role_hint(p, False).alias("first_hint"))


def _extracted(name, sql, build):
    @query(name, f"SELECT doc_id, {Q.joined(sql)} AS found FROM feat0", FILES, {"feat0": Q.FEATURES["feat0"]})
    def _(t):
        return t.files.select("doc_id", joined(build(F.col("content"))).alias("found"))


_extracted("code_entities", Q.CODE_ENTITIES, X.code_entities)
_extracted("api_methods", Q.API_METHODS, X.api_methods)
_extracted("components_used", Q.COMPONENTS, X.components_used)
_extracted("composables_used", Q.COMPOSABLES, X.composables_used)


@query("split_sfc", "SELECT page_id, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS script, "
                    "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS article, "
                    "regexp_extract(html, '(?s)<template[^>]*>(.*?)</template>', 1) AS template FROM pages")
def _(t):
    return t.pages.select("page_id", *[X.split_block(F.col("html"), b).alias(b) for b in ("script", "article", "template")])


@query("line_count", "SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents")
def _(t):
    return t.documents.select("doc_id", X.line_count(F.col("text")).alias("lines"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("complexity_bucket", "SELECT doc_id, " + Q.case(
    [(c, f"len(string_split(content, chr(10))) < {b}") for c, b in R.COMPLEXITY_BOUNDS], "very-high")
    + " AS complexity FROM files", FILES)
def _(t):
    lines = t.files.select("doc_id", X.line_count(F.col("content")).alias("lines"))
    return lines.select("doc_id", X.complexity(F.col("lines")).alias("complexity"))


def _detect_sql(entries, out):
    scored = ", ".join(
        "{'n': " + " + ".join(f"len(regexp_extract_all(content, {Q.lit(p)}))" for p in pats)
        + f", 'o': {-i}, 'lib': {Q.lit(lib)}}}" for i, (lib, pats) in enumerate(entries))
    return f"(SELECT CASE WHEN b.n > 0 THEN b.lib END FROM (SELECT list_max([{scored}]) AS b)) AS {out}"


CUSTOM_LIBRARIES = [("house-kit", [r"[A-Z]\w+Card", r"house-kit"]), ("house-utils", [r"[a-z]+tion"])]


@query("detect_library", f"SELECT doc_id, {_detect_sql(R.DESIGN_SYSTEM_PATTERNS, 'design_system')}, "
                         f"{_detect_sql(R.UTILITY_PATTERNS, 'utility_library')} FROM files", FILES)
def _(t):
    c = F.col("content")
    return t.files.select("doc_id", X.detect_library(c, R.DESIGN_SYSTEM_PATTERNS).alias("design_system"),
                          X.detect_library(c, R.UTILITY_PATTERNS).alias("utility_library"))


@query("detect_library_custom", "SELECT doc_id, "
       f"{_detect_sql(R.DESIGN_SYSTEM_PATTERNS + CUSTOM_LIBRARIES, 'design_system')} FROM files", FILES)
def _(t):
    return t.files.select("doc_id", X.detect_library(
        F.col("content"), R.DESIGN_SYSTEM_PATTERNS, CUSTOM_LIBRARIES).alias("design_system"))


MANIFESTS = {"deps": """SELECT path, depth, list_distinct(list_concat(json_keys(json, '$.dependencies'),
        json_keys(json, '$.devDependencies'))) AS packages FROM manifests"""}
_GRPC = f"len(list_filter(packages, lambda d: {Q.any_of('d', R.GRPC_PACKAGES)})) > 0"
_OPEN = f"len(list_filter(packages, lambda d: {Q.any_of('d', R.OPENAPI_PACKAGES)})) > 0"
_REST = f"list_has_any(packages, ['axios', 'fetch', 'ky'])"
API_TYPE = Q.case([("mixed", f"{_GRPC} AND {_OPEN}"), ("grpc", _GRPC), ("openapi", _OPEN), ("rest", _REST)], "unknown")


@query("manifest_api_type", f"""SELECT path, {API_TYPE} AS api_type,
       {Q.case([("high", f"{_GRPC} OR {_OPEN}"), ("medium", _REST)], "low")} AS confidence,
       {Q.joined("list_filter(packages, lambda d: " + Q.any_of('d', R.GRPC_PACKAGES + R.OPENAPI_PACKAGES)
                 + " OR d IN ('axios', 'fetch', 'ky'))")} AS api_packages FROM deps""", ("manifests",), MANIFESTS)
def _(t):
    return P.manifest_api_type(P.parse_manifests(t.manifests)).select(
        "path", "api_type", "confidence", joined(F.col("api_packages")).alias("api_packages"))


SYSTEMS = "[" + ", ".join(map(Q.lit, R.KNOWN_DESIGN_SYSTEMS)) + "]"


@query("manifest_libraries", f"""SELECT path,
       {Q.joined(f"list_filter(packages, lambda d: list_contains({SYSTEMS}, d))")} AS design_systems,
       {Q.joined("list_filter(packages, lambda d: " + Q.any_of('d', R.KNOWN_UTILITIES) + ")")} AS utilities,
       list_filter(ordered, lambda d: list_contains({SYSTEMS}, d))[1] AS design_system,
       list_filter(ordered, lambda d: {Q.any_of('d', R.KNOWN_UTILITIES)})[1] AS utility_library
       FROM (SELECT *, list_concat(json_keys(json, '$.dependencies'), json_keys(json, '$.devDependencies')) AS ordered,
                    list_distinct(ordered) AS packages FROM manifests)""", ("manifests",))
def _(t):
    return P.manifest_libraries(P.parse_manifests(t.manifests)).select(
        "path", joined(F.col("design_systems")).alias("design_systems"), joined(F.col("utilities")).alias("utilities"),
        "design_system", "utility_library")


@query("read_manifests", """SELECT path, unnest(packages) AS package,
       coalesce(json_extract_string(json, '$.devDependencies."' || package || '"'),
                json_extract_string(json, '$.dependencies."' || package || '"')) AS version
       FROM (SELECT path, json, list_distinct(list_concat(json_keys(json, '$.dependencies'),
             json_keys(json, '$.devDependencies'))) AS packages FROM manifests)""", ("manifests",))
def _(t):
    return P.dependencies(P.parse_manifests(t.manifests), "path")


@query("discover_projects", """SELECT m.path, m.depth FROM marked m WHERE m.depth = 1 OR NOT EXISTS
       (SELECT 1 FROM marked p WHERE p.depth = 1 AND p.path = string_split(m.path, '/')[1])""", ("manifests",),
       {**MANIFESTS, "marked": "SELECT * FROM deps WHERE list_has_any(packages, ['nuxt', 'nuxt3', '@nuxt/core'])"})
def _(t):
    return P.discover_projects(P.parse_manifests(t.manifests))


NAMING = {
    "blocks": r"""SELECT project, doc_id AS m, generate_subscripts(b, 1) AS pos, unnest(b) AS block FROM
        (SELECT *, regexp_extract_all(content, 'addComponentsDir\s*\(\s*\{([^}]+)\}\s*\)', 1) AS b FROM modules)""",
    "prefixes": r"""SELECT project, segment, min((m, pos)) AS first, arg_max(prefix, (m, pos)) AS prefix FROM
        (SELECT project, m, pos, lower(regexp_extract(block, 'resolve\([^)]*"([^"]+)"\)', 1)) AS segment,
                regexp_extract(block, 'prefix:\s*"(\w+)"', 1) AS prefix FROM blocks)
        WHERE segment <> '' AND prefix <> '' GROUP BY ALL""",
    "aliases": r"""SELECT project, regexp_extract(content, '(\w+)\s+as\s+(\w+)', 1) AS file_name,
        arg_max(regexp_extract(content, '(\w+)\s+as\s+(\w+)', 2), doc_id) AS alias FROM modules GROUP BY ALL""",
    "named": r"""SELECT doc_id, project, path,
        regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.(vue|tsx?)$', '') AS file_name FROM files""",
    "segments": "SELECT doc_id, project, unnest(list_distinct(string_split(lower(path), '/'))) AS segment FROM files",
    "by_dir": """SELECT doc_id, arg_min(prefix, first) AS prefix FROM segments JOIN prefixes USING (project, segment)
        GROUP BY doc_id""",
    "names": """SELECT n.doc_id, n.project, n.path, n.file_name,
        coalesce(alias, prefix || n.file_name, n.file_name) AS name
        FROM named n LEFT JOIN aliases USING (project, file_name) LEFT JOIN by_dir USING (doc_id)""",
}


@query("component_naming", "SELECT doc_id, project, path, file_name, name FROM names", ("files", "modules"), NAMING)
def _(t):
    return P.name_components(t.files, t.modules)


@query("item_category", f"""SELECT kind, name, count(*) AS n,
       CASE kind WHEN 'component' THEN {Q.case([(c, Q.any_of('lower(name)', n)) for c, n in R.COMPONENT_CATEGORIES], 'other')}
       ELSE {Q.case([(c, Q.any_of('lower(name)', n)) for c, n in R.FUNCTION_CATEGORIES], 'utility')} END AS category
       FROM (SELECT 'component' AS kind, unnest({Q.split('components_used_s')}) AS name FROM file_meta
             UNION ALL SELECT 'function', unnest({Q.split('api_methods_s')}) FROM file_meta) GROUP BY kind, name""", META)
def _(t):
    m = t.file_meta
    items = (m.select(F.lit("component").alias("kind"), F.explode("components_used").alias("name"))
             .unionByName(m.select(F.lit("function").alias("kind"), F.explode("api_methods").alias("name"))))
    return items.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "category", F.when(F.col("kind") == "component", X.component_category(F.col("name")))
        .otherwise(X.function_category(F.col("name"))))


@query("name_prefix", f"""SELECT doc_id, name, coalesce(nullif(regexp_extract(name, '^([A-Z][a-z]+)[A-Z]', 1), ''),
       nullif(regexp_extract(name, '^([A-Z][a-z]?)[A-Z]', 1), '')) AS prefix
       FROM (SELECT doc_id, unnest({Q.split('components_used_s')}) AS name FROM file_meta)""", META)
def _(t):
    return t.file_meta.select("doc_id", F.explode("components_used").alias("name")).withColumn(
        "prefix", X.name_prefix(F.col("name")))


def _listed(label, field):
    return f"CASE WHEN {field}_s <> '' THEN '{label}: ' || replace({field}_s, '|', ', ') END"


EMBEDDING_TEXT = ("concat_ws('. ', 'File role: ' || category, " + ", ".join(
    _listed(label, f) for label, f in [("API methods", "api_methods"), ("Components", "components_used"),
                                       ("Composables", "composables_used"), ("Patterns", "patterns"),
                                       ("Entities", "entities")]) + ")")


@query("embedding_text", f"SELECT doc_id, {EMBEDDING_TEXT} AS summary FROM file_meta", META)
def _(t):
    return t.file_meta.select("doc_id", X.embedding_text(
        F.col("category"), api_methods=F.col("api_methods"), components=F.col("components_used"),
        composables=F.col("composables_used"), patterns=F.col("patterns"), entities=F.col("entities")).alias("summary"))


@query("query_text", "SELECT request_id, concat_ws('. ', description, 'Target function: ' || target_function, "
                     "'Entities: ' || entity) AS query_text FROM requests", ("requests",))
def _(t):
    return t.requests.select("request_id", X.query_text(
        F.col("description"), F.col("target_function"), F.array("entity")).alias("query_text"))


META_WORDS = "list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(" \
    f"{Q.split('patterns_s')}, {Q.split('frameworks_s')}), {Q.present(['api_type'])}), {Q.split('features_s')}), " \
    f"{Q.split('api_methods_s')}[1:5]), {Q.split('entities_s')}), " \
    "CASE WHEN complexity = 'high' THEN ['complex', 'advanced'] ELSE [] END), " \
    "CASE WHEN error_handling = 'comprehensive' THEN ['error-handling', 'recovery', 'resilience'] ELSE [] END)"


@query("metadata_keywords", f"SELECT doc_id, {Q.joined(f'list_transform({META_WORDS}, lambda w: lower(w))')} AS keywords "
                            "FROM file_meta", META)
def _(t):
    c = F.col
    return t.file_meta.select("doc_id", joined(X.metadata_keywords(
        c("patterns"), c("frameworks"), c("api_type"), c("features"), c("api_methods"), c("entities"),
        c("complexity"), c("error_handling"), k_methods=5)).alias("keywords"))


@query("metadata_keywords_whole",
       f"SELECT doc_id, {Q.joined(f'list_transform({META_WORDS.replace(chr(91) + "1:5" + chr(93), "")}, lambda w: lower(w))')} AS keywords "
       "FROM file_meta", META)
def _(t):
    c = F.col
    return t.file_meta.select("doc_id", joined(X.metadata_keywords(
        c("patterns"), c("frameworks"), c("api_type"), c("features"), c("api_methods"), c("entities"),
        c("complexity"), c("error_handling"))).alias("keywords"))


_GUIDE_WORDS = "list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(" \
    f"{Q.split('patterns_s')}, {Q.split('frameworks_s')}), {Q.split('entities_s')}), {Q.split('features_s')}), " \
    f"{Q.present(['category', 'api_type'])}), CASE WHEN design_system IS NOT NULL THEN [design_system, 'design-system'] ELSE [] END), " \
    "CASE WHEN utility_library IS NOT NULL THEN [utility_library, 'utility'] ELSE [] END)"


@query("guide_keywords", f"SELECT doc_id, {Q.joined(_GUIDE_WORDS)} AS keywords FROM file_meta", META)
def _(t):
    c = F.col
    return t.file_meta.select("doc_id", joined(X.guide_keywords(
        c("patterns"), c("frameworks"), c("entities"), c("features"), c("category"), c("api_type"),
        c("design_system"), c("utility_library"))).alias("keywords"))


STRIP = ("CASE WHEN regexp_matches(old_id, '-[0-9]{13}$') AND CAST(right(old_id, 13) AS BIGINT) > 1577836800000 "
         "THEN left(old_id, -14) END")


@query("strip_id_timestamp", f"SELECT old_id, {STRIP} AS new_id FROM stamped_ids", ("stamped_ids",))
def _(t):
    return t.stamped_ids.select("old_id", X.strip_timestamp(F.col("old_id")).alias("new_id"))


@query("grep_lines", r"""SELECT doc_id,
       array_to_string(list_filter(l, lambda x: regexp_matches(x, 'const page|import.*lodash'))[1:10], '~') AS definitions,
       array_to_string(list_filter(l, lambda x: regexp_matches(x, '[uU]se[A-Z][a-z]+\(') AND NOT regexp_matches(x, '^\s*//'))[1:5], '~') AS usages,
       array_to_string(l[1:30], chr(10)) AS preview
       FROM (SELECT doc_id, content, string_split(content, chr(10)) AS l FROM files) WHERE contains(content, 'use')""", FILES)
def _(t):
    g = L.grep_lines(t.files.select("doc_id", "content"), "use", "const page|import.*lodash", r"[uU]se[A-Z][a-z]+\(", "content",
                     k_definitions=10, k_usages=5, preview=30)
    return g.select("doc_id", F.array_join("definitions", "~").alias("definitions"),
                    F.array_join("usages", "~").alias("usages"), "preview")


@query("grep_lines_whole", r"""SELECT doc_id,
       array_to_string(list_filter(l, lambda x: regexp_matches(x, 'const page|import.*lodash')), '~') AS definitions,
       array_to_string(list_filter(l, lambda x: regexp_matches(x, '[uU]se[A-Z][a-z]+\(') AND NOT regexp_matches(x, '^\s*//')), '~') AS usages,
       content AS preview
       FROM (SELECT doc_id, content, string_split(content, chr(10)) AS l FROM files) WHERE contains(content, 'use')""", FILES)
def _(t):
    g = L.grep_lines(t.files.select("doc_id", "content"), "use", "const page|import.*lodash", r"[uU]se[A-Z][a-z]+\(", "content")
    return g.select("doc_id", F.array_join("definitions", "~").alias("definitions"),
                    F.array_join("usages", "~").alias("usages"), "preview")


FLAGS = {
    "has_vue_import": r"import\s*\{[^}]*reactive[^}]*ref[^}]*\}\s*from\s*['\"]vue['\"]",
    "has_composable_call": r"use[A-Z]\w+\(", "has_try": r"(?s)try\s*\{.*catch", "has_email": r"[a-z]+@[a-z]+\.[a-z]+",
}


@query("regex_flags", "SELECT doc_id, " + ", ".join(f"regexp_matches(content, {Q.lit(p)}) AS {n}" for n, p in FLAGS.items())
       + " FROM files", FILES)
def _(t):
    return t.files.select("doc_id", *X.regex_flags(F.col("content"), FLAGS))


HREF = 'href="([^"]+)"'
LINKS = {
    "html_lines": "SELECT page_id, generate_subscripts(l, 1) AS line, unnest(l) AS line_text FROM "
                  "(SELECT page_id, string_split(html, chr(10)) AS l FROM pages)",
    "raw_links": f"SELECT page_id, line, generate_subscripts(m, 1) - 1 AS nth, unnest(m) AS raw FROM "
                 f"(SELECT *, regexp_extract_all(line_text, '{HREF}', 1) AS m FROM html_lines)",
    "links": "SELECT page_id, line, nth, regexp_replace(raw, '#.*$', '') AS target FROM raw_links "
             "WHERE NOT regexp_matches(raw, '^(https?://|#)')",
}


@query("extract_links", "SELECT page_id, line, nth, target FROM links", (), LINKS)
def _(t):
    return L.extract_links(t.pages, "page_id", "html", HREF)


@query("broken_links", "SELECT page_id, line, nth, target FROM links WHERE regexp_replace(target, '^/', '') NOT IN "
       "(SELECT regexp_replace(url_path, '^/', '') FROM page_urls UNION SELECT lower(p1) FROM file_names)",
       ("page_urls", "file_names"), LINKS)
def _(t):
    listing = t.page_urls.select(F.col("url_path").alias("path")).unionByName(
        t.file_names.select(F.lower("p1").alias("path")))
    return L.broken_links(L.extract_links(t.pages, "page_id", "html", HREF), listing)
