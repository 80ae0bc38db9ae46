"""Corpus views derived from the driver's tables.

The tables hold prose, web pages and an event log. The library works on source
files, requests, guides, manifests and stored records, so each of those is
derived from a table, one row per row, with the whole text kept. The
derivations are written in SQL that Spark and other engines read alike, which
lets a query and its check start from the same rows. ``{name}`` is a base
table; a plain name is an earlier view. Multi-valued fields are ``|`` lists
here and become arrays in ``Tables``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.operators.facets import facet_postings
from corpuslens.functions.text import request_keywords
from corpuslens.operators.incremental import extract_features, score_cases
from corpuslens.operators.recommend import recommend
from corpuslens.operators.rollup import project_rollup, project_values
from corpuslens.sources.store import written_once

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_WORD1 = "regexp_extract(text, '([A-Za-z][A-Za-z][A-Za-z]+)', 1)"
_WORD2 = "regexp_extract(text, '[A-Za-z][A-Za-z][A-Za-z]+[^A-Za-z]+([A-Za-z][A-Za-z][A-Za-z]+)', 1)"


def _pascal(word: str, default: str) -> str:
    return f"CASE WHEN {word} = '' THEN '{default}' ELSE upper(substr({word}, 1, 1)) || lower(substr({word}, 2)) END"


VIEWS = {
    # one source file per document: path, and code wrapped around the whole text
    "file_names": f"""
      SELECT doc_id, project, lang, n_chars, text, {_pascal('w1', 'Note')} AS p1, {_pascal('w2', 'Entry')} AS p2,
             CASE WHEN lang = 'en' AND n_chars < 1000 THEN 'pages'
                  WHEN lang = 'en' AND n_chars < 2000 THEN 'src/components/common'
                  WHEN lang = 'en' THEN 'composables'
                  WHEN lang = 'de' AND n_chars < 1000 THEN 'stores'
                  WHEN lang = 'de' AND n_chars < 2000 THEN 'src/api'
                  WHEN lang = 'de' THEN 'utils'
                  WHEN lang = 'fr' AND n_chars < 1000 THEN 'layouts'
                  WHEN lang = 'fr' AND n_chars < 2000 THEN 'src/pages'
                  WHEN lang = 'fr' THEN 'services'
                  WHEN n_chars < 1000 THEN 'types'
                  WHEN n_chars < 2000 THEN 'plugins'
                  ELSE 'components' END AS folder
      FROM (SELECT doc_id, source AS project, lang, n_chars, text, {_WORD1} AS w1, {_WORD2} AS w2 FROM {{documents}}) w""",
    "files": """
      SELECT doc_id, project, lang, n_chars, folder, p1, p2,
             folder || '/' || lower(p1) || '/'
               || CASE WHEN folder = 'composables' THEN 'use' ELSE '' END || p2
               || CASE WHEN folder LIKE '%pages' OR folder LIKE '%components%' THEN '.vue'
                       WHEN folder = 'types' THEN '.d.ts' WHEN folder = 'utils' THEN '.js'
                       WHEN folder = 'plugins' THEN '' ELSE '.ts' END AS path,
             '<template><El' || p1 || ' /><' || p2 || 'Card></template>' || chr(10)
               || '<script setup lang="ts">' || chr(10)
               || CASE lang WHEN 'en' THEN 'import {{ reactive, ref }} from ' || chr(39) || 'vue' || chr(39)
                            WHEN 'de' THEN 'import _ from ' || chr(39) || 'lodash' || chr(39)
                            WHEN 'fr' THEN 'import dayjs from ' || chr(39) || 'dayjs' || chr(39)
                            ELSE 'export default useStore(pinia)' END || chr(10)
               || 'interface ' || p1 || 'Dto {{}}' || chr(10) || 'type ' || p2 || ' = string' || chr(10)
               || 'const page: number = use' || p1 || '(1)' || chr(10)
               || CASE lang WHEN 'en' THEN 'client.get' || p1 || '(page)'
                            WHEN 'de' THEN 'useBackendClient().list' || p2 || '()'
                            WHEN 'fr' THEN 'axios.post(1); axios.get(2)'
                            ELSE 'fetch(1)' END || chr(10)
               || CASE WHEN n_chars < 1000 THEN '// TODO: search form' || chr(10)
                       WHEN n_chars < 2000 THEN '// todo list table' || chr(10) || '// TODO: modal' || chr(10)
                       ELSE 'try {{ await run() }} catch (e) {{ throw e }}' || chr(10) END
               || text || chr(10) || '</script>' AS content
      FROM file_names""",
    # what an annotator says about each file
    "file_meta": """
      SELECT f.doc_id, f.project, f.path, f.lang,
             CASE WHEN folder = 'composables' THEN 'composable' WHEN folder LIKE '%api' THEN 'api'
                  WHEN folder = 'utils' THEN 'utility' WHEN folder LIKE '%pages' THEN 'page'
                  WHEN folder LIKE '%components%' THEN 'component' ELSE 'other' END AS category,
             concat_ws('|', CASE WHEN lang = 'en' THEN 'composable-setup' END,
                            CASE WHEN n_chars > 2000 THEN 'error-recovery' END,
                            CASE WHEN n_chars < 1500 THEN 'api-client' END,
                            CASE WHEN lang = 'de' THEN 'interceptor' END,
                            CASE WHEN l.toxic = 1 THEN 'validation' END,
                            CASE WHEN l.quality = 1 THEN 'type-safe' END,
                            CASE WHEN lang = 'es' THEN 'store-module' END,
                            CASE WHEN lang = 'fr' AND n_chars > 3000 THEN 'computed-caching' END) AS patterns_s,
             concat_ws('|', 'vue3', CASE lang WHEN 'en' THEN 'pinia' WHEN 'de' THEN 'vuex'
                                              WHEN 'fr' THEN 'element-ui' END) AS frameworks_s,
             CASE WHEN lang = 'en' THEN 'grpc' WHEN lang = 'de' THEN 'openapi'
                  WHEN lang = 'fr' AND n_chars < 2000 THEN 'rest' WHEN lang = 'es' THEN 'none' END AS api_type,
             CASE lang WHEN 'en' THEN 'element-plus' WHEN 'de' THEN 'vuetify' END AS design_system,
             CASE lang WHEN 'de' THEN 'lodash' WHEN 'fr' THEN 'dayjs' WHEN 'es' THEN 'date-fns' END AS utility_library,
             concat_ws('|', 'get' || p1, CASE WHEN n_chars > 1500 THEN 'list' || p2 END) AS api_methods_s,
             CASE WHEN n_chars < 300 THEN 'trivial' WHEN n_chars < 1000 THEN 'low' WHEN n_chars < 2000 THEN 'medium'
                  WHEN n_chars < 5000 THEN 'high' ELSE 'very-high' END AS complexity,
             CASE WHEN lang = 'en' THEN 'high' WHEN lang = 'de' THEN 'medium' ELSE 'low' END AS reusability,
             CASE WHEN l.quality = 1 AND n_chars > 1000 THEN 'comprehensive' WHEN n_chars > 600 THEN 'basic'
                  ELSE 'none' END AS error_handling,
             CASE WHEN l.quality = 1 AND lang = 'en' THEN 'excellent' WHEN l.quality = 1 THEN 'good'
                  WHEN lang = 'de' THEN 'basic' ELSE 'poor' END AS type_definitions,
             concat_ws('|', CASE lang WHEN 'en' THEN '@grpc/grpc-js' WHEN 'de' THEN 'lodash-es'
                                      WHEN 'fr' THEN 'dayjs' END,
                            CASE WHEN n_chars > 1500 THEN 'element-plus' END) AS dependencies_s,
             concat_ws('|', 'El' || p1, p2 || 'Card') AS components_used_s,
             concat_ws('|', 'use' || p1, CASE WHEN n_chars > 2500 THEN 'use' || p2 END) AS composables_used_s,
             concat_ws('|', p1 || 'Dto', p2) AS entities_s,
             concat_ws('|', CASE WHEN n_chars < 1000 THEN 'detail' ELSE 'list' END,
                            CASE WHEN lang = 'en' THEN 'pagination' END) AS features_s,
             coalesce(l.quality, 0) = 1 AS is_excellent,
             CASE WHEN l.quality = 1 THEN concat_ws('|', 'Clean structure',
                  CASE WHEN lang = 'en' THEN 'Good API error handling' END,
                  CASE WHEN lang = 'fr' THEN 'UI design' END) ELSE '' END AS excellent_reasons_s,
             length(content) - length(replace(content, chr(10), '')) + 1 AS lines_of_code
      FROM files f LEFT JOIN {labels} l ON f.doc_id = l.doc_id""",
    # one request per user turn
    "request_words": f"""
      SELECT conv_id, turn, text, n, {_pascal('w1', 'Note')} AS p1 FROM
        (SELECT conv_id, turn, text, length(text) AS n, {_WORD1} AS w1 FROM {{conversations}} WHERE role = 'user') w""",
    "requests": """
      SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS request_id,
             text || CASE WHEN n < 150 THEN ' search list page' WHEN n < 300 THEN ' form with table and error state'
                          ELSE ' grpc client detail, cache and type interface' END AS description,
             CASE WHEN n < 100 THEN 'pagination' WHEN n < 200 THEN 'async' END AS target_function,
             CASE WHEN turn = 0 THEN 'page' WHEN n > 250 THEN 'composable' END AS file_role,
             p1 AS entity,
             CASE WHEN turn = 0 THEN 'pages/' WHEN n > 250 THEN 'composables/' ELSE 'src/components/' END
               || lower(p1) || '/index.vue' AS draft_path,
             CASE WHEN n < 200 THEN 'grpc' WHEN n < 300 THEN 'openapi' END AS api_type,
             concat_ws('|', 'guide-' || CAST(turn AS STRING), 'guide-' || CAST(CAST(floor(n / 10.0) AS INTEGER) AS STRING),
                            CASE WHEN n > 90 THEN 'guide-' || CAST(CAST(floor(n / 7.0) AS INTEGER) AS STRING) END) AS wanted_s
      FROM request_words""",
    # one guide per benchmark item
    "guide_words": f"""
      SELECT item_id, text, n, {_pascal('w1', 'Note')} AS p1, {_pascal('w2', 'Entry')} AS p2 FROM
        (SELECT item_id, text, length(text) AS n, {_WORD1} AS w1, {_WORD2} AS w2 FROM {{benchmark}}) w""",
    "guides": """
      SELECT 'guide-' || CAST(item_id AS STRING) AS id,
             CASE WHEN n < 120 THEN 'project' WHEN n < 160 THEN 'repo' WHEN n < 200 THEN 'org' ELSE 'global' END AS scope,
             CASE WHEN text LIKE '%hand%' THEN 'grpc' WHEN text LIKE '%ing%' THEN 'any' ELSE 'openapi' END AS api_type,
             concat_ws('|', lower(p1), CASE WHEN n < 150 THEN 'search' END, CASE WHEN n > 120 THEN 'form' END,
                            CASE WHEN text LIKE '%tion%' THEN 'grpc-client' END,
                            CASE WHEN text LIKE '%ea%' THEN 'element-plus' END) AS tags_s,
             CAST(CASE WHEN n > 250 THEN 100 ELSE n - 150 END AS INTEGER) AS priority,
             '2025.' || CASE WHEN n < 150 THEN '01' WHEN n < 200 THEN '06' ELSE '11' END || '.01' AS version,
             CASE WHEN n < 140 THEN 'guide-' || CAST(item_id + 1 AS STRING) ELSE '' END AS requires_s,
             CASE WHEN n > 180 THEN 'guide-' || CAST(item_id - 1 AS STRING) ELSE '' END AS excludes_s,
             p1 || ' ' || p2 || CASE WHEN n > 170 THEN ' list and table rules' ELSE ' lodash rules' END AS summary,
             n > 385 AS mandatory, text AS content, 'rules/' || lower(p1) || '.md' AS file_path
      FROM guide_words""",
    # a package.json per nation (depth 1) and per customer (depth 2)
    "manifests": """
      SELECT path, depth, '{{"name": "' || path || '", "dependencies": {{"vue": "3.4", ' || deps
             || '}}, "devDependencies": {{"typescript": "5.0", "vue": "3.5"' || dev || '}}}}' AS json
      FROM (
        SELECT 'n' || CAST(n_nationkey AS STRING) AS path, 1 AS depth,
               CASE WHEN n_regionkey = 0 THEN '"nuxt": "3.1"' ELSE '"vite": "5.0"' END AS deps, '' AS dev
        FROM {nation}
        UNION ALL
        SELECT 'n' || CAST(c_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING), 2,
               CASE c_mktsegment
                 WHEN 'BUILDING' THEN '"@grpc/grpc-js": "1.9", "nuxt": "3.2", "element-plus": "2.4"'
                 WHEN 'AUTOMOBILE' THEN '"@openapi/client": "1.0", "swagger-ui": "5.0", "vuetify": "3.3"'
                 WHEN 'MACHINERY' THEN '"axios": "1.6", "nuxt3": "3.0", "lodash-es": "4.1"'
                 WHEN 'HOUSEHOLD' THEN '"@grpc/proto-loader": "0.7", "swagger": "2.0"'
                 ELSE '"pinia": "2.1"' END,
               CASE WHEN c_acctbal < 0 THEN ', "@vueuse/core": "10.0", "naive-ui": "2.3"'
                    WHEN c_acctbal < 5000 THEN ', "dayjs": "1.11", "@nuxt/core": "2.1"' ELSE '' END
        FROM {customer}) m""",
    # one exemplar per web page
    "page_urls": """
      SELECT page_id, url, html,
             regexp_extract(url, '://([^/?#]+)', 1) AS host,
             regexp_extract(url, '://[^/?#]+/([a-z]+)/', 1) AS lang,
             regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS url_path,
             CAST('0' || regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS n
      FROM {pages}""",
    "cases": """
      SELECT page_id AS id, host AS project, url_path,
             CASE WHEN host LIKE 'm.%' THEN 'list' WHEN host LIKE 'www.%' THEN 'detail'
                  WHEN host LIKE 'blog.%' AND lang = 'en' THEN 'table-browse'
                  WHEN lang = 'fr' THEN 'form-edit' WHEN lang = 'es' THEN 'dashboard' WHEN lang = 'de' THEN 'Profile'
                  ELSE 'search-index' END AS category,
             CASE WHEN url LIKE '%.html' THEN 'grpc' WHEN url LIKE '%/' THEN 'openapi'
                  WHEN url LIKE '%utm%' THEN 'mixed' WHEN url LIKE '%#%' THEN 'none' END AS api_type,
             CASE WHEN host LIKE '%.com' THEN 'element-plus' WHEN host LIKE '%.net' THEN 'vuetify' END AS design_system,
             concat_ws('|', 'vue3', CASE WHEN n > 500 THEN 'pinia' END, CASE WHEN lang = 'de' THEN 'vuex' END) AS frameworks_s,
             concat_ws('|', lang, CASE WHEN n < 400 THEN 'search' END, CASE WHEN n > 700 THEN 'form' END) AS tags_s,
             CASE WHEN n > 100 THEN CAST(n - 1 AS DOUBLE) / 10 END AS raw_score
      FROM page_urls""",
    # files that belong to an exemplar
    "case_files": """
      SELECT doc_id, CAST(floor(doc_id / 4.0) AS BIGINT) AS case_id, path, content,
             CASE WHEN lang = 'en' THEN 'paging of ' || p1 ELSE p2 || ' view' END AS purpose
      FROM files""",
    # stored project records of several historical shapes, one per order
    "records": """
      SELECT CAST(o_orderkey AS STRING) AS id,
             CASE WHEN o_totalprice < 3000 THEN NULL ELSE 'p' || CAST(o_custkey AS STRING) END AS project_name,
             CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE lower(substr(o_orderpriority, 3)) END AS category,
             CASE o_orderstatus WHEN 'O' THEN 'scored' WHEN 'F' THEN 'metadata'
                  ELSE CASE WHEN o_totalprice < 60000 THEN 'none' ELSE 'legacy' END END AS shape,
             CASE WHEN o_orderstatus = 'O' AND o_totalprice > 250000 THEN '1.0.0'
                  WHEN o_orderstatus = 'O' THEN '2.0.0' END AS scoring_version,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'grpc' WHEN '2-HIGH' THEN 'openapi' ELSE 'none' END AS legacy_api,
             o_orderpriority = '3-MEDIUM' AS has_framework,
             CAST(floor(o_totalprice / 5000) AS INTEGER) AS stored_total,
             CAST(floor(o_totalprice) AS INTEGER) AS amount, o_orderdate AS created_at, o_custkey AS custkey
      FROM {orders}""",
    # keyed store with timestamped ids, one record per event
    "stamped_ids": """
      SELECT CASE WHEN event_type = 'view' THEN 'p' || CAST(user_id AS STRING) || '--view-' || CAST(event_id AS STRING) || '-ts'
                  WHEN event_type = 'signup' THEN 'p' || CAST(user_id AS STRING) || '--signup-ts-' || CAST(1400000000000 + event_id AS STRING)
                  ELSE 'p' || CAST(user_id AS STRING) || '--' || event_type || '-vue-' || CAST(1700000000000 + event_id AS STRING) END AS old_id,
             ts AS analyzed_at
      FROM {events}""",
    # scan failures, one per error event
    "failures": """
      SELECT event_id, user_id AS project, 'src/f' || CAST(event_id AS STRING) || '.ts' AS path,
             CASE WHEN value < 5 THEN 0 WHEN value < 10 THEN 1 WHEN value < 20 THEN 2 ELSE 3 END AS retry_count
      FROM {events} WHERE event_type = 'error'""",
    # local packages, one per part
    "packages": """
      SELECT p_partkey AS id, p_name AS package_name,
             CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'design-system' WHEN p_type IN ('STANDARD', 'LARGE') THEN 'utility'
                  ELSE 'hybrid' END AS type, p_size > 25 AS analyzed
      FROM {part}""",
    # module files that register component directories and aliases
    "modules": """
      SELECT doc_id, project,
             'addComponentsDir({{ path: resolve(root, "' || lower(p1) || '"), prefix: "' || p2 || '" }})' || chr(10)
               || 'export {{ ' || p1 || ' as ' || p2 || 'Alias }}' AS content
      FROM file_names WHERE lang <> 'en'""",
    # stored snapshot of the files: the labelled ones. Low quality ones were
    # stored with other text, toxic ones by an older scorer.
    "stored": """
      SELECT f.doc_id, CASE WHEN l.toxic = 1 THEN '1.0.0' ELSE '2.0.0' END AS scoring_version,
             CASE WHEN l.quality = 0 THEN f.content || chr(10) ELSE f.content END AS content,
             '2025-01-01 00:00:00' AS created_at
      FROM files f JOIN {labels} l ON f.doc_id = l.doc_id""",
}

DEPENDS = {
    "files": ["file_names"], "file_meta": ["file_names", "files"], "requests": ["request_words"],
    "guides": ["guide_words"], "cases": ["page_urls"], "case_files": ["file_names", "files"], "modules": ["file_names"],
    "stored": ["file_names", "files"],
}


def view_sql(*names: str) -> str:
    """``WITH`` clause that defines the named views and what they need."""
    needed: list[str] = []
    for name in names:
        for n in [*DEPENDS.get(name, []), name]:
            if n not in needed:
                needed.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)


def _list(field: str) -> Column:
    return F.filter(F.split(field, r"\|"), lambda x: x != "")


class Tables:
    """The driver's tables and the corpus views, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    def file_stream(self, documents: DataFrame) -> DataFrame:
        """The file view over a stream of documents."""
        return self.view("files", documents=documents)

    def view(self, name: str, **tables: DataFrame) -> DataFrame:
        sql = f"{view_sql(name)} SELECT * FROM {name}"
        used = {t: tables.get(t) or getattr(self, t) for t in BASE_TABLES if "{" + t + "}" in sql}
        df = self.spark.sql(sql, **used)
        lists = {c[:-2]: _list(c) for c in df.columns if c.endswith("_s")}
        return df.withColumns(lists).drop(*[c for c in df.columns if c.endswith("_s")]) if lists else df

    @cached_property
    def features(self) -> DataFrame:
        """Files with everything extracted from their text, one narrow stage."""
        return extract_features(self.files)

    @cached_property
    def case_store(self) -> DataFrame:
        """Scored file records, written once; texts stay with the files."""
        return written_once(self.spark, f"cases-{self.sf_dir}", lambda: score_cases(self.features).drop("content", "low"))

    @cached_property
    def postings(self) -> DataFrame:
        """Posting table of the file records, partitioned by facet."""
        facets = {"project": "project", "excellence": "excellent_in", "tag": "keywords", "grade": "grade"}
        return written_once(self.spark, f"postings-{self.sf_dir}",
                            lambda: facet_postings(self.case_store, facets, "doc_id"), ["facet"])

    @cached_property
    def project_values(self) -> DataFrame:
        """Distinct metadata values per project, written once."""
        return written_once(self.spark, f"project-values-{self.sf_dir}", lambda: project_values(self.file_meta))

    @cached_property
    def project_rollup(self) -> DataFrame:
        """One row per project, written once."""
        return written_once(self.spark, f"rollup-{self.sf_dir}", lambda: project_rollup(self.project_values))

    @cached_property
    def request_rows(self) -> DataFrame:
        """Requests with their extracted keywords."""
        low = self.requests.withColumn("low", F.lower("description"))
        return low.withColumn("keywords", request_keywords(F.col("low"), F.col("target_function")))

    @cached_property
    def hits(self) -> DataFrame:
        """Recommended records per request, written once."""
        asked = self.request_rows.withColumn("entities", F.array("entity"))
        return written_once(self.spark, f"hits-{self.sf_dir}", lambda: recommend(asked, self.case_store))
