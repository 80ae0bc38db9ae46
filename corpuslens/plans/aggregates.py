"""Queries: aggregations over files, records and events."""

from pyspark.sql import functions as F

from corpuslens.functions import rules as R, scoring as S, text as X
from corpuslens.operators import facets as A, incremental as I, packages as P, rollup as U
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.features import FILES, META, NAMING, joined
from corpuslens.plans.registry import query
from corpuslens.plans.scores import ROLLUP, project_rows, scored
from corpuslens.sources import observed as W


def _pairs_sql(field):
    return (f"(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT {field} AS v, count(*) AS n FROM file_meta m "
            f"WHERE m.project = p.project GROUP BY 1))")


_ROLL = ["project", "total_files", "total_lines_of_code", "categories", "api_type", "design_system", "utility_library",
         "complexity", "files_with_good_error_handling", "files_with_good_types", "excellent_files"]


@query("project_rollup", f"SELECT {', '.join(_ROLL)}, {', '.join(f'{f} AS n_{f}' for f in U.LIST_FIELDS)}, "
       f"{_pairs_sql('category')} AS files_by_category, {_pairs_sql('complexity')} AS complexity_distribution "
       "FROM proj p", META, ROLLUP)
def _(t):
    def pairs(m):
        entries = F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return F.array_join(F.array_sort(entries), ",").alias(m)
    return project_rows(t).select(*_ROLL, *[F.col(f).alias(f"n_{f}") for f in U.LIST_FIELDS],
                                  pairs("files_by_category"), pairs("complexity_distribution"))


@query("project_rollup_values", "SELECT project, field, value, count(DISTINCT doc_id) AS files, min(doc_id) AS first_seen "
       "FROM long_values GROUP BY ALL", META, ROLLUP)
def _(t):
    return t.project_values.filter(F.col("field").isin(U.LIST_FIELDS)).select(
        "project", "field", "value", "files", "first_seen")


@query("project_excellent_files", f"SELECT project, doc_id, path, {Q.joined(Q.split('excellent_reasons_s'), '; ')} AS reasons, "
       f"{Q.joined(Q.split('patterns_s'))} AS patterns FROM file_meta WHERE is_excellent", META)
def _(t):
    return t.file_meta.filter("is_excellent").select(
        "project", "doc_id", "path", joined(F.col("excellent_reasons"), "; ").alias("reasons"),
        joined(F.col("patterns")).alias("patterns"))


@query("dominant_value", """SELECT o_custkey, arg_max(o_orderpriority, (n, -o)) AS dominant, max(n) AS n FROM
       (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def _(t):
    return U.dominant(t.orders, "o_custkey", "o_orderpriority", "o_orderkey")


_IDX = Q.lookup("complexity", {v: i for i, v in enumerate(R.COMPLEXITY_LEVELS)})


@query("average_ordinal", "SELECT project, " + Q.case([(v, f"floor(avg({_IDX}) + 0.5) = {i}") for i, v in enumerate(R.COMPLEXITY_LEVELS)], None)
       + " AS average_level FROM file_meta GROUP BY project", META)
def _(t):
    return U.average_level(t.file_meta, "project", "complexity")


# file records by facet; tags are the keywords
CASE_FACETS = {"project": "project", "excellence": "excellent_in", "tag": "keywords", "grade": "grade"}
FILE_FACETS = {"project": "project", "keyword": "keywords", "type": "file_type", "role": "file_role", "entity": "entities"}


def _posting_sql(facets, lists, source):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS facet, {'unnest(list_distinct(' + c + '))' if c in lists else c} AS term, doc_id FROM {source}"
        for f, c in facets.items())


POSTINGS = {**Q.SCORED, "postings": _posting_sql(CASE_FACETS, ("excellent_in", "keywords"), "graded")}


@query("build_facet_index", "SELECT facet, term, doc_id FROM postings", FILES, POSTINGS)
def _(t):
    return A.facet_postings(scored(t), CASE_FACETS, "doc_id")


@query("build_file_facet_index", _posting_sql(FILE_FACETS, ("keywords", "entities"), "features"), FILES, Q.FEATURES)
def _(t):
    return A.facet_postings(t.features, FILE_FACETS, "doc_id")


_CLOSED = ", ".join([f"('excellence', '{d}')" for d in R.DIMENSIONS]
                    + [f"('grade', '{g}')" for g in ("excellent", "good", "fair", "poor")])


@query("facet_stats", f"""SELECT c.facet, c.term, (SELECT count(*) FROM postings p WHERE p.facet = c.facet AND p.term = c.term) AS n
       FROM (VALUES {_CLOSED}) c(facet, term)
       UNION ALL SELECT 'total', 'cases', count(*) FROM graded
       UNION ALL SELECT 'total', 'projects', count(DISTINCT project) FROM graded
       UNION ALL SELECT 'total', 'tags', count(DISTINCT term) FROM postings WHERE facet = 'tag'""", FILES, POSTINGS)
def _(t):
    return A.facet_stats(t.postings)


@query("corpus_summary", """SELECT count(*) AS total_files, avg(total_score) AS average_score,
       count(*) FILTER (total_score >= 60) AS excellent_files,
       (SELECT string_agg(path, ',' ORDER BY total_score DESC, path) FROM
         (SELECT path, total_score FROM scored ORDER BY total_score DESC, path LIMIT 5)) AS top_files FROM scored""",
       FILES, Q.SCORED)
def _(t):
    s = U.corpus_summary(t.case_store, excellent_from=60)
    return s.withColumn("top_files", F.array_join("top_files", ","))


@query("excellent_snippets", f"""SELECT doc_id, reason, score FROM (SELECT doc_id, unnest({Q.split('excellent_reasons_s')}) AS reason,
       70 + length(reason) AS score FROM file_meta) WHERE score >= 85""", META)
def _(t):
    snippets = F.transform("excellent_reasons", lambda r: F.struct(r.alias("reason"), (F.length(r) + 70).cast("bigint").alias("score")))
    rows = U.explode_snippets(t.file_meta.select("doc_id", snippets.alias("snippets")))
    return rows.select("doc_id", "snippet.reason", "snippet.score")


_COMPONENT_CATEGORY = Q.case([(c, Q.any_of("lower(name)", n)) for c, n in R.COMPONENT_CATEGORIES], "other")
_ITEMS = {**NAMING, "items": f"""SELECT project, name, max(doc_id) AS doc_id, {_COMPONENT_CATEGORY} AS category,
          '<' || name || ' />' AS usage, arg_max(replace(features_s, '|', ', '), m.doc_id) AS description
          FROM file_meta m JOIN names n USING (doc_id, project)
          WHERE m.category = 'component' OR contains(m.path, '/components/') GROUP BY project, name""",
          "prefixed": """SELECT DISTINCT project, coalesce(nullif(regexp_extract(name, '^([A-Z][a-z]+)[A-Z]', 1), ''),
          nullif(regexp_extract(name, '^([A-Z][a-z]?)[A-Z]', 1), '')) AS prefix FROM items"""}


@query("package_components", """SELECT project, 'component' AS kind, name, category, usage, description, doc_id FROM items
       UNION ALL SELECT project, 'pattern', prefix || '[A-Z]\\w+', NULL, NULL, NULL, -1 FROM prefixed WHERE prefix IS NOT NULL""",
       ("file_meta", "modules"), _ITEMS)
def _(t):
    items = P.package_components(t.file_meta, P.name_components(t.files, t.modules))
    return items.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


_FN = {
    "fn0": f"""SELECT doc_id, project, patterns_s, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.(ts|js)$', '') AS file_name,
        {Q.split('api_methods_s')} AS methods FROM file_meta WHERE category IN ('composable', 'utility')""",
    "fn1": """SELECT *, list_concat(CASE WHEN starts_with(file_name, 'use') THEN [file_name] ELSE [] END, methods) AS l FROM fn0""",
    "fn2": "SELECT doc_id, project, patterns_s, file_name, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS name FROM fn1",
    "fn": """SELECT project, name, max(doc_id) AS doc_id, arg_max(patterns_s, (doc_id, pos)) AS patterns_s,
        arg_max(pos, (doc_id, pos)) AS pos, arg_max(file_name, (doc_id, pos)) AS file_name FROM fn2 GROUP BY ALL""",
}
_FN_CATEGORY = Q.case([(c, Q.any_of("lower(name)", n)) for c, n in R.FUNCTION_CATEGORIES]
                      + [(c, f"list_contains(string_split(patterns_s, '|'), '{p}')") for c, p in R.FUNCTION_PATTERN_CATEGORIES], "utility")


@query("package_functions", f"""SELECT project, name, {_FN_CATEGORY} AS category,
       CASE WHEN pos = 0 AND file_name = name THEN 'const result = ' || name || '()' ELSE name || '()' END AS usage, doc_id
       FROM fn""", META, _FN)
def _(t):
    return P.package_functions(t.file_meta)


@query("packages_to_analyze", """SELECT id, package_name, type, analyzed, 'open design systems' AS worklist FROM packages
       WHERE NOT analyzed AND type IN ('design-system', 'hybrid')
       UNION ALL SELECT id, package_name, type, analyzed, 'all utilities' FROM packages WHERE type IN ('utility', 'hybrid')""",
       ("packages",))
def _(t):
    return P.package_worklist(t.packages, "unanalyzed", "design-system").withColumn("worklist", F.lit("open design systems")).unionByName(
        P.package_worklist(t.packages, "all", "utility").withColumn("worklist", F.lit("all utilities")))


# a catalogue of our own vocabulary, so that lookups hit the derived names
HOUSE = [("house-kit", "component", {"table": ["ElThe", "ElAnd", "ElThat"], "card": ["TheCard", "AndCard", "TheseCard"]}),
         ("house-utils", "function", {"state": ["useThe", "useAnd"], "network": ["useThat", "useThan"]})]
_HOUSE_ROWS = ", ".join(f"({', '.join(map(Q.lit, r))})" for r in R.catalogue_rows(R.CATALOGUE + HOUSE))


@query("catalog_enrich", f"""SELECT project, kind, library, slot, sum(n)::BIGINT AS uses, count(*) AS names FROM (
       SELECT project, kind, name, n, CASE places WHEN 0 THEN 'unknown' WHEN 1 THEN one.library ELSE 'ambiguous' END AS library,
       CASE places WHEN 0 THEN 'unknown' WHEN 1 THEN one.slot ELSE 'ambiguous' END AS slot FROM (
         SELECT *, (SELECT count(*) FROM house h WHERE h.kind = u.kind AND h.name = u.name) AS places,
         (SELECT any_value(h) FROM house h WHERE h.kind = u.kind AND h.name = u.name) AS one FROM uses u))
       GROUP BY ALL""", META,
       {"house": f"SELECT * FROM (VALUES {_HOUSE_ROWS}) c(library, kind, slot, name)",
        "uses": f"""SELECT project, kind, name, count(*) AS n FROM (
            SELECT project, 'component' AS kind, unnest({Q.split('components_used_s')}) AS name FROM file_meta UNION ALL
            SELECT project, 'function', unnest({Q.split('composables_used_s')}) FROM file_meta) GROUP BY ALL"""})
def _(t):
    return P.catalog_enrich(t.file_meta, P.catalogue(t.spark, R.CATALOGUE + HOUSE))


@query("scan_outcome_stats", """SELECT user_id, event_type, count(*) AS n, event_type = 'error' AS failed FROM events GROUP BY user_id, event_type
       UNION ALL SELECT -1, event_type, count(*), event_type = 'error' FROM events GROUP BY event_type""")
def _(t):
    return I.outcome_stats(t.events, "user_id", "event_type").withColumn("user_id", F.coalesce("user_id", F.lit(-1)))  # all projects


def _counted(t, df, name, counts):
    """The counts of the job that writes ``df``, as a row."""
    _, found = W.write_observed(df, name, counts)
    return t.spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} long" for c in found))


_OUTCOMES = ["click", "error", "view"]


@query("scan_outcomes_observed", "SELECT count(*) AS rows, " + ", ".join(
       f"count(*) FILTER (event_type = '{o}') AS {o}" for o in _OUTCOMES)
       + f", count(*) FILTER (event_type NOT IN ({', '.join(map(Q.lit, _OUTCOMES))})) AS other FROM events")
def _(t):
    return _counted(t, t.events, "scan-outcomes", W.outcome_counts("event_type", _OUTCOMES))


@query("dimension_mismatch_observed", """SELECT count(*) AS rows, count(*) FILTER (embedding IS NULL) AS missing,
       count(*) FILTER (len(embedding) <> 64) AS mismatched, min(len(embedding)) AS shortest, max(len(embedding)) AS longest FROM embeddings""")
def _(t):
    return _counted(t, t.embeddings, "vectors", W.dimension_counts("embedding", 64))


@query("file_case_text_stats", """SELECT project, sum(lines_of_code)::BIGINT AS total_lines_of_code,
       count(*) FILTER (error_handling = 'comprehensive') AS files_with_good_error_handling,
       count(*) FILTER (type_definitions IN ('excellent', 'good')) AS files_with_good_types FROM file_meta GROUP BY project""", META)
def _(t):
    return U.text_stats(t.file_meta, "project")
