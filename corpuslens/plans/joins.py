"""Queries: joins and set operations."""

from pyspark.sql import functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.operators import facets as A, incremental as I, joins as J, rollup as U
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.aggregates import POSTINGS
from corpuslens.plans.features import FILES, META, REQUESTS, joined
from corpuslens.plans.registry import query
from corpuslens.plans.scores import ANNOTATION_SQL, ROLLUP
from corpuslens.sources.store import written_once

_ANNOTATED = {
    **Q.FEATURES,
    "fb": f"SELECT *, {Q.text_score_columns(R.FALLBACK_TEXT_TERMS)} FROM features",
    "ann": f"SELECT m.doc_id, api_type, is_excellent, {ANNOTATION_SQL} FROM file_meta m JOIN labels l ON m.doc_id = l.doc_id",
}
_EXTRA = Q.present(["CASE WHEN a.is_excellent THEN 'excellent' END", "CASE WHEN a.api_type IN ('grpc', 'rest') THEN a.api_type END"])


@query("join_annotations", "SELECT f.doc_id, a.doc_id IS NOT NULL AS annotated, "
       f"{Q.joined(f'list_concat(f.keywords, {_EXTRA})')} AS keywords, "
       + ", ".join(f'coalesce(a."{d}", f."{d}") AS "{d}"' for d in R.DIMENSIONS)
       + " FROM fb f LEFT JOIN ann a ON f.doc_id = a.doc_id", ("files", "file_meta"), _ANNOTATED)
def _(t):
    annotations = t.file_meta.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    df = I.join_annotations(t.features, annotations)
    return df.select("doc_id", "annotated", joined(F.col("keywords")).alias("keywords"), *R.DIMENSIONS)


@query("join_postings", "SELECT facet, term, doc_id, path, total_score FROM postings JOIN graded USING (doc_id)", FILES, POSTINGS)
def _(t):
    return J.join_postings(t.postings, t.case_store, "doc_id").select("facet", "term", "doc_id", "path", "total_score")


@query("join_guides_by_id", f"""SELECT request_id, id, position, priority FROM (SELECT request_id,
       id, min(pos) AS position FROM (SELECT request_id, unnest(w) AS id, generate_subscripts(w, 1) AS pos FROM
       (SELECT request_id, {Q.split('wanted_s')} AS w FROM requests)) GROUP BY ALL) JOIN guides USING (id)""",
       ("requests", "guides"))
def _(t):
    return J.join_guides_by_id(t.requests, t.guides.select("id", "priority")).select("request_id", "id", "position", "priority")


# projects of finer grain, so that api types differ between them
BY_LANG = {"meta2": "SELECT * REPLACE (project || '/' || lang AS project) FROM file_meta"}
ROLLUP2 = {**BY_LANG, **{k: v.replace("file_meta", "meta2") for k, v in ROLLUP.items()}}
PAIRS = {**ROLLUP2,
         "first_ex": "SELECT api_type, min(project) AS exemplar FROM exemplars GROUP BY api_type",
         "pairs": "SELECT p.project, api_type, exemplar FROM proj p JOIN first_ex USING (api_type)"}


def meta_by_lang(t):
    return t.file_meta.withColumn("project", F.concat_ws("/", "project", "lang"))


def fine_values(t):
    """Values per project and language, written once: every comparison reads them."""
    return written_once(t.spark, f"fine-values-{t.sf_dir}", lambda: U.project_values(meta_by_lang(t)))


def fine_rollup(t):
    return written_once(t.spark, f"fine-rollup-{t.sf_dir}", lambda: U.project_rollup(fine_values(t)))


def pairs(t):
    rolled = fine_rollup(t)
    return J.pick_exemplar(rolled, U.build_exemplars(rolled).select("project", "api_type"))


@query("pick_exemplar", "SELECT project, api_type, exemplar FROM pairs", META, {
       **PAIRS, "first_ex": "SELECT api_type, min(project) AS exemplar FROM exemplars WHERE total_score >= 40 OR len(excellent_in) > 0 GROUP BY api_type"})
def _(t):
    return pairs(t).select("project", "api_type", "exemplar")


PAIRS["first_ex"] = "SELECT api_type, min(project) AS exemplar FROM exemplars WHERE total_score >= 40 OR len(excellent_in) > 0 GROUP BY api_type"
_MISSING = {**PAIRS, "missing": """SELECT DISTINCT p.project, p.exemplar, v.field, v.value FROM pairs p JOIN long_values v ON v.project = p.exemplar
        WHERE v.field IN ('patterns', 'api_methods', 'components_used') AND NOT EXISTS
        (SELECT 1 FROM long_values o WHERE o.project = p.project AND o.field = v.field AND o.value = v.value)"""}
MISSING = _MISSING
COMPARED_FIELDS = ["patterns", "api_methods", "components_used"]


@query("anti_join_missing", "SELECT project, exemplar, field, value FROM missing", META, _MISSING)
def _(t):
    return J.anti_join_missing(pairs(t), fine_values(t), COMPARED_FIELDS)


@query("join_pattern_reference", """SELECT m.project, m.exemplar, m.value AS pattern, f.doc_id, f.path FROM missing m JOIN
       (SELECT project, value, min(doc_id) AS doc_id, arg_min(path, doc_id) AS path FROM
         (SELECT project, doc_id, path, unnest(string_split(patterns_s, '|')) AS value FROM meta2) GROUP BY project, value) f
       ON f.project = m.exemplar AND f.value = m.value WHERE m.field = 'patterns'""", META, _MISSING)
def _(t):
    missing = J.anti_join_missing(pairs(t), fine_values(t), ["patterns"])
    reference = J.first_with_value(meta_by_lang(t), "project", "patterns", "doc_id", "path")
    return missing.join(reference.withColumnRenamed("project", "exemplar"), ["exemplar", "value"]).select(
        "project", "exemplar", F.col("value").alias("pattern"), "doc_id", "path")


def _member(value, key, words):
    return "(" + " OR ".join(f"contains(lower({value}), '{w}') OR contains('{w}', lower({value}))" for w in [key, *words]) + ")"


def _groups(value):
    return Q.present([f"CASE WHEN {_member(value, k, w)} THEN '{k}' END" for k, w in R.CATEGORY_ALIASES])


@query("join_category_alias", f"""SELECT id, category, target, CASE WHEN lower(category) = lower(target) THEN 'exact' ELSE 'partial' END AS match
       FROM cases JOIN targets ON lower(category) = lower(target) OR list_has_any({_groups('category')}, {_groups('target')})""",
       ("cases", "file_meta"), {"targets": f"SELECT DISTINCT unnest(list_concat({Q.split('features_s')}, [category])) AS target FROM file_meta"})
def _(t):
    targets = t.file_meta.select(F.explode(F.concat("features", F.array("category"))).alias("target"))
    return J.join_category_alias(t.cases.select("id", "category"), targets).select("id", "category", "target", "match")


@query("semi_join_facets", """SELECT doc_id, total_score FROM graded WHERE doc_id IN (SELECT doc_id FROM postings WHERE facet = 'tag' AND term IN ('modal', 'async'))""",
       FILES, POSTINGS)
def _(t):
    return A.semi_join_facet(t.case_store, t.postings, "tag", ["modal", "async"], "doc_id").select("doc_id", "total_score")


@query("anti_join_completed", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_join_completed(t.customer, done, "c_custkey").select("c_custkey", "c_name")


@query("union_mandatory", """SELECT id, 1000.0::DOUBLE AS score, summary FROM guides WHERE mandatory
       UNION ALL SELECT id, priority / 10, summary FROM guides WHERE NOT mandatory""", ("guides",))
def _(t):
    scored = t.guides.select("id", (F.col("priority") / 10).alias("score"), "summary")
    return J.union_mandatory(scored, t.guides.filter("mandatory").select("id", "summary"))


@query("union_distinct_ids", """SELECT request_id, id, min(src) AS source FROM
       (SELECT request_id, unnest(string_split(wanted_s, '|')) AS id, 0 AS src FROM requests
        UNION ALL SELECT request_id, g.id, 1 FROM requests r JOIN guides g ON g.mandatory)
       GROUP BY ALL""", ("requests", "guides"))
def _(t):
    own = t.requests.select("request_id", F.posexplode("wanted").alias("position", "id"))
    auto = J.with_mandatory(t.requests.select("request_id"), t.guides).withColumn("position", F.lit(0))
    return J.union_distinct_ids(own, auto).select("request_id", "id", F.col("rank._s").alias("source"))


@query("intersect_facets", """SELECT doc_id FROM postings WHERE facet = 'tag' AND term IN ('search', 'list')
       INTERSECT SELECT doc_id FROM postings WHERE facet = 'project' AND term IN ('src1', 'src2', 'src3')
       INTERSECT SELECT doc_id FROM postings WHERE facet = 'grade' AND term = 'poor'""", FILES, POSTINGS)
def _(t):
    return A.intersect_facets(t.postings, {"tag": ["search", "list"], "project": ["src1", "src2", "src3"], "grade": ["poor"]}, "doc_id")


@query("except_patterns", """SELECT p.project, p.exemplar, value FROM pairs p JOIN long_values v ON v.project = p.exemplar AND field = 'patterns'
       EXCEPT SELECT p.project, p.exemplar, value FROM pairs p JOIN long_values v ON v.project = p.project AND field = 'patterns'""", META, PAIRS)
def _(t):
    return J.except_patterns(pairs(t), fine_values(t), "patterns").drop("field")
