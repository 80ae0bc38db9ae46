"""Queries: ranking, top-k and retrieval."""

from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.functions import rules as R, scoring as S, text as X
from corpuslens.operators import (guides as G, joins as J, packages as P, page_matches as B, recommend as C, similar as M,
                                  vectors as V)
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.features import API_TYPE, CATEGORY_10, FILES, MANIFESTS, META, META_WORDS, REQUESTS, SYSTEMS, joined
from corpuslens.plans.joins import _groups
from corpuslens.plans.registry import query


def six(x):
    """Six decimals, half up, by the same arithmetic in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def six_sql(x):
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def centroids(df: DataFrame, by: str) -> DataFrame:
    """Mean vector per group, averaged per dimension before it is put together."""
    cells = df.select(by, F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vector"))


CENTROIDS = {"centroids": """SELECT label, list(m ORDER BY pos) AS vector FROM (SELECT label, pos, avg(v) AS m FROM
    (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
    GROUP BY label"""}
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], c.vector)"


@query("cosine_similarity", f"SELECT vec_id, {six_sql(_COS)} AS similarity FROM embeddings e JOIN centroids c USING (label)", (), CENTROIDS)
def _(t):
    e = t.embeddings
    return e.join(centroids(e, "label"), "label").select("vec_id", six(V.cosine(F.col("embedding"), F.col("vector"))).alias("similarity"))


@query("vector_top_k", f"""SELECT label AS query_id, rank, vec_id, {six_sql('s')} AS similarity FROM
       (SELECT c.label, vec_id, {_COS} AS s, row_number() OVER (PARTITION BY c.label ORDER BY {_COS} DESC, vec_id) AS rank
        FROM embeddings e CROSS JOIN centroids c) WHERE rank <= 20""", (), CENTROIDS)
def _(t):
    queries = centroids(t.embeddings, "label").withColumnRenamed("label", "query_id")
    best = V.top_k(queries, t.embeddings, 20, "query_id", "vec_id")
    return best.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", six(F.col("similarity")).alias("similarity"))


# one request for each record: its five nearest others
_NEAR = "floor(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) * 1e9 + 0.5)"


@query("vector_top_k_each", f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, vec_id,
       floor(s / 1e3 + 0.5) / 1e6 AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, {_NEAR} AS s FROM embeddings q JOIN embeddings e
       ON q.vec_id <> e.vec_id) QUALIFY rank <= 5""")
def _(t):
    each = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    # six at most hold the record itself, or six that equal it and come first
    best = V.top_k(each, t.embeddings, 6, "query_id", "vec_id").filter("query_id <> vec_id")
    near = F.floor(F.col("similarity") * 1e9 + 0.5)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(near.desc(), "vec_id")).cast("bigint")
    return best.withColumn("rank", place).filter("rank <= 5").select(
        "query_id", "rank", "vec_id", (F.floor(near / 1e3 + 0.5) / 1e6).alias("similarity"))


@query("dimension_mismatch_report", "SELECT len(embedding) AS dimension, count(*) AS n, len(embedding) <> 64 AS mismatch FROM embeddings GROUP BY ALL")
def _(t):
    return V.dimension_report(t.embeddings, expected=64).withColumn("dimension", F.col("dimension").cast("bigint"))


def _overlap_sql(wanted, present):
    return (f"len(list_filter({wanted}, lambda k: len(list_filter({present}, lambda p: contains(lower(p), lower(k)))) > 0)) "
            f"/ greatest(len({wanted}), 1)")


@query("keyword_overlap", f"SELECT doc_id, {_overlap_sql('wanted', 'keywords')} AS share FROM "
       f"(SELECT doc_id, list_concat({Q.split('features_s')}, ['sea', 'async']) AS wanted FROM file_meta) JOIN features USING (doc_id)",
       ("files", "file_meta"), Q.FEATURES)
def _(t):
    wanted = t.file_meta.select("doc_id", F.concat("features", F.array(F.lit("sea"), F.lit("async"))).alias("wanted"))
    return wanted.join(t.case_store.select("doc_id", "keywords"), "doc_id").select(
        "doc_id", V.overlap(F.col("wanted"), F.col("keywords")).alias("share"))


# one hybrid request per vector label, with keywords, role and entity by the label's last digit
_HYBRID_ROWS = [(0, "search form", None, None), (1, "rest list", "page", None), (2, "async error", None, "the"),
                (3, "modal table", "store", None), (4, "grpc", "component", "ent"), (5, "", None, None),
                (6, "search list form table", "api", None), (7, "modal", None, "dto"), (8, "sort", "util", None),
                (9, "rest async", "composable", None)]
_HYBRID = {
    **Q.FEATURES, **CENTROIDS,
    "asked": "SELECT label, vector, " + ", ".join(
        "CASE label % 10 " + " ".join(f"WHEN {r[0]} THEN {Q.lit(r[i])}" for r in _HYBRID_ROWS) + f" END AS {n}"
        for i, n in ((1, "words"), (2, "role"), (3, "entity"))) + " FROM centroids",
    "cand": f"""SELECT c.label, f.doc_id, e.embedding IS NOT NULL AS has, {_COS} AS cos,
        {_overlap_sql("list_filter(string_split(words, ' '), lambda x: x <> '')", 'f.keywords')} AS ov
        FROM asked c JOIN features f ON (c.role IS NULL OR c.role = f.file_role)
        AND (c.entity IS NULL OR len(list_filter(f.entities, lambda x: contains(lower(x), c.entity))) > 0)
        LEFT JOIN embeddings e ON e.vec_id = f.doc_id""",
    "cand2": "SELECT *, max(has) OVER (PARTITION BY label) AS any_vector FROM cand",
    "sim": """SELECT label, doc_id, CASE WHEN has THEN 0.7 * cos + 0.3 * ov WHEN any_vector THEN 0.5 * ov ELSE ov END AS s
        FROM cand2 WHERE has OR ov > 0""",
}


@query("hybrid_search", f"""SELECT label, doc_id, {six_sql('s')} AS similarity, rank FROM
       (SELECT *, row_number() OVER (PARTITION BY label ORDER BY floor(s * 1e9 + 0.5) DESC, doc_id) AS rank FROM sim) WHERE rank <= 10""",
       FILES, _HYBRID)
def _(t):
    wanted = t.spark.createDataFrame(_HYBRID_ROWS, "digit INT, words STRING, file_role STRING, entity STRING")
    asked = centroids(t.embeddings, "label").withColumn("digit", F.col("label") % 10).join(wanted, "digit").select(
        "label", "vector", "file_role", F.filter(F.split("words", " "), lambda w: w != "").alias("keywords"),
        F.array_compact(F.array("entity")).alias("entities"))
    corpus = t.case_store.select("doc_id", "file_role", "keywords", "entities").join(
        t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    best = V.hybrid(asked, corpus, 10, request_key="label", key="doc_id", filters=("file_role",))
    return best.select("label", "doc_id", six(F.col("similarity")).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


RECOMMEND = {
    **Q.FEATURES, **REQUESTS,
    "matched": f"""SELECT r.request_id, f.doc_id, {_overlap_sql('r.keywords', 'f.keywords')} AS s FROM req r JOIN features f
        ON (r.file_role IS NULL OR r.file_role = f.file_role)
        AND len(list_filter(f.entities, lambda x: contains(lower(x), lower(r.entity)))) > 0""",
    "hits": """SELECT request_id, rank, doc_id, s AS similarity FROM (SELECT *, row_number() OVER
        (PARTITION BY request_id ORDER BY s DESC, doc_id) AS rank FROM matched WHERE s > 0) WHERE rank <= 5""",
}


@query("auto_recommend", "SELECT request_id, rank, doc_id, similarity FROM hits", ("files", "requests"), RECOMMEND)
def _(t):
    return t.hits.withColumn("rank", F.col("rank").cast("bigint"))


_DRAFT = {
    **Q.FEATURES,
    "drafts": "SELECT request_id, draft_path, description, 'x' || chr(10) || '// TODO: ' || description AS content FROM requests",
    "draft1": "SELECT request_id, " + Q.case([(r, f"contains(draft_path, {Q.lit(n)})") for r, n in reversed(R.ROLE_HINTS)], "page")
              + " AS role, lower(description) AS low, list_transform(list_filter(list_filter(list_transform(string_split(draft_path, '/'), "
              "lambda s: regexp_replace(s, '\\.(vue|ts|tsx|js)$', '')), lambda s: s <> 'index' AND length(s) > 2), "
              "lambda s: s NOT IN ('pages', 'components', 'composables', 'stores')), lambda s: lower(s)) AS ents, "
              "lower(string_split(description, chr(10))[1]) AS todo FROM drafts",
    "draft": f"SELECT *, list_distinct(list_concat({Q.tags('low', R.REQUEST_RULES, [])}, "
             f"list_slice({Q.tags('todo', R.TODO_RULES, [])}, 1, 1))) AS kw FROM draft1",
    "dm": f"""SELECT r.request_id, f.doc_id, {_overlap_sql('r.kw', 'f.keywords')} AS s FROM draft r JOIN features f
        ON r.role = f.file_role AND (len(r.ents) = 0 OR len(list_filter(f.entities, lambda x:
            len(list_filter(r.ents, lambda e: contains(lower(x), e))) > 0)) > 0)""",
}


@query("recommend_for_file", """SELECT request_id, rank, doc_id, s AS similarity FROM (SELECT *, row_number() OVER
       (PARTITION BY request_id ORDER BY s DESC, doc_id) AS rank FROM dm WHERE s > 0) WHERE rank <= 5""",
       ("files", "requests"), _DRAFT)
def _(t):
    drafts = t.requests.withColumn("content", F.concat(F.lit("x\n// TODO: "), "description"))
    best = C.recommend_drafts(drafts, t.case_store)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


CRITERIA = {"category": "list", "api_type": "grpc", "design_system": "element-plus",
            "frameworks": ["vue3", "pinia"], "tags": ["en", "search", "form"]}


def _match_sql(criteria):
    def ratio(field, weight):
        wanted = "[" + ", ".join(map(Q.lit, criteria[field])) + "]"
        return f"floor({weight} * (len(list_intersect(list_distinct({Q.split(field + '_s')}), {wanted})) / {len(criteria[field])}) + 0.5)"
    cat = Q.lit(criteria["category"])
    mixed = "api_type = 'mixed'" + (" OR api_type IS NOT NULL" if criteria["api_type"] == "mixed" else "")
    return (f"least(100, CASE WHEN lower(category) = lower({cat}) THEN 35 WHEN list_has_any({_groups('category')}, {_groups(cat)}) THEN 20 ELSE 0 END"
            f" + CASE WHEN api_type = {Q.lit(criteria['api_type'])} THEN 25 WHEN {mixed} THEN 15 ELSE 0 END"
            f" + CASE WHEN design_system = {Q.lit(criteria['design_system'])} THEN 20 ELSE 0 END"
            f" + {ratio('frameworks', 15)} + {ratio('tags', 5)} + CASE WHEN raw_score >= 85 THEN 5 ELSE 0 END)::BIGINT")


def scored_cases(t):
    return t.cases.withColumnRenamed("raw_score", "total_score")


@query("similar_pages", f"""SELECT id, project, category, match_score FROM (SELECT *, {_match_sql(CRITERIA)} AS match_score FROM cases)
       WHERE match_score >= 40 AND (coalesce(raw_score, 0) = 0 OR raw_score >= 30) ORDER BY match_score DESC, id LIMIT 10""", ("cases",))
def _(t):
    return M.similar(scored_cases(t), CRITERIA, min_total=30).select("id", "project", "category", "match_score")


ANALYSIS = {"category": "list", "api_type": "grpc", "design_system": "element-plus", "frameworks": ["vue3", "pinia"],
            "features": ["paging", "search", "en"]}
_ANALYSIS_CRITERIA = {**ANALYSIS, "tags": ANALYSIS["features"]}
_PRIORITY = R.FILE_PRIORITIES["list"]


def _relevance_sql():
    bonus = Q.case([(max(5, 30 - 5 * i), f"file_category = '{c}'") for i, c in enumerate(_PRIORITY)], 5)
    hits = " + ".join(f"contains(hay, {Q.lit(f)})::INT" for f in ANALYSIS["features"])
    return (f"least(100, floor(match_score * 0.4::DOUBLE + 0.5) + {bonus} + floor(20 * (({hits}) / {len(ANALYSIS['features'])}) + 0.5)"
            " + CASE WHEN lines BETWEEN 50 AND 500 THEN 10 WHEN lines > 500 THEN 5 ELSE 0 END)::BIGINT")


_RELEVANT = {
    "pages0": f"SELECT id AS case_id, project AS source_project, raw_score, {_match_sql(_ANALYSIS_CRITERIA)} AS match_score FROM cases",
    "rel0": f"""SELECT f.*, p.match_score, source_project, {CATEGORY_10} AS file_category, len(string_split(content, chr(10))) AS lines,
        lower(concat_ws(chr(10), content, path, purpose)) AS hay, regexp_extract(path, '([^/]*)$', 1) AS file_name
        FROM case_files f JOIN pages0 p USING (case_id)""",
    "rel": f"SELECT *, {_relevance_sql()} AS relevance FROM rel0",
}


def relevant_files(t):
    score, _ = M.match_score(_ANALYSIS_CRITERIA)
    pages = scored_cases(t).select(F.col("id").alias("case_id"), score.alias("match_score"))
    return M.relevance(t.case_files, pages, ANALYSIS)


@query("file_relevance", "SELECT doc_id, case_id, file_category, relevance FROM rel", ("cases", "case_files"), _RELEVANT)
def _(t):
    return relevant_files(t).select("doc_id", "case_id", "file_category", "relevance")


@query("recommend_page_files", """SELECT doc_id, case_id, source_project, path, file_category, relevance FROM
       (SELECT *, row_number() OVER (PARTITION BY file_category, file_name ORDER BY relevance DESC, case_id, path) AS n FROM rel
        WHERE relevance >= 30 AND case_id IN (SELECT case_id FROM pages0 WHERE match_score >= 35 ORDER BY match_score DESC, case_id LIMIT 5))
       WHERE n = 1 ORDER BY relevance DESC, case_id, path LIMIT 15""", ("cases", "case_files"), _RELEVANT)
def _(t):
    return M.recommend_page(scored_cases(t), t.case_files, ANALYSIS).select(
        "doc_id", "case_id", "source_project", "path", "file_category", "relevance")


@query("dedupe_keep_best", """SELECT doc_id, file_category, file_name, relevance FROM (SELECT *, row_number() OVER
       (PARTITION BY file_category, file_name ORDER BY relevance DESC, doc_id) AS n FROM rel) WHERE n = 1""",
       ("cases", "case_files"), _RELEVANT)
def _(t):
    files = relevant_files(t).withColumn("file_name", X.base_name(F.col("path")))
    return M.keep_best(files, ["file_category", "file_name"], F.desc("relevance"), "doc_id").select(
        "doc_id", "file_category", "file_name", "relevance")


@query("group_by_category_ordered", "SELECT doc_id, file_category, path, relevance, "
       f"list_position([{', '.join(map(Q.lit, R.FILE_CATEGORY_ORDER))}], file_category)::BIGINT AS category_place FROM rel",
       ("cases", "case_files"), _RELEVANT)
def _(t):
    return M.group_ordered(relevant_files(t)).select(
        "doc_id", "file_category", "path", "relevance", "category_place")


def _wanted_sql(tags):
    """Points of case c for the form f, criteria as columns."""
    def ratio(case, form, weight):
        want = Q.split("f." + form)
        return (f"CASE WHEN len({want}) = 0 THEN {dict(frameworks_s=6, tags_s=2)[case]} ELSE floor({weight} * "
                f"(len(list_intersect(list_distinct({Q.split('c.' + case)}), {want})) / len({want})) + 0.5) END")
    return f"""least(100, CASE WHEN f.category IS NULL THEN 15 WHEN lower(c.category) = lower(f.category) THEN 35
             WHEN list_has_any({_groups('c.category')}, {_groups('f.category')}) THEN 20 ELSE 0 END
        + CASE WHEN f.api_type IS NULL THEN 10 WHEN c.api_type = f.api_type THEN 25
               WHEN c.api_type = 'mixed' OR (f.api_type = 'mixed' AND c.api_type IS NOT NULL) THEN 15 ELSE 0 END
        + CASE WHEN f.design_system IS NULL THEN 8 WHEN c.design_system = f.design_system THEN 20 ELSE 0 END
        + {ratio('frameworks_s', 'frameworks_s', 15)} + {ratio('tags_s', tags, 5)}
        + CASE WHEN c.raw_score >= 85 THEN 5 ELSE 0 END)::BIGINT"""


# every case is a request
_SAME_FORM = " AND ".join(f"f.{c} IS NOT DISTINCT FROM r.{c}" for c in
                          ("category", "api_type", "design_system", "frameworks_s", "tags_s"))
_FORMS = {"forms": "SELECT DISTINCT category, api_type, design_system, frameworks_s, tags_s FROM cases",
          "form_scores": f"SELECT f.*, c.id, c.raw_score, {_wanted_sql('tags_s')} AS match_score FROM forms f CROSS JOIN cases c"}


def _form_top(least, k, where="TRUE"):
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, api_type, design_system, frameworks_s, tags_s
        ORDER BY match_score DESC, id) AS rank FROM form_scores WHERE match_score >= {least} AND {where}) WHERE rank <= {k}"""


def page_requests(t):
    return scored_cases(t).select(F.col("id").alias("request_id"), "category", "api_type", "design_system", "frameworks", "tags")


@query("similar_pages_bulk", f"""SELECT r.id AS request_id, f.rank, f.id, f.match_score FROM cases r JOIN
       ({_form_top(40, 10, "(coalesce(raw_score, 0) = 0 OR raw_score >= 30)")}) f ON {_SAME_FORM}""", ("cases",), _FORMS)
def _(t):
    return B.similar_bulk(scored_cases(t), page_requests(t), min_total=30).select(
        "request_id", F.col("rank").cast("bigint").alias("rank"), "id", "match_score")


def _bonus_sql():
    def by(order):
        return Q.case([(max(5, 30 - 5 * i), f"file_category = '{c}'") for i, c in enumerate(order)], 5)
    rest = by(R.DEFAULT_PRIORITIES)
    return "CASE " + " ".join(f"WHEN lower(category) = '{p}' THEN {by(o)}" for p, o in R.FILE_PRIORITIES.items()) + f" ELSE {rest} END"


_PAGE_FILES = {**_FORMS, "form_top": _form_top(35, 5), "page_files0": f"""
    SELECT p.* EXCLUDE (rank, id, raw_score), f.doc_id, f.case_id, f.path, {CATEGORY_10} AS file_category,
        regexp_extract(path, '([^/]*)$', 1) AS file_name, len(string_split(content, chr(10))) AS lines, {Q.split('p.tags_s')} AS wanted,
        lower(concat_ws(chr(10), content, path, purpose)) AS hay FROM case_files f JOIN form_top p ON p.id = f.case_id""",
    "page_files": f"""SELECT *, least(100, floor(match_score * 0.4::DOUBLE + 0.5) + {_bonus_sql()}
        + CASE WHEN len(wanted) = 0 THEN 0 ELSE floor(20 * (len(list_filter(wanted, lambda x: contains(hay, lower(x)))) / len(wanted)) + 0.5) END
        + CASE WHEN lines BETWEEN 50 AND 500 THEN 10 WHEN lines > 500 THEN 5 ELSE 0 END)::BIGINT AS relevance FROM page_files0""",
    "page_best": """SELECT *, row_number() OVER (PARTITION BY category, api_type, design_system, frameworks_s, tags_s
        ORDER BY relevance DESC, case_id, path, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category, api_type, design_system,
        frameworks_s, tags_s, file_category, file_name ORDER BY relevance DESC, case_id, path, doc_id) AS n FROM page_files WHERE relevance >= 30) WHERE n = 1"""}


@query("recommend_page_files_bulk", f"""SELECT r.id AS request_id, f.rank, f.doc_id, f.case_id, f.path, f.file_category, f.relevance
       FROM cases r JOIN page_best f ON f.rank <= 15 AND {_SAME_FORM}""", ("cases", "case_files"), _PAGE_FILES)
def _(t):
    asked = page_requests(t).withColumnRenamed("tags", "features")
    return B.recommend_pages(scored_cases(t), t.case_files, asked).withColumn("rank", F.col("rank").cast("bigint"))


GUIDE_REQUESTS = {**REQUESTS, "greq": """SELECT request_id, keywords, api_type, CASE WHEN file_role = 'page' THEN 'element-plus' END AS design_system,
    CASE WHEN target_function = 'async' THEN 'lodash' END AS utility_library, CASE WHEN file_role = 'composable' THEN 'org' END AS scope FROM req"""}


def guide_requests(t):
    c = F.col
    return t.request_rows.select(
        "request_id", "keywords", "api_type", F.when(c("file_role") == "page", "element-plus").alias("design_system"),
        F.when(c("target_function") == "async", "lodash").alias("utility_library"),
        F.when(c("file_role") == "composable", "org").alias("scope"))


def _library_sql(name):
    return (f"CASE WHEN r.{name} IS NULL THEN 0 WHEN g.id = r.{name} OR g.id = r.{name} || '-guide' THEN 40 "
            f"WHEN len(list_filter(g.tags, lambda x: contains(lower(x), lower(r.{name})))) > 0 THEN 35 "
            f"WHEN contains(lower(g.summary), lower(r.{name})) OR contains(lower(g.content), lower(r.{name})) THEN 25 ELSE 0 END")


_GUIDES = {
    **GUIDE_REQUESTS,
    "g0": f"SELECT *, {Q.split('tags_s')} AS tags FROM guides",
    "gs": f"""SELECT r.request_id, g.id, CASE WHEN g.mandatory THEN 1000 ELSE
        CASE WHEN r.api_type IS NULL THEN 0 ELSE 30 END + CASE WHEN r.scope = g.scope THEN 20 ELSE 0 END
        + {_library_sql('design_system')} + {_library_sql('utility_library')}
        + coalesce(list_sum(list_transform(r.keywords, lambda k:
            CASE WHEN len(list_filter(g.tags, lambda x: contains(lower(x), lower(k)))) > 0 THEN 15 ELSE 0 END
            + CASE WHEN contains(lower(g.summary), lower(k)) THEN 10 ELSE 0 END
            + CASE WHEN contains(lower(g.content), lower(k)) THEN 5 ELSE 0 END)), 0) + g.priority / 10 END::DOUBLE AS score
        FROM greq r JOIN g0 g ON g.mandatory OR r.api_type IS NULL OR g.api_type = r.api_type OR g.api_type = 'any'""",
}


@query("search_guides", """SELECT request_id, rank, id, floor(score * 10 + 0.5) / 10 AS score FROM (SELECT *, row_number() OVER
       (PARTITION BY request_id ORDER BY floor(score * 10 + 0.5) DESC, id) AS rank FROM gs) WHERE rank <= 10""", ("requests", "guides"), _GUIDES)
def _(t):
    found = G.search_guides(guide_requests(t), t.guides)
    return found.select("request_id", F.col("rank").cast("bigint").alias("rank"), "id",
                        (F.floor(F.col("score") * 10 + 0.5) / 10).alias("score"))


def combine_ctes(wanted: str) -> dict[str, str]:
    """Combination of ``wanted`` (rid, id, pos): a fold over each request's sorted list."""
    item = "{{'id': {}, 'ex': {}, 'ok': {}, 'kept': []::VARCHAR[]}}"
    return {
        "gc_guides": f"SELECT *, {Q.split('requires_s')} AS rq, {Q.split('excludes_s')} AS ex, "
                     f"{Q.lookup('scope', R.SCOPE_RANK, 0)} AS scope_rank FROM guides",
        "gc_must": "SELECT id, row_number() OVER (ORDER BY id) AS pos FROM guides WHERE mandatory",
        "gc_ids": f"""SELECT rid, id, min((src, pos)) AS o FROM (SELECT rid, id, 1 AS src, pos FROM {wanted} UNION ALL
            SELECT rid, m.id, 0, m.pos FROM (SELECT DISTINCT rid FROM {wanted}) CROSS JOIN gc_must m) GROUP BY ALL""",
        "gc_rows": "SELECT i.rid, i.o, g.* FROM gc_ids i JOIN gc_guides g USING (id)",
        "gc_asked": "SELECT rid, list(id) AS requested FROM gc_rows GROUP BY rid",
        "gc_lists": "SELECT rid, list(" + item.format("id", "ex", "len(list_filter(rq, lambda x: NOT list_contains(requested, x))) = 0")
                    + " ORDER BY scope_rank DESC, priority DESC, version DESC, o) AS gs FROM gc_rows JOIN gc_asked USING (rid) GROUP BY rid",
        "gc_kept": "SELECT rid, list_reduce(list_prepend(" + item.format("''", "[]::VARCHAR[]", "true") + ", gs), lambda a, x: "
                   "{'id': x.id, 'ex': x.ex, 'ok': x.ok, 'kept': CASE WHEN x.ok AND NOT list_has_any(x.ex, a.kept) "
                   "THEN list_append(a.kept, x.id) ELSE a.kept END}).kept AS kept FROM gc_lists",
        "gc_places": "SELECT rid, generate_subscripts(kept, 1) - 1 AS position, unnest(kept) AS id FROM gc_kept",
        "gc_text": """SELECT rid, substr(string_agg('# ' || summary || chr(10) || chr(10) || content,
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position), 1, 50000) AS combined, count(*) AS n_guides
            FROM gc_places JOIN guides USING (id) GROUP BY rid""",
    }


def search_ctes(requests: str, k: int) -> dict[str, str]:
    """Guide search for ``requests`` (rid, keywords, api_type), then combination of the first k."""
    return {
        "gt": f"SELECT *, {Q.split('tags_s')} AS tags FROM guides",
        "gc_scores": f"""SELECT r.rid, g.id, CASE WHEN g.mandatory THEN 10000 ELSE CASE WHEN r.api_type IS NULL THEN 0 ELSE 300 END + g.priority
            + coalesce(list_sum(list_transform(r.keywords, lambda k:
                CASE WHEN len(list_filter(g.tags, lambda x: contains(lower(x), lower(k)))) > 0 THEN 150 ELSE 0 END
                + CASE WHEN contains(lower(g.summary), lower(k)) THEN 100 ELSE 0 END
                + CASE WHEN contains(lower(g.content), lower(k)) THEN 50 ELSE 0 END)), 0) END AS score
            FROM {requests} r JOIN gt g ON g.mandatory OR r.api_type IS NULL OR g.api_type = r.api_type OR g.api_type = 'any'""",
        "gc_found": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS pos FROM gc_scores) WHERE pos <= {k}",
        **combine_ctes("gc_found"),
    }


WANTED = {"gc_wanted": f"SELECT request_id AS rid, unnest(w) AS id, generate_subscripts(w, 1) AS pos FROM "
                       f"(SELECT request_id, {Q.split('wanted_s')} AS w FROM requests)"}


@query("combine_guides", "SELECT rid AS request_id, position, id, priority, version, scope FROM gc_places JOIN guides USING (id)",
       ("requests", "guides"), {**WANTED, **combine_ctes("gc_wanted")})
def _(t):
    wanted = t.requests.select("request_id", F.posexplode("wanted").alias("position", "id"))
    return G.combine_guides(wanted, t.guides)


@query("guides_for_metadata", "SELECT rid AS doc_id, combined, n_guides FROM gc_text", ("file_meta", "guides"), {
       "asking": f"SELECT doc_id AS rid, api_type, list_distinct(list_transform({META_WORDS}, lambda w: lower(w))) AS keywords FROM file_meta",
       **search_ctes("asking", 5)})
def _(t):
    return G.guides_for(G.metadata_requests(t.file_meta, k_methods=5), t.guides, max_guides=5, max_chars=50000,
                        request_key="doc_id")


# every guide found, whole texts
@query("guides_for_metadata_whole", "SELECT rid AS doc_id, combined, n_guides FROM gc_text", ("file_meta", "guides"), {
       "asking": f"""SELECT doc_id AS rid, api_type, list_distinct(list_transform({META_WORDS.replace('[1:5]', '')}, lambda w: lower(w))) AS keywords
            FROM file_meta""", **{n: q.replace(", 1, 50000)", ", 1)") for n, q in search_ctes("asking", 1 << 40).items()}})
def _(t):
    return G.guides_for(G.metadata_requests(t.file_meta), t.guides, request_key="doc_id")


_DIM_COUNTS = ", ".join(
    f"{{'n': -({' + '.join(f'contains(low, {Q.lit(w)})::INT' for w in ws)}), 'o': {i}, 'd': '{d}'}}"
    for i, (d, ws) in enumerate(R.DIMENSION_WORDS))
DIMS = {"req_low": f"SELECT *, lower(description) || ' ' || array_to_string(keywords, ' ') AS low_all FROM req",
        "dim0": f"SELECT *, list_filter(list_sort([{_DIM_COUNTS.replace('contains(low,', 'contains(low_all,')}]), lambda x: x.n < 0) AS hits FROM req_low",
        "dims": "SELECT *, CASE WHEN len(hits) > 0 THEN list_transform(hits[1:3], lambda x: x.d) "
                "ELSE ['structure', 'apiConnection'] END AS dimensions FROM dim0"}


def dimension_rows(t):
    text = t.request_rows.withColumn("low_all", F.concat_ws(" ", "low", F.array_join("keywords", " ")))
    return text.withColumn("dimensions", C.important_dimensions(F.col("low_all")))


@query("important_dimensions", "SELECT request_id, array_to_string(dimensions, ',') AS dimensions FROM dims", ("requests",), {**REQUESTS, **DIMS})
def _(t):
    return dimension_rows(t).select("request_id", F.array_join("dimensions", ",").alias("dimensions"))




def _picked(prefix):
    whens = " ".join(f"WHEN '{d}' THEN {prefix}\"{d}\"" for d in R.DIMENSIONS)
    return f"list_transform(dimensions, lambda x: CASE x {whens} END)"


BEST = {
    **Q.SCORED, **REQUESTS, **DIMS,
    "forms": "SELECT DISTINCT file_role, dimensions FROM dims",
    "forms_id": "SELECT *, row_number() OVER (ORDER BY file_role, dimensions) AS form FROM forms",
    "cand": "SELECT f.form, f.dimensions, s.* FROM forms_id f JOIN scored s ON f.file_role IS NULL OR f.file_role = s.file_role",
    "mean": "SELECT form, any_value(dimensions) AS dimensions, count(*) AS total, "
            + ", ".join(f'avg("{d}") AS "{d}"' for d in R.DIMENSIONS) + " FROM cand GROUP BY form",
    "low": f"SELECT form, total, list_min({_picked('')}) AS lowest FROM mean",
    "thr": "SELECT *, CASE WHEN lowest < 75 THEN greatest(lowest * 1.1::DOUBLE, lowest + 10) ELSE 75 END AS threshold FROM low",
    "val": f"SELECT form, doc_id, dimensions, {_picked('')} AS picked FROM cand",
    "val2": """SELECT v.*, list_max(picked) AS top_score, list_sum(picked) / len(picked) AS mean, threshold, total,
        max(list_max(picked)) OVER (PARTITION BY v.form) >= threshold AS found FROM val v JOIN thr USING (form)""",
    "val3": "SELECT *, row_number() OVER (PARTITION BY form ORDER BY mean DESC, top_score DESC, doc_id) AS place FROM val2",
    "kept": "SELECT *, row_number() OVER (PARTITION BY form ORDER BY top_score DESC, doc_id) AS rank FROM val3 "
            "WHERE CASE WHEN found THEN top_score >= threshold ELSE place <= ceil(total * 0.1) END",
}


@query("best_practice_search", """SELECT d.request_id, k.rank, k.doc_id, k.top_score, array_to_string(CASE WHEN found THEN
       list_filter(k.dimensions, lambda x, i: k.picked[i] >= threshold) ELSE k.dimensions END, ',') AS excellent_in
       FROM dims d JOIN forms_id f ON d.file_role IS NOT DISTINCT FROM f.file_role AND d.dimensions = f.dimensions
       JOIN kept k ON k.form = f.form AND k.rank <= 3""", ("files", "requests"), BEST)
def _(t):
    best = C.best_practice(dimension_rows(t), C.score_signatures(t.case_store, 3))
    return best.select("request_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "top_score",
                       F.array_join("excellent_in", ",").alias("excellent_in"))


HIT_ROWS = {"hit_rows": "SELECT h.request_id, h.rank, f.* FROM hits h JOIN features f USING (doc_id)"}
_VERDICT = ("CASE WHEN len(list_filter(api_methods, lambda m: contains(m, 'grpc'))) > 0 OR list_contains(keywords, 'grpc') THEN 'grpc' "
            "WHEN list_contains(keywords, 'rest') OR list_contains(keywords, 'openapi') THEN 'openapi' END")


def hit_rows(t):
    return t.hits.join(t.case_store.select("doc_id", "project", "keywords", "api_methods"), "doc_id")


@query("infer_api_from_hits", f"""SELECT request_id, coalesce(arg_min(v, rank) FILTER (v IS NOT NULL), 'any') AS api_type FROM
       (SELECT request_id, rank, {_VERDICT} AS v FROM hit_rows) GROUP BY request_id""", ("files", "requests"), {**RECOMMEND, **HIT_ROWS})
def _(t):
    return C.infer_api(hit_rows(t))


@query("union_keywords", f"""SELECT request_id, unnest(keywords) AS keyword FROM req UNION SELECT request_id, unnest(list_concat(h.keywords,
       {Q.split('patterns_s')})) FROM hit_rows h JOIN file_meta USING (doc_id)""", ("file_meta", "requests"), {**RECOMMEND, **HIT_ROWS})
def _(t):
    hits = hit_rows(t).join(t.file_meta.select("doc_id", "patterns"), "doc_id")
    return J.union_keywords(t.request_rows, hits)


_CONTEXT = {
    **RECOMMEND, **HIT_ROWS, **DIMS, **{k: v for k, v in BEST.items() if k not in RECOMMEND and k not in DIMS}, **MANIFESTS,
    "all_words": f"""SELECT request_id, list(DISTINCT keyword) AS keywords FROM (SELECT request_id, unnest(keywords) AS keyword FROM req
        UNION ALL SELECT request_id, unnest(list_concat(h.keywords, {Q.split('patterns_s')})) FROM hit_rows h JOIN file_meta USING (doc_id))
        GROUP BY request_id""",
    "found": """SELECT request_id, count(*) AS recommendations, arg_min(project, rank) AS project FROM hit_rows GROUP BY request_id""",
    "apis": f"SELECT request_id, arg_min(v, rank) FILTER (v IS NOT NULL) AS api_type FROM (SELECT request_id, rank, {_VERDICT} AS v FROM hit_rows) GROUP BY request_id",
    "asking": "SELECT request_id AS rid, keywords, api_type FROM found JOIN all_words USING (request_id) JOIN apis USING (request_id)",
    **search_ctes("asking", 5),
    "shown": """SELECT d.request_id, count(*) AS examples FROM dims d JOIN forms_id f ON d.file_role IS NOT DISTINCT FROM f.file_role
        AND d.dimensions = f.dimensions JOIN kept k ON k.form = f.form AND k.rank <= 3 GROUP BY d.request_id""",
    "facts": f"""SELECT regexp_replace(path, '^n', 'src') AS project, {API_TYPE} AS project_api,
        list_filter(packages, lambda d: list_contains({SYSTEMS}, d))[1] AS design_system FROM deps""",
}


@query("request_context", """SELECT d.request_id, array_to_string(d.dimensions, ',') AS dimensions, coalesce(recommendations, 0) AS recommendations, project,
       coalesce(n_guides, 0) AS n_guides, coalesce(length(combined), 0) AS guide_chars, coalesce(examples, 0) AS examples, project_api, design_system,
       CASE WHEN recommendations IS NULL THEN 'no_recommendations'
            WHEN n_guides IS NULL THEN 'no_guides' ELSE '' END AS warnings
       FROM dims d LEFT JOIN found USING (request_id) LEFT JOIN gc_text g ON g.rid = d.request_id LEFT JOIN shown USING (request_id)
       LEFT JOIN facts USING (project)""", ("files", "file_meta", "requests", "guides", "manifests"), _CONTEXT)
def _(t):
    """Per request: recommendations, keywords, guides, project facts, examples and warnings."""
    rows = hit_rows(t)
    requests = dimension_rows(t)
    patterns = t.file_meta.select("doc_id", "patterns")
    words = J.union_keywords(requests, rows.join(patterns, "doc_id")).groupBy("request_id").agg(
        F.array_sort(F.collect_list("keyword")).alias("all_keywords"))
    found = rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("recommendations"), F.min_by("project", "rank").alias("project"))
    wanted = found.select("request_id").join(words, "request_id").join(C.infer_api(rows), "request_id").select(
        "request_id", F.col("all_keywords").alias("keywords"), F.when(F.col("api_type") != "any", F.col("api_type")).alias("api_type"))
    texts = G.guides_for(wanted, t.guides, max_guides=5, max_chars=50000).select("request_id", "n_guides", F.length("combined").alias("guide_chars"))
    examples = C.best_practice(requests, C.score_signatures(t.case_store, 3)).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("examples"))
    facts = P.manifest_libraries(P.manifest_api_type(P.parse_manifests(t.manifests)))
    facts = facts.select(F.regexp_replace("path", "^n", "src").alias("project"), F.col("api_type").alias("project_api"), "design_system")
    warnings = F.array_compact(F.array(
        F.when(F.col("recommendations").isNull(), F.lit("no_recommendations")),
        F.when(F.col("recommendations").isNotNull() & F.col("n_guides").isNull(), F.lit("no_guides"))))
    return (requests.select("request_id", F.array_join("dimensions", ",").alias("dimensions"))
            .join(found, "request_id", "left").join(texts, "request_id", "left").join(examples, "request_id", "left")
            .join(facts, "project", "left").withColumn("warnings", F.array_join(warnings, "; "))
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("recommendations", "n_guides", "guide_chars", "examples")})
            .withColumn("guide_chars", F.col("guide_chars").cast("bigint")))
