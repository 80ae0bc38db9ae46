"""Queries: predicates and faceted search."""

from functools import reduce

from pyspark.sql import functions as F

from corpuslens.operators import bitmaps as B, facets as A, terms as T
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.aggregates import POSTINGS
from corpuslens.plans.features import FILES, REQUESTS, joined
from corpuslens.plans.registry import query
from corpuslens.sources.store import written_once


def _exists(values, word):
    return f"len(list_filter({values}, lambda v: contains(lower(v), '{word}'))) > 0"


_SEARCH = f"""SELECT doc_id, project, file_role, total_score FROM scored WHERE file_role = 'page'
       AND "apiConnection" >= 40 AND ({_exists('keywords', 'rest')} OR {_exists('keywords', 'sort')} OR {_exists('keywords', 'stat')})
       AND {_exists('keywords', 'form')} AND {_exists('keywords', 'sea')} AND {_exists('entities', 'dto')}
       AND {_exists('components_used', 'card')} AND {_exists('api_methods', 'get')}"""
_SEARCHED = dict(role="page", keywords=["REST", "sort", "stat"], keywords_all=["form", "Sea"],
                 min_scores={"apiConnection": 40}, entities=["Dto"], components=["card"], methods=["get"])


@query("search_files", _SEARCH, FILES, Q.SCORED)
def _(t):
    return A.search_files(t.case_store, **_SEARCHED).select("doc_id", "project", "file_role", "total_score")


def term_index(t):
    columns = {"keywords": "keywords", "entities": "entities", "components": "components_used", "methods": "api_methods"}
    return T.build_index(t.case_store, columns, "doc_id")


@query("search_files_indexed", _SEARCH, FILES, Q.SCORED)
def _(t):
    return T.search_files(t.case_store, term_index(t), **_SEARCHED).select("doc_id", "project", "file_role", "total_score")


# every distinct keyword of the requests, wanted in the keywords or entities of a file
@query("search_files_bulk", f"""SELECT n.request, s.doc_id FROM (SELECT DISTINCT unnest(keywords) AS request FROM req) n
       JOIN scored s ON {_exists('s.keywords', "' || lower(n.request) || '")} OR {_exists('s.entities', "' || lower(n.request) || '")}""",
       (*FILES, "requests"), {**Q.SCORED, **REQUESTS})
def _(t):
    words = t.request_rows.select(F.explode("keywords").alias("request")).distinct()
    asked = words.select("request", F.lit(0).alias("part"), F.explode(F.array(F.lit("keywords"), F.lit("entities"))).alias("field"),
                         F.col("request").alias("needle"))
    return T.matching(asked, term_index(t)).select("request", "doc_id")


_SHORTCUTS = [
    ("keywords", f"{_exists('keywords', 'search')} OR {_exists('keywords', 'modal')}", 10),
    ("function", _exists("keywords", "table"), 10), ("min_score", '"typeUsage" >= 50', None),
    ("role", "file_role = 'store' AND project = 'src1'", 10), ("entity", _exists("entities", "user"), 10),
    ("recommended", f"{_exists('keywords', 'search')} AND file_role = 'page' AND {_exists('entities', 'the')}", 5),
]


def _shortcuts_sql(cut: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS shortcut, doc_id FROM scored WHERE {w}{f' ORDER BY doc_id LIMIT {k}' if k and cut else ''})"
        for n, w, k in _SHORTCUTS)


def _shortcuts(t, cut: bool):
    df = t.case_store.select("doc_id", "project", "file_role", "keywords", "entities", "typeUsage")
    ten, five = (10, 5) if cut else (None, None)
    parts = {"keywords": A.by_keywords(df, "search", "modal", limit=ten), "function": A.by_function(df, "table", limit=ten),
             "min_score": A.by_min_score(df, "typeUsage", 50), "role": A.by_role(df, "store", "src1", limit=ten),
             "entity": A.by_entity(df, "user", limit=ten), "recommended": A.recommended_code(df, "search", "page", ["the"], limit=five)}
    return reduce(lambda a, b: a.unionByName(b),
                  [p.select(F.lit(n).alias("shortcut"), "doc_id") for n, p in parts.items()])


@query("search_files_shortcuts", _shortcuts_sql(True), FILES, Q.SCORED)
def _(t):
    return _shortcuts(t, True)


@query("search_files_shortcuts_whole", _shortcuts_sql(False), FILES, Q.SCORED)
def _(t):
    return _shortcuts(t, False)


@query("search_cases_exact", f"""SELECT id, project, category, coalesce(raw_score, -1) AS score FROM cases WHERE category = 'table-browse'
       AND list_has_any({Q.split('tags_s')}, ['search', 'form'])""", ("cases",))
def _(t):
    return A.search_exact(t.cases, category="table-browse", tags=["search", "form"]).select(
        "id", "project", "category", F.coalesce("raw_score", F.lit(-1.0)).alias("score"))


_ANY = "doc_id IN (SELECT doc_id FROM postings WHERE facet = '{}' AND term IN ({}))"


@query("search_facets", "SELECT doc_id, grade, total_score FROM graded WHERE coalesce(total_score, 0) >= 40 AND "
       + _ANY.format("tag", "'search', 'grpc'") + " AND " + _ANY.format("grade", "'poor'") + " AND "
       + _ANY.format("project", "'src3'"), FILES, POSTINGS)
def _(t):
    return A.search_facets(t.postings, t.case_store, "doc_id", project="src3", tags=["search", "grpc"], grade="poor",
                           min_total=40).select("doc_id", "grade", "total_score")


def bitmap_tables(t):
    numbers = written_once(t.spark, f"numbers-{t.sf_dir}", lambda: B.record_numbers(t.case_store, "doc_id"))
    return written_once(t.spark, f"bitmaps-{t.sf_dir}", lambda: B.facet_bitmaps(t.postings, numbers, "doc_id"), ["facet"]), numbers


@query("facet_counts_bitmaps", "SELECT facet, term, count(*) AS n FROM postings GROUP BY ALL", FILES, POSTINGS)
def _(t):
    return B.counts(bitmap_tables(t)[0])


@query("search_facets_bitmaps", "SELECT doc_id, grade, total_score FROM graded WHERE coalesce(total_score, 0) >= 40 AND "
       + _ANY.format("tag", "'search', 'grpc'") + " AND " + _ANY.format("grade", "'poor'") + " AND "
       + _ANY.format("project", "'src3'"), FILES, POSTINGS)
def _(t):
    bitmaps, numbers = bitmap_tables(t)
    return B.search(bitmaps, numbers, t.case_store, "doc_id", project="src3", tags=["search", "grpc"], grade="poor",
                    min_total=40).select("doc_id", "grade", "total_score")


@query("intersect_facets_bitmaps", "SELECT DISTINCT doc_id FROM postings WHERE " + _ANY.format("tag", "'search', 'list'") + " AND "
       + _ANY.format("project", "'src1', 'src2', 'src3'") + " AND " + _ANY.format("grade", "'poor'"), FILES, POSTINGS)
def _(t):
    bitmaps, numbers = bitmap_tables(t)
    wanted = {"tag": ["search", "list"], "project": ["src1", "src2", "src3"], "grade": ["poor"]}
    return B.keys_of(B.matching(bitmaps, wanted), numbers)


@query("search_score_ranges", """SELECT doc_id, structure, "apiConnection", total_score FROM graded
       WHERE "apiConnection" >= 50 AND structure <= 70 AND "errorHandling" BETWEEN 20 AND 60""", FILES, Q.SCORED | {
       "graded": f"SELECT *, {Q.grade('total_score')} AS grade FROM scored"})
def _(t):
    return A.score_ranges(t.case_store, {"apiConnection": (50, None), "structure": (None, 70), "errorHandling": (20, 60)}
                          ).select("doc_id", "structure", "apiConnection", "total_score")


# listing order over the page exemplars: unscored rows have a null total
_LIST = {"listed": f"""SELECT id, project, raw_score AS total_score, {Q.split('tags_s')} AS excellent_in,
         CASE WHEN raw_score > 60 THEN 'A' WHEN api_type = 'grpc' THEN 'C' END AS legacy_tier FROM cases"""}


@query("list_cases_ranked", """SELECT id, project, coalesce(total_score, -1) AS total, len(excellent_in) AS n_excellent, legacy_tier FROM listed
       ORDER BY total_score DESC NULLS LAST, CASE WHEN total_score IS NOT NULL THEN len(excellent_in) ELSE 0 END DESC,
       CASE legacy_tier WHEN 'A' THEN 4 WHEN 'C' THEN 2 ELSE 0 END DESC, project, id""",
       ("cases",), _LIST)
def _(t):
    listed = t.cases.select("id", "project", F.col("raw_score").alias("total_score"), F.col("tags").alias("excellent_in"),
                            F.when(F.col("raw_score") > 60, "A").when(F.col("api_type") == "grpc", "C").alias("legacy_tier"))
    return A.rank_cases(listed).select("id", "project", F.coalesce("total_score", F.lit(-1.0)).alias("total"), F.size("excellent_in").cast("bigint").alias("n_excellent"),
                                       "legacy_tier")
