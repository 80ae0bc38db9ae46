"""Queries: scans, record stores and keyed writes."""

from pyspark.sql import functions as F

from corpuslens.functions import rules as R
from corpuslens.operators import facets as A, lines as L
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.features import FILES
from corpuslens.plans.registry import query
from corpuslens.sources import store as O, tree as E

# the tree the files would lie in, with places a scan must skip
_REL = ("project || '/' || CASE WHEN n_chars < 200 THEN 'node_modules/' WHEN n_chars < 400 THEN '.cache/' "
        "WHEN n_chars < 600 THEN 'pages/.hidden/' WHEN n_chars < 800 THEN 'pages/dist/' ELSE '' END || path")
_TREE = {"tree": f"SELECT doc_id, {_REL} AS relative_path, length(content) AS size FROM files",
         "inner_paths": "SELECT *, string_split(relative_path, '/')[1] AS project, relative_path[length(string_split(relative_path, '/')[1]) + 2:] AS path FROM tree"}


def tree(t):
    return t.files.select("doc_id", F.expr(_REL).alias("relative_path"), F.length("content").cast("bigint").alias("size"))


_EXT = "regexp_matches(lower(path), '\\.({})$')"


@query("scan_source_tree", f"""SELECT doc_id, project, path FROM inner_paths WHERE {_EXT.format('|'.join(R.SCAN_EXTENSIONS))}
       AND NOT list_contains(string_split(path, '/'), 'node_modules') AND NOT regexp_matches(path, '(^|/)\\.')
       AND string_split(path, '/')[1] IN ({', '.join(map(Q.lit, R.SCAN_FOLDERS))}) AND contains(path, '/')""", FILES, _TREE)
def _(t):
    return E.source_files(tree(t)).select("doc_id", "project", "path")


@query("scan_package_sources", f"""SELECT doc_id, project, path FROM inner_paths WHERE {_EXT.format('|'.join(R.PACKAGE_EXTENSIONS))}
       AND NOT list_has_any(string_split(path, '/'), ['node_modules', 'dist', '.git'])""", FILES, _TREE)
def _(t):
    return E.package_sources(tree(t)).select("doc_id", "project", "path")


@query("glob_file_search", """SELECT doc_id, regexp_extract(relative_path, '([^/]*)$', 1) AS name, relative_path AS path, size FROM tree
       WHERE regexp_matches(regexp_extract(relative_path, '([^/]*)$', 1), '^.*e.\\.ts$')""", FILES, _TREE)
def _(t):
    return L.glob_files(tree(t).withColumnRenamed("relative_path", "path"), "*e?.ts").select("doc_id", "name", "path", "size")


# the record store as JSON: Spanish records are cut short, German ones are of another kind
@query("read_case_store", """SELECT doc_id, project, path, 'record' AS status FROM files WHERE lang NOT IN ('es', 'de')
       UNION ALL SELECT -1, NULL, NULL, 'corrupt' FROM files WHERE lang = 'es'""", FILES)
def _(t):
    doc = F.to_json(F.struct("doc_id", "project", "path", F.when(F.col("lang") != "de", F.struct(
        F.col("n_chars").alias("structure"))).alias("scores")))
    path = O.fresh_path(t.spark, "json-store")
    (t.files.select(F.when(F.col("lang") == "es", F.substr(doc, F.lit(1), F.length(doc) - 1)).otherwise(doc).alias("value"))
     .write.text(path))
    good, bad = O.read_cases(t.spark, path, "doc_id BIGINT, project STRING, path STRING, scores STRUCT<structure: BIGINT>",
                             ["path", "scores"], one_per_file=False)
    nothing = [F.lit(-1).cast("bigint").alias("doc_id"), *[F.lit(None).cast("string").alias(c) for c in ("project", "path")]]
    return good.select("doc_id", "project", "path", F.lit("record").alias("status")).unionByName(
        bad.select(*nothing, F.lit("corrupt").alias("status")))


_LINE = {"order_lines": "SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem"}


@query("upsert_case", """SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
       UNION ALL SELECT l_orderkey, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FROM lineitem GROUP BY l_orderkey""")
def _(t):
    store = O.RecordStore(t.spark, O.fresh_path(t.spark, "order-store"), "o_orderkey", buckets=8)
    store.replace(t.orders.select("o_orderkey", F.col("o_totalprice").alias("price")))
    batch = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"),
                              "l_linenumber", "l_partkey", "l_suppkey")
    return store.save(batch, "l_linenumber", "l_partkey", "l_suppkey", "price")


@query("delete_case", """SELECT o_orderkey, false AS deleted FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
       UNION ALL SELECT DISTINCT l_orderkey, true FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def _(t):
    keys = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    store = O.RecordStore(t.spark, O.fresh_path(t.spark, "order-store"), "o_orderkey", buckets=8)
    store.replace(t.orders)
    left = store.delete(keys).select("o_orderkey", F.lit(False).alias("deleted"))
    gone = O.delete_results(t.orders, keys, "o_orderkey").filter("deleted")
    return left.unionByName(gone)


@query("read_guides", f"""SELECT id, scope, api_type, {Q.joined(Q.split('tags_s'))} AS tags, priority, version, mandatory, trim(content, ' ' || chr(10) || chr(9)) AS content,
       summary, requires_s AS requires, excludes_s AS excludes FROM guides""", ("guides",))
def _(t):
    g = F.col
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    text = F.concat(
        F.lit("---\r\nid: "), g("id"), F.lit("\r\n# a comment\r\nscope: "), g("scope"), F.lit("\r\napiType: '"), g("api_type"),
        F.lit("'\r\ntags: "), listed("tags"), F.lit("\r\npriority: "), g("priority").cast("string"), F.lit('\r\nversion: "'), g("version"),
        F.lit('"\r\nrequires: '), listed("requires"), F.lit("\r\nexcludes: "), listed("excludes"), F.lit("\r\nsummary: "), g("summary"),
        F.lit("\r\nmandatory: "), g("mandatory").cast("string"), F.lit("\r\n---\r\n\r\n"), g("content"))
    texts = t.guides.select(F.col("file_path").alias("relative_path"), text.alias("content"))
    rows = E.typed_guides(E.front_matter(texts))
    return rows.select("id", "scope", "api_type", F.array_join(F.array_sort(F.array_distinct("tags")), ",").alias("tags"), "priority", "version",
                       "mandatory", "content", "summary", F.array_join("requires", "|").alias("requires"), F.array_join("excludes", "|").alias("excludes"))


@query("case_by_id", """SELECT k.vec_id AS doc_id, d.doc_id IS NOT NULL AS found, d.source, coalesce(d.n_chars, -1) AS n_chars
       FROM (SELECT vec_id FROM embeddings UNION SELECT l_partkey FROM lineitem) k LEFT JOIN documents d ON k.vec_id = d.doc_id""")
def _(t):
    keys = t.embeddings.select(F.col("vec_id").alias("doc_id")).union(t.lineitem.select("l_partkey")).distinct()
    return A.by_keys(t.documents.select("doc_id", "source", "n_chars"), keys, "doc_id").select(
        "doc_id", "found", "source", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query("load_first_case", "SELECT id, project, category FROM cases WHERE category = 'detail' AND api_type = 'grpc' ORDER BY id LIMIT 1", ("cases",))
def _(t):
    return A.first_match(t.cases, category="detail", api_type="grpc").select("id", "project", "category")
