"""Trees, record stores, facets, projects and packages."""

import json

import pytest
from pyspark.sql import Row, functions as F

from corpuslens.functions import rules as R
from corpuslens.operators import facets as A, joins as J, packages as P, similar as M
from corpuslens.sources import store as O, tree as E


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_source_tree(spark, tmp_path):
    write(tmp_path, {"app/pages/a.vue": "A", "app/pages/deep/b.TS": "B", "app/pages/.hidden/c.ts": "", "app/pages/node_modules/d.ts": "",
                     "app/utils/e.js": "E", "app/utils/f.css": "", "app/src/g.ts": "", "app/h.ts": "", "lib/dist/i.ts": "", "lib/src/j.tsx": "J",
                     "app/pages/with space.vue": "S"})
    texts = E.read_text_files(spark, str(tmp_path))
    got = {(r.project, r.path): r.content for r in E.source_files(texts).collect()}
    assert got == {("app", "pages/a.vue"): "A", ("app", "pages/deep/b.TS"): "B", ("app", "utils/e.js"): "E", ("app", "pages/with space.vue"): "S"}
    capped = E.source_files(texts, cap=2).collect()
    assert sorted(r.path for r in capped) == ["pages/a.vue", "pages/deep/b.TS"]
    package = {(r.project, r.path) for r in E.package_sources(texts).collect()}
    assert ("lib", "src/j.tsx") in package and ("lib", "dist/i.ts") not in package and ("app", "utils/e.js") not in package
    listing = E.list_files(spark, str(tmp_path))
    assert listing.filter("relative_path = 'app/pages/a.vue'").first().size == 1


def test_read_cases_quarantines_what_does_not_parse(spark, tmp_path):
    write(tmp_path, {"a.json": json.dumps({"filePath": "x", "scores": {"structure": 1.5}}, indent=2), "b.json": "{ broken",
                     "c.json": json.dumps({"projectName": "other kind"}), "index-page.json": json.dumps({"filePath": "y", "scores": {"structure": 2}})})
    good, bad = O.read_cases(spark, str(tmp_path), "filePath STRING, scores STRUCT<structure: DOUBLE>", ["filePath", "scores"])
    assert sorted((r.filePath, r.scores.structure) for r in good.collect()) == [("x", 1.5), ("y", 2.0)]
    assert [r._corrupt for r in bad.collect()] == ["{ broken"]


def test_upsert_and_delete(spark):
    store = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id INT, v STRING, t INT")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id INT, v STRING, t INT")
    once = O.upsert(store, batch, "id", "t")
    want = [(1, "a"), (2, "y"), (3, "z")]
    assert sorted((r.id, r.v) for r in once.collect()) == want
    assert sorted((r.id, r.v) for r in O.upsert(once, batch, "id", "t").collect()) == want
    keys = spark.createDataFrame([(2,), (9,), (2,)], "id INT")
    assert sorted(r.id for r in O.delete_by_key(store, keys, "id").collect()) == [1]
    assert sorted(map(tuple, O.delete_results(store, keys, "id").collect())) == [(2, True), (9, False)]


def test_work_dir_is_the_shared_folder(spark):
    assert O.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = O.write_table(spark.range(3), "t")
    assert df.count() == 3 and df.inputFiles()[0].removeprefix("file://").startswith(O.work_dir(spark))


# --- facets, on the six cases of the hand-made fixture

CASES = [
    ("001", "project-a", "frontend", [95, 60, 70, 65, 55, 75, 60, 80], 72, ["structure"], ["vue3", "structure"]),
    ("002", "project-a", "api", [65, 92, 55, 60, 85, 80, 70, 75], 75, ["apiConnection", "errorHandling"], ["grpc", "composable"]),
    ("003", "project-b", "frontend", [70, 65, 88, 72, 68, 75, 65, 70], 71, ["designSystem"], ["vue3", "design-system"]),
]


@pytest.fixture(scope="module")
def cases(spark):
    from corpuslens.functions import scoring as S
    rows = [(i, p, c, *map(float, s), t, e, g) for i, p, c, s, t, e, g in CASES]
    df = spark.createDataFrame(rows, "id STRING, project STRING, category STRING, " + ", ".join(f"{d} DOUBLE" for d in R.DIMENSIONS)
                               + ", total_score INT, excellent_in ARRAY<STRING>, tags ARRAY<STRING>")
    return df.withColumn("grade", S.grade(F.col("total_score")))


@pytest.fixture(scope="module")
def postings(cases):
    return A.facet_postings(cases, {"project": "project", "excellence": "excellent_in", "tag": "tags", "grade": "grade"})


@pytest.mark.parametrize("query,ids", [
    (dict(excellent=["structure"]), ["001"]), (dict(excellent=["apiConnection"]), ["002"]), (dict(project="project-a"), ["001", "002"]),
    (dict(tags=["vue3"]), ["001", "003"]), (dict(project="project-a", excellent=["structure"]), ["001"]), (dict(grade="excellent"), []),
    (dict(grade="good"), ["001", "002", "003"]), (dict(min_total=72), ["001", "002"]), ({}, ["001", "002", "003"])])
def test_search_facets(cases, postings, query, ids):
    assert sorted(r.id for r in A.search_facets(postings, cases, **query).collect()) == ids


def test_facet_stats(postings):
    stats = {(r.facet, r.term): r.n for r in A.facet_stats(postings).collect()}
    assert [stats[("total", x)] for x in ("cases", "projects", "tags")] == [3, 2, 5]
    assert [stats[("excellence", d)] for d in ("structure", "apiConnection", "errorHandling", "designSystem", "performance")] == [1, 1, 1, 1, 0]
    assert stats[("grade", "good")] == 3 and stats[("grade", "poor")] == 0


def test_ranking_order(spark):
    rows = [("a", "p2", None, None, "S"), ("b", "p1", None, None, "A"), ("c", "p3", 70, ["x"], None), ("d", "p4", 70, ["x", "y"], None), ("e", "p0", 90, [], None)]
    df = spark.createDataFrame(rows, "id STRING, project STRING, total_score INT, excellent_in ARRAY<STRING>, legacy_tier STRING")
    assert [r.id for r in A.rank_cases(df).collect()] == ["e", "d", "c", "a", "b"]


# --- manifests and packages

def test_manifests(spark):
    rows = [("a", 1, {"dependencies": {"nuxt": "3", "@grpc/grpc-js": "1"}, "devDependencies": {"nuxt": "4", "swagger-ui": "1"}}),
            ("a/x", 2, {"dependencies": {"nuxt3": "1"}}), ("b", 1, {"dependencies": {"axios": "1", "lodash-es": "1", "vuetify": "1"}}),
            ("b/y", 2, {"devDependencies": {"@nuxt/core": "1"}}), (".c", 1, {"dependencies": {"nuxt": "3"}}), ("d", 1, None)]
    df = spark.createDataFrame([(p, d, json.dumps(j) if j else "not json") for p, d, j in rows], "path STRING, depth INT, json STRING")
    parsed = P.parse_manifests(df)
    assert sorted(r.path for r in P.discover_projects(parsed).collect()) == ["a", "b/y"]
    facts = {r.path: r for r in P.manifest_libraries(P.manifest_api_type(parsed)).collect()}
    assert (facts["a"].api_type, facts["a"].confidence, facts["a"].versions["nuxt"]) == ("mixed", "high", "4")
    assert (facts["b"].api_type, facts["b"].confidence, facts["b"].design_system, facts["b"].utility_library) == ("rest", "medium", "vuetify", "axios")
    assert (facts["d"].api_type, facts["d"].readable) == ("unknown", False)


def test_component_names(spark):
    files = spark.createDataFrame([(1, "k", "src/components/common/ToolTip.vue"), (2, "k", "src/components/base/Box.vue"), (3, "k", "src/Raw.vue"),
                                   (4, "other", "src/components/common/ToolTip.vue")], "doc_id INT, project STRING, path STRING")
    module = ('addComponentsDir({ path: resolve(dir, "components", "common"), prefix: "Common" })\n'
              "addComponentsDir( { path: resolve(dir, 'base'), prefix: 'B' } )\nexport { Box as NiceBox, Other }")
    modules = spark.createDataFrame([(9, "k", module)], "doc_id INT, project STRING, content STRING")
    names = {r.doc_id: r.name for r in P.name_components(files, modules).collect()}
    assert names == {1: "CommonToolTip", 2: "NiceBox", 3: "Raw", 4: "ToolTip"}


def test_worklist(spark):
    df = spark.createDataFrame([(1, "hybrid", False), (2, "utility", False), (3, "design-system", True)], "id INT, type STRING, analyzed BOOLEAN")
    assert sorted(r.id for r in P.package_worklist(df).collect()) == [1, 2]
    assert sorted(r.id for r in P.package_worklist(df, "all", "design-system").collect()) == [1, 3]


def test_catalogue_has_no_duplicate_rows():
    rows = R.catalogue_rows()
    assert len(rows) == len(set(rows)) == 98


# --- joins and similar pages

def test_category_match(spark):
    df = spark.createDataFrame([("List", "list"), ("table-view", "list"), ("login", "list"), ("user-profile", "account")], "a STRING, b STRING")
    assert [r[0] for r in df.select(J.category_match(F.col("a"), F.col("b"))).collect()] == ["exact", "partial", "none", "partial"]


def test_similar_gives_credit_for_open_criteria(spark):
    row = Row(id=1, category="list", api_type="grpc", design_system=None, frameworks=["vue3"], tags=["x"], total_score=90.0)
    schema = "id INT, category STRING, api_type STRING, design_system STRING, frameworks ARRAY<STRING>, tags ARRAY<STRING>, total_score DOUBLE"
    df = spark.createDataFrame([row], schema)
    assert M.similar(df, {}).first().match_score == 15 + 10 + 8 + 6 + 2 + 5
    full = {"category": "list", "api_type": "grpc", "design_system": "q", "frameworks": ["vue3", "pinia"], "tags": ["x"]}
    r = M.similar(df, full).first()
    assert r.match_score == 35 + 25 + 0 + 8 + 5 + 5 and r.match_reasons == ["category exact", "api type", "frameworks", "tags", "quality"]
    assert M.similar(df, {"category": "login"}, min_score=60).count() == 0


def test_load_one_raises_for_a_missing_key(cases):
    assert A.load_one(cases, "002").project == "project-a"
    with pytest.raises(KeyError):
        A.load_one(cases, "nope")
