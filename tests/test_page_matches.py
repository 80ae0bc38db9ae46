"""Bulk page matching against one request at a time."""

import itertools
import random

from pyspark.sql import functions as F

from corpuslens.operators import page_matches as B, similar as M

CASES = ("id long, project string, category string, api_type string, design_system string, frameworks array<string>, "
         "tags array<string>, total_score double")


def case_rows(n, seed):
    rng = random.Random(seed)
    lists = [None, [], ["vue3"], ["vue3", "pinia"], ["vuex", "vue3"], ["a", "b", "c"], ["vue3", "vue3"]]
    return [(i, f"p{i % 7}", rng.choice(["list", "Table-Browse", "detail", "form-edit", "index form", None, "zzz"]),
             rng.choice(["grpc", "openapi", "mixed", None, "rest"]), rng.choice(["element-plus", "vuetify", None]),
             rng.choice(lists), rng.choice(lists + [["en", "x"], ["en"]]), rng.choice([None, 0.0, 12.0, 50.0, 85.0, 99.0]))
            for i in rng.sample(range(10 * n), n)]


def single(cases, criteria, **how):
    return [(r.id, r.match_score, r.match_reasons) for r in M.similar(cases, criteria, **how).collect()]


def test_bulk_equals_one_by_one(spark):
    # one signature holds a third of the cases
    rows = case_rows(300, 1) + [(10_000 + i, "hot", "list", "grpc", "vuetify", ["vue3"], ["en"], 90.0) for i in range(150)]
    cases = spark.createDataFrame(rows, CASES).cache()
    forms = [dict(category=c, api_type=a, design_system=d, frameworks=f, tags=t) for c, a, d, f, t in itertools.product(
        ["LIST", "edit", None], ["grpc", "mixed", ""], ["vuetify", None], [["vue3", "pinia"], []], [["en", "x", "x"]])]
    forms += [dict(category="list", api_type="rest", design_system="element-plus", frameworks=["c"], tags=None),
              dict(category="none such", api_type="none", design_system="none", frameworks=["no"], tags=["no"])]
    forms = random.Random(2).sample(forms, 6) + forms[-2:] + [forms[0]]
    requests = spark.createDataFrame([(i, *f.values(), "extra") for i, f in enumerate(forms)],
                                     "request_id long, category string, api_type string, design_system string, "
                                     "frameworks array<string>, tags array<string>, id string")
    for how in (dict(k=10, min_score=40, min_total=30), dict(k=3, min_score=0)):
        got: dict = {}
        for r in B.similar_bulk(cases, requests, **how).orderBy("request_id", "rank").collect():
            got.setdefault(r.request_id, []).append((r.id, r.match_score, r.match_reasons))
        for i, f in enumerate(forms):
            assert got.get(i, []) == single(cases, f, **how), (i, f, how)


def test_bulk_empty_and_repeated(spark):
    cases = spark.createDataFrame([(1, "p", "list", "grpc", None, ["x"], None, None)] * 2
                                  + [(1, "p", "detail", None, None, ["x"], None, 90.0)], CASES)
    asked = cases.withColumnRenamed("id", "request_id")
    got = B.similar_bulk(cases, asked).collect()
    # a case stored several times is one answer, with its best score; every request row is answered
    assert [(r.id, r["rank"]) for r in got] == [(1, 1)] * 3
    assert B.similar_bulk(cases.limit(0), asked).count() == 0
    assert B.similar_bulk(cases, asked.limit(0)).count() == 0


def test_recommend_pages_equals_one_by_one(spark):
    cases = spark.createDataFrame(case_rows(60, 5), CASES).cache()
    rng = random.Random(6)
    names = ["pages/list.vue", "api/user.ts", "composables/useX.ts", "components/Card.vue", "utils/date.ts"]
    files = spark.createDataFrame(
        [(i, r.id, f"src/{rng.choice(names)}", "\n".join(rng.choice(["paging", "en", "plain"]) for _ in range(rng.choice([3, 80]))),
          rng.choice([None, "Search"])) for i, r in enumerate(r for r in cases.collect() for _ in range(4))],
        "doc_id long, case_id long, path string, content string, purpose string").cache()
    asked = [dict(category=c, api_type="grpc", design_system=None, frameworks=["vue3"], features=f)
             for c, f in (("list", ["paging", "SEARCH", ""]), ("detail", None), ("zzz", ["en", "en", "paging"]), (None, ["none"]))]
    analyses = spark.createDataFrame([(i, *a.values()) for i, a in enumerate(asked)],
                                     "request_id long, category string, api_type string, design_system string, "
                                     "frameworks array<string>, features array<string>")
    got: dict = {}
    for r in B.recommend_pages(cases, files, analyses).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.case_id, r.path, r.file_category, r.relevance))
    for i, a in enumerate(asked):
        want = [(r.case_id, r.path, r.file_category, r.relevance) for r in M.recommend_page(cases, files, a).collect()]
        assert got.get(i, []) == want, (i, a)
