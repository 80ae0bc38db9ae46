"""Substring conditions from the term index against scans of the lists."""

import random

from corpuslens.operators import facets as A, terms as T

SCHEMA = ("id long, project string, file_role string, keywords array<string>, entities array<string>, "
          "components_used array<string>, api_methods array<string>, structure double")
FIELDS = {"keywords": "keywords", "entities": "entities", "components": "components_used", "methods": "api_methods"}


def record_rows(n=300):
    rng = random.Random(8)
    words = ["Search", "research", "form", "reform", "listUser", "getUser", "UserDto", "x", "ab", "", "Überschrift", "日本語", None]

    def some():
        return rng.choice([None, [], rng.choices(words, k=3), rng.choices(words, k=1), ["listUser"]])
    return [(i, f"p{i % 3}", rng.choice(["page", "api"]), some(), some(), some(), some(), float(i % 100)) for i in range(n)]


def test_index_equals_scan(spark):
    records = spark.createDataFrame(record_rows(), SCHEMA).cache()
    index = T.build_index(records, FIELDS)
    for how in (dict(keywords=["sea"]), dict(keywords=["X", "ab"], role="page"), dict(keywords=["a"]), dict(keywords=[""]),
                dict(keywords_all=["form", "SEAR"], min_scores={"structure": 20}), dict(entities=["user", "übers"], methods=["list"]),
                dict(components=["日本"]), dict(keywords=["searching"]), dict(keywords_all=["zz"], entities=["user"]),
                dict(project="p1"), dict(entities=["getuser"], keywords_all=["re", "ref"])):
        want = sorted(r.id for r in A.search_files(records, **how).select("id").collect())
        got = sorted(r.id for r in T.search_files(records, index, **how).select("id").collect())
        assert got == want, how


def test_many_requests_at_once(spark):
    rows = record_rows(120)
    index = T.build_index(spark.createDataFrame(rows, SCHEMA), FIELDS)
    asked = [("a", 0, "keywords", "form"), ("a", 0, "entities", "form"), ("a", 1, "methods", "user"),
             ("b", 0, "keywords", "zzz"), ("b", 0, "keywords", None), ("c", 0, "keywords", ""), ("c", 0, "keywords", "")]
    conditions = spark.createDataFrame(asked, "request string, part int, field string, needle string")
    got = sorted((r.request, r.id) for r in T.matching(conditions, index).collect())

    def holds(values, needle):
        return any(needle in v.lower() for v in values or [] if v is not None)
    want = sorted([("a", r[0]) for r in rows if (holds(r[3], "form") or holds(r[4], "form")) and holds(r[6], "user")]
                  + [("c", r[0]) for r in rows if holds(r[3], "")])
    assert got == want
    assert T.matching(conditions.limit(0), index).count() == 0
    empty = T.build_index(spark.createDataFrame([], SCHEMA), FIELDS)
    assert T.matching(conditions, empty).count() == 0
