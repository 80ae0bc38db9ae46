"""Reading, searching and combining guides."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import rules as R
from corpuslens.operators import guides as G
from corpuslens.sources import tree as E
from corpuslens.sources.corpus import Tables

GUIDES = [
    ("grpc.api.connection", "project", "grpc", ["grpc", "api"], 90, "2025.11.01", [], ["rest.api"], False),
    ("rest.api", "repo", "openapi", ["rest", "api"], 80, "2025.10.01", [], ["grpc.api.connection"], False),
    ("api.validation", "org", "any", ["api", "validation"], 70, "2025.09.01", ["grpc.api.connection"], [], False),
    ("error.handling", "global", "any", ["error"], 60, "2025.11.05", [], [], False),
    ("ui.table", "global", "any", ["element-plus", "table"], 60, "2025.11.06", ["missing.guide"], [], False),
    ("core", "project", "any", ["core"], 100, "2025.01.01", [], [], True),
]


@pytest.fixture(scope="module")
def guides(spark):
    df = spark.createDataFrame(GUIDES, "id STRING, scope STRING, api_type STRING, tags ARRAY<STRING>, priority INT, version STRING, "
                                       "requires ARRAY<STRING>, excludes ARRAY<STRING>, mandatory BOOLEAN")
    return df.withColumns({"summary": F.concat(F.lit("About "), "id"), "content": F.concat(F.lit("Text of "), "id")})


def wanted(spark, *ids):
    return spark.createDataFrame([("r", i, n) for n, i in enumerate(ids)], "request_id STRING, id STRING, position INT")


def test_combine(spark, guides):
    kept = G.combine_guides(wanted(spark, "grpc.api.connection", "rest.api", "api.validation", "ui.table"), guides)
    assert [r.id for r in kept.orderBy("position").collect()] == ["core", "grpc.api.connection", "api.validation"]
    text = G.combined_text(kept, guides).first()
    assert text.combined.startswith("# About core\n\nText of core\n\n---\n\n# About grpc") and text.n_guides == 3
    assert len(G.combined_text(kept, guides, max_chars=10).first().combined) == 10


def test_whole_guides_once_for_equal_requests(spark, guides, monkeypatch):
    """Words that no guide has make no other request; repeated keys have the guides of all their rows."""
    rows = [(n, api, words + [f"nowhere{n}"]) for n, (api, words) in enumerate(
        [("grpc", ["table"]), (None, ["rest", "TABLE"]), ("openapi", []), ("grpc", ["table", "table"]), (None, ["TABLE", "rest"]),
         ("none", ["error"]), ("none", [])] * 3)] + [(100, "grpc", ["api"]), (100, "openapi", ["rest"]), (None, "grpc", ["api"])]
    requests = spark.createDataFrame(rows, "request_id INT, api_type STRING, keywords ARRAY<STRING>")
    # of equal rank, so that keywords decide
    guides = guides.withColumns({"priority": F.lit(5), "version": F.lit("2025.01.01"), "scope": F.lit("org"),
                                 "requires": F.array().cast("array<string>")})
    found = G.search_guides(requests, guides, None)
    kept = G.combine_guides(found.select("request_id", "id", F.col("rank").alias("position")), guides)
    want = {tuple(r) for r in G.combined_text(kept, guides).collect()}
    searched = []
    search = G.search_guides
    monkeypatch.setattr(G, "search_guides", lambda asked, *a: searched.append(asked.count()) or search(asked, *a))
    got = G.guides_for(requests, guides)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 23 and len({w[1] for w in want}) > 3
    assert searched == [7]
    assert {r.combined for r in G.guides_for(requests, guides, max_chars=30).collect()} == {w[1][:30] for w in want}


def test_requirement_is_met_by_a_request_that_is_later_dropped(spark, guides):
    more = guides.withColumn("requires", F.when(F.col("id") == "error.handling", F.array(F.lit("rest.api"))).otherwise(F.col("requires")))
    kept = G.combine_guides(wanted(spark, "error.handling", "rest.api", "grpc.api.connection"), more)
    assert {r.id for r in kept.collect()} == {"core", "grpc.api.connection", "error.handling"}


def brute_combine(ids, guides):
    by_id = {g.id: g for g in guides}
    names = list(dict.fromkeys(sorted(g.id for g in guides if g.mandatory) + ids))
    rows = [by_id[i] for i in names if i in by_id]
    rows.sort(key=lambda g: (-R.SCOPE_RANK[g.scope], -g.priority, -int(g.version.replace(".", ""))))
    kept = []
    for g in rows:
        if any(x in [k.id for k in kept] for x in g.excludes) or any(x not in [r.id for r in rows] for x in g.requires):
            continue
        kept.append(g)
    return [g.id for g in kept]


def test_combine_on_the_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = t.guides.collect()
    asked = {r.request_id: r.wanted for r in t.requests.select("request_id", "wanted").collect()}
    kept = G.combine_guides(t.requests.select("request_id", F.posexplode("wanted").alias("position", "id")), t.guides)
    got = {}
    for r in kept.orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append(r.id)
    want = {k: brute_combine(list(dict.fromkeys(v)), rows) for k, v in asked.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_search(spark, guides):
    rows = [("a", ["grpc", "api"], "grpc", None, None), ("b", ["table"], None, None, ["error.handling"]), ("c", ["table"], "grpc", "element-plus", None)]
    req = spark.createDataFrame(rows, "request_id STRING, keywords ARRAY<STRING>, api_type STRING, design_system STRING, mandatory ARRAY<STRING>")
    got = {}
    for r in G.search_guides(req, guides).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.id, r.score))
    # api type 30, tag 15, summary 10 and content 5 per keyword, priority / 10
    assert got["a"][:3] == [("core", 1000.0), ("grpc.api.connection", 30 + 2 * (15 + 10 + 5) + 9.0), ("api.validation", 30 + 15 + 10 + 5 + 7.0)]
    assert "rest.api" not in dict(got["a"])
    assert dict(got["b"])["error.handling"] == 1000.0 and dict(got["b"])["ui.table"] == 15 + 10 + 5 + 6.0
    assert dict(got["c"])["ui.table"] == 30 + 35 + 30 + 6.0


def test_front_matter_types(spark):
    text = "---\r\nid: \"g.one\"\r\n# note\r\nscope: org\r\napiType: any\r\ntags: [a, b , ,c]\r\npriority: 42\r\nversion: '2025.01.02'\r\n" \
           "summary: has: colon\r\nmandatory: true\r\n---\r\n\r\nBody\r\n"
    df = spark.createDataFrame([("a.md", text), ("b.md", "no front matter")], "relative_path STRING, content STRING")
    rows = E.typed_guides(E.front_matter(df)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.scope, r.tags, r.priority, r.version, r.summary, r.mandatory, r.content) == (
        "g.one", "org", ["a", "b", "c"], 42, "2025.01.02", "has: colon", True, "Body")
    kinds = spark.createDataFrame([("true",), ("[a]",), ("12",), ("'x'",), ("1a",)], "v STRING").select(E.value_type(F.col("v")))
    assert [k[0] for k in kinds.collect()] == ["boolean", "list", "integer", "quoted", "string"]


def test_read_guides_from_a_tree(spark, tmp_path):
    (tmp_path / "api").mkdir()
    (tmp_path / "api" / "one.md").write_text("---\nid: one\nscope: org\ntags: [x]\npriority: 5\nversion: 2025.01.01\nsummary: s\n---\nHello\n")
    (tmp_path / "plain.md").write_text("nothing")
    (tmp_path / "other.txt").write_text("---\nid: two\n---\nno")
    rows = E.read_guides(spark, str(tmp_path)).collect()
    assert [(r.id, r.file_path, r.content) for r in rows] == [("one", "api/one.md", "Hello")]
