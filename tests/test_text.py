"""Extraction from paths and code."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.operators import lines as L

SNIPPETS = {
    "pages/users/index.vue": "<template><ElTable/><UserCard /></template>\n<script setup>const p = usePaging(1)\n// TODO: search form\n</script>",
    "composables/useUser.ts": "interface UserDto {}\ntype Page = number\nclient.getUser(1)\nuseBackendClient().listUsers()",
    "utils/http.js": "axios.get('/a'); axios.delete('/b')",
    "README": "",
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(SNIPPETS.items()), "path STRING, text STRING").withColumn("low", F.lower("text"))
    t, p = F.col("text"), F.col("path")
    rows = df.select("path", X.line_count(t).alias("lines"), X.components_used(t).alias("components"), X.composables_used(t).alias("composables"),
                     X.code_entities(t).alias("entities"), X.api_methods(t).alias("methods"), X.todo_hints(t).alias("hints"),
                     X.tag(F.col("low")).alias("tags"), X.file_type(p).alias("type"), X.file_role(p).alias("role"),
                     X.file_role(p, strict=True).alias("strict"), X.path_entities(p).alias("names")).collect()
    return {r.path: r for r in rows}


def test_page(found):
    r = found["pages/users/index.vue"]
    assert (r.lines, r.components, r.composables, r.hints) == (4, ["ElTable", "UserCard"], ["usePaging"], ["search", "form"])
    assert (r.type, r.role, r.strict, r.names) == ("vue", "page", "other", ["Users"])


def test_composable(found):
    r = found["composables/useUser.ts"]
    assert (r.entities, r.methods, r.composables) == (["UserDto", "Page", "User"], ["grpc.getUser", "grpc.listUsers"], ["useBackendClient"])
    assert (r.type, r.role) == ("ts", "composable")


def test_rest(found):
    r = found["utils/http.js"]
    assert r.methods == ["rest.get", "rest.delete"] and {"rest", "delete"} <= set(r.tags)


def test_empty_file(found):
    r = found["README"]
    assert (r.lines, r.type, r.tags, r.components) == (1, "unknown", [], [])


@pytest.mark.parametrize("path,category", [
    ("src/pages/a.ts", "page"), ("x/a.page.ts", "page"), ("src/components/common/A.vue", "shared-component"), ("a/B.vue", "component"),
    ("src/composables/x.ts", "composable"), ("lib/useX.ts", "composable"), ("src/server/a.ts", "api"), ("a/b.d.ts", "type"),
    ("src/store/a.ts", "store"), ("src/helpers/a.ts", "utility"), ("src/services/a.ts", "service"), ("a/b.ts", "other")])
def test_category(spark, path, category):
    assert spark.range(1).select(X.file_category(F.lit(path)).alias("c")).first().c == category


@pytest.mark.parametrize("name,prefix", [("CommonTable", "Common"), ("ElButton", "El"), ("VBtn", "V"), ("Table", None)])
def test_name_prefix(spark, name, prefix):
    assert spark.range(1).select(X.name_prefix(F.lit(name)).alias("c")).first().c == prefix


@pytest.mark.parametrize("old,new", [("p--a-vue-1700000000000", "p--a-vue"), ("p--b-ts", None), ("p--c-ts-1400000000000", None),
                                     ("p--d-12345", None)])
def test_strip_timestamp(spark, old, new):
    assert spark.range(1).select(X.strip_timestamp(F.lit(old)).alias("c")).first().c == new


def test_library_ties_go_to_the_first(spark):
    pats = [("a", ["x"]), ("b", ["y"]), ("c", ["y", "z"])]
    df = spark.createDataFrame([("xy",), ("yz",), ("q",)], "t STRING")
    assert [r[0] for r in df.select(X.detect_library(F.col("t"), pats)).collect()] == ["a", "c", None]


def test_markdown_links(spark):
    text = "see [a](./docs/a.md#top) and [b](https://x.org)\n[c](#here) [d](b.md)"
    df = spark.createDataFrame([(1, text)], "id INT, text STRING")
    links = L.extract_links(df, "id")
    assert [(r.line, r.target) for r in links.orderBy("line", "nth").collect()] == [(1, "./docs/a.md"), (2, "b.md")]
    listing = spark.createDataFrame([("docs/a.md",)], "path STRING")
    assert [r.target for r in L.broken_links(links, listing).collect()] == ["b.md"]


def test_glob_takes_other_characters_literally(spark):
    df = spark.createDataFrame([("a/x.ts",), ("a/xtts",), ("y.ts",)], "path STRING")
    assert sorted(r.name for r in L.glob_files(df, "*.ts").collect()) == ["x.ts", "y.ts"]
    assert [r.name for r in L.glob_files(df, "?.ts", recursive=False).collect()] == ["y.ts"]


def test_grep_caps_are_per_file(spark):
    text = "\n".join(["const usePaging = 1"] * 12 + ["usePaging(1)"] * 7 + ["// usePaging(2)"])
    r = L.grep_lines(spark.createDataFrame([(text,), ("none",)], "text STRING"), "usePaging", "const usePaging", r"usePaging\(",
                     k_definitions=10, k_usages=5, preview=30).collect()
    assert len(r) == 1 and (len(r[0].definitions), len(r[0].usages)) == (10, 5) and r[0].preview.count("\n") == 19
    whole = L.grep_lines(spark.createDataFrame([(text,)], "text STRING"), "usePaging", "const usePaging", r"usePaging\(").first()
    assert (len(whole.definitions), len(whole.usages)) == (12, 7)  # without limits nothing is cut


def test_rules_are_unique():
    assert len({t for t, _ in R.KEYWORD_RULES + R.KEYWORD_RULES_ALL}) == 24
