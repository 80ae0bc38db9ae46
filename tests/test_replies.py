"""Annotators' replies: whole records, recovery by field, and cases built and stored from them."""

import json

from pyspark.sql import functions as F

from corpuslens.functions import rules as R
from corpuslens.operators import replies as P
from corpuslens.sources.store import RecordStore

SCHEMA = "doc_id LONG, project STRING, path STRING, content STRING"
WHOLE = {"patterns": ["queue", "", None], "frameworks": ["vue"], "designSystem": "vuetify", "utilityLibrary": "lodash",
         "apiType": "GRPC", "apiMethods": ["getUser"], "complexity": "high", "reusability": "high",
         "errorHandling": "comprehensive", "typeDefinitions": "excellent", "dependencies": ["axios"],
         "composablesUsed": ["useA"], "componentsUsed": ["ElTable"], "entities": ["User"], "features": ["a \"quoted\" ] one"],
         "hasDocumentation": True, "hasLoadingStates": True, "hasErrorStates": False, "isExcellent": True,
         "excellentReasons": ["clear"], "excellentPatterns": ["slots"],
         "vModelBindings": [{"name": "form", "component": "ElInput", "hasWatch": True}]}


def read(spark, replies, path="pages/a.vue", content="<template>\n<b/></template>\n<script>x</script>"):
    rows = [(i, r, path, content) for i, r in enumerate(replies)]
    df = spark.createDataFrame(rows, "i INT, reply STRING, path STRING, content STRING").withColumn(
        "reply_error", F.lit(None).cast("string"))
    return [r.record for r in P.read_replies(df).orderBy("i").collect()]


def test_whole_reply(spark):
    plain, fenced, snake = read(spark, [
        json.dumps(WHOLE), f"Sure:\n```json\n{json.dumps(WHOLE, indent=2)}\n``` done",
        json.dumps({"design_system": "vuetify", "has_documentation": True})])
    assert plain == fenced and plain.errors == []
    want = {"category": "component", "complexity": "high", "reusability": "high", "error_handling": "comprehensive",
            "type_definitions": "excellent", "api_type": "grpc", "patterns": ["queue"], "frameworks": ["vue"],
            "api_methods": ["getUser"], "dependencies": ["axios"], "composables_used": ["useA"], "components_used": ["ElTable"],
            "entities": ["User"], "features": ['a "quoted" ] one'], "excellent_reasons": ["clear"],
            "excellent_patterns": ["slots"], "has_documentation": True, "has_loading_states": True,
            "has_error_states": False, "is_excellent": True, "design_system": "vuetify", "utility_library": "lodash",
            "lines_of_code": 3, "template_lines": 2, "script_lines": 1, "errors": []}
    got = plain.asDict(recursive=True)
    assert got.pop("v_model_bindings") == [{"name": "form", "component": "ElInput", "has_watch": True,
                                            "has_validation": False, "has_type_definition": False}]
    assert got == want
    assert (snake.design_system, snake.has_documentation, snake.complexity, snake.errors) == ("vuetify", True, "medium", [])


def test_cut_mistyped_and_missing_replies(spark):
    whole = json.dumps(WHOLE)
    cut, typed, prose, null, empty, array = read(spark, [
        whole[:whole.index('"hasLoadingStates"')],
        json.dumps({"patterns": "lone", "entities": 5, "features": None, "complexity": ["high"], "isExcellent": "perhaps",
                    "apiType": "soap", "vModelBindings": "none", "designSystem": "", "reusability": " High "}),
        "I cannot tell.", None, "{}", "[1, 2]"], path="src/utils/a.ts", content="import x from 'element-plus'\n")
    assert cut.errors == ["reply: cut or malformed"]
    assert (cut.features, cut.complexity, cut.api_methods, cut.has_documentation) == (['a "quoted" ] one'], "high", ["getUser"], True)
    assert (cut.is_excellent, cut.excellent_reasons, cut.v_model_bindings, cut.category) == (False, [], [], "utility")
    assert typed.errors == ["complexity: not a level", "api_type: not a level", "patterns: not a list", "entities: not a list",
                            "is_excellent: not a flag", "v_model_bindings: not a list"]
    assert (typed.patterns, typed.features, typed.complexity, typed.reusability, typed.api_type) == (["lone"], [], "medium", "high", None)
    assert (typed.design_system, typed.utility_library, typed.template_lines, typed.lines_of_code) == (
        "element-plus", "element-plus", None, 2)
    for record, fault in ((prose, "reply: no object"), (null, "reply: none"), (array, "reply: no object")):
        assert record.errors == [fault]
        assert (record.complexity, record.reusability, record.error_handling, record.type_definitions) == ("low", "low", "none", "poor")
        assert record.design_system == "element-plus" and record.patterns == []
    assert empty.complexity == "low" and empty.errors == []


def test_one_failing_file_costs_only_itself(spark):
    def model(paths, texts):
        assert max(map(len, texts)) <= 9
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return [json.dumps({"complexity": "high"})] * len(paths)

    rows = [(i, "p", f"api/{i}.ts", "bad" if i == 3 else "x" * 20) for i in range(6)] + [(6, "p", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("reply", F.lit("mine")).coalesce(1)
    got = {r.doc_id: r for r in P.annotate_records(df.drop("reply"), model, batch_size=4, max_chars=9).collect()}
    assert {i: r.record.complexity for i, r in got.items()} == {i: "low" if i == 3 else "high" for i in range(7)}
    assert got[3].record.errors == ["reply: RuntimeError: down"] and got[3].content == "bad"
    short = P.annotate_records(df.drop("reply").limit(1), lambda p, t: []).first().record
    assert short.errors == ["reply: ValueError: 0 replies for 1 files"]


def test_cases_go_from_annotation_to_the_store(spark, tmp_path):
    rows = [(1, "p", "pages/a.vue", "export const getThing = 1"), (2, "p", "pages/b.vue", "plain")]
    files = spark.createDataFrame(rows, SCHEMA)

    def model(paths, texts):
        return [json.dumps(WHOLE) if "export" in t else "{" for t in texts]

    def encode(texts):
        if any("queue" not in t for t in texts):
            raise ValueError("no vector")
        return [[1.0, 2.0]] * len(texts)

    cases = P.annotated_cases(files, model, encode, now=F.lit("t"))
    store = RecordStore(spark, str(tmp_path / "cases"), "doc_id", buckets=4)
    store.save(cases, "analyzed_at")
    one, two = store.get(1).first(), store.get(2).first()
    assert list(one.embedding) == [1.0, 2.0] and two.embedding is None
    assert {"excellent", "grpc"} <= set(one.keywords) and "queue" in one.summary and one.patterns == ["queue"]
    assert (one.apiConnection, one.structure, one.errorHandling) == (100.0, 80.0, 100.0)
    assert two.record.errors == ["reply: no object"] and two.structure == 40.0 and two.total_score < one.total_score
    plain = {r.doc_id: r for r in P.annotated_cases(files).collect()}
    assert plain[1].patterns == [] and all(plain[2][d] is not None for d in R.DIMENSIONS)


def test_no_files(spark):
    none = P.annotated_cases(spark.createDataFrame([], SCHEMA), lambda p, t: ["{}"] * len(p))
    assert none.count() == 0 and {"record", "embedding", "total_score", "grade"} <= set(none.columns)
