"""Scores against values worked out by hand."""

import pytest
from pyspark.sql import Row, functions as F

from corpuslens.functions import rules as R, scoring as S

PROJECT = dict(
    total_files=50, files_by_category={"page": 10, "composable": 15, "api": 8, "utility": 12, "other": 5}, api_type="grpc",
    api_methods=["GetUser", "ListUsers", "CreateUser", "UpdateUser", "DeleteUser"], frameworks=["vue3", "pinia", "vite"],
    patterns=["composable", "api-client", "error-handling", "type-safe"],
    dependencies=["@grpc/grpc-js", "ui-kit", "lodash", "date-fns", "pinia"], design_system="ui-kit", utility_library="lodash",
    components_used=["CommonButton", "CommonInput", "CommonTable", "CommonSelect", "CommonDialog"],
    composables_used=["useUser", "useAuth", "useState", "useRouter", "useApi"],
    excellent_files=[Row(path="index.vue", reasons=["Well structured components", "Clean separation of concerns"]),
                     Row(path="useUser.ts", reasons=["Excellent API error handling", "Type-safe gRPC client"]),
                     Row(path="date.ts", reasons=["Reusable utility functions", "Good documentation"])],
    average_complexity="low", files_with_good_error_handling=35, files_with_good_types=42)

FILE = dict(
    category="page", patterns=["composition-api", "async-data", "error-handling"], frameworks=["vue3"], design_system="ui-kit",
    utility_library="lodash", api_type="grpc", api_methods=["GetUser", "UpdateUser"], complexity="low", reusability="medium",
    error_handling="comprehensive", type_definitions="excellent", dependencies=["@grpc/grpc-js", "ui-kit", "lodash"],
    composables_used=["useUser", "useAuth"], is_excellent=True, lines_of_code=150)


def scored(spark, row, columns):
    df = spark.createDataFrame([Row(**row)]).select("*", *columns)
    return df.withColumns({"total": S.weighted_total(), "best": S.excellent_in()}).withColumn(
        "decision", S.save_decision(F.col("total"), F.col("best"))).first()


def test_project(spark):
    r = scored(spark, PROJECT, S.metadata_scores())
    assert [r[d] for d in R.DIMENSIONS] == [87, 71.5, 75, 85, 61, 69, 78, 60]
    assert (r.total, r.best, r.decision.rule_no) == (73, ["structure", "utilityUsage"], 1)


def test_project_with_nothing(spark):
    empty = {k: None for k in PROJECT} | {"total_files": 0, "files_by_category": {}, "excellent_files": [], "average_complexity": "medium",
                                          "files_with_good_error_handling": 0, "files_with_good_types": 0}
    schema = spark.createDataFrame([Row(**PROJECT)]).schema
    r = spark.createDataFrame([empty], schema).select(*S.metadata_scores()).first()
    assert [r[d] for d in R.DIMENSIONS] == [30 + 5 + 15, 20, 30, 20, 25, 35, 30, 55]


def test_file(spark):
    r = scored(spark, FILE, S.file_scores())
    assert [r[d] for d in R.DIMENSIONS] == [89, 83, 85, 80, 85, 80, 43, 80]
    assert r.total == 79
    assert r.best == [d for d in R.DIMENSIONS if d != "stateManagement"]


def test_single_score_and_tier(spark):
    r = spark.createDataFrame([Row(**FILE)]).select(S.single_score().alias("s")).select("s", S.tier(F.col("s")).alias("t")).first()
    assert (r.s, r.t) == (87, "A")


@pytest.mark.parametrize("value,expected", [(-2.5, -2), (2.5, 3), (2.49, 2), (-2.51, -3)])
def test_half_up(spark, value, expected):
    assert spark.range(1).select(S.half_up(F.lit(value)).alias("x")).first().x == expected


def test_save_rules_in_order(spark):
    rows = [[70] * 8, [80] + [10] * 7, [50] * 8, [10] * 8]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], R.DIMENSIONS)
    df = df.withColumns({"t": S.weighted_total(), "e": S.excellent_in()})
    got = [r.d.rule_no for r in df.select(S.save_decision(F.col("t"), F.col("e")).alias("d")).collect()]
    assert got == [1, 2, 4, 0]


def test_grades_and_bounds(spark):
    df = spark.createDataFrame([(85,), (84,), (70,), (50,), (49,), (None,)], "t INT")
    assert [r[0] for r in df.select(S.grade(F.col("t"))).collect()] == ["excellent", "good", "good", "fair", "poor", "poor"]
    assert sum(R.WEIGHTS.values()) == 100 and list(R.WEIGHTS) == R.DIMENSIONS


def test_text_scores_stay_in_range(spark):
    text = "export default <script setup defineProps interface X type Y = : string try catch pinia computed lazy memo"
    row = dict(content=text, text=text, low=text.lower(), lines=100, keywords=["grpc", "rest", "async", "error-handling", "state-management"],
               api_methods=[f"m{i}" for i in range(20)], components_used=[f"C{i}" for i in range(30)], composables_used=["useA"])
    r = spark.createDataFrame([Row(**row)]).select(*S.text_scores()).first()
    assert all(0 <= r[d] <= 100 for d in R.DIMENSIONS)
    assert (r.apiConnection, r.designSystem) == (100, 100)
