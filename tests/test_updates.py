"""Change detection, upserts, migration, annotation and streams."""

from pyspark.sql import Row, functions as F

from corpuslens.functions import rules as R, scoring as S, text as X
from corpuslens.operators import annotate as N, incremental as I, migrate as H
from corpuslens.sources.store import RecordStore, fresh_path
from corpuslens.streaming import ingest as T

FILES = [(1, "p", "pages/a.vue", "one"), (2, "p", "pages/b.vue", "two"), (3, "p", "pages/c.vue", "three"), (4, "p", "pages/d.vue", "four")]


def scan(spark, files=FILES):
    return spark.createDataFrame(files, "doc_id INT, project STRING, path STRING, content STRING")


def stored(spark):
    """1 unchanged, 2 other text, 3 older scorer, 9 no longer scanned."""
    rows = [(1, "p", "pages/a.vue", "one", "2.0.0"), (2, "p", "pages/b.vue", "old", "2.0.0"), (3, "p", "pages/c.vue", "three", "1.0.0"),
            (9, "p", "pages/z.vue", "nine", "2.0.0")]
    df = spark.createDataFrame(rows, "doc_id INT, project STRING, path STRING, content STRING, v STRING")
    return I.build_cases(df, now=F.lit("t0")).withColumn("scoring_version", F.col("v")).drop("v")


def test_outcomes_in_order(spark):
    hashed = scan(spark).withColumn("content_hash", X.content_hash(F.col("content")))
    got = {r.doc_id: r.outcome for r in I.detect_changes(hashed, stored(spark)).collect()}
    assert got == {1: "up_to_date", 2: "content_changed", 3: "version_outdated", 4: "new_file"}
    assert {r.outcome for r in I.detect_changes(hashed, stored(spark), force=True).collect()} == {"force_reanalyze"}


def test_apply_changes_keeps_first_seen_and_is_idempotent(spark):
    first = I.apply_changes(scan(spark), stored(spark), F.lit("t1"))
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == {1, 2, 3, 4, 9}
    assert {i: (r.created_at, r.updated_at) for i, r in rows.items()} == {
        1: ("t0", "t0"), 2: ("t0", "t1"), 3: ("t0", "t1"), 4: ("t1", "t1"), 9: ("t0", "t0")}
    assert rows[2].content == "two" and rows[3].scoring_version == R.SCORING_VERSION
    again = I.apply_changes(scan(spark), first.drop("outcome"), F.lit("t2")).collect()
    assert {r.outcome for r in again} == {"kept"} and len(again) == 5


def test_retry_plan(spark):
    df = spark.createDataFrame([(1, 0), (2, 2), (3, 3)], "id INT, retry_count INT")
    assert [(r.action, r.attempt) for r in I.retry_plan(df).orderBy("id").collect()] == [("retry", 1), ("retry", 3), ("parked", None)]


def test_migrate_ids(spark):
    rows = [("p--a-vue-1700000000000", "2024-01-01"), ("p--a-vue-1710000000000", "2024-02-01"), ("p--b-ts", "2024-01-01"),
            ("p--c-ts-1400000000000", "2024-01-01"), ("p--b-ts-1700000000000", "2024-03-01"), ("p--d-1700000000000", "2023-01-01"), ("p--d", "2024-01-01")]
    got = {r.old_id: r for r in H.migrate_ids(spark.createDataFrame(rows, "old_id STRING, analyzed_at STRING")).collect()}
    assert {k: (r.new_id, r.status, r.writes) for k, r in got.items()} == {
        "p--a-vue-1700000000000": ("p--a-vue", "conflict", False), "p--a-vue-1710000000000": ("p--a-vue", "migrated", True),
        "p--b-ts": ("p--b-ts", "skipped", False), "p--c-ts-1400000000000": ("p--c-ts-1400000000000", "skipped", False),
        "p--b-ts-1700000000000": ("p--b-ts", "migrated", True), "p--d-1700000000000": ("p--d", "migrated", False), "p--d": ("p--d", "skipped", False)}


RECORD = """id STRING, project_name STRING, category STRING, files ARRAY<STRING>,
    patterns STRUCT<score: DOUBLE, metadata: STRUCT<api_type: STRING, frameworks: ARRAY<STRING>, patterns: ARRAY<STRING>,
        components_used: ARRAY<STRING>, average_complexity: STRING>, api_info: STRUCT<has_grpc: BOOLEAN, has_openapi: BOOLEAN, api_type: STRING>,
        framework: STRING, composable_usage: MAP<STRING, BIGINT>, component_usage: MAP<STRING, BIGINT>>,
    scores STRUCT<structure: DOUBLE, apiConnection: DOUBLE, designSystem: DOUBLE, utilityUsage: DOUBLE, errorHandling: DOUBLE,
        typeUsage: DOUBLE, stateManagement: DOUBLE, performance: DOUBLE>,
    total_score BIGINT, excellent_in ARRAY<STRING>, scoring_version STRING,
    metadata STRUCT<created_at: TIMESTAMP_NTZ, updated_at: TIMESTAMP_NTZ, tags: ARRAY<STRING>>"""


def record(id, **fields):
    names = ["project_name", "category", "files", "patterns", "scores", "total_score", "excellent_in", "scoring_version", "metadata"]
    base = dict(project_name="p", category="c", files=["f"], patterns=(None, None, None, None, None, None), metadata=(None, None, ["old"]))
    return (id, *[(base | fields).get(n) for n in names])


def records(spark):
    legacy = (50.0, None, (True, False, "none"), "pinia", {"useA": 2, "useB": 0}, {"Box": 1, "Pod": 0})
    scored = dict(scores=(90.0,) * 8, total_score=90, excellent_in=["structure"])
    return spark.createDataFrame([
        record("v1", patterns=legacy), record("v15", patterns=(None, ("grpc", [], [], [], "low"), None, None, None, None)),
        record("v2", **scored, scoring_version="2.0.0"), record("old", **scored, scoring_version="1.0.0"),
        record("bare"), record("nameless", category="", **scored, scoring_version="2.0.0")], RECORD)


def test_shape_version(spark):
    got = {r.id: (r.version, r.missing_fields, r.outdated, r.needs_migration) for r in H.shape_version(records(spark)).collect()}
    assert got == {"v1": ("1.0", [], False, True), "v15": ("1.5", [], False, True), "v2": ("2.0", [], False, False),
                   "old": ("2.0", [], True, True), "bare": ("unknown", [], False, True), "nameless": ("2.0", ["category"], False, True)}


def test_migrate(spark):
    got = {r.id: r for r in H.migrate(records(spark), F.lit("2025-01-01").cast("timestamp_ntz")).collect()}
    assert {k: (r.status, r.rescored) for k, r in got.items()} == {
        "v1": ("migrated", True), "v15": ("migrated", True), "v2": ("skipped", False), "old": ("migrated", True),
        "bare": ("migrated", True), "nameless": ("migrated", False)}
    one = got["v1"]
    assert (one.m_api, one.m_frameworks, one.m_patterns, one.m_components) == ("grpc", ["pinia"], ["useA"], ["Box"])
    # base 20 + any api 25 + grpc 10; base 30 + pinia 30; base 30 + one component 5
    assert (one.scores.apiConnection, one.scores.stateManagement, one.scores.designSystem) == (55, 60, 35)
    assert {"old", "multi-score", "v2.0", f"score-{one.total_score // 10 * 10}"} <= set(one.tags)
    assert got["old"].scoring_version == R.SCORING_VERSION and got["v2"].tags == ["old"]
    assert "excellent-structure" in got["nameless"].tags


def test_validate(spark):
    df = records(spark).withColumn("metadata", F.struct(F.lit("2025-01-01").cast("timestamp_ntz").alias("created_at")))
    fresh = {r.id: r.reason for r in H.validate(df, F.lit("2025-01-31").cast("date")).collect()}
    assert fresh["v2"] is None and fresh["nameless"] == "missing fields" and fresh["v1"] == "no scores"
    stale = {r.id: r.valid for r in H.validate(df, F.lit("2025-02-01").cast("date")).collect()}
    assert stale["v2"] is False


def test_one_bad_file_costs_only_itself(spark):
    def model(paths, texts):
        if "three" in texts:
            raise ValueError("cannot read")
        return N.rule_annotator(paths, texts)

    rows = {r.doc_id: r for r in N.annotate(scan(spark).coalesce(1), model, batch_size=2).collect()}
    assert {i: r.error for i, r in rows.items()} == {1: None, 2: None, 3: "ValueError: cannot read", 4: None}
    assert (rows[3].complexity, rows[3].category, rows[3].lines_of_code, rows[1].lines_of_code) == ("low", "page", 1, 1)
    assert rows[1].category == "page"


def test_prefilter(spark):
    files = [(1, "p", "a.ts", "client.x()\n" * 20), (2, "p", "b.ts", "text")]
    df = scan(spark, files)
    assert [r.doc_id for r in N.worth_annotating(df, N.quick_classify(df)).collect()] == [1]


# --- streams

def drop_in(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def test_ingest_twice(spark, tmp_path):
    store, source, checkpoint = fresh_path(spark, "store"), str(tmp_path / "in"), str(tmp_path / "cp")
    T.write_batch(stored(spark).select("doc_id", "content_hash", "scoring_version", "created_at", F.lit("kept").alias("outcome")), store, 0)

    def run():
        stream = spark.readStream.schema(scan(spark).schema).parquet(f"{source}/*")
        T.start(stream, checkpoint, T.ingest_batch(store)).awaitTermination()
        return {r.doc_id: r for r in T.current(spark, store, "doc_id").collect()}

    drop_in(scan(spark), source, "one")
    first = run()
    assert {i: r.outcome for i, r in first.items()} == {1: "kept", 2: "content_changed", 3: "version_outdated", 4: "new_file", 9: "kept"}
    assert first[2].created_at == "t0"
    drop_in(scan(spark, [(4, "p", "pages/d.vue", "four"), (5, "p", "pages/e.vue", "five"), (1, "p", "pages/a.vue", "ONE")]), source, "two")
    second = run()
    assert {i: r.outcome for i, r in second.items()}[5] == "new_file" and second[1].outcome == "content_changed"
    assert second[4].batch == first[4].batch  # unchanged: not written again


def test_retried_batch_replaces_itself(spark):
    log = fresh_path(spark, "log")
    each = T.latest_batch(log, "k", "t")
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k STRING, t INT")
    each(rows, 0)
    each(rows, 0)
    assert sorted((r.k, r.t) for r in T.read_log(spark, log).collect()) == [("a", 3), ("b", 2)]


def test_windows_over_several_files(spark, tmp_path):
    log, source = fresh_path(spark, "windows"), str(tmp_path / "in")
    rows = [("2024-01-01 10:00:00", "ok"), ("2024-01-01 23:59:59", "ok"), ("2024-01-02 00:00:00", "error")]
    for i, r in enumerate(rows):
        drop_in(spark.createDataFrame([Row(at=r[0], outcome=r[1])]).select(F.to_timestamp("at").alias("at"), "outcome"), source, f"f{i}")
    stream = spark.readStream.schema("at TIMESTAMP, outcome STRING").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    T.run_available(T.outcome_windows(stream, "at", "outcome"), "w", lambda df, i: T.write_batch(df, log, i), mode="update")
    counts = T.read_log(spark, log).groupBy("window_start", "outcome").agg(F.max_by("n", "batch").alias("n"))
    assert sorted((T_day, r.outcome, r.n) for r in counts.collect() for T_day in [r.window_start.day]) == [(1, "ok", 2), (2, "error", 1)]


def test_sliding_windows_overlap(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "ok")], "at STRING, outcome STRING").withColumn("at", F.to_timestamp("at"))
    assert T.outcome_windows(df, "at", "outcome", "2 days", "1 day").count() == 2


def test_two_scheduled_runs_lose_nothing(spark, tmp_path):
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    T.write_batch(stored(spark).select("doc_id", "content_hash", "scoring_version", "created_at",
                                       F.lit("kept").alias("outcome")).limit(0), store, 0)

    def run(each_store):
        stream = spark.readStream.schema(scan(spark).schema).parquet(f"{source}/*")
        T.run_available(stream, each_store, T.ingest_batch(store))
        return {r.doc_id for r in T.current(spark, store, "doc_id").collect()}

    drop_in(scan(spark, [(1, "p", "a.ts", "one"), (2, "p", "b.ts", "two")]), source, "one")
    assert run(store) == {1, 2}
    drop_in(scan(spark, [(3, "p", "c.ts", "three")]), source, "two")
    assert run(store) == {1, 2, 3}
    drop_in(scan(spark, [(4, "p", "d.ts", "four")]), source, "three")
    assert run(str(tmp_path / "other-checkpoint")) == {1, 2, 3, 4}      # a new checkpoint numbers on


def test_record_store(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "records"), "k")
    assert store.version() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "k STRING, v INT")
    store.save(rows(("a", 1), ("a", 2), ("b", 5)), "v")
    store.save(rows(("b", 7), ("c", 1)), "v")
    assert sorted(map(tuple, store.load().collect())) == [("a", 2), ("b", 7), ("c", 1)]
    assert store.get("b").first().v == 7
    # a write that fails before its manifest is complete leaves the old version
    rows(("x", 9)).write.parquet(f"{store.path}/data/3/_bucket=0")
    (tmp_path / "records" / "manifests" / "3").mkdir()
    assert store.version() == 2 and store.get("x").count() == 0
    store.delete(rows(("a", 0), ("nobody", 0)).select("k"))
    assert sorted(r.k for r in RecordStore(spark, store.path, "k").load().collect()) == ["b", "c"]
    # keys of another type, none at all, and a store that becomes empty
    store.save(spark.createDataFrame([(None, 3), ("d", 4)], "k STRING, v LONG"), "v")
    assert sorted(map(tuple, store.load().collect())) == [("b", 7), ("c", 1), ("d", 4)]
    left = store.delete(store.load().select("k"))
    assert left.count() == 0 and dict(left.dtypes) == {"k": "string", "v": "int"}
    assert store.get("b").count() == 0 and store.save(rows(("e", 1)), "v").count() == 1


def test_a_save_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "records"), "k", buckets=64, grace=2)
    store.save(spark.range(2000).select(F.col("id").alias("k"), F.lit(0).alias("v")), "v")
    first = {r.bucket: r for r in store.manifest().collect()}
    assert len(first) == 64 and sum(r.rows for r in first.values()) == 2000
    batch = spark.createDataFrame([(5, 1), (900, 1), (5000, 1)], "k INT, v INT")
    store.save(batch, "v")
    second = {r.bucket: r for r in store.manifest().collect()}
    rewritten = [b for b, r in second.items() if r.written == 2]
    assert 0 < len(rewritten) <= 3 and {b for b in second if second[b] == first[b]} == set(second) - set(rewritten)
    assert sorted(p.name for p in (tmp_path / "records" / "data" / "2").glob("_bucket=*")) == sorted(
        f"_bucket={b}" for b in rewritten)
    assert store.load().agg(F.sum("v"), F.count("*")).first()[:] == (3, 2001)
    assert store.load(1).agg(F.sum("v"), F.count("*")).first()[:] == (0, 2000)      # an old version stays readable
    assert len(store.get(900).inputFiles()) == 1 and store.get(900).first().v == 1
    for v in (2, 3, 4):
        store.save(batch.withColumn("v", F.lit(v)), "v")
    assert store.versions() == [4, 5]                                               # beyond the grace, files go
    assert sorted(int(p.name) for p in (tmp_path / "records" / "data").iterdir()) == [1, 4, 5]
    assert store.load().agg(F.sum("v"), F.count("*")).first()[:] == (12, 2001)
    store.replace(spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    store.delete(spark.createDataFrame([(3,)], "k LONG"))
    assert sorted(int(p.name) for p in (tmp_path / "records" / "data").iterdir()) == [6, 7]


def test_latest_state_over_runs_late_and_repeated_rows(spark, tmp_path):
    source, store = str(tmp_path / "events"), str(tmp_path / "state")
    schema = "k LONG, at LONG, v STRING"

    def run(*rows, checkpoint=store):
        if rows:
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        T.run_available(spark.readStream.schema(schema).parquet(source), checkpoint,
                        T.latest_state(store, "k", "at", "v", buckets=4))
        return {r.k: (r.at, r.v) for r in RecordStore(spark, store, "k").load().collect()}

    assert run((1, 5, "a"), (1, 7, "b"), (2, 1, "x"), (None, 1, "no key")) == {1: (7, "b"), 2: (1, "x")}
    assert run((1, 6, "late"), (3, 1, "new"), (2, 1, "x")) == {1: (7, "b"), 2: (1, "x"), 3: (1, "new")}
    want = {1: (7, "b"), 2: (9, "y"), 3: (1, "new")}
    assert run((2, 9, "y")) == want
    assert run(checkpoint=str(tmp_path / "again")) == want          # all rows once more
    for at in range(10, 14):
        run((1, at, "v"))
    state = RecordStore(spark, store, "k")
    assert len(state.load().inputFiles()) <= 4 and state.manifest().agg(F.sum("rows")).first()[0] == 3
    version = state.version()
    T.latest_state(store, "k", "at", "v")(spark.createDataFrame([], schema), 99)    # an empty batch writes nothing
    assert state.version() == version


def test_migrated_project_scores_as_a_project_of_its_metadata(spark):
    meta = dict(total_files=10, files_by_category={"page": 4, "component": 3, "api": 3}, api_type="grpc",
                api_methods=["getUser", "listUsers"], frameworks=["vue3", "pinia"], patterns=["api-client", "error-recovery"],
                dependencies=["element-plus", "lodash"], design_system="element-plus", utility_library="vueuse",
                components_used=["ElTable", "ElForm"], composables_used=["useUser"],
                excellent_files=[("a.vue", ["clean structure"])], average_complexity="medium",
                files_with_good_error_handling=4, files_with_good_types=7)
    fields = ", ".join(f"{k}: {v}" for k, v in S.METADATA_FIELDS.items())
    schema = ("id STRING, project_name STRING, category STRING, files ARRAY<STRING>, patterns STRUCT<score: DOUBLE, "
              f"metadata: STRUCT<{fields}>, api_info: STRUCT<has_grpc: BOOLEAN, has_openapi: BOOLEAN, api_type: STRING>, "
              "framework: STRING, composable_usage: MAP<STRING, BIGINT>, component_usage: MAP<STRING, BIGINT>>, scores STRUCT<"
              + ", ".join(f"{d}: DOUBLE" for d in R.DIMENSIONS) + ">, total_score BIGINT, excellent_in ARRAY<STRING>, "
              "scoring_version STRING, metadata STRUCT<created_at: TIMESTAMP_NTZ, updated_at: TIMESTAMP_NTZ, tags: ARRAY<STRING>>")
    record = ("v15", "p", "c", ["a.vue"], (None, tuple(meta[k] for k in S.METADATA_FIELDS), None, None, None, None),
              None, None, None, None, None)
    got = H.migrate(spark.createDataFrame([record], schema), F.lit("2025-01-01").cast("timestamp_ntz")).first()
    want = spark.createDataFrame([tuple(meta[k] for k in S.METADATA_FIELDS)],
                                 ", ".join(f"{k} {v}" for k, v in S.METADATA_FIELDS.items())).select(*S.metadata_scores()).first()
    assert got.scores.asDict() == want.asDict()
