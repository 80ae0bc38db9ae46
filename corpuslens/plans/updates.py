"""Queries: incremental, stateful and streaming work; migration; annotation."""

import json

from pyspark.sql import functions as F

from corpuslens.functions import rules as R, text as X
from corpuslens.operators import annotate as N, incremental as I, migrate as H, open_records as O, replies as P, rollup as U, vectors as V
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.features import EMBEDDING_TEXT, FILES, META, STRIP, _detect_sql, joined
from corpuslens.plans.registry import query
from corpuslens.plans.scores import ANNOTATION_SQL, ROLLUP, RULE, project_rows
from corpuslens.sources.store import RecordStore, fresh_path, spread, written_once
from corpuslens.streaming import ingest as T

_HASH = "substr(sha256({}.content), 1, 16)"
_OUTCOME = f"""CASE WHEN s.doc_id IS NULL THEN 'new_file' WHEN s.scoring_version <> '{R.SCORING_VERSION}' THEN 'version_outdated'
    WHEN {_HASH.format('s')} <> {_HASH.format('f')} THEN 'content_changed' ELSE 'up_to_date' END"""
CHANGES = {"changes": f"SELECT f.doc_id, {_HASH.format('f')} AS content_hash, {_OUTCOME} AS outcome FROM files f LEFT JOIN stored s ON f.doc_id = s.doc_id"}


def stored_hashes(t):
    return t.stored.select("doc_id", "scoring_version", X.content_hash(F.col("content")).alias("content_hash"), "created_at")


def scan(t):
    return t.files.withColumn("content_hash", X.content_hash(F.col("content")))


@query("change_detection", "SELECT doc_id, content_hash, outcome FROM changes", ("files", "stored"), CHANGES)
def _(t):
    return I.detect_changes(scan(t).select("doc_id", "content_hash"), stored_hashes(t)).select("doc_id", "content_hash", "outcome")


@query("build_file_case", f"""SELECT doc_id, id, file_type, file_role, lines, content_hash, total_score, grade, {Q.joined('keywords')} AS keywords,
       {Q.joined('entities')} AS entities, {Q.joined('api_methods')} AS api_methods, array_to_string(list_concat([file_type, file_role], keywords[1:5]), ',') AS tags
       FROM graded""", FILES, Q.SCORED)
def _(t):
    c = I.build_cases(t.files, now=F.lit("2025-06-01 00:00:00").cast("timestamp"), tag_keywords=5)
    return c.select("doc_id", "id", "file_type", "file_role", "lines", "content_hash", "total_score", "grade",
                    *[joined(F.col(x)).alias(x) for x in ("keywords", "entities", "api_methods")], F.array_join("tags", ",").alias("tags"))


@query("build_exemplar", f"""SELECT project, total_score, array_to_string(excellent_in, ',') AS excellent_in, rule_no, '{R.SCORING_VERSION}' AS scoring_version
       FROM (SELECT *, {RULE} AS rule_no FROM exemplars) WHERE rule_no > 0""", META, ROLLUP)
def _(t):
    return U.build_exemplars(project_rows(t)).select("project", "total_score", F.array_join("excellent_in", ",").alias("excellent_in"),
                                                     "decision.rule_no", "scoring_version")


_NOW = "2025-06-01 00:00:00"


@query("incremental_upsert", f"""SELECT c.doc_id, c.content_hash, CASE WHEN c.outcome = 'up_to_date' THEN 'kept' ELSE c.outcome END AS outcome,
       coalesce(s.created_at, '{_NOW}') AS created_at, CASE WHEN c.outcome = 'up_to_date' THEN s.created_at ELSE '{_NOW}' END AS updated_at,
       g.total_score FROM changes c JOIN graded g USING (doc_id) LEFT JOIN stored s USING (doc_id)""", ("files", "stored"), {**CHANGES, **Q.SCORED})
def _(t):
    first = F.lit("2025-01-01 00:00:00")

    def snapshot():
        files = t.stored.select("doc_id", "content", F.col("scoring_version").alias("v")).join(t.files.drop("content"), "doc_id")
        return I.build_cases(files, now=first).withColumn("scoring_version", F.col("v")).drop("v")

    store = written_once(t.spark, f"snapshot-{t.sf_dir}", snapshot)
    after = I.apply_changes(t.files, store, F.lit(_NOW))
    return after.select("doc_id", "content_hash", "outcome", "created_at", "updated_at", "total_score")


@query("resume_and_retry", """SELECT event_id, project, path, retry_count, CASE WHEN retry_count < 3 THEN 'retry' ELSE 'parked' END AS action,
       CASE WHEN retry_count < 3 THEN retry_count + 1 ELSE 0 END AS attempt FROM failures""", ("failures",))
def _(t):
    return I.retry_plan(t.failures).withColumn("attempt", F.coalesce("attempt", F.lit(0)))


@query("retry_until_parked", """SELECT event_id, CASE WHEN event_id % 5 < 3 - retry_count THEN 'done' ELSE 'parked' END AS status,
       least(3, retry_count + event_id % 5 + 1) AS retry_count FROM failures WHERE retry_count < 3
       UNION ALL SELECT event_id, 'parked', retry_count FROM failures WHERE retry_count >= 3""", ("failures",))
def _(t):
    """Work that succeeds at its (event_id % 5 + 1)-th try, from where earlier runs have left it."""
    def work(pending):
        tries = F.col("retry_count") - F.col("before")
        return pending.withColumn("error", F.when(F.col("event_id") % 5 != tries, "not yet"))

    pending = t.failures.select("event_id", "retry_count", F.col("retry_count").alias("before"))
    done = I.run_with_retries(pending, work)
    return done.select("event_id", "status", F.col("retry_count").cast("bigint").alias("retry_count"))


# --- stored project records of three shapes, built from the flat view

def stored_records(t, *others, records=None):
    c, shape = F.col, F.col("shape")
    some = lambda *pairs: F.array_compact(F.array(*[F.when(cond, F.lit(v)) for v, cond in pairs]))
    true = F.lit(True)
    meta = F.struct(
        c("legacy_api").alias("api_type"), some(("vue3", true), ("pinia", c("amount") > 200000)).alias("frameworks"),
        some(("api-client", c("amount") > 100000), ("error-recovery", true), ("lazy-cache", c("has_framework"))).alias("patterns"),
        some(("CommonTable", true), ("CommonForm", c("amount") > 50000)).alias("components_used"),
        F.when(c("amount") > 300000, "high").otherwise("low").alias("average_complexity"),
        F.lit(10).cast("bigint").alias("total_files"),
        F.when(c("amount") > 150000, F.create_map(*[F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v)
                                                    for v in ("page", 4, "component", 3, "api", 3)]))
        .otherwise(F.create_map(F.lit("page"), F.lit(10).cast("bigint"))).alias("files_by_category"),
        some(("getUser", true), ("listUsers", c("amount") > 200000)).alias("api_methods"),
        some(("lodash", true), ("element-plus", c("amount") > 250000)).alias("dependencies"),
        F.when(c("amount") > 100000, "element-plus").alias("design_system"),
        F.when(c("has_framework"), "vueuse").alias("utility_library"),
        some(("useUser", true), ("useRoute", c("amount") > 50000)).alias("composables_used"),
        F.when(c("amount") > 180000, F.array(F.struct(F.lit("a.vue").alias("path"), F.array(
            F.lit("Clean structure"), F.lit("API error handling")).alias("reasons"))))
        .otherwise(F.array().cast("array<struct<path:string,reasons:array<string>>>")).alias("excellent_files"),
        F.lit(4).cast("bigint").alias("files_with_good_error_handling"),
        F.lit(7).cast("bigint").alias("files_with_good_types"))
    count = lambda cond: F.when(cond, 2).otherwise(0).cast("bigint")
    patterns = F.struct(
        F.when(shape == "legacy", c("stored_total").cast("double")).alias("score"),
        F.when(shape.isin("metadata", "scored"), meta).alias("metadata"),
        F.struct((c("legacy_api") == "grpc").alias("has_grpc"), (c("legacy_api") == "openapi").alias("has_openapi"),
                 c("legacy_api").alias("api_type")).alias("api_info"),
        F.when(c("has_framework"), F.lit("vuex")).alias("framework"),
        F.create_map(F.lit("useStateStore"), count(c("amount") > 150000), F.lit("useTypeGuard"), count(true)).alias("composable_usage"),
        F.create_map(F.lit("CommonList"), count(c("amount") > 120000), F.lit("CommonCard"), count(F.lit(False))).alias("component_usage"))
    scores = F.struct(*[(c("stored_total") % 100).cast("double").alias(d) for d in R.DIMENSIONS])
    scored = shape == "scored"
    return (t.records if records is None else records).select(
        "id", "project_name", "category", F.when(c("amount") > 10000, F.array(F.lit("a.vue"))).alias("files"),
        F.when(shape != "none", patterns).alias("patterns"), F.when(scored, scores).alias("scores"),
        F.when(scored, (c("stored_total") % 100).cast("bigint")).alias("total_score"),
        F.when(scored, F.array().cast("array<string>")).alias("excellent_in"), "scoring_version",
        F.when(c("amount") > 5000, F.struct(c("created_at"), c("created_at").alias("updated_at"),
                                            F.array(F.lit("v2.0")).alias("tags"))).alias("metadata"), *others)


_SCORED = "shape = 'scored'"
_MISSING_FIELDS = Q.present(["CASE WHEN project_name IS NULL THEN 'project_name' END", "CASE WHEN category IS NULL THEN 'category' END",
                             "CASE WHEN amount <= 10000 THEN 'files' END", "CASE WHEN shape = 'none' THEN 'patterns' END",
                             "CASE WHEN amount <= 5000 THEN 'metadata' END"])
SHAPES = {"shapes": f"""SELECT *, CASE shape WHEN 'scored' THEN '2.0' WHEN 'metadata' THEN '1.5' WHEN 'legacy' THEN '1.0' ELSE 'unknown' END AS version,
    {_MISSING_FIELDS} AS missing_fields, {_SCORED} AND scoring_version <> '{R.SCORING_VERSION}' AS outdated,
    version <> '2.0' OR len(missing_fields) > 0 OR outdated AS needs_migration FROM records"""}


@query("shape_version", "SELECT id, version, array_to_string(missing_fields, ',') AS missing_fields, outdated, needs_migration FROM shapes",
       ("records",), SHAPES)
def _(t):
    return H.shape_version(stored_records(t)).select("id", "version", F.array_join("missing_fields", ",").alias("missing_fields"),
                                                     "outdated", "needs_migration")


_KNOWN = "shape IN ('metadata', 'scored')"


def _migrate_feature(name):
    lists = {"patterns": "mp", "dependencies": "md", "excellent": "me"}
    if name in R.COUNTED:
        field, needles = R.COUNTED[name]
        if field == "excellent":    # files with such a reason: the fixture has one file or none
            return f"(CASE WHEN len(list_filter(me, lambda x: {Q.any_of('lower(x)', needles)})) > 0 THEN 1 ELSE 0 END)"
        return f"len(list_filter({lists[field]}, lambda x: {Q.any_of('x', needles)}))"
    return {"patterns": "len(mp)", "components_used": "len(mc)", "complexity": "mx", "api_type": "legacy_api",
            "has_api": "(legacy_api <> 'none')",
            "has_design_system": f"({_KNOWN} AND amount > 100000)",
            "has_utility_library": f"({_KNOWN} AND has_framework)",
            "categories": f"(CASE WHEN NOT {_KNOWN} THEN 0 WHEN amount > 150000 THEN 3 ELSE 1 END)",
            "api_methods": f"(CASE WHEN NOT {_KNOWN} THEN 0 WHEN amount > 200000 THEN 2 ELSE 1 END)",
            "composables_used": f"(CASE WHEN NOT {_KNOWN} THEN 0 WHEN amount > 50000 THEN 2 ELSE 1 END)",
            "excellent_ratio": f"(CASE WHEN {_KNOWN} AND amount > 180000 THEN 0.1 ELSE 0 END)",
            "good_error_ratio": f"(CASE WHEN {_KNOWN} THEN 0.4 ELSE 0 END)",
            "good_type_ratio": f"(CASE WHEN {_KNOWN} THEN 0.7 ELSE 0 END)",
            "state_library": "(CASE WHEN list_contains(mf, 'pinia') THEN 'pinia' WHEN list_contains(mf, 'vuex') THEN 'vuex' ELSE 'none' END)"
            }[name]


MIGRATED = {
    **SHAPES,
    "mig0": f"""SELECT *, CASE WHEN shape = 'none' THEN 'none' ELSE legacy_api END AS legacy_api2,
        CASE WHEN shape IN ('metadata', 'scored') THEN {Q.present(["'vue3'", "CASE WHEN amount > 200000 THEN 'pinia' END"])}
             WHEN shape = 'legacy' AND has_framework THEN ['vuex'] ELSE [] END AS mf,
        CASE WHEN shape IN ('metadata', 'scored') THEN {Q.present(["CASE WHEN amount > 100000 THEN 'api-client' END", "'error-recovery'", "CASE WHEN has_framework THEN 'lazy-cache' END"])}
             WHEN shape = 'legacy' THEN {Q.present(["CASE WHEN amount > 150000 THEN 'useStateStore' END", "'useTypeGuard'"])} ELSE [] END AS mp,
        CASE WHEN shape IN ('metadata', 'scored') THEN {Q.present(["'CommonTable'", "CASE WHEN amount > 50000 THEN 'CommonForm' END"])}
             WHEN shape = 'legacy' AND amount > 120000 THEN ['CommonList'] ELSE [] END AS mc,
        CASE WHEN shape IN ('metadata', 'scored') THEN CASE WHEN amount > 300000 THEN 'high' ELSE 'low' END ELSE 'medium' END AS mx,
        CASE WHEN {_KNOWN} THEN {Q.present(["'lodash'", "CASE WHEN amount > 250000 THEN 'element-plus' END"])} ELSE [] END AS md,
        CASE WHEN {_KNOWN} AND amount > 180000 THEN ['Clean structure', 'API error handling'] ELSE [] END AS me,
        needs_migration AND (shape <> 'scored' OR stored_total % 100 = 0 OR outdated) AS rescored FROM shapes""",
    "mig1": f"SELECT * EXCLUDE (legacy_api2) REPLACE (legacy_api2 AS legacy_api), {Q.score_columns(R.PROJECT_SCORE_TERMS, _migrate_feature).replace('legacy_api', 'legacy_api2')} FROM mig0",
    "mig": f"""SELECT *, CASE WHEN rescored THEN {Q.total()} ELSE stored_total % 100 END AS total_score,
        CASE WHEN rescored THEN {Q.excellent()} ELSE [] END AS excellent FROM mig1""",
}
_TAGS = ("CASE WHEN needs_migration THEN list_concat(CASE WHEN amount > 5000 THEN ['v2.0'] ELSE [] END, "
         "list_concat(['multi-score', 'v2.0', 'score-' || (floor(total_score / 10) * 10)::INT], list_transform(excellent, lambda d: 'excellent-' || d))) "
         "ELSE CASE WHEN amount > 5000 THEN ['v2.0'] END END")


@query("migrate_shape", f"""SELECT id, CASE WHEN needs_migration THEN 'migrated' ELSE 'skipped' END AS status, rescored, total_score::BIGINT AS total_score,
       array_to_string(excellent, ',') AS excellent_in, {Q.joined(_TAGS)} AS tags,
       CASE WHEN rescored THEN '{R.SCORING_VERSION}' ELSE scoring_version END AS scoring_version FROM mig""", ("records",), MIGRATED)
def _(t):
    m = H.migrate(stored_records(t), F.lit(_NOW).cast("timestamp_ntz"))
    return m.select("id", "status", "rescored", "total_score", F.array_join("excellent_in", ",").alias("excellent_in"),
                    joined(F.col("tags")).alias("tags"), "scoring_version")


def open_records(t):
    """The stored records as JSON, each with fields of its writer's own beside the known ones."""
    own = stored_records(t, "amount", "has_framework", records=spread(t.records))
    known = [c for c in own.columns if c not in ("amount", "has_framework", "patterns", "metadata")]
    patterns = F.when(F.col("patterns").isNotNull(), F.struct(
        F.col("patterns.*"), F.struct(F.col("amount").alias("seen"), F.array(F.lit("x"), F.col("id")).alias("of")).alias("odd")))
    metadata = F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.*"), F.col("project_name").alias("owner")))
    return own.select("id", F.to_json(F.struct(*known, patterns.alias("patterns"), metadata.alias("metadata"),
                                               F.col("has_framework").alias("flag"))).alias("json"))


# fields that no schema names, read back from the migrated JSON
@query("migrate_open_records", f"""SELECT id, CASE WHEN needs_migration THEN 'migrated' ELSE 'skipped' END AS status, rescored,
       total_score::BIGINT AS total_score, {Q.joined(_TAGS)} AS tags, has_framework AS flag,
       CASE WHEN shape <> 'none' THEN id END AS odd, CASE WHEN amount > 5000 THEN project_name END AS owner FROM mig""",
       ("records",), MIGRATED)
def _(t):
    done = O.migrate_records(open_records(t), F.lit(_NOW).cast("timestamp_ntz"), style=str)
    back = F.parse_json("migrated")

    def read(path, kind="string"):
        return F.try_variant_get(back, path, kind)

    return done.select(
        "id", "status", "rescored", "total_score", joined(read("$.metadata.tags", "array<string>")).alias("tags"),
        read("$.flag", "boolean").alias("flag"), read("$.patterns.odd.of[1]").alias("odd"), read("$.metadata.owner").alias("owner"))


@query("unnamed_fields", """SELECT '$.flag' AS path, 'BOOLEAN' AS kind, count(*) AS n FROM records HAVING count(*) > 0
       UNION ALL SELECT '$.patterns.odd', 'OBJECT<of: ARRAY<STRING>, seen: BIGINT>', count(*) FROM records WHERE shape <> 'none' HAVING count(*) > 0
       UNION ALL SELECT '$.metadata.owner', 'STRING', count(*) FROM records WHERE amount > 5000 AND project_name IS NOT NULL
       HAVING count(*) > 0""", ("records",))
def _(t):
    return O.unnamed_fields(O.parse(open_records(t)), style=str)


_AGE = "date_diff('day', created_at::DATE, DATE '1999-06-01')"
VALID = {"checked": f"""SELECT id, CASE WHEN project_name IS NULL OR category IS NULL THEN 'missing fields' WHEN shape = 'none' THEN 'no patterns'
    WHEN shape <> 'scored' THEN 'no scores' WHEN amount <= 10000 THEN 'no files'
    WHEN amount > 5000 AND {_AGE} > 30 THEN 'older than limit: ' || {_AGE} || ' days' END AS reason FROM records"""}


def validated(t):
    return H.validate(stored_records(t), F.lit("1999-06-01").cast("date"))


@query("stale_records", "SELECT id, reason, reason IS NULL AS valid FROM checked", ("records",), VALID)
def _(t):
    return validated(t).select("id", "reason", "valid")


IDS = {
    "stripped": f"SELECT *, {STRIP} AS new_id, CAST(right(old_id, 13) AS BIGINT) AS stamp FROM stamped_ids WHERE {STRIP} IS NOT NULL",
    "ids": f"""SELECT old_id, new_id, CASE WHEN row_number() OVER (PARTITION BY new_id ORDER BY stamp DESC, old_id DESC) = 1 THEN 'migrated'
        ELSE 'conflict' END AS status, count(*) OVER (PARTITION BY new_id) AS copies FROM stripped
        UNION ALL SELECT old_id, old_id, 'skipped', 1 FROM stamped_ids WHERE {STRIP} IS NULL""",
}


@query("migrate_ids", "SELECT old_id, new_id, status, copies FROM ids", ("stamped_ids",), IDS)
def _(t):
    return H.migrate_ids(t.stamped_ids).select("old_id", "new_id", "status", "copies")


@query("migration_stats", """SELECT 'ids' AS run, status, count(*) AS n FROM ids GROUP BY status
       UNION ALL SELECT 'shapes', CASE WHEN needs_migration THEN 'migrated' ELSE 'skipped' END, count(*) FROM shapes GROUP BY ALL
       UNION ALL SELECT 'validation', CASE WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END, count(*) FROM checked GROUP BY ALL""",
       ("stamped_ids", "records"), {**IDS, **SHAPES, **VALID})
def _(t):
    ids = H.migrate_ids(t.stamped_ids).select(F.lit("ids").alias("run"), "status")
    shapes = H.shape_version(stored_records(t)).select(F.lit("shapes"), F.when(F.col("needs_migration"), "migrated").otherwise("skipped"))
    checked = validated(t).select(F.lit("validation"), F.when(F.col("valid"), "valid").otherwise("rejected"))
    return H.status_stats(ids.union(shapes).union(checked), "run", "status")


# --- streams: each query works off the whole table as its source

def stream_of(t, table):
    """The table as a file stream; the glob takes a single file as well as a folder."""
    path = t.path(table)
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


@query("stream_ingest", f"SELECT doc_id, content_hash, outcome FROM changes", ("files", "stored"), CHANGES)
def _(t):
    store = fresh_path(t.spark, "ingest-store")
    T.write_batch(stored_hashes(t).withColumn("outcome", F.lit("up_to_date")), store, 0)
    files = t.file_stream(stream_of(t, "documents"))
    T.run_available(files, store, T.ingest_batch(store))
    return T.current(t.spark, store, "doc_id").select("doc_id", "content_hash", "outcome")


@query("stream_dedup", "SELECT doc_id, sha256(text) AS content_hash FROM documents GROUP BY ALL")
def _(t):
    log = fresh_path(t.spark, "dedup")
    # every document is scanned twice, some minutes apart; the event time goes on with the ids
    at = F.timestamp_seconds(F.lit(1748736000) + F.col("doc_id") % 600 + F.col("later"))
    seen = (stream_of(t, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"),
                                             F.explode(F.array(F.lit(0), F.lit(300))).alias("later"))
            .select("doc_id", "content_hash", at.alias("scanned_at")))
    T.run_available(T.dedup_stream(seen, ["doc_id", "content_hash"], "scanned_at"), log,
                    lambda df, i: T.write_batch(df, log, i))
    return T.read_log(t.spark, log).select("doc_id", "content_hash")


@query("stream_latest_state", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
       FROM events GROUP BY user_id""")
def _(t):
    store = fresh_path(t.spark, "latest")
    rows = stream_of(t, "events").select("user_id", "ts", "event_id", "event_type")
    T.run_available(rows, store, T.latest_state(store, "user_id", "ts", "event_id", buckets=8))
    return RecordStore(t.spark, store, "user_id").load().select("user_id", "event_id", "event_type")


@query("stream_outcome_counts", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    log = fresh_path(t.spark, "windows")
    rows = stream_of(t, "events").select(T.utc("ts").alias("at"), "event_type")
    T.run_available(T.outcome_windows(rows, "at", "event_type"), log,
                    lambda df, i: T.write_batch(df, log, i), mode="update")
    counts = T.read_log(t.spark, log).groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return counts.select(T.utc_day("window_start").alias("day"), "event_type", "n")


# --- annotation and embedding

_LINES = "len(string_split(content, chr(10)))"
_LEVELS = Q.case([(c, f"{_LINES} < {b}") for c, b in R.COMPLEXITY_BOUNDS], "very-high")
_GUARDED = "(contains(content, 'try') AND contains(content, 'catch'))"


@query("annotate_files", f"""SELECT doc_id, {Q.case([("composable", "contains(path, 'composables')"), ("api", "contains(path, '/api/')"),
       ("utility", "contains(path, 'utils')"), ("page", "contains(path, 'pages')")], "other")} AS category, {_LEVELS} AS complexity,
       CASE WHEN contains(content, 'export ') THEN 'high' ELSE 'low' END AS reusability,
       CASE WHEN {_GUARDED} AND contains(content, 'throw') THEN 'comprehensive' WHEN {_GUARDED} THEN 'basic' ELSE 'none' END AS error_handling,
       CASE WHEN contains(content, 'interface ') THEN 'good' ELSE 'poor' END AS type_definitions, {_LINES} AS lines_of_code,
       {_GUARDED} AND contains(content, 'interface ') AS is_excellent, CAST(NULL AS VARCHAR) AS error FROM files""", FILES)
def _(t):
    return N.rule_annotations(t.files)


def _replies(paths, texts):
    """A model's stand-in: rules in the form of replies, one in seven each cut, of wrong types, missing or mere prose."""
    out = []
    for text in texts:
        lines, kind = text.count("\n") + 1, len(text) % 7
        if kind == 3:
            raise ValueError("no reply")
        reply = {"patterns": ["export"] if "export " in text else [], "features": [text[:12]], "hasDocumentation": lines > 1,
                 "complexity": N._level(lines), "isExcellent": lines >= 12, "reusability": "high" if lines < 5 else "low",
                 "errorHandling": "comprehensive" if lines >= 30 else "none", "typeDefinitions": "good", "apiType": "rest"}
        if kind == 2:
            reply |= {"patterns": "lone", "complexity": 7, "isExcellent": "maybe"}
        said = json.dumps(reply)
        if kind == 1:
            said = said[:said.index('"isExcellent"')]
        out.append("I cannot tell." if kind == 4 else f"Here it is:\n```json\n{said}\n```" if kind == 5 else said)
    return out


_RECORDS = {
    "said": f"""SELECT doc_id, content, length(content) % 7 AS kind, {_LINES} AS lines_of_code, {_LEVELS} AS level,
        {_detect_sql(R.DESIGN_SYSTEM_PATTERNS, 'design_system')} FROM files""",
    "records": """SELECT doc_id, lines_of_code, design_system,
        CASE WHEN kind IN (3, 4) THEN 'low' WHEN kind = 2 THEN 'medium' ELSE level END AS complexity,
        CASE WHEN kind IN (3, 4) THEN 'low' WHEN kind = 1 THEN 'medium' WHEN lines_of_code < 5 THEN 'high' ELSE 'low' END AS reusability,
        CASE WHEN kind IN (3, 4) THEN 'none' WHEN kind = 1 THEN 'basic' WHEN lines_of_code >= 30 THEN 'comprehensive' ELSE 'none' END AS error_handling,
        CASE WHEN kind IN (3, 4) THEN 'poor' WHEN kind = 1 THEN 'basic' ELSE 'good' END AS type_definitions,
        CASE WHEN kind IN (1, 3, 4) THEN NULL ELSE 'rest' END AS api_type, '' AS api_methods_s, '' AS frameworks_s,
        CASE WHEN kind IN (3, 4) THEN '' WHEN kind = 2 THEN 'lone' WHEN contains(content, 'export ') THEN 'export' ELSE '' END AS patterns_s,
        CASE WHEN kind IN (3, 4) OR trim(substr(content, 1, 12)) = '' THEN '' ELSE substr(content, 1, 12) END AS features,
        kind NOT IN (3, 4) AND lines_of_code > 1 AS has_documentation, kind IN (0, 5, 6) AND lines_of_code >= 12 AS is_excellent,
        CASE kind WHEN 1 THEN 'reply: cut or malformed' WHEN 3 THEN 'reply: ValueError: no reply' WHEN 4 THEN 'reply: no object'
          WHEN 2 THEN 'complexity: not a level|patterns: not a list|is_excellent: not a flag' ELSE '' END AS errors
        FROM said""",
}


@query("annotate_replies", "SELECT * EXCLUDE (api_methods_s, frameworks_s, patterns_s), patterns_s AS patterns FROM records",
       FILES, _RECORDS)
def _(t):
    records = P.annotate_records(t.files, _replies).select("doc_id", "record.*")
    one = lambda c: F.array_join(c, "|").alias(c)
    return records.select("doc_id", "lines_of_code", "design_system", *[l for l in P.LEVELS], "has_documentation", "is_excellent",
                          *[one(c) for c in ("features", "errors", "patterns")])


@query("annotated_cases", f"SELECT doc_id, {ANNOTATION_SQL}, patterns_s AS patterns FROM records", FILES, _RECORDS)
def _(t):
    return P.annotated_cases(t.files, _replies).select("doc_id", *R.DIMENSIONS, F.array_join("patterns", "|").alias("patterns"))


_HAS_API = "(contains(content, 'client.') OR contains(content, 'axios') OR contains(content, 'fetch('))"


@query("quick_classify", f"""SELECT doc_id, {_HAS_API} AS has_api, contains(content, '<El') AS has_components, {_LEVELS} AS estimated_complexity
       FROM files WHERE {_HAS_API} AND {_LINES} >= 12""", FILES)
def _(t):
    return N.quick_classify(t.files).filter("worth_deep_analysis").select("doc_id", "has_api", "has_components", "estimated_complexity")


_CELLS = {
    "words": f"SELECT doc_id, unnest(string_split(lower({EMBEDDING_TEXT}), ' ')) AS w FROM file_meta",
    "cells": """SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % 64 AS place, count(*)::DOUBLE AS n FROM words
        WHERE w <> '' GROUP BY ALL""",
}


@query("embed_texts", """SELECT doc_id, place, floor(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) * 1e4 + 0.5) / 1e4 AS weight
       FROM cells""", META, _CELLS)
def _(t):
    texts = t.file_meta.select("doc_id", X.embedding_text(
        F.col("category"), api_methods=F.col("api_methods"), components=F.col("components_used"),
        composables=F.col("composables_used"), patterns=F.col("patterns"), entities=F.col("entities")).alias("summary"))
    cells = V.embed(texts, "summary").select("doc_id", F.posexplode("embedding").alias("place", "x")).filter("x <> 0")
    return cells.select("doc_id", "place", (F.floor(F.col("x").cast("double") * 1e4 + 0.5) / 1e4).alias("weight"))
