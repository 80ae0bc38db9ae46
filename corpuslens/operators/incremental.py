"""Building, comparing and updating file records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import rules as R, scoring as S, text as X
from corpuslens.sources.store import pin


def extract_features(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Add everything that is read from path and text. Narrow: no shuffle.

    The text is lower-cased in its own projection so that each needle scans
    the same value instead of lower-casing the text again.
    """
    p, t = F.col(path), F.col(text)
    return (files
            .withColumn("low", F.lower(t))
            .withColumns({
                "id": X.file_id(F.col("project"), p),
                "file_type": X.file_type(p),
                "file_role": X.file_role(p),
                "keywords": X.tag(F.col("low")),
                "entities": X.code_entities(t),
                "api_methods": X.api_methods(t),
                "components_used": X.components_used(t),
                "composables_used": X.composables_used(t),
                "lines": X.line_count(t),
                "content_hash": X.content_hash(t)}))


def score_cases(features: DataFrame, scores: list[Column] | None = None) -> DataFrame:
    """Add the eight scores, their total, grade and the excellent dimensions."""
    if scores is None:
        scores = S.fallback_scores(text=F.col("content"))
    return (features.select("*", *scores)
            .withColumns({"total_score": S.weighted_total(), "excellent_in": S.excellent_in()})
            .withColumn("grade", S.grade(F.col("total_score"))))


def build_cases(files: DataFrame, extra_keywords: Column | None = None, now: Column | None = None,
                scores: list[Column] | None = None, tag_keywords: int | None = None) -> DataFrame:
    """Whole record per file: features, scores and metadata tags, in one stage.

    ``scores`` are the eight score columns to use, by default the plain ones
    from text; ``scoring.text_scores`` gives the richer variant. Tags hold all
    keywords, or the first ``tag_keywords``.
    """
    df = extract_features(files)
    if extra_keywords is not None:
        df = df.withColumn("keywords", F.array_distinct(F.concat("keywords", extra_keywords)))
    df = score_cases(df, scores)
    stamp = F.current_timestamp() if now is None else now
    return df.withColumns({
        "scoring_version": F.lit(R.SCORING_VERSION),
        "tags": F.concat(F.array("file_type", "file_role"), F.col("keywords") if tag_keywords is None else F.slice("keywords", 1, tag_keywords)),
        "created_at": stamp, "updated_at": stamp, "analyzed_at": stamp,
    }).drop("low")


def join_annotations(files: DataFrame, annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left join; annotated files are scored by lookup, the rest from their text."""
    annotated = annotations.select(
        key, F.lit(True).alias("annotated"),
        *[c.alias(f"a_{d}") for d, c in zip(R.DIMENSIONS, _annotation_exprs())],
        F.col("api_type").alias("a_api_type"), F.col("is_excellent").alias("a_excellent"))
    scored = files.select("*", *S.fallback_scores(text=F.col("content")))
    extra = F.array_compact(F.array(
        F.when(F.col("a_excellent"), F.lit("excellent")),
        F.when(F.col("a_api_type").isin("grpc", "rest"), F.col("a_api_type"))))
    joined = scored.join(annotated, key, "left")
    return joined.withColumns(
        {d: F.coalesce(F.col(f"a_{d}"), F.col(d)) for d in R.DIMENSIONS}
        | {"annotated": F.coalesce("annotated", F.lit(False)),
           "keywords": F.array_distinct(F.concat("keywords", extra))}
    ).drop(*[f"a_{d}" for d in R.DIMENSIONS], "a_api_type", "a_excellent")


def _annotation_exprs() -> list[Column]:
    return S.annotation_scores()


def detect_changes(scan: DataFrame, store: DataFrame, version: str = R.SCORING_VERSION,
                   force: bool = False, key: str = "doc_id") -> DataFrame:
    """Outcome per scanned file: the first rule that holds, in fixed order.

    ``scan``: key, content_hash. ``store``: key, content_hash, scoring_version.
    Pass them without texts, so that only hashes travel through the join.
    """
    known = store.select(key, F.col("content_hash").alias("stored_hash"),
                         F.col("scoring_version").alias("stored_version"), F.lit(True).alias("known"))
    outcome = (F.when(F.lit(force), "force_reanalyze")
               .when(F.col("known").isNull(), "new_file")
               .when(~F.col("stored_version").eqNullSafe(version), "version_outdated")
               .when(~F.col("stored_hash").eqNullSafe(F.col("content_hash")), "content_changed")
               .otherwise("up_to_date"))
    return (scan.join(known, key, "left").withColumn("outcome", outcome)
            .drop("stored_hash", "stored_version", "known"))


def changed_files(scan: DataFrame, store: DataFrame, key: str = "doc_id", version: str = R.SCORING_VERSION) -> DataFrame:
    """Keys to rebuild, as a small written table: key, content_hash, outcome, first_seen.

    Outcomes are settled on keys and hashes alone. The table is then joined to
    the scan: when little has changed it is broadcast, and no text moves.
    """
    hashes = scan.select(key, X.content_hash(F.col("content")).alias("content_hash")).groupBy(key).agg(
        F.max("content_hash").alias("content_hash"))  # a file scanned twice counts once
    outcomes = detect_changes(hashes, store, version, key=key).filter(F.col("outcome") != "up_to_date")
    return pin(outcomes.join(store.select(key, F.col("created_at").alias("first_seen")), key, "left"), "changed")


def rebuild(scan: DataFrame, changed: DataFrame, now: Column, key: str = "doc_id", repeats: bool = False) -> DataFrame:
    """New records of the changed files; known files keep their first ``created_at``.

    ``repeats``: the scan may hold the same version of a file more than once.
    """
    files = scan.withColumn("content_hash", X.content_hash(F.col("content"))).join(changed, [key, "content_hash"])
    return (build_cases(files.dropDuplicates([key]) if repeats else files, now=now)
            .withColumn("created_at", F.coalesce("first_seen", now)).drop("first_seen"))


def apply_changes(scan: DataFrame, store: DataFrame, now: Column, key: str = "doc_id",
                  version: str = R.SCORING_VERSION) -> DataFrame:
    """Store after a rescan: changed files rebuilt, unchanged and unseen ones kept.

    A first scan has nothing to compare: ``build_cases`` alone makes the store.
    ``scan``: files (key, project, path, content), each once. ``store``: records with
    content_hash, scoring_version, created_at.
    """
    changed = changed_files(scan, store, key, version)
    rebuilt = rebuild(scan, changed, now, key)
    kept = store.join(changed.select(key), key, "left_anti")
    columns = [c for c in store.columns if c in rebuilt.columns] + ["outcome"]
    return (rebuilt.select(*columns)
            .unionByName(kept.withColumn("outcome", F.lit("kept")).select(*columns)))


def outcome_stats(df: DataFrame, by: str, outcome: str, failed: str = "error") -> DataFrame:
    """Counts per project and outcome, plus an overall row (project null)."""
    counts = df.groupBy(by, outcome).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy(outcome).agg(F.sum("n").alias("n")).withColumn(by, F.lit(None).cast(df.schema[by].dataType))
    return counts.unionByName(overall).withColumn("failed", F.col(outcome) == failed)


def run_with_retries(pending: DataFrame, work: Callable[[DataFrame], DataFrame], max_retries: int = 3) -> DataFrame:
    """Run ``work`` on the pending rows, and again on those that fail, until all are done or parked.

    ``pending`` has a ``retry_count`` from earlier runs; ``work`` returns its rows with an ``error`` column (null: done).
    Every round is a written table, so a lost executor or a stopped run goes on from the last round. Returns all
    rows with ``status`` (done or parked) and their count of tries.
    """
    parked = pending.filter(F.col("retry_count") >= max_retries).withColumn("status", F.lit("parked"))
    left, ended = pending.filter(F.col("retry_count") < max_retries), [parked]
    while True:
        tried = pin(work(left), "attempt").withColumn("retry_count", F.col("retry_count") + 1)
        failed = F.col("error").isNotNull()
        ended.append(tried.filter(~failed).withColumn("status", F.lit("done")).select(parked.columns))
        ended.append(tried.filter(failed & (F.col("retry_count") >= max_retries)).withColumn("status", F.lit("parked"))
                     .select(parked.columns))
        left = tried.filter(failed & (F.col("retry_count") < max_retries)).select(pending.columns)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, ended)


def retry_plan(failures: DataFrame, max_retries: int = 3) -> DataFrame:
    """Split failures into the next retry round and those that stay parked."""
    again = F.col("retry_count") < max_retries
    return failures.withColumns({
        "action": F.when(again, F.lit("retry")).otherwise(F.lit("parked")),
        "attempt": F.when(again, F.col("retry_count") + 1)})
