"""Queries: quality scores."""

from pyspark.sql import functions as F

from corpuslens.functions import rules as R, scoring as S, text as X
from corpuslens.operators import incremental as I, rollup as U
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.features import FILES, META, joined
from corpuslens.plans.registry import query

DIMS = R.DIMENSIONS

# project rollup for the checks: scalars, dominant values, distinct values
_LONG = " UNION ALL ".join(
    f"SELECT project, '{f}' AS field, unnest({Q.split(f + '_s')}) AS value, doc_id FROM file_meta" for f in U.LIST_FIELDS)


def _dominant(field):
    return (f"SELECT project, arg_max(v, (n, -o)) AS {field} FROM (SELECT project, {field} AS v, count(*) AS n, "
            f"min(doc_id) AS o FROM file_meta WHERE {field} IS NOT NULL GROUP BY ALL) GROUP BY project")


def _counted(name):
    field, needles = R.COUNTED.get(name, (name, []))
    if field == "excellent":
        return (f"(SELECT count(*) FROM file_meta m WHERE m.project = p.project AND is_excellent "
                f"AND {Q.any_of('lower(excellent_reasons_s)', needles)})")
    extra = f" AND {Q.any_of('value', needles)}" if needles else ""
    return f"(SELECT count(DISTINCT value) FROM long_values v WHERE v.project = p.project AND field = '{field}'{extra})"


_COUNTED = [f for f in U._score_features() if f in R.COUNTED] + U.LIST_FIELDS
ROLLUP = {
    "long_values": _LONG,
    **{f"dom_{f}": _dominant(f) for f in U.DOMINANT},
    "proj0": f"""SELECT project, count(*) AS total_files, sum(lines_of_code)::BIGINT AS total_lines_of_code,
        count(DISTINCT category) AS categories, count(*) FILTER (is_excellent) AS excellent_files,
        count(*) FILTER (error_handling = 'comprehensive') AS files_with_good_error_handling,
        count(*) FILTER (type_definitions IN ('excellent', 'good')) AS files_with_good_types,
        floor(avg({Q.lookup('complexity', {v: i for i, v in enumerate(R.COMPLEXITY_LEVELS)})}) + 0.5) AS level
        FROM file_meta GROUP BY project""",
    "proj": f"""SELECT p.*, {Q.case([(v, f"level = {i}") for i, v in enumerate(R.COMPLEXITY_LEVELS)], None)} AS complexity,
        coalesce(a.api_type, 'none') AS api_type, d.design_system, u.utility_library,
        {", ".join(f'{_counted(n)} AS "{n}"' for n in _COUNTED)},
        CASE WHEN EXISTS (SELECT 1 FROM long_values v WHERE v.project = p.project AND field = 'frameworks' AND value = 'pinia') THEN 'pinia'
             WHEN EXISTS (SELECT 1 FROM long_values v WHERE v.project = p.project AND field = 'frameworks' AND value = 'vuex') THEN 'vuex'
             ELSE 'none' END AS state_library
        FROM proj0 p LEFT JOIN dom_api_type a USING (project) LEFT JOIN dom_design_system d USING (project)
        LEFT JOIN dom_utility_library u USING (project)""",
    "proj_features": """SELECT *, api_type <> 'none' AS has_api, design_system IS NOT NULL AS has_design_system,
        utility_library IS NOT NULL AS has_utility_library, excellent_files / total_files AS excellent_ratio,
        files_with_good_error_handling / total_files AS good_error_ratio,
        files_with_good_types / total_files AS good_type_ratio FROM proj""",
    "proj_scored": f"SELECT *, {Q.score_columns(R.PROJECT_SCORE_TERMS, Q.lit_name)} FROM proj_features",
    "exemplars": f"SELECT *, {Q.total()} AS total_score, {Q.excellent()} AS excellent_in FROM proj_scored",
}
_CRITICAL = " OR ".join(f'"{d}" >= {R.SAVE_CRITICAL}' for d in R.CRITICAL_DIMENSIONS)
RULE = (f"CASE WHEN total_score >= {R.SAVE_TOTAL} THEN 1 WHEN len(excellent_in) >= 1 THEN 2 WHEN {_CRITICAL} THEN 3 "
        f"WHEN total_score >= {R.SAVE_MINIMUM} THEN 4 ELSE 0 END")


def project_rows(t):
    return t.project_rollup


@query("project_scores_8", f"SELECT project, {Q.SCORES}, {Q.total()} AS total_score FROM proj_scored", META, ROLLUP)
def _(t):
    scored = U.project_features(project_rows(t)).select("project", *S.project_scores())
    return scored.withColumn("total_score", S.weighted_total())


FILE_SCORED = {"fs": f"SELECT doc_id, {Q.score_columns(R.FILE_SCORE_TERMS, Q.file_feature)} FROM file_meta"}


@query("file_scores_8", f"SELECT *, {Q.total()} AS total_score FROM fs", META, FILE_SCORED)
def _(t):
    return t.file_meta.select("doc_id", *S.file_scores()).withColumn("total_score", S.weighted_total())


@query("text_scores_8", f"SELECT doc_id, {Q.text_score_columns(R.RICH_TEXT_TERMS)} FROM features", FILES, Q.FEATURES)
def _(t):
    return t.features.select("doc_id", *S.text_scores(text=F.col("content")))


@query("fallback_scores_8", f"SELECT doc_id, {Q.text_score_columns(R.FALLBACK_TEXT_TERMS)} FROM features", FILES, Q.FEATURES)
def _(t):
    return t.features.select("doc_id", *S.fallback_scores(text=F.col("content")))


def _annotation_sql():
    bonus = "CASE WHEN is_excellent THEN 10 ELSE 0 END"
    level = Q.lookup("complexity", R.SINGLE_COMPLEXITY, 50)
    values = [level,
              f"least(100, {Q.lookup('api_type', R.ANNOTATION_API, 40)} + len({Q.split('api_methods_s')}) * 5) + {bonus}",
              f"50 + 10 * len({Q.split('frameworks_s')})", f"50 + 10 * len({Q.split('patterns_s')})",
              f"{Q.lookup('error_handling', R.ANNOTATION_ERROR, 50)} + {bonus}",
              f"{Q.lookup('type_definitions', R.ANNOTATION_TYPES, 50)} + {bonus}",
              Q.lookup("reusability", R.ANNOTATION_REUSE, 50), level]
    return ", ".join(f'least(100, {v})::DOUBLE AS "{d}"' for d, v in zip(DIMS, values))


ANNOTATION_SQL = _annotation_sql()


@query("annotation_scores_8", f"SELECT doc_id, {ANNOTATION_SQL} FROM file_meta", META)
def _(t):
    return t.file_meta.select("doc_id", *S.annotation_scores())


def scored(t):
    return I.score_cases(t.features)


@query("weighted_total", "SELECT doc_id, total_score FROM scored", FILES, Q.SCORED)
def _(t):
    return scored(t).select("doc_id", "total_score")


@query("score_grade", f"SELECT doc_id, {Q.grade('total_score')} AS grade FROM ft", META,
       {**FILE_SCORED, "ft": f"SELECT *, {Q.total()} AS total_score FROM fs"})
def _(t):
    df = t.file_meta.select("doc_id", *S.file_scores()).withColumn("total_score", S.weighted_total())
    return df.select("doc_id", S.grade(F.col("total_score")).alias("grade"))


@query("excellent_in", f"SELECT doc_id, array_to_string({Q.excellent()}, ',') AS excellent_in FROM fs", META, FILE_SCORED)
def _(t):
    return t.file_meta.select("doc_id", *S.file_scores()).select(
        "doc_id", F.array_join(S.excellent_in(), ",").alias("excellent_in"))


@query("save_decision", f"SELECT doc_id, rule_no > 0 AS should_save, rule_no, total_score FROM "
       f"(SELECT *, {RULE} AS rule_no FROM scored)", FILES, Q.SCORED)
def _(t):
    d = scored(t).withColumn("d", S.save_decision(F.col("total_score"), F.col("excellent_in")))
    return d.select("doc_id", "d.should_save", "d.rule_no", "total_score")


SINGLE = (f"floor(least(100, ({Q.lookup('complexity', R.SINGLE_COMPLEXITY)} + {Q.lookup('error_handling', R.SINGLE_ERROR)} "
          f"+ {Q.lookup('type_definitions', R.SINGLE_TYPES)} + {Q.lookup('reusability', R.SINGLE_REUSE)}) / 4 "
          "+ CASE WHEN is_excellent THEN 10 ELSE 0 END) + 0.5)::BIGINT")


def tier_sql(score):
    return Q.case([(x, f"{score} >= {b}") for x, b in R.TIERS], "D")


@query("file_score_single", f"SELECT doc_id, {SINGLE} AS score FROM file_meta", META)
def _(t):
    return t.file_meta.select("doc_id", S.single_score().alias("score"))


@query("score_tier", f"SELECT doc_id, {tier_sql(SINGLE)} AS tier FROM file_meta", META)
def _(t):
    return t.file_meta.select("doc_id", S.tier(S.single_score()).alias("tier"))


_PS = {"ps0": f"""SELECT project, count(*) AS files, avg(s) AS mean, count(*) FILTER (is_excellent) / count(*) * 20 AS e,
       count(*) FILTER (error_handling = 'comprehensive') / count(*) * 10 AS h,
       count(*) FILTER (type_definitions IN ('excellent', 'good')) / count(*) * 10 AS q,
       {", ".join(f"count(*) FILTER ({tier_sql('s')} = '{x}') AS tier_{x}" for x in 'SABCD')}
       FROM (SELECT *, {SINGLE} AS s FROM file_meta) GROUP BY project"""}


@query("project_score_single", f"""SELECT project, files, floor(least(100, mean + e + h + q) + 0.5)::BIGINT AS overall,
       floor(mean + 0.5)::BIGINT AS average, floor(e + 0.5)::BIGINT AS excellent, floor(h + 0.5)::BIGINT AS error_handling,
       floor(q + 0.5)::BIGINT AS type_quality, {", ".join("tier_" + x for x in "SABCD")} FROM ps0""", META, _PS)
def _(t):
    return U.project_score(t.file_meta)


@query("corpus_top_files", f"SELECT doc_id, path, lines, {Q.joined('keywords')} AS keywords, content_hash, total_score, "
       "grade FROM graded ORDER BY total_score DESC, doc_id LIMIT 20", FILES, Q.SCORED)
def _(t):
    top = U.top_files(scored(t).select("doc_id", "path", "lines", "keywords", "content_hash", "total_score", "grade"), 20)
    return top.withColumn("keywords", joined(F.col("keywords")))
