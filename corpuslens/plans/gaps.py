"""Queries: comparison with exemplars and gap lists."""

from pyspark.sql import functions as F

from corpuslens.functions import rules as R
from corpuslens.operators import compare as K, joins as J, rollup as U
from corpuslens.plans import sqlgen as Q
from corpuslens.plans.features import META
from corpuslens.plans.joins import COMPARED_FIELDS, MISSING, fine_rollup, fine_values, meta_by_lang, pairs
from corpuslens.plans.registry import query
from corpuslens.plans.scores import SINGLE, tier_sql

_LEVEL = {v: i for i, v in enumerate(R.COMPLEXITY_LEVELS)}


def _n(field):
    return f"(SELECT count(*) FROM missing m WHERE m.project = q.project AND m.exemplar = q.exemplar AND m.field = '{field}')"


COMPARED = {**MISSING, "compared": f"""SELECT q.project, q.exemplar, p.complexity AS project_complexity, e.complexity AS exemplar_complexity,
    ({Q.lookup('p.complexity', _LEVEL)} - {Q.lookup('e.complexity', _LEVEL)})::BIGINT AS complexity_difference,
    floor((e.files_with_good_error_handling / e.total_files - p.files_with_good_error_handling / p.total_files) * 100 + 0.5)::BIGINT AS error_handling_gap,
    floor((e.files_with_good_types / e.total_files - p.files_with_good_types / p.total_files) * 100 + 0.5)::BIGINT AS type_quality_gap,
    {_n('patterns')} AS missing_patterns, {_n('api_methods')} AS unused_methods, {_n('components_used')} AS unused_components
    FROM pairs q JOIN proj p ON p.project = q.project JOIN proj e ON e.project = q.exemplar"""}


def compared(t):
    counts = J.missing_counts(pairs(t), fine_values(t), COMPARED_FIELDS)
    return K.compare(pairs(t), fine_rollup(t), counts)


@query("compare_projects", "SELECT * FROM compared", META, COMPARED)
def _(t):
    return compared(t)


def _rules_sql():
    tests = {2: "error_handling_gap > 20", 3: "type_quality_gap > 20", 4: "complexity_difference > 1",
             5: "unused_methods > 0", 6: "unused_components BETWEEN 1 AND 10"}

    def row(number, test):
        todo, files, loc, priority = R.GAP_RULES[number]
        lines = f"unused_methods * {loc}" if number == 5 else str(loc)
        return (f"SELECT project, exemplar, {number} AS rule_no, {Q.lit(todo)} AS todo, {Q.lit(', '.join(files))} AS files, "
                f"({lines})::BIGINT AS loc, {Q.lit(priority)} AS priority FROM compared WHERE {test}")
    return " UNION ALL ".join(row(*t) for t in tests.items())


_PATTERN_FILE = Q.lookup("value", R.PATTERN_FILES,
                         "('composables/use' || upper(substr(value, 1, 1)) || substr(value, 2) || '.ts')")


@query("gap_todos", f"""{_rules_sql()} UNION ALL SELECT project, exemplar, 1, 'add-' || value || '-pattern',
       {_PATTERN_FILE}, {Q.lookup('value', R.PATTERN_LOC, 20)}, {Q.lookup('value', R.PATTERN_PRIORITY, 'low')} FROM missing WHERE field = 'patterns'""", META, COMPARED)
def _(t):
    patterns = J.anti_join_missing(pairs(t), fine_values(t), ["patterns"])
    todos = K.gap_todos(compared(t), patterns)
    return todos.select("project", "exemplar", "rule_no", "todo", F.array_join("files", ", ").alias("files"), "loc", "priority")


@query("reference_files_top3", f"""SELECT project, kind, rank, path, doc_id, score, {tier_sql('score')} AS tier FROM
       (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY score DESC, doc_id) AS rank FROM
         (SELECT *, {SINGLE} AS score, unnest({Q.present(["CASE WHEN error_handling = 'comprehensive' THEN 'error-handling' END",
                                                          "CASE WHEN type_definitions = 'excellent' THEN 'types' END"])}) AS kind FROM file_meta))
       WHERE rank <= 3""", META)
def _(t):
    return K.reference_files(t.file_meta).withColumn("rank", F.col("rank").cast("bigint"))
