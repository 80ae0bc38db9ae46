"""Quality scores as column expressions over rule data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from corpuslens.functions import rules as R
from corpuslens.functions.text import contains_all, contains_any, first_match


def half_up(x: Column) -> Column:
    """Round half towards +infinity, also for negative numbers."""
    return F.floor(x + F.lit(0.5))


def lookup(key: Column, table: dict, default=None) -> Column:
    return first_match([(v, key == k) for k, v in table.items()], F.lit(default))


def capped(x: Column, cap: float = 100.0) -> Column:
    return F.least(x, F.lit(float(cap)))


def _steps(cases, default) -> Column:
    return F.coalesce(*[F.when(c, F.lit(float(p))) for c, p in cases],
                      default if isinstance(default, Column) else F.lit(float(default)))


def _term(term, feature: Callable[[str], Column]) -> Column:
    kind, rest = term[0], term[1:]
    if kind == "base":
        return F.lit(float(rest[0]))
    value = feature(R.feature_name(rest[0]))
    if kind == "pick":
        return _steps([(value == k, p) for k, p in rest[1].items()], 0)
    if kind == "flag":
        return _steps([(value, rest[1])], 0)
    if kind == "under":
        return _steps([(value < b, p) for b, p in rest[1]], 0)
    if kind == "from":
        return _steps([(value >= b, p) for b, p in rest[1]], rest[2])
    if kind == "over":
        return _steps([(value > b, p) for b, p in rest[1]], capped(value * float(rest[2]), rest[3]))
    if kind == "per":
        return capped(F.coalesce(value, F.lit(0)) * float(rest[1]), rest[2])
    if kind == "share":
        return F.coalesce(F.floor(value * rest[1]).cast("double"), F.lit(0.0))
    raise ValueError(f"unknown score term {kind!r}")


def points(terms, feature: Callable[[str], Column]) -> Column:
    """Sum of the terms, at most 100."""
    return capped(reduce(lambda a, b: a + b, [_term(t, feature) for t in terms]))


def score_columns(table: dict, feature: Callable[[str], Column]) -> list[Column]:
    return [points(table[d], feature).alias(d) for d in R.DIMENSIONS]


def count_containing(values: Column, needles: list[str]) -> Column:
    return F.size(F.filter(values, lambda v: contains_any(v, needles)))


def file_feature(name: str) -> Column:
    """Features of a file metadata row, by the names the score terms use."""
    if name in R.COUNTED:
        field, needles = R.COUNTED[name]
        return count_containing(F.col(field), needles)
    if name in ("patterns", "api_methods", "composables_used"):
        return F.size(F.col(name))
    def uses(library: str) -> Column:
        return F.exists("frameworks", lambda f: F.contains(f, F.lit(library)))

    named = {
        "lines": F.col("lines_of_code"),
        "has_category": F.coalesce(F.col("category") != "other", F.lit(False)),
        "has_api": F.coalesce(F.col("api_type") != "none", F.lit(False)),
        "has_design_system": F.col("design_system").isNotNull(),
        "has_utility_library": F.col("utility_library").isNotNull(),
        "state_library": first_match(
            [(lib, uses(lib)) for lib in ("pinia", "vuex")], F.lit("none")),
    }
    return named.get(name, F.col(name))


def file_scores() -> list[Column]:
    """Eight scores of a file metadata row."""
    return score_columns(R.FILE_SCORE_TERMS, file_feature)


def project_scores() -> list[Column]:
    """Eight scores of a project row made by ``operators.rollup.project_features``."""
    return score_columns(R.PROJECT_SCORE_TERMS, lambda name: F.col(f"`{name}`"))


METADATA_FIELDS = {
    "total_files": "bigint", "files_by_category": "map<string,bigint>", "api_type": "string",
    "api_methods": "array<string>", "frameworks": "array<string>", "patterns": "array<string>",
    "dependencies": "array<string>", "design_system": "string", "utility_library": "string",
    "components_used": "array<string>", "composables_used": "array<string>",
    "excellent_files": "array<struct<path:string,reasons:array<string>>>", "average_complexity": "string",
    "files_with_good_error_handling": "bigint", "files_with_good_types": "bigint",
}


def metadata_feature(name: str, prefix: str = "") -> Column:
    """Features of an imported project metadata row with the columns METADATA_FIELDS, lists and maps on the row.

    ``prefix`` stands before the names of the columns.
    """
    def field(column: str) -> Column:
        return F.col(prefix + column)

    def values(column: str) -> Column:
        return F.coalesce(field(column), F.array().cast("array<string>"))

    if name in R.COUNTED:
        counted, needles = R.COUNTED[name]
        if counted != "excellent":
            return count_containing(values(counted), needles)
        return F.coalesce(F.size(F.filter(field("excellent_files"), lambda f: F.exists(
            f["reasons"], lambda r: contains_any(F.lower(r), needles)))), F.lit(0))
    if name in ("patterns", "api_methods", "components_used", "composables_used"):
        return F.size(values(name))
    files = F.nullif(field("total_files"), F.lit(0))
    return {
        "categories": F.size(field("files_by_category")), "complexity": field("average_complexity"),
        "api_type": field("api_type"),
        "has_api": F.coalesce(field("api_type") != "none", F.lit(False)),
        "has_design_system": field("design_system").isNotNull(),
        "has_utility_library": field("utility_library").isNotNull(),
        "excellent_ratio": F.size(field("excellent_files")) / files,
        "good_error_ratio": field("files_with_good_error_handling") / files,
        "good_type_ratio": field("files_with_good_types") / files,
        "state_library": first_match([(lib, F.array_contains(values("frameworks"), lib)) for lib in ("pinia", "vuex")],
                                     F.lit("none")),
    }[name]


def metadata_scores() -> list[Column]:
    """Eight scores of an imported project metadata row."""
    return score_columns(R.PROJECT_SCORE_TERMS, metadata_feature)


def _text_clause(clause, c: dict[str, Column]) -> Column:
    kind, arg, pts = clause
    if kind.startswith("per_"):
        return F.size(c[kind[4:]]) * float(pts)
    tests = {
        "lines": lambda: (c["lines"] > arg[0]) & (c["lines"] < arg[1]),
        "raw": lambda: contains_any(c["text"], arg),
        "not_raw": lambda: ~contains_any(c["text"], arg),
        "low": lambda: contains_any(c["low"], arg),
        "low_all": lambda: contains_all(c["low"], arg),
        "tag": lambda: F.array_contains(c["keywords"], arg),
        "any_use_composable": lambda: F.exists(c["composables_used"], lambda x: x.startswith("use")),
    }
    return F.when(tests[kind](), F.lit(float(pts))).otherwise(F.lit(0.0))


def text_scores(table=R.RICH_TEXT_TERMS, **cols: Column) -> list[Column]:
    """Eight scores from raw text, its lower-cased form and extracted lists.

    Columns by default: text, low, lines, keywords, api_methods,
    components_used, composables_used.
    """
    names = ("text", "low", "lines", "keywords", "api_methods", "components_used", "composables_used")
    c = {n: cols.get(n, F.col(n)) for n in names}
    return [
        capped(reduce(lambda a, b: a + b, [_text_clause(x, c) for x in clauses], F.lit(float(base)))).alias(d)
        for d, (base, clauses) in ((d, table[d]) for d in R.DIMENSIONS)]


def fallback_scores(**cols: Column) -> list[Column]:
    return text_scores(R.FALLBACK_TEXT_TERMS, **cols)


def annotation_scores() -> list[Column]:
    """Eight scores by ordinal lookup from an annotated file row."""
    level = lookup(F.col("complexity"), R.SINGLE_COMPLEXITY, 50)
    bonus = F.when(F.col("is_excellent"), F.lit(10)).otherwise(F.lit(0))
    api = capped(lookup(F.col("api_type"), R.ANNOTATION_API, 40) + F.size("api_methods") * 5)
    values = {
        "structure": level,
        "apiConnection": api + bonus,
        "designSystem": F.lit(50) + F.size("frameworks") * 10,
        "utilityUsage": F.lit(50) + F.size("patterns") * 10,
        "errorHandling": lookup(F.col("error_handling"), R.ANNOTATION_ERROR, 50) + bonus,
        "typeUsage": lookup(F.col("type_definitions"), R.ANNOTATION_TYPES, 50) + bonus,
        "stateManagement": lookup(F.col("reusability"), R.ANNOTATION_REUSE, 50),
        "performance": level,
    }
    return [capped(values[d].cast("double")).alias(d) for d in R.DIMENSIONS]


def weighted_total(scores: dict[str, Column] | None = None, weights=R.WEIGHTS) -> Column:
    """Weighted mean of the eight scores, rounded; decimal, so halves are exact."""
    s = scores or {d: F.col(d) for d in R.DIMENSIONS}
    total = reduce(lambda a, b: a + b, [s[d].cast("decimal(9,3)") * F.lit(w) for d, w in weights.items()])
    return F.floor((total + F.lit(50)) / F.lit(100)).cast("bigint")


def grade(total: Column) -> Column:
    t = F.coalesce(total, F.lit(0))
    return first_match([(g, t >= bound) for g, bound in R.GRADES], F.lit("poor"))


def tier(score: Column) -> Column:
    return first_match([(t, score >= bound) for t, bound in R.TIERS], F.lit("D"))


def excellent_in(scores: dict[str, Column] | None = None, at_least: float = R.EXCELLENT_FROM) -> Column:
    s = scores or {d: F.col(d) for d in R.DIMENSIONS}
    return F.array_compact(F.array(*[F.when(s[d] >= at_least, F.lit(d)) for d in R.DIMENSIONS]))


def save_decision(total: Column, excellent: Column) -> Column:
    """struct(should_save, rule_no, reason): first of four ordered rules."""
    critical = reduce(lambda a, b: a | b, [F.col(d) >= R.SAVE_CRITICAL for d in R.CRITICAL_DIMENSIONS])
    rule = (F.when(total >= R.SAVE_TOTAL, 1).when(F.size(excellent) >= 1, 2)
            .when(critical, 3).when(total >= R.SAVE_MINIMUM, 4).otherwise(0))
    reason = (F.when(rule == 1, F.concat(F.lit("total "), total.cast("string")))
              .when(rule == 2, F.concat(F.lit("excellent in "), F.array_join(excellent, ", ")))
              .when(rule == 3, F.lit("critical dimension"))
              .when(rule == 4, F.concat(F.lit("minimum met "), total.cast("string")))
              .otherwise(F.concat(F.lit("below minimum "), total.cast("string"))))
    return F.struct((rule > 0).alias("should_save"), rule.alias("rule_no"), reason.alias("reason"))


def single_score() -> Column:
    """Mean of four ordinal lookups, plus ten when excellent; 0 to 100."""
    mean = (lookup(F.col("complexity"), R.SINGLE_COMPLEXITY) + lookup(F.col("error_handling"), R.SINGLE_ERROR)
            + lookup(F.col("type_definitions"), R.SINGLE_TYPES) + lookup(F.col("reusability"), R.SINGLE_REUSE)) / 4
    bonus = F.when(F.col("is_excellent"), F.lit(10)).otherwise(F.lit(0))
    return half_up(F.greatest(F.lit(0.0), capped(mean + bonus))).cast("bigint")


def level_index(level: Column) -> Column:
    return lookup(level, {v: i for i, v in enumerate(R.COMPLEXITY_LEVELS)})


def level_name(index: Column) -> Column:
    return lookup(index, dict(enumerate(R.COMPLEXITY_LEVELS)))
