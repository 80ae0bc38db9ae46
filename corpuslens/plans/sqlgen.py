"""SQL text for the checks, generated from the same rule data as the plans."""

from __future__ import annotations

from corpuslens.functions import rules as R


def lit(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def any_of(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def all_of(text: str, needles) -> str:
    return "(" + " AND ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def case(pairs, default) -> str:
    whens = " ".join(f"WHEN {cond} THEN {lit(value)}" for value, cond in pairs)
    return f"CASE {whens} ELSE {default if default.startswith('(') else lit(default)} END" \
        if isinstance(default, str) else f"CASE {whens} ELSE {lit(default)} END"


def present(items: list[str]) -> str:
    """List of the non-null items."""
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)" if items else "[]"


def tags(low: str, rules=R.KEYWORD_RULES, all_rules=R.KEYWORD_RULES_ALL) -> str:
    return present([f"CASE WHEN {any_of(low, n)} THEN {lit(t)} END" for t, n in rules]
                   + [f"CASE WHEN {all_of(low, n)} THEN {lit(t)} END" for t, n in all_rules])


def joined(items: str, sep: str = ",") -> str:
    """Sorted distinct list as one string."""
    return f"array_to_string(list_sort(list_distinct({items})), {lit(sep)})"


def split(field: str) -> str:
    return f"list_filter(string_split({field}, '|'), lambda x: x <> '')"


def lookup(key: str, table: dict, default=None) -> str:
    return case([(v, f"{key} = {lit(k)}") for k, v in table.items()], default)


def _number(pairs, default) -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN {float(p)}::DOUBLE" for c, p in pairs) + f" ELSE {default} END)"


def term(t, feature) -> str:
    kind, rest = t[0], t[1:]
    if kind == "base":
        return f"{float(rest[0])}::DOUBLE"
    v = feature(R.feature_name(rest[0]))
    if kind == "pick":
        return _number([(f"{v} = {lit(k)}", p) for k, p in rest[1].items()], "0")
    if kind == "flag":
        return _number([(v, rest[1])], "0")
    if kind == "under":
        return _number([(f"{v} < {b}", p) for b, p in rest[1]], "0")
    if kind == "from":
        return _number([(f"{v} >= {b}", p) for b, p in rest[1]], str(rest[2]))
    if kind == "over":
        return _number([(f"{v} > {b}", p) for b, p in rest[1]], f"least({v} * {rest[2]}, {rest[3]})")
    if kind == "per":
        return f"least(coalesce({v}, 0) * {float(rest[1])}::DOUBLE, {rest[2]})"
    if kind == "share":
        return f"coalesce(floor({v} * {rest[1]}), 0)"
    raise ValueError(kind)


def score_columns(table: dict, feature) -> str:
    return ",\n".join(
        f"least({' + '.join(term(t, feature) for t in table[d])}, 100)::DOUBLE AS {lit_name(d)}"
        for d in R.DIMENSIONS)


def lit_name(name: str) -> str:
    return f'"{name}"'


def file_feature(name: str) -> str:
    if name in R.COUNTED:
        field, needles = R.COUNTED[name]
        return f"len(list_filter({split(field + '_s')}, lambda x: {any_of('x', needles)}))"
    if name in ("patterns", "api_methods", "composables_used"):
        return f"len({split(name + '_s')})"
    return {
        "lines": "lines_of_code", "has_category": "(category <> 'other')",
        "has_api": "coalesce(api_type <> 'none', false)",
        "has_design_system": "(design_system IS NOT NULL)",
        "has_utility_library": "(utility_library IS NOT NULL)",
        "state_library": "(CASE WHEN contains(frameworks_s, 'pinia') THEN 'pinia' "
                         "WHEN contains(frameworks_s, 'vuex') THEN 'vuex' ELSE 'none' END)",
    }.get(name, name)


def text_score_columns(table: dict) -> str:
    def clause(kind, arg, pts):
        if kind.startswith("per_"):
            return f"len({kind[4:]}) * {pts}"
        test = {
            "lines": lambda: f"lines > {arg[0]} AND lines < {arg[1]}",
            "raw": lambda: any_of("text", arg), "not_raw": lambda: "NOT " + any_of("text", arg),
            "low": lambda: any_of("low", arg), "low_all": lambda: all_of("low", arg),
            "tag": lambda: f"list_contains(keywords, {lit(arg)})",
            "any_use_composable": lambda: "len(composables_used) > 0",
        }[kind]()
        return f"CASE WHEN {test} THEN {pts} ELSE 0 END"
    return ",\n".join(
        f"least(100, {' + '.join([str(base)] + [clause(*c) for c in clauses])})::DOUBLE AS {lit_name(d)}"
        for d, (base, clauses) in ((d, table[d]) for d in R.DIMENSIONS))


def total() -> str:
    weighted = " + ".join(f'"{d}"::DECIMAL(9,3) * {w}' for d, w in R.WEIGHTS.items())
    return f"floor(({weighted} + 50) / 100)::BIGINT"


def grade(t: str) -> str:
    return case([(g, f"{t} >= {b}") for g, b in R.GRADES], "poor")


def excellent() -> str:
    return present([f"CASE WHEN \"{d}\" >= {R.EXCELLENT_FROM} THEN {lit(d)} END" for d in R.DIMENSIONS])


SCORES = ", ".join(lit_name(d) for d in R.DIMENSIONS)

# features of every derived source file, as ``operators.incremental`` extracts them
CODE_ENTITIES = ("list_distinct(list_concat(list_concat("
                 "regexp_extract_all(text, 'interface\\s+([A-Z][a-zA-Z0-9_]*)', 1), "
                 "regexp_extract_all(text, 'type\\s+([A-Z][a-zA-Z0-9_]*)\\s*=', 1)), "
                 + present([f"CASE WHEN contains(text, {lit(n)}) THEN {lit(n)} END" for n in R.ENTITY_NOUNS]) + "))")
API_METHODS = ("list_distinct(list_concat(list_transform(list_concat("
               "regexp_extract_all(text, 'client\\.([a-zA-Z]+)\\s*\\(', 1), "
               "regexp_extract_all(text, 'useBackendClient\\(\\)\\.([a-zA-Z]+)', 1)), lambda m: 'grpc.' || m), "
               + present([f"CASE WHEN {any_of('text', n)} THEN {lit(m)} END" for m, n in R.REST_CALLS]) + "))")
COMPONENTS = ("list_distinct(list_concat(regexp_extract_all(text, '<(El[A-Z][a-zA-Z]+)', 1), "
              "list_filter(regexp_extract_all(text, '<([A-Z][a-zA-Z]+)(?:\\s|>|/)', 1), "
              "lambda c: NOT starts_with(c, 'El'))))")
COMPOSABLES = "list_distinct(regexp_extract_all(text, '(use[A-Z][a-zA-Z]+)\\s*\\(', 1))"


def has_dir(path: str, name: str, strict: bool = False) -> str:
    return f"regexp_matches({path}, '{'' if strict else '(^|[/])'}{'[/]' if strict else ''}{name}[/]')"


def file_role(path: str, strict: bool = False) -> str:
    return case([(role, "(" + " OR ".join(has_dir(f"lower({path})", n, strict) for n in names) + ")")
                 for role, names in R.ROLE_DIRS], "other")


FILE_TYPE = ("CASE WHEN regexp_extract(path, '[^/]\\.([^./]*)$', 1) = '' THEN 'unknown' "
             "ELSE lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) END")
FILE_ID = "replace(project, '/', '-') || '--' || replace(replace(path, '/', '-'), '.', '-')"

FEATURES = {
    "feat0": "SELECT *, content AS text, lower(content) AS low, len(string_split(content, chr(10))) AS lines FROM files",
    "features": f"""SELECT doc_id, project, path, lang, text, low, lines, n_chars,
        {FILE_ID} AS id, {FILE_TYPE} AS file_type, {file_role('path')} AS file_role,
        {tags('low')} AS keywords, {CODE_ENTITIES} AS entities, {API_METHODS} AS api_methods,
        {COMPONENTS} AS components_used, {COMPOSABLES} AS composables_used,
        substr(sha256(text), 1, 16) AS content_hash FROM feat0""",
}
SCORED = {
    **FEATURES,
    "scored0": f"SELECT *, {text_score_columns(R.FALLBACK_TEXT_TERMS)} FROM features",
    "scored": f"SELECT *, {total()} AS total_score, {excellent()} AS excellent_in FROM scored0",
    "graded": f"SELECT *, {grade('total_score')} AS grade FROM scored",
}
