"""Column builders over paths and file text. All JVM-side, one pass, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from corpuslens.functions import rules as R


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def contains_all(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(n)) for n in needles])


def first_match(cases: list[tuple[str, Column]], default: Column) -> Column:
    """CASE WHEN chain from (value, condition) pairs."""
    return F.coalesce(*[F.when(cond, F.lit(value)) for value, cond in cases], default)


# --- paths -----------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_id(project: Column, path: Column) -> Column:
    """Deterministic record id: ``project--path`` with separators replaced."""
    return F.concat_ws("--", F.translate(project, "/\\", "--"), F.translate(path, "/\\.", "---"))


def file_type(path: Column) -> Column:
    # a leading dot is a hidden file, not an extension
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.when(ext == "", F.lit("unknown")).otherwise(ext)


def _has_dir(path: Column, name: str, strict: bool = False) -> Column:
    return path.rlike(rf"[/\\]{name}[/\\]" if strict else rf"(^|[/\\]){name}[/\\]")


def file_role(path: Column, strict: bool = False, dirs=R.ROLE_DIRS) -> Column:
    """Role by directory name, first rule wins; ``strict`` wants a slash before it."""
    low = F.lower(path)
    return first_match(
        [(role, reduce(lambda a, b: a | b, [_has_dir(low, n, strict) for n in names]))
         for role, names in dirs],
        F.lit("other"))


def file_category(path: Column, strict: bool = False) -> Column:
    """Ten-way taxonomy used when ranking files for a page; ``strict`` as for roles."""
    low = F.lower(path)

    def inside(name: str) -> Column:
        return _has_dir(low, name, strict)

    shared = contains_any(low, ["common", "shared"])
    component = inside("components") | low.endswith(".vue")
    return first_match([
        ("page", inside("pages") | F.contains(low, F.lit(".page."))),
        ("shared-component", component & shared),
        ("component", component),
        ("composable", inside("composables") | F.contains(low, F.lit("use"))),
        ("api", inside("api") | inside("server")),
        ("type", inside("types") | low.endswith(".d.ts")),
        ("store", inside("stores") | inside("store")),
        ("utility", inside("utils") | inside("helpers")),
        ("service", inside("services")),
    ], F.lit("other"))


def annotation_category(path: Column) -> Column:
    """Five-way taxonomy used by the annotator defaults (case kept)."""
    return first_match([
        ("composable", F.contains(path, F.lit("composables"))),
        ("api", F.contains(path, F.lit("/api/"))),
        ("utility", F.contains(path, F.lit("utils"))),
        ("page", F.contains(path, F.lit("pages"))),
    ], F.lit("other"))


def role_hint(path: Column, last_wins: bool = True, hints=R.ROLE_HINTS) -> Column:
    """Role guessed from a partial path, default page.

    ``last_wins`` follows a chain of overwrites, the other form stops at the
    first rule that fires.
    """
    ordered = list(reversed(hints)) if last_wins else hints
    return first_match([(role, F.contains(path, F.lit(n))) for role, n in ordered], F.lit("page"))


def path_entities(path: Column, stop=R.ENTITY_STOPLIST) -> Column:
    """Path segments turned into PascalCase entity names."""
    cleaned = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"\.(vue|ts|tsx|js)$", ""))
    kept = F.filter(cleaned, lambda s: (s != "index") & (F.length(s) > 2))
    pascal = F.transform(kept, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s))))
    return F.filter(pascal, lambda s: ~s.isin(stop))


# --- text ------------------------------------------------------------------

def tag(lowered: Column, rules=R.KEYWORD_RULES, all_rules=R.KEYWORD_RULES_ALL) -> Column:
    """Tags whose needles occur in the lower-cased text, in rule order.

    Pass a column that already holds the lower-cased text: it is read once per
    needle, and lower-casing whole texts again for each needle would dominate.
    """
    hits = [F.when(contains_any(lowered, needles), F.lit(name)) for name, needles in rules]
    hits += [F.when(contains_all(lowered, needles), F.lit(name)) for name, needles in all_rules]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def request_keywords(lowered: Column, target: Column | None = None, rules=R.REQUEST_RULES) -> Column:
    """Keywords of a request plus the caller's target function, distinct."""
    found = tag(lowered, rules, [])
    if target is None:
        return found
    return F.array_distinct(F.concat(found, F.array_compact(F.array(target))))


def todo_hints(text: Column, rules=R.TODO_RULES) -> Column:
    """Hints named in TODO comments, in order of comment and rule."""
    todos = F.regexp_extract_all(text, F.lit(r"(?i)TODO[:\s]+([^\n]+)"), F.lit(0))
    return F.flatten(F.transform(todos, lambda t: F.array_compact(
        F.array(*[F.when(contains_any(F.lower(t), needles), F.lit(name)) for name, needles in rules]))))


def code_entities(text: Column, nouns=R.ENTITY_NOUNS) -> Column:
    """Declared interfaces and type aliases, plus well-known nouns."""
    declared = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in
                (r"interface\s+([A-Z][a-zA-Z0-9_]*)", r"type\s+([A-Z][a-zA-Z0-9_]*)\s*=")]
    known = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in nouns]))
    return F.array_distinct(F.concat(*declared, known))


def api_methods(text: Column, rest_calls=R.REST_CALLS) -> Column:
    """``client.x(`` and ``useBackendClient().x`` as grpc.x, plus REST calls."""
    grpc = F.concat(
        F.regexp_extract_all(text, F.lit(r"client\.([a-zA-Z]+)\s*\("), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"useBackendClient\(\)\.([a-zA-Z]+)"), F.lit(1)))
    rest = F.array_compact(F.array(*[F.when(contains_any(text, n), F.lit(m)) for m, n in rest_calls]))
    return F.array_distinct(F.concat(F.transform(grpc, lambda m: F.concat(F.lit("grpc."), m)), rest))


def components_used(text: Column) -> Column:
    """``<El…`` tags first, then the other upper-case tags; distinct."""
    element = F.regexp_extract_all(text, F.lit(r"<(El[A-Z][a-zA-Z]+)"), F.lit(1))
    custom = F.regexp_extract_all(text, F.lit(r"<([A-Z][a-zA-Z]+)(?:\s|>|/)"), F.lit(1))
    return F.array_distinct(F.concat(element, F.filter(custom, lambda c: ~c.startswith("El"))))


def composables_used(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(use[A-Z][a-zA-Z]+)\s*\("), F.lit(1)))


def split_block(text: Column, tag_name: str) -> Column:
    """Body of the first ``<tag …>`` block, empty when there is none."""
    return F.regexp_extract(text, rf"(?s)<{tag_name}[^>]*>(.*?)</{tag_name}>", 1)


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a trailing newline opens a last, empty line."""
    return F.size(F.split(text, "\n")).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def complexity(lines: Column, bounds=R.COMPLEXITY_BOUNDS) -> Column:
    return first_match([(name, lines < bound) for name, bound in bounds], F.lit("very-high"))


def detect_library(text: Column, patterns, custom=()) -> Column:
    """Library whose patterns match most often; ties go to the earlier one.

    ``patterns`` and ``custom`` are lists of (library, [regex, …]); null when
    nothing matches.
    """
    entries = list(patterns) + list(custom)
    scored = F.array(*[
        F.struct(
            reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in regexes]).alias("n"),
            F.lit(-i).alias("o"), F.lit(name).alias("lib"))
        for i, (name, regexes) in enumerate(entries)])
    # bound once: the counts behind it are the whole cost
    best = F.transform(F.array(F.array_max(scored)), lambda b: F.when(b["n"] > 0, b["lib"]))
    return F.get(best, F.lit(0))


def component_category(name: Column, rules=R.COMPONENT_CATEGORIES) -> Column:
    low = F.lower(name)
    return first_match([(c, contains_any(low, n)) for c, n in rules], F.lit("other"))


def function_category(name: Column, patterns: Column | None = None, rules=R.FUNCTION_CATEGORIES,
                      by_pattern=R.FUNCTION_PATTERN_CATEGORIES) -> Column:
    low = F.lower(name)
    cases = [(c, contains_any(low, n)) for c, n in rules]
    if patterns is not None:
        cases += [(c, F.coalesce(F.array_contains(patterns, p), F.lit(False))) for c, p in by_pattern]
    return first_match(cases, F.lit("utility"))


def name_prefix(name: Column) -> Column:
    """Leading word of a component name: CommonTable → Common; null without one."""
    word = F.regexp_extract(name, r"^([A-Z][a-z]+)[A-Z]", 1)
    short = F.regexp_extract(name, r"^([A-Z][a-z]?)[A-Z]", 1)
    return F.coalesce(F.nullif(word, F.lit("")), F.nullif(short, F.lit("")))


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def embedding_text(role: Column, **lists: Column) -> Column:
    """Summary sentence of a file; empty lists are left out.

    ``lists``: keywords, api_methods, components, composables, patterns, entities.
    """
    labels = {"keywords": "Keywords", "api_methods": "API methods", "components": "Components",
              "composables": "Composables", "patterns": "Patterns", "entities": "Entities"}
    parts = [_listed(label, lists[key]) for key, label in labels.items() if key in lists]
    return F.concat_ws(". ", F.concat(F.lit("File role: "), role), *parts)


def query_text(description: Column, target: Column | None = None, entities: Column | None = None,
               components: Column | None = None) -> Column:
    parts = [description]
    if target is not None:
        parts.append(F.when(target != "", F.concat(F.lit("Target function: "), target)))
    if entities is not None:
        parts.append(_listed("Entities", entities))
    if components is not None:
        parts.append(_listed("Components", components))
    return F.concat_ws(". ", *parts)


def metadata_keywords(patterns, frameworks, api_type, features, methods, entities,
                      level: Column, error_handling: Column, k_methods: int | None = None) -> Column:
    """Guide keywords of a metadata record, lower-cased and distinct; of the first ``k_methods`` methods if given."""
    words = F.concat(
        patterns, frameworks, F.array_compact(F.array(api_type)), features,
        methods if k_methods is None else F.slice(methods, 1, k_methods), entities,
        F.when(level == "high", F.array(F.lit("complex"), F.lit("advanced"))).otherwise(_none()),
        F.when(error_handling == "comprehensive",
               F.array(F.lit("error-handling"), F.lit("recovery"), F.lit("resilience"))).otherwise(_none()))
    return F.array_distinct(F.transform(words, F.lower))


def _none() -> Column:
    return F.array().cast("array<string>")


def guide_keywords(patterns, frameworks, entities, features, category: Column,
                   api_type: Column, design_system: Column, utility_library: Column) -> Column:
    """Variant that keeps case and adds the category and the chosen options."""
    def option(value, literal):
        return F.when(value.isNotNull(), F.array(value, F.lit(literal))).otherwise(_none())

    return F.array_distinct(F.concat(
        patterns, frameworks, entities, features, F.array_compact(F.array(category, api_type)),
        option(design_system, "design-system"), option(utility_library, "utility")))


def strip_timestamp(record_id: Column, after: int = 1577836800000) -> Column:
    """Id without its trailing 13-digit epoch; null when there is none."""
    digits = F.regexp_extract(record_id, r"^.*-([0-9]{13})$", 1)
    stamped = F.try_to_number(digits, F.lit("9999999999999")) > after
    return F.when(stamped, F.regexp_extract(record_id, r"^(.*)-[0-9]{13}$", 1))


def id_timestamp(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"-([0-9]{13})$", 1).try_cast("bigint")


def regex_flags(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [text.rlike(p).alias(name) for name, p in patterns.items()]


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` are wild, everything else is literal."""
    escaped = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c)
                      for c in pattern)
    return f"^{escaped}$"
