"""String functions over text, paths and labels, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists, names, ranks and patterns that results depend on.

#: Words that say nothing about what a change is about.
COMMON = (
    "a add added allow an and api are as at be before by change changed check create default do does enable error existing fix for from function get if in "
    "index into is it js lib main make method missing new node not of on or py remove request return set src test tests that the this to update use used using when with"
).split()

LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java", "go": "go",
    "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "sh": "bash", "sql": "sql", "json": "json", "jsonc": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "md": "markdown", "html": "html", "css": "css", "scss": "css", "vue": "vue", "txt": "text",
}
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock")
NOISY_DIRS = ("node_modules", "vendor", "vendors", "third_party", "dist", "build", "coverage", "generated", "fixtures", "snapshots", "__snapshots__")


def split_words(text: Column) -> Column:
    """Lower-case words of at least two letters or digits; camel case is split, numbers are dropped."""
    apart = F.regexp_replace(text, r"([a-z\d])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^a-z\d]+"), lambda w: (F.length(w) >= 2) & ~F.rlike(w, F.lit(r"^\d+$")))


def exploded_words(text: Column) -> Column:
    """The words as rows, and a null where there are none: an inner explode has Spark work the
    words out a second time, to see whether there are any."""
    return F.explode_outer(split_words(text))


def useful_tokens(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*COMMON))))


def concept_tokens(labels: Column, path: Column, subject: Column) -> Column:
    """Useful tokens of changed labels (array), of path parts and stem, and of the subject."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    words = F.flatten(F.transform(labels, split_words))
    return F.struct(useful_tokens(words).alias("changed_code"), useful_tokens(F.concat(F.flatten(F.transform(F.split(path, "/"), split_words)), split_words(stem))).alias("file_path"), useful_tokens(split_words(subject)).alias("commit_subject"))


def count_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def clip(text: Column, n: int) -> Column:
    mark = F.concat(F.lit(f"\n... first {n} of "), F.length(text).cast("string"), F.lit(" characters"))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), mark)).otherwise(text)


def head_tail(text: Column, n: int, head: float = 0.72) -> Column:
    """The beginning and the end of a long text, the middle left out."""
    first = int(n * head)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, first), F.lit("\n[...]\n"), F.right(text, F.lit(n - first)))).otherwise(text)


def excerpt(text: Column, start: Column, end: Column, pad: int = 100, most: int = 1200) -> Column:
    """A span with its surroundings, cut at ``most`` characters."""
    lo = F.greatest(start - pad, F.lit(0))
    cut = F.substr(text, (lo + 1).cast("int"), (end + pad - lo).cast("int"))
    return F.when(F.length(cut) > most, F.concat(F.substring(cut, 1, most), F.lit("…"))).otherwise(cut)


def compact_excerpt(text: Column, most: int = 1800) -> Column:
    parts = F.transform(F.split(text, "\n---\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.substring(F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "\n---\n"), 1, most)


def template(**parts: Column) -> Column:
    """``name: value`` lines; a null value's line is left out."""
    return F.concat_ws("\n", *(F.concat(F.lit(k.replace("_", " ") + ": "), v) for k, v in parts.items()))


def regexp_escape(text: str) -> str:
    import re

    return re.escape(text)


def word_hits(text: Column, name: str) -> Column:
    """Occurrences of a name that no word character or ``$`` touches."""
    return F.regexp_count(text, F.lit(rf"(?<![\w$]){regexp_escape(name)}(?![\w$])"))


def label(text: Column, n: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def indent_width(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t]*", 0))


def noun_label(terms: Column) -> Column:
    return F.array_join(F.slice(terms, 1, 3), " · ")


def by_locale(text: Column) -> Column:
    """To order by: the root locale's order, in which case and accents come after the letters."""
    return F.collate(text, "UNICODE")


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[\w-]*\n", ""), r"\n```\s*$", ""))


def clean_type(text: Column) -> Column:
    """A node type: spaces to underscores; null unless it holds a letter or underscore."""
    t = F.regexp_replace(F.trim(text), r"\s+", "_")
    return F.when(F.rlike(t, F.lit("[A-Za-z_]")), t)


def anchor(text: Column) -> Column:
    """A quoted name without its quotes, lower case; null for other than identifier characters."""
    t = F.lower(F.regexp_replace(F.trim(text), "^[`'\"]+|[`'\"]+$", ""))
    return F.when(F.rlike(t, F.lit(r"^[a-z_$][\w$.-]*$")) & ~t.isin("true", "false", "null", "none", "self", "this"), t)


def normalised_label(kind: Column, text: Column) -> Column:
    return F.when(F.rlike(kind, F.lit("(?:identifier|name)$")), "$ID").when(F.rlike(kind, F.lit("^(?:string|string_fragment|integer|float|number)$")), "$LIT").otherwise(text)


# The classes of node types, their patterns and ranks.
_CALL = "^(?:call|call_expression|new_expression)$"
_ENTITIES = (
    ("conditional_guard", "^(?:if_statement|if_clause)$"), ("exception", "^(?:raise_statement|throw_statement)$"), ("function", "(?:function|method)_(?:definition|declaration|expression)$"),
    ("class", "class_(?:definition|declaration)$"), ("named_argument", "^(?:keyword_argument|default_parameter)$"), ("object_property", "^pair$"),
    ("import", "^(?:import_statement|import_from_statement|import_clause|named_imports|dotted_name)$"),
    ("assignment", "^(?:assignment|assignment_expression|augmented_assignment|lexical_declaration|variable_declaration|variable_declarator)$"), ("return_value", "^return_statement$"),
    ("loop", "^(?:for_statement|while_statement)$"), ("comment", "^comment$"), ("function_call", _CALL), ("expression_statement", "^expression_statement$"),
    ("literal", "^(?:string|string_fragment|integer|float|number|true|false|null|none|literal)$"), ("identifier", "(?:identifier|name)$"), ("delimiter", r"^[,;.:()\[\]{}]$"),
)
ENTITY_RANK = {
    "conditional_guard": 100, "exception": 95, "function": 90, "class": 90, "named_argument": 85, "object_property": 80, "function_call": 75, "import": 70, "assignment": 65,
    "return_value": 60, "loop": 55, "comment": 30, "expression_statement": 20, "literal": 15, "identifier": 10, "unknown_construct": 5, "delimiter": 0,
}


def entity(root: Column, types: Column) -> Column:
    """What an edit is about: by the type of its root, else by the types in its subtree."""

    def some(pattern: str) -> Column:
        return F.coalesce(F.exists(types, lambda t: F.rlike(t, F.lit(pattern))), F.lit(False))

    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in _ENTITIES:
        hit = F.rlike(root, F.lit(pattern))
        if name == "expression_statement":
            out = out.when(hit & some(_CALL), "function_call")
        out = out.when(hit, name)
    return out.when(some("^(?:if_statement|if_clause)$"), "conditional_guard").when(some("^(?:raise_statement|throw_statement)$"), "exception").when(some(_CALL), "function_call").otherwise("unknown_construct")


def container(kind: Column) -> Column:
    """The container that a node type is, or null."""
    rules = (
        ("function_call", "^(?:call|call_expression|new_expression|argument_list|arguments)$"), ("object_property", "^(?:object|dictionary|pair)$"), ("conditional_guard", "^(?:if_statement|if_clause)$"),
        ("function", "(?:function|method)_(?:definition|declaration|expression)$"), ("class", "class_(?:definition|declaration)$"), ("loop", "^(?:for_statement|while_statement)$"),
        ("assignment", "assignment|lexical_declaration|variable_declaration"),
    )
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(F.rlike(kind, F.lit(pattern)), name)
    return out


def operation(action: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name in ("insert", "delete", "update", "move"):
        out = out.when(action.startswith(name), name)
    return out.otherwise("other")


def rank_of(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ENTITY_RANK.items() for x in kv)), name)


# Roles that node types of several languages share, the first whose pattern matches.
ROLES = (
    ("function", "^(function_definition|function_declaration|method_definition|arrow_function|generator_function_declaration)$"),
    ("class", "^(class_definition|class_declaration)$"),
    ("call", "^(call|call_expression|new_expression)$"),
    ("string", "^(string|string_fragment|template_string|concatenated_string)$"),
    ("return", "^return_statement$"),
    ("conditional", "^(if_statement|elif_clause|conditional_expression|ternary_expression)$"),
    ("iteration", "^(for_statement|for_in_statement|while_statement|list_comprehension|dictionary_comprehension)$"),
    ("assignment", "^(assignment|assignment_expression|augmented_assignment|lexical_declaration|variable_declaration|pair)$"),
    ("access", "^(subscript|member_expression|attribute)$"),
    ("operator", "^(binary_expression|comparison_operator|boolean_operator|unary_operator)$"),
    ("sequence", "^(list|array|array_pattern|tuple|set)$"),
    ("mapping", "^(dictionary|object|object_pattern)$"),
    ("regex", "^(regex|regex_pattern)$"),
    ("error_flow", "^(try_statement|except_clause|catch_clause|finally_clause)$"),
    ("lambda", "^(lambda|lambda_expression)$"),
    ("import", "^(import_statement|import_from_statement|import_clause)$"),
)


def role(kind: Column) -> Column:
    """One of sixteen roles that node types of several languages share; null for other types."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in ROLES:
        out = out.when(F.rlike(kind, F.lit(pattern)), name)
    return out


def reference_kind(line: Column, name: str) -> Column:
    """How a line uses a name: import, then definition, then call, else reference."""
    n = regexp_escape(name)
    return (
        F.when(F.rlike(line, F.lit(rf"^\s*(?:import|from|use|require|include)\b|\brequire\(")), "import")
        .when(F.rlike(line, F.lit(rf"\b(?:def|class|function|func|fn|const|let|var|type|interface)\s+{n}\b")), "definition")
        .when(F.rlike(line, F.lit(rf"(?<![\w$]){n}\s*\(")), "call")
        .otherwise("reference")
    )


def line_range(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("Line "), first.cast("string"))).otherwise(F.concat(F.lit("Lines "), first.cast("string"), F.lit("–"), last.cast("string")))


def mentions(text: Column, names: list[str]) -> Column:
    """Names that a text mentions, longest first where they overlap, in order of appearance."""
    either = "|".join(regexp_escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![\w$])({either})(?![\w$])"), F.lit(1)), F.lower))


def repositories(csv: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(csv, ","), lambda r: F.trim(r)), lambda r: r != "")))


def language_of(path: Column) -> Column:
    """The language of a path's extension; null for others and for lock files."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.regexp_extract(base, r"\.([a-z0-9]+)$", 1))
    return F.when(~base.isin(*LOCKFILES), found)


def keep_path(path: Column, skip: list[str]) -> Column:
    return ~F.exists(F.split(F.lower(path), "/"), lambda s: s.isin(*skip))


def fenced_blocks(text: Column) -> Column:
    """The kinds of a small Markdown's lines: fence, heading, bullet, blank or text."""
    def kind(line: Column) -> Column:
        return F.when(line.startswith("```"), "fence").when(F.rlike(line, F.lit(r"^#{1,6} ")), "heading").when(F.rlike(line, F.lit(r"^\s*[-*] ")), "bullet").when(F.trim(line) == "", "blank").otherwise("text")

    return F.transform(F.split(text, "\n"), kind)


def bold_and_code(text: Column) -> Column:
    """The runs set in bold or as code."""
    return F.regexp_extract_all(text, F.lit(r"(\*\*[^*]+\*\*|`[^`]+`)"), F.lit(1))
