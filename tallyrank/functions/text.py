"""Text, list and commit scalars: Column to Column, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and templates of the published text preparation
SEP = " [SEP] "
SPACES = r"(?U)[\s\x{1c}-\x{1f}]+"
CONTROLS = r"[\x00-\x1f\x7f-\x{9f}]"
COMMIT_PREFIX = r"(?i)^(Merge|Revert|Fix|Add|Update|Remove|Refactor):\s*"
ISSUE = r"#\d+|\b[A-Z]+-\d+\b"
NO_TC, NO_COMMIT = "No test case information", "No commit information"
# end of fixed values


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """Collapse whitespace, drop control characters, trim; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(_text(c), SPACES, " "), CONTROLS, ""))


def combine_fields(summary: Column, steps: Column, commit: Column, meta: Column | None = None) -> Column:
    """Cleaned fields joined by a separator; the last two only when non-empty."""
    optional = [F.nullif(clean_text(c), F.lit("")) for c in (commit, meta) if c is not None]
    return F.concat_ws(SEP, clean_text(summary), clean_text(steps), *optional)


def field_texts(summary: Column, steps: Column, commits: Column, cr_type: Column, cr_component: Column) -> dict[str, Column]:
    """Cleaned single fields and a `Type: … Component: …` text."""
    tagged = lambda tag, c: F.when(clean_text(c) != "", F.concat(F.lit(tag), clean_text(c)))
    return {"summary": clean_text(summary), "steps": clean_text(steps), "commits": clean_text(commits),
            "cr": F.concat_ws(" ", tagged("Type: ", cr_type), tagged("Component: ", cr_component))}


def list_items(c: Column) -> Column:
    """`array<string>` of a Python list literal or JSON list; null if it is neither."""
    json = F.regexp_replace(c, r"([\[,]\s*)None(?=\s*[,\]])", "$1null")
    arr = F.from_json(json, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.when(F.trim(c).startswith("["), arr)


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def parse_list_literal(c: Column, first: int | None = None, max_chars: int | None = None) -> Column:
    """Items joined by the separator, all of them unless a number of items or characters is given;
    bad input gives the empty string."""
    joined = F.array_join(_first(list_items(c), first), SEP)
    return F.coalesce(joined if max_chars is None else F.substring(joined, 1, max_chars), F.lit(""))


def first_of_list(c: Column) -> Column:
    return F.coalesce(F.get(list_items(c), 0), F.lit(""))


def parse_commits(c: Column, keep: int | None = None) -> Column:
    """Structs (message, author, files_changed) from a JSON list of strings or objects;
    any other text is one message. Empty text gives an empty list."""
    text = F.trim(_text(c))
    items = F.try_parse_json(text).try_cast("array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    usable = F.filter(items, lambda v: kind(v).startswith("OBJECT") | (kind(v) == "STRING"))
    parsed = F.transform(usable, lambda v: F.when(
        kind(v) == "STRING", _commit(v.cast("string"), F.lit(None), F.lit(None))
    ).otherwise(_commit(F.try_variant_get(v, "$.message", "string"), F.try_variant_get(v, "$.author", "string"),
                        F.try_variant_get(v, "$.files_changed", "array<string>"))))
    plain = F.array(_commit(text, F.lit(None), F.lit(None)))
    is_list = text.startswith("[") & text.endswith("]") & items.isNotNull()
    return F.when(text == "", F.slice(plain, 1, 0)).when(is_list, _first(parsed, keep)).otherwise(plain)


def _commit(message, author, files) -> Column:
    return F.struct(message.cast("string").alias("message"), author.cast("string").alias("author"),
                    files.cast("array<string>").alias("files_changed"))


def clean_commit(c: Column) -> Column:
    """Cleaned message without one leading prefix and without issue references."""
    flat = F.regexp_replace(F.regexp_replace(_text(c), SPACES, " "), CONTROLS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, COMMIT_PREFIX, ""), ISSUE, ""))


def commit_text(commit: Column, metadata: bool = True, files: int | None = None) -> Column:
    """Message, author and base file names, all of them unless `files` is given."""
    parts = [F.nullif(clean_commit(commit["message"]), F.lit(""))]
    if metadata:
        names = F.transform(_first(commit["files_changed"], files), lambda f: F.element_at(F.split(f, "/"), -1))
        parts += [
            F.when(F.coalesce(commit["author"], F.lit("")) != "", F.concat(F.lit("Author: "), F.trim(commit["author"]))),
            F.when(F.size(commit["files_changed"]) > 0, F.concat(F.lit("Files: "), F.array_join(names, ", "))),
        ]
    return F.concat_ws(" ", *parts)


def commits_text(c: Column, keep: int | None = None, metadata: bool = True) -> Column:
    """`Commit 1: … | Commit 2: …` over the non-empty commit texts."""
    texts = F.filter(F.transform(parse_commits(c, keep), lambda x: commit_text(x, metadata)), lambda t: t != "")
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("Commit "), (i + 1).cast("string"), F.lit(": "), t)), " | ")


def package_name(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*)\.[^.]*$", 1)


def class_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def camel_to_words(c: Column, variant: str = "class") -> Column:
    """`class`: without a final `Test`, split at case changes. `dotted`: before every capital."""
    if variant == "class":
        name = F.regexp_replace(c, "Test$", "")
        words = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        return F.trim(F.lower(words))
    if variant == "dotted":
        words = F.regexp_replace(F.regexp_replace(c, "([A-Z])", " $1"), r"\.", " ")
        return F.trim(F.regexp_replace(F.lower(words), r"\s+", " "))
    raise ValueError(f"unknown variant {variant!r}")


def char_budget(max_tokens: int, margin: float = 0.9, chars_per_token: float = 4.0) -> int:
    return int(int(max_tokens * margin) * chars_per_token)


def _last_space(c: Column) -> Column:
    """Zero-based, -1 if there is none."""
    at = F.locate(" ", F.reverse(c))
    return F.when(at > 0, F.length(c) - at).otherwise(-1)


def _first_space(c: Column) -> Column:
    return F.locate(" ", c) - 1


def truncate_safe(c: Column, max_tokens: int = 512, strategy: str = "tail") -> Column:
    """Cut to the character budget at a word boundary within 10 %, with a marker."""
    n = char_budget(max_tokens)

    def start(k):
        t = F.substring(c, 1, k)
        sp = _last_space(t)
        return F.when(sp > F.lit(k * 0.9), F.substr(t, F.lit(1), sp)).otherwise(t)

    def end(k):
        t = F.substring(c, -k, k)
        sp = _first_space(t)
        return F.when((sp > 0) & (sp < F.lit(k * 0.1)), F.substr(t, sp + 2)).otherwise(t)

    cut = {
        "tail": lambda: F.concat(start(n), F.lit(" [TRUNCATED]")),
        "head": lambda: F.concat(F.lit("[TRUNCATED] "), end(n)),
        "middle": lambda: F.concat(start(n // 2), F.lit(" [...] "), end(n // 2)),
    }[strategy]()
    return F.when(F.length(c) <= n, c).otherwise(cut)


def tc_text(summary: Column, steps: Column) -> Column:
    s, t = _text(summary), _text(steps)
    return (F.when((s != "") & (t != ""), F.concat(F.lit("Summary: "), s, F.lit("\nSteps: "), t))
            .when(s != "", F.concat(F.lit("Summary: "), s)).when(t != "", F.concat(F.lit("Steps: "), t)).otherwise(NO_TC))


def commit_template(message: Column, diff: Column, diff_chars: int | None = None) -> Column:
    m, d = _text(message), _text(diff) if diff_chars is None else F.substring(_text(diff), 1, diff_chars)
    body = F.concat(F.lit("Diff:\n"), d)
    return (F.when((m != "") & (d != ""), F.concat(F.lit("Commit Message: "), m, F.lit("\n\n"), body))
            .when(m != "", F.concat(F.lit("Commit Message: "), m)).when(d != "", body).otherwise(NO_COMMIT))


def distinct_changes(commits: Column, crs: Column) -> Column:
    """Distinct commits plus prefixed change requests."""
    empty = F.array().cast("array<string>")
    marked = F.transform(F.coalesce(crs, empty), lambda c: F.concat(F.lit("CR_"), c))
    return F.array_distinct(F.concat(F.coalesce(commits, empty), marked))


def commit_count(commits: Column, crs: Column) -> Column:
    """Distinct commits and change requests, at least 1."""
    return F.greatest(F.size(distinct_changes(commits, crs)), F.lit(1))
