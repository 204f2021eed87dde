"""String column expressions with Python's notion of whitespace and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``.

    A projection would be collapsed into the lambda and evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(rules.WHITESPACE))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(rules.WHITESPACE))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(rules.WHITESPACE))


def squeeze(c: Column | str) -> Column:
    """Runs of whitespace become one blank; the ends are stripped."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def lines(c: Column | str) -> Column:
    return F.split(col(c), rules.LINE_BREAK)


def full_lines(c: Column | str) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def any_contains(c: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | c.contains(needle)
    return out


def any_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | c.startswith(prefix)
    return out


def any_match(c: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | c.rlike(pattern)
    return out


def first_group(c: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first keyword group of which some word occurs in ``c``."""
    out: Column | None = None
    for name, words in groups:
        hit = any_contains(c, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def extract_or_null(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def word_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([a-z0-9_/-]+)"), F.lit(1))


def long_tokens(c: Column | str) -> Column:
    """Distinct tokens of two characters and more, as scored for overlap."""
    return F.array_distinct(F.filter(word_tokens(c), lambda t: F.length(t) >= 2))


def query_terms(c: Column | str, limit: int = rules.MAX_QUERY_TERMS) -> Column:
    """Search terms: split on separators, plus the compact form, in order, distinct."""

    def variants(tok: Column) -> Column:
        compact = F.regexp_replace(tok, "[-_/]+", "")
        parts = F.split(tok, "[-_/]+")
        return F.concat(parts, F.when(compact != tok, F.array(compact)).otherwise(F.array().cast("array<string>")))

    expanded = F.flatten(F.transform(F.filter(word_tokens(c), lambda t: F.length(t) >= 2), variants))
    return F.slice(F.array_distinct(F.filter(expanded, lambda t: F.length(t) >= 2)), 1, limit)


def index_tokens(c: Column | str) -> Column:
    """Distinct alphanumeric tokens of an indexed text."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda t: F.length(t) >= 2)


def canonical_machine(c: Column | str) -> Column:
    lowered = F.lower(strip(text_or_empty(c)))
    bare = F.when(
        lowered.startswith(rules.MACHINE_PREFIX), F.substring(lowered, len(rules.MACHINE_PREFIX) + 1, 1 << 30)
    ).otherwise(lowered)
    return strip(F.regexp_replace(bare, "[^a-z0-9-]+", " "))


def content_key(*fields: Column, chars: int = 24) -> Column:
    """Leading hex digits of SHA-256 over the fields joined by ``|``."""
    return F.left(F.sha2(F.concat_ws("|", *[text_or_empty(f) for f in fields]), 256), F.lit(chars))


def first_word(c: Column | str) -> Column:
    """First word of a command, looking through sudo and doas."""
    words = F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")
    return let(
        words,
        lambda w: F.lower(
            F.when(F.size(w) == 0, "")
            .when(F.get(w, F.lit(0)).isin("sudo", "doas") & (F.size(w) > 1), F.get(w, F.lit(1)))
            .otherwise(F.get(w, F.lit(0)))
        ),
    )


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), "")
