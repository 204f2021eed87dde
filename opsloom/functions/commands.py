"""Column rules over one command or one output line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import text as tx

QUOTES = "\"'"


def command_hash(c: Column | str) -> Column:
    """SHA-256 of the command with whitespace normalised."""
    return F.sha2(tx.squeeze(tx.text_or_empty(c)), 256)


def is_code_line(c: Column | str) -> Column:
    return tx.let(tx.strip(tx.text_or_empty(c)), lambda t: tx.any_prefix(t, rules.CODE_PREFIXES) | t.isin(*rules.HEREDOC_ENDS))


def tool_word(c: Column | str) -> Column:
    """First word with shell quotes removed, looking through sudo and doas, lower case."""
    words = F.regexp_extract_all(tx.text_or_empty(c), F.lit(r"((?:\"[^\"]*\"|'[^']*'|[^\s\"'])+)"), F.lit(1))
    bare = F.transform(words, lambda w: F.regexp_replace(w, "[\"']", ""))
    return tx.let(
        bare,
        lambda w: F.lower(
            F.when(F.size(w) == 0, "")
            .when(F.lower(F.get(w, F.lit(0))).isin("sudo", "doas") & (F.size(w) > 1), F.get(w, F.lit(1)))
            .otherwise(F.get(w, F.lit(0)))
        ),
    )


def is_technical(
    c: Column | str, tools: Sequence[str] = rules.TOOLS, prefixes: Sequence[str] = rules.TOOL_PREFIXES
) -> Column:
    return ~is_code_line(c) & tx.let(tool_word(c), lambda w: w.isin(*tools) | tx.any_prefix(w, prefixes))


def feedback_signal(c: Column | str) -> Column:
    """failure, success or null; failure markers win."""
    raw = tx.text_or_empty(c)

    def judge(low: Column) -> Column:
        return (
            F.when(tx.any_contains(low, rules.PROSE_MARKS), F.lit(None).cast("string"))
            .when(tx.any_contains(low, rules.FAILURE_MARKS), "failure")
            .when(tx.any_contains(low, rules.SUCCESS_MARKS), "success")
        )

    # Length and code lines are checked on the text as written; the words on its lower-case form.
    return F.when((F.length(raw) <= rules.SIGNAL_MAX_CHARS) & ~is_code_line(raw), tx.let(F.lower(raw), judge))


def cd_argument(c: Column | str) -> Column:
    """Argument of ``cd`` without quotes, else null."""
    bare = tx.strip(tx.text_or_empty(c))
    arg = F.btrim(tx.strip(F.substring(bare, 4, 1 << 30)), F.lit(QUOTES))
    return F.when(F.lower(bare).startswith("cd "), arg)


def cd_target(c: Column | str) -> Column:
    """Machine-like last component of a relative ``cd``."""

    def name(arg: Column) -> Column:
        inner = F.when(arg.startswith("~/"), F.substring(arg, 3, 1 << 30)).otherwise(arg)
        last = F.regexp_extract(inner, r"([^/\\]*)$", 1)
        ok = arg.isNotNull() & ~arg.isin(*rules.CD_SKIP) & ~arg.startswith("/") & last.rlike(rules.NAME_PATTERN)
        return F.when(ok, F.lower(last))

    return tx.let(cd_argument(c), name)


def host_target(c: Column | str) -> Column:
    names = F.transform(F.regexp_extract_all(tx.text_or_empty(c), F.lit(rules.HOST_PATTERN), F.lit(1)), F.lower)
    return F.get(F.filter(names, lambda n: ~n.isin(*rules.HOST_ALIASES)), F.lit(0))


def needs_json_hint(c: Column | str) -> Column:
    def judge(low: Column) -> Column:
        capable = F.lit(False)
        for tool in rules.JSON_TOOLS:
            capable = capable | low.startswith(tool) | low.contains(f" {tool} ")
        return ~tx.any_contains(low, rules.JSON_FLAGS) & capable

    return tx.let(F.lower(tx.text_or_empty(c)), judge)


def command_phase(c: Column | str, table: Sequence[tuple[str, Sequence[str]]] = rules.PHASE_RULES) -> Column:
    """Phase of one command, or null when no rule matches."""
    cases = [(phase, patterns) for phase, patterns in table]

    def judge(cmd: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for phase, patterns in cases:
            out = out.when(tx.any_match(cmd, patterns), phase)
        return out

    return tx.let(tx.text_or_empty(c), judge)


def phase_bucket(phase: Column | str) -> Column:
    out = F.lit("unknown")
    for name, bucket in rules.PHASE_BUCKETS:
        out = F.when(tx.col(phase) == name, bucket).otherwise(out)
    return out


def is_exploit(c: Column | str) -> Column:
    return tx.let(tx.text_or_empty(c), lambda t: tx.any_match(t, rules.EXPLOIT_PATTERNS))


def is_recon(c: Column | str) -> Column:
    return tx.let(tx.text_or_empty(c), lambda t: tx.any_match(t, rules.RECON_PATTERNS))


def similar_key(c: Column | str) -> Column:
    """Commands with equal keys are the same up to their numbers."""
    return F.regexp_replace(F.lower(tx.squeeze(tx.text_or_empty(c))), r"\d+", "NUM")


def tool_suggestion(c: Column | str, table: Sequence[tuple[str, str]] = rules.TOOL_SUGGESTIONS) -> Column:
    """Tip of the first tool in list order that occurs in the command."""
    def judge(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for tool, text in table:
            out = out.when(low.contains(tool), rules.TIP_MARK + text)
        return out

    return tx.let(F.lower(tx.text_or_empty(c)), judge)


def stuck_status(blob: Column) -> Column:
    both, only_injection, only_path, other = rules.STUCK_TEXTS

    def judge(low: Column) -> Column:
        injection = low.contains("command injection")
        path = low.contains("/ip") | low.contains("ip parameter")
        return (
            F.when(injection & (path | low.contains(" ip ")), both)
            .when(injection, only_injection)
            .when(path, only_path)
            .otherwise(other)
        )

    return tx.let(F.lower(blob), judge)


def is_similar_input(current: Column, previous: Column) -> Column:
    """Equal after normalising, or token Jaccard of at least 0.60; false when either is empty."""

    def norm(c: Column) -> Column:
        return tx.strip(F.regexp_replace(F.lower(tx.strip(tx.text_or_empty(c))), "[^a-z0-9]+", " "))

    def judge(n: Column) -> Column:
        a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
        share = F.size(F.array_intersect(ta, tb)) / F.greatest(F.lit(1), F.size(F.array_union(ta, tb)))
        return (a == b) | ((a != "") & (b != "") & (share >= rules.SIMILAR_INPUT_SHARE))

    given = (tx.text_or_empty(current) != "") & (tx.text_or_empty(previous) != "")
    return F.when(given, tx.let(F.array(norm(current), norm(previous)), judge)).otherwise(False)
