"""Scoring, selection and rendering of candidate hits.

Each query holds a capped list of hits here (at most max(10, k) per index), so the
per-query windows and lists are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.functions import vectors as vx
from opsloom.session import keep

#: Different query words that one automaton holds (on the driver and in every task).
RECALL_WORDS = 200_000
#: Different documents that were hit, up to which their keys are sent to every task that reads documents; beyond that both sides are exchanged.
HIT_KEYS = 200_000
#: Characters of a text in a row on its way to a scorer (a long text is several rows; a batch has a fixed number of them).
PIECE_CHARS = 256


# ---------------------------------------------------------------- scores
def snippet_phase(content: Column | str) -> Column:
    """Explicit ``phase:`` line, else the first matching keyword group, else unknown."""
    body = tx.text_or_empty(content)
    explicit = F.lower(tx.extract_or_null(body, r"(?im)^phase:\s*([a-z-]+)$"))
    by_words = tx.let(F.lower(body), lambda low: tx.first_group(low, rules.SNIPPET_PHASES, "unknown"))
    return F.coalesce(explicit, by_words)


def overlap_score(query: Column | str, *fields: Column | str) -> Column:
    """Share of the query's tokens found among the tokens of the fields."""
    hay = tx.word_tokens(F.concat_ws("\n", *[tx.text_or_empty(f) for f in fields]))
    return tx.let(
        tx.long_tokens(query),
        lambda q: F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, hay)) / F.size(q)),
    )


def overlap_of_tokens(query: Column | str, tokens: Column | str) -> Column:
    """``overlap_score`` against token sets made beforehand."""
    return tx.let(
        tx.long_tokens(query),
        lambda q: F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(tx.col(tokens), q)) / F.size(q)),
    )


def hit_docs(docs: DataFrame, hits: DataFrame, index: str = "index") -> DataFrame:
    """The documents that were hit.  Their keys go to the scan, so the texts of all others are neither exchanged nor sorted."""
    hit = keep(hits.select(index, "doc_id").distinct(), "hit-keys")
    return docs.join(F.broadcast(hit) if hit.count() <= HIT_KEYS else hit, [index, "doc_id"], "left_semi")


def hit_features(
    docs: DataFrame, hits: DataFrame, index: str = "index", phase: Column | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """What scoring needs of each document that was hit, computed once per document, and the columns named in ``also``.

    Hits repeat documents (long ones are hit by most queries), so tokens, phase and
    fingerprint are made before documents and hits meet, and contents stay behind.
    """
    hay = F.concat_ws("\n", *[tx.text_or_empty(c) for c in ("title", "machine", "content")])
    return hit_docs(docs, hits, index).select(
        index,
        "doc_id",
        "machine",
        F.array_distinct(tx.word_tokens(hay)).alias("tokens"),
        (snippet_phase("content") if phase is None else phase).alias("phase"),
        fingerprint(index, "machine", "title", "content").alias("fingerprint"),
        *also,
    )


def fingerprint(source: Column | str, machine: Column | str, title: Column | str, content: Column | str) -> Column:
    parts = [tx.text_or_empty(source), tx.text_or_empty(machine), tx.text_or_empty(title)]
    return F.sha1(F.concat_ws("|", *parts, tx.text_or_empty(content)))


def phase_bonus(
    phase: Column | str, tags: Column | str, breadcrumb: Column | str, weights: Sequence[tuple[str, str, float]] = rules.PHASE_BONUS
) -> Column:
    """Tag weights of the query's phase: whole in a tag, half in the breadcrumb, capped."""
    low_tags = F.transform(F.coalesce(tx.col(tags), F.array().cast("array<string>")), F.lower)
    crumb = F.lower(tx.text_or_empty(breadcrumb))
    total = F.lit(0.0)
    for name, tag, weight in weights:
        in_tag = F.when(F.exists(low_tags, _has(tag)), weight).otherwise(0.0)
        in_crumb = F.when(crumb.contains(tag), weight * 0.5).otherwise(0.0)
        total = total + F.when(tx.col(phase) == name, in_tag + in_crumb).otherwise(0.0)
    return F.least(total, F.lit(rules.PHASE_BONUS_CAP))


def _has(word: str) -> Callable[[Column], Column]:
    return lambda t: t.contains(word)


def source_bonus(query: Column | str, source: Column | str) -> Column:
    """Extra weight for privilege-escalation phrases and for single short tool names."""
    q, src = F.lower(tx.text_or_empty(query)), F.lower(tx.text_or_empty(source))
    privesc = (q.contains("find") & q.contains("suid")) | q.contains("setuid") | q.contains("sudo -l")
    bonus = F.lit(0.0)
    for name, weight in rules.PRIVESC_BONUS:
        bonus = bonus + F.when(privesc & (src == name), weight).otherwise(0.0)
    toks = tx.long_tokens(query)
    short = (F.size(toks) == 1) & (F.length(F.get(toks, F.lit(0))) <= rules.SHORT_TOOL_CHARS)
    return bonus + F.when(short & (src == rules.SHORT_TOOL_SOURCE), rules.SHORT_TOOL_BONUS).otherwise(0.0)


def cross_score(
    hits: DataFrame,
    scorer_factory: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]] | None = None,
    query: str = "query",
    content: str = "content",
    fallback: str = "lexical",
    out: str = "rerank_score",
    chars: int | None = None,
    whole: bool = True,
) -> DataFrame:
    """Model score of (query, content); the lexical score where there is none.

    ``chars``: how much of a text the model takes, if it has such a limit; the rows stay whole.  ``whole`` false leaves the content out of the result.
    A text goes to the model whole, but travels in pieces, so that a batch of long texts takes no more memory than one of short ones.
    """
    if scorer_factory is None:
        return hits.withColumn(out, F.col(fallback)).drop(*([] if whole else [content]))
    others = [c for c in hits.columns if c != content]
    cut = F.regexp_extract_all(F.col(content), F.lit(f"(?s)(.{{1,{PIECE_CHARS}}})"), F.lit(1))
    pieces = F.when(F.size(cut) > 0, cut).otherwise(F.array(F.col(content)))
    rows = hits.select(*others, F.posexplode(pieces).alias("_n", "_piece"))
    # What else a hit has goes with its first piece.
    rows = rows.select(*[F.when(F.col("_n") == 0, F.col(c)).alias(c) for c in others], "_n", "_piece")
    kept = [*others, content] if whole else others
    kinds = [T.StructField(c, hits.schema[c].dataType) for c in kept]
    scored = rows.mapInArrow(_scored(scorer_factory, others, query, content if whole else None, chars), T.StructType([*kinds, T.StructField("_score", T.DoubleType())]))
    return scored.withColumn(out, F.coalesce("_score", fallback)).drop("_score").select(*[c for c in hits.columns if c in kept and c != out], out)


def _scored(factory: Callable, others: Sequence[str], query: str, content: str | None, chars: int | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, held = None, None

        def scores(queries: list, texts: list) -> list:
            nonlocal scorer
            try:
                scorer = scorer or factory()
                return [float(v) for v in scorer(queries, texts)]
            except Exception:
                return [None] * len(texts)

        def done(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            """The hits of rows that hold all of their pieces."""
            pieces = rows["_piece"].to_pylist()
            ends = [*first[1:].tolist(), len(pieces)]
            texts = [pieces[a] if b == a + 1 else "".join(pieces[a:b]) for a, b in zip(first.tolist(), ends)]
            heads = rows.take(pa.array(first))
            got = scores(heads[query].to_pylist(), texts if chars is None else [t and t[:chars] for t in texts])
            tail = {} if content is None else {content: pa.array(texts, pa.string())}
            columns = {c: heads[c] for c in others} | tail | {"_score": pa.array(got, pa.float64())}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            first = np.flatnonzero(rows["_n"].to_numpy() == 0)
            if len(first) > 1:
                yield done(rows.slice(0, first[-1]), first[:-1])
            held = rows.slice(first[-1])
        if held is not None:
            yield done(held, np.array([0]))

    return of


def recent_fingerprints(
    shown: DataFrame, now: Column | None = None, turns: int = rules.SHOWN_TURNS, ttl: int = rules.SHOWN_TTL_SECONDS, source_like: str | None = None
) -> DataFrame:
    """Distinct (machine, fingerprint) of the last turns of each machine that are not expired.

    ``shown``: machine, turn, shown_at (timestamp), source, fingerprint.  The newest turn
    refreshes the age of the whole list, as the list has one expiry.  The latest turns come
    from a grouped maximum list of (machine, turn) pairs, not from a window over all rows.
    """
    per_turn = shown.groupBy("machine", "turn").agg(F.max("shown_at").alias("_at"))
    w = Window.partitionBy("machine").orderBy(F.desc("turn"))
    last = per_turn.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= turns)
    if now is not None:
        newest = last.groupBy("machine").agg(F.max("_at").alias("_newest"))
        alive = newest.filter(F.col("_newest") > now - F.make_dt_interval(secs=F.lit(ttl)))
        last = last.join(alive, "machine", "left_semi")
    rows = shown.join(last, ["machine", "turn"], "left_semi")
    if source_like is not None:
        rows = rows.filter(F.lower("source").contains(source_like))
    return rows.select("machine", "fingerprint").distinct()


def with_shown_flag(hits: DataFrame, recent: DataFrame, machine: str = "target") -> DataFrame:
    """Flag hits whose fingerprint was shown recently to the query's machine."""
    seen = recent.select(F.col("machine").alias(machine), "fingerprint").withColumn("recently_shown", F.lit(True))
    return hits.join(seen, [machine, "fingerprint"], "left").withColumn(
        "recently_shown", F.coalesce("recently_shown", F.lit(False))
    )


def rerank(
    hits: DataFrame,
    *,
    query: str = "query",
    source: str = "index",
    phase_bucket: str = "phase_bucket",
    rerank_score: str = "rerank_score",
    bonus: Column | None = None,
    shown: str | None = None,
    position: str = "position",
) -> DataFrame:
    """Final score and rank; recon hits give way in later phases unless there is nothing else.

    Needs query_id, distance, phase and an input ``position`` for ties.
    """
    late = F.col(phase_bucket).isin("user", "root")
    w = Window.partitionBy("query_id")
    has_other = F.max(F.col("phase") != "recon").over(w)
    match = (F.col(phase_bucket) != "unknown") & (F.col("phase") == F.col(phase_bucket))
    score = (
        rules.RERANK_WEIGHT * F.col(rerank_score)
        + rules.SIMILARITY_WEIGHT * vx.similarity("distance")
        + F.when(match, rules.PHASE_WEIGHT).otherwise(0.0)
        + (bonus if bonus is not None else F.lit(0.0))
        + source_bonus(query, source)
    )
    if shown is not None:
        score = score - F.when(F.col(shown), rules.SHOWN_PENALTY).otherwise(0.0)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("final_score"), position)
    return (
        hits.withColumn("_other", has_other)
        .filter(~late | ~F.col("_other") | (F.col("phase") != "recon"))
        .withColumn("final_score", F.round(score, 6))
        .withColumn("rank", F.row_number().over(ranked))
        .drop("_other")
    )


# ---------------------------------------------------------------- selection
def diverse_topk(hits: DataFrame, k: int, source: str = "index", rank: str = "rank") -> DataFrame:
    """Best hit of each source first, then the others by rank, ``k`` per query."""
    per_source = Window.partitionBy("query_id", source).orderBy(rank)
    order = Window.partitionBy("query_id").orderBy("_later", rank)
    return (
        hits.withColumn("_later", F.row_number().over(per_source) > 1)
        .withColumn("slot", F.row_number().over(order))
        .filter(F.col("slot") <= k)
        .drop("_later")
    )


def similarity_stats(hits: DataFrame, top_n: int = 3, threshold: float = rules.CONFIDENT_SIMILARITY) -> DataFrame:
    """Per query: best similarity, the top-n list and whether any is confident."""
    sim = F.round(vx.similarity("distance"), 6)
    return hits.groupBy("query_id").agg(
        F.max(sim).alias("best_similarity"),
        F.slice(F.sort_array(F.collect_list(sim), asc=False), 1, top_n).alias("top_similarity"),
        F.bool_or(vx.similarity("distance") >= threshold).alias("confident"),
    )


def token_cost(title: Column | str, url: Column | str, content: Column | str) -> Column:
    size = F.length(tx.text_or_empty(title)) + F.length(tx.text_or_empty(url)) + F.length(tx.text_or_empty(content)) + 2
    return F.greatest(F.lit(1), F.floor(size / 4)).cast("int")


def with_priority(
    hits: DataFrame, *, target: str = "target", machine: str = "machine", title: str = "title", url: str = "url", content: str = "content"
) -> DataFrame:
    """Token cost and priority: target-specific rows up, generic method rows down."""
    want = F.lower(tx.strip(tx.text_or_empty(target)))
    own = F.lower(tx.strip(tx.text_or_empty(machine)))
    hay = F.concat_ws(" ", own, F.lower(tx.text_or_empty(title)), F.lower(tx.text_or_empty(content)))
    def judge(text: Column) -> Column:
        specific = (want != "") & ((own == want) | text.contains(want))
        generic = tx.any_contains(text, rules.GENERIC_HINTS)
        return (F.when(specific, 2).otherwise(0) - F.when(generic, 1).otherwise(0)).cast("int")

    return hits.withColumns({"token_cost": token_cost(title, url, content), "priority": tx.let(hay, judge)})


def budget_trim(hits: DataFrame, budget: int = rules.TOKEN_BUDGET, rank: str = "rank") -> DataFrame:
    """Greedy selection in priority order within a token budget.

    A row that would overflow is skipped, unless nothing is kept yet; the walk ends when
    the budget is used up.  Whether a row fits depends on what was kept before, so the
    ids of one query's capped list are folded as an array.  Needs token_cost and priority.
    """
    if budget <= 0:
        return hits
    order = F.struct(
        (-F.col("priority")).alias("a"), F.col("distance").alias("b"), F.col("token_cost").alias("c"),
        F.col(rank).alias("d"),
    )
    walk = F.array_sort(F.collect_list(order))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] < budget) & ((s["used"] + x["c"] <= budget) | (F.size(s["kept"]) == 0))
        return F.struct(
            F.when(fits, s["used"] + x["c"]).otherwise(s["used"]).alias("used"),
            F.when(fits, F.concat(s["kept"], F.array(x["d"].cast("int")))).otherwise(s["kept"]).alias("kept"),
        )

    kept = hits.groupBy("query_id").agg(F.aggregate(walk, start, step, lambda s: s["kept"]).alias("_kept"))
    picks = kept.select("query_id", F.posexplode("_kept").alias("_p", rank)).select(
        "query_id", rank, (F.col("_p") + 1).alias("kept_no")
    )
    return hits.join(picks, ["query_id", rank])


def normalise_web(web: DataFrame, n: int = rules.WEB_MAX_RESULTS, chars: int = rules.WEB_SNIPPET_CHARS) -> DataFrame:
    """First n results per query, those without address dropped, texts cut.

    ``web``: query_id, web_rank, title, url, content, snippet.
    """
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("snippet"), F.lit(""))
    w = Window.partitionBy("query_id").orderBy("web_rank")
    return (
        web.withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= n)
        .select(
            "query_id", "web_rank", tx.strip(tx.text_or_empty("title")).alias("title"),
            tx.strip(tx.text_or_empty("url")).alias("url"), F.left(tx.strip(body), F.lit(chars)).alias("snippet"),
        )
        .filter(F.col("url") != "")
    )


def tiered_fallback(
    queries: DataFrame,
    hits: DataFrame,
    web: DataFrame,
    threshold: float = rules.CONFIDENT_SIMILARITY,
    force: bool = False,
    allow: Column | bool = True,
) -> DataFrame:
    """Local hits, plus web rows for queries whose best similarity is below the threshold.

    Returns query_id, tier (local or web), position, ref (doc id or address), used_web.
    ``web`` must be normalised.
    """
    best = hits.groupBy("query_id").agg((1.0 - F.min("distance")).alias("_best"))
    allowed = F.lit(allow) if isinstance(allow, bool) else allow
    asked = (
        queries.withColumn("_allow", allowed)
        .select("query_id", "_allow")
        .join(best, "query_id", "left")
        .filter(F.col("_allow") & (F.lit(force) | (F.coalesce("_best", F.lit(0.0)) < threshold)))
    )
    used = web.join(asked.select("query_id"), "query_id", "left_semi")
    flags = used.select("query_id").distinct().withColumn("used_web", F.lit(True))
    local = hits.select("query_id", F.lit("local").alias("tier"), F.col("rank").cast("int").alias("position"), F.col("doc_id").cast("string").alias("ref"))
    live = used.select("query_id", F.lit("web").alias("tier"), F.col("web_rank").cast("int").alias("position"), F.col("url").alias("ref"))
    return (
        local.unionByName(live)
        .join(flags, "query_id", "left")
        .withColumn("used_web", F.coalesce("used_web", F.lit(False)))
    )


# ---------------------------------------------------------------- rendering
def snippet_summary(content: Column | str) -> Column:
    """Up to five bullets from ``key: value`` lines in fixed key order, else a note."""
    body = tx.text_or_empty(content)

    def build(rows: Column) -> Column:
        pairs = F.filter(
            F.transform(
                F.filter(rows, lambda r: r.contains(":")),
                lambda r: F.struct(
                    F.lower(tx.strip(F.substring_index(r, ":", 1))).alias("k"),
                    tx.strip(F.substring(r, F.locate(":", r) + 1, F.length(r))).alias("v"),
                ),
            ),
            lambda p: (p["k"] != "") & (p["v"] != ""),
        )
        free = F.filter(rows, lambda r: ~r.contains(":"))

        def render(p: Column) -> Column:
            def value(key: str) -> Column:
                return F.try_element_at(F.filter(p, lambda e: e["k"] == key), F.lit(-1))["v"]

            main = F.slice(
                F.array_compact(
                    F.array(*[F.concat(F.lit(f"- {k.replace('_', ' ')}: "), value(k)) for k in rules.SUMMARY_KEYS])
                ),
                1, 4,
            )
            with_machine = F.array_compact(F.concat(main, F.array(F.concat(F.lit("- machine: "), value("machine")))))
            note = F.concat(F.lit("- note: "), F.left(F.get(free, F.lit(0)), F.lit(140)))
            last = F.coalesce(F.concat(F.lit("- url: "), value("url")), note)
            full = F.when(
                F.size(with_machine) < 5, F.array_compact(F.concat(with_machine, F.array(last)))
            ).otherwise(with_machine)
            clipped = F.concat(F.lit("- note: "), F.left(tx.squeeze(body), F.lit(220)))
            return F.array_join(F.when(F.size(full) > 0, full).otherwise(F.array(clipped)), " ")

        return tx.let(pairs, render)

    return tx.let(tx.full_lines(body), build)


def ordered_text(rows: Column, order: Column | str, sep: str = "\n") -> Column:
    """Aggregate: texts joined in order (for bounded groups)."""
    pairs = F.array_sort(F.collect_list(F.struct(tx.col(order).alias("o"), rows.alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)


def reference_block(queries: DataFrame, hits: DataFrame, order: str = "rank") -> DataFrame:
    """One text block per query; ``none`` for queries without hits."""
    row = F.concat(
        F.lit("- ["), "index", F.lit("] "), tx.text_or_empty("machine"), F.lit(" | "), tx.text_or_empty("title"),
        F.lit(" | "), tx.text_or_empty("url"), F.lit("\n  "), snippet_summary("content"),
    )
    blocks = hits.groupBy("query_id").agg(F.concat(F.lit("Reference Material:\n"), ordered_text(row, order)).alias("reference_block"))
    return queries.select("query_id").join(blocks, "query_id", "left").withColumn(
        "reference_block", F.coalesce("reference_block", F.lit("Reference Material: none"))
    )


def web_block(web: DataFrame) -> DataFrame:
    row = F.concat(
        F.lit("\n["), F.col("_n").cast("string"), F.lit("] "), "title", F.lit("\n    URL: "), "url",
        F.when(F.col("snippet") != "", F.concat(F.lit("\n    "), "snippet")).otherwise(""),
    )
    w = Window.partitionBy("query_id").orderBy("web_rank")
    head = F.lit("Live Web Results (cite these URLs if you use this information):\n")
    return web.withColumn("_n", F.row_number().over(w)).groupBy("query_id").agg(
        F.concat(head, ordered_text(row, "_n")).alias("web_block")
    )


def methodology_block(hits: DataFrame, name: str = "HackTricks", order: str = "rank") -> DataFrame:
    """Citation block per query: numbered hits with their location, address and content."""
    def opt(label: str, c: str) -> Column:
        return F.when(tx.text_or_empty(c) != "", F.concat(F.lit(f"\n{label}: "), c)).otherwise("")

    w = Window.partitionBy("query_id").orderBy(order)
    row = F.concat(
        F.lit(f"\n[{name} #"), F.col("_n").cast("string"), F.lit("] "), tx.text_or_empty("title"), opt("Location", "breadcrumb"),
        opt("Reference", "url"), F.lit("\n\nContent:\n"), tx.text_or_empty("content"), F.lit("\n"),
    )
    head, tail = F.lit(f"\n--- {name} Methodology Reference ---\n"), F.lit(f"\n--- End {name} Reference ---\n")
    return hits.withColumn("_n", F.row_number().over(w)).groupBy("query_id").agg(
        F.concat(head, ordered_text(row, "_n"), tail).alias("methodology_block")
    )


def search_results(
    queries: DataFrame, hits: DataFrame, web: DataFrame, preambles: tuple[str, str] = ("", ""), order: str = "rank"
) -> DataFrame:
    """One row per query: reference block, whether the web was used, hits and web rows as arrays, top similarities.

    ``web``: normalised rows of the queries that may use them (see ``tiered_fallback``).
    ``preambles``: put before web results when there are no, or some, local hits.
    """
    none, some = preambles
    cite = "Cite the URLs below if you use any of this information.\n\n"
    local = reference_block(queries, hits, order).withColumnRenamed("reference_block", "_local")
    hit_list = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("rank"), "index", "doc_id", "distance"))).alias("hits")
    )
    web_list = web.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("web_rank", "title", "url", "snippet"))).alias("web_results"))
    joined = (
        local.join(hit_list, "query_id", "left")
        .join(similarity_stats(hits).select("query_id", "top_similarity"), "query_id", "left")
        .join(web_list, "query_id", "left")
        .join(web_block(web), "query_id", "left")
    )
    live = F.concat(F.when(F.col("hits").isNull(), none).otherwise(some), F.lit(cite), "web_block")
    block = (
        F.when(F.col("web_block").isNull(), F.col("_local"))
        .when(F.col("hits").isNull(), live)
        .otherwise(F.concat("_local", F.lit("\n\n"), live))
    )
    return joined.select(
        "query_id", block.alias("reference_block"), F.col("web_block").isNotNull().alias("used_web"), "hits", "web_results", "top_similarity"
    )


def solution_block(hits: DataFrame, machine: str = "target", order: str = "rank") -> DataFrame:
    """Guided material per query: title, address and content of each hit."""
    head = F.concat(F.lit("# "), F.first(machine), F.lit(" - Guided Solution Material\n\n"))
    row = F.concat(
        F.lit("## "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")), F.lit(" ("), "index", F.lit(")\n"),
        F.when(tx.text_or_empty("url") != "", F.concat("url", F.lit("\n"))).otherwise(""), F.lit("\n"), "content", F.lit("\n"),
    )
    return hits.groupBy("query_id").agg(F.concat(head, ordered_text(row, order)).alias("solution_block"))


def hits_by_source(hits: DataFrame, order: str = "rank", max_lines: int | None = None) -> DataFrame:
    """Per (query, source): numbered items with their content lines (all, or the first ``max_lines``)."""
    source = F.coalesce(F.nullif(F.col("index"), F.lit("")), F.lit("unknown"))

    def dash(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))

    body = tx.lines(tx.text_or_empty("content"))
    shown = body if max_lines is None else F.slice(body, 1, max_lines)
    item = F.concat(
        F.lit("] title: "), dash("title"), F.lit("\n    machine: "), dash("machine"), F.lit("\n    url: "), dash("url"),
        F.lit("\n    score: "), F.format_string("%.4f", "distance"), F.lit("\n    content:"),
        F.array_join(F.transform(shown, lambda x: F.concat(F.lit("\n      "), x)), ""),
    )
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("t"))))
    body = F.array_join(F.transform(pairs, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), p["t"])), "\n\n")
    return (
        hits.groupBy("query_id", source.alias("source"))
        .agg(F.count(F.lit(1)).alias("n_hits"), body.alias("_b"))
        .select("query_id", "source", "n_hits", F.concat(F.lit("### SOURCE: "), F.upper("source"), F.lit("\n"), "_b").alias("block"))
    )


def hits_by_title(hits: DataFrame) -> DataFrame:
    """Per (query, title): size and source mix, largest first."""
    title = F.coalesce(F.nullif(tx.strip(tx.text_or_empty("title")), F.lit("")), F.lit("untitled"))
    src = F.lower(tx.strip(F.coalesce("index", F.lit("?"))))
    per_source = hits.groupBy("query_id", F.lower(title).alias("group_key"), src.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    mix = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_s").alias("s"))))
    grouped = per_source.groupBy("query_id", "group_key").agg(
        F.sum("_n").alias("n_hits"),
        F.array_join(F.transform(mix, lambda m: F.concat(m["s"], F.lit(":"), (-m["n"]).cast("string"))), ", ").alias("source_mix"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("n_hits"), "group_key")
    return grouped.withColumn("group_no", F.row_number().over(w))


# ---------------------------------------------------------------- recall and advisories
def recall_overlap(queries: DataFrame, learnings: DataFrame, limit: int = rules.RECALL_LIMIT, block_words: int = RECALL_WORDS) -> DataFrame:
    """Learnings that contain query words (longer than three characters), best first.

    ``queries``: query_id, text, exclude_machine; ``learnings``: learning_id, machine,
    explanation.  "Contains" is on characters, not words: the different words of all queries make an automaton that reads each text
    once, whatever the number of words, and says which it holds.  More than ``block_words`` different words make several automata, one pass over the
    texts each.  Scores are counted from (text, word) and (word, query); texts stay where they are.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(tx.text_or_empty("text")), r"(?U)\s+"), lambda w: F.length(w) > 3))
    terms = queries.select("query_id", F.coalesce("exclude_machine", F.lit("")).alias("_not"), F.explode(words).alias("_w"))
    asked = keep(terms.select("_w").distinct(), "recall-words")
    blocks = max(1, -(-asked.count() // block_words))
    spread = learnings.select("learning_id", "machine", F.lower(tx.text_or_empty("explanation")).alias("_low"))
    own = spread.schema
    spec = f"learning_id {own['learning_id'].dataType.simpleString()}, machine {own['machine'].dataType.simpleString()}, _w string"
    held = None
    for block in range(blocks):  # about block_words words each, by hash
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("_w"), F.lit(blocks)) == block)
        found = spread.mapInArrow(_holds([r["_w"] for r in part.collect()]), spec)
        held = found if held is None else held.unionByName(found)
    scored = (
        held.join(terms, "_w")
        .filter((F.col("_not") == "") | (F.coalesce("machine", F.lit("")) != F.col("_not")))
        .groupBy("learning_id", "query_id")
        .agg(F.count(F.lit(1)).alias("score"))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "learning_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def _holds(words: list[str]):
    """(learning_id, machine, _w) for each word that a text holds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, word in enumerate(words):
            machine.add_word(word, k)
        machine.make_automaton()
        own = pa.array(words, pa.string())
        for b in batches:
            if not words:
                continue
            rows, found = [], []
            for i, text in enumerate(b["_low"].to_pylist()):
                seen = {k for _, k in machine.iter(text)}
                rows += [i] * len(seen)
                found += sorted(seen)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b["learning_id"].take(take), b["machine"].take(take), own.take(pa.array(found, pa.int64()))], names=["learning_id", "machine", "_w"])

    return of


def cve_ids(c: Column | str) -> Column:
    found = F.regexp_extract_all(tx.text_or_empty(c), F.lit(rules.CVE_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def cve_enrich(texts: DataFrame, advisories: DataFrame, key: str = "run_id", text: str = "text", chars: int | None = None) -> DataFrame:
    """Ids named in each text with the advisory description (whole, or its first ``chars`` characters)."""
    named = texts.select(key, F.explode(cve_ids(text)).alias("cve_id"))
    told = tx.text_or_empty("description")
    known = advisories.select(F.upper("cve_id").alias("cve_id"), (told if chars is None else F.left(told, F.lit(chars))).alias("description"))
    return named.join(known, "cve_id", "left").select(
        key, "cve_id", "description", F.concat_ws(": ", "cve_id", "description").alias("finding")
    )
