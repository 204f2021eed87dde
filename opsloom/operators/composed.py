"""Retrieval from query text to the selected hits, put together from the steps of ``retrieval``, ``knn`` and ``ranking``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.functions import vectors as vx
from opsloom.operators import knn as nn
from opsloom.operators import ranking as ra
from opsloom.operators import retrieval as re_
from opsloom.session import keep


def retrieve(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    *,
    shown: DataFrame | None = None,
    now: Column | None = None,
    index_order: Sequence[str] = (),
    candidates: int = rules.RERANK_CANDIDATES,
    embed: Callable[[str], Column] = vx.hash_embedding,
    scorer_factory=None,
) -> DataFrame:
    """The ``k`` selected hits of each query: query_id, slot, index, doc_id, origin, distance, final_score, target (its canonical form), fingerprint.

    ``queries``: query_id, text, target, history (commands), phase_bucket; ``docs``: doc_id, index, machine, title, url, content, tags, breadcrumb;
    ``shown``: the list that ``shown_rows`` writes.

    1. Queries with a target take documents of that machine.
    2. The others are searched by their expanded text, in words and by vector (with the target as predicate), and the lists are merged per index.
    3. All hits are scored on the plain query text, with phase, metadata and intent bonus and the penalty for what was shown lately, and the best are
       chosen with each source first.

    Contents meet hits only in their own scan (features of documents that were hit); no text is exchanged for scoring but that of hits for a scoring model.
    """
    limit = max(candidates, k)
    asked = keep(re_.expand_queries(queries, machine="target").withColumn("target", tx.canonical_machine("target")), "retrieve-queries")
    first = re_.target_hits(asked.select("query_id", F.col("target").alias("machine")), docs, k).withColumn("origin", F.lit("target"))
    first = keep(first, "retrieve-target")
    rest = asked.join(first.select("query_id").distinct(), "query_id", "left_anti")
    # A target that no document has leaves nothing for a search within it; its vector search is bounded by the predicate as well.
    free = rest.filter(F.col("target") == "").select("query_id", F.col("expanded").alias("text"))
    lexical = re_.lexical_hits(free, docs, limit)
    vectors = docs.select("doc_id", "index", tx.canonical_machine("machine").alias("machine"), embed("content").alias("embedding"))
    points = rest.select("query_id", F.nullif("target", F.lit("")).alias("only"), embed("expanded").alias("embedding"))
    vector = nn.knn(points, vectors, limit, machine="machine", only="only")
    merged = re_.hybrid_merge(lexical, vector, docs, limit)
    columns = ("query_id", "index", "doc_id", "distance", "rank", "origin")
    hits = keep(re_.federated(first.select(*columns).unionByName(merged.select(*columns)), k, candidates=limit, index_order=index_order), "retrieve-hits")
    scored = hits.join(ra.hit_features(docs, hits, also=["tags", "breadcrumb"]), ["index", "doc_id"]).join(asked.select("query_id", F.col("text").alias("query"), "target", "phase_bucket"), "query_id")
    scored = scored.withColumn("lexical", ra.overlap_of_tokens("query", "tokens"))
    if scorer_factory is not None:
        scored = ra.cross_score(scored.join(ra.hit_docs(docs, hits).select("index", "doc_id", "content"), ["index", "doc_id"]), scorer_factory, whole=False)
    else:
        scored = ra.cross_score(scored)
    flagged = scored.withColumn("recently_shown", F.lit(False)) if shown is None else ra.with_shown_flag(scored, ra.recent_fingerprints(shown, now))
    bonus = ra.phase_bonus("phase_bucket", "tags", "breadcrumb")
    top = ra.diverse_topk(ra.rerank(flagged.drop("rank", "tokens"), shown="recently_shown", bonus=bonus), k)
    return top.select("query_id", "slot", "index", "doc_id", "origin", "distance", "final_score", "target", "fingerprint")


def shown_rows(selected: DataFrame, at: Column, shown: DataFrame | None = None) -> DataFrame:
    """What a retrieval showed, as the next turn of each machine: machine, turn, shown_at, source, fingerprint.  To be appended to the list of shown hits."""
    new = selected.filter(F.col("target") != "").select(F.col("target").alias("machine"), at.alias("shown_at"), F.col("index").alias("source"), "fingerprint").distinct()
    if shown is None:
        return new.withColumn("turn", F.lit(1).cast("long"))
    last = shown.groupBy("machine").agg(F.max("turn").alias("_last"))
    return new.join(last, "machine", "left").withColumn("turn", (F.coalesce("_last", F.lit(0)) + 1).cast("long")).drop("_last")


def append_shown(selected: DataFrame, path: str, at: Column, shown: DataFrame | None = None) -> None:
    """Append a retrieval's turn to the list; older turns need no removal, readers take the last ones."""
    shown_rows(selected, at, shown).write.mode("append").parquet(path)
