"""Candidate retrieval for query tables: lexical, target, federated and merged hits.

A hit row carries query_id, index, doc_id, distance and a rank in its list.  Per-query
windows only ever see the capped candidates of that query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.session import keep

#: Documents of a block of the index (an eighth as many bytes per word of it), and blocks looked at first per query and index.
BLOCK_DOCS, FIRST_LOOK = 2048, 4
#: Different query terms that a task holds at a time; more are looked up in turns.
TERMS_AT_ONCE = 200_000
#: Words of a document in a row while blocks are made (a long document is several rows; a batch has a fixed number of them), words of a block, with
#: which it ends before it has all its documents, and cells of a table of words by documents.
PIECE_WORDS, BLOCK_WORDS, CELLS = 64, 1 << 20, 1 << 20
#: Bytes of a row group of the index, and of input (by its own size estimate) per task that sorts texts, with the most such tasks.
GROUP_BYTES, SORT_BYTES, MOST_SORTS = 8 << 20, 16 << 20, 4096


def expand_queries(
    queries: DataFrame, text: str = "text", machine: str = "machine", history: str = "history", out: str = "expanded"
) -> DataFrame:
    """Query text, machine and the last ten commands as one text."""
    recent = F.slice(F.col(history), -F.least(F.size(history), F.lit(10)), F.lit(10))
    recent = F.when(F.size(history) > 0, recent).otherwise(F.array().cast("array<string>"))
    head = F.array(
        F.col(text),
        F.concat(F.lit("Current machine: "), F.lower(tx.strip(tx.text_or_empty(machine)))),
        F.lit("Recent shell context:"),
    )
    return queries.withColumn(out, F.array_join(F.concat(head, recent), "\n"))


def term_rows(queries: DataFrame, text: str = "text", limit: int = rules.MAX_QUERY_TERMS) -> DataFrame:
    """query_id, ord (1-based), term."""
    return queries.select("query_id", F.posexplode(tx.query_terms(text, limit)).alias("ord", "term")).withColumn(
        "ord", (F.col("ord") + 1).cast("int")
    )


# ---------------------------------------------------------------- inverted index
def build_index(docs: DataFrame, *, title: str = "title", content: str = "content", index: str = "index", block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """(postings, blocks) of a corpus, written to the shared folder.

    The documents of an index are cut, in the order of doc_id, into blocks of at most ``block_docs``, fewer where they are long.  ``postings`` has block, word and a bit for
    each document of the block that has the word; ``blocks`` has block, index, first and docs (the ids by place).  Each text
    is exchanged once, then cut into its distinct words; a block is written word by word, so no row holds all of it.
    """
    kind, own = docs.schema["doc_id"].dataType.simpleString(), docs.schema[index].dataType.simpleString()
    order = [F.asc_nulls_first("index"), "doc_id"]
    # Texts are put in order before they are cut into words: the sampling of the ranges would otherwise cut them a second time.
    texts = docs.select(F.col(index).alias("index"), "doc_id", F.concat_ws("\n", F.col(title), F.col(content)).alias("text"))
    size, cores = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), texts.sparkSession.sparkContext.defaultParallelism
    words = texts.repartitionByRange(max(cores, min(MOST_SORTS, -(-size // SORT_BYTES))), *order).sortWithinPartitions(*order).select("index", "doc_id", tx.index_tokens("text").alias("all"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(PIECE_WORDS)), lambda n: F.slice("all", n + 1, PIECE_WORDS))
    rows = words.select("index", "doc_id", F.explode(pieces).alias("words"))
    made = keep(rows.mapInArrow(_index_blocks(block_docs), f"block bigint, index {own}, docs array<{kind}>, word string, bits binary"), "inverted-index", GROUP_BYTES)
    postings = made.filter(F.col("word").isNotNull()).select("block", "word", "bits")
    return postings, made.filter(F.col("word").isNull()).select("block", "index", F.get("docs", F.lit(0)).alias("first"), "docs")


def _index_blocks(most: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, None

        def one(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """A row with the documents of a block, then one for each of its words."""
            nonlocal number
            number += 1
            ids = rows["doc_id"]
            place = np.concatenate(([0], np.cumsum(_changes(ids))))  # rows that repeat a doc_id are one document
            coded = rows["words"].flatten().dictionary_encode()
            row = place.astype(np.int32)[np.repeat(np.arange(len(ids), dtype=np.int32), pc.fill_null(pc.list_value_length(rows["words"]), 0).to_numpy())]
            docs = ids.take(pa.array(np.flatnonzero(np.append(True, np.diff(place) > 0))))
            yield of_block(rows, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), None, None)
            code = coded.indices.to_numpy()
            turn = np.argsort(code, kind="stable")
            code, row = code[turn], row[turn]
            for low in range(0, len(coded.dictionary), step := max(1, CELLS // len(docs))):
                some = coded.dictionary.slice(low, step)
                own = slice(*np.searchsorted(code, (low, low + len(some))))
                flags = np.zeros((len(some), len(docs)), bool)
                flags[code[own] - low, row[own]] = True
                yield of_block(rows, None, some, _binary(np.packbits(flags, axis=1, bitorder="little")))

        def of_block(rows: pa.RecordBatch, docs: pa.Array | None, words: pa.Array | None, bits: pa.Array | None) -> pa.RecordBatch:
            n = len(words) if docs is None else 1
            kinds = (pa.list_(rows["doc_id"].type), pa.string(), pa.binary())
            tail = [pa.nulls(n, t) if x is None else x for x, t in zip((docs, words, bits), kinds, strict=True)]
            index = rows["index"].take(pa.array(np.zeros(n, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, (part << 32) + number)), index, *tail], names=["block", "index", "docs", "word", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            new = np.append(True, _changes(rows["index"]))
            fresh = new | np.append(True, _changes(rows["doc_id"]))
            words = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(rows["words"]), 0).to_numpy(), dtype=np.int64)))
            at, docs = 0, 0
            for k in np.flatnonzero(fresh).tolist():
                if k > at and (new[k] or docs == most or words[k] - words[at] >= BLOCK_WORDS):
                    yield from one(rows.slice(at, k - at))
                    at, docs = k, 0
                docs += 1
            held = rows.slice(at)
        if held is not None:
            yield from one(held)

    return of


def _changes(x: pa.Array) -> np.ndarray:
    """Does a value differ from the one before it (null equals null)?"""
    null = x.is_null().to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), False).to_numpy(zero_copy_only=False)
    return other | (null[1:] != null[:-1])


def lexical_hits(queries: DataFrame, docs: DataFrame, k: int, *, text: str = "text", title: str = "title", content: str = "content", index: str = "index", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Documents with any query term as a word prefix in title or content.

    The best ``k`` per (query, index): query_id, index, doc_id, distance, matched, rank; ranked by matched terms, then doc_id.
    """
    return search_index(queries, *build_index(docs, title=title, content=content, index=index, block_docs=block_docs), k, text=text)


def search_index(queries: DataFrame, postings: DataFrame, blocks: DataFrame, k: int, *, text: str = "text", first_look: int = FIRST_LOOK) -> DataFrame:
    """As ``lexical_hits``, over an index that was built before.

    Threshold search: a block can hold no document with more matches than the query has terms in the block.  Blocks are looked at from
    the largest such bound on, by doc_id among equals, ``first_look`` of them at first and eight times as many in each further look; a query and index is done when its k-th
    best cannot be beaten by what is left.  So a word that all documents have costs a look at a few blocks, not a pair for every document and
    query.  Queries with the same terms are searched once.
    """
    asked = keep(queries.select("query_id", F.array_sort(tx.query_terms(text)).alias("terms")).filter(F.size("terms") > 0).withColumn("g", F.xxhash64(F.array_join("terms", " "))), "lexical-queries")
    wanted = keep(asked.select("g", F.explode("terms").alias("term")).distinct(), "lexical-terms")
    lengths = [r[0] for r in wanted.select(F.length("term")).distinct().collect()] or [2]
    # One row of bits per block and term.  Words are looked up where they lie, by their prefixes: the bits of a block's words meet before
    # they are exchanged, and words no term begins stay behind.
    spec = "block bigint, term string, bits binary"
    terms = wanted.select("term").distinct()
    parts = max(1, -(-terms.count() // TERMS_AT_ONCE))
    prefixes = postings.select("block", "word", "bits", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("n")).filter(F.col("n") <= F.length("word"))
    prefixes = prefixes.select("block", F.left("word", F.col("n")).alias("term"), "bits")
    some = None
    for part in range(parts):
        own = F.broadcast(terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part))
        met = prefixes.join(own, "term").select("block", "term", "bits").mapInArrow(_some_bits, spec)
        some = met if some is None else some.unionByName(met)
    found = keep(some.repartition("block", "term").sortWithinPartitions("block", "term").mapInArrow(_any_bits, spec), "lexical-postings")
    bounds = found.select("block", "term").join(wanted, "term").groupBy("g", "block").agg(F.count(F.lit(1)).alias("bound"))
    turn = Window.partitionBy("g", "index").orderBy(F.desc("bound"), "first", "block")
    plan = keep(bounds.join(blocks.select("block", "index", "first"), "block").withColumn("turn", F.row_number().over(turn)), "lexical-plan")
    most = plan.agg(F.max("turn")).first()[0] or 0
    best, left, seen, look = None, plan, 0, first_look
    while True:
        now = left.filter(F.col("turn") <= seen + look)
        bits = now.select("g", "index", "block").join(wanted, "g").join(found, ["block", "term"]).groupBy("g", "index", "block").agg(F.collect_list("bits").alias("bits"))
        own = bits.mapInArrow(_best_places(k), "g bigint, block bigint, place int, matched bigint").join(blocks, "block").select("g", "index", F.get("docs", "place").alias("doc_id"), "matched")
        w = Window.partitionBy("g", "index").orderBy(F.desc("matched"), "doc_id")
        every = own if best is None else best.drop("rank").unionByName(own)
        best = keep(every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "lexical-best")
        seen, look = seen + look, look * 8
        if seen >= most:
            break
        last = best.filter(F.col("rank") == k).select(F.col("g").alias("_g"), F.col("index").alias("_index"), F.col("matched").alias("_matched"), F.col("doc_id").alias("_doc"))
        rest = left.filter(F.col("turn") > seen).join(last, (F.col("g") == F.col("_g")) & F.col("index").eqNullSafe(F.col("_index")), "left")
        open_ = F.col("_g").isNull() | (F.col("bound") > F.col("_matched")) | ((F.col("bound") == F.col("_matched")) & (F.col("first") < F.col("_doc")))
        left = keep(rest.filter(open_).select(*plan.columns), "lexical-left")
        if left.isEmpty():
            break
    ranked = asked.select("query_id", "g").join(best, "g")
    return ranked.select("query_id", "index", "doc_id", F.lit(rules.LEXICAL_DISTANCE).alias("distance"), "matched", "rank")


def _some_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (block, term) of a batch as one, before they are exchanged."""
    for batch in batches:
        if batch.num_rows:
            yield _merged(batch.take(pc.sort_indices(batch, [("block", "ascending"), ("term", "ascending")])))


def _any_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits that are set in any row of a (block, term); rows come sorted, and those of one may go on in the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        last = int(_runs(rows)[-1])
        if last:
            yield _merged(rows.slice(0, last))
        held = _merged(rows.slice(last))
    if held is not None:
        yield held


def _runs(rows: pa.RecordBatch) -> np.ndarray:
    """Where a new (block, term) begins in sorted rows."""
    return np.flatnonzero(np.append(True, _changes(rows["block"]) | _changes(rows["term"])))


def _merged(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row per (block, term) of sorted rows; all bits of a block have one length."""
    width = pc.binary_length(rows["bits"]).to_numpy()
    done = []
    for w in np.unique(width).tolist():
        own = rows.take(pa.array(np.flatnonzero(width == w)))
        new = _runs(own)
        table = np.frombuffer(b"".join(own["bits"].to_pylist()), np.uint8).reshape(-1, w)
        bits = _binary(np.bitwise_or.reduceat(table, new, axis=0))
        done.append(pa.RecordBatch.from_arrays([*(own[c].take(pa.array(new)) for c in ("block", "term")), bits], names=["block", "term", "bits"]))
    return pa.Table.from_batches(done).combine_chunks().to_batches()[0]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


def _best_places(k: int):
    """The k places of a block that most terms of a query have, the first ones among equals."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, counts = [], [], []
            for i in range(batch.num_rows):
                n = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in batch["bits"][i].as_py()]), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                at = np.argsort(-n, kind="stable")[:k]
                at = at[n[at] > 0]
                rows.append(np.full(len(at), i))
                places.append(at)
                counts.append(n[at])
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch["g"].take(take), batch["block"].take(take), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], names=["g", "block", "place", "matched"])

    return of


def title_rescue(
    queries: DataFrame,
    docs: DataFrame,
    hits: DataFrame,
    k: int,
    *,
    text: str = "text",
    title: str = "title",
    index: str = "index",
    only_index: str | None = rules.RESCUE_INDEX,
) -> DataFrame:
    """For queries without hits: documents whose title holds the earliest term that any title holds."""
    missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    terms = term_rows(missed, text)
    pool = docs if only_index is None else docs.filter(F.lower(index) == only_index)
    words = pool.select(F.col(index).alias("index"), "doc_id", F.explode(tx.index_tokens(title)).alias("term"))
    found = words.join(terms, "term").groupBy("query_id", "index", "doc_id").agg(F.min("ord").alias("ord"))
    first = found.groupBy("query_id", "index").agg(F.min("ord").alias("_first"))
    kept = found.join(first, ["query_id", "index"]).filter(F.col("ord") == F.col("_first"))
    w = Window.partitionBy("query_id", "index").orderBy("doc_id")
    return (
        kept.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "index", "doc_id", F.lit(rules.LEXICAL_DISTANCE).alias("distance"), "ord", "rank")
    )


def machine_variants(c: Column | str) -> Column:
    """Spaced, compact and prefixed spellings of a machine name, sorted."""
    words = F.transform(
        F.split(tx.canonical_machine(c), " "),
        lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30))),
    )

    def spell(w: Column) -> Column:
        spaced, compact = F.array_join(w, " "), F.array_join(w, "")
        prefixed = [F.concat(F.lit("HackTheBox - "), v) for v in (spaced, compact)]
        return F.array_sort(F.array_distinct(F.array(spaced, compact, *prefixed)))

    return F.when(tx.canonical_machine(c) == "", F.array().cast("array<string>")).otherwise(tx.let(words, spell))


def filter_machine(docs: DataFrame, targets: DataFrame, machine: str = "machine", target: str = "machine") -> DataFrame:
    """Documents whose machine is spelled in one of the variants of a target."""
    spellings = targets.select(F.explode(machine_variants(target)).alias("_variant")).distinct()
    return docs.join(spellings, docs[machine] == F.col("_variant"), "left_semi")


def target_hits(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    *,
    machine: str = "machine",
    content: str = "content",
    index: str = "index",
    index_rank: str | None = None,
) -> DataFrame:
    """Documents of the query's own machine, distance 0.

    At most 3k per index, copies (source, machine, leading content) once, the first k in
    index order.  The machine's documents are cut to 3k per index *before* they meet
    the queries, so a machine with very many documents or queries costs nothing extra.
    """
    wanted = queries.select("query_id", tx.canonical_machine(machine).alias("_key")).filter(F.col("_key") != "")
    order_col = F.col(index_rank) if index_rank else F.col(index)
    keyed = docs.select(
        F.col(index).alias("index"),
        "doc_id",
        order_col.alias("_ord"),
        tx.canonical_machine(machine).alias("_key"),
        F.sha2(F.concat_ws("|", F.col(machine), F.col(content)), 256).alias("_copy"),
    ).filter(F.col("_key") != "")
    per_index = Window.partitionBy("_key", "index").orderBy("doc_id")
    capped = keyed.withColumn("_n", F.row_number().over(per_index)).filter(F.col("_n") <= max(3 * k, k))
    # A copy is the earliest row of its (machine, index, leading content).
    once = capped.groupBy("_key", "index", "_copy").agg(F.min(F.struct("_ord", "_n", "doc_id")).alias("_b"))
    per_key = Window.partitionBy("_key").orderBy("_b._ord", "index", "_b._n")
    short = once.withColumn("rank", F.row_number().over(per_key)).filter(F.col("rank") <= k)
    return short.join(wanted, "_key").select(
        "query_id", "index", F.col("_b.doc_id").alias("doc_id"), F.lit(0.0).alias("distance"), "rank"
    )


def with_fallback(first: DataFrame, queries: DataFrame, rest) -> DataFrame:
    """``first`` where it answers a query, else ``rest(remaining queries)``."""
    answered = first.select("query_id").distinct()
    remaining = queries.join(answered, "query_id", "left_anti")
    return first.unionByName(rest(remaining), allowMissingColumns=True)


def hybrid_merge(
    lexical: DataFrame, vector: DataFrame, docs: DataFrame, limit: int, *, content: str = "content", index: str = "index"
) -> DataFrame:
    """Lexical hits first, then vector hits, copies dropped, ``limit`` per (query, index)."""
    key = docs.select(
        F.col(index).alias("index"),
        "doc_id",
        F.sha2(F.concat_ws("|", F.col(index), F.col(content)), 256).alias("_copy"),
    )
    cols = ("query_id", "index", "doc_id", "distance", "rank")
    both = (
        lexical.select(*cols)
        .withColumns({"origin": F.lit("lexical"), "_o": F.lit(0)})
        .unionByName(vector.select(*cols).withColumns({"origin": F.lit("vector"), "_o": F.lit(1)}))
        .join(key, ["index", "doc_id"])
    )
    once = both.groupBy("query_id", "index", "_copy").agg(
        F.min(F.struct("_o", "rank", "doc_id", "distance", "origin")).alias("_b")
    )
    w = Window.partitionBy("query_id", "index").orderBy("_b._o", "_b.rank", "_b.doc_id")
    return (
        once.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
        .select("query_id", "index", F.col("_b.doc_id").alias("doc_id"), F.col("_b.distance").alias("distance"), F.col("_b.origin").alias("origin"), "rank")
    )


def federated(hits: DataFrame, k: int, candidates: int = rules.RERANK_CANDIDATES, index_order: Sequence[str] = ()) -> DataFrame:
    """Per-index lists capped at max(candidates, k), in index order, numbered over the query."""
    cap = max(candidates, k)
    per_index = Window.partitionBy("query_id", "index").orderBy("rank", "doc_id")
    place: Column = F.lit(len(index_order))
    for n, name in reversed(list(enumerate(index_order))):
        place = F.when(F.col("index") == name, n).otherwise(place)
    capped = hits.withColumn("rank", F.row_number().over(per_index)).filter(F.col("rank") <= cap)
    over_query = Window.partitionBy("query_id").orderBy("_place", "index", "rank")
    return capped.withColumn("_place", place).withColumn("position", F.row_number().over(over_query)).drop("_place")


def source_filter_of(text: Column | str, pattern: str = rules.SOURCE_PHRASE) -> Column:
    """Source named by ``only <source>`` in the text (both spellings of an alias), else null."""
    found = F.lower(tx.extract_or_null(tx.text_or_empty(text), "(?i)" + pattern))
    for alias, name in rules.SOURCE_ALIASES.items():
        found = F.when(found == alias, name).otherwise(found)
    return found


def apply_source_filter(hits: DataFrame, allowed: DataFrame, index: str = "index") -> DataFrame:
    """Keep hits of allowed sources; a query without rows in ``allowed`` is not restricted.

    ``allowed``: query_id, source.
    """
    norm = allowed.select("query_id", F.lower(tx.strip("source")).alias("_src")).filter(F.col("_src") != "").distinct()
    listed = norm.groupBy("query_id").agg(F.collect_set("_src").alias("_allow"))
    return (
        hits.join(listed, "query_id", "left")
        .filter(F.col("_allow").isNull() | F.array_contains("_allow", F.lower(index)))
        .drop("_allow")
    )


def prefer_target(hits: DataFrame, targets: DataFrame, machine: str = "machine", target: str = "target") -> DataFrame:
    """If any hit of a query is of its target machine, keep only those."""
    want = targets.select("query_id", tx.canonical_machine(target).alias("_want"))
    is_match = (F.col("_want") != "") & (tx.canonical_machine(machine) == F.col("_want"))
    w = Window.partitionBy("query_id")
    return (
        hits.join(want, "query_id", "left")
        .withColumn("_m", F.coalesce(is_match, F.lit(False)))
        .withColumn("_any", F.max("_m").over(w))
        .filter(F.col("_m") | ~F.col("_any"))
        .drop("_want", "_m", "_any")
    )


def index_counts(registry: DataFrame, docs: DataFrame, index: str = "index") -> DataFrame:
    """Documents per registered index, with a warning flag for empty ones."""
    counts = docs.groupBy(F.col(index).alias("index")).agg(F.count(F.lit(1)).alias("num_docs"))
    return (
        registry.select("index").distinct().join(counts, "index", "left")
        .select("index", F.coalesce("num_docs", F.lit(0)).cast("long").alias("num_docs"))
        .withColumn("ok", F.col("num_docs") > 0)
    )
