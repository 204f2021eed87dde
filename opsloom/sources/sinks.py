"""Writers: full refresh, TTL upserts, status, purge, snapshots, learnings, redacted traces."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.operators.corpus import distinct_by_key


# ---------------------------------------------------------------- chunks
def refresh_partitions(
    df: DataFrame, path: str, partition: str = "index", key: str = "doc_key", order: Sequence[str] = ("chunk_no",), vector: str = "embedding", salt: int = 32
) -> dict[str, int]:
    """Replace the partitions present in ``df`` by its rows, one row per key; returns counters.

    Rows are spread over (partition, salt), so an index with most of the rows is written
    by many tasks.  Other partitions stay as they are.
    """
    has_vector = vector in df.columns
    failed = F.count_if(F.col(vector).isNull()) if has_vector else F.lit(0).cast("long")
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("total"), failed.alias("failed"))
    good = watched.filter(F.col(vector).isNotNull()) if has_vector else watched
    once = distinct_by_key(good, [partition, key], list(order))
    spread = once.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salt))).repartition(partition, "_salt").drop("_salt")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    out = dict(seen.get)
    return {"total": int(out["total"]), "failed": int(out["failed"])}


def with_ttl(df: DataFrame, days: int = rules.CHUNK_TTL_DAYS, at: str = "updated_at", out: str = "expires_at") -> DataFrame:
    return df.withColumn(out, F.col(at) + F.make_dt_interval(days=F.lit(days)))


def unexpired(df: DataFrame, now: Column | None = None, expires: str = "expires_at") -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return df.filter(F.col(expires).isNull() | (F.col(expires) > now))


def append_upsert(df: DataFrame, path: str, batch_rows: int = 50) -> dict[str, int]:
    """Append rows that carry expires_at; readers take the latest row per key.  Returns batch statistics."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("embedding").isNull()).alias("failed"))
    rows.filter(F.col("embedding").isNotNull()).write.mode("append").parquet(path)
    total, failed = int(seen.get["total"]), int(seen.get["failed"])
    return {"total_chunks": total, "ingested": total - failed, "failed": failed, "batches": -(-total // batch_rows)}


def read_upserts(spark: SparkSession, path: str, key: str = "doc_key", now: Column | None = None) -> DataFrame:
    return unexpired(distinct_by_key(spark.read.parquet(path), key, ["updated_at"]), now)


def purge_by_url(df: DataFrame, fragment: str | Column, url: str = "url", index: str | None = None, name: str = "webcrawl") -> tuple[DataFrame, DataFrame]:
    """(rows kept, count deleted) for deleting by a fragment of the address, ignoring case."""
    frag = F.lower(F.lit(fragment) if isinstance(fragment, str) else fragment)
    gone = F.lower(tx.text_or_empty(url)).contains(frag)
    if index is not None:
        gone = gone & (F.col(index) == name)
    return df.filter(~gone), df.agg(F.count_if(gone).alias("deleted"))


def rewrite_purged(spark: SparkSession, path: str, fragment: str, index_name: str = "webcrawl") -> int:
    """Rewrite one index partition of a chunk table without the matching rows; returns the count deleted.

    The rows kept are first materialised in the shared checkpoint folder, since the partition
    is read and replaced in one job otherwise.
    """
    from opsloom.session import shared_folder

    shared_folder(spark)
    part = spark.read.parquet(path).filter(F.col("index") == index_name)
    kept, deleted = purge_by_url(part, fragment)
    n = deleted.collect()[0]["deleted"]
    if n:
        safe = kept.checkpoint(eager=True)
        if safe.isEmpty():
            # A dynamic overwrite replaces only partitions that get rows.
            hadoop = spark._jvm.org.apache.hadoop.fs
            target = hadoop.Path(f"{path}/index={index_name}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        else:
            safe.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index").parquet(path)
    return int(n)


# ---------------------------------------------------------------- status
def sync_status(registry: DataFrame, log: DataFrame, name: str = "source", at: str = "last_sync") -> DataFrame:
    """Latest sync per registered source; ``never`` when there is none."""
    fields = [c for c in log.columns if c != name]
    latest = log.groupBy(name).agg(F.max_by(F.struct(*fields), at).alias("_s")).select(name, "_s.*")
    return registry.select(name).distinct().join(latest, name, "left").withColumn(
        "status", F.coalesce(F.nullif(F.col(at).cast("string"), F.lit("")), F.lit("never"))
    )


def write_sync_status(df: DataFrame, path: str) -> None:
    """Append status rows (source, index, last_sync, count, failed)."""
    df.write.mode("append").parquet(path)


# ---------------------------------------------------------------- sessions and learnings
def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("kind").json(path)


def learning_rows(df: DataFrame, text: str = "explanation", at: str = "created_at") -> DataFrame:
    """Learnings worth keeping, with their expiry; exploration markers live shorter.

    A row is a marker when it has a column ``kind`` with value ``marker``.
    """
    kind = F.col("kind") if "kind" in df.columns else F.lit("learning")
    days = F.when(kind == "marker", rules.MARKER_TTL_DAYS).otherwise(rules.LEARNING_TTL_DAYS)
    clean = tx.strip(tx.text_or_empty(text))
    return (
        df.withColumn(text, clean)
        .filter((F.length(text) >= rules.LEARNING_MIN_CHARS) | (kind == "marker"))
        .withColumn("expires_at", F.col(at) + F.make_dt_interval(days=days))
    )


def append_learnings(df: DataFrame, path: str) -> None:
    learning_rows(df).write.mode("append").parquet(path)


def save_context(df: DataFrame, path: str) -> None:
    """Append per-machine context rows; readers take the newest row per machine (``latest_state``)."""
    df.write.mode("append").parquet(path)


def context_writer(path: str):
    """``foreachBatch`` function; the batch id makes a replayed batch replace itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)

    return write


# ---------------------------------------------------------------- traces
def redact_value(key: Column, value: Column, max_chars: int) -> Column:
    limit = max(rules.REDACT_MIN_CHARS, max_chars)
    size = F.length(value)
    return (
        F.when(F.lower(key).isin(*rules.SECRET_KEYS), "<redacted>")
        .when(
            value.startswith("data:image") & value.contains(";base64,"),
            F.concat(F.lit("<image-data-uri length="), size.cast("string"), F.lit(">")),
        )
        .when(size > limit, F.concat(F.left(value, F.lit(limit)), F.lit("...<truncated "), (size - limit).cast("string"), F.lit(" chars>")))
        .otherwise(value)
    )


def redact_map(payload: Column | str, max_chars: int = 2000) -> Column:
    """Flat payload (map of texts) with secrets masked, image data and long texts shortened."""
    return F.transform_values(tx.col(payload), lambda k, v: redact_value(k, v, max_chars))


def redact_json(payload: Column | str, max_chars: int = 2000) -> Column:
    """Nested JSON payload, redacted at every depth.

    Built-in functions cannot walk a value of unknown depth, so this is one small
    Arrow-batched function; flat payloads should use ``redact_map``.
    """
    limit = max(rules.REDACT_MIN_CHARS, max_chars)
    secret = frozenset(rules.SECRET_KEYS)

    def clean(v):
        if isinstance(v, dict):
            return {k: "<redacted>" if k.lower() in secret else clean(x) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, str) and v.startswith("data:image") and ";base64," in v:
            return f"<image-data-uri length={len(v)}>"
        if isinstance(v, str) and len(v) > limit:
            return f"{v[:limit]}...<truncated {len(v) - limit} chars>"
        return v

    @F.pandas_udf(T.StringType())
    def walk(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else json.dumps(clean(json.loads(t))))

    # Text that is no JSON has no keys to look at: it counts as one text value.
    raw = tx.col(payload)
    good = F.try_parse_json(raw).isNotNull()
    return F.when(good, walk(F.when(good, raw))).otherwise(redact_value(F.lit(""), raw, max_chars))


def redact_typed(payload: Column | str, schema: T.StructType | str, max_chars: int = 2000) -> Column:
    """Like ``redact_json`` for payloads whose fields are known, by built-in functions alone.

    The walk is over the schema, so no Python sees a row.  Fields that are null or not in the schema are left out of the
    result; use a map type where names vary.  Text that is no JSON object counts as one text value.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = tx.col(payload)
    parsed = F.from_json(raw, kind)
    good = tx.strip(raw).startswith("{") & F.try_parse_json(raw).isNotNull()
    return F.when(good, F.to_json(_redact_by_type(parsed, kind, max_chars))).otherwise(redact_value(F.lit(""), raw, max_chars))


def _redact_by_type(value: Column, kind: T.DataType, max_chars: int) -> Column:
    def named(name: Column, one: Column, of: T.DataType) -> Column:
        secret = F.lower(name).isin(*rules.SECRET_KEYS)
        if isinstance(of, T.StringType):
            return F.when(secret & one.isNotNull(), "<redacted>").otherwise(redact_value(F.lit(""), one, max_chars))
        return _redact_by_type(one, of, max_chars)

    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            one = value.getField(f.name)
            if f.name.lower() in rules.SECRET_KEYS:  # of any type
                fields.append(F.when(one.isNotNull(), "<redacted>").alias(f.name))
            else:
                fields.append(_redact_by_type(one, f.dataType, max_chars).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redact_by_type(x, kind.elementType, max_chars))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: named(k, x, kind.valueType))
    return redact_value(F.lit(""), value, max_chars) if isinstance(kind, T.StringType) else value


def write_traces(df: DataFrame, path: str, max_chars: int = 2000) -> None:
    """Append trace records as JSON lines with redacted payloads (``payload``: JSON text)."""
    df.withColumn("payload", redact_json("payload", max_chars)).select("ts", "event", "trace_id", "provider", "machine", "payload").write.mode("append").json(path)
