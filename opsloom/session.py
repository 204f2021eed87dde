"""Session set-up and the shared-folder helpers used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("opsloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate results.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests on one
    machine) a folder inside the warehouse, which is shared by definition, takes its place.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return spark.sparkContext.getCheckpointDir()


def spread(df: DataFrame, small_bytes: int = 1 << 30) -> DataFrame:
    """Give a small input as many partitions as there are cores.

    A small file is one row group and so one task, however costly the work on its rows.
    Inputs above ``small_bytes`` (by the scan's own size estimate) have many row
    groups already, and inputs of as many files as cores are spread as they lie; both are left alone, so large tables get no extra exchange.
    """
    size, cores = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), df.sparkSession.sparkContext.defaultParallelism
    return df if size > small_bytes or len(df.inputFiles()) >= cores else df.repartition(cores)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and go on from there.

    For results that the next step reads more than once and that are costly to compute:
    chained two-pass operators would otherwise repeat everything below them at each link.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """Like ``settle``, as a Parquet table: compressed, and later reads take only the columns they need.

    ``group_bytes``: size of a row group, which a task holds while it writes; a column of one is held while it is read.
    """
    path = new_path(df.sparkSession, label)
    df.write.options(**({} if group_bytes is None else {"parquet.block.size": group_bytes})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
