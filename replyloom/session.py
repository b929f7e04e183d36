"""Spark session and checkpoint folder."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(app_name: str = "replyloom", master: str | None = None, **settings) -> SparkSession:
    """Session in UTC with adaptive execution on; other settings are the caller's."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; where it names none, one in the warehouse folder.

    A warehouse on one machine's disk is refused on a cluster.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        shared = "://" in warehouse and not warehouse.startswith("file:")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{warehouse}/checkpoints"
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder; what follows survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_checkpoints(*tables: DataFrame) -> None:
    """Delete the files behind tables of :func:`cut_lineage` that nothing reads any more.

    Otherwise files go when the driver happens to collect its garbage, which may be long after. It is asked to, so that Spark also lets go of the
    shuffles behind such tables.
    """
    for df in tables:
        context, jvm = df.sparkSession.sparkContext, df.sparkSession._jvm
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """As :func:`cut_lineage`, and the number of rows, counted while they are written."""
    seen = Observation()
    written = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return written, seen.get["rows"]


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A few parameter rows as part of the plan."""
    entries = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))
