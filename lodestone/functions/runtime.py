"""Session helpers shared by all operators: loading tables, shared folders, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The parquet table of that name below folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset on a local master, as in tests, a folder of this process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = os.path.join(tempfile.gettempdir(), f"lodestone-{os.getpid()}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known or spark.sparkContext.getCheckpointDir()


def table_cut(df: DataFrame) -> DataFrame:
    """df written once as parquet in the shared folder and read again: survives the loss of executors, and costs less disk than checkpoint()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted, not guessed), else df as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition before costly per-row work, only where a scan gives fewer partitions than the cluster has cores.

    A plan with a shuffle is left as it is: asking for its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString() or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hash_sample(rows: DataFrame, column: str, limit: int) -> list[str]:
    """At most limit distinct-by-hash values of a text column, the same ones at every run; tasks send only about as many as are kept."""
    hashed = rows.select(column, F.xxhash64(column).alias("h"))
    n = rows.count()
    if n > 2 * limit:
        hashed = hashed.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * limit / n)))
    return [r[0] for r in hashed.orderBy("h", column).limit(limit).collect()]
