"""Incremental mail sync and backlog drains as streams: offsets advance only over what the sink has committed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.runtime import load, shared_dir
from lodestone.operators.state import StateStore

#: How far a resumed run reads back behind its watermark.
OVERLAP_MS = 2 * 86_400_000


def sync_state(log: DataFrame) -> DataFrame:
    """(mid, attempts, done, ms): state of every mail of a sync log; repeated and late rows change nothing, null mids are left out."""
    ok = F.col("outcome") == "ok"
    return log.where("mid is not null").groupBy("mid").agg(F.max("attempt").alias("attempts"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("done"), F.max(F.when(ok, F.col("internal_ms"))).alias("ms"))


def watermark(state: DataFrame) -> DataFrame:
    """One row: the newest fetched time, where the next run resumes, and how many mails wait for a retry. The list of those is
    retries(state), whole however long."""
    return state.agg(F.max("ms").alias("watermark_ms"), (F.max("ms") - OVERLAP_MS).alias("resume_ms"), F.count_if(~F.col("done")).alias("retry"))


def retries(state: DataFrame) -> DataFrame:
    return state.where(~F.col("done")).select("mid")


def next_batch(listing: DataFrame, state: DataFrame) -> DataFrame:
    """The listed mails (mid, internal_ms) that the next run fetches, oldest first: newer than the overlap or waiting for a retry, and not done."""
    mark = F.broadcast(watermark(state).select("resume_ms"))
    wait = retries(state).withColumn("_wait", F.lit(True))
    rows = listing.crossJoin(mark).join(wait, "mid", "left").join(state.where("done").select("mid"), "mid", "left_anti")
    return rows.where(F.col("_wait") | F.col("resume_ms").isNull() | (F.col("internal_ms") >= F.col("resume_ms"))).select("mid", "internal_ms").orderBy("internal_ms", "mid")


def drain(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, name: str = "drain", seconds: float | None = None, tries: int = 1, pause: float = 2.0) -> bool:
    """Works off what a stream has now in micro-batches; a batch counts as read once commit has returned, so a failure repeats it.

    With `seconds` it stops after that time, and the next run on the checkpoint goes on where this one stopped. A run that fails is
    tried again, `tries` times in all, after a pause that doubles. Returns whether all was worked off.
    """
    end = None if seconds is None else time.monotonic() + seconds
    for k in range(tries):
        job = stream.writeStream.queryName(f"{name}_{uuid.uuid4().hex[:8]}").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            done = job.awaitTermination(None if end is None else max(0.0, end - time.monotonic()))
            if end is not None and not done:
                job.stop()
                return False
            return True
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    return False


def save_offsets(spark: SparkSession, path: str, state: DataFrame) -> None:
    """Keeps what the next run resumes from: the watermark, and the whole list of mails that wait for a retry."""
    store = StateStore(spark, path)
    store.save("mail_retries", retries(state))
    mark = watermark(state).first()
    store.put("mail_offset", {"watermark_ms": mark["watermark_ms"], "resume_ms": mark["resume_ms"]})


def stored_offsets(spark: SparkSession, path: str) -> tuple[int | None, DataFrame]:
    """(resume_ms, waiting mails): from where and for what the next run fetches; (None, none) before the first."""
    store = StateStore(spark, path)
    return store.get("mail_offset", {}).get("resume_ms"), store.load("mail_retries", "mid string")


def fetch_window(listing: DataFrame, resume_ms: int | None, waiting: DataFrame) -> DataFrame:
    """Of a listing (mid, internal_ms) the mails that a run fetches: from resume_ms on, and those that wait; oldest first."""
    late = F.lit(True) if resume_ms is None else F.coalesce(F.col("internal_ms") >= resume_ms, F.lit(False))
    rows = listing.join(waiting.select("mid").distinct().withColumn("_wait", F.lit(True)), "mid", "left")
    return rows.where(late | F.col("_wait")).select("mid", "internal_ms").distinct().orderBy("internal_ms", "mid")


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodestone-streams/{what}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    schema = load(spark, d, table).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parquet" if not _is_file(spark, f"{d}/{table}.parquet") else f"{d}/[{table[0]}]{table[1:]}.parquet")


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def run_available(spark: SparkSession, d: str, place: str | None = None) -> DataFrame:
    """The mail sync log read as a stream: each micro-batch is committed under its number, so that a repeated batch replaces itself;
    repeats across batches fold away at the end. A run on the place of an earlier one reads only what is new since."""
    place = place or _place(spark, "mail-sync")
    out = f"{place}/batches"

    def commit(batch: DataFrame, number: int) -> None:
        batch.where("mid is not null").distinct().write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(_stream(spark, d, "mail_sync"), commit, f"{place}/checkpoint", "mail_sync")
    rows = spark.read.parquet(out).drop("batch").distinct()
    return rows.groupBy("mid").agg(F.min("sync_id").alias("first_sync"), F.max("attempt").alias("attempts"), F.count("*").alias("n"))


def drain_events(spark: SparkSession, d: str, place: str | None = None) -> DataFrame:
    """Events read as a stream, folded per type in each micro-batch and summed up at the end; place as in run_available."""
    place = place or _place(spark, "events")
    out = f"{place}/batches"

    def commit(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(_stream(spark, d, "events"), commit, f"{place}/checkpoint", "events")
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").cast("long").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def embed_drain(spark: SparkSession, pending: DataFrame, embedder=None, place: str | None = None, seconds: float | None = None) -> DataFrame:
    """(id, embedding, drop_reason) of a stream of pending rows (id, text), embedded micro-batch by micro-batch, as far as `seconds` allow;
    a run on the place of an earlier one goes on where that stopped."""
    from lodestone.operators.embedding import embed

    place = place or _place(spark, "vectors")
    out = f"{place}/batches"
    drain(pending, lambda batch, number: embed(batch, embedder).write.mode("overwrite").parquet(f"{out}/batch={number}"), f"{place}/checkpoint", "embed", seconds)
    return spark.read.schema("id string, embedding array<float>, drop_reason string").parquet(out)
