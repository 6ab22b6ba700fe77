"""Mail of a live account: paged listing, fetching by tasks, and pulls that resume from stored offsets. The calls themselves are pluggable."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.runtime import table_cut
from lodestone.operators.state import StateStore
from lodestone.operators.store import SourceStatus
from lodestone.sources.records import first_of, mails
from lodestone.streaming.incremental import OVERLAP_MS, stored_offsets

#: One page of a listing: (query, page token or None) -> output of the account's tool, {"messages": [{"id"}], "nextPageToken"?} in JSON.
Lister = Callable[[str, str | None], str]
#: One message: id -> output of the account's tool, {"raw": base64url, "internalDate": ms} in JSON.
Fetcher = Callable[[str], str]


def answer(output: str) -> dict:
    """The JSON object in a tool's output, which may print other lines before it."""
    start = output.find("{")
    if start < 0:
        raise ValueError("no JSON object in the answer")
    return json.JSONDecoder().raw_decode(output[start:])[0]


def listed(spark: SparkSession, call: Lister, query: str = "") -> DataFrame:
    """(mid) of all pages of a listing, each once. Pages follow from one another, so they are asked for here; ids only are held."""
    found, token = [], None
    while True:
        page = answer(call(query, token))
        found += [(m["id"],) for m in page.get("messages", [])]
        token = page.get("nextPageToken")
        if not token:
            return spark.createDataFrame(found, "mid string").distinct()


def fetched(wanted: DataFrame, fetch: Fetcher) -> DataFrame:
    """(mid, raw, internal_ms, outcome) of the wanted (mid): ok with its bytes and time, or failed, which the next run tries again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for mid in b["mid"]:
                try:
                    got = answer(fetch(mid))
                    row = (mid, got["raw"], int(got["internalDate"]), "ok")
                except Exception:
                    row = (mid, None, None, "failed")
                yield pd.DataFrame([row], columns=["mid", "raw", "internal_ms", "outcome"]).astype({"internal_ms": "Int64"})

    rows = wanted.select("mid").mapInPandas(run, "mid string, raw string, internal_ms long, outcome string")
    return rows.withColumn("raw", X.from_base64url(F.col("raw")))


def pull(spark: SparkSession, path: str, call: Lister, fetch: Fetcher) -> tuple[DataFrame, SourceStatus, Callable[[], None]]:
    """(mail objects, status, done) of one incremental run: mails since the stored watermark less an overlap, and those that failed before.

    The listing is asked for by time where there is a watermark. done stores the new offsets; it is called once the objects are in the
    store, so that a run that dies is repeated. The status is PARTIAL, as only part of the account is seen, so nothing is pruned.
    """
    resume, waiting = stored_offsets(spark, path)
    query = "" if resume is None else f"after:{resume // 1000}"
    wanted = listed(spark, call, query).unionByName(waiting.select("mid")).distinct()
    got = table_cut(fetched(wanted, fetch))

    def done() -> None:
        store = StateStore(spark, path)
        top = got.where("outcome = 'ok'").agg(F.max("internal_ms")).first()[0]
        known = store.get("mail_offset", {}).get("watermark_ms")
        mark = max((m for m in (top, known) if m is not None), default=None)
        store.save("mail_retries", got.where("outcome <> 'ok'").select("mid"))
        store.put("mail_offset", {"watermark_ms": mark, "resume_ms": None if mark is None else mark - OVERLAP_MS})

    return mails(got.where("outcome = 'ok'").select("raw", F.lit("live").alias("origin"), "internal_ms")), SourceStatus.PARTIAL, done


def archive_and_live(archives: DataFrame | None, live: DataFrame | None, archives_changed: bool = True) -> tuple[DataFrame | None, SourceStatus]:
    """(mail objects, status) of archived and live mail together: of one mail the archive's object counts. Archives that are as before are
    not read again, so that what was seen is PARTIAL, as it is with live mail, which is a part of the account."""
    parts = [p for p in (archives if archives_changed else None, live) if p is not None]
    if not parts:
        return None, SourceStatus.UNCHANGED
    both = parts[0] if len(parts) == 1 else first_of(parts[0].withColumn("_part", F.lit(0)).unionByName(parts[1].withColumn("_part", F.lit(1))), ["source_id"], ["_part", "origin"]).drop("_part")
    return both, SourceStatus.COMPLETE if live is None else SourceStatus.PARTIAL
