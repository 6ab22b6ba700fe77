"""One ingest run: sources to chunk rows, upsert into the store, pruning by status, a new store version.

A version is a manifest that names the folder of each kind. Kinds of which a run has nothing new keep their folder, so a run that finds
nothing writes no data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.runtime import table_cut
from lodestone.operators.chunkers import COLUMNS, chunk_code, chunk_markdown, chunk_rows, code_rows
from lodestone.operators.state import StateStore
from lodestone.operators.store import SourceStatus, changed_kinds, fingerprint, prune, upsert, write_kinds
from lodestone.schema import CHUNKS

#: A source: kind -> (objects or ready chunk rows, how its run ended).
Source = Callable[[SparkSession], tuple[DataFrame | None, SourceStatus]]
_PRINTS = "kind string, fingerprint string"


def to_chunks(kind: str, objects: DataFrame) -> DataFrame:
    """Chunk rows of a kind's objects: documents by headings, source files by syntax, commits and tasks whole, the rest in windows."""
    if set(COLUMNS) <= set(objects.columns):
        return objects.select(*COLUMNS)
    if kind == "doc":
        return chunk_markdown(objects, kind)
    if kind == "code":
        return code_rows(chunk_code(objects), objects)
    return chunk_rows(objects, kind, single=kind in ("git_commit", "things3", "fyr"))


def read_store(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """The newest complete version of the store at path, of the kinds asked for; empty before the first run."""
    places = StateStore(spark, path).get("manifest", {})
    parts = [spark.read.schema(CHUNKS).parquet(place).withColumn("source_kind", F.lit(kind)).select(*CHUNKS.fieldNames()) for kind, place in sorted(places.items()) if kinds is None or kind in kinds]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], CHUNKS)


def unchanged(spark: SparkSession, path: str, listings: DataFrame) -> set[str]:
    """The kinds of listings (kind, path, mtime, size) that are as a completed run last saw them."""
    state = StateStore(spark, path)
    now = fingerprint(listings)
    changed = {r[0] for r in changed_kinds(now, state.load("fingerprints", _PRINTS)).collect()}
    return {r[0] for r in now.select("kind").collect()} - changed


def ingest(spark: SparkSession, sources: dict[str, Source], path: str, version: str, allow_empty: bool = False, listings: DataFrame | None = None) -> dict[str, SourceStatus]:
    """Brings the store at path up to date and returns each source's status.

    A source that raises, at once or when its rows are read, counts as UNAVAILABLE, so that nothing of it is written or pruned;
    UNCHANGED and UNAVAILABLE sources give no rows, and kinds whose listing is as before are UNCHANGED without being run. Only kinds with
    rows, or complete ones that are pruned, are rewritten. Fingerprints are kept for kinds that completed, after the data.
    """
    state = StateStore(spark, path)
    same = unchanged(spark, path, listings) if listings is not None else set()
    fresh, status = [], {}
    for kind, source in sources.items():
        if kind in same:
            status[kind] = SourceStatus.UNCHANGED
            continue
        try:
            rows, ended = source(spark)
            if rows is not None and ended in (SourceStatus.COMPLETE, SourceStatus.PARTIAL):
                fresh.append(table_cut(to_chunks(kind, rows)))
            status[kind] = ended
        except Exception:
            status[kind] = SourceStatus.UNAVAILABLE
    if fresh:
        new = reduce(DataFrame.unionByName, fresh)
        touched = sorted({r[0] for r in new.select("source_kind").distinct().collect()} | {k for k, s in status.items() if s is SourceStatus.COMPLETE and allow_empty})
        merged = prune(upsert(read_store(spark, path, touched), new), new.select("id", "source_kind", "project"), status, allow_empty)
        places = write_kinds(merged, f"{path.rstrip('/')}/data", version)
        kept = {k: p for k, p in state.get("manifest", {}).items() if k not in touched}
        state.put("manifest", {**kept, **places})
    if listings is not None:
        done = [k for k, s in status.items() if s in (SourceStatus.COMPLETE, SourceStatus.UNCHANGED)]
        former = state.load("fingerprints", _PRINTS)
        if any(s is SourceStatus.COMPLETE for s in status.values()):
            now = fingerprint(listings).where(F.col("kind").isin(*done))
            state.save("fingerprints", now.unionByName(former.where(~F.col("kind").isin(*done))))
    return status
