"""Mixed timestamp formats and zones -> one unambiguous form, through a dictionary of distinct raw values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.instants import PLAIN_DAY, normalise
from lodestone.functions.runtime import small, table_cut

_KEY = ["raw", "tz_name", "day_first"]
_SCHEMA = "raw string, tz_name string, day_first boolean, norm_value string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["norm_value"] = [normalise(r, z, d) for r, z, d in zip(b["raw"], b["tz_name"], b["day_first"])]
        yield b[[*_KEY, "norm_value"]]


def parse_dictionary(keys: DataFrame, known_path: str | None = None) -> DataFrame:
    """(raw, tz_name, day_first) -> norm_value for each distinct key.

    With known_path, a parquet table of earlier results: only keys absent from it are parsed, and they are appended to it.
    """
    keys = keys.select(*_KEY).distinct()
    if known_path is None:
        return keys.mapInPandas(_parse, _SCHEMA)
    spark = keys.sparkSession
    try:
        known = spark.read.schema(_SCHEMA).parquet(known_path)
        fresh = keys.join(known, [keys[c].eqNullSafe(known[c]) for c in _KEY], "left_anti")
    except Exception as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        fresh = keys
    fresh = table_cut(fresh.mapInPandas(_parse, _SCHEMA))
    fresh.write.mode("append").parquet(known_path)
    return spark.read.schema(_SCHEMA).parquet(known_path)


def normalised_instants(rows: DataFrame, clock: DataFrame, columns: tuple[str, ...] = ("created", "updated"), id_col: str = "id", known_path: str | None = None) -> DataFrame:
    """(id, col_name, norm_value): one row per id and column whose value is neither null, empty nor already a plain day and denotes an instant or day.

    rows needs id_col, source_kind and the columns; other columns are ignored. clock has (source_kind, tz_name, day_first); where
    it repeats a kind, the least row counts, and a kind it lacks is read as UTC, day first. Repeated rows give one result, null ids
    none. Hot values meet the dictionary in a map-side distinct first; the join back is left to adaptive skew handling, as the
    dictionary has one row per key.
    """
    clock = clock.groupBy(F.col("source_kind").alias("_kind")).agg(F.min(F.struct("tz_name", "day_first")).alias("c"))
    clock = small(clock.select("_kind", F.col("c.tz_name").alias("tz_name"), F.col("c.day_first").alias("day_first")))
    # columns = repeated id rows carry the same values, so a map-side distinct on the result is enough
    values = (
        rows.select(F.col(id_col).alias("id"), F.col("source_kind").alias("_kind"), F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("raw")) for c in columns])).alias("v"))
        .select("id", "_kind", "v.col_name", "v.raw")
        .where(F.col("id").isNotNull() & F.col("raw").isNotNull() & F.col("raw").rlike(r"\S") & ~F.col("raw").rlike(PLAIN_DAY))
        .join(clock, "_kind", "left")
        .select("id", "col_name", "raw", F.coalesce("tz_name", F.lit("UTC")).alias("tz_name"), F.coalesce("day_first", F.lit(True)).alias("day_first"))
        .distinct()
    )
    known = parse_dictionary(values, known_path).where(F.col("norm_value").isNotNull())
    return values.join(known, _KEY).select("id", "col_name", "norm_value")
