"""Photo library tables: originals that exist, and text read from images through a cache that lasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.runtime import spread, table_cut

#: Reads the text of an image: path -> text.
Reader = Callable[[str], str]


def originals(assets: DataFrame, files: DataFrame) -> DataFrame:
    """assets (uuid, ...) with the file of each: of the rows (uuid, file, error) those without an error whose file is in `present`, else null.
    Several files of a uuid: the least counts; uuids meet case aside."""
    good = files.where(F.col("error").isNull() & F.col("present") & F.col("file").isNotNull()).groupBy(F.upper("uuid").alias("_u")).agg(F.min("file").alias("file"))
    return assets.join(good, F.upper(assets["uuid"]) == F.col("_u"), "left").drop("_u")


def read_texts(spark: SparkSession, images: DataFrame, reader: Reader, cache: str) -> DataFrame:
    """(path, text) of images (path): what the cache (parquet at `cache`) has is taken from it, the rest read once and added to it.

    An image that can't be read has an empty text, and that is cached too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for path in b["path"]:
                try:
                    texts.append(reader(path) or "")
                except Exception:
                    texts.append("")
            yield pd.DataFrame({"path": b["path"], "text": texts})

    schema = "path string, text string"
    try:
        known = spark.read.schema(schema).parquet(cache)
    except Exception as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        known = spark.createDataFrame([], schema)
    wanted = images.select("path").where("path is not null").distinct()
    fresh = table_cut(spread(wanted.join(known, "path", "left_anti")).mapInPandas(run, schema))
    fresh.write.mode("append").parquet(cache)
    return wanted.join(known.unionByName(fresh).groupBy("path").agg(F.max("text").alias("text")), "path")


def without_cached(assets: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """assets that the cache has no row for."""
    return assets.join(cache.select(key).distinct(), key, "left_anti")
