"""Small state between runs (fingerprints, offsets, retry lists, the store's manifest): written whole, then switched by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class StateStore:
    """Named tables and notes below a folder that all runs share. A reader sees the last complete one; a run that dies leaves the former."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, name: str, value) -> None:
        """A value as JSON: written beside, then renamed over the former."""
        jvm = self.spark.sparkContext._jvm
        aside, fs = self._fs(f"{self.path}/{name}.{uuid.uuid4().hex}.tmp")
        target, _ = self._fs(f"{self.path}/{name}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), overwrite)

    def get(self, name: str, default=None):
        path, fs = self._fs(f"{self.path}/{name}.json")
        if not fs.exists(path):
            return default
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}.json").collect()))

    def save(self, name: str, rows: DataFrame) -> str:
        """rows as the table `name` from now on; returns where it lies. Earlier versions stay until they are cleaned."""
        place = f"{self.path}/{name}/v={uuid.uuid4().hex}"
        rows.write.parquet(place)
        self.put(name, {"place": place, "schema": rows.schema.json()})
        return place

    def load(self, name: str, schema: str) -> DataFrame:
        """The table `name`, empty with that schema before it was first saved."""
        known = self.get(name)
        return self.spark.createDataFrame([], schema) if known is None else self.spark.read.schema(schema).parquet(known["place"])
