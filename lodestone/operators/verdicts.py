"""Labels of screenshots by a pluggable classifier: targets, resumable batches, verdict lines, and what may be offered for removal."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.runtime import spread

LABELS = ("impersonal", "personal", "ambiguous")
#: A classifier: texts in, one label per text out; a missing or unknown label counts as ambiguous, so that it is kept.
Classifier = Callable[[list[str]], list]


_PRICE = re.compile(r"[0-9][.,][0-9][0-9]")


def rule_classifier(texts: list[str]) -> list[str]:
    """Stand-in without a model: a text with a link or a price tells of things, one with first-person words of a person."""
    out = []
    for t in map(str.lower, texts):
        words = set(t.split())
        personal = bool(words & {"i", "me", "my", "you", "jag", "mig", "min", "du", "dig", "vi", "we", "love", "älskar"})
        thing = "http" in t or "www." in t or bool(_PRICE.search(t))
        out.append("impersonal" if thing and not personal else "personal" if personal else "ambiguous")
    return out


def object_bodies(chunks: DataFrame, kind: str = "screenshot", most: int = 1200) -> DataFrame:
    """(uuid, body): per object the chunks' text in order without its head of name and labels, cut at `most` characters."""
    rows = chunks.where(F.col("source_kind") == kind).select("source_id", "chunk_idx", "text").distinct()
    full = rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda r: r["text"]), " ").alias("full"))
    body = X.strip(F.regexp_replace("full", r"^\S+\s*\[[^\]]*\]", ""))
    return full.select(F.upper(F.element_at(F.split("source_id", "photo:"), -1)).alias("uuid"), F.substring(body, 1, most).alias("body"))


def targets(listed: DataFrame, bodies: DataFrame) -> DataFrame:
    """(uuid, body) of every listed uuid, case aside; empty where no text is known. Null uuids are left out, repeated ones count once."""
    own = listed.where(F.col("uuid").isNotNull()).select(F.upper("uuid").alias("uuid")).distinct()
    return own.join(bodies.groupBy("uuid").agg(F.min("body").alias("body")), "uuid", "left").select("uuid", F.coalesce("body", F.lit("")).alias("body"))


def pending(wanted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The targets without a verdict yet."""
    return wanted.join(verdicts.select(F.upper("uuid").alias("uuid")).distinct(), "uuid", "left_anti")


def label(wanted: DataFrame, classifier: Classifier = rule_classifier, batch: int = 25) -> DataFrame:
    """(uuid, label) of targets, classified in batches; labels that the classifier leaves out or invents are ambiguous, as are batches that fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            labels: list[str] = []
            bodies = [t or "(no text)" for t in b["body"]]
            for at in range(0, len(bodies), batch):
                part = bodies[at : at + batch]
                try:
                    got = list(classifier(part))
                except Exception:
                    got = []
                labels += [y if y in LABELS else "ambiguous" for y in (got + [None] * len(part))[: len(part)]]
            yield pd.DataFrame({"uuid": b["uuid"], "label": labels})

    return spread(wanted.select("uuid", "body")).mapInPandas(run, "uuid string, label string")


def append(rows: DataFrame, path: str) -> None:
    """Verdict lines added to the JSON lines at path, stamped with the run's time so that the last verdict of a uuid can be told."""
    rows.select("uuid", "label", F.current_timestamp().cast("string").alias("at")).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, label, at) of verdict lines; none where nothing has been written yet, unreadable lines skipped."""
    schema = "uuid string, label string, at string"
    try:
        return spark.read.schema(schema).json(path).where("uuid is not null")
    except Exception as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        return spark.createDataFrame([], schema)


def last(verdicts: DataFrame) -> DataFrame:
    """(uuid, label): the last verdict of each uuid by its time, then label."""
    by = Window.partitionBy("uuid").orderBy(F.desc_nulls_last("at"), F.desc("label"))
    return verdicts.select(F.upper("uuid").alias("uuid"), "label", "at").withColumn("_r", F.row_number().over(by)).where("_r = 1").select("uuid", "label")


def removable(verdicts: DataFrame, kept: DataFrame) -> DataFrame:
    """(uuid) whose last verdict is impersonal, without those listed in kept (uuid), of which no other copy exists."""
    return last(verdicts).where("label = 'impersonal'").join(kept.select(F.upper("uuid").alias("uuid")).distinct(), "uuid", "left_anti").select("uuid")


def counts(verdicts: DataFrame) -> DataFrame:
    """(label, n) over the last verdicts."""
    return last(verdicts).groupBy("label").agg(F.count("*").alias("n"))
