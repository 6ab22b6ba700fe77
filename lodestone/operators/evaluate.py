"""Known-item evaluation: expectations, first relevant rank, recall, reciprocal rank, latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.runtime import small


def matches(blob: Column, fields: dict[str, Column], expectation: Column) -> Column:
    """Whether a result meets an expectation struct<text, fields: map>: the text within the lower-cased blob and every named field's
    value within that field; an empty expectation is met by nothing."""
    named = F.coalesce(F.map_entries(expectation["fields"]), F.array().cast("array<struct<key:string,value:string>>"))
    lookup = F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), F.lower(F.coalesce(c, F.lit(""))))])
    text_ok = expectation["text"].isNull() | F.contains(F.lower(blob), F.lower(expectation["text"]))
    fields_ok = F.forall(named, lambda e: F.coalesce(F.contains(F.try_element_at(lookup, e["key"]), F.lower(e["value"])), F.lit(False)))
    return text_ok & fields_ok & (expectation["text"].isNotNull() | (F.size(named) > 0))


def matches_any(blob: Column, fields: dict[str, Column], expectations: Column) -> Column:
    """Whether a result meets one of a list of expectations; an empty or null list is met by nothing."""
    return F.coalesce(F.exists(expectations, lambda e: matches(blob, fields, e)), F.lit(False))


def judge(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """hits (qid, id, source_kind, project, title, text, created, ...) that meet one of their case's expectations (qid, expectations)."""
    names = {c: F.col(c) for c in ("id", "source_kind", "project", "title", "text", "created")}
    blob = F.concat_ws("\n", *names.values())
    return hits.join(small(cases.select("qid", "expectations")), "qid").where(matches_any(blob, names, F.col("expectations"))).drop("expectations")


def hit_ranks(results: DataFrame, relevant: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, first_rank) of every case: the least rank of a relevant (qid, id) among results (qid, id, rank), null without one."""
    first = results.join(relevant.select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return cases.select("qid").distinct().join(first, "qid", "left")


def metrics(ranks: DataFrame, k: int = 10) -> DataFrame:
    """One row (n, recall_at_k, mrr) over (qid, first_rank)."""
    hit = (F.col("first_rank") <= k).cast("double")
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(hit, F.lit(0.0))), 9).alias("recall_at_k"), F.round(F.avg(F.coalesce(F.when(F.col("first_rank") <= k, 1.0 / F.col("first_rank")), F.lit(0.0))), 9).alias("mrr"))


def nearest_rank(values: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """One row (value): the element at the half-even rounded index (n - 1) * share of the sorted values; for few values, as latencies are."""
    ordered = values.where(F.col(column).isNotNull()).agg(F.array_sort(F.collect_list(column)).alias("v"))
    at = (F.bround((F.size("v") - 1) * share) + 1).cast("int")
    return ordered.select(F.when(F.size("v") > 0, F.try_element_at("v", F.greatest(at, F.lit(1)))).alias("value"))


def latency(values: DataFrame, column: str = "ms") -> DataFrame:
    """One row (latency_ms_avg, latency_ms_p95) of measured milliseconds, rounded to a tenth; zeros without a value."""
    mean = values.agg(F.round(F.coalesce(F.avg(column), F.lit(0.0)), 1).alias("latency_ms_avg"))
    top = nearest_rank(values, column).select(F.round(F.coalesce("value", F.lit(0.0)), 1).alias("latency_ms_p95"))
    return mean.join(top)
