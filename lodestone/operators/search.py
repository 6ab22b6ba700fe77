"""Keyword and vector retrieval fused by weighted reciprocal ranks, for any number of queries in one plan.

A query set is (qid, q[, kinds, projects][, vector]); every layer keeps its best rows per query as (qid, id, rank), layers are summed
by id, and text is fetched only for what is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.runtime import BROADCAST_ROWS, small, spread, table_cut
from lodestone.schema import DEFAULT, PROJECT_KINDS, Config


POSTINGS = "term string, id string, source_kind string, project string, tf bigint"
#: Query terms that are pushed into the index scan as literals, and queries that one pass over the rows takes, at most.
LITERALS, BLOCK = 200, 5000


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, source_kind, project, tf): the inverted index over title and text; one row per distinct id and term.

    Null ids are left out, a null title or text counts as empty; versions of one id: one is indexed. Written sorted by term
    (write_postings), equality and prefix filters prune row groups.
    """
    rows = chunks.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    terms = F.explode(X.tokens(F.concat_ws(" ", "title", "text")))
    return rows.select("id", "source_kind", "project", terms.alias("term")).groupBy("term", "id", "source_kind", "project").agg(F.count("*").alias("tf"))


def write_postings(index: DataFrame, path: str, files: int | None = None) -> None:
    """The index as parquet, range-partitioned and sorted by term, so that filters on terms and their beginnings skip row groups."""
    ranged = index.repartitionByRange(files, "term", "id") if files else index.repartitionByRange("term", "id")
    ranged.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """An index that write_postings stored, for search(index=...)."""
    return spark.read.schema(POSTINGS).parquet(path)


def _of_terms(index: DataFrame, wanted: DataFrame, column: str, prefix_chars: int | None = None) -> DataFrame:
    """The index narrowed by literals to the wanted terms, or to terms that begin like them; as it is where there are more than LITERALS."""
    few = [r[0] for r in wanted.select(column).distinct().limit(LITERALS + 1).collect()]
    if len(few) > LITERALS or not few:
        return index if few else index.where(F.lit(False))
    exact = [t for t in few if prefix_chars is None or len(t) < prefix_chars]
    ok = F.col("term").isin(*exact) if exact else F.lit(False)
    for t in few:
        if prefix_chars is not None and len(t) >= prefix_chars:
            ok = ok | F.startswith("term", F.lit(t))
    return index.where(ok)


def in_scope(kind: Column, project: Column, kinds: Column | None, projects: Column | None) -> Column:
    """Whether a row is of the kinds and projects asked for; a null list asks for all."""
    ok = F.lit(True)
    if kinds is not None:
        ok = ok & (kinds.isNull() | F.coalesce(F.array_contains(kinds, kind), F.lit(False)))
    if projects is not None:
        ok = ok & (projects.isNull() | F.coalesce(F.array_contains(projects, project), F.lit(False)))
    return ok


def _scope_of(queries: DataFrame) -> tuple[DataFrame, list[str]]:
    own = [c for c in ("kinds", "projects") if c in queries.columns]
    return queries, own


def _scoped(joined: DataFrame, own: list[str]) -> DataFrame:
    return joined.where(in_scope(F.col("source_kind"), F.col("project"), F.col("kinds") if "kinds" in own else None, F.col("projects") if "projects" in own else None))


def _best(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """rank within keys by order, of which Spark keeps the first `most` before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def strict_layer(index: DataFrame, queries: DataFrame, most: int = DEFAULT.keyword_limit) -> DataFrame:
    """(qid, id, rank, kwscore): rows that hold all tokens of the query, by summed term frequency; a query without token finds nothing."""
    queries, own = _scope_of(queries)
    terms = queries.withColumn("terms", F.array_distinct(X.tokens(F.col("q")))).where(F.size("terms") > 0)
    wanted = small(terms.select("qid", *own, F.size("terms").alias("n"), F.explode("terms").alias("term")))
    hits = _scoped(_of_terms(index, terms.select(F.explode("terms").alias("term")), "term").join(wanted, "term"), own).groupBy("qid", "id", "n").agg(F.count("*").alias("met"), F.sum("tf").alias("kwscore")).where("met = n")
    return _best(hits, ["qid"], [F.desc("kwscore"), F.col("id")], most).select("qid", "id", "rank", "kwscore")


def soft_layer(index: DataFrame, queries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(qid, term, id, rank, kwscore): per soft term the best rows, all terms and queries in one job.

    Terms of prefix_chars letters match as prefixes, joined on those letters; with None all match as whole terms. All matches are ranked;
    no candidate cap is needed.
    """
    queries, own = _scope_of(queries)
    n = config.prefix_chars
    stem = lambda c: F.substring(c, 1, n) if n else F.col(c)
    wanted = small(queries.select("qid", *own, F.explode(X.soft_terms(F.col("q"), config.soft_terms)).alias("want")).withColumn("stem", stem("want")))
    joined = _of_terms(index, wanted, "want", n).withColumn("stem", stem("term")).join(wanted, "stem")
    same = F.col("term") == F.col("want")
    match = F.when(F.length("want") >= n, F.startswith("term", F.col("want"))).otherwise(same) if n else same
    hits = _scoped(joined.where(match), own).groupBy("qid", "want", "id").agg(F.sum("tf").alias("kwscore"))
    return _best(hits, ["qid", "want"], [F.desc("kwscore"), F.col("id")], config.soft_rows).select("qid", F.col("want").alias("term"), "id", "rank", "kwscore")


def _blocks(queries: DataFrame, columns: list[str], size: int | None = None) -> Iterator[list[Row]]:
    """The stated queries in blocks of BLOCK by qid, so that what a pass holds is bounded whatever their number."""
    size = size or BLOCK
    n = queries.count()
    if n <= size:
        if n:
            yield queries.select(*columns).orderBy("qid").collect()
        return
    numbered = table_cut(queries.select(*columns, (F.row_number().over(Window.orderBy("qid")) - 1).alias("_k")))
    for k in range(0, n, size):
        yield numbered.where((F.col("_k") >= k) & (F.col("_k") < k + size)).drop("_k").orderBy("qid").collect()


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def containing(rows: DataFrame, needles: DataFrame, text: Column, keep: list[str], size: int = 300) -> DataFrame:
    """(qid, *keep): the rows whose text holds a query's needle (qid, needle[, kinds, projects]) literally; rows out of a query's scope don't count.

    The needles of a block are literals of the scan, so no row is paired with a query that it doesn't meet.
    """
    own = [c for c in ("kinds", "projects") if c in needles.columns]
    qtype, parts = needles.schema["qid"].dataType, []
    for block in _blocks(needles, ["qid", "needle", *own], size):
        wanted = F.array(*[F.struct(F.lit(r["qid"]).cast(qtype).alias("qid"), F.lit(r["needle"]).alias("needle"), *[(F.array(*[F.lit(v) for v in r[c]]) if r[c] is not None else F.lit(None)).cast("array<string>").alias(c) for c in own]) for r in block])
        met = F.filter(wanted, lambda w: in_scope(F.col("source_kind"), F.col("project"), w["kinds"] if "kinds" in own else None, w["projects"] if "projects" in own else None) & F.contains(F.col("_text"), w["needle"]))
        parts.append(rows.withColumn("_text", text).select(*keep, F.explode(met).alias("_met")).select("_met.qid", *keep))
    return _union(parts, rows.sparkSession, f"qid {qtype.simpleString()}, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep))


def exact_layer(chunks: DataFrame, queries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(qid, id, rank): rows whose text holds the query literally, case aside, shortest first; only queries of 1 to exact_terms terms.

    The query set is held against every row of the scan, as substrings have no key to join on.
    """
    queries, own = _scope_of(queries)
    terms = F.size(X.query_terms(F.col("q")))
    wanted = queries.where(terms.between(1, config.exact_terms)).select("qid", *own, F.lower(X.strip(F.col("q"))).alias("needle"))
    rows = spread(chunks.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "source_kind", "project", "text")).withColumn("len", F.length("text"))
    hits = containing(rows, wanted, F.lower("text"), ["id", "len"]).distinct()
    return _best(hits, ["qid"], [F.col("len"), F.col("id")], config.exact_limit).select("qid", "id", "rank")


def _nearest(ids: list, matrix: np.ndarray, most: int, scopes: list[tuple] | None = None, own: list[str] | None = None) -> Callable:
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    unit = matrix / np.where(norm > 0, norm, 1)[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["vec"].tolist(), dtype=np.float64)
            size = np.sqrt((x * x).sum(axis=1))
            s = (x / np.where(size > 0, size, 1)[:, None]) @ unit.T
            out = []
            for k, qid in enumerate(ids):
                mine = s[:, k]
                for c, allowed in zip(own or [], scopes[k] if scopes else ()):
                    if allowed is not None:
                        mine = np.where(b["source_kind" if c == "kinds" else "project"].isin(allowed), mine, -2.0)
                keep = min(most, int((mine > -2).sum()))
                if keep:
                    # ties with the last kept row stay, so that the order by id can settle them
                    edge = np.partition(mine, len(b) - keep)[len(b) - keep]
                    at = np.flatnonzero(mine >= edge - 1e-12)
                    out.append(pd.DataFrame({"qid": qid, "id": b["id"].to_numpy()[at], "sem": s[at, k]}))
            if out:
                yield pd.concat(out)

    return run


def vector_layer(rows: DataFrame, queries: DataFrame, most: int = DEFAULT.semantic_limit, id_col: str = "id", vec_col: str = "embedding", dim: int = 64, digits: int = 9) -> DataFrame:
    """(qid, id, rank, sem): exact cosine in double precision of the query vectors (qid, vector) to all rows, the best `most` each.

    Rows without a vector of `dim` finite values take no part; a zero vector has similarity 0. Queries are held against all rows in
    blocks; each batch of rows sends on only its best, and similarities are rounded to `digits` before they are compared. Queries with
    kinds or projects see the rows of these only.
    """
    own = [c for c in ("kinds", "projects") if c in queries.columns]
    qtype, kind = queries.schema["qid"].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()
    schema = f"qid {qtype}, id {kind}, sem double"
    vec = F.col(vec_col)
    fine = (F.size(vec) == dim) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scope = ["source_kind", "project"] if own else []
    usable = rows.where(F.col(id_col).isNotNull() & vec.isNotNull()).where(fine).select(F.col(id_col).alias("id"), vec.alias("vec"), *scope)
    parts = []
    for block in _blocks(queries.where(F.size("vector") == dim), ["qid", "vector", *own]):
        matrix = np.array([r["vector"] for r in block], dtype=np.float64).reshape(len(block), dim)
        scopes = [tuple(None if r[c] is None else set(r[c]) for c in own) for r in block] if own else None
        parts.append(usable.mapInPandas(_nearest([r["qid"] for r in block], matrix, most, scopes, own), schema))
    near = _union(parts, rows.sparkSession, schema).withColumn("sem", F.round("sem", digits)).distinct()
    return _best(near, ["qid"], [F.desc("sem"), F.col("id")], most).select("qid", "id", "rank", "sem")


def rrf(rank: Column, k: int = DEFAULT.rrf_k) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def fuse(chunks: DataFrame, exact: DataFrame | None, strict: DataFrame | None, soft: DataFrame | None, semantic: DataFrame | None, as_of: str, limit: int = 12, config: Config = DEFAULT, most: int | None = None) -> DataFrame:
    """(qid, rank, id, source_id, source_kind, project, title, created, updated, score, sem, exact, kw): layers summed by id, recency for
    project records added, one hit per source object, the best `limit` per query. kw: whether a keyword layer found it.

    most: how many fused rows there can be at most, by the layers' limits; up to BROADCAST_ROWS they are broadcast to the payload.
    """
    parts = []
    none = F.lit(None).cast("double")
    if exact is not None:
        parts.append(exact.select("qid", "id", (config.weight_exact * rrf(F.col("rank"))).alias("part"), none.alias("sem"), F.lit(True).alias("exact"), F.lit(True).alias("kw")))
    if strict is not None:
        parts.append(strict.select("qid", "id", (config.weight_strict * rrf(F.col("rank"))).alias("part"), none.alias("sem"), F.lit(False).alias("exact"), F.lit(True).alias("kw")))
    if soft is not None:
        parts.append(soft.select("qid", "id", (config.weight_soft * rrf(F.col("rank"))).alias("part"), none.alias("sem"), F.lit(False).alias("exact"), F.lit(True).alias("kw")))
    if semantic is not None:
        parts.append(semantic.select("qid", "id", (config.weight_semantic * rrf(F.col("rank"))).alias("part"), F.col("sem").cast("double"), F.lit(False).alias("exact"), F.lit(False).alias("kw")))
    layers = parts[0]
    for p in parts[1:]:
        layers = layers.unionByName(p)
    fused = layers.groupBy("qid", "id").agg(F.sum("part").alias("part"), F.max("sem").alias("sem"), F.bool_or("exact").alias("exact"), F.bool_or("kw").alias("kw"))
    updated = F.col("updated") if "updated" in chunks.columns else F.lit("")
    payload = chunks.select("id", "source_id", "source_kind", "project", "title", "created", updated.alias("updated"))
    fresh = F.when(F.col("source_kind").isin(*PROJECT_KINDS), config.recency_weight * X.recency(F.col("created"), F.lit(as_of).cast("date"), config.recency_days)).otherwise(0.0)
    score = F.round(F.col("part") + F.when(F.col("exact"), config.exact_bonus).otherwise(0.0) + fresh, 9)
    fused = F.broadcast(fused) if most is not None and most <= BROADCAST_ROWS else fused
    scored = payload.join(fused, "id").withColumn("score", score)
    order = [F.desc("score"), F.desc(F.coalesce("sem", F.lit(0.0))), F.col("id")]
    # repeated rows of an id fall to this ranking too, so the payload needs no distinct of its own
    one = _best(scored, ["qid", "source_id"], order, 1).drop("rank")
    return _best(one, ["qid"], order, limit).select("qid", "rank", "id", "source_id", "source_kind", "project", "title", "created", "updated", "score", "sem", "exact", "kw")


def search(chunks: DataFrame, queries: DataFrame, index: DataFrame | None = None, as_of: str = "2026-01-01", keyword_only: bool = False, limit: int = 12, config: Config = DEFAULT) -> DataFrame:
    """The hybrid search of every query; without a vector column in queries, or with keyword_only, by keywords alone."""
    index = postings(chunks) if index is None else index
    semantic = vector_layer(chunks, queries, config.semantic_limit) if "vector" in queries.columns and not keyword_only else None
    most = queries.count() * (config.exact_limit + config.keyword_limit + config.soft_terms * config.soft_rows + config.semantic_limit)
    return fuse(chunks, exact_layer(chunks, queries, config), strict_layer(index, queries, config.keyword_limit), soft_layer(index, queries, config), semantic, as_of, limit, config, most)


def linear_scan(rows: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """(qid, id, score, rank): the simpler scorer: cosine plus 0.3 if every blank-separated term is in text or title; kept above 0.15
    or with a keyword match. Rows (id, title, text, embedding), queries (qid, q, vector); a query without a term finds nothing."""
    wanted = queries.where(X.strip(F.col("q")) != "").select("qid", F.split(F.lower(X.strip(F.col("q"))), r"\s+").alias("terms"), F.col("vector").cast("array<double>").alias("v"))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    blob = F.lower(F.concat_ws("\n", "title", "text"))
    plain = rows.select("id", blob.alias("blob"), F.col("embedding").alias("e"))
    parts = [plain.mapInPandas(_scorer([(r["qid"], r["terms"], r["v"]) for r in block]), schema) for block in _blocks(wanted, ["qid", "terms", "v"])]
    kept = _union(parts, rows.sparkSession, schema).withColumn("score", F.round("score", 9))
    return _best(kept, ["qid"], [F.desc("score"), F.col("id")], most)


def _scorer(queries: list[tuple]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blobs, vectors, out = b["blob"].tolist(), b["e"].tolist(), []
            for qid, terms, v in queries:
                kw = np.array([all(t in blob for t in terms) for blob in blobs], dtype=bool)
                cos = np.array([_cosine(e, v) for e in vectors], dtype=np.float64)
                at = np.flatnonzero((cos > 0.15) | kw)
                out.append(pd.DataFrame({"qid": qid, "id": b["id"].to_numpy()[at], "score": cos[at] + 0.3 * kw[at]}))
            if out:
                yield pd.concat(out)

    return run


def _cosine(a, b) -> float:
    if a is None or b is None or not len(a) or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / size) if size > 0 else 0.0


def with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the full text of each: the few rows left meet the table once; of repeated rows of an id the least text counts."""
    own = hits.select("id").distinct()
    texts = chunks.join(small(own), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return hits.join(texts, "id", "left")


def snippet(text: Column, query: Column, width: int = 160) -> Column:
    """A window of the text around the first query term that it holds, on one line."""
    lower = F.lower(text)
    places = F.filter(F.transform(X.query_terms(query), lambda t: F.instr(lower, t)), lambda p: p > 0)
    start = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - width // 4)
    return F.regexp_replace(F.substr(text, start, F.lit(width)), r"\s+", " ")


#: Words of a headline's fragment, least and most, and its fragments at most.
FRAGMENT_WORDS, FRAGMENTS = (14, 32), 3


def headline_of(text: str, terms: set[str]) -> str:
    """Up to FRAGMENTS fragments of the text around words of the query, which are marked «so», parted by ` … `; without such a word the
    text's first words. A fragment starts a third of its length before its first marked word and ends with the last that fits."""
    least, most = FRAGMENT_WORDS
    words = text.split()
    hits = [k for k, w in enumerate(words) if terms.intersection(_HEADLINE_WORD.findall(w.lower()))]
    if not hits:
        return " ".join(words[:least])
    marked, spans, at = set(hits), [], 0
    for k in hits:
        if k < at:
            continue
        if len(spans) == FRAGMENTS:
            break
        start = max(at, k - most // 3)
        inside = [h for h in hits if k <= h < start + most]
        stop = min(len(words), max(start + least, inside[-1] + 1 + (most // 3 if inside[-1] + 1 + most // 3 <= start + most else 0)))
        start = max(at, min(start, stop - least))
        spans.append((start, stop))
        at = stop
    return " … ".join(" ".join(f"«{words[k]}»" if k in marked else words[k] for k in range(a, b)) for a, b in spans)


_HEADLINE_WORD = re.compile(r"[^\W_]+")


def headlines(hits: DataFrame, queries: DataFrame, most: int = 500) -> DataFrame:
    """hits (qid, text, ...) with snippet: the headline of each text for all words of its query, at most `most` characters."""

    def run(text: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([headline_of(t or "", set(_HEADLINE_WORD.findall((w or "").lower())))[:most] for t, w in zip(text, q)])

    made = F.pandas_udf(run, "string")
    return hits.join(small(queries.select("qid", F.col("q").alias("_q"))), "qid").withColumn("snippet", made(F.col("text"), F.col("_q"))).drop("_q")


def to_jsonl(hits: DataFrame) -> DataFrame:
    """(line): each hit as one JSON object (rank, source, created, updated, project, title, sem, kw, snippet, id and qid); empty strings are
    left out, as is a snippet that hits don't have; no hit gives no line."""
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    shown = [F.substring(F.replace("snippet", F.lit("\n"), F.lit(" ")), 1, 500).alias("snippet")] if "snippet" in hits.columns else []
    fields = F.struct("qid", "rank", F.col("source_kind").alias("source"), blank("created").alias("created"), blank("updated").alias("updated"), blank("project").alias("project"), blank("title").alias("title"), F.round(F.coalesce("sem", F.lit(0.0)), 3).alias("sem"), "kw", *shown, "id")
    return hits.select(F.to_json(fields).alias("line"))
