"""Command line over a chunk store: search (also the default verb), ingest, stats, embed, eval, chunks.

Called as ccsearch (or with LODESTONE_INVOKED_AS=ccsearch) a search without kinds is one over the records of projects.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import classify, embedding, evaluate, search, stats, store
from lodestone.operators.chunkers import _size, code_chunks
from lodestone.operators.store import SourceStatus
from lodestone.plans.ingest import ingest, read_store
from lodestone.schema import KINDS, PROJECT_KINDS
from lodestone.sources import files, readers

FLAGS = {"session": "-s", "doc": "-d", "messenger": "-m", "aichat": "-a", "note": None, "email": "-e", "things3": "-t", "fyr": "-f", "screenshot": "-p", "git_commit": "-g", "code": "-c"}
LONG = {"screenshot": "--photos", "git_commit": "--git"}
VERBS = ("search", "ingest", "stats", "embed", "eval", "chunks")


def _search_options(s: argparse.ArgumentParser) -> None:
    s.add_argument("-k", "--keyword", action="store_true")
    s.add_argument("-n", "--limit", type=int, default=12)
    s.add_argument("-P", "--project", "--repo", nargs="*", action="extend")
    s.add_argument("--as-of", default=time.strftime("%Y-%m-%d"))
    s.add_argument("--index", help="folder of a stored index; without it the store is indexed for the call")
    s.add_argument("--pretty", action="store_true")
    for kind, short in FLAGS.items():
        s.add_argument(*[o for o in (short, LONG.get(kind, f"--{kind}")) if o], dest="kinds", action="append_const", const=kind)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="verb", required=True)
    s = sub.add_parser("search")
    s.add_argument("store")
    s.add_argument("query", nargs="+")
    _search_options(s)
    i = sub.add_parser("ingest", help="bring a store up to date from folders of exports")
    i.add_argument("store")
    i.add_argument("--sources", nargs="*", required=True, metavar="KIND=PATH")
    i.add_argument("--allow-empty", action="store_true")
    v = sub.add_parser("stats")
    v.add_argument("store")
    m = sub.add_parser("embed")
    m.add_argument("store")
    m.add_argument("target", help="folder of the new store version")
    m.add_argument("--limit", type=int, default=0, help="pending chunks to embed in this run, at most; 0 for all")
    m.add_argument("--classes", help="parquet of (mid, mail_class); mails of skipped classes stay without a vector")
    m.add_argument("--url", help="embedding endpoint; without it a stand-in is used")
    m.add_argument("--dim", type=int, default=64)
    e = sub.add_parser("eval")
    e.add_argument("store")
    e.add_argument("--file", required=True, help="JSON list of cases: query, must_match or expected, scope, project or repo")
    e.add_argument("-k", type=int, default=10)
    e.add_argument("--keyword", action="store_true")
    e.add_argument("--json", action="store_true")
    e.add_argument("--show-top", action="store_true")
    e.add_argument("--index")
    e.add_argument("--as-of", default=time.strftime("%Y-%m-%d"))
    c = sub.add_parser("chunks", help="show how source files are cut")
    c.add_argument("files", nargs="+")
    return p


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store at path: one with a manifest, or a plain folder of chunk rows."""
    chunks = read_store(spark, path)
    try:
        return chunks if chunks.inputFiles() else spark.read.parquet(path)
    except Exception as why:
        if "UNABLE_TO_INFER_SCHEMA" not in str(why) and "PATH_NOT_FOUND" not in str(why):
            raise
        return chunks


def _readers(named: list[str]) -> dict:
    def complete(read):
        return lambda spark: (read(spark), SourceStatus.COMPLETE)

    out = {}
    for kind, _, path in (n.partition("=") for n in named):
        made = {
            "messenger": lambda s, p=path: readers.messenger(s, p), "note": lambda s, p=path: readers.notes(s, p, f"{p.rstrip('/')}/notes.json"), "doc": lambda s, p=path: files.documents_of(s, [files.Root(p)]),
            "session": lambda s, p=path: readers.sessions(s, p.split(",")), "email": lambda s, p=path: readers.mbox(s, p), "git_commit": lambda s, p=path: readers.git_commits(s, p),
            "code": lambda s, p=path: readers.code_files(s, p, os.path.basename(p.rstrip("/"))), "aichat": lambda s, p=path: readers.chats_by_list(s, p),
        }
        if kind not in made:
            raise SystemExit(f"no reader for {kind}; there are {', '.join(sorted(made))}")
        out[kind] = complete(made[kind])
    return out


def run_eval(chunks: DataFrame, cases: DataFrame, index: DataFrame | None, as_of: str, k: int, keyword: bool) -> dict:
    """Recall, reciprocal rank and latency over cases (qid, query, kinds, projects, expectations), each searched by itself for its time."""
    spark, rows = chunks.sparkSession, []
    for case in cases.orderBy("qid").collect():
        q = spark.createDataFrame([(case["qid"], case["query"], case["kinds"], case["projects"])], "qid int, q string, kinds array<string>, projects array<string>")
        start = time.perf_counter()
        hits = search.search(chunks, q, index, as_of, keyword_only=True, limit=k) if keyword else search.search(chunks, _with_vectors(q), index, as_of, limit=k)
        found = search.with_text(hits, chunks).orderBy("rank").collect()
        spent = (time.perf_counter() - start) * 1000
        shown = spark.createDataFrame([r.asDict() for r in found], hits.schema.add("text", "string")) if found else None
        rank = evaluate.judge(shown, cases.where(F.col("qid") == case["qid"])).agg(F.min("rank")).first()[0] if found else None
        rows.append({"query": case["query"], "hit": rank is not None, "rank": rank, "latency_ms": round(spent, 1), "top": [r["title"] for r in found[:3]]})
    ms = spark.createDataFrame([(r["latency_ms"],) for r in rows] or [], "ms double")
    n = max(1, len(rows))
    return {"cases": len(rows), f"recall@{k}": sum(r["hit"] for r in rows) / n, "mrr": sum(1 / r["rank"] for r in rows if r["rank"]) / n, **evaluate.latency(ms).first().asDict(), "rows": rows}


def _with_vectors(q: DataFrame) -> DataFrame:
    """Queries with the vector that the stand-in embedder gives them."""
    made = embedding.embed(q.select(F.col("qid").cast("string").alias("id"), F.col("q").alias("text"))).select(F.col("id").cast("int").alias("qid"), F.col("embedding").alias("vector"))
    return q.join(made, "qid")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in (*VERBS, "-h", "--help"):
        argv = ["search", *argv]
    a = parser().parse_args(argv)
    if a.verb == "chunks":
        for path in a.files:
            with open(path, encoding="utf-8", errors="replace") as f:
                for _, symbols, kind, start, end, body, _ in code_chunks(f.read(), path):
                    print(f"L{start}-{end} {kind} {' '.join(symbols)} ({_size(body.splitlines())} nw-chars)")
        return 0
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if a.verb == "ingest":
        for kind, status in ingest(spark, _readers(a.sources), a.store, time.strftime("%Y%m%d%H%M%S"), a.allow_empty).items():
            print(kind, status.value)
        return 0
    chunks = open_store(spark, a.store)
    index = search.read_postings(spark, a.index) if getattr(a, "index", None) else None
    if a.verb == "search":
        alias = os.environ.get("LODESTONE_INVOKED_AS") or os.path.basename(sys.argv[0])
        kinds = [k for k in KINDS if k in (a.kinds or (PROJECT_KINDS if alias == "ccsearch" else []))] or None
        q = spark.createDataFrame([(0, " ".join(a.query), kinds, [p for p in a.project or [] if p] or None)], "qid int, q string, kinds array<string>, projects array<string>")
        hits = search.search(chunks, q if a.keyword else _with_vectors(q), index, as_of=a.as_of, keyword_only=a.keyword, limit=a.limit)
        shown = search.headlines(search.with_text(hits, chunks), q).orderBy("rank")
        for row in search.to_jsonl(shown).collect():
            hit = json.loads(row["line"])
            print(f"{hit['rank']:2d} {hit['source']:10s} {hit.get('created', ''):10s} {hit.get('title', '')}\n   {hit.get('snippet', '')}" if a.pretty else row["line"])
    elif a.verb == "stats":
        for r in stats.by_kind(chunks).orderBy(F.desc("n")).collect():
            print(r["source_kind"] or "total", r["n"], r["embedded"], r["pending"])
    elif a.verb == "embed":
        classes = spark.read.parquet(a.classes) if a.classes else spark.createDataFrame([], "mid string, mail_class string")
        pending = classify.embed_backlog(chunks, classes).select("id", "text")
        pending = pending.orderBy("id").limit(a.limit) if a.limit else pending
        done = embedding.embed(pending, embedding.HttpEmbedder(a.url, a.dim) if a.url else embedding.HashEmbedder(a.dim))
        print(store.write_store(store.set_vectors(chunks, done.where("embedding is not null")), a.target, time.strftime("%Y%m%d%H%M%S")))
    else:
        summary = run_eval(chunks, readers.eval_cases(spark, a.file), index, a.as_of, a.k, a.keyword)
        if a.json:
            print(json.dumps(summary, indent=2))
            return 0
        print(f"eval: {summary['cases']} cases  recall@{a.k}={summary[f'recall@{a.k}']:.2f}  mrr={summary['mrr']:.2f}  avg={summary['latency_ms_avg']:.1f}ms  p95={summary['latency_ms_p95']:.1f}ms")
        for row in summary["rows"]:
            print(f"  {'ok' if row['hit'] else 'MISS':4} rank={row['rank'] or '-':>2} {row['latency_ms']:>7.1f}ms  {row['query']}")
            for title in row["top"] if a.show_top or not row["hit"] else []:
                print(f"       top: {title}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
