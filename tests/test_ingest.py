import json
import os

from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import search
from lodestone.operators.state import StateStore
from lodestone.operators.store import SourceStatus as S
from lodestone.plans.ingest import ingest, read_store, unchanged

OBJECTS = "source_id string, project string, title string, full string, created string, updated string"
NOTES = [("note:a", "p", "A", "the boat licence", "2020-01-01", ""), ("note:b", "p", "B", "winter key", "2020-01-01", "")]
DOCS = [("doc:p:x", "p", "x", "# Head\nboat text", "2020-01-01", "")]


def source(rows, status=S.COMPLETE):
    return lambda s: (s.createDataFrame(rows, OBJECTS), status)


def ids(spark, path):
    return {r["id"] for r in read_store(spark, path).collect()}


def test_two_runs_and_the_command_line(spark, tmp_path, capsys):
    path = f"file:{tmp_path}/store"
    gone = lambda s: 1 / 0
    status = ingest(spark, {"note": source(NOTES), "doc": source(DOCS), "code": gone}, path, "1")
    assert status["code"] is S.UNAVAILABLE
    assert ids(spark, path) == {"note:a#0", "note:b#0", "doc:p:x#0"}
    ingest(spark, {"note": source(NOTES[:1]), "doc": lambda s: (None, S.UNCHANGED)}, path, "2")
    assert ids(spark, path) == {"note:a#0", "doc:p:x#0"}
    assert cli.main([path, "boat", "licence", "-k"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0]["id"] == "note:a#0" and lines[0]["rank"] == 1 and lines[0]["kw"] and lines[0]["snippet"] == "the «boat» «licence»" and lines[0]["updated"] == "2020-01-01"
    assert cli.main(["search", path, "boat", "-d", "-k"], spark) == 0
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()] == ["doc:p:x#0"]
    cli.main(["stats", path], spark)
    assert "total 2 0 2" in capsys.readouterr().out
    classes = f"file:{tmp_path}/classes"
    spark.createDataFrame([("note:a", "Reading")], "mid string, mail_class string").write.parquet(classes)
    cli.main(["embed", path, f"file:{tmp_path}/embedded", "--classes", classes], spark)
    embedded = spark.read.parquet(capsys.readouterr().out.strip())
    assert {r["id"] for r in embedded.where("embedding is not null").collect()} == {"doc:p:x#0"}
    (tmp_path / "cases.json").write_text(json.dumps([{"query": "boat licence", "must_match": ["nowhere", {"contains": "licence", "source_kind": "note"}], "scope": "note"}, {"query": "boat", "expected": "licence", "scope": ["doc"], "repo": "p"}]))
    cli.main(["eval", path, "--file", f"file:{tmp_path}/cases.json", "--keyword", "--json"], spark)
    summary = json.loads(capsys.readouterr().out)
    assert summary["cases"] == 2 and summary["mrr"] == 0.5 and [r["rank"] for r in summary["rows"]] == [1, None] and summary["latency_ms_p95"] > 0
    search.write_postings(search.postings(read_store(spark, path)), f"file:{tmp_path}/index")
    cli.main(["search", path, "boat", "--index", f"file:{tmp_path}/index"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 2


def test_alias_and_chunks(spark, tmp_path, capsys, monkeypatch):
    path = f"file:{tmp_path}/store"
    ingest(spark, {"note": source(NOTES), "doc": source(DOCS)}, path, "1")
    monkeypatch.setenv("LODESTONE_INVOKED_AS", "ccsearch")
    cli.main([path, "boat", "-k"], spark)
    assert [json.loads(x)["source"] for x in capsys.readouterr().out.splitlines()] == ["doc"]
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    cli.main(["chunks", f"{tmp_path}/a.py"], spark)
    assert capsys.readouterr().out.startswith("L1-3 function f (")


def test_a_source_that_fails_while_it_is_read_is_unavailable(spark, tmp_path):
    path = f"file:{tmp_path}/store"
    ingest(spark, {"note": source(NOTES), "doc": source(DOCS)}, path, "1")
    bad = lambda s: (s.createDataFrame(NOTES[:1], OBJECTS).withColumn("full", F.raise_error(F.lit("unreadable"))), S.COMPLETE)
    status = ingest(spark, {"note": bad, "doc": source(DOCS)}, path, "2")
    assert status == {"note": S.UNAVAILABLE, "doc": S.COMPLETE}
    assert ids(spark, path) == {"note:a#0", "note:b#0", "doc:p:x#0"}


def test_a_run_with_nothing_new_writes_no_data(spark, tmp_path):
    path = f"file:{tmp_path}/store"
    listing = spark.createDataFrame([("note", "a", 1, 10), ("note", "b", 1, 5), ("doc", "x", 1, 3)], "kind string, path string, mtime long, size long")
    assert unchanged(spark, path, listing) == set()
    ingest(spark, {"note": source(NOTES), "doc": source(DOCS)}, path, "1", listings=listing)
    before = sorted(os.listdir(tmp_path / "store/data"))
    called = []
    status = ingest(spark, {"note": lambda s: called.append(1), "doc": lambda s: called.append(2)}, path, "2", listings=listing)
    assert status == {"note": S.UNCHANGED, "doc": S.UNCHANGED} and not called
    assert sorted(os.listdir(tmp_path / "store/data")) == before and ids(spark, path) == {"note:a#0", "note:b#0", "doc:p:x#0"}
    later = listing.withColumn("mtime", F.when(F.col("kind") == "doc", 2).otherwise(F.col("mtime")).cast("long"))
    assert unchanged(spark, path, later) == {"note"}
    failed = ingest(spark, {"note": source(NOTES), "doc": lambda s: 1 / 0}, path, "3", listings=later)
    assert failed["doc"] is S.UNAVAILABLE and unchanged(spark, path, later) == {"note"}


def test_code_becomes_chunk_rows(spark, tmp_path):
    path = f"file:{tmp_path}/store"
    files = [("repo", "a.py", "import os\n\n\ndef first():\n    return 1\n\n\nclass Second:\n    def inner(self):\n        return 2\n", "2024-05-01"), ("repo", "bad.py", None, None)]
    ingest(spark, {"code": lambda s: (s.createDataFrame(files, "repo string, path string, source string, modified string"), S.COMPLETE)}, path, "1")
    rows = read_store(spark, path).orderBy("chunk_idx").collect()
    assert [r["id"] for r in rows] == [f"code:repo:a.py#{k}" for k in range(len(rows))] and rows[0]["created"] == "2024-05-01"
    assert rows[0]["title"].startswith("a.py › first") and all(len(r["content_hash"]) == 16 and len(r["title"]) <= 120 for r in rows)


def test_state_is_switched_whole(spark, tmp_path):
    state = StateStore(spark, f"file:{tmp_path}/state")
    assert state.get("x") is None and state.load("t", "a int").count() == 0
    state.put("x", {"k": 1})
    state.put("x", {"k": 2, "å": [1]})
    assert state.get("x") == {"k": 2, "å": [1]}
    state.save("t", spark.createDataFrame([(1,)], "a int"))
    state.save("t", spark.createDataFrame([(2,), (3,)], "a int"))
    assert sorted(r["a"] for r in state.load("t", "a int").collect()) == [2, 3]
