import math

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import evaluate, search
from lodestone.schema import Config

CHUNKS = "id string, source_kind string, source_id string, chunk_idx int, project string, title string, text string, created string, embedding array<float>, rank int"


def table(spark):
    rows = [
        ("a#0", "doc", "a", 0, "p", "Boat", "the boat licence", "2025-12-31", [1.0, 0.0], 1), ("a#1", "doc", "a", 1, "p", None, "boat boat", "", [0.0, 1.0], 1), ("b#0", "note", "b", 0, None, "", "boats sail", None, None, 1),
        ("c#0", "email", "c", 0, "q", "x", None, "2020-01-01", [float("nan"), 0.0], 1), (None, "doc", "d", 0, "p", "boat", "boat", "", [0.0, 0.0], 1), ("a#0", "doc", "a", 0, "p", "Boat", "the boat licence", "2025-12-31", [1.0, 0.0], 1),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def test_layers(spark):
    t = table(spark)
    q = spark.createDataFrame([(1, "the boat"), (2, ""), (3, "licence")], "qid int, q string")
    index = search.postings(t)
    strict = {(r["qid"], r["id"]) for r in search.strict_layer(index, q).collect()}
    assert strict == {(1, "a#0"), (3, "a#0")}
    soft = {(r["qid"], r["id"]) for r in search.soft_layer(index, q).collect()}
    assert (1, "b#0") in soft and (1, "a#1") in soft and not any(i == 2 for i, _ in soft)
    exact = [(r["qid"], r["id"]) for r in search.exact_layer(t, q).collect()]
    assert sorted(exact) == [(1, "a#0"), (3, "a#0")]


def test_one_hit_per_object_and_scope(spark):
    t = table(spark)
    q = spark.createDataFrame([(1, "boat", ["doc"], None), (2, "boat", None, ["q"])], "qid int, q string, kinds array<string>, projects array<string>")
    hits = search.search(t, q, as_of="2026-01-01").collect()
    assert [(r["qid"], r["source_id"]) for r in hits] == [(1, "a")]


def test_vectors_against_brute_force(spark):
    t = table(spark)
    q = spark.createDataFrame([(1, "boat", [1.0, 1.0])], "qid int, q string, vector array<double>")
    got = [(r["id"], r["sem"]) for r in search.vector_layer(t, q, 5, dim=2).orderBy("rank").collect()]
    assert got == [("a#0", round(1 / math.sqrt(2), 9)), ("a#1", round(1 / math.sqrt(2), 9))]
    hybrid = search.search(t.withColumn("embedding", F.col("embedding")), q.withColumn("vector", F.array(*[F.lit(0.1)] * 64)))
    assert hybrid.count() > 0


def test_empty_tables(spark):
    t = table(spark).where("false")
    q = spark.createDataFrame([(1, "boat")], "qid int, q string")
    assert search.search(t, q).count() == 0
    assert search.search(table(spark), q.where("false")).count() == 0
    assert search.to_jsonl(search.search(t, q)).count() == 0


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    results = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 4)], "qid int, id string, rank int")
    relevant = spark.createDataFrame([(1, "y"), (1, "y"), (2, "z"), (3, "q")], "qid int, id string")
    row = evaluate.metrics(evaluate.hit_ranks(results, relevant, cases)).first()
    assert (row["n"], round(row["recall_at_k"], 6), row["mrr"]) == (3, 0.666667, 0.25)
    lat = spark.createDataFrame([(float(k),) for k in range(1, 12)], "ms double")
    assert evaluate.nearest_rank(lat, "ms").first()["value"] == 11.0
    assert evaluate.nearest_rank(lat.where("false"), "ms").first()["value"] is None


def test_expectations(spark):
    e = spark.createDataFrame([("Boat trip", "p", "trip", None), ("x", "p", None, {"project": "P"}), ("x", "p", None, {}), ("x", "p", None, {"nope": "a"})], "t string, project string, text string, fields map<string,string>")
    got = e.select(evaluate.matches(F.col("t"), {"project": F.col("project")}, F.struct("text", "fields")).alias("m")).collect()
    assert [r["m"] for r in got] == [True, True, False, False]


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    t = table(spark).where("id is not null")
    q = spark.createDataFrame([(k, w, [float(k), 1.0], ["doc"] if k % 2 else None) for k, w in enumerate(["boat", "the boat", "sail", "licence", "x"])], "qid int, q string, vector array<double>, kinds array<string>")

    def rows():
        near = {(r["qid"], r["id"], r["rank"], r["sem"]) for r in search.vector_layer(t, q, 3, dim=2).collect()}
        exact = {(r["qid"], r["id"], r["rank"]) for r in search.exact_layer(t, q).collect()}
        scan = {(r["qid"], r["id"], r["score"]) for r in search.linear_scan(t, q).collect()}
        return near, exact, scan

    whole = rows()
    monkeypatch.setattr(search, "BLOCK", 2)
    assert rows() == whole and all(whole)
    needles = q.select("qid", F.col("q").alias("needle"), "kinds")
    a, b = ({tuple(r) for r in search.containing(t, needles, F.lower("text"), ["id"], size).collect()} for size in (300, 1))
    assert a == b and (2, "b#0") in a and not any(k % 2 and i == "b#0" for k, i in a)


def test_literals_and_joins_find_the_same(spark, monkeypatch, tmp_path):
    t = table(spark)
    q = spark.createDataFrame([(1, "the boat"), (2, "boats"), (3, "licence sail")], "qid int, q string")
    search.write_postings(search.postings(t), f"file:{tmp_path}/index", 2)
    index = search.read_postings(spark, f"file:{tmp_path}/index")
    layers = lambda: [{tuple(r) for r in layer(index, q).collect()} for layer in (search.strict_layer, search.soft_layer)]
    pushed = layers()
    plan = search.soft_layer(index, q)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,boat)" in plan
    monkeypatch.setattr(search, "LITERALS", 0)
    assert layers() == pushed
    whole = search.soft_layer(index, q, Config(prefix_chars=None))
    assert (1, "b#0") not in {(r["qid"], r["id"]) for r in whole.collect()} and whole.count() > 0


def test_headlines():
    words = [f"w{k}" for k in range(120)]
    text = " ".join(words)
    assert search.headline_of(text, {"nothing"}) == " ".join(words[:14])
    one = search.headline_of(text, {"w50"})
    assert "«w50»" in one and 14 <= len(one.split()) <= 32
    far = search.headline_of(text, {"w5", "w60", "w90", "w119"})
    assert far.count(" … ") == 2 and far.count("«") == 3 and all(len(f.split()) <= 32 for f in far.split(" … "))
    assert search.headline_of("", {"a"}) == "" and search.headline_of("Boat, boat!", {"boat"}) == "«Boat,» «boat!»"


@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=150), st.sets(st.sampled_from(["a", "b", "z"]), min_size=1))
def test_headlines_keep_order_and_bounds(words, terms):
    out = search.headline_of(" ".join(words), terms)
    fragments = out.split(" … ")
    assert len(fragments) <= 3 and all(len(f.split()) <= 32 for f in fragments)
    plain = " ".join(words)
    assert all(f.replace("«", "").replace("»", "") in plain for f in fragments)
    assert bool(terms & set(words)) == ("«" in out)


def test_expectations_of_a_case(spark):
    hits = spark.createDataFrame([(1, 1, "i", "note", "p", "T", "the boat", "2020"), (1, 2, "j", "doc", "p", "T", "the boat", "2020")], "qid int, rank int, id string, source_kind string, project string, title string, text string, created string")
    cases = spark.createDataFrame([(1, [("nowhere", {}), ("BOAT", {"source_kind": "doc"})]), (2, [])], "qid int, expectations array<struct<text:string,fields:map<string,string>>>")
    assert [r["id"] for r in evaluate.judge(hits, cases).collect()] == ["j"]
    row = evaluate.latency(spark.createDataFrame([(1.0,), (3.04,)], "ms double")).first()
    assert (row["latency_ms_avg"], row["latency_ms_p95"]) == (2.0, 3.0)
    assert evaluate.latency(spark.createDataFrame([], "ms double")).first()["latency_ms_p95"] == 0.0
