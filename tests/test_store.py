import pytest
from lodestone.operators import classify, embedding, store
from lodestone.operators.store import SourceStatus as S
from lodestone.sources import readers, records
from lodestone.sources.mbox import split_mbox
from lodestone.streaming import incremental

STORE = "id string, source_kind string, project string, content_hash string, embedding array<float>"


def test_upsert_keeps_vectors_of_unchanged_texts(spark):
    old = spark.createDataFrame([("a", "doc", "p", "1", [1.0]), ("b", "doc", "p", "2", [2.0]), ("c", "doc", "p", "3", [3.0])], STORE)
    new = spark.createDataFrame([("a", "doc", "p", "1"), ("b", "doc", "p", "9"), ("d", "doc", "p", "4"), ("d", "doc", "p", "4"), (None, "doc", "p", "4")], "id string, source_kind string, project string, content_hash string")
    got = {r["id"]: (r["content_hash"], r["embedding"]) for r in store.upsert(old, new).collect()}
    assert got == {"a": ("1", [1.0]), "b": ("9", None), "c": ("3", [3.0]), "d": ("4", None)}
    once = store.upsert(old, new)
    assert sorted(map(str, store.upsert(once, new).collect())) == sorted(map(str, once.collect()))
    assert store.upsert(old.where("false"), new.where("false")).count() == 0


def test_prune_spares_what_was_not_completed(spark):
    rows = [("n1", "note", None, "1", None), ("n2", "note", None, "1", None), ("e1", "email", None, "1", None), ("c1", "code", "seen", "1", None), ("c2", "code", "other", "1", None), ("d1", "doc", "p", "1", None)]
    seen = spark.createDataFrame([("n1", "note", None), ("c9", "code", "seen")], "id string, source_kind string, project string")
    status = {"note": S.COMPLETE, "email": S.PARTIAL, "code": S.COMPLETE, "doc": S.COMPLETE}
    left = {r["id"] for r in store.prune(spark.createDataFrame(rows, STORE), seen, status).collect()}
    assert left == {"n1", "e1", "c2", "d1"}
    left = {r["id"] for r in store.prune(spark.createDataFrame(rows, STORE), seen, status, allow_empty=True).collect()}
    assert left == {"n1", "e1", "c2"}


def test_fingerprints(spark):
    rows = [("doc", f"f{k}", k, 10) for k in range(50)]
    schema = "kind string, path string, mtime long, size int"
    a = store.fingerprint(spark.createDataFrame(rows, schema))
    b = store.fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3))
    assert a.collect() == b.collect() and store.changed_kinds(a, b).count() == 0
    c = store.fingerprint(spark.createDataFrame([*rows[1:], ("doc", "f0", 99, 10)], schema))
    assert store.changed_kinds(c, a).count() == 1


def test_domain_rules(spark):
    domains = spark.createDataFrame([("1", "a.shop.example"), ("2", "myshop.example"), ("3", None), ("4", "shop.example")], "mid string, sender_domain string")
    rules = spark.createDataFrame([(1, "reading", "shop.example"), (2, "Telemetry", "A.SHOP.example"), (3, "work", "shop.example"), (4, "x", None)], "line_no int, mail_class string, sender_domain string")
    got = {r["mid"]: r["mail_class"] for r in classify.classify_domains(domains, rules).collect()}
    assert got == {"1": "work", "2": None, "3": None, "4": "work"}


def test_mails():
    raw = b"From x@y Mon Jan  1 00:00:00 2024\nMessage-ID: <1@x>\nSubject: Hej\nFrom: =?utf-8?q?=C3=85sa?= <a@x>\nDate: nonsense\n\nBody\n"
    one, two = records.parse_mail(raw, 1723500000000), records.parse_mail(raw.split(b"\n", 1)[1], 1723500000000)
    assert one == two and one["created"] == "2024-08-12" and "Åsa" in one["full"]
    assert records.parse_mail(b"") is None
    html = records.parse_mail(b"Subject: s\nContent-Type: text/html\n\n<p>a &amp; b</p><style>x</style>")
    assert html["full"].endswith("a & b")
    box = b"From a@b Mon Jan  1 00:00:00 2024\nSubject: 1\n\nFrom here on\n\nFrom c@d Mon Jan  1 00:00:00 2024\nSubject: 2\n\nx\n"
    assert len(list(split_mbox(iter(box.splitlines(keepends=True))))) == 2


def test_readers(spark, tmp_path):
    (tmp_path / "docs/p").mkdir(parents=True)
    (tmp_path / "docs/p/2020_01_02_a.md").write_text("# A\ntext")
    (tmp_path / "docs/p/.hidden.md").write_text("x")
    (tmp_path / "docs/p/blank.txt").write_text("  ")
    got = readers.documents(spark, f"file:{tmp_path}/docs").collect()
    assert [(r["source_id"], r["created"]) for r in got] == [("doc:p:p/2020_01_02_a.md", "2020-01-02")]
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/n.txt").write_text("hello\nworld\nTags: a")
    (tmp_path / "side.json").write_text('{"activeNotes": [{"id": "1", "content": "hello\\r\\nworld", "creationDate": "2021-01-01T00:00:00", "lastModified": "2022-01-01"}, {"id": "2", "content": "hello world", "creationDate": "2020-01-01", "lastModified": "2020-01-01"}], "trashedNotes": []}')
    got = readers.notes(spark, f"file:{tmp_path}/notes", f"file:{tmp_path}/side.json").collect()
    assert [(r["source_id"], r["created"]) for r in got] == [("note:n", "2020-01-01")]
    (tmp_path / "t/one").mkdir(parents=True)
    (tmp_path / "t/one/message_1.json").write_text('{"title": "", "participants": [{"name": "A"}, {"name": "B"}], "messages": [{"sender_name": "A", "content": "hej", "timestamp_ms": 1}, {"sender_name": "B", "timestamp_ms": 1723500000000}]}')
    row = readers.messenger(spark, f"file:{tmp_path}/t").first()
    assert (row["source_id"], row["title"], row["full"], row["created"]) == ("msg:one", "A, B", "A, B\nA: hej", "2024-08-12")
    (tmp_path / "list.json").write_text('[{"name": "n", "uuid": "u", "created_at": "2024-01-01T00:00", "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "x", "text": " "}]}]')
    assert readers.chats_by_list(spark, f"file:{tmp_path}/list.json").first()["full"] == "n\nhuman: hi"
    (tmp_path / "map.json").write_text('[{"title": "t", "conversation_id": "c", "mapping": {"a": {"message": {"create_time": 2, "content": {"parts": ["second", {"x": 1}]}}}, "b": {"message": {"create_time": 1, "content": {"parts": ["first"]}}}, "r": {"message": null}}}]')
    assert readers.chats_by_node(spark, f"file:{tmp_path}/map.json").first()["full"] == "t\nfirst\nsecond"
    (tmp_path / "s/proj-x").mkdir(parents=True)
    (tmp_path / "s/proj-x/id1.jsonl").write_text('{"type":"user","timestamp":"2024-01-01T00:00:00Z","message":{"content":"hello"}}\nbroken\n{"type":"assistant","timestamp":"2024-01-02","message":{"content":[{"type":"text","text":"hi"},{"type":"tool","text":"no"}]}}\n')
    row = readers.sessions(spark, [f"file:{tmp_path}/s"]).first()
    assert (row["source_id"], row["project"], row["full"], row["created"]) == ("session:id1", "x", "user: hello\nassistant: hi", "2024-01-01")
    (tmp_path / "rules").write_text("# c\nReading News.Example\nbad\n")
    assert [tuple(r) for r in readers.class_rules(spark, f"file:{tmp_path}/rules").collect()] == [(2, "reading", "news.example")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/repo.txt").write_text("s1\x1fme\x1f2020-01-01T00:00:00Z\x1fsubj\x1fbody\x00s2\x1ftoo few\x00")
    assert [r["source_id"] for r in readers.git_commits(spark, f"file:{tmp_path}/log").collect()] == ["gitcommit:repo:s1"]
    (tmp_path / "box").write_bytes(b"From a@b Mon Jan  1 00:00:00 2024\nSubject: 1\n\nx\nFrom c@d Mon Jan  1 00:00:00 2024\nSubject: 2\n\ny\n")
    assert sorted(r["title"] for r in readers.mbox(spark, f"file:{tmp_path}/box").collect()) == ["1", "2"]


def test_graph_tasks(spark):
    rows = spark.createDataFrame([("u", "n", "s", "open", "ticktick", "1723500000000"), ("v", None, None, None, None, "2020-01-01T00:00")], "uuid string, name string, summary string, status string, external_source string, created_at string")
    assert sorted((r["created"], r["full"]) for r in records.graph_tasks(rows).collect()) == [("2020-01-01", " [?/?]"), ("2024-08-12", "n [ticktick/open]\ns")]


def test_embedding_bisects_and_records():
    def picky(texts):
        if len(texts) > 1:
            raise RuntimeError("one at a time")
        if len(texts[0]) > 5:
            raise embedding.ContextExceeded("long")
        if texts[0] == "bad":
            raise RuntimeError("no")
        return embedding.HashEmbedder(4)(texts)

    got = embedding.embed_pairs([("1", "abc"), ("2", "abcdefgh"), ("3", "bad")], picky)
    assert [(i, v is None, bool(r)) for i, v, r in got] == [("1", False, False), ("2", False, False), ("3", True, True)]
    calls = []

    def broken(texts):
        calls.append(1)
        raise RuntimeError("down")

    now = [0.0]
    both = embedding.Failover(broken, embedding.HashEmbedder(4), rest=60, clock=lambda: now[0])
    both(["a"]), both(["b"])
    assert len(calls) == 1
    now[0] = 61
    both(["c"])
    assert len(calls) == 2

    def short(texts):
        raise embedding.ContextExceeded("short")

    assert len(embedding.Failover(short, embedding.HashEmbedder(4), clock=lambda: now[0])(["a"])) == 1
    with pytest.raises(embedding.ContextExceeded):
        embedding.Failover(short, broken, clock=lambda: now[0])(["a"])


def test_incremental_state(spark):
    log = spark.createDataFrame([("a", 10**12, 1, "ok", 1), ("b", None, 1, "failed", 2), ("b", None, 1, "failed", 2), (None, 5, 1, "ok", 3), ("c", 5, 1, "retry", 4), ("c", 5, 2, "ok", 5)], "mid string, internal_ms long, attempt int, outcome string, sync_id long")
    state = incremental.sync_state(log)
    mark = incremental.watermark(state).first()
    assert (mark["watermark_ms"], mark["retry"]) == (10**12, 1)
    listing = spark.createDataFrame([("a", 10**12), ("b", 1), ("d", 10**12 + 1), ("e", 2)], "mid string, internal_ms long")
    assert [r["mid"] for r in incremental.next_batch(listing, state).collect()] == ["b", "d"]


def test_streamed_embedding(spark, tmp_path):
    spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, text string").write.parquet(f"file:{tmp_path}/in")
    stream = spark.readStream.schema("id string, text string").parquet(f"file:{tmp_path}/in")
    assert incremental.embed_drain(spark, stream).count() == 2
