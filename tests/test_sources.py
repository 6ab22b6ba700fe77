import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import verdicts
from lodestone.operators.store import SourceStatus
from lodestone.sources import files, live, mbox, photos, readers, records
from lodestone.streaming import incremental

BOX = (
    b"From a@b Mon Jan  1 00:00:00 2024\nSubject: 1\nContent-Type: text/plain; charset=latin-1\n\nFrom here on it is body text, r\xe4tt 2024\nFrom: not this either\n"
    b"From c@d Tue Jan  2 00:00:00 2024\nSubject: 2\n\nx\n\nFrom now to 2024\n"
    b"From e@f Wed Feb 12 00:00:00 2024\nSubject: 3\n\ny"
)


@pytest.mark.parametrize("size", [1, 7, 40, 64, 1 << 20])
def test_mails_are_parted_at_envelopes_whatever_the_ranges(spark, tmp_path, size):
    (tmp_path / "box").mkdir()
    (tmp_path / "box/one.mbox").write_bytes(BOX)
    (tmp_path / "box/empty.mbox").write_bytes(b"")
    got = [bytes(r["raw"]) for r in mbox.raw_mails(spark, f"file:{tmp_path}/box", size).collect()]
    assert b"".join(sorted(got, key=BOX.index)) == BOX and len(got) == 3


def test_bytes_of_mails_are_kept(spark, tmp_path):
    (tmp_path / "box").write_bytes(BOX)
    rows = {r["title"]: r["full"] for r in readers.mbox(spark, f"file:{tmp_path}/box").collect()}
    assert set(rows) == {"1", "2", "3"} and "rätt" in rows["1"]


def test_walk_never_enters_hidden_or_skipped_folders(spark, tmp_path, monkeypatch):
    for name in ("a/b.md", "a/c.txt", ".git/x.md", "a/node_modules/y.md", "top.md", "a/.hidden.md", "a/2021-03-04 note.md", "a/blank.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(" " if "blank" in name else name)
    entered = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: entered.append(str(p)) or real(p))
    assert [os.path.relpath(f, tmp_path) for f in files.walk(str(tmp_path), (".md",))] == ["top.md", "a/.hidden.md", "a/2021-03-04 note.md", "a/b.md", "a/blank.md"]
    assert not any(".git" in e or "node_modules" in e for e in entered)
    monkeypatch.undo()
    (tmp_path / "single.md").write_text("alone")
    monkeypatch.setattr(files, "is_placeholder", lambda p: p.endswith("top.md"))
    roots = [files.Root(str(tmp_path / "single.md"), mode="label", label="one"), files.Root(str(tmp_path), (".md",)), files.Root(str(tmp_path), patterns=("*/*.txt",), mode="label", label="texts")]
    got = {r["source_id"]: r for r in files.documents_of(spark, roots).collect()}
    assert set(got) == {"doc:one:single.md", "doc:a:a/.hidden.md", "doc:a:a/2021-03-04 note.md", "doc:a:a/b.md", "doc:texts:a/c.txt"}
    assert got["doc:a:a/2021-03-04 note.md"]["created"] == "2021-03-04" and got["doc:a:a/b.md"]["title"] == "b"
    monkeypatch.undo()
    assert files.documents_of(spark, []).count() == 0 and files.is_placeholder(str(tmp_path / "gone")) is True


def test_notes_without_their_sidecar_lose_the_dates_only(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/n.txt").write_text("hello")
    rows = readers.notes(spark, f"file:{tmp_path}/notes", f"file:{tmp_path}/absent.json").collect()
    assert [(r["source_id"], r["created"]) for r in rows] == [("note:n", "")]


def test_verdicts(spark, tmp_path):
    chunks = spark.createDataFrame([("photo:a", 0, "IMG.PNG [Text, Sky] buy at", "screenshot"), ("photo:a", 1, "http://x", "screenshot"), ("photo:b", 0, "B.PNG [] I love you", "screenshot"), ("note:c", 0, "x", "note")], "source_id string, chunk_idx int, text string, source_kind string")
    bodies = verdicts.object_bodies(chunks)
    listed = spark.createDataFrame([("a",), ("A",), ("B",), ("gone",), (None,)], "uuid string")
    wanted = verdicts.targets(listed, bodies)
    assert {tuple(r) for r in wanted.collect()} == {("A", "buy at http://x"), ("B", "I love you"), ("GONE", "")}
    place = f"file:{tmp_path}/verdicts"
    assert verdicts.read(spark, place).count() == 0
    verdicts.append(verdicts.label(wanted.where("uuid = 'A'")), place)
    assert {r["uuid"] for r in verdicts.pending(wanted, verdicts.read(spark, place)).collect()} == {"B", "GONE"}

    def broken(texts):
        raise RuntimeError("quota")

    verdicts.append(verdicts.label(verdicts.pending(wanted, verdicts.read(spark, place)), broken), place)
    assert {tuple(r) for r in verdicts.counts(verdicts.read(spark, place)).collect()} == {("impersonal", 1), ("ambiguous", 2)}
    verdicts.append(verdicts.label(wanted.where("uuid = 'B'")), place)
    assert {tuple(r) for r in verdicts.last(verdicts.read(spark, place)).collect()} == {("A", "impersonal"), ("B", "personal"), ("GONE", "ambiguous")}
    assert verdicts.removable(verdicts.read(spark, place), listed.where("false")).count() == 1
    assert verdicts.removable(verdicts.read(spark, place), spark.createDataFrame([("a",)], "uuid string")).count() == 0
    assert [r["label"] for r in verdicts.label(wanted, lambda t: ["impersonal", "nonsense"][: len(t)], 2).collect()].count("ambiguous") >= 1


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    place = f"file:{tmp_path}/place"
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    rows.write.parquet(f"file:{tmp_path}/in")
    stream = spark.readStream.schema("id string, text string").parquet(f"file:{tmp_path}/in")
    assert incremental.embed_drain(spark, stream, place=place).count() == 2
    spark.createDataFrame([("c", "z")], "id string, text string").write.mode("append").parquet(f"file:{tmp_path}/in")
    seen = []

    def counting(texts):
        from lodestone.operators.embedding import HashEmbedder

        return HashEmbedder(4)(texts)

    got = incremental.embed_drain(spark, stream, counting, place)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c"] and not seen
    assert {r["id"]: len(r["embedding"]) for r in got.collect()} == {"a": 64, "b": 64, "c": 4}


def test_a_failing_batch_is_repeated(spark, tmp_path):
    spark.createDataFrame([("a",)], "id string").write.parquet(f"file:{tmp_path}/in")
    stream = spark.readStream.schema("id string").parquet(f"file:{tmp_path}/in")
    tries = []

    def commit(batch, number):
        tries.append(number)
        if len(tries) == 1:
            raise RuntimeError("down")

    assert incremental.drain(stream, commit, f"file:{tmp_path}/check", tries=2, pause=0.01) and tries == [0, 0]


def test_offsets_are_kept(spark, tmp_path):
    path = f"file:{tmp_path}/state"
    assert incremental.stored_offsets(spark, path)[0] is None
    log = spark.createDataFrame([("a", 10**12, 1, "ok"), ("b", 3, 1, "failed"), ("c", 5, 1, "retry")], "mid string, internal_ms long, attempt int, outcome string")
    incremental.save_offsets(spark, path, incremental.sync_state(log))
    resume, waiting = incremental.stored_offsets(spark, path)
    assert resume == 10**12 - incremental.OVERLAP_MS and {r["mid"] for r in waiting.collect()} == {"b", "c"}
    listing = spark.createDataFrame([("b", 3), ("d", 10**12 + 5), ("e", 7), ("f", None)], "mid string, internal_ms long")
    assert [r["mid"] for r in incremental.fetch_window(listing, resume, waiting).collect()] == ["b", "d"]
    assert F is not None


def test_live_mail_resumes(spark, tmp_path):
    path, asked, broken = f"file:{tmp_path}/state", [], {"m3"}
    pages = {None: '{"messages": [{"id": "m1"}, {"id": "m2"}], "nextPageToken": "t"}', "t": 'notice\n{"messages": [{"id": "m3"}, {"id": "m1"}]}'}

    def call(query, token):
        asked.append(query)
        return pages[token] if query == "" else '{"messages": [{"id": "m4"}]}'

    def mail(k, body):
        import base64

        raw = f"Message-ID: <{k}>\nSubject: {k}\nFrom: a@b\nContent-Type: text/plain; charset=utf-8\nDate: Fri, 6 Jan 2023 10:00:00 +0000\n\n{body}\n".encode()
        return base64.urlsafe_b64encode(raw).decode().rstrip("=")

    def fetch(mid):
        if mid in broken:
            raise RuntimeError("down")
        return 'warning: x\n{"raw": "' + mail(mid, "räk?>~") + '", "internalDate": "' + str(10**12 + int(mid[1])) + '"}'

    objects, status, done = live.pull(spark, path, call, fetch)
    assert sorted(r["title"] for r in objects.collect()) == ["m1", "m2"] and status is SourceStatus.PARTIAL and "räk?>~" in objects.first()["full"]
    assert incremental.stored_offsets(spark, path)[0] is None
    done()
    resume, waiting = incremental.stored_offsets(spark, path)
    assert resume == 10**12 + 2 - incremental.OVERLAP_MS and [r["mid"] for r in waiting.collect()] == ["m3"]
    broken.clear()
    objects, _, done = live.pull(spark, path, call, fetch)
    assert sorted(r["title"] for r in objects.collect()) == ["m3", "m4"] and asked[-1] == f"after:{resume // 1000}"
    done()
    assert incremental.stored_offsets(spark, path)[1].count() == 0
    with pytest.raises(ValueError):
        live.answer("no answer")


def test_photos(spark, tmp_path):
    assets = spark.createDataFrame([("A",), ("b",), ("c",)], "uuid string")
    rows = spark.createDataFrame([("a", "/x/2", None, True), ("a", "/x/1", None, True), ("B", "/y", "gone", True), ("c", "/z", None, False)], "uuid string, file string, error string, present boolean")
    assert {tuple(r) for r in photos.originals(assets, rows).collect()} == {("A", "/x/1"), ("b", None), ("c", None)}
    cache, images = f"file:{tmp_path}/cache", spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,)], "path string")

    def reader(path):
        with open(f"{tmp_path}/log", "a") as f:
            f.write(path + "\n")
        if path == "p2":
            raise RuntimeError("unreadable")
        return "text of " + path

    for _ in range(2):
        assert {tuple(r) for r in photos.read_texts(spark, images, reader, cache).collect()} == {("p1", "text of p1"), ("p2", "")}
    assert sorted((tmp_path / "log").read_text().split()) == ["p1", "p2"]
    assert photos.without_cached(images.where("path is not null"), spark.read.parquet(cache)).count() == 0


def test_settings_entities_and_base64(spark, tmp_path):
    (tmp_path / "env").write_text("# c\nexport A=1\nB = \"two words\"\nA=3\nnot a setting\n")
    assert readers.settings(spark, f"file:{tmp_path}/env") == {"A": "3", "B": "two words"}
    row = spark.createDataFrame([("<p>&aring;&#228;&#xF6; &lt;b&gt; &amp;amp;</p>", "8J-YgD8-", None)], "h string, b string, n string").select(X.html_text(F.col("h")).alias("h"), X.from_base64url(F.col("b")).cast("string").alias("b"), X.from_base64url(F.col("n")).alias("n")).first()
    assert (row["h"], row["b"], row["n"]) == ("åäö <b> &amp;", "😀?>", None)


def test_archive_before_live(spark):
    columns = "source_id string, title string, origin string"
    old = spark.createDataFrame([("email:1", "archived", "a.mbox"), ("email:2", "only there", "a.mbox")], columns)
    new = spark.createDataFrame([("email:1", "live", "live"), ("email:3", "only here", "live")], columns)
    rows, status = live.archive_and_live(old, new)
    assert {r["source_id"]: r["title"] for r in rows.collect()} == {"email:1": "archived", "email:2": "only there", "email:3": "only here"} and status is SourceStatus.PARTIAL
    assert live.archive_and_live(old, None) == (old, SourceStatus.COMPLETE)
    assert live.archive_and_live(old, None, False) == (None, SourceStatus.UNCHANGED)
    assert live.archive_and_live(old, new, False)[1] is SourceStatus.PARTIAL


def test_screenshots_and_graphs(spark):
    files_of = spark.createDataFrame([("/a.png", "a.png", True), ("/b.jpg", "b.jpg", False), ("/c.png", "c.png", True), ("/d.png", "d.png", True)], "path string, name string, is_screenshot boolean")
    labels = spark.createDataFrame([("/a.png", [f"l{k}" for k in range(12)]), ("/b.jpg", ["Sky"])], "path string, labels array<string>")
    cache = spark.createDataFrame([("/d.png", "cached")], "path string, text string")
    rows = readers.screenshots(files_of, labels, lambda path: F.when(path == "/a.png", "read"), cache).collect()
    assert {r["source_id"]: r["full"] for r in rows} == {"photo:/a.png": "a.png [" + ", ".join(f"l{k}" for k in range(10)) + "]\nread", "photo:/b.jpg": "b.jpg [Sky]\n", "photo:/d.png": "d.png []\ncached"}

    def query(graph, text):
        if graph == "broken":
            raise RuntimeError("down")
        return [(f"{graph}-1", "name", None, "open", None, 1723500000)] if "Task" in text else []

    got = records.graph_tasks(records.task_nodes(spark, ["g", "broken", "h"], query)).collect()
    assert {(r["source_id"], r["created"], r["full"]) for r in got} == {("fyr:g-1", "2024-08-12", "name [?/open]"), ("fyr:h-1", "2024-08-12", "name [?/open]")}
