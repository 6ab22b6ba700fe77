"""Readers of files and exports; every one gives the source objects that chunk_rows takes, and skips only what it can't read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.chunkers import LANGUAGES
from lodestone.schema import DEFAULT
from lodestone.sources.files import SKIPPED_PARTS
from lodestone.sources.mbox import raw_mails
from lodestone.sources.records import commits, first_of, git_log, mails, threads

# Path parts that hold no source code, and markers of text that tools write into sessions.
CODE_SKIPPED = ["/vendor/", "/node_modules/", "/.git/", "/dist/", "/build/", "/tmp/", "/coverage/", "/.venv/", "/target/", ".min.js", ".min.css"]
SESSION_NOISE = [
    "<system-reminder>", "This session is being continued", "Caveat:", "# CLAUDE.md", "Codebase and user instructions are shown below",
    "<command-name>", "<local-command-stdout>", "DO NOT respond to these",
]


def messenger(spark: SparkSession, path: str) -> DataFrame:
    """Threads of `<thread>/message_*.json` exports."""
    schema = "title string, participants array<struct<name:string>>, messages array<struct<sender_name:string,content:string,timestamp_ms:bigint>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "message_*.json").json(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), "title", "participants", F.posexplode("messages").alias("pos", "m"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.array_join(F.transform("participants", lambda p: p["name"]), ", "))
    return threads(rows.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("thread"), title.alias("title"), "file", "pos", F.col("m.sender_name").alias("sender"), F.col("m.content").alias("content"), F.col("m.timestamp_ms").alias("timestamp_ms")))


def chats_by_node(spark: SparkSession, path: str) -> DataFrame:
    """Chat exports that map node ids to messages; only string parts count, sorted by time, then node and part."""
    schema = "array<struct<title:string,conversation_id:string,mapping:map<string,struct<message:struct<create_time:double,content:struct<parts:array<variant>>>>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("c"))
    nodes = raw.select("c.title", "c.conversation_id", F.explode("c.mapping").alias("node", "n"))
    parts = nodes.select("title", "conversation_id", "node", F.coalesce("n.message.create_time", F.lit(0.0)).alias("t"), F.posexplode("n.message.content.parts").alias("k", "p"))
    texts = parts.where(F.schema_of_variant("p") == "STRING").select("title", "conversation_id", "node", "t", "k", F.variant_get("p", "$", "string").alias("text")).where(X.strip(F.col("text")) != "")
    grouped = texts.groupBy("conversation_id").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("t", "node", "k", "text"))).alias("l"))
    full = F.concat_ws("\n", "title", F.array_join(F.transform("l", lambda r: r["text"]), "\n"))
    return grouped.select(F.concat(F.lit("aichat:cg:"), "conversation_id").alias("source_id"), F.lit("chatgpt").alias("project"), "title", full.alias("full"), F.lit("").alias("created"), F.lit("").alias("updated"))


def chats_by_list(spark: SparkSession, path: str) -> DataFrame:
    """Chat exports that list messages: lines `sender: text` of non-blank texts."""
    schema = "array<struct<name:string,uuid:string,created_at:string,chat_messages:array<struct<sender:string,text:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("c")).select("c.*")
    said = F.filter("chat_messages", lambda m: X.strip(m["text"]) != "")
    full = F.concat_ws("\n", "name", F.array_join(F.transform(said, lambda m: F.concat_ws(": ", m["sender"], m["text"])), "\n"))
    return raw.select(F.concat(F.lit("aichat:cl:"), "uuid").alias("source_id"), F.lit("claude").alias("project"), F.col("name").alias("title"), full.alias("full"), F.coalesce(F.substring("created_at", 1, 10), F.lit("")).alias("created"), F.lit("").alias("updated"))


def notes(spark: SparkSession, path: str, sidecar: str | None = None) -> DataFrame:
    """Text files as notes, dated by a JSON sidecar of active notes joined on normalised content; unmatched notes have no date.

    Of sidecar notes with one content the oldest counts; trashed ones don't. A sidecar that isn't there costs the dates only.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("full")).where(X.strip(F.col("full")) != "")
    files = files.withColumn("key", X.note_key(F.col("full")))
    if sidecar and _is_there(spark, sidecar):
        dates = spark.read.option("multiLine", True).schema("activeNotes array<struct<id:string,content:string,creationDate:string,lastModified:string>>").json(sidecar)
        dates = dates.select(F.explode("activeNotes").alias("n")).select(X.note_key(F.col("n.content")).alias("key"), F.substring("n.creationDate", 1, 10).alias("created"), F.substring("n.lastModified", 1, 10).alias("updated"))
        files = files.join(first_of(dates, ["key"], [F.asc_nulls_last(F.nullif("created", F.lit(""))), "updated"]), "key", "left")
    else:
        files = files.withColumns({"created": F.lit(""), "updated": F.lit("")})
    title = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.select(F.concat(F.lit("note:"), title).alias("source_id"), F.lit("simplenote").alias("project"), title.alias("title"), "full", F.coalesce("created", F.lit("")).alias("created"), F.coalesce("updated", F.lit("")).alias("updated"))


def _is_there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def documents(spark: SparkSession, root: str, project: str | None = None, most: int = DEFAULT.doc_max_bytes) -> DataFrame:
    """Markdown and text files below root; hidden and generated folders, oversized and blank files are left out. Created is a date in the
    file name, else the file's time; the project is the first folder unless given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(root)
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    for part in [*SKIPPED_PARTS, "/."]:
        files = files.where(~F.contains(F.concat(F.lit("/"), rel), F.lit(part)))
    stamp = F.date_format("modificationTime", "yyyy-MM-dd")
    named = F.regexp_extract(rel, r"(20\d\d)[-_](\d\d)[-_](\d\d)[^/]*$", 0)
    created = F.when(named != "", F.regexp_replace(F.substring(named, 1, 10), "_", "-")).otherwise(stamp)
    label = F.lit(project) if project else F.substring_index(rel, "/", 1)
    rows = files.where(F.col("length") <= most).select(rel.alias("rel"), label.alias("project"), F.try_validate_utf8(F.col("content").cast("string")).alias("full"), created.alias("created"), stamp.alias("updated"))
    return rows.where(X.strip(F.col("full")) != "").select(F.concat(F.lit("doc:"), "project", F.lit(":"), "rel").alias("source_id"), "project", F.col("rel").alias("title"), "full", "created", "updated")


def sessions(spark: SparkSession, roots: list[str], most: int = DEFAULT.session_text_max) -> DataFrame:
    """Agent sessions in JSON lines: user and assistant texts in order; a session in several roots counts from the first. Sub-agents, compact
    summaries, tool noise and overlong texts are left out, unreadable lines skipped. Lines are ordered by file block, then as read in it."""
    rows = None
    for k, root in enumerate(roots):
        one = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root).select(F.lit(k).alias("root"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line"), "value")
        rows = one if rows is None else rows.unionByName(one)
    msg = F.from_json("value", "type string, timestamp string, isCompactSummary boolean, message struct<role:string,content:variant>")
    kind = F.schema_of_variant("content")
    listed = F.array_join(F.transform(F.filter(F.variant_get("content", "$", "array<struct<type:string,text:string>>"), lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    parsed = rows.where(~F.contains(F.lower("file"), F.lit("subagent"))).select("root", "file", "line", msg.alias("m")).where(F.col("m.type").isin("user", "assistant") & ~F.coalesce("m.isCompactSummary", F.lit(False)))
    parsed = parsed.select("root", "file", "line", "m.type", "m.timestamp", F.col("m.message.content").alias("content")).withColumn("text", F.when(kind == "STRING", F.variant_get("content", "$", "string")).otherwise(listed))
    kept = noise_free(parsed, "text", most)
    ident, folder = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    grouped = kept.groupBy("root", ident.alias("sid"), folder.alias("folder")).agg(F.min("timestamp").alias("t"), F.array_sort(F.collect_list(F.struct("line", F.concat_ws(": ", "type", "text").alias("said")))).alias("l"))
    full = F.array_join(F.transform("l", lambda r: r["said"]), "\n")
    first = first_of(grouped, ["sid"], ["root", "folder"])
    return first.select(F.concat(F.lit("session:"), "sid").alias("source_id"), F.substring_index("folder", "-", -1).alias("project"), F.substring(F.split(full, "\n")[0], 1, 80).alias("title"), full.alias("full"), F.coalesce(F.substring("t", 1, 10), F.lit("")).alias("created"), F.lit("").alias("updated"))


def noise_free(rows: DataFrame, column: str, most: int = DEFAULT.session_text_max) -> DataFrame:
    """Rows whose text is not blank, at most `most` characters and without a marker of tool output."""
    markers = F.array(*[F.lit(m) for m in SESSION_NOISE])
    return rows.where((F.length(column) <= most) & (X.strip(F.col(column)) != "") & ~F.exists(markers, lambda m: F.contains(column, m)))


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """Mails of mbox files, read as bytes in ranges and parted at whole envelope lines only."""
    return mails(raw_mails(spark, path).select("raw", "origin"))


def git_commits(spark: SparkSession, path: str) -> DataFrame:
    """`git log` dumps, one file per repository named after it, records parted by NUL."""
    raw = spark.read.option("lineSep", "\x00").text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("repo"), "value")
    return commits(git_log(raw))


def code_files(spark: SparkSession, root: str, repo: str, most: int = DEFAULT.code_max_bytes) -> DataFrame:
    """(repo, path, source, modified) of the files of known languages below root, for chunk_code."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    known = F.lower(F.regexp_extract(rel, r"\.([A-Za-z]+)$", 1)).isin(*LANGUAGES)
    for part in CODE_SKIPPED:
        files = files.where(~F.contains(F.concat(F.lit("/"), rel), F.lit(part)))
    rows = files.where((F.col("length") <= most) & known).select(F.lit(repo).alias("repo"), rel.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("source"), F.date_format("modificationTime", "yyyy-MM-dd").alias("modified"))
    return rows.where("source is not null")


def screenshots(files: DataFrame, labels: DataFrame, ocr, cache: DataFrame | None = None) -> DataFrame:
    """Objects of images (path, name, is_screenshot) with labels (path, labels): the first ten labels for all, read text for screenshots;
    neither gives none. ocr is a column function of the path; what the cache (path, text) has is not read again."""
    rows = files.join(labels, "path", "left")
    if cache is not None:
        rows = rows.join(cache.select("path", F.col("text").alias("_known")), "path", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    read = F.when(F.col("is_screenshot"), F.coalesce("_known", ocr(F.col("path"))))
    tags = F.array_join(F.slice(F.coalesce("labels", F.array().cast("array<string>")), 1, 10), ", ")
    rows = rows.select("path", "name", tags.alias("tags"), F.coalesce(read, F.lit("")).alias("read")).where((F.col("tags") != "") | (F.col("read") != ""))
    return rows.select(F.concat(F.lit("photo:"), "path").alias("source_id"), F.lit("photo").alias("project"), F.col("name").alias("title"), F.concat("name", F.lit(" ["), "tags", F.lit("]\n"), "read").alias("full"), F.lit("").alias("created"), F.lit("").alias("updated"))


def class_rules(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, mail_class, sender_domain) of a config of lines `class domain`; comments and short lines are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("k", "line"))
    parts = F.split(X.strip(F.lower(F.substring_index("line", "#", 1))), r"\s+")
    return lines.select((F.col("k") + 1).cast("int").alias("line_no"), parts.alias("p")).where(F.size("p") == 2).select("line_no", F.col("p")[0].alias("mail_class"), F.col("p")[1].alias("sender_domain"))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, kinds, projects, expectations) of a JSON list of cases: scope and project (or repo) a text or a list of texts,
    must_match (or expected) a text, an object or a list of either; texts and `contains` are sought in the whole result, other names in that field."""
    schema = "array<struct<query:string,must_match:variant,expected:variant,scope:variant,project:variant,repo:variant>>"
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("qid", "c")).select("qid", "c.*").where("query is not null")

    def texts(c: str):
        kind = F.schema_of_variant(c)
        return F.when(kind == "STRING", F.array(F.variant_get(c, "$", "string"))).when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(c, "$", "array<string>"))

    want = F.coalesce("must_match", "expected")
    each = F.when(F.startswith(F.schema_of_variant(want), F.lit("ARRAY")), F.try_variant_get(want, "$", "array<variant>")).when(want.isNotNull(), F.array(want))

    def expectation(v):
        named = F.coalesce(F.try_variant_get(v, "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
        is_text = F.schema_of_variant(v) == "STRING"
        text = F.when(is_text, F.variant_get(v, "$", "string")).otherwise(F.nullif(F.try_element_at(named, F.lit("contains")), F.lit("")))
        return F.struct(text.alias("text"), F.when(is_text, F.create_map().cast("map<string,string>")).otherwise(F.map_filter(named, lambda k, x: (k != "contains") & (x != ""))).alias("fields"))

    return raw.select("qid", "query", texts("scope").alias("kinds"), F.coalesce(texts("project"), texts("repo")).alias("projects"), F.coalesce(F.transform(each, expectation), F.array().cast("array<struct<text:string,fields:map<string,string>>>")).alias("expectations"))


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """The settings of a file of lines `KEY=value`: comments and other lines left out, quotes around a value taken off, the last of a key counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("k", "line")).where(F.col("line").rlike(r"^\s*(?:export\s+)?[A-Za-z_]\w*\s*=")).orderBy("k")
    key = F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", 1)
    value = F.regexp_replace(X.strip(F.regexp_extract("line", r"=(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    return {r[0]: r[1] for r in lines.select(key, value).collect()}
