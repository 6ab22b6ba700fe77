"""Source objects (source_id, project, title, full, created, updated) from record tables: tasks, commits, mails, graph tasks, threads."""

from __future__ import annotations

import email
import email.policy
import hashlib
import html
import re
from collections.abc import Callable, Iterator
from datetime import timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.schema import DEFAULT


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in a stated order: the first source wins, whatever partition it came from."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def tasks(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Open and done tasks with their context: the project's title, else the area's. Trashed rows and projects give none; repeated
    uuids count once; a dangling project or area leaves the context empty; a null creation date gives an empty created."""
    rows = rows.where(F.col("uuid").isNotNull())
    projects = rows.groupBy(F.col("uuid").alias("_p")).agg(F.min("title").alias("_ptitle"))
    named = areas.groupBy(F.col("uuid").alias("_a")).agg(F.min("title").alias("_atitle"))
    own = first_of(rows.where("trashed = 0 and task_type = 0"), ["uuid"], ["title", "notes", "status", "creation_date", "area", "project"])
    joined = own.join(named, own["area"] == F.col("_a"), "left").join(projects, own["project"] == F.col("_p"), "left")
    context = F.coalesce(F.nullif("_ptitle", F.lit("")), F.nullif("_atitle", F.lit("")))
    state = F.when(F.col("status") == 3, "done").otherwise("open")
    created = F.coalesce(F.date_format(F.timestamp_seconds(F.col("creation_date").cast("long")), "yyyy-MM-dd"), F.lit(""))
    head = F.concat(F.coalesce(F.concat(F.lit("["), context, F.lit("] ")), F.lit("")), F.coalesce("title", F.lit("")), F.lit(" ("), state, F.lit(")"))
    return joined.select(
        F.concat(F.lit("things3:"), "uuid").alias("source_id"), F.lit("things3").alias("project"), "title", F.concat_ws("\n", head, F.nullif("notes", F.lit(""))).alias("full"), created.alias("created"), F.lit("").alias("updated"), context.alias("context"), state.alias("state")
    )


def graph_tasks(rows: DataFrame) -> DataFrame:
    """Tasks of a graph (uuid, name, summary, status, external_source, created_at): the time is an epoch in s or ms, else a date text."""
    number = F.expr("try_cast(created_at as double)")
    created = F.when(number.isNotNull(), X.epoch_day(number)).otherwise(F.coalesce(F.substring("created_at", 1, 10), F.lit("")))
    head = F.concat(F.coalesce("name", F.lit("")), F.lit(" ["), F.coalesce("external_source", F.lit("?")), F.lit("/"), F.coalesce("status", F.lit("?")), F.lit("]"))
    return first_of(rows.where("uuid is not null"), ["uuid"], ["name", "created_at"]).select(
        F.concat(F.lit("fyr:"), "uuid").alias("source_id"), F.lit("fyr").alias("project"), F.col("name").alias("title"), F.concat_ws("\n", head, F.nullif("summary", F.lit(""))).alias("full"), created.alias("created"), F.lit("").alias("updated")
    )


def task_nodes(spark: SparkSession, graphs: list[str], query: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Rows for graph_tasks from every graph that has tasks: query(graph, text) runs a graph query and gives its rows; one graph that fails
    costs its own tasks only. Each graph is one task's work."""
    columns = ["uuid", "name", "summary", "status", "external_source", "created_at"]
    text = f"MATCH (t:Task) RETURN {', '.join(f't.{c}' for c in columns)}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for graph in b["graph"]:
                try:
                    rows = [tuple(None if v is None else str(v) for v in row) for row in query(graph, text)]
                except Exception:
                    continue
                yield pd.DataFrame(rows, columns=columns)

    named = spark.createDataFrame([(g,) for g in graphs], "graph string").repartition(max(1, len(graphs)))
    return named.mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def commits(rows: DataFrame, most: int = DEFAULT.commit_max) -> DataFrame:
    """One object per commit of a repository, its text cut at `most` characters; repeated and late rows count once, the earliest fetched wins."""
    one = first_of(rows.where("sha is not null"), ["repo", "sha"], ["fetched_at", "author", "authored", "subject", "body"])
    day = F.substring("authored", 1, 10)
    head = F.concat(F.lit("commit "), F.substring("sha", 1, 8), F.lit(" · "), "repo", F.lit(" · "), day, F.lit(" · "), F.coalesce("author", F.lit("")))
    full = F.concat(head, F.lit("\n"), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return one.select(F.concat(F.lit("gitcommit:"), "repo", F.lit(":"), "sha").alias("source_id"), F.col("repo").alias("project"), F.col("subject").alias("title"), F.substring(full, 1, most).alias("full"), day.alias("created"), F.lit("").alias("updated"))


def git_log(lines: DataFrame) -> DataFrame:
    """Commit records (repo, value) as `git log` writes them, fields parted by unit separators; records of under five fields are left out."""
    parts = F.split(F.regexp_replace("value", r"^\s+", ""), "\x1f")
    return lines.select("repo", parts.alias("p")).where(F.size("p") >= 5).select(F.col("p")[0].alias("sha"), "repo", F.col("p")[1].alias("author"), F.col("p")[2].alias("authored"), F.col("p")[3].alias("subject"), F.col("p")[4].alias("body"), F.lit(None).cast("timestamp").alias("fetched_at"))


_BLOCKS = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>")
_TAGS = re.compile(r"(?s)<[^>]*>")


def _plain(markup: str) -> str:
    text = html.unescape(_TAGS.sub(" ", _BLOCKS.sub(" ", markup)))
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def _part(part) -> str:
    try:
        return part.get_content()
    except Exception:
        raw = part.get_payload(decode=True) or b""
        return raw.decode("utf-8", "replace")


def _header(message, name: str) -> str:
    try:
        return " ".join(str(message.get(name) or "").split())
    except Exception:
        return ""


def mail_body(message) -> str:
    """Plain text before HTML (as text), else all text parts joined."""
    try:
        best = message.get_body(preferencelist=("plain", "html"))
    except Exception:
        best = None
    if best is not None:
        body = _part(best)
        return _plain(body) if best.get_content_type() == "text/html" else body
    return "\n".join(_part(p) for p in message.walk() if p.get_content_maintype() == "text")


def parse_mail(raw: bytes, fallback_ms: int | None = None) -> dict | None:
    """Key, headers and body of one mail; None for one without subject and body. Malformed headers count as empty, never as errors."""
    message = email.message_from_bytes(re.sub(rb"\AFrom [^\n]*\n", b"", raw or b""), policy=email.policy.default)
    subject, sender, to = (_header(message, h) for h in ("Subject", "From", "To"))
    body = mail_body(message).strip()
    if not subject and not body:
        return None
    dated = _header(message, "Date")
    ident = _header(message, "Message-ID") or f"{dated}|{sender}|{subject}|{len(body)}"
    try:
        created = parsedate_to_datetime(dated).date().isoformat()
    except (ValueError, TypeError, IndexError):
        created = pd.Timestamp(fallback_ms, unit="ms", tz=timezone.utc).strftime("%Y-%m-%d") if fallback_ms else ""
    return {"key": hashlib.sha1(ident.encode("utf-8", "replace")).hexdigest()[:16], "title": subject or sender[:60] or "(mail)", "full": f"{subject}\nFrom: {sender}\nTo: {to}\nDate: {dated}\n\n{body}", "created": created}


def mails(rows: DataFrame) -> DataFrame:
    """Objects of raw mails (raw, origin[, internal_ms]); of several with one key the first origin wins."""
    columns = ["key", "title", "full", "created"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(parse_mail(raw, None if pd.isna(ms) else int(ms)), o) for raw, o, ms in zip(b["raw"], b["origin"], b["internal_ms"])]
            yield pd.DataFrame([(*(m[c] for c in columns), o) for m, o in found if m], columns=[*columns, "origin"])

    internal = F.col("internal_ms") if "internal_ms" in rows.columns else F.lit(None)
    parsed = rows.where("raw is not null").select("raw", "origin", internal.cast("long").alias("internal_ms")).mapInPandas(run, "key string, title string, full string, created string, origin string")
    one = first_of(parsed, ["key"], ["origin"])
    return one.select(F.concat(F.lit("email:"), "key").alias("source_id"), F.lit("mail").alias("project"), "title", "full", "created", F.lit("").alias("updated"), "origin")


def threads(messages: DataFrame) -> DataFrame:
    """Objects of message rows (thread, title, file, pos, sender, content, timestamp_ms): lines `sender: content` in order of file and
    position; messages without content give no line but count for the date; a missing title is the senders."""
    m = messages.withColumns({c: X.latin1_repair(F.col(c)) for c in ("title", "sender", "content")})
    line = F.when(F.col("content").isNotNull(), F.concat_ws(": ", "sender", "content"))
    grouped = m.groupBy("thread").agg(
        F.max(F.nullif("title", F.lit(""))).alias("_title"), F.array_sort(F.collect_set("sender")).alias("_senders"), F.max("timestamp_ms").alias("_ms"), F.array_sort(F.collect_list(F.struct("file", "pos", line.alias("line")))).alias("_lines")
    )
    title = F.coalesce("_title", F.array_join("_senders", ", "))
    lines = F.array_join(F.transform("_lines", lambda r: r["line"]), "\n")
    return grouped.select(F.concat(F.lit("msg:"), "thread").alias("source_id"), F.lit("messenger").alias("project"), title.alias("title"), F.concat_ws("\n", title, lines).alias("full"), X.epoch_day(F.col("_ms").cast("double")).alias("created"), F.lit("").alias("updated"))
