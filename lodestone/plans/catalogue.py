"""Registry of the core queries and their SQL counterparts. Every query runs over its whole tables and whole texts."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.runtime import load, shared_dir, small
from lodestone.operators import chunkers, classify, embedding, evaluate, search, stats, store, verdicts
from lodestone.operators.timestamps import normalised_instants
from lodestone.sources import readers, records
from lodestone.sources.mbox import raw_mails
from lodestone.streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2026-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# pieces of SQL used by several oracles
_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_BLANK}|{_BLANK}$', '', 'g')"
_TOKENS = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP) + "]"
_GENERIC = "[" + ", ".join(f"'{w}'" for w in X.SOFT_STOP) + "]"
# distinct terms in order: DuckDB's list_distinct does not keep order
_TERMS = lambda c: f"list_filter({_TOKENS(c)}, lambda t: length(t) >= 2 and not list_contains({_STOP}, t))"
_ORDERED = lambda c: f"list_filter({c}, lambda t, i: list_position({c}, t) = i)"
_CHUNKS = "(select * from (select *, row_number() over (partition by id order by id) rn_ from chunks where id is not null) where rn_ = 1)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """documents as a chunk table with one chunk per document."""
    return load(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "source_kind", F.col("doc_id").cast("string").alias("source_id"), F.lit(0).alias("chunk_idx"), F.col("source").alias("project"), "title", "text", F.coalesce("created", F.lit("")).alias("created"), "doc_id", "lang"
    )


_DOCS = "(select doc_id::varchar as id, source_kind, source as project, title, text, coalesce(created, '') as created, lang from documents)"


def item_queries(spark: SparkSession, d: str) -> DataFrame:
    """Of every fiftieth held-out item its question, the first name in it, and how its text begins, as the stated query set."""
    items = load(spark, d, "eval_items").where("item_id % 50 = 0")
    forms = [F.col("question"), F.regexp_extract("question", "([A-Z][a-z]{3,})", 1), F.regexp_extract("text", r"^(\S+ \S+ \S+ \S+)", 1)]
    return items.select(F.explode(F.array(*[F.struct((F.col("item_id") * 10 + k).alias("qid"), f.alias("q")) for k, f in enumerate(forms)])).alias("e")).select("e.qid", "e.q")


_QUERIES = r"(select item_id * 10 as qid, question as q from eval_items where item_id % 50 = 0 union all select item_id * 10 + 1, regexp_extract(question, '([A-Z][a-z]{3,})', 1) from eval_items where item_id % 50 = 0 union all select item_id * 10 + 2, regexp_extract(text, '^(\S+ \S+ \S+ \S+)', 1) from eval_items where item_id % 50 = 0)"
_INDEX = f"(select term, id, source_kind, project, count(*) as tf from (select id, source_kind, project, unnest({_TOKENS("concat_ws(' ', title, text)")}) as term from {_DOCS}) group by all)"


@query()
def p7_found(spark, d):
    return normalised_instants(load(spark, d, "chunks"), load(spark, d, "source_clock"))


# --- chunk rows -------------------------------------------------------------------------------------------------------


@query(
    f"""with t as (select doc_id, {_STRIP("replace(text, chr(0), '')")} as t from documents where text is not null),
    c as (select doc_id, t, unnest(range(0, least(cast(ceil(length(t) / 670.0) as int), 400))) as k from t where length(t) > 0)
    select doc_id::varchar || '#' || k as id, k::int as chunk_idx, substring(t, k * 670 + 1, 750) as text, substring(sha1(substring(t, k * 670 + 1, 750)), 1, 16) as content_hash from c"""
)
def chunk_fixed(spark, d):
    docs = documents(spark, d).withColumns({"full": F.col("text"), "updated": F.lit("")})
    return chunkers.chunk_rows(docs, F.col("source_kind")).select("id", "chunk_idx", "text", "content_hash")


@query(
    f"""with t as (select doc_id, source_kind, source, title, created, {_STRIP("replace(text, chr(0), '')")} as t from documents where text is not null)
    select doc_id::varchar || '#0' as id, source_kind, source as project, replace(title, chr(0), '') as title, coalesce(created, '') as created, coalesce(created, '') as updated, t as text from t where length(t) > 0"""
)
def chunk_single(spark, d):
    docs = documents(spark, d).withColumns({"full": F.col("text"), "updated": F.lit("")})
    return chunkers.chunk_rows(docs, F.col("source_kind"), single=True).select("id", "source_kind", "project", "title", "created", "updated", "text")


@query(
    f"""with t as (select doc_id, title, {_STRIP("replace(text, chr(0), '')")} as t from documents where text is not null), c as (select *, least(cast(ceil(length(t) / 750.0) as int), 60) as n from t where length(t) > 0), k as (select *, unnest(range(0, n)) as k from c)
    select case when n > 1 then doc_id || '#' || k else doc_id::varchar end as id, case when n > 1 then coalesce(title, '') || ' [' || (k + 1) || '/' || n || ']' else title end as title, substring(t, k * 750 + 1, 750) as text from k"""
)
def chunk_plain(spark, d):
    return chunkers.plain_chunks(documents(spark, d).withColumn("full", F.col("text")))


@query("""with t as (select doc_id::varchar as source_id, length(trim(text)) as n from documents where text is not null) select source_id, (ceil(n / 670.0) - 2)::bigint as dropped from t where ceil(n / 670.0) > 2""".replace("trim(text)", _STRIP("replace(text, chr(0), '')")))
def chunk_dropped(spark, d):
    return chunkers.dropped_chunks(documents(spark, d).withColumn("full", F.col("text")), most=2)


# all headings of the input have one level, so that a section's path is its own heading
_HEAD = r"'^#{1,6}\s+(.*?)\s*#*\s*$'"


@query(
    f"""with t as (select doc_id::varchar as source_id, source as project, replace(title, chr(0), '') as title, coalesce(created, '') as created, string_split(replace(regexp_replace(text, '(?m)^Heading: (.*)$', '# \\1', 'g'), chr(0), ''), chr(10)) as lines from documents where text is not null and source_kind in ('doc', 'note')),
    l as (select * exclude lines, unnest(lines) as line, unnest(range(len(lines))) as k from t), m as (select *, regexp_matches(line, {_HEAD}) as head from l), n as (select *, sum(head::int) over (partition by source_id order by k) as sec from m),
    b as (select source_id, project, title, created, sec, {_STRIP("string_agg(line, chr(10) order by k)")} as body, max(case when head then 'Heading: ' || regexp_extract(line, {_HEAD}, 1) || chr(10) || chr(10) end) as prefix from n group by all),
    w as (select *, greatest(200, 750 - length(coalesce(prefix, ''))) as room from b where length(body) > 0), c as (select *, unnest(range(0, length(body), greatest(1, room - 80))) as s from w),
    r as (select *, row_number() over (partition by source_id order by sec, s) - 1 as i, coalesce(prefix, '') || substring(body, s + 1, room) as text from c)
    select source_id || '#' || i as id, 'doc' as source_kind, source_id, i::int as chunk_idx, project, title, text, created, created as updated, substring(sha1(text), 1, 16) as content_hash from r where i < 1200"""
)
def chunk_markdown(spark, d):
    docs = documents(spark, d).withColumns({"full": F.regexp_replace("text", r"(?m)^Heading: (.*)$", "# $1"), "updated": F.lit("")})
    return chunkers.chunk_markdown(docs.where("source_kind in ('doc', 'note')"))


@query()
def chunk_code(spark, d):
    code = load(spark, d, "chunks").where("source_kind = 'code'").select("project", "id", "text").distinct()
    return chunkers.chunk_code(code.select(F.col("project").alias("repo"), F.regexp_extract("id", r"([^:]+)#\d+$", 1).alias("path"), F.regexp_replace("text", r"^\[[^\n]*\n", "").alias("source")))


@query(r"select id, length(text)::int as n, regexp_extract(id, '^(.*)#[^#]*$', 1) as object_key, split_part(id, '#', 1) as mail_key from (select distinct id, text from chunks)")
def id_keys(spark, d):
    return load(spark, d, "chunks").select("id", "text").distinct().select("id", F.length("text").alias("n"), X.object_key(F.col("id")).alias("object_key"), F.split_part("id", F.lit("#"), F.lit(1)).alias("mail_key"))


@query(
    r"""with t as (select distinct id, text from chunks where text is not null), r as (select id, text, case when regexp_full_match(text, '[\x{0}-\x{ff}\n\r]*') then try(decode(unhex(array_to_string([printf('%02x', ord(c)) for c in string_split(text, '')], '')))) end as fixed from t)
    select id, fixed as text from r where fixed <> text"""
)
def latin1_repair(spark, d):
    fixed = X.latin1_repair(F.col("text"))
    return load(spark, d, "chunks").select("id", "text").distinct().where(fixed != F.col("text")).select("id", fixed.alias("text"))


@query(
    rf"""select distinct id, {_STRIP(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n+Tags:[^\n]*\s*$', '', 'g'), '" + _BLANK + r"', ' ', 'g')")} as note_key from chunks where source_kind = 'note'"""
)
def note_keys(spark, d):
    return load(spark, d, "chunks").where("source_kind = 'note'").select("id", X.note_key(F.col("text")).alias("note_key")).distinct()


@query(
    rf"""with h as (select distinct id, '<html><head><style>p {{ color: red }}</style></head><body><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><br/></body></html>' as html from chunks where source_kind = 'email'),
    a as (select id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as t from h),
    b as (select id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from a)
    select id, {_STRIP(r"regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g')")} as body from b"""
)
def html_text(spark, d):
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><style>p { color: red }</style></head><body><p>"), escaped, F.lit("</p><br/></body></html>"))
    return load(spark, d, "chunks").where("source_kind = 'email'").select("id", html.alias("html")).distinct().select("id", X.html_text(F.col("html")).alias("body"))


# --- statistics -------------------------------------------------------------------------------------------------------


@query("select source_kind, count(*) as n, count(embedding) as embedded, count(*) - count(embedding) as pending from chunks group by rollup (source_kind)")
def stats_by_kind(spark, d):
    return stats.by_kind(load(spark, d, "chunks"))


@query("select project, count(*) as n from chunks where project is not null group by project order by n desc, project limit 20")
def stats_projects(spark, d):
    return stats.top_projects(load(spark, d, "chunks"))


@query("select mail_class, count(distinct mid) as mails from email_class group by mail_class")
def mails_per_class(spark, d):
    return stats.per_class(load(spark, d, "email_class"))


@query("select source_kind, project, count(*) as n from chunks where source_kind in ('doc', 'session', 'code') and project in ('gmail', 'boat', 'tax', 'attic-photos') group by all")
def scope_filter(spark, d):
    scope = search.in_scope(F.col("source_kind"), F.col("project"), F.lit(["doc", "session", "code"]), F.lit(["gmail", "boat", "tax", "attic-photos"]))
    return load(spark, d, "chunks").where(scope).groupBy("source_kind", "project").agg(F.count("*").alias("n"))


@query(f"""select distinct id, round(case when regexp_matches(created, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_cast(created as date) is not null then greatest(0.0, 1.0 - greatest(date_diff('day', try_cast(created as date), date '{AS_OF}'), 0) / 730.0) else 0.0 end, 9) as recency from chunks""")
def recency_score(spark, d):
    return load(spark, d, "chunks").select("id", F.round(X.recency(F.col("created"), F.lit(AS_OF).cast("date")), 9).alias("recency")).distinct()


# --- query terms and index --------------------------------------------------------------------------------------------


@query(
    f"""with q as (select item_id, list_slice({_ORDERED(_TERMS("question"))}, 1, 12) as terms from eval_items),
    s as (select *, list_filter(terms, lambda t: not list_contains({_GENERIC}, t)) as rest from q)
    select item_id, array_to_string(terms, ' ') as terms, array_to_string(case when len(rest) > 0 then rest else terms end, ' ') as soft, len(terms) between 1 and 5 as exact from s"""
)
def query_terms(spark, d):
    q = F.col("question")
    return load(spark, d, "eval_items").select("item_id", F.array_join(X.query_terms(q), " ").alias("terms"), F.array_join(X.soft_terms(q), " ").alias("soft"), F.size(X.query_terms(q)).between(1, 5).alias("exact"))


@query(f"select term, count(*) as df, sum(tf)::bigint as tf from {_INDEX} group by term")
def posting_terms(spark, d):
    return search.postings(documents(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_STRICT = f"""select qid, id, rank, kwscore from (select *, row_number() over (partition by qid order by kwscore desc, id) as rank from (
    select qid, id, sum(tf)::bigint as kwscore from {_INDEX} i join (select qid, len(list_distinct({_TOKENS("q")})) as n, unnest(list_distinct({_TOKENS("q")})) as term from {_QUERIES}) w using (term) group by qid, id, n having count(*) = n)) where rank <= 80"""


def indexed(spark: SparkSession, d: str, table: str = "documents"):
    """The stored index of a table, written on first use to the shared folder under the table's place and time, then read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    stamp = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).getModificationTime()
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-index/{table}-{zlib.crc32(d.encode()):08x}-{stamp}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        search.write_postings(search.postings(documents(spark, d) if table == "documents" else load(spark, d, table)), path)
    return search.read_postings(spark, path)


@query(_STRICT)
def fts_strict(spark, d):
    return search.strict_layer(indexed(spark, d), item_queries(spark, d))


_SOFT = f"""select qid, term, id, rank, kwscore from (select *, row_number() over (partition by qid, term order by kwscore desc, id) as rank from (
    select qid, want as term, id, sum(tf)::bigint as kwscore from {_INDEX} i join (
        select qid, unnest(case when len(rest) > 0 then rest else terms end) as want from (select *, list_filter(terms, lambda t: not list_contains({_GENERIC}, t)) as rest from (select qid, list_slice({_ORDERED(_TERMS("q"))}, 1, 12) as terms from {_QUERIES}))) w
    on case when length(want) >= 4 then starts_with(i.term, want) else i.term = want end group by qid, want, id)) where rank <= 12"""


@query(_SOFT)
def fts_soft(spark, d):
    return search.soft_layer(indexed(spark, d), item_queries(spark, d))


_EXACT = f"""select qid, id, rank from (select *, row_number() over (partition by qid order by len, id) as rank from (
    select qid, id, length(text) as len from {_DOCS} s join (select qid, lower({_STRIP("q")}) as needle from {_QUERIES} where len(list_distinct({_TERMS("q")})) between 1 and 5) w on contains(lower(text), needle))) where rank <= 25"""


@query(_EXACT)
def exact_phrase(spark, d):
    return search.exact_layer(documents(spark, d), item_queries(spark, d))


_FUSE = lambda layers: f"""with layers as ({layers}),
    f as (select qid, id, sum(part) as part, max(sem) as sem, bool_or(exact) as exact from layers group by qid, id),
    s as (select f.*, s.source_kind, s.project, s.created, round(part + case when exact then 0.02 else 0.0 end + case when s.source_kind in ('doc', 'session', 'git_commit', 'code') and regexp_matches(s.created, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_cast(s.created as date) is not null
        then 0.05 * greatest(0.0, 1.0 - greatest(date_diff('day', try_cast(s.created as date), date '{AS_OF}'), 0) / 730.0) else 0.0 end, 9) as score from f join {_DOCS} s using (id))
    select qid, rank, id, source_kind, project, score from (select *, row_number() over (partition by qid order by score desc, coalesce(sem, 0.0) desc, id) as rank from s) where rank <= 12"""  # noqa: E731
_KEYWORD = f"""select qid, id, 2.4 / (60.0 + rank) as part, null::double as sem, true as exact from ({_EXACT}) union all select qid, id, 1.6 / (60.0 + rank), null, false from ({_STRICT}) union all select qid, id, 0.35 / (60.0 + rank), null, false from ({_SOFT})"""


@query(_FUSE(_KEYWORD))
def hybrid_keyword(spark, d):
    return search.search(documents(spark, d), item_queries(spark, d), indexed(spark, d), AS_OF, keyword_only=True).select("qid", "rank", "id", "source_kind", "project", "score")


# --- vectors ----------------------------------------------------------------------------------------------------------


def vector_queries(spark, d):
    return load(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


_COS = lambda a, b: f"round(list_cosine_similarity({a}::double[], {b}::double[]), 9)"
_VECTORS = f"""select qid, id, rank, sem from (select *, row_number() over (partition by qid order by sem desc, id) as rank from (
    select q.vec_id as qid, e.vec_id as id, {_COS("q.embedding", "e.embedding")} as sem from embeddings q, embeddings e where q.vec_id % 50 = 0)) where rank <= 80"""


@query(_VECTORS)
def vector_topk(spark, d):
    return search.vector_layer(load(spark, d, "embeddings"), vector_queries(spark, d), id_col="vec_id")


def paired(spark, d):
    """documents with the vector of the same number, where there is one."""
    return documents(spark, d).join(load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


@query(
    _FUSE(
        f"""{_KEYWORD} union all select qid, id, 1.0 / (60.0 + rank), sem, false from (select qid, id, sem, row_number() over (partition by qid order by sem desc, id) as rank from (
        select q.qid, e.vec_id::varchar as id, {_COS("v.embedding", "e.embedding")} as sem from {_QUERIES} q join embeddings v on v.vec_id = q.qid // 10 join embeddings e on e.vec_id in (select doc_id from documents))) where rank <= 80"""
    )
)
def hybrid_full(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    q = item_queries(spark, d).withColumn("item", (F.col("qid") / 10).cast("long")).join(vectors, "item", "left").drop("item")
    return search.search(paired(spark, d), q, indexed(spark, d), AS_OF).select("qid", "rank", "id", "source_kind", "project", "score")


@query(
    f"""with w as (select q.qid, list_filter(regexp_split_to_array(lower({_STRIP("q.q")}), '\\s+'), lambda t: true) as terms, v.embedding as v from {_QUERIES} q join embeddings v on v.vec_id = q.qid // 10 where {_STRIP("q.q")} <> ''),
    r as (select s.id, lower(concat_ws(chr(10), s.title, s.text)) as blob, e.embedding as e from {_DOCS} s left join embeddings e on e.vec_id::varchar = s.id),
    s as (select qid, id, case when e is null then 0.0 else list_cosine_similarity(e::double[], v::double[]) end as cos, len(list_filter(terms, lambda t: not contains(blob, t))) = 0 as kw from r, w)
    select qid, id, score, rank from (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from (select qid, id, round(cos + case when kw then 0.3 else 0.0 end, 9) as score from s where cos > 0.15 or kw)) where rank <= 20"""
)
def linear_scan(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    q = item_queries(spark, d).withColumn("item", (F.col("qid") / 10).cast("long")).join(vectors, "item").drop("item")
    return search.linear_scan(paired(spark, d), q)


# --- joins of the sources ---------------------------------------------------------------------------------------------


@query("select source_id, string_agg(text, ' ' order by chunk_idx) as full_text, count(*) as n from (select distinct source_id, chunk_idx, text from chunks) group by source_id")
def object_texts(spark, d):
    return stats.object_texts(load(spark, d, "chunks"))


@query(
    """with t as (select *, row_number() over (partition by uuid order by title, notes, status, creation_date, area, project) as r from tasks where trashed = 0 and task_type = 0 and uuid is not null),
    p as (select uuid, min(title) as ptitle from tasks where uuid is not null group by uuid), a as (select uuid, min(title) as atitle from areas group by uuid)
    select 'things3:' || t.uuid as source_id, coalesce(nullif(p.ptitle, ''), nullif(a.atitle, '')) as context, case when t.status = 3 then 'done' else 'open' end as state,
        coalesce(strftime(make_timestamp((t.creation_date::bigint) * 1000000), '%Y-%m-%d'), '') as created,
        coalesce('[' || coalesce(nullif(p.ptitle, ''), nullif(a.atitle, '')) || '] ', '') || coalesce(t.title, '') || ' (' || case when t.status = 3 then 'done' else 'open' end || ')' || coalesce(chr(10) || nullif(t.notes, ''), '') as "full" from t left join a on a.uuid = t.area left join p on p.uuid = t.project where t.r = 1"""
)
def task_context(spark, d):
    rows = records.tasks(load(spark, d, "tasks"), load(spark, d, "areas"))
    return rows.select("source_id", "context", "state", "created", "full")


@query(
    """with c as (select sha, repo, author, authored, subject, body, fetched_at, row_number() over (partition by repo, sha order by fetched_at, author, authored, subject, body) as r from commits where sha is not null)
    select 'gitcommit:' || repo || ':' || sha as source_id, repo as project, subject as title, substring(authored, 1, 10) as created, substring('commit ' || substring(sha, 1, 8) || ' · ' || repo || ' · ' || substring(authored, 1, 10) || ' · ' || coalesce(author, '') || chr(10) || coalesce(subject, '') || chr(10) || chr(10) || coalesce(body, ''), 1, 4000) as "full" from c where r = 1"""
)
def commit_objects(spark, d):
    return records.commits(load(spark, d, "commits")).select("source_id", "project", "title", "created", "full")


@query("select mid, b.c as mail_class, n from (select mid, max(struct_pack(d := coalesce(sender_domain, ''), k := coalesce(mail_class, ''), c := mail_class)) as b, count(*) as n from email_class where mid is not null group by mid)")
def last_class(spark, d):
    return stats.last_class(load(spark, d, "email_class"))


@query(
    r"""with m as (select source_id as mid, min(nullif(lower(regexp_extract(text, 'From:[^@\n]*@([A-Za-z0-9._-]+)', 1)), '')) as sender_domain from chunks where source_kind = 'email' and chunk_idx = 0 group by source_id),
    f as (select m.mid, max(struct_pack(l := r.line_no, c := lower(r.mail_class))) as best from m join class_rules r on m.sender_domain = lower(r.sender_domain) or ends_with(m.sender_domain, '.' || lower(r.sender_domain)) group by m.mid)
    select m.mid, m.sender_domain, f.best.c as mail_class from m left join f using (mid)"""
)
def domain_class(spark, d):
    return classify.classify_domains(classify.mail_domains(load(spark, d, "chunks")), load(spark, d, "class_rules")).select("mid", "sender_domain", "mail_class")


@query("select distinct id, source_kind from chunks c where embedding is null and not exists (select 1 from email_class e where lower(e.mail_class) in ('telemetry', 'reading') and e.mid = split_part(c.id, '#', 1))")
def embed_backlog(spark, d):
    return classify.embed_backlog(load(spark, d, "chunks"), load(spark, d, "email_class")).select("id", "source_kind")


@query("select count(distinct c.source_id) as unclassified from chunks c where source_kind = 'email' and chunk_idx = 0 and not exists (select 1 from email_class e where e.mid = c.source_id)")
def unclassified_mails(spark, d):
    return stats.unclassified(load(spark, d, "chunks"), load(spark, d, "email_class"))


@query("select key, min(id) as first_id, min(nullif(created, '')) as oldest, count(*) as n from (select distinct id, created, trim(lower(title)) as key from chunks where source_kind = 'note' and title is not null) group by key")
def oldest_per_title(spark, d):
    return stats.note_titles(load(spark, d, "chunks"))


@query("select doc_id as keeper, copies from (select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by text)")
def first_of_copies(spark, d):
    return stats.first_of_copies(load(spark, d, "documents"))


@query("select id, label_rows, labels from (select id, count(*) as label_rows, count(distinct label) as labels from lang_labels group by id)")
def labels_per_chunk(spark, d):
    return stats.labels_per_object(load(spark, d, "lang_labels"))


_NOISE = " or ".join(f"contains(text, '{m}')" for m in readers.SESSION_NOISE)


@query(f"select source_kind, count(*) as n, sum(length(text))::bigint as chars from chunks where length(text) <= 4000 and {_STRIP('text')} <> '' and not ({_NOISE}) group by source_kind")
def noise_free(spark, d):
    return readers.noise_free(load(spark, d, "chunks"), "text", 4000).groupBy("source_kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    """with t as (select uuid, title, notes, status, case when status = 3 then (creation_date * 1000)::bigint::varchar when trashed = 1 then '2020-01-02T03:04' else creation_date::bigint::varchar end as created_at from tasks where uuid is not null),
    o as (select *, row_number() over (partition by uuid order by title, created_at) as r from t)
    select 'fyr:' || uuid as source_id, coalesce(case when try_cast(created_at as double) is null then substring(created_at, 1, 10) else strftime(make_timestamp((case when created_at::double > 1e11 then created_at::double / 1000 else created_at::double end * 1000000)::bigint), '%Y-%m-%d') end, '') as created,
        coalesce(title, '') || ' [?/' || coalesce(status::varchar, '?') || ']' || coalesce(chr(10) || nullif(notes, ''), '') as "full" from o where r = 1"""
)
def graph_tasks(spark, d):
    t = load(spark, d, "tasks")
    created = F.when(F.col("status") == 3, (F.col("creation_date") * 1000).cast("long").cast("string")).when(F.col("trashed") == 1, "2020-01-02T03:04").otherwise(F.col("creation_date").cast("long").cast("string"))
    rows = t.select("uuid", F.col("title").alias("name"), F.col("notes").alias("summary"), F.col("status").cast("string").alias("status"), F.lit(None).cast("string").alias("external_source"), created.alias("created_at"))
    return records.graph_tasks(rows).select("source_id", "created", "full")


@query("""select 'item' || item_id as case_id, contains(lower(question || chr(10) || text), lower(regexp_extract(question, '([A-Z][a-z]{3,})', 1))) and contains(lower(lang), 's') as met from eval_items""")
def expectations(spark, d):
    name = F.regexp_extract("question", "([A-Z][a-z]{3,})", 1)
    e = F.struct(name.alias("text"), F.create_map(F.lit("lang"), F.lit("s")).alias("fields"))
    return load(spark, d, "eval_items").select(F.concat(F.lit("item"), "item_id").alias("case_id"), evaluate.matches(F.concat_ws("\n", "question", "text"), {"lang": F.col("lang")}, e).alias("met"))


# --- store ------------------------------------------------------------------------------------------------------------


def snapshots(spark, d):
    """An earlier and a later state of the order table as a store: keys, a hash, a vector that stands for the embedding."""
    o = load(spark, d, "orders")
    old = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("doc").alias("source_kind"), F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("content_hash"), F.array(F.col("o_totalprice").cast("float")).alias("embedding"))
    new = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("doc").alias("source_kind"), F.col("o_orderpriority").alias("project"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("content_hash"))
    return old, new


@query(
    """with o as (select o_orderkey::varchar as id, o_orderpriority as project, o_orderstatus as h, round(o_totalprice::float::double, 2) as v from orders where o_orderstatus <> 'P'), n as (select o_orderkey::varchar as id, o_orderpriority as project, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as h from orders where o_orderkey % 3 <> 0)
    select coalesce(n.id, o.id) as id, coalesce(n.project, o.project) as project, coalesce(n.h, o.h) as content_hash, case when o.id is not null and (n.id is null or n.h = o.h) then o.v end as vec from o full join n on o.id = n.id"""
)
def upsert_merge(spark, d):
    old, new = snapshots(spark, d)
    return store.upsert(old, new).select("id", "project", "content_hash", F.round(F.get("embedding", F.lit(0)).cast("double"), 2).alias("vec"))


def _seen(spark, d):
    """What a run saw: every chunk but those of two weekdays' hashes."""
    return load(spark, d, "chunks").where(~F.substring("content_hash", 1, 1).isin("0", "7", "c")).select("id", "source_kind", "project").distinct()


_KEPT = lambda gone: f"select distinct id, source_kind, content_hash from chunks c where not ({gone})"


@query(_KEPT("source_kind in ('note', 'doc', 'fyr') and substring(content_hash, 1, 1) in ('0', '7', 'c')"))
def prune_kinds(spark, d):
    s = store.SourceStatus
    status = {"note": s.COMPLETE, "doc": s.COMPLETE, "fyr": s.COMPLETE, "email": s.PARTIAL, "things3": s.UNAVAILABLE, "session": s.UNCHANGED}
    return store.prune(load(spark, d, "chunks"), _seen(spark, d), status).select("id", "source_kind", "content_hash").distinct()


@query(_KEPT("source_kind in ('code', 'git_commit') and project in ('pebble-web', 'tide-notes') and substring(content_hash, 1, 1) in ('0', '7', 'c')"))
def prune_projects(spark, d):
    s = store.SourceStatus
    seen = _seen(spark, d).where(F.col("project").isin("pebble-web", "tide-notes"))
    return store.prune(load(spark, d, "chunks"), seen, {"code": s.COMPLETE, "git_commit": s.COMPLETE}).select("id", "source_kind", "content_hash").distinct()


@query(
    """select d.doc_id::varchar as id, d.source_kind, array_to_string([printf('%.6f', round(x::double, 6)::float::double + 0.0) for x in v.embedding], ' ') as vec from documents d left join embeddings v on v.vec_id = d.doc_id"""
)
def vector_update(spark, d):
    rows = documents(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    shown = F.array_join(F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double") + F.lit(0.0))), " ")
    return store.set_vectors(rows, vectors).select("id", "source_kind", shown.alias("vec"))


_LISTING = "select distinct source_kind as kind, id as path, updated as mtime, length(text) as size from chunks"
_PRINT = lambda listing: f"""select kind, sha1(string_agg(l, ',' order by l)) as fingerprint from (select kind, concat_ws(':', b, n, s0, s1, s2, s3) as l from (
    select kind, substring(h, 1, 2) as b, count(*) as n, {', '.join(f"sum(('0x' || substring(h, {3 + 8 * k}, 8))::bigint) as s{k}" for k in range(4))} from (select kind, sha1(concat_ws('|', path, mtime, size)) as h from ({listing})) group by all)) group by kind"""  # noqa: E731


@query(f"""with now as ({_PRINT(f"select kind, path, case when kind = 'note' then mtime || '!' else mtime end as mtime, size from ({_LISTING})")}), old as ({_PRINT(_LISTING)}) select now.kind from now left join old using (kind) where now.fingerprint is distinct from old.fingerprint""")
def changed_sources(spark, d):
    listing = load(spark, d, "chunks").select(F.col("source_kind").alias("kind"), F.col("id").alias("path"), F.col("updated").alias("mtime"), F.length("text").alias("size")).distinct()
    later = listing.withColumn("mtime", F.when(F.col("kind") == "note", F.concat("mtime", F.lit("!"))).otherwise(F.col("mtime")))
    return store.changed_kinds(store.fingerprint(later), store.fingerprint(listing))


@query(
    """with s as (select mid, max(internal_ms) as internal_ms, bool_or(outcome = 'ok') as done, max(case when outcome = 'ok' then internal_ms end) as ms from mail_sync where mid is not null group by mid),
    m as (select max(ms) - 2 * 86400000 as resume_ms from s)
    select mid, internal_ms from s, m where not coalesce(done, false) or (not coalesce(done, false) and (resume_ms is null or internal_ms >= resume_ms))"""
)
def next_fetches(spark, d):
    log = load(spark, d, "mail_sync")
    return incremental.next_batch(log.where("mid is not null").groupBy("mid").agg(F.max("internal_ms").alias("internal_ms")), incremental.sync_state(log))


@query(_PRINT(_LISTING))
def source_fingerprints(spark, d):
    return store.fingerprint(load(spark, d, "chunks").select(F.col("source_kind").alias("kind"), F.col("id").alias("path"), F.col("updated").alias("mtime"), F.length("text").alias("size")).distinct())


@query(
    rf"""with f as (select source_id, string_agg(text, ' ' order by chunk_idx) as full_text from (select distinct source_id, chunk_idx, text from chunks where source_kind = 'screenshot') group by source_id),
    s as (select source_id, string_split_regex(regexp_extract(full_text, '\[([^\]]*)\]', 1), ',\s*') as labels, length({_STRIP(r"regexp_replace(full_text, '^[^\[\n]*\[[^\]]*\]', '')")})::int as ocr_len from f)
    select source_id, ocr_len, case when ocr_len >= 200 and not list_has_any(labels, {classify.SCENE}) then 'text' when ocr_len >= 200 then 'mixed' else 'unassigned' end as bucket from s"""
)
def triage_rules(spark, d):
    return classify.triage(load(spark, d, "chunks"))


# --- evaluation, embedding, streams -----------------------------------------------------------------------------------


@query(
    f"""with r as ({_FUSE(_KEYWORD)}), rel as (select q.qid, s.id from {_QUERIES} q join {_DOCS} s on contains(s.text, regexp_extract(q.q, '([A-Z][a-z]{{3,}})', 1)) where regexp_extract(q.q, '([A-Z][a-z]{{3,}})', 1) <> ''),
    k as (select q.qid, min(rank) as first_rank from {_QUERIES} q left join (select r.qid, r.rank from r join rel using (qid, id)) x using (qid) group by q.qid)
    select count(*) as n, round(avg(case when first_rank <= 10 then 1.0 else 0.0 end), 9) as recall_at_k, round(avg(case when first_rank <= 10 then 1.0 / first_rank else 0.0 end), 9) as mrr from k"""
)
def eval_metrics(spark, d):
    q = item_queries(spark, d)
    names = q.select("qid", F.regexp_extract("q", "([A-Z][a-z]{3,})", 1).alias("needle")).where("needle <> ''")
    relevant = search.containing(documents(spark, d).where("text is not null"), names, F.col("text"), ["id"])
    hits = search.search(documents(spark, d), q, indexed(spark, d), AS_OF, keyword_only=True)
    return evaluate.metrics(evaluate.hit_ranks(hits, relevant, q))


_JSON = lambda name, c: f"""coalesce('"{name}":' || to_json(nullif({c}, ''))::varchar || ',', '')"""


@query(
    f"""with r as ({_FUSE(_KEYWORD)}) select '{{"qid":' || r.qid || ',"rank":' || r.rank || ',' || {_JSON("source", "s.source_kind")} || {_JSON("created", "s.created")} || {_JSON("project", "s.project")} || {_JSON("title", "s.title")} || '"sem":0.0,"kw":true,"id":' || to_json(r.id)::varchar || '}}' as line from r join {_DOCS} s using (id)"""
)
def search_lines(spark, d):
    return search.to_jsonl(search.search(documents(spark, d), item_queries(spark, d), indexed(spark, d), AS_OF, keyword_only=True))


@query(
    f"""with r as ({_FUSE(_KEYWORD)}), t as (select r.qid, r.rank, r.id, s.text, list_min(list_filter([strpos(lower(s.text), w) for w in list_slice({_ORDERED(_TERMS("q.q"))}, 1, 12)], lambda p: p > 0)) as p from r join {_DOCS} s using (id) join {_QUERIES} q using (qid))
    select qid, rank, id, regexp_replace(substring(text, greatest(1, coalesce(p, 1) - 40), 160), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') as snippet from t"""
)
def search_snippets(spark, d):
    q = item_queries(spark, d)
    hits = search.search(documents(spark, d), q, indexed(spark, d), AS_OF, keyword_only=True).select("qid", "rank", "id")
    return search.with_text(hits, documents(spark, d)).join(small(q), "qid").select("qid", "rank", "id", search.snippet(F.col("text"), F.col("q")).alias("snippet"))


@query()
def embed_pending(spark, d):
    backlog = classify.embed_backlog(load(spark, d, "chunks"), load(spark, d, "email_class"))
    return embedding.embed(backlog.select("id", "text"))


@query()
def parse_mails(spark, d):
    mails = load(spark, d, "chunks").where("source_kind = 'email'").select("id", "text").distinct()
    return records.mails(mails.select(F.encode(F.regexp_replace("text", r"^([^\n]*)\n", "Subject: $1\n"), "UTF-8").alias("raw"), F.col("id").alias("origin")))


@query(
    """with s as (select distinct * from mail_sync), m as (select mid, max(attempt) as attempts, bool_or(outcome = 'ok') as done, max(case when outcome = 'ok' then internal_ms end) as ms from s where mid is not null group by mid)
    select mid, attempts, done, ms from m"""
)
def sync_state(spark, d):
    return incremental.sync_state(load(spark, d, "mail_sync"))


@query(
    """with m as (select mid, bool_or(outcome = 'ok') as done, max(case when outcome = 'ok' then internal_ms end) as ms from mail_sync where mid is not null group by mid)
    select max(ms) as watermark_ms, max(ms) - 2 * 86400000 as resume_ms, count(*) filter (where not done) as retry from m"""
)
def sync_watermark(spark, d):
    return incremental.watermark(incremental.sync_state(load(spark, d, "mail_sync")))


@query("select mid, min(sync_id) as first_sync, max(attempt) as attempts, count(*) as n from (select distinct * from mail_sync where mid is not null) group by mid")
def stream_mail_sync(spark, d):
    return incremental.run_available(spark, d)


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def stream_events(spark, d):
    return incremental.drain_events(spark, d)


@query("select mid, min(sync_id) as first_sync, max(attempt) as attempts, count(*) as n from (select distinct * from mail_sync where mid is not null) group by mid")
def stream_resumed(spark, d):
    place = f"{shared_dir(spark).rstrip('/')}/lodestone-streams/resumed-{uuid.uuid4().hex}"
    incremental.run_available(spark, d, place)
    return incremental.run_available(spark, d, place)


@query("select distinct text || chr(10) as text from chunks where source_kind = 'email' and text is not null")
def mbox_texts(spark, d):
    place = f"{shared_dir(spark).rstrip('/')}/lodestone-mbox/{uuid.uuid4().hex}"
    mails = load(spark, d, "chunks").where("source_kind = 'email' and text is not null").select("text").distinct()
    mails.select(F.concat(F.lit("From MAILER Mon Jan  1 00:00:00 2024\n"), "text")).write.text(place)
    return raw_mails(spark, place, 1 << 20).select(F.regexp_replace(F.col("raw").cast("string"), r"\A[^\n]*\n", "").alias("text"))


_BODIES = rf"""(select upper(list_extract(string_split(source_id, 'photo:'), -1)) as uuid, substring({_STRIP(r"regexp_replace(string_agg(text, ' ' order by chunk_idx), '^\S+\s*\[[^\]]*\]', '')")}, 1, 1200) as body from (select distinct source_id, chunk_idx, text from chunks where source_kind = 'screenshot') group by source_id)"""
_WORDS = "string_split_regex(lower(body), '[\\s\\p{Z}]+')"
_VERDICTS = f"""(select uuid, case when (contains(lower(body), 'http') or contains(lower(body), 'www.') or regexp_matches(body, '[0-9][.,][0-9][0-9]')) and not p then 'impersonal' when p then 'personal' else 'ambiguous' end as label
    from (select *, list_has_any({_WORDS}, ['i', 'me', 'my', 'you', 'jag', 'mig', 'min', 'du', 'dig', 'vi', 'we', 'love', 'älskar']) as p from {_BODIES}))"""


@query(f"select uuid, body from {_BODIES}")
def verdict_targets(spark, d):
    bodies = verdicts.object_bodies(load(spark, d, "chunks"))
    return verdicts.targets(bodies.select(F.lower("uuid").alias("uuid")), bodies)


def _verdicts(spark, d):
    """Verdicts on the screenshots in two runs: the second takes what the first left."""
    place = f"{shared_dir(spark).rstrip('/')}/lodestone-verdicts/{uuid.uuid4().hex}"
    wanted = verdict_targets(spark, d)
    verdicts.append(verdicts.label(wanted.where("uuid < '8'")), place)
    verdicts.append(verdicts.label(verdicts.pending(wanted, verdicts.read(spark, place))), place)
    return verdicts.read(spark, place)


@query(f"select label, count(*) as n from {_VERDICTS} group by label")
def verdict_counts(spark, d):
    return verdicts.counts(_verdicts(spark, d))


@query(f"select uuid from {_VERDICTS} where label <> 'personal' and label = 'impersonal' and uuid not in (select uuid from {_BODIES} where length(body) % 2 = 0)")
def verdict_removable(spark, d):
    kept = verdict_targets(spark, d).where(F.length("body") % 2 == 0).select("uuid")
    return verdicts.removable(_verdicts(spark, d), kept)


# --- hybrid search over the chunk table: several chunks an object, vectors of the chunks, scope in every layer ------------


def chunk_rows_of(spark, d):
    return load(spark, d, "chunks").where("id is not null").withColumn("created", F.coalesce("created", F.lit("")))


def chunk_queries(spark, d):
    """Of each kind its first title as a query, of every other kind within its kind, with the first usable vector of the kind."""
    vec = F.col("embedding")
    usable = (F.size(vec) == 64) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    own = load(spark, d, "chunks").groupBy("source_kind").agg(F.min(F.when(F.trim("title") != "", F.col("title"))).alias("q"), F.min(F.when(vec.isNotNull() & usable, F.struct("id", "embedding"))).alias("v"))
    numbered = own.withColumn("qid", F.row_number().over(Window.orderBy("source_kind")))
    return numbered.select("qid", "q", F.when(F.col("qid") % 2 == 0, F.array("source_kind")).alias("kinds"), F.col("v.embedding").alias("vector"))


_USABLE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
_ROWS = "(select id, any_value(source_kind) as source_kind, any_value(source_id) as source_id, any_value(project) as project, any_value(title) as title, any_value(text) as text, coalesce(any_value(created), '') as created, any_value(embedding) as embedding from chunks where id is not null group by id)"
_CQ = f"""(select qid, q, case when qid % 2 = 0 then [source_kind] end as kinds, v.embedding as vector from (select *, row_number() over (order by source_kind) as qid from (select source_kind, min(case when trim(title) <> '' then title end) as q, arg_min(struct_pack(embedding), id) filter ({_USABLE}) as v from chunks group by source_kind)))"""
_IN = "(w.kinds is null or list_contains(w.kinds, i.source_kind))"
_CINDEX = f"(select term, id, source_kind, count(*) as tf from (select id, source_kind, unnest({_TOKENS("concat_ws(' ', title, text)")}) as term from {_ROWS}) group by all)"
_CHUNK_SEARCH = f"""with q as materialized (select * from {_CQ}), s as materialized (select * from {_ROWS}), ix as materialized (select * from {_CINDEX}),
    strict as (select qid, id, row_number() over (partition by qid order by kw desc, id) as rank from (select qid, id, sum(tf) as kw from ix i join (select qid, kinds, len(list_distinct({_TOKENS("q")})) as n, unnest(list_distinct({_TOKENS("q")})) as term from q) w using (term) where {_IN} group by qid, id, n having count(*) = n)),
    soft as (select qid, id, row_number() over (partition by qid, want order by kw desc, id) as rank from (select qid, want, id, sum(tf) as kw from ix i join (select qid, kinds, unnest(case when len(rest) > 0 then rest else terms end) as want from (select *, list_filter(terms, lambda t: not list_contains({_GENERIC}, t)) as rest from (select qid, kinds, list_slice({_ORDERED(_TERMS("q"))}, 1, 12) as terms from q))) w
        on case when length(want) >= 4 then starts_with(i.term, want) else i.term = want end where {_IN} group by qid, want, id)),
    exact as (select qid, id, row_number() over (partition by qid order by len, id) as rank from (select qid, id, length(text) as len from s i join (select qid, kinds, lower({_STRIP("q")}) as needle from q where len(list_distinct({_TERMS("q")})) between 1 and 5) w on contains(lower(i.text), needle) where {_IN})),
    near as (select qid, id, sem, row_number() over (partition by qid order by sem desc, id) as rank from (select qid, id, case when list_dot_product(embedding::double[], embedding::double[]) = 0 then 0.0 else {_COS("vector", "embedding")} end as sem from (select * from s where {_USABLE}) i, q w where vector is not null and {_IN})),
    layers as (select qid, id, 2.4 / (60.0 + rank) as part, null::double as sem, true as exact from exact where rank <= 25 union all select qid, id, 1.6 / (60.0 + rank), null, false from strict where rank <= 80
        union all select qid, id, 0.35 / (60.0 + rank), null, false from soft where rank <= 12 union all select qid, id, 1.0 / (60.0 + rank), sem, false from near where rank <= 80),
    f as (select qid, id, sum(part) as part, max(sem) as sem, bool_or(exact) as exact from layers group by qid, id),
    c as (select f.*, s.source_kind, s.source_id, s.project, round(part + case when exact then 0.02 else 0.0 end + case when s.source_kind in ('doc', 'session', 'git_commit', 'code') and regexp_matches(s.created, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_cast(s.created as date) is not null
        then 0.05 * greatest(0.0, 1.0 - greatest(date_diff('day', try_cast(s.created as date), date '{AS_OF}'), 0) / 730.0) else 0.0 end, 9) as score from f join s using (id)),
    one as (select * from (select *, row_number() over (partition by qid, source_id order by score desc, coalesce(sem, 0.0) desc, id) as r from c) where r = 1)
    select qid, rank, id, source_id, source_kind, project, score from (select *, row_number() over (partition by qid order by score desc, coalesce(sem, 0.0) desc, id) as rank from one) where rank <= 12"""


@query(_CHUNK_SEARCH)
def hybrid_chunks(spark, d):
    hits = search.search(chunk_rows_of(spark, d), chunk_queries(spark, d), indexed(spark, d, "chunks"), AS_OF)
    return hits.select("qid", "rank", "id", "source_id", "source_kind", "project", "score")


@query(
    f"""with r as ({_CHUNK_SEARCH}), h as (select r.qid, min(r.rank) as first_rank from r join {_ROWS} t using (id) join {_CQ} w using (qid) where contains(lower(concat_ws(chr(10), t.id, t.source_kind, t.project, t.title, t.text, t.created)), lower(w.q)) and (w.kinds is not null or contains(lower(t.source_kind), 'o')) group by r.qid)
    select w.qid, h.first_rank from {_CQ} w left join h using (qid)"""
)
def eval_scoped(spark, d):
    q = chunk_queries(spark, d)
    fields = F.when(F.col("kinds").isNull(), F.create_map(F.lit("source_kind"), F.lit("O"))).otherwise(F.create_map().cast("map<string,string>"))
    never = F.struct(F.lit("\x01 nowhere").alias("text"), F.create_map().cast("map<string,string>").alias("fields"))
    cases = q.select("qid", F.array(F.struct(F.col("q").alias("text"), fields.alias("fields")), never).alias("expectations"))
    hits = search.search(chunk_rows_of(spark, d), q, indexed(spark, d, "chunks"), AS_OF)
    return evaluate.hit_ranks(hits, evaluate.judge(search.with_text(hits, chunk_rows_of(spark, d)), cases), q)
