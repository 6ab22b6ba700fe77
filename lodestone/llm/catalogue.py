"""Registry of the text-corpus queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.runtime import load
from lodestone.llm.email_lines import new_lines
from lodestone.llm.encoding_repair import find_garbled, restore
from lodestone.llm.language import fit, relabel
from lodestone.llm.leakage import leaked, leaks
from lodestone.llm.neighbours import similar_pairs
from lodestone.llm.personal_data import find_mentions
from lodestone.llm.residue import to_exclude
from lodestone.llm.splitting import split_oversized
from lodestone.llm.tokenising import encode_column

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_END = r"""case when length(text) - s <= 750 then length(text) else s + coalesce(nullif(greatest(length(regexp_extract(substring(text, s + 1, 750), '(?s)^.{374,748}\n\n')), length(regexp_extract(substring(text, s + 1, 750), '(?s)^.{373,747}\n\r\n'))), 0),
    nullif(length(regexp_extract(substring(text, s + 1, 750), '(?s)^.{375,749}\n')), 0), nullif(length(regexp_extract(substring(text, s + 1, 750), '(?s)^.{374,748}[.!?] ')), 0), nullif(length(regexp_extract(substring(text, s + 1, 750), '(?s)^.{375,749} ')), 0), 750) end"""
_GAP = r"length(regexp_extract(substring(text, e - 80, 80), '^[^ \n]*'))"


@query(
    f"""with recursive p as (select distinct id, text, 0 as piece_no, 0::bigint as s from chunks where source_kind not in ('git_commit', 'code') and length(text) > 750
    union all select id, text, piece_no + 1, e - 80 + case when {_GAP} < 80 then {_GAP} else 0 end from (select *, {_END} as e from p) where e < length(text))
    select id, piece_no, s::int as start_pos, ({_END})::int as end_pos from p"""
)
def p5_found(spark, d):
    return split_oversized(load(spark, d, "chunks").where(~F.col("source_kind").isin("git_commit", "code")))


@query()
def p1_found(spark, d):
    return find_garbled(load(spark, d, "chunks"))


@query()
def p1_restored(spark, d):
    return restore(load(spark, d, "chunks"))


@query()
def p2_found(spark, d):
    return similar_pairs(load(spark, d, "chunks"))


@query()
def p8_ids(spark, d):
    return encode_column(load(spark, d, "documents"))


@query()
def p6_found(spark, d):
    return new_lines(load(spark, d, "chunks").where("source_kind = 'email'"))


@query()
def p3_found(spark, d):
    rows = load(spark, d, "chunks").where(F.col("source_kind").isin("note", "doc", "aichat", "messenger"))
    return relabel(rows, load(spark, d, "lang_labels"), fit(load(spark, d, "documents"))).select("id", "seg_no", "lang")


@query()
def p10_found(spark, d):
    return to_exclude(load(spark, d, "documents"))


@query()
def p9_found(spark, d):
    return leaked(load(spark, d, "documents"), load(spark, d, "eval_items"))


@query()
def p9_matches(spark, d):
    return leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


@query()
def p4_found(spark, d):
    return find_mentions(load(spark, d, "chunks"))
