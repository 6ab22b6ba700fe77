"""Figures and summaries over the chunk table and its side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_kind(chunks: DataFrame) -> DataFrame:
    """(source_kind, n, embedded, pending) per kind, and with a null kind over all."""
    return chunks.rollup("source_kind").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"), (F.count("*") - F.count("embedding")).alias("pending"))


def top_projects(chunks: DataFrame, most: int = 20) -> DataFrame:
    """(project, n) of the largest projects; ties by name."""
    return chunks.where("project is not null").groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(most)


def per_class(mail_class: DataFrame) -> DataFrame:
    """(mail_class, mails): distinct mails of each class."""
    return mail_class.groupBy("mail_class").agg(F.count_distinct("mid").alias("mails"))


def last_class(mail_class: DataFrame) -> DataFrame:
    """(mid, mail_class, n): the class of each mail's last row by sender domain, then class, and its rows; null mids are left out."""
    order = F.struct(F.coalesce("sender_domain", F.lit("")).alias("d"), F.coalesce("mail_class", F.lit("")).alias("c"))
    best = F.max(F.struct(order.alias("o"), "mail_class"))
    return mail_class.where("mid is not null").groupBy("mid").agg(best["mail_class"].alias("mail_class"), F.count("*").alias("n"))


def unclassified(chunks: DataFrame, mail_class: DataFrame) -> DataFrame:
    """One row (unclassified): mails without a class."""
    heads = chunks.where("source_kind = 'email' and chunk_idx = 0").select(F.col("source_id").alias("mid")).distinct()
    return heads.join(mail_class, "mid", "left_anti").agg(F.count("*").alias("unclassified"))


def object_texts(chunks: DataFrame) -> DataFrame:
    """(source_id, full_text, n): each object's chunks in order, joined by a space; repeated rows count once."""
    rows = chunks.select("source_id", "chunk_idx", "text").distinct()
    return rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda r: r["text"]), " ").alias("full_text"), F.count("*").alias("n"))


def oldest_of(rows: DataFrame, key: Column) -> DataFrame:
    """(key, first_id, oldest, n): per key the least id, the least non-empty created and the distinct (id, created) rows; null keys are left out."""
    own = rows.select("id", "created", key.alias("key")).where("key is not null").distinct()
    return own.groupBy("key").agg(F.min("id").alias("first_id"), F.min(F.nullif("created", F.lit(""))).alias("oldest"), F.count("*").alias("n"))


def first_of_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(keeper, copies) of each text: its least id and how often it occurs. Texts meet by two hashes, so none is shuffled; null texts are left out."""
    keys = [F.xxhash64(text_col).alias("k0"), F.sha1(F.encode(text_col, "UTF-8")).alias("k1")]
    return documents.where(F.col(text_col).isNotNull()).groupBy(*keys).agg(F.min(id_col).alias("keeper"), F.count("*").alias("copies")).select("keeper", "copies")


def labels_per_object(labels: DataFrame) -> DataFrame:
    """(id, label_rows, labels): rows and distinct labels of each id."""
    return labels.groupBy("id").agg(F.count("*").alias("label_rows"), F.count_distinct("label").alias("labels"))


def note_titles(chunks: DataFrame) -> DataFrame:
    """oldest_of the notes by their lower-case title."""
    return oldest_of(chunks.where("source_kind = 'note'"), F.trim(F.lower("title")))

