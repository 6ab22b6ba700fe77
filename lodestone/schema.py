"""Types of the chunk table and the constants of its semantics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KINDS = ("messenger", "aichat", "note", "doc", "session", "email", "things3", "fyr", "screenshot", "git_commit", "code")
#: Kinds whose records tell of projects; only these get the recency term.
PROJECT_KINDS = ("doc", "session", "git_commit", "code")
#: Kinds that are pruned by project rather than as a whole.
PROJECT_SCOPED = ("git_commit", "code")
#: Mail classes that are not embedded.
SKIP_CLASSES = ("telemetry", "reading")

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("project", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


@dataclass(frozen=True)
class Config:
    """Defaults of the engine; every operator takes one of these or single values."""

    chunk_size: int = 750
    overlap: int = 80
    max_chunks: int = 400
    max_doc_chunks: int = 1200
    embed_head: int = 750
    keyword_limit: int = 80
    semantic_limit: int = 80
    exact_terms: int = 5
    exact_limit: int = 25
    soft_terms: int = 12
    soft_rows: int = 12
    rrf_k: int = 60
    weight_exact: float = 2.4
    weight_strict: float = 1.6
    weight_soft: float = 0.35
    weight_semantic: float = 1.0
    exact_bonus: float = 0.02
    recency_weight: float = 0.05
    recency_days: int = 730
    #: Letters from which a soft term matches as a prefix; None: never.
    prefix_chars: int | None = 4
    session_text_max: int = 12000
    commit_max: int = 4000
    doc_max_bytes: int = 600_000
    code_max_bytes: int = 200_000
    code_budget: int = 700
    code_min: int = 80


DEFAULT = Config()
