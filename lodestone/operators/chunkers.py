"""Chunk row construction: fixed windows, heading-aware markdown, syntax-aware code."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.runtime import spread
from lodestone.functions.text import content_hash, strip, windows, without_nul
from lodestone.operators import code_blocks
from lodestone.schema import DEFAULT

COLUMNS = ["id", "source_kind", "source_id", "chunk_idx", "project", "title", "text", "created", "updated", "content_hash"]


def chunk_rows(objects: DataFrame, kind: str | Column, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.overlap, most: int | None = DEFAULT.max_chunks, single: bool = False) -> DataFrame:
    """Chunk rows of source objects (source_id, project, title, full, created, updated).

    NULs are dropped, an empty updated falls back to created, a blank or null full text gives no row. single keeps an object whole.
    """
    body = strip(without_nul(F.col("full")))
    parts = F.when(F.length(body) > 0, F.array(body)).otherwise(F.array().cast("array<string>")) if single else windows(F.col("_body"), size, overlap, most)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    created = F.coalesce(F.col("created"), F.lit(""))
    return (
        spread(objects).withColumn("_body", body)
        .where(F.length("_body") > 0)
        .select("source_id", kind.alias("source_kind"), "project", without_nul(F.col("title")).alias("title"), created.alias("created"), F.coalesce(F.nullif(F.col("updated"), F.lit("")), created).alias("updated"), F.posexplode(parts).alias("chunk_idx", "text"))
        .withColumn("id", F.concat("source_id", F.lit("#"), F.col("chunk_idx").cast("string")))
        .withColumn("content_hash", content_hash(F.col("text")))
        .select(*COLUMNS)
    )


_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")


def markdown_chunks(text: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.overlap, most: int | None = DEFAULT.max_doc_chunks) -> list[str]:
    """Windows per section, each headed by the path of headings above it; the prefix counts against the size (at least 200 stay). most: None for no cap."""
    sections: list[tuple[list[str], list[str]]] = [([], [])]
    path: list[str] = []
    for line in text.split("\n"):
        if m := _HEADING.match(line):
            path = path[: len(m[1]) - 1] + [m[2]]
            sections.append((path, [line]))
        else:
            sections[-1][1].append(line)
    out: list[str] = []
    for heads, lines in sections:
        body = "\n".join(lines).strip()
        if not body:
            continue
        prefix = "Heading: " + " > ".join(heads) + "\n\n" if heads else ""
        room = max(200, size - len(prefix))
        for start in range(0, len(body), max(1, room - overlap)):
            if len(out) == most:
                return out
            out.append(prefix + body[start : start + room])
    return out


def chunk_markdown(objects: DataFrame, kind: str = "doc", size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.overlap, most: int | None = DEFAULT.max_doc_chunks) -> DataFrame:
    """Heading-aware chunk rows; the input is as for chunk_rows. A heading stack is sequential per document, hence Python per batch."""
    extra = "source_id string, project string, title string, created string, updated string, chunk_idx int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:5], k, t) for r in b[["source_id", "project", "title", "created", "updated", "full"]].itertuples(index=False) for k, t in enumerate(markdown_chunks((r[5] or "").replace("\x00", ""), size, overlap, most))]
            yield pd.DataFrame(rows, columns=["source_id", "project", "title", "created", "updated", "chunk_idx", "text"])

    cut = spread(objects).select("source_id", "project", without_nul(F.col("title")).alias("title"), F.coalesce("created", F.lit("")).alias("created"), F.coalesce(F.nullif("updated", F.lit("")), "created", F.lit("")).alias("updated"), "full").mapInPandas(run, extra)
    return cut.withColumns({"source_kind": F.lit(kind), "id": F.concat("source_id", F.lit("#"), F.col("chunk_idx").cast("string")), "content_hash": content_hash(F.col("text"))}).select(*COLUMNS)


def plain_chunks(objects: DataFrame, size: int = 750, most: int = 60) -> DataFrame:
    """(id, title, text) of the simpler engine: up to `most` pieces of `size` characters without overlap; several are numbered in id and title."""
    body = strip(without_nul(F.col("full")))
    parts = objects.withColumn("_p", windows(body, size, 0, most)).where(F.size("_p") > 0)
    rows = parts.select("source_id", "title", F.size("_p").alias("n"), F.posexplode("_p").alias("k", "text"))
    many = F.col("n") > 1
    place = F.concat(F.coalesce("title", F.lit("")), F.lit(" ["), (F.col("k") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("]"))
    return rows.select(F.when(many, F.concat("source_id", F.lit("#"), F.col("k").cast("string"))).otherwise(F.col("source_id")).alias("id"), F.when(many, place).otherwise(F.col("title")).alias("title"), "text")


def dropped_chunks(objects: DataFrame, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.overlap, most: int = DEFAULT.max_chunks) -> DataFrame:
    """(source_id, dropped): how many windows of an object chunk_rows leaves out beyond `most`, for the objects that lose any."""
    n = F.length(strip(without_nul(F.col("full"))))
    windows_of = F.ceil(n / F.lit(max(1, size - overlap)))
    return objects.select("source_id", (windows_of - most).cast("long").alias("dropped")).where("dropped > 0")


# File extensions of the languages that have a grammar.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx",
    "rb": "ruby", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "c_sharp", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "bash": "bash", "lua": "lua", "ex": "elixir", "exs": "elixir",
}


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition(".")[2].lower()) if "." in path else None


def _size(lines: list[str]) -> int:
    return sum(len("".join(x.split())) for x in lines)


def _python_spans(body: list[ast.stmt], start: int, stop: int, lines: list[str], budget: int) -> list[tuple[int, int]]:
    """Greedy merge of neighbouring statements up to the budget; a statement above it is split at its own body."""
    spans: list[tuple[int, int]] = []
    at = start
    edges = [(node, node.end_lineno or node.lineno) for node in body]
    for k, (node, end) in enumerate(edges):
        end = stop if k == len(edges) - 1 else end
        if end <= at:
            continue
        inner = [n for n in getattr(node, "body", []) if isinstance(n, ast.stmt)]
        if _size(lines[at:end]) > budget and inner and inner[0].lineno > node.lineno:
            head = inner[0].lineno - 1
            first = _python_spans(inner, head, end, lines, budget)
            spans += [(at, first[0][1]), *first[1:]] if first and _size(lines[at : first[0][1]]) <= budget else [(at, head), *first]
        elif spans and _size(lines[spans[-1][0] : end]) <= budget and spans[-1][1] == at:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((at, end))
        at = end
    return spans


def _line_spans(lines: list[str], budget: int) -> list[tuple[int, int]]:
    """Runs of lines that close once they reach the budget."""
    spans, start = [], 0
    for k in range(len(lines)):
        if _size(lines[start : k + 1]) >= budget:
            spans.append((start, k + 1))
            start = k + 1
    if start < len(lines):
        spans.append((start, len(lines)))
    return spans


def _definitions(tree: ast.AST, trail: tuple[str, ...] = ()) -> Iterator[tuple[int, str, str]]:
    """(line, dotted name, kind) of all functions and classes."""
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield first - 1, ".".join((*trail, node.name)), "class" if isinstance(node, ast.ClassDef) else "function"
            yield from _definitions(node, (*trail, node.name))
        else:
            yield from _definitions(node, trail)


def code_chunks(source: str, path: str, language: str | None = None, budget: int = 1200, least: int = 80) -> list[tuple]:
    """(language, symbols, kind, start_line, end_line, body, text) pieces of a source file that keep every non-blank character.

    Python is cut along its syntax tree, languages with braces along their blocks, others and broken files along lines; pieces under
    `least` join the one before.
    """
    language = language or language_of(path) or "text"
    lines = source.split("\n")
    spans, found = [], []
    if language == "python":
        try:
            tree = ast.parse(source)
            spans, found = _python_spans(tree.body, 0, len(lines), lines, budget), list(_definitions(tree))
        except (SyntaxError, ValueError, RecursionError):
            spans = []
    elif language in code_blocks.BRACES:
        depth = code_blocks.depths(source, language == "php")
        spans, found = code_blocks.spans(lines, depth, budget, _size), list(code_blocks.definitions(lines, depth))
    spans = spans or _line_spans(lines, budget)
    merged: list[tuple[int, int]] = []
    for s, e in spans:
        if merged and _size(lines[s:e]) < least:
            merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    if len(merged) > 1 and _size(lines[slice(*merged[0])]) < least:
        merged[:2] = [(merged[0][0], merged[1][1])]
    out = []
    for s, e in merged:
        body = "\n".join(lines[s:e])
        if not body.strip():
            continue
        own = [(name, kind) for at, name, kind in found if s <= at < e]
        symbols = list(dict.fromkeys(name for name, _ in own))
        kind = own[0][1] if own else "module"
        out.append((language, symbols, kind, s + 1, e, body, f"[{path}] {kind} {', '.join(symbols)} (L{s + 1}-{e})\n{body}"))
    return out


def chunk_code(files: DataFrame, budget: int = DEFAULT.code_budget, least: int = DEFAULT.code_min) -> DataFrame:
    """(repo, path, language, symbols, symbol_kind, start_line, end_line, body, text) of source files (repo, path, source)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(repo, path, *c) for repo, path, source in b[["repo", "path", "source"]].itertuples(index=False) if source and path for c in code_chunks(source, path, None, budget, least)]
            yield pd.DataFrame(rows, columns=["repo", "path", "language", "symbols", "symbol_kind", "start_line", "end_line", "body", "text"])

    return files.select("repo", "path", "source").mapInPandas(run, "repo string, path string, language string, symbols array<string>, symbol_kind string, start_line int, end_line int, body string, text string")


def code_rows(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunk rows of chunk_code's pieces: ids by repository, path and place, titles `path › symbols` of at most 120 characters, dated by
    the files' modified day where files (repo, path[, modified]) has it."""
    place = F.row_number().over(Window.partitionBy("repo", "path").orderBy("start_line", "end_line")) - 1
    source = F.concat(F.lit("code:"), "repo", F.lit(":"), "path")
    symbols = F.array_join("symbols", " ")
    title = F.substring(F.when(symbols != "", F.concat("path", F.lit(" › "), symbols)).otherwise(F.col("path")), 1, 120)
    if "modified" in files.columns:
        chunks = chunks.join(files.groupBy("repo", "path").agg(F.min("modified").cast("string").alias("created")), ["repo", "path"], "left")
    else:
        chunks = chunks.withColumn("created", F.lit(""))
    rows = chunks.withColumns({"chunk_idx": place, "source_id": source, "source_kind": F.lit("code"), "project": F.col("repo"), "title": without_nul(title), "created": F.coalesce("created", F.lit(""))})
    return rows.withColumns({"text": without_nul(F.col("text")), "updated": F.col("created")}).withColumns({"id": F.concat("source_id", F.lit("#"), F.col("chunk_idx").cast("string")), "content_hash": content_hash(F.col("text"))}).select(*COLUMNS)
