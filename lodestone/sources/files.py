"""Files of document roots, listed on the driver with whole folders pruned before they are entered."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.schema import DEFAULT

# Path parts that hold no documents.
SKIPPED_PARTS = ["/archive/", "/vendor/", "/node_modules/"]


def is_placeholder(path: str) -> bool:
    """Whether a file has a size but no blocks on disk, as cloud folders leave behind; one that can't be looked at counts as such."""
    try:
        s = os.stat(path)
    except OSError:
        return True
    return s.st_size > 0 and getattr(s, "st_blocks", 1) == 0


def walk(root: str, suffixes: tuple[str, ...], skipped: list[str] = SKIPPED_PARTS) -> Iterator[str]:
    """Files below root with one of the suffixes; hidden and skipped folders are never entered, unreadable ones passed over."""
    names = {p.strip("/") for p in skipped if p.count("/") == 2}
    for folder, inner, files in os.walk(root):
        inner[:] = sorted(d for d in inner if not d.startswith(".") and d not in names)
        for f in sorted(files):
            path = os.path.join(folder, f)
            if f.endswith(suffixes) and not any(p in path[len(root) :] for p in skipped):
                yield path


@dataclass(frozen=True)
class Root:
    """A document root. mode: `first` takes the first folder as the project (label for a file in the root itself), `label` the label for
    all. patterns: globs below the root instead of a walk."""

    path: str
    suffixes: tuple[str, ...] = (".md", ".txt")
    mode: str = "first"
    label: str = "documents"
    patterns: tuple[str, ...] = ()

    def files(self) -> Iterator[str]:
        root = self.path.rstrip("/")
        if os.path.isfile(root):
            yield root
        elif self.patterns:
            found = sorted({f for p in self.patterns for f in glob.glob(f"{root}/{p}", recursive=True)})
            yield from (f for f in found if f.endswith(self.suffixes) and not any(p in f[len(root) :] for p in SKIPPED_PARTS))
        else:
            yield from walk(root, self.suffixes)


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples(index=False):
            try:
                with open(r.path, encoding="utf-8", errors="replace") as f:
                    stamp = datetime.fromtimestamp(os.stat(r.path).st_mtime, timezone.utc).strftime("%Y-%m-%d")
                    yield pd.DataFrame([(r.rel, r.project, r.title, f.read(), stamp)], columns=["rel", "project", "title", "full", "stamp"])
            except OSError:
                continue


def documents_of(spark: SparkSession, roots: list[Root], most: int = DEFAULT.doc_max_bytes) -> DataFrame:
    """Source objects of the documents of local or mounted roots. A file in several roots counts in the first; placeholders, oversized,
    unreadable and blank files are left out. Created is a date in the file name, else the file's time. Files are listed here, read by tasks."""
    listed, seen = [], set()
    for root in roots:
        base = root.path.rstrip("/")
        for path in root.files():
            if path in seen or is_placeholder(path) or os.path.getsize(path) > most:
                continue
            seen.add(path)
            rel = os.path.relpath(path, base) if path != base else os.path.basename(path)
            parts = rel.split("/")
            listed.append((path, rel, root.label if root.mode == "label" or len(parts) == 1 else parts[0], os.path.splitext(parts[-1])[0]))
    if not listed:
        return spark.createDataFrame([], "source_id string, project string, title string, full string, created string, updated string")
    names = spark.createDataFrame(listed, "path string, rel string, project string, title string")
    files = names.mapInPandas(_contents, "rel string, project string, title string, full string, stamp string")
    named = F.regexp_extract("rel", r"(20\d\d[-_]\d\d[-_]\d\d)[^/]*$", 1)
    rows = files.select("rel", "project", "title", "full", F.when(named != "", F.replace(named, F.lit("_"), F.lit("-"))).otherwise(F.col("stamp")).alias("created"), F.col("stamp").alias("updated"))
    return rows.where(X.strip(F.col("full")) != "").select(F.concat(F.lit("doc:"), "project", F.lit(":"), "rel").alias("source_id"), "project", "title", "full", "created", "updated")
