"""The chunk store: upsert that keeps vectors of unchanged texts, and pruning guarded by how each source's run ended."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.runtime import small
from lodestone.schema import CHUNKS, PROJECT_SCOPED


class SourceStatus(Enum):
    """How a source's run ended; only COMPLETE lets its absent rows be pruned."""

    COMPLETE = "complete"
    UNCHANGED = "unchanged"
    UNAVAILABLE = "unavailable"
    PARTIAL = "partial"


def upsert(old: DataFrame, new: DataFrame, key: str = "id", hash_col: str = "content_hash", vector_col: str = "embedding") -> DataFrame:
    """old with the rows of new put in by key; a row keeps its vector unless its hash changed.

    Both sides count each key once (of several rows the one with the least hash, then the least other columns). One full outer join on
    the key; unchanged columns of old rows pass through, columns that only one side has stay with null for the other.
    """

    def one(df: DataFrame) -> DataFrame:
        order = [hash_col, *[c for c in df.columns if c not in (key, hash_col) and "map<" not in df.schema[c].dataType.simpleString()]]
        return df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")

    o, n = one(old).alias("o"), one(new).withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.coalesce(F.col("n._new"), F.lit(False))
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]:
        if c == vector_col:
            kept = F.when(F.col(f"o.{hash_col}").eqNullSafe(F.col(f"n.{hash_col}")), F.col(f"o.{c}")) if c in old.columns else F.lit(None)
            fresh = F.coalesce(F.col(f"n.{c}"), kept) if c in new.columns else kept
            out.append(F.when(is_new, fresh).otherwise(F.col(f"o.{c}") if c in old.columns else None).alias(c))
        elif c in new.columns and c in old.columns:
            out.append(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in new.columns:
            out.append(F.col(f"n.{c}").alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def prune(store: DataFrame, seen: DataFrame, status: dict[str, SourceStatus], allow_empty: bool = False) -> DataFrame:
    """store without orphans: rows of COMPLETE kinds whose id this run did not see; code and commits only within projects it saw.

    seen has (id, source_kind, project). A COMPLETE kind that saw nothing is spared unless allow_empty. Rows with a null id go.
    """
    complete = [k for k, s in status.items() if s is SourceStatus.COMPLETE]
    whole = [k for k in complete if k not in PROJECT_SCOPED]
    if not allow_empty:
        present = {r[0] for r in seen.where(F.col("source_kind").isin(*whole)).select("source_kind").distinct().collect()} if whole else set()
        whole = [k for k in whole if k in present]
    scoped = [k for k in complete if k in PROJECT_SCOPED]
    ids = seen.where(F.col("id").isNotNull()).select("id").distinct().withColumn("_seen", F.lit(True))
    projects = small(seen.where(F.col("source_kind").isin(*PROJECT_SCOPED) & F.col("project").isNotNull()).select("source_kind", "project").distinct().withColumn("_project", F.lit(True)))
    marked = store.where(F.col("id").isNotNull()).join(ids, "id", "left").join(projects, ["source_kind", "project"], "left")
    orphan = F.col("_seen").isNull() & (F.col("source_kind").isin(*whole) | F.col("source_kind").isin(*scoped) & F.col("_project").isNotNull())
    return marked.where(~F.coalesce(orphan, F.lit(False))).select(*store.columns)


def write_store(rows: DataFrame, path: str, name: str) -> str:
    """rows as a new version `name` of the store, partitioned by kind; returns its path. The caller switches readers over to it, so a
    version is never overwritten while it is read. Files are sized by adaptive execution: a large kind is split, small ones are not."""
    target = f"{path.rstrip('/')}/version={name}"
    rows.select(*CHUNKS.fieldNames()).hint("rebalance", "source_kind").write.partitionBy("source_kind").parquet(target)
    return target


def write_kinds(rows: DataFrame, path: str, name: str) -> dict[str, str]:
    """write_store, and the folder of each kind in it."""
    target = write_store(rows, path, name)
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    folders = [f.getPath().getName() for f in found if f.isDirectory()]
    return {f.partition("=")[2]: f"{target}/{f}" for f in folders if f.startswith("source_kind=")}


def set_vectors(store: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """store with the vectors (id, embedding) put in, rounded to the stored number of digits; of several for an id the least counts."""
    fresh = vectors.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("embedding").alias("_vec"))
    rounded = F.transform("_vec", lambda x: F.round(x.cast("double"), digits).cast("float"))
    return store.join(fresh, "id", "left").withColumn("embedding", F.coalesce(rounded, "embedding")).select(*store.columns)


def fingerprint(files: DataFrame) -> DataFrame:
    """(kind, fingerprint) of listings (kind, path, mtime, size): SHA-1 over the sorted entries' hashes; equal listings give equal prints.

    Entries are hashed one by one and summed in 128 buckets before they are joined, so no kind's listing meets in one row.
    """
    entry = F.sha1(F.concat_ws("|", "path", F.col("mtime").cast("string"), F.col("size").cast("string")).cast("binary"))
    parts = files.select("kind", entry.alias("h")).withColumn("b", F.substring("h", 1, 2))
    sums = [F.sum(F.conv(F.substring("h", 3 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    buckets = parts.groupBy("kind", "b").agg(F.count("*").alias("n"), *sums)
    line = F.concat_ws(":", "b", "n", *[f"s{k}" for k in range(4)])
    return buckets.select("kind", line.alias("l")).groupBy("kind").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("l")), ",").cast("binary")).alias("fingerprint"))


def changed_kinds(now: DataFrame, before: DataFrame) -> DataFrame:
    """(kind) whose fingerprint is new or differs from the stored one."""
    b = before.withColumnRenamed("fingerprint", "_old")
    return now.join(b, "kind", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).select("kind")
