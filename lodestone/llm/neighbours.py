"""The k most similar vectors of every vector: stable projections in a kd-tree, searched by growing projected distance to a chi-square stop.

Rows are first routed by the signed leading axis of a random (2-stable) rotation of the centred vectors, in several independent tables,
so that one cell is home to about CELL vectors; each goes also to the cells that it is nearest to besides. Inside a cell the
vectors are projected to DIMS Gaussian coordinates and put in a kd-tree. Each leaf of queries takes the leaves in the order of their
projected distance; of these only the vectors are verified that a chi-square test still allows, with probability QUANTILE, to be nearer
than a query's k-th best so far (or the floor), and the search ends where no leaf ahead holds any. A vector so dense in neighbours
that it has k of them early thus verifies few of the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.runtime import small, table_cut

CELL = 2048
TABLES = 2
#: Cells of each table that a vector goes to, its own included; one more where cells are cut twice, as near vectors then part at one more axis.
PROBES = 3
DIMS = 16
LEAF = 128
#: Leaves taken at once: as many as have been taken before, so that the first ones lower the bound of the rest.
FIRST = 1
#: Upper quantile of chi-square with DIMS=16 degrees of freedom at 0.999 (fixed value of the test).
CHI2 = 39.252
#: Cells above HOT vectors are worked off as pairs of blocks of that size, so no task holds more than two blocks.
HOT = 16384
#: Pairs whose cosine is taken at once.
PAIRS = 100_000


def _rotations(dim: int, tables: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(2 * tables)])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def mean_direction(vectors: DataFrame, dim: int) -> np.ndarray:
    """Mean of all unit vectors: one partial sum per task, then one small row to the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dim), 0
        for b in batches:
            if len(b):
                total += _unit(_matrix(b["vec"])).sum(axis=0)
                n += len(b)
        yield pd.DataFrame({"i": range(dim), "s": total, "n": n})

    rows = vectors.select("vec").mapInPandas(sums, "i int, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return np.array([r["s"] / max(r["n"], 1) for r in sorted(rows, key=lambda r: r["i"])])


def _shape(n: int, dim: int) -> tuple[int, int]:
    """(width, fine) of the router, for about CELL vectors at home in a cell at any size: one cell, then up to 2 * dim, then those cut again."""
    width = int(min(dim, round(n / (2 * CELL)))) if n > CELL else 0
    return width, int(np.clip(round(n / (4 * dim * CELL)), 1, dim)) if width == dim else 1


def _leading(z: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` leading signed axes of each row, the first foremost, and how far each lies behind the first."""
    both = np.concatenate([z, -z], axis=1)
    axes = np.argpartition(-both, min(most, both.shape[1]) - 1, axis=1)[:, :most]
    axes = np.take_along_axis(axes, np.argsort(-np.take_along_axis(both, axes, axis=1), axis=1, kind="stable"), axis=1)
    size = np.take_along_axis(both, axes, axis=1)
    return axes, size[:, :1] - size


def _router(dim: int, mean: np.ndarray, tables: int, width: int, fine: int) -> Callable:
    """Cells by the leading of the first `width` axes (all in one for 0), cut again by the leading of `fine` axes of a second rotation;
    of each table the PROBES cells that take the least change of the vector, or one more for cells cut twice."""
    turns, probes = _rotations(dim, tables), PROBES + (fine > 1)

    def cells(x: np.ndarray, t: int) -> np.ndarray:
        if not width:
            return np.zeros((len(x), 1), dtype=np.int64)
        cell, behind = _leading((x @ turns[2 * t])[:, :width], probes)
        if fine > 1:
            part, lag = _leading((x @ turns[2 * t + 1])[:, :fine], probes)
            cell = (cell[:, :, None] * (2 * fine) + part[:, None, :]).reshape(len(x), -1)
            cost = (behind[:, :, None] ** 2 + lag[:, None, :] ** 2).reshape(len(x), -1)
            cell = np.take_along_axis(cell, np.argsort(cost, axis=1, kind="stable")[:, :probes], axis=1)
        return cell.astype(np.int64)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            raw = _matrix(b["vec"])
            x = _unit(raw) - mean
            packed = [v.tobytes() for v in raw]
            for t in range(tables):
                for cell in cells(x, t).T:
                    yield pd.DataFrame({"cell": cell * tables + t, "vid": b["vid"], "vec": packed})

    return route


def _leaves(z: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Leaves of a kd-tree over projected points: median cuts along the widest side."""
    todo, out = [rows], []
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            out.append(part)
            continue
        side = np.ptp(z[part], axis=0).argmax()
        order = part[np.argsort(z[part, side], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[a[at : at + PAIRS]], x[b[at : at + PAIRS]]) for at in range(0, len(a), PAIRS)] or [np.zeros(0, x.dtype)])


def search_block(x: np.ndarray, block: np.ndarray, k: int, floor: float, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, cosine) of pairs within x (unit rows) with cosine >= floor, the best k of each row and ties with the k-th.

    block: 0 for rows that meet all rows, else 1 or 2, of which only rows of different blocks meet. counts gets the numbers of
    pairs in all, of those whose projections were compared, and of those whose cosine was taken.
    """
    n, dim = x.shape
    gauss = np.random.default_rng(11).standard_normal((dim, DIMS))
    z, fast = (x @ gauss).astype(np.float32), x.astype(np.float32)
    norm = np.einsum("ij,ij->i", z, z)[:, None]
    # the product of a row of `ask` and one of `tell` is the squared projected distance, less what is added to the last column of `ask`
    ask, tell = np.hstack([-2 * z, np.ones_like(norm), norm]), np.hstack([z, norm, np.ones_like(norm)])
    leaves = _leaves(z, np.arange(n))
    low = np.stack([z[p].min(axis=0) for p in leaves])
    high = np.stack([z[p].max(axis=0) for p in leaves])
    split = block.any()
    total, compared, verified = n * n, 0, 0
    found: list[tuple] = []
    for i, mine in enumerate(leaves):
        gap = np.maximum(0, np.maximum(low - high[i], low[i] - high))
        near = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(near, kind="stable")
        worst = np.full(len(mine), max(0.0, 2 - 2 * floor))
        own = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        at, step = 0, FIRST
        while at < len(order):
            reach = CHI2 * worst + 1e-4
            ahead = order[at : at + step]
            ahead = ahead[near[ahead] <= reach.max()]
            if not len(ahead):
                break
            at, step = at + step, at + step
            others = np.concatenate([leaves[j] for j in ahead])
            questions = ask[mine]
            questions[:, -1] -= reach
            compared += len(mine) * len(others)
            a, b = np.divmod(np.flatnonzero(questions @ tell[others].T <= 0), len(others))
            b = others[b]
            keep = mine[a] != b
            if split:
                keep &= (block[mine[a]] != block[b]) | (block[b] == 0)
            a, b = a[keep], b[keep]
            verified += len(a)
            keep = _cosines(fast, mine[a], b) >= floor - 1e-4
            a, b = a[keep], b[keep]
            cos = _cosines(x, mine[a], b)
            keep = cos >= floor
            if keep.any():
                own = _best(*(np.concatenate(v) for v in zip(own, (a[keep], b[keep], cos[keep]))), k)
                full = np.flatnonzero(np.bincount(own[0], minlength=len(mine)) >= k)
                worst[full] = 2 - 2 * own[2][np.searchsorted(own[0], full) + k - 1]
        found.append((mine[own[0]], *own[1:]))
    if counts is not None:
        for name, number in (("pairs", total), ("compared", compared), ("verified", verified)):
            counts[name] = counts.get(name, 0) + number
    a, b, cos = (np.concatenate(v) for v in zip(*found))
    return a, b, cos


def _best(a: np.ndarray, b: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((-cos, a))
    a, b, cos = a[order], b[order], cos[order]
    start = np.searchsorted(a, a, side="left")
    kth = np.minimum(start + k - 1, len(a) - 1)
    keep = (np.arange(len(a)) - start < k) | (cos >= np.where(a[kth] == a, cos[kth], -2)) if len(a) else slice(0)
    return a[keep], b[keep], cos[keep]


def _searcher(k: int, floor: float) -> Callable:
    def search(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack([np.frombuffer(v, dtype=np.float32) for v in group["vec"]]))
        a, b, cos = search_block(x, group["side"].to_numpy(), k, floor)
        vid = group["vid"].to_numpy()
        return pd.DataFrame({"a": vid[a], "b": vid[b], "cos": cos})

    return search


def neighbours(rows: DataFrame, k: int = 10, floor: float = 0.9, dim: int = 64, id_col: str = "id", vec_col: str = "embedding", tables: int = TABLES) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar other ids of each id, of cosine >= floor; ties go to the smaller id.

    The collection is the distinct ids with exactly dim finite values that are not all zero; nulls and other vectors take no part,
    and repeated rows of an id count once (versions of an id: one is taken). Exact copies of a vector are searched once, through their k+1
    smallest ids; every other copy has the k smallest as neighbours, so a group of copies never expands into its pairs.
    """
    spark = rows.sparkSession
    vec = F.col(vec_col)
    fine = (F.size(vec) == dim) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0)
    valid = rows.where(F.col(id_col).isNotNull() & vec.isNotNull()).where(fine).select(F.col(id_col).alias("id"), vec.cast("array<float>").alias("vec")).dropDuplicates(["id"])
    valid = table_cut(valid.select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")))
    by_copy = Window.partitionBy("k1", "k2").orderBy("id")
    reps = table_cut(
        valid.withColumn("r", F.row_number().over(by_copy))
        .where(F.col("r") <= k + 1)
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))
        .withColumn("vid", F.monotonically_increasing_id())
    )
    n = reps.count()
    mean = mean_direction(reps, dim)
    width, split = _shape(n, dim)
    routed = reps.select("vid", "vec").mapInPandas(_router(dim, mean, tables if width else 1, width, split), "cell long, vid long, vec binary")
    hot = small(table_cut(routed.groupBy("cell").count().where(F.col("count") > HOT).select("cell", F.ceil(F.col("count") / HOT).cast("int").alias("blocks"))))
    own = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")))
    placed = routed.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("cell", "vid", "vec", F.explode(pairs).alias("p")).select("cell", "p.i", "p.j", "p.side", "vid", "vec")
    hits = placed.groupBy("cell", "i", "j").applyInPandas(_searcher(k, floor), "a long, b long, cos double")
    # both steps share the partitioning by a
    best = hits.repartition("a").groupBy("a", "b").agg(F.max("cos").alias("cos")).withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cos")))).where(F.col("r") <= k)
    ids = reps.select("vid", "ids")
    near = best.join(ids.withColumnRenamed("vid", "b"), "b").select("a", F.transform("ids", lambda i: F.struct((-F.col("cos")).alias("far"), i.alias("id"))).alias("found"))
    lists = near.groupBy("a").agg(F.flatten(F.collect_list("found")).alias("found"))
    per_rep = ids.join(lists, ids["vid"] == lists["a"], "left").select(
        "ids", F.slice(F.array_sort(F.concat(F.coalesce("found", F.array().cast("array<struct<far:double,id:string>>")), F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id"))))), 1, k + 1).alias("found")
    )
    listed = per_rep.select(F.explode("ids").alias("id"), "found").select("id", F.posexplode(F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k)).alias("p", "f"))
    # copies beyond the k+1 smallest ids
    many = valid.groupBy("k1", "k2").count().where(F.col("count") > k + 1).select("k1", "k2")
    crowds = reps.join(many, ["k1", "k2"]).select("k1", "k2", "ids")
    rest = valid.join(crowds, ["k1", "k2"]).where(~F.array_contains("ids", F.col("id"))).select("id", F.posexplode(F.slice("ids", 1, k)).alias("p", "neighbour"))
    return (
        listed.select("id", F.col("f.id").alias("neighbour"), (-F.col("f.far")).alias("cosine"), (F.col("p") + 1).alias("rank"))
        .unionByName(rest.select("id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("p") + 1).alias("rank")))
        .where(F.col("cosine") >= floor)
    )


def similar_pairs(rows: DataFrame, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: unordered pairs of which one is among the k most similar of the other; options as in neighbours()."""
    found = neighbours(rows, **options)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
