import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours as N


def brute(ids, x, k, floor):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    pairs = set()
    s = u @ u.T
    for i in range(len(ids)):
        near = sorted((-round(s[i, j], 12), ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= floor)[:k]
        pairs |= {tuple(sorted((ids[i], j))) for _, j in near}
    return pairs


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([c + 0.25 * rng.standard_normal((12, 64)) for c in centres] + [rng.standard_normal((300, 64))]).astype(np.float32)
    ids = [f"v{k:04d}" for k in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "x", 1.0) for i, v in zip(ids, x)], "id string, embedding array<float>, vec string, cos double")
    got = {tuple(r) for r in N.similar_pairs(df).collect()}
    want = brute(ids, x, 10, 0.9)
    assert len(want) > 500 and len(got & want) / len(want) >= 0.95 and len(got - want) <= 0.05 * len(want)


def test_unusable_and_copies(spark):
    v, w = [1.0] * 64, [1.0] * 63 + [0.9]
    rows = [(f"k{k:02d}", v) for k in range(30)] + [("k00", v), ("w", w), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0] * 3), ("null", None), (None, v), ("inf", [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    near = {}
    for r in N.neighbours(df, k=10).orderBy("id", "rank").collect():
        near.setdefault(r["id"], []).append(r["neighbour"])
    first = [f"k{k:02d}" for k in range(12)]
    assert near["k29"] == first[:10] and near["k00"] == first[1:11] and near["w"] == first[:10]
    assert set(near) == {f"k{k:02d}" for k in range(30)} | {"w"}
    assert N.similar_pairs(df.where("false")).count() == 0


def test_hot_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 16)
    rng = np.random.default_rng(5)
    x = (np.ones(64) + 0.2 * rng.standard_normal((90, 64))).astype(np.float32)
    ids = [f"v{k:03d}" for k in range(90)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, embedding array<float>")
    got = {tuple(r) for r in N.similar_pairs(df, tables=8).collect()}
    want = brute(ids, x, 10, 0.9)
    assert len(got & want) / len(want) >= 0.95


def test_block_search_keeps_ties():
    x = np.tile(np.eye(1, 64), (5, 1))
    a, b, cos = N.search_block(x, np.zeros(5, int), 2, 0.9)
    assert len(a) == 20 and F is not None


@pytest.mark.parametrize("fine", [1, 2, 8, 64])
def test_fine_cells_keep_near_pairs(fine):
    """The router as it is for up to 30 million vectors, where cells are cut a second time."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.92 * x + np.sqrt(1 - 0.92**2) * y
    route = N._router(64, np.zeros(64), N.TABLES, 64, fine)
    met = [set() for _ in range(4000)]
    for side in (x, y):
        batch = N.pd.DataFrame({"vid": range(4000), "vec": list(side.astype(np.float32))})
        cells = [set() for _ in range(4000)]
        for part in route([batch]):
            for v, c in zip(part["vid"], part["cell"]):
                cells[v].add(c)
        met = cells if side is x else [a & b for a, b in zip(met, cells)]
    assert sum(map(bool, met)) / 4000 >= 0.96


def test_few_vectors_are_verified():
    """In a cell of vectors about one axis the projections rule out nearly all, and no neighbour is lost."""
    rng = np.random.default_rng(9)
    x = 0.35 * np.eye(1, 64) + rng.standard_normal((3000, 64)) / 8
    x[1500:1900] = x[:400] + 0.04 * rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    counts = {}
    a, b, cos = N.search_block(x, np.zeros(len(x), int), 10, 0.9, counts)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = set(zip(*np.nonzero(s >= 0.9)))
    assert len(want) > 700 and len(want & set(zip(a, b))) >= 0.99 * len(want)
    assert counts["verified"] < 0.05 * counts["pairs"] and np.allclose(cos, s[a, b])


def test_early_neighbours_stop_the_search():
    """Vectors with k nearer ones in their own leaf don't verify those that the floor alone would let in."""
    rng = np.random.default_rng(10)
    centre = rng.standard_normal((40, 64))
    x = np.repeat(np.ones(64) + 0.25 * centre, 30, axis=0) + 0.004 * rng.standard_normal((1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    counts = {}
    a, b, cos = N.search_block(x, np.zeros(len(x), int), 10, 0.9, counts)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    tenth = -np.partition(-s, 9, axis=1)[:, 9]
    assert counts["compared"] < counts["pairs"] and counts["verified"] < 0.3 * (s >= 0.9).sum()
    assert len(a) >= 0.99 * 12000 and (cos >= tenth[a] - 1e-9).mean() >= 0.99


def test_against_brute_force_in_fine_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 1)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((150, 64))
    x = np.repeat(centres, 6, axis=0) + 0.29 * rng.standard_normal((900, 64))
    x = x.astype(np.float32)
    ids = [f"v{k:04d}" for k in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, embedding array<float>")
    got = {tuple(r) for r in N.similar_pairs(df).collect()}
    want = brute(ids, x, 10, 0.9)
    assert len(want) > 1000 and got <= want and len(got) / len(want) >= 0.98
