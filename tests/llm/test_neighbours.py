"""Recall against brute force, copies, ties and vectors that take no part."""

import numpy as np
import pytest

from strataloom.llm import neighbours

SCHEMA = "id string, v array<float>, distances int"


def slow(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    out = {}
    for i, name in enumerate(ids):
        order = sorted((d[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[name] = [n for _, n in order[:k]]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + 0.5 * rng.normal(size=(50, 32)) for c in centres]).astype(np.float32)
    return [f"id{i:05d}" for i in range(len(x))], x * rng.uniform(0.5, 2, (len(x), 1)).astype(np.float32)


def test_recall(spark, clustered):
    ids, x = clustered
    df = spark.createDataFrame([(n, v.tolist(), 0) for n, v in zip(ids, x)], SCHEMA).repartition(3)
    got = {r.id: list(r.ids) for r in neighbours.neighbours(df, "id", "v", 5).collect()}
    want = slow(ids, x.astype(np.float64), 5)
    recall = np.mean([len(set(got[n]) & set(want[n])) / 5 for n in ids])
    assert set(got) == set(ids) and recall >= 0.9


def test_distances_are_exact_from_every_cell(spark, clustered):
    ids, x = clustered
    df = spark.createDataFrame([(n, v.tolist(), 0) for n, v in zip(ids, x)], SCHEMA).repartition(3)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    where = {n: i for i, n in enumerate(ids)}
    for r in neighbours.neighbours(df, "id", "v", 5).collect():
        want = 1 - u[[where[n] for n in r.ids]] @ u[where[r.id]]
        assert list(r.distances) == pytest.approx(want.tolist(), rel=0, abs=1.1e-9)


def test_quantised_scan_ranks_like_the_exact_product(clustered):
    _, x = clustered
    u = neighbours._unit(x)
    index = neighbours.Index(u, 8, len(u))
    cell = int((u[:1] @ index.centres.T).argmax())
    members = u[(u @ index.centres.T).argmax(axis=1) == cell]
    scores = index.scan(members[:20], index.encode(members, cell), cell)
    exact = members @ members[:20].T
    assert np.corrcoef(scores.ravel(), exact.ravel())[0, 1] > 0.95


def test_copies_ties_and_unusable_rows(spark):
    rows = [(f"c{i:02d}", [1.0, 2.0, 3.0], 0) for i in range(20)] + [("far", [-1.0, 0.5, 0.0], 0), ("near", [1.0, 2.0, 2.9], 0)]
    rows += [("null", None, 0), ("zero", [0.0, 0.0, 0.0], 0), ("nan", [float("nan"), 1.0, 1.0], 0), ("short", [1.0], 0), ("part", [1.0, None, 1.0], 0), ("c00", [1.0, 2.0, 3.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.id: list(r.ids) for r in neighbours.neighbours(df, "id", "v", 5).collect()}
    assert set(got) == {f"c{i:02d}" for i in range(20)} | {"far", "near"}
    assert got["c00"] == ["c01", "c02", "c03", "c04", "c05"] and got["c03"] == ["c00", "c01", "c02", "c04", "c05"] and got["c19"] == ["c00", "c01", "c02", "c03", "c04"]
    assert got["near"] == ["c00", "c01", "c02", "c03", "c04"]
    pairs = {tuple(r) for r in neighbours.neighbour_pairs(df, "id", "v", 5).collect()}
    assert all(a < b for a, b in pairs) and ("c00", "near") in pairs
    assert neighbours.neighbours(df.limit(0), "id", "v").count() == 0
    assert neighbours.neighbours(df.where("id = 'null'"), "id", "v").count() == 0


def test_recall_where_clusters_outnumber_the_drivers_sample(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 512)
    monkeypatch.setattr(neighbours, "LEAST_SAMPLE", 512)
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 16, raising=False)
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.repeat(unit(rng.normal(size=(400, 128))), 10, axis=0) + 0.6 * unit(rng.normal(size=(4000, 128)))).astype(np.float32)
    ids = [f"id{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, v.tolist(), 0) for n, v in zip(ids, x)], SCHEMA).repartition(3)
    got = {r.id: list(r.ids) for r in neighbours.neighbours(df, "id", "v", 5).collect()}
    want = slow(ids, x.astype(np.float64), 5)
    recall = np.mean([len(set(got[n]) & set(want[n])) / 5 for n in ids])
    assert set(got) == set(ids) and recall >= 0.93


@pytest.mark.parametrize("probes", [1, 3, 7])
def test_nearest_centres_are_found_in_blocks(monkeypatch, probes):
    monkeypatch.setattr(neighbours, "CENTRES", 4)
    monkeypatch.setattr(neighbours, "VECTORS", 7)
    rng = np.random.default_rng(8)
    x, centres = rng.normal(size=(30, 6)).astype(np.float32), rng.normal(size=(23, 6)).astype(np.float16)
    want = np.argsort(-(x @ centres.astype(np.float32).T), axis=1, kind="stable")[:, :probes]
    assert (neighbours._nearest(x, centres, probes) == want).all()
