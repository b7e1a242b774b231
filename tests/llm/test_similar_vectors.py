from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quillstore.llm import similar_vectors as forest
from quillstore.llm.similar_vectors import neighbour_pairs, similar_vectors


def frame(spark, rows):
    embeddings = [None if x is None else [None if v is None else float(v) for v in x] for _, x in rows]
    columns = [pa.array([i for i, _ in rows], pa.string()), pa.array(embeddings, pa.list_(pa.float32())), pa.array([""] * len(rows)), pa.array([""] * len(rows))]
    return spark.createDataFrame(pa.table(columns, ["id", "embedding", "vid", "cosine"])).repartition(4)


def brute(rows, k, least):
    ids = [i for i, _ in rows]
    x = np.array([r for _, r in rows], np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ids[b]))
        out |= {(ids[a], ids[b]) for b in order[:k]}
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return [(f"v{i:05}", r) for i, r in enumerate((centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, dim)) * 0.35) * rng.uniform(0.5, 2, (n, 1)))]


def test_a_small_table_is_exact(spark):
    rows = clustered(600, 64, 1)
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, rows), "id", "embedding").collect()}
    assert got == brute(rows, 5, 0.85)


def test_recall_with_many_cells(spark):
    rows = clustered(6000, 64, 2)
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, rows), "id", "embedding", wanted=2048, most=512).collect()}
    want = brute(rows, 5, 0.85)
    assert len(got & want) >= 0.9 * len(want)


def test_recall_without_a_threshold(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{i:04}", r) for i, r in enumerate(rng.normal(size=(500, 32)))]
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, rows), "id", "embedding", dim=32, k=10, least=-1.0, wanted=6000, most=400, trees=24).collect()}
    want = brute(rows, 10, -1.0)
    assert len(got & want) >= 0.9 * len(want)


def test_copies_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=64)
    rows = [(f"c{i:03}", a) for i in range(40)] + [("a1", a * 2), ("z1", a + rng.normal(size=64) * 0.05)]
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, rows + rows[:5]), "id", "embedding").collect()}
    assert got == brute(rows, 5, 0.85)


def test_unusable_vectors(spark):
    good = np.arange(64) + 1.0
    bad = [("n", None), ("s", good[:63]), ("l", np.append(good, 1)), ("z", good * 0), ("q", [*good[:63], float("nan")]), ("i", [*good[:63], float("inf")]), ("u", [*good[:63], None]), (None, good), ("e", [])]
    assert similar_vectors(frame(spark, bad), "id", "embedding").count() == 0
    assert similar_vectors(frame(spark, []), "id", "embedding").count() == 0
    pairs = neighbour_pairs(similar_vectors(frame(spark, [*bad, ("a", good), ("b", good * 3)]), "id", "embedding"))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]


def test_one_direction_in_many_lengths(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=64)
    rows = [(f"s{i:04}", a * x) for i, x in enumerate(rng.uniform(0.1, 10, 1000))] + [("t", a + rng.normal(size=64) * 0.05)]
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, rows), "id", "embedding").where("id <> 't'").collect()}
    assert got == {x for x in brute(rows, 5, 0.85) if x[0] != "t"}


def test_a_tight_cluster_is_exact(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=64)
    rows = [(f"v{i:03}", a + rng.normal(size=64) * 0.003) for i in range(300)]
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, rows), "id", "embedding").collect()}
    assert got == brute(rows, 5, 0.85)


@pytest.mark.parametrize("spread", [0.1, 0.03, 0.01])
def test_recall_in_a_hot_cluster(spark, spread):
    """Mean cosines of 0.99, 0.999 and 0.9999."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=64)
    rows = [(f"v{i:04}", a + rng.normal(size=64) * spread) for i in range(4000)]
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, rows), "id", "embedding", most=1024).collect()}
    want = brute(rows, 5, 0.85)
    assert len(got & want) >= 0.95 * len(want)


def test_a_stretch_larger_than_what_a_task_holds(spark, monkeypatch):
    """Cells are worked off as they come; none is cut where a batch ends."""
    rows = clustered(3000, 64, 8)
    vids, depth = np.arange(3000), np.full(3000, 4, np.int16)
    unit = np.array([r / np.linalg.norm(r) for _, r in rows], np.float32)
    order = np.argsort(forest._first_bits(unit, 0))
    codes = np.round(unit[order] / np.abs(unit[order]).max(axis=1, keepdims=True) * 127).astype(np.int8)
    strings = forest._joined(np.sort(forest._first_bits(unit, 0)), np.zeros(3000, np.uint64))
    table = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(3000, np.int32)), forest._fixed(strings), pa.array(depth), pa.array(vids), forest._fixed(codes), pa.array(np.full(3000, 0.01, np.float32))],
        ["stretch", "string", "depth", "vid", "code", "error"],
    )

    def pairs(size):
        batches = (table.slice(i, size) for i in range(0, 3000, size))
        return {(r["a"], r["b"]) for b in forest._search(64, 400, True, 0.85, 5)(batches) for r in b.to_pylist()}

    whole = pairs(3000)
    monkeypatch.setattr(forest, "HELD", 1000)
    assert len(whole) > 1000 and whole <= pairs(100)


def test_ascent_is_in_step_and_asks_for_enough():
    """Each vector's prefix is the longest that `wanted` vectors share with it over all trees."""
    unit = np.array([r / np.linalg.norm(r) for _, r in clustered(2000, 64, 9)], np.float32)
    trees = forest._plan(unit, 4, 3, 100, 1000)
    strings = [(f := forest._first_bits(unit, n), *forest._further_bits(unit, n, f, t.crowds, t.middles)) for n, t in enumerate(trees)]
    depth = forest._depths(trees, strings, 100).astype(int)
    sharing = lambda v, bits: sum(int((s[0] >> np.uint64(64 - bits) == s[0][v] >> np.uint64(64 - bits)).sum()) if bits else len(unit) for s in strings)
    for v in range(0, 2000, 97):
        assert sharing(v, depth[v]) >= 100 > sharing(v, depth[v] + 1)
