"""Centroid clustering by cells against brute force and odd input."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from logtarn.llm.registry import QUERIES
from logtarn.llm.vafile import Lookup, Setting, cell_bounds, clustered

SMALL = Setting(dimensions=5, centroids=4, rounds=3, scale=8)


def brute(rows, setting):
    kept = [
        (vec_id, [max(-(2**27), min(2**27, math.floor(setting.scale * x))) for x in vector])
        for vec_id, vector in rows
        if vector is not None and len(vector) == setting.dimensions
        and all(x is not None and math.isfinite(x) for x in vector)
    ]
    named = [(sha256(f"{setting.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centroids = [v for _, v in sorted(named)[: setting.centroids]]

    if not centroids:
        return [], []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(setting.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [
            [sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c
            for k, c in enumerate(centroids)
        ]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


def order(row):
    return [(v is None, v or 0) for v in row]


def same(spark, rows, setting):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    assigned, centroids = clustered(frame, setting)
    found = sorted((tuple(r[:3]) for r in assigned.collect()), key=order)
    expected, expected_centroids = brute([r[:2] for r in rows], setting)
    assert found == sorted(expected, key=order)
    assert centroids.tolist() == expected_centroids


def points(seed, n, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.uniform(-4, 4) for _ in range(5)] for _ in range(4)]
    return [
        (k, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(middles)], "x") for k in range(n)
    ]


@pytest.mark.parametrize("spread", [0.05, 1.0, 6.0])
def test_clusters(spark, spread):
    same(spark, points(3, 400, spread), SMALL)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, [1.0] * 5, "a"), (900, None, "a"), (901, [], "a"), (902, [1.0] * 4, "a"),
        (903, [1.0, None, 1.0, 1.0, 1.0], "a"), (904, [nan] * 5, "a"), (905, [1.0, 1.0, -inf, 1.0, 1.0], "a"),
        (906, [3e38, -3e38, 1.0, 0.0, -0.0], "a"), (None, [9.0] * 5, "a"), (907, [1.0] * 6, "a"),
    ]
    rows = points(4, 60) + odd
    same(spark, rows, SMALL)
    same(spark, rows + rows, SMALL)  # repeated rows
    same(spark, [(k, [0.5] * 5, "a") for k in range(20)], SMALL)  # all alike: ties, empty clusters
    same(spark, odd[:1] + points(5, 2), SMALL)  # fewer than there are centroids
    same(spark, odd[:8], SMALL)
    same(spark, odd[1:7], SMALL)  # none that count
    same(spark, odd[:1], SMALL)  # none that starts a centroid
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustered(frame, SMALL)[0].collect() == []


def test_intervals_hold_every_distance():
    rng = np.random.default_rng(2)
    full = rng.integers(-50, 50, (500, 5)).astype(np.int32)
    cuts = np.sort(np.quantile(full, np.arange(1, 16) / 16, axis=0).astype(np.int64).T, axis=1)
    bounds = (
        np.concatenate([full.min(0)[:, None], cuts], 1),
        np.concatenate([cuts - 1, full.max(0)[:, None]], 1),
    )
    centroids = rng.integers(-60, 60, (6, 5)).astype(np.int64)
    cells = np.stack([np.searchsorted(cuts[d], full[:, d], "right") for d in range(5)], 1)
    cells = np.concatenate([cells, np.zeros((500, 1), np.int64)], 1).astype(np.uint8)
    lookup = Lookup(centroids, bounds)
    exact = ((full[:, None, :] - centroids[None]) ** 2).sum(2)
    packed = cells[:, ::2] | (cells[:, 1::2] << 4)
    sums = sum(lookup.pairs[p][packed[:, p]] for p in range(3))
    assert (sums[:, :6] <= exact).all() and (exact <= sums[:, 6:]).all()
    assigned = lookup.assign(packed, full)
    assert assigned.cluster.tolist() == exact.argmin(1).tolist()
    assert (assigned.left == 1).any()


def test_full_vectors_are_taken_only_where_intervals_overlap(spark):
    """Vectors close to their centroid are decided by cells alone."""
    frame = spark.createDataFrame(points(6, 400, 0.05), "vec_id long, embedding array<float>, cluster string")
    assigned, _ = clustered(frame, SMALL)
    assert assigned.where("n_overlapping = 1").count() > 300


def test_bounds_of_no_vectors(spark):
    assert cell_bounds(spark.createDataFrame([], "components array<int>"), 3) is None


def test_query_of_extreme_vectors(spark, tmp_path):
    """Inertias beyond a long are the greatest long."""
    rows = [(k, [float((-1) ** k) * 3e38] * 64) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op12_vafile"](spark, str(tmp_path)).collect()
    assert len(found) == 40 and {r.inertia for r in found} == {0}
