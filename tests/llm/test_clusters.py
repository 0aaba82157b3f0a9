"""Ball-tree clustering against plain rounds over all vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from folioscope.llm import clusters

KIND = "vec_id long, embedding array<double>, cluster string, distance string, n string, i string, point string"


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(held, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in held]
        groups = [[v for (_, v), c in zip(held, of) if c == n] for n in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    final = [(i, *near(v)) for i, v in held]
    sums = {n: sum(d for _, d, c in final if c == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, c, d, sums[c], sum(sums.values()), sha[c])) for i, d, c in final)


def found(spark, rows, k, rounds, dims):
    got = clusters.cluster(spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], KIND).repartition(3), k, rounds, dims=dims)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters(spark, monkeypatch, spread):
    monkeypatch.setattr(clusters, "BLOCK", 70)
    r = random.Random(1)
    middles = [[r.uniform(-2, 2) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, spread) for x in middles[i % 6]]) for i in range(400)]
    assert found(spark, rows, 8, 10, 5) == brute(rows, 8, 10, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, None), (2, []), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [-0.0004, 0.5]), (7, [9.0, 9.0]), (7, [9.0, 9.0])]
    rows += [(100 + i, [3.0, 3.0]) for i in range(60)] + [(200 + i, [float(i % 3), 0.0]) for i in range(30)]  # a hot vector, and ties
    assert found(spark, rows, 8, 10, 2) == brute(rows, 8, 10, 2)
    assert found(spark, rows[:8], 8, 10, 2) == brute(rows[:8], 8, 10, 2)  # fewer vectors than centroids
    assert found(spark, rows[2:7], 8, 10, 2) == [] and found(spark, [], 8, 10, 2) == []


def test_components_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e6, 0.0])], 8, 1, 2)


def test_balls_hold_their_vectors_and_filter():
    """Each ball's range, count, sum and radius are those of its vectors; near clusters are assigned in whole balls."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-20, 20, (500, 8)) + 5_000 * c for c in range(4)])
    order, balls = clusters.plant(points)
    assert sorted(order) == list(range(2000))
    tree = balls | {"points": points[order]}
    for start, stop, child, radius, total in zip(*(balls[c] for c in ("start", "stop", "child", "radius", "sums"))):
        own = tree["points"][start:stop]
        assert (own.sum(0) == total).all() and np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= radius + 1e-6
        assert child < 0 or (balls["start"][child], balls["stop"][child + 1]) == (start, stop)
    cut = list(clusters.filtered(tree, points[[0, 500, 1000, 1500]]))
    whole = [ball for ball, may in cut if len(may) == 1]
    assert len(whole) == len(cut) <= 8  # four clusters, and the balls above them
    assert sum(balls["stop"][b] - balls["start"][b] for b, _ in cut) == 2000
