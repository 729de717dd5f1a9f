import hashlib
import math

import numpy as np
import pytest

from tidegate.llm.clustering import Centroids, axes, cluster, integers, op13_centroids, project, rotate, sums
from tidegate.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, x string, lead int"


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in e]) for i, e in rows
            if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))
    centre = [list(x) for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(centre)):
            own = [x for (_, x), c in zip(kept, of) if c == j]
            if own:
                centre[j] = [sum(col) // len(own) for col in zip(*own)]
    last = [(i, *near(x)) for i, x in kept]
    total = [sum(d for _, d, c in last if c == j) for j in range(len(centre))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    big = (1 << 63) - 1
    return sorted(((i, c, min(d, big), min(total[c], big), min(sum(total), big), sha[c]) for i, d, c in last), key=repr)


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, e, "x", 0) for i, e in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters_match_plain_ones(spark, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 5))
    rows = [(int(i), (middle[i % 6] + 0.3 * rng.normal(size=5)).astype(np.float32).tolist()) for i in range(300)]
    rows += rows[:20]   # repeated rows and ids
    assert rows_of(cluster(frame(spark, rows), k=5, rounds=4, dim=5, leading=2)) == brute(rows, 5, 4, 5)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [0.5, -0.25]),
            (7, [1.0, 2.0]), (8, [-1e-9, 0.0]), (9, [0.0, 0.0]), (9, [0.0, 0.0]), (10, [])]
    for k in (1, 2, 4, 8):
        assert rows_of(cluster(frame(spark, rows), k=k, rounds=3, dim=2, leading=1)) == brute(rows, k, 3, 2)
    assert rows_of(cluster(frame(spark, rows[1:4]), dim=2)) == []
    assert rows_of(cluster(frame(spark, rows).where("false"), dim=2)) == []


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 0, 2, 1])]
    assert rows_of(cluster(frame(spark, rows), k=3, rounds=2, dim=2, leading=2)) == brute(rows, 3, 2, 2)


def test_large_values_stay_exact(spark):
    rows = [(i, [s * 10.0 ** e, 1.0 + i]) for i, (s, e) in enumerate([(1, 3), (-1, 6), (2, 6), (1, 12), (-3, 12), (1, 30), (1, 5), (1, 7)])]
    assert rows_of(cluster(frame(spark, rows), k=3, rounds=2, dim=2, leading=1)) == brute(rows, 3, 2, 2)


def test_the_filter_keeps_the_nearest_and_spares_centroids(spark, sf_dir):
    data = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    mean, basis = axes(data, 64, 8)
    rows = data.collect()
    x = np.array([r.x for r in rows])
    centroids = Centroids([[int(v) for v in r] for r in x[:8]], mean, basis)
    lead, rest = project(x, mean, basis)
    exact = ((x[:, None] - x[None, :8]) ** 2).sum(axis=2)
    assert (centroids.bounds(lead, rest) <= exact).all()
    _, n, measured = sums(rotate(data, mean, basis), centroids, 64)
    assert n == len(rows) and n <= measured < 8 * n
    nearest, distance, _ = centroids.nearest(x, lead, rest)
    assert (nearest == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows_of(op13_centroids(spark, sf_dir)) == brute(rows, 8, 10, 64)
