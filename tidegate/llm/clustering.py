"""Centroid clustering in integers, with PCA-rotated filtering of the centroids.

Components become integers floor(scale * x); assignments, distances and centroid updates are
exact.  What makes a round cheap is a filter: the vectors are rotated onto the leading principal
axes once and stored with those coordinates and the norm of what is left.  For a vector x and a
centroid c with coordinates p and rests r,

    |x - c|^2  >=  |p_x - p_c|^2 + (r_x - r_c)^2

so a centroid whose bound lies above the exact distance of another one is never looked at; the
survivors are measured in integers.  The axes come from the covariance of all vectors; the bound
holds for any axes, so they decide the speed and never a result.  A round is one scan of the
stored table: every task sends one row of sums per centroid, added up by Spark; the driver holds
the centroids alone.

Defined cases: vectors that are null, of another length, or with null or non-finite components
are left out; repeated rows and ids count as often as they occur; a null vec_id is clustered like
any other and sorts last among the seeds, equal ids by their components; with fewer vectors than
centroids every vector is a seed; an empty table gives no rows; other columns are ignored.
Distances beyond a long are given as the largest long (components of about 1e6 or more).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import prepare, table
from tidegate.llm.registry import query
from tidegate.session import stage_table

CENTROIDS, ROUNDS, SCALE, DIM, LEADING = 8, 10, 1024, 64, 8
LONG = (1 << 63) - 1
EXACT = 1 << 27   # 64 squared differences of smaller integers fit a long


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that count; x holds the integers as doubles, which are exact up to 2^53 and
    beyond that exact images of what floor() gives for a double."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False)) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda v: v.cast("double") * scale)
    # floor() of a double is a long in Spark, so large values, which are whole already, stay as they are
    whole = F.transform(scaled, lambda v: F.when(F.abs(v) < 2.0 ** 52, F.floor(v).cast("double")).otherwise(v))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def exact(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64 bits where distances fit them, else Python's."""
    if not x.size or np.abs(x).max() < EXACT:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def moments(data: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance over all vectors, for the axes; values are scaled to keep squares finite."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim + 2))
        for batch in batches:
            x = np.clip(matrix(batch.column("x"), dim), -1e100, 1e100)
            total[:, :dim] += x.T @ x
            total[:, dim] += x.sum(axis=0)
            total[:, dim + 1] += len(x)
        i, j = np.divmod(np.arange(total.size), dim + 2)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((dim, dim + 2))
    for r in data.select("x").mapInArrow(part, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    mean = total[:, dim] / total[0, dim + 1]
    return mean, total[:, :dim] / total[0, dim + 1] - np.outer(mean, mean)


def axes(data: DataFrame, dim: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthonormal leading axes (dim x leading)."""
    mean, covariance = moments(data, dim)
    _, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return mean, np.ascontiguousarray(vectors[:, ::-1][:, :leading])


def project(x: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    centred = x - mean
    lead = centred @ basis
    return lead, np.sqrt(((centred - lead @ basis.T) ** 2).sum(axis=1))


def rotate(data: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    dim = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = project(matrix(batch.column("x"), dim), mean, basis)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(list(lead), pa.list_(pa.float64())), pa.array(rest)],
                ["vec_id", "x", "lead", "rest"])

    return data.mapInArrow(run, "vec_id long, x array<double>, lead array<double>, rest double")


class Centroids:
    """Exact centroids beside their rotated images."""

    def __init__(self, values: list[list[int]], mean: np.ndarray, basis: np.ndarray):
        self.values = values
        self.exact = exact(np.array(values, np.float64)) if max(abs(v) for c in values for v in c) < EXACT else np.array(values, object)
        self.lead, self.rest = project(np.array(values, np.float64), mean, basis)
        self.slack = 1e-6 + 1e-13 * float((mean ** 2).sum())

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, less what rounding may have added."""
        apart = ((lead[:, None, :] - self.lead[None]) ** 2).sum(axis=2) + (rest[:, None] - self.rest[None]) ** 2
        size = (lead ** 2).sum(axis=1)[:, None] + (rest ** 2)[:, None] + (self.lead ** 2).sum(axis=1) + self.rest ** 2
        return np.nan_to_num(apart - 1e-9 * size - self.slack, nan=-np.inf)

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of every row (ties: the smaller number), its exact distance, and the pairs measured."""
        ints, centre, n = exact(x), self.exact, len(x)
        if object in (ints.dtype, centre.dtype):
            ints, centre = ints.astype(object), centre.astype(object)
        bound = self.bounds(lead, rest)
        first = bound.argmin(axis=1)
        best = ((ints - centre[first]) ** 2).sum(axis=1)
        cluster, measured = first.copy(), n
        limit = best.astype(np.float64) * (1 + 1e-12)
        for c in range(len(centre)):
            open_ = np.flatnonzero((bound[:, c] <= limit) & (first != c))
            if len(open_):
                measured += len(open_)
                d = ((ints[open_] - centre[c]) ** 2).sum(axis=1)
                take = (d < best[open_]) | ((d == best[open_]) & (c < cluster[open_]))
                best[open_[take]], cluster[open_[take]] = d[take], c
        return cluster, best, measured


def seeds(data: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest hash of their id, in that order: a top-k, so each task keeps k rows."""
    order = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = data.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return [[int(v) for v in r.x] for r in rows]


def sums(rotated: DataFrame, centroids: Centroids, dim: int) -> tuple[list[tuple[int, list[int]]], int, int]:
    """Number and component sums of the vectors of every cluster; rows, and pairs measured in integers."""
    k = len(centroids.values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, measured = [[0] * dim for _ in range(k)], [0] * k, 0
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            cluster, _, n = centroids.nearest(x, matrix(batch.column("lead"), centroids.lead.shape[1]), np.asarray(batch.column("rest")))
            measured += n
            ints = exact(x)
            for c in np.unique(cluster):
                own = ints[cluster == c]
                count[c] += len(own)
                total[c] = [a + int(b) for a, b in zip(total[c], own.sum(axis=0))]
        # two limbs of every sum, so that they stay exact when Spark adds them up
        flat = [v for t in total for v in t]
        c, i = np.divmod(np.arange(k * dim), dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(np.repeat(count, dim), pa.int64()),
             pa.array([str(v >> 40) for v in flat]), pa.array([v & ((1 << 40) - 1) for v in flat], pa.int64()),
             pa.array(np.where((c == 0) & (i == 0), measured, 0), pa.int64())],
            ["c", "i", "n", "high", "low", "measured"])

    found = rotated.select("x", "lead", "rest").mapInArrow(part, "c int, i int, n long, high string, low long, measured long")
    rows = found.groupBy("c", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low"),
        F.sum("measured").alias("measured")).collect()
    number, total = [0] * k, [[0] * dim for _ in range(k)]
    for r in rows:
        number[r.c], total[r.c][r.i] = r.n, (int(r.high) << 40) + r.low
    return list(zip(number, total)), sum(number), sum(r.measured for r in rows)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, leading: int = LEADING) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    spark: SparkSession = prepare(vectors.sparkSession)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    data = integers(vectors, dim, scale)
    values = seeds(data, k)
    if not values:
        return spark.createDataFrame([], schema)
    mean, basis = axes(data, dim, min(leading, dim))
    rotated = stage_table(rotate(data, mean, basis), "rotated")
    for _ in range(rounds):
        found, _, _ = sums(rotated, Centroids(values, mean, basis), dim)
        moved = [[s // found[c][0] for s in found[c][1]] if found[c][0] else values[c] for c in range(len(values))]
        if moved == values:  # further rounds would change nothing
            break
        values = moved
    last = Centroids(values, mean, basis)
    width = last.lead.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, d, _ = last.nearest(matrix(batch.column("x"), dim), matrix(batch.column("lead"), width), np.asarray(batch.column("rest")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(c, pa.int32()), pa.array([min(int(v), LONG) for v in d], pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stage_table(rotated.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, min(inertia.get(c, 0), LONG), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(values)]
    by = {name: F.element_at(F.create_map(*[F.lit(v) for r in rows for v in (r[0], r[i])]), F.col("cluster")) for i, name in ((1, "cluster_inertia"), (2, "centroid_sha256"))}
    return assigned.select(
        "vec_id", "cluster", "distance", by["cluster_inertia"].cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), LONG)).cast("long").alias("inertia"), by["centroid_sha256"].alias("centroid_sha256"))


def plain_sql(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    """The same clustering by comparing every vector with every centroid; one block of subqueries a round."""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x AS m FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(x) AS x, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
    SELECT n.rid, n.vec_id, n.x, c{r}.c, list_sum(list_transform(list_zip(n.x, c{r}.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM (SELECT row_number() OVER () AS rid, vec_id, x FROM v) n, c{r}) GROUP BY rid, vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(u.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS m FROM (
      SELECT c, i, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
      FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) u ON u.c = c{r}.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(m.m, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""


@query("op13_centroids", plain_sql())
def op13_centroids(spark, sf_dir):
    """Eight centroids over all vectors of embeddings, ten rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))
