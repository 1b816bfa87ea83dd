"""Centroid clustering with a LAESA pivot table (operator 13).

Vectors become exact integers. A few fixed pivots (starting centroids that lie far
apart) are chosen once, and every vector's squared distances to them are stored
beside it in one Parquet table. In each round the distances between pivots and
the present centroids bound every vector's distance to every centroid from
below, as ``|d(x, p) - d(c, p)| <= d(x, c)``: a vector's least bound names the
first centroid to measure, and only centroids whose bound does not exceed the
best exact distance are measured, in 64-bit integers. A round is one pass over the
table: tasks return sums and counts per centroid, Spark adds them up (as decimals),
and the driver holds centroids and pivots only (``k`` rows each).

Edge cases: vectors that are null, not of ``dims`` components, hold null or
non-finite components, or are too long for exact 64-bit distances
(``integers.MAX_SQUARE``) are left out; repeated rows and ids all count and are
all returned; rows without id count, but come last as starting centroids; fewer
than ``k`` vectors give as many centroids; equal centroids are legal, the smaller
number wins; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import discard, staged
from ledgermesh.llm.integers import exact, matrix, scaled

K, ROUNDS, DIMS, PIVOTS = 40, 5, 64, 16
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``y`` (one row, or as many)."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def pick_pivots(centers: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of ``centers`` that lie far apart: each next one has the greatest sum
    of distances to those before it."""
    chosen, far = [0], np.zeros(len(centers))
    while len(chosen) < min(pivots, len(centers)):
        far += np.sqrt(squares(centers, centers[chosen[-1]]).astype(np.float64))
        rest = far.copy()
        rest[chosen] = -1
        chosen.append(int(rest.argmax()))
    return centers[chosen]


def assign(x: np.ndarray, to_pivots: np.ndarray, centers: np.ndarray, pivots: np.ndarray):
    """Nearest centroid of every row (ties: the smaller number), its exact squared
    distance, and how many distances were computed."""
    reach = np.sqrt(np.stack([squares(pivots, c) for c in centers]).astype(np.float64))  # centroid x pivot
    own = np.sqrt(to_pivots.astype(np.float64))
    bound = np.zeros((len(x), len(centers)))
    for p in range(len(pivots)):
        # less the rounding of the roots, so that a bound never exceeds the true distance
        gap = np.abs(own[:, p, None] - reach[:, p]) - 1e-9 * (own[:, p, None] + reach[:, p])
        np.maximum(bound, gap, out=bound)
    bound *= bound
    near = bound.argmin(axis=1)
    first, best = near.copy(), squares(x, centers[near])
    measured = len(x)
    for c, center in enumerate(centers):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if not len(rows):
            continue
        measured += len(rows)
        d = squares(x[rows], center)
        closer = (d < best[rows]) | ((d == best[rows]) & (c < near[rows]))
        near[rows[closer]], best[rows[closer]] = c, d[closer]
    return near, best, measured


def _measure(pivots: np.ndarray):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = matrix(batch.column(1), pivots.shape[1])
            table = np.stack([squares(x, p) for p in pivots], axis=1)
            ends = np.arange(0, table.size + 1, len(pivots), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, table.reshape(-1))],
                ["vec_id", "x", "to_pivots"])
    return run


def _sums(centers: np.ndarray, pivots: np.ndarray):
    def run(batches):
        import pyarrow as pa
        total, count = np.zeros_like(centers), np.zeros(len(centers), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), centers.shape[1])
            near, _, _ = assign(x, matrix(batch.column(1), len(pivots)), centers, pivots)
            for c in np.unique(near):
                mine = near == c
                total[c] += x[mine].sum(axis=0)
                count[c] += mine.sum()
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(count[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])
    return run


def _place(centers: np.ndarray, pivots: np.ndarray):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            near, best, _ = assign(matrix(batch.column(1), centers.shape[1]), matrix(batch.column(2), len(pivots)),
                                   centers, pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(best)],
                                             ["vec_id", "cluster", "distance"])
    return run


def moved(table: DataFrame, centers: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the means; empty ones stay."""
    parts = table.select("x", "to_pivots").mapInArrow(_sums(centers, pivots), "cluster int, n long, sums array<long>")
    means = (parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    out = centers.copy()
    for r in means.collect():  # one row per centroid and dimension
        out[r.cluster, r.dim] = int(r.s) // int(r.n)
    return out


def start_hash(vec_id: Column, seed: int = 2) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, pivots: int = PIVOTS,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of
    every usable vector."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
            .filter((F.size("v") == dims) & exact(F.col("v"))).select("vec_id", scaled(F.col("v")).alias("x")))
    start = rows.orderBy(start_hash(F.col("vec_id")).asc_nulls_last(), "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    centers = np.array([r.x for r in start], np.int64)
    fixed = pick_pivots(centers, pivots)
    table = staged(rows.mapInArrow(_measure(fixed), "vec_id long, x array<long>, to_pivots array<long>"), "pivots")
    for _ in range(rounds):
        centers = moved(table, centers, fixed)
    placed = staged(table.mapInArrow(_place(centers, fixed), "vec_id long, cluster int, distance long"), "clusters")
    discard(table)
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row per centroid
    named = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
             for c, s in inertia.items()]
    names = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(names), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 2) -> str:
    """DuckDB statement of ``op13`` by plain distances to all centroids."""
    def nearest(r: int) -> str:
        return f"""
    a{r} AS MATERIALIZED (SELECT n, vec_id, x, d.num, d.dist FROM (
      SELECT v.n, v.vec_id, any_value(v.x) AS x, min({{'dist': list_sum(list_transform(list_zip(v.x, c.x),
          lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'num': c.num}}) AS d
      FROM v, c{r} c GROUP BY v.n, v.vec_id))"""

    def mean(r: int) -> str:
        return f"""
    m{r} AS (SELECT num, list(q ORDER BY dim) AS x FROM (
      SELECT num, dim, (s - ((s % c + c) % c)) // c AS q
      FROM (SELECT num, dim, sum(e)::HUGEINT AS s, count(*) AS c
            FROM (SELECT num, unnest(x) AS e, generate_subscripts(x, 1) AS dim FROM a{r}) GROUP BY num, dim))
      GROUP BY num),
    c{r + 1} AS MATERIALIZED (SELECT num, coalesce(m.x, c.x)::BIGINT[] AS x FROM c{r} c LEFT JOIN m{r} m USING (num))"""
    steps = ",".join(f"{nearest(r)},{mean(r)}" for r in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id,
        list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
      FROM embeddings WHERE len(embedding) = {dims}
        AND coalesce(list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))), true)),
    c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, x) - 1)::INT AS num, x
      FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k})),
    {steps},
    {nearest(rounds)}
    SELECT vec_id, a.num AS cluster, dist AS distance, sum(dist) OVER (PARTITION BY a.num)::BIGINT AS cluster_inertia,
      sum(dist) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c USING (num)"""
