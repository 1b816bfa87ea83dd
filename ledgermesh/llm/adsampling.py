"""Approximate nearest neighbours by adaptive dimension scans (operator 7).

Vectors are scaled to length one and rotated by one random orthogonal matrix,
so any run of columns is a fair sample of a distance. An inverted file over
spherical k-means centroids (fitted on at most ``sample`` vectors, those with the
smallest hash) places every vector in one list. A query probes the same number of
its nearest lists: as many as hold ``recall`` of the true neighbours of queries
drawn from the sample, searched exhaustively there, so clustered vectors need few
lists and vectors without clusters most of them. A query whose lists hold too few
candidates for ``k`` results probes on until they do or all lists are read. Within a list columns are read in blocks: after each block a
hypothesis test compares the distance so far, scaled to all columns, with
the best k found, and abandons candidates that can hardly come closer. The
survivors' cosines are computed on the original vectors in double precision.

Equal vectors are searched once and expanded by their smallest ids, so a common
vector costs no more than any other. Lists are cut into pieces of at most ``piece``
vectors and their queries into pieces of at most ``piece`` queries; one task
sees one piece of each.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite
components take no part, nor do rows without id or of another length than the
most frequent one; an id with several vectors counts with the smallest; fewer
candidates than k give all that were found; ties go to the smaller id; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.llm.common import staged

K, RECALL, SAMPLE, SAMPLE_QUERIES, MAX_LISTS, PIECE = 5, 0.98, 20_000, 256, 4096, 4096
COLUMNS, EPSILON = 16, 2.1


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; empty lists restart at a sampled vector."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at, count = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], count, axis=0)
        new = x[rng.choice(len(x), len(c))]
        new[at] = sums
        c = _unit(new)
    return c


def adaptive_scan(x: np.ndarray, q: np.ndarray, k: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances of the rows of ``x`` nearest to ``q``."""
    d = x.shape[1]
    best_i, best = np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(x), block):
        rows = np.arange(lo, min(lo + block, len(x)))
        part = np.zeros(len(rows))
        bound = best[k - 1] if len(best) >= k else np.inf
        for j in range(0, d, COLUMNS):
            gap = x[rows, j:j + COLUMNS] - q[j:j + COLUMNS]
            part = part + (gap * gap).sum(axis=1)
            seen = min(j + COLUMNS, d)
            if seen < d and np.isfinite(bound):
                stay = part * (d / seen) <= bound * (1 + EPSILON / np.sqrt(seen)) ** 2
                rows, part = rows[stay], part[stay]
                if not len(rows):
                    break
        if len(rows):
            best_i, best = np.concatenate([best_i, rows]), np.concatenate([best, part])
            order = np.argsort(best, kind="stable")[:k]
            best_i, best = best_i[order], best[order]
    return best_i, best


def needed_lists(x: np.ndarray, centers: np.ndarray, k: int, recall: float, queries: int = SAMPLE_QUERIES) -> int:
    """How many of its nearest lists a query must probe to meet ``recall`` of its
    ``k`` nearest rows of the sample ``x`` (unit vectors, in the order of their hash)."""
    q = min(queries, len(x))
    if len(x) <= 1 or len(centers) == 1:
        return len(centers)
    home = np.concatenate([(x[i:i + 4096] @ centers.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    near = x[:q] @ x.T
    near[np.arange(q), np.arange(q)] = -np.inf
    k = min(k, len(x) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.empty((q, len(centers)), np.int64)  # how near each list is to each query
    np.put_along_axis(place, np.argsort(-(x[:q] @ centers.T), axis=1, kind="stable"),
                      np.broadcast_to(np.arange(len(centers)), place.shape), axis=1)
    ranks = np.sort(np.take_along_axis(place, home[best], axis=1).reshape(-1))
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1


def _place(rotation: np.ndarray, centers: np.ndarray):
    """Rotated unit vector and its own list."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1))) @ rotation
            home = np.concatenate([(x[i:i + 1024] @ centers.T).argmax(axis=1) for i in range(0, len(x), 1024)])
            d = x.shape[1]
            ends = np.arange(0, x.size + 1, d, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, x.reshape(-1)), pa.array(home, pa.int32())],
                ["rep", "x", "list"])
    return run


def _probe(centers: np.ndarray, held: np.ndarray, probes: int, least: int):
    """The lists that a query probes: the nearest ``probes``, and on until they
    hold ``least`` vectors."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            order = np.concatenate([np.argsort(-(x[i:i + 1024] @ centers.T), axis=1, kind="stable")
                                    for i in range(0, len(x), 1024)])
            short = (np.cumsum(held[order], axis=1) < least).sum(axis=1) + 1
            n = np.minimum(np.maximum(short, probes), len(centers))
            flat = order[np.arange(order.shape[1]) < n[:, None]].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)],
                                             ["rep", "x", "lists"])
    return run


def _search(k: int):
    def run(key, queries, vectors):
        import pandas as pd
        out = []
        if len(queries) and len(vectors):
            x = np.stack(vectors["x"].to_numpy())
            reps = vectors["rep"].to_numpy()
            order = np.argsort(reps, kind="stable")
            x, reps = x[order], reps[order]
            for rep, q in zip(queries["rep"], queries["x"], strict=True):
                i, dist = adaptive_scan(x, np.asarray(q), k)
                out.append(pd.DataFrame({"q": rep, "rep": reps[i], "dist": dist}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "dist": []}).astype(
            {"q": "int64", "rep": "int64"})
    return run


def _cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        products = F.zip_with(F.col(x), F.col(y), lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE,
            max_lists: int = MAX_LISTS, piece: int = PIECE, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every row that
    ``is_query`` (a condition on ``vec_id``) selects, among all rows but its own."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
            .filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v")))
    rows = staged(rows, "vectors")
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    d = shape.d
    rows = rows.filter(F.size("v") == d)
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = staged(rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
                      .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
                      .select(F.get("ids", F.lit(0)).alias("rep"), "v", "ids"), "distinct")
    total = distinct.count()
    asked = staged(rows.filter(is_query).withColumnRenamed("vec_id", "query_id")
                   .join(distinct.select("v", "rep"), "v").select("query_id", "rep"), "asked")

    rotation = _rotation(d)
    chosen = distinct.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow().column(0).combine_chunks()
    known = _unit(_matrix(chosen)) @ rotation
    centers = centroids(known, min(max_lists, max(1, round(total ** 0.5))))
    probes = needed_lists(known, centers, k, recall)
    placed = staged(distinct.select("rep", "v").mapInArrow(_place(rotation, centers),
                                                           "rep long, x array<double>, list int"), "placed")
    home = placed.select("rep", "x", "list")
    held = np.zeros(len(centers), np.int64)
    for r in placed.groupBy("list").count().collect():  # max_lists rows at most
        held[r.list] = r["count"]
    query = (placed.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "x")
             .mapInArrow(_probe(centers, held, probes, k + 1), "rep long, x array<double>, lists array<int>")
             .select("rep", "x", F.explode("lists").alias("list")))
    # pieces per list, at most max_lists rows each
    sizes = home.groupBy("list").count().select("list", F.ceil(F.col("count") / piece).alias("pv"))
    loads = query.groupBy("list").count().select("list", F.ceil(F.col("count") / piece).alias("pq"))
    plan = F.broadcast(sizes.join(loads, "list"))

    def spread(table: DataFrame, own: str, other: str, a: str, b: str) -> DataFrame:
        return (table.join(plan, "list")
                .withColumn(a, F.pmod(F.xxhash64("rep", F.lit("piece")), F.col(own)))
                .withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
                .select("list", F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b),
                        F.col("rep").alias("rep"), F.col("x").alias("x")))
    keys = ["list", "a", "b"]
    found = (spread(query, "pq", "pv", "a", "b").groupBy(*keys)
             .cogroup(spread(home, "pv", "pq", "b", "a").groupBy(*keys))
             .applyInPandas(_search(k + 1), "q long, rep long, dist double"))
    near = Window.partitionBy("q").orderBy("dist", "rep")
    found = staged(found.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= 2 * k + 2).select("q", "rep"),
                   "found")
    scored = (found.join(distinct.select(F.col("rep").alias("q"), F.col("v").alias("a")), "q")
              .join(distinct.select("rep", F.col("v").alias("b"), "ids"), "rep")
              .select("q", "ids", _cosine("a", "b").alias("score")))
    pairs = asked.join(scored, F.col("rep") == F.col("q")).select(
        "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
