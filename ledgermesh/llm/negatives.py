"""Hard-negative mining by Strassen products on tiles (operator 11).

Vectors become exact integers. Anchors and candidates are dealt by a hash of
their id into stripes; a grid of (anchor stripe, candidate stripe) tiles joins the
stated anchors with all rows, a tile to a task call. In a tile the scores are one
matrix product by Strassen's recursion: blocks are halved (odd sizes padded with a
zero row or column), seven products and integer additions replace eight products,
down to small blocks that numpy multiplies in 64-bit integers. All of it is ring
arithmetic modulo 2^64, so intermediate wrap-around cancels and scores are exact.

Two passes over the grid: the first keeps a heap of the best rows of the
anchor's label, the second, knowing the positives' scores, a heap of the best rows
of other labels inside every positive's score window. Heaps are rows
(score, id) in order, cut to their size per tile and merged by the same order
across tiles, so no anchor gathers more than a few rows per tile.

Edge cases: rows with a null id or label, a null vector, or null, non-finite or
too long components for exact 64-bit sums (``integers.MAX_SQUARE``) take no part;
an id with several usable rows counts once, with the least (label, vector); rows
of different length are compared over their common components, as if
padded with zeros; ties go to the smaller id; fewer positives or negatives than
asked give all there are; a positive without negatives in its window, an
anchor without positives and an empty table give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.llm.common import discard, staged
from ledgermesh.llm.integers import exact, matrix, scaled

POSITIVES, NEGATIVES, WINDOW = 5, 10, (30, 90)
LEAF, BLOCK_ROWS, BLOCK_COLUMNS = 24, 512, 2048
STRIPE_VALUES = 1 << 20  # vector components in a stripe: 8 MB
_NONE = np.int64(-(1 << 62))
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact modulo 2^64."""
    (m, d), n = a.shape, b.shape[1]
    if min(m, d, n) <= leaf:
        return a @ b
    if m % 2 or d % 2:
        a = np.pad(a, ((0, m % 2), (0, d % 2)))
    if d % 2 or n % 2:
        b = np.pad(b, ((0, d % 2), (0, n % 2)))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def merged(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The ``k`` best entries (score down, id up) of each row's heap."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.ones(len(row), bool)
    keep[k:] = row[k:] != row[:-k]
    return row[keep], ids[keep], score[keep]


def heaps(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int):
    """Each row's ``k`` best allowed columns as heap entries."""
    masked = np.where(allowed, score, _NONE)
    if masked.shape[1] > k:  # all columns at or over the k-th best score, ties included
        least = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (masked >= least[:, None])
    row, column = np.nonzero(allowed)
    return merged(row, ids[column], score[row, column], k)


def _tiles(anchors, rows):
    """Score blocks of one tile: anchor range, candidate range, scores."""
    from pyarrow import compute as pc
    width = min(pc.max(pc.list_value_length(t.column("x"))).as_py() or 0 for t in (anchors, rows))
    a, b = matrix(anchors.column("x"), width), matrix(rows.column("x"), width).T
    for i in range(0, len(a), BLOCK_ROWS):
        part = a[i:i + BLOCK_ROWS]
        for j in range(0, b.shape[1], BLOCK_COLUMNS):
            columns = slice(j, min(j + BLOCK_COLUMNS, b.shape[1]))
            yield slice(i, i + len(part)), columns, strassen(part, b[:, columns])


def _values(table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(parts: list, k: int):
    """Merge heap entries of earlier and later blocks."""
    return merged(*[np.concatenate(c) for c in zip(*parts, strict=True)], k)


def _mine(select, found):
    """A tile's heaps: ``select`` says what an anchor's heaps take and hold."""
    def run(_, anchors, rows):
        import pyarrow as pa
        empty = [np.zeros(0, np.int64)] * 5
        if anchors.num_rows and rows.num_rows:
            ids, labels = _values(rows, "vec_id"), _values(rows, "label")
            heap: dict[int, tuple] = {}
            asked = select(anchors)
            for i, j, score in _tiles(anchors, rows):
                for slot, k, allowed in asked(i, ids[j], labels[j], score):
                    row, of, s = heaps(score, allowed, ids[j], k)
                    old = heap.get(slot)
                    new = (row + i.start, of, s)
                    heap[slot] = new if old is None else _joined([old, new], k)
            parts = [found(anchors, slot, *h) for slot, h in heap.items()]
            empty = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table(empty, names=["anchor_id", "positive_id", "positive_score", "id", "score"])
    return run


def _positives(k: int):
    def select(anchors):
        own, label = _values(anchors, "vec_id"), _values(anchors, "label")

        def asked(i, ids, labels, score):
            yield 0, k, (labels == label[i][:, None]) & (ids != own[i][:, None])
        return asked

    def found(anchors, _, row, ids, score):
        zero = np.zeros(len(row), np.int64)
        return _values(anchors, "vec_id")[row], zero, zero, ids, score
    return _mine(select, found)


def _negatives(k: int, positives: int, window: tuple[int, int]):
    def select(anchors):
        label = _values(anchors, "label")
        count = anchors.column("p_score").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        base = matrix(anchors.column("p_score"), positives)

        def asked(i, ids, labels, score):
            other = labels != label[i][:, None]
            for slot in range(positives):
                of = base[i, slot][:, None]
                inside = (window[0] * of <= 100 * score) & (100 * score <= window[1] * of)
                yield slot, k, other & inside & (slot < count[i])[:, None]
        return asked

    def found(anchors, slot, row, ids, score):
        return (_values(anchors, "vec_id")[row], matrix(anchors.column("p_id"), positives)[row, slot],
                matrix(anchors.column("p_score"), positives)[row, slot], ids, score)
    return _mine(select, found)


def _grid(anchors: DataFrame, rows: DataFrame, across: int, down: int, run) -> DataFrame:
    """Run every (anchor stripe, candidate stripe) tile."""
    stripe = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("stripe")), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.withColumn("a", stripe(down)).withColumn("b", every(across))
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # attributes of its own: both sides read one table
    right = rows.withColumn("b", stripe(across)).withColumn("a", every(down))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, stripe_values: int = STRIPE_VALUES,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``
    of every row that ``is_anchor`` (a condition on ``vec_id``) selects. ``label``,
    an expression on ``vec_id`` and ``label``, replaces the labels first; ``window``
    bounds a negative's score in percent of the positive's."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & exact(F.col("v")))
    rows = rows.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"),
                       scaled(F.col("v")).alias("x"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    rows = staged(rows, "integers")
    anchors = rows.filter(is_anchor)
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("q"), F.max(F.size("x")).alias("d")).first()
    # a stripe holds stripe_values components at most; small tables are cut finer, for every core to have work
    most = max(1, stripe_values // max(1, size.d or 1))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-size.n // most), min(4 * cores, -(-size.n // 256)))
    down = max(1, -(-size.q // most))

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = _grid(anchors, rows, across, down, _positives(positives)).withColumn("rank", F.row_number().over(best))
    near = near.filter(F.col("rank") <= positives).groupBy("anchor_id").agg(  # ``positives`` entries at most
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    asked = staged(anchors.join(near, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "x", F.col("p.id").alias("p_id"), F.col("p.score").alias("p_score")), "asked")
    far = _grid(asked, rows, across, down, _negatives(negatives, positives, window))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    found = staged(far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "negatives")
    discard(rows, asked)
    return found


def oracle() -> str:
    """DuckDB statement of ``op11`` by plain inner products."""
    return f"""
    WITH v AS MATERIALIZED (SELECT vec_id, min({{'l': l, 'x': x}}) AS r FROM (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS l,
          list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND coalesce(list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))), true))
      GROUP BY vec_id),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.r.l = b.r.l AS same,
        coalesce(list_sum(list_transform(list_zip(a.r.x, b.r.x, true), lambda p: p[1] * p[2])), 0)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
    SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score,
      score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same
      AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= {NEGATIVES}"""
