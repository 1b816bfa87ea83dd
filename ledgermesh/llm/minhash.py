"""MinHash near-duplicate groups (operator 10).

1. Every whole text is sketched: ``bands * rows`` universal hash minima over
   its set of 5-word shingles, and a 128-bit hash of the set itself. Texts with
   equal sets form one class, so copies never meet as pairs.
2. Classes that agree on all rows of a band share a bucket. Every member is
   tested against its bucket's hub. In buckets that still hold several
   components, shingles found in one class only are counted: they can't be
   shared, so ``s`` of a class's ``n`` shingles bound what any partner has in
   common with it, and a class with ``s`` below the threshold's part of ``n`` has
   no link at all. The others are compared with one pick, the member of the
   bucket's largest component with the fewest such shingles, and finally with all
   members outside their own component, where two bounds allow it: two classes
   share at most what each shares with the pick, plus what each could share beside
   it. No pair that shares a bucket is left untested unless its bound is too low or
   its ends are connected already.
3. Signatures drop pairs far below the threshold (six standard deviations);
   every remaining pair is confirmed on the full sets.
4. Components come from alternating large-star and small-star steps, each
   written to the shared folder.

Links start at similarity 0.8 unless a caller names another threshold (op10 has
0.85). With 36 bands of 5 rows a pair at 0.8 shares no bucket with probability
6e-7; with op10's 24 bands one at 0.85 with 8e-7, one at 0.9 with 2e-10.

Edge cases: null or blank text has no shingles and is linked with nothing; a
null id takes part, and a component's id is its smallest non-null doc_id (null
if it has none); repeated rows are one class; an empty table gives no rows.
Classes are told apart by 128 bits of their set hash, components by 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import chunks, discard, staged, utf8
from ledgermesh.llm.shingles import U, mix, shingle_hashes

BANDS, ROWS = 36, 5
_SKETCH = "doc_id long, h long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>"


def _sketcher(bands: int, rows: int):
    k = bands * rows
    rng = np.random.default_rng(7)
    mul = rng.integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    fold = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * U(2) + U(1)
    salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def minima(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """k minima of each non-empty run of x, as 32 bits of each hash."""
        out = np.empty((k, len(bounds) - 1), np.uint32)
        work = np.empty_like(x)
        for i in range(k):
            np.multiply(x, mul[i], out=work)
            np.add(work, add[i], out=work)
            out[i] = np.minimum.reduceat(work, bounds[:-1]) >> U(32)
        return out.T

    def sketch(batches):
        import pyarrow as pa
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            n = len(offsets) - 1
            count = np.zeros(n, np.int64)
            keys = np.zeros((n, 2), np.int64)
            sigs: list[bytes | None] = [None] * n
            bucket = np.zeros((n, bands), np.int64)
            for i, j in chunks(offsets):
                x, b = shingle_hashes(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                full = np.flatnonzero(np.diff(b))
                if not len(full):
                    continue
                m = minima(x, np.append(b[:-1][full], len(x)))
                rows_at = m.reshape(len(full), bands, rows).astype(U)
                bucket[i + full] = mix((rows_at * fold).sum(axis=2, dtype=U) + salt).view(np.int64)
                for at, r in enumerate(full):
                    s = np.unique(x[b[r]:b[r + 1]])
                    count[i + r] = len(s)
                    keys[i + r] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    sigs[i + r] = m[at].tobytes()
            listed = pa.ListArray.from_arrays(np.arange(0, (n + 1) * bands, bands, dtype=np.int32), bucket.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count), pa.array(keys[:, 0].copy()),
                 pa.array(keys[:, 1].copy()), pa.array(sigs, pa.binary()), listed],
                ["doc_id", "h", "n_shingles", "s1", "s2", "sig", "bands"])
    return sketch


def _sets(column):
    """The shingle set of every row, sorted."""
    buf, offsets = utf8(column)
    for i, j in chunks(offsets):
        x, b = shingle_hashes(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        for r in range(j - i):
            yield np.unique(x[b[r]:b[r + 1]])


def _confirmer(num: int, den: int):
    def confirm(batches):
        import pyarrow as pa
        for batch in batches:
            keep = [den * (c := len(np.intersect1d(a, b, assume_unique=True))) >= num * (len(a) + len(b) - c)
                    for a, b in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return confirm


def _estimator(least: float):
    def estimate(batches):
        import pyarrow as pa
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                    for i in (2, 3))
            keep = (a == b).mean(axis=1) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return estimate


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(u, v)``; comp is the smallest
    node of its component. Alternating large-star and small-star steps until
    all that is left are stars."""
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low_of_all = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")  # a hub can be split
        large = staged(both.filter("v > u").join(low_of_all, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = staged(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        discard(now, large, low_of_all)
        now = small
        roots = now.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1))
        tops = now.groupBy("u").agg(F.count("*").alias("n")).join(roots, "u", "left").filter("n > 1 or root = 1")
        if tops.isEmpty():  # every node points at one root and no root points on
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _list_shingles(batches):
    import pyarrow as pa
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        for node, x in zip(nodes, _sets(batch.column(1)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x.view(np.int64))], ["node", "x"])


def _overlaps(batches):
    import pyarrow as pa
    for batch in batches:
        both = [(len(np.intersect1d(a, b, assume_unique=True)), len(b))
                for a, b in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
        c, n = zip(*both, strict=True) if both else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.int64()),
                                          pa.array(n, pa.int64())], ["node", "pick", "c", "np"])


def _open_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with ``comp``, the
    bucket's largest component ``main`` and that one's ``pick``, the member with
    the smallest share of shingles of its own."""
    placed = staged(members.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    parts = placed.groupBy("bucket", "comp").agg(
        F.count("*").alias("size"), F.max_by("node", F.struct(F.col("s") / F.col("n"), "node")).alias("pick"))
    heads = parts.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.max_by(F.struct("comp", "pick"), F.struct("size", "comp")).alias("top")
    ).filter("parts > 1").select("bucket", F.col("top.comp").alias("main"), F.col("top.pick").alias("pick"))
    return placed.join(staged(heads, "heads"), "bucket")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` after links (u, cu, v, cv) between members of two components."""
    links = staged(links, "links")
    joined = connected_components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select(
        F.col("node").alias("comp"), F.col("comp").alias("into"))
    known = label.union(links.select("u", "cu")).union(links.select("v", "cv")).distinct()
    return staged(known.join(joined, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "label")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, h, n_shingles, component_id, kept, leader``.

    Documents with ``den * intersection >= num * union`` are linked.
    ``leader`` marks the row that stands for its component (all rows equal to
    it in id and text); ``kept`` is ``doc_id = component_id``.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"),
                        F.col(text_col).alias("text"))
    sketch = staged(texts.mapInArrow(_sketcher(bands, rows), _SKETCH), "sketch")
    row = F.struct(F.col("doc_id").isNull().alias("anon"), "doc_id", "h")
    classes = staged(sketch.filter("n_shingles > 0").groupBy("s1", "s2")
                     .agg(F.min(row).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"),
                          F.first("bands").alias("bands")).withColumnRenamed("s1", "node"), "classes")

    spread = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # written first: a join of two plain shuffles lets Spark split a hot bucket
    hubs = staged(spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("other"))
                  .filter("hub < other").select("bucket", "hub"), "hubs")
    members = staged(spread.join(hubs, "bucket"), "members")

    needed = members.select("node").distinct().join(classes.select("node", "rep.doc_id", "rep.h"), "node")
    bodies = staged(texts.join(needed.select("node", F.col("doc_id").alias("i"), F.col("h").alias("k")),
                               F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")))
                    .select("node", "text").dropDuplicates(["node"]), "bodies")
    ratio = (F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num)

    def confirmed(pairs: DataFrame) -> DataFrame:
        body = bodies.select(F.col("node").alias("u"), F.col("text").alias("a"))
        twin = bodies.select(F.col("node").alias("v"), F.col("text").alias("b"))
        return pairs.join(body, "u").join(twin, "v").select("u", "v", "a", "b").mapInArrow(
            _confirmer(num, den), "u long, v long")

    sizes = classes.select(F.col("node").alias("hub"), F.col("n").alias("nv"))
    first = members.filter("node <> hub").select("hub", F.col("node").alias("u"), F.col("n").alias("nu")).distinct()
    links = staged(confirmed(first.join(sizes, "hub").filter(ratio).select("u", F.col("hub").alias("v"))), "links")
    label = staged(connected_components(links), "label")

    opened = _open_buckets(members.select("bucket", "node", "n").withColumn("s", F.col("n")), label).select(
        "bucket", "node", "n")
    unique = (bodies.join(opened.select("node").distinct(), "node").mapInArrow(_list_shingles, "node long, x long")
              .groupBy("x").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
              .groupBy("node").agg(F.count("*").alias("u")))
    opened = staged(opened.join(unique, "node", "left").withColumn("s", F.col("n") - F.coalesce("u", F.lit(0)))
                    .filter(F.col("s") * den >= F.col("n") * num).select("bucket", "node", "n", "s"), "open")
    now = staged(_open_buckets(opened, label), "now")
    if not now.isEmpty():
        # every member against its bucket's pick: how many shingles they share
        body, twin = bodies.toDF("node", "a"), bodies.toDF("pick", "b")
        met = staged(now.filter("node <> pick").select("node", "pick").distinct().join(body, "node").join(twin, "pick")
                     .select("node", "pick", "a", "b").mapInArrow(_overlaps, "node long, pick long, c long, np long"), "met")
        close = now.filter("comp <> main").join(met, ["node", "pick"]).filter(
            F.col("c") * den >= (F.col("n") + F.col("np") - F.col("c")) * num)
        label = _merged(label, close.select(F.col("node").alias("u"), F.col("comp").alias("cu"),
                                            F.col("pick").alias("v"), F.col("main").alias("cv")).distinct())

        # the others against all members outside their component, bounded by what both share with the pick
        comp = label.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        placed = (now.drop("comp", "main").join(comp, F.col("node") == F.col("__n"), "left")
                  .withColumn("comp", F.coalesce("__c", "node")).drop("__n", "__c")
                  .join(comp, F.col("pick") == F.col("__n"), "left")
                  .withColumn("main", F.coalesce("__c", "pick")).drop("__n", "__c")
                  .join(met.select("node", "pick", "c"), ["node", "pick"], "left").withColumn("c", F.coalesce("c", "n")))
        # shared with the pick, and shareable but not with the pick
        placed = staged(placed.withColumn("e", F.greatest(F.col("s") - F.col("c"), F.lit(0))), "placed")
        loose = staged(placed.filter("comp <> main"), "loose")
        mine = loose.select("bucket", *[F.col(x).alias(f"{x}u") for x in ("node", "n", "s", "comp", "c", "e")])
        rest = placed.select("bucket", "main", *[F.col(x).alias(f"{x}v") for x in ("node", "n", "s", "comp", "c", "e")])
        most = F.least(F.least("su", "sv"), F.least("cu", "cv") + F.least("eu", "ev"))
        pairs = mine.join(rest, "bucket").filter(
            (F.col("compu") != F.col("compv")) & ((F.col("compv") == F.col("main")) | (F.col("nodeu") < F.col("nodev")))
            & (most * den >= (F.col("nu") + F.col("nv") - most) * num))
        pairs = staged(pairs.select(F.col("nodeu").alias("u"), F.col("compu").alias("cu"), F.col("nodev").alias("v"),
                                    F.col("compv").alias("cv")).distinct(), "pairs")
        if not pairs.isEmpty():
            sig = classes.select("node", "sig")
            likely = staged(pairs.select("u", "v").join(sig.toDF("u", "a"), "u").join(sig.toDF("v", "b"), "v").select(
                "u", "v", "a", "b").mapInArrow(_estimator(_floor(num / den, bands * rows)), "u long, v long"), "likely")
            label = _merged(label, pairs.join(confirmed(likely), ["u", "v"]))

    ends = classes.select("node", "s2", "rep").join(label, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    leaders = ends.groupBy("comp").agg(F.min("rep").alias("head"))
    table = ends.join(leaders, "comp").select(F.col("node").alias("s1"), "s2", "head")
    own = F.col("n_shingles") == 0
    out = sketch.select("doc_id", "h", "n_shingles", "s1", "s2").join(table, ["s1", "s2"], "left").select(
        "doc_id", "h", "n_shingles",
        F.when(own, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (own | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h")))).alias("leader"))
    return out.select("doc_id", "h", "n_shingles", "component_id",
                      F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("component_id"))
                      .otherwise(F.col("leader")).alias("kept"), "leader")


def _floor(similarity: float, k: int) -> float:
    """Six standard deviations below the expected share of equal minima."""
    return max(0.0, similarity - 6 * (similarity * (1 - similarity) / k) ** 0.5)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group; rows equal in id and text
    count as one. Columns and their values stay as they are."""
    keys = near_duplicates(docs, **options).filter("leader").select(
        F.col("doc_id").alias("__i"), F.col("h").alias("__h")).distinct()
    marked = docs.withColumn("__k", F.xxhash64("text"))
    return (marked.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__h")))
            .dropDuplicates(["__i", "__h"]).drop("__i", "__h", "__k"))
