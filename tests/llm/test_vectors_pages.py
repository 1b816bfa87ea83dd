"""Hard negatives, WARC bundles and centroid clustering against brute force, with
nulls, repeated rows and ids, ties, empty tables and clashing columns."""

import base64
import collections
import glob
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermesh.llm import bundles, laesa, negatives
from ledgermesh.llm.integers import MAX_SQUARE

# the names that the operators use inside clash on purpose
SCHEMA = ("vec_id long, embedding array<double>, label int, x string, a int, b int, v string, id long, rank int, "
          "score string, to_pivots int, cluster string")
EXTRA = ("x", 1, 2, "v", 3, 4, "s", 5, "c")


def integer(v):
    return [math.floor(256 * float(x)) for x in v]


def sound(v):
    return (v is not None and all(x is not None and math.isfinite(x) for x in v)
            and sum(256.0 * x * 256.0 * x for x in v) < MAX_SQUARE)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = []
    for i in range(-10, 420):
        v = [rng.choice([0.25, -0.5, 0.75, 1.0, rng.gauss(0, 0.4)]) for _ in range(6)]
        rows.append((i, v, rng.randrange(3)))
    rows += [rows[5], rows[40], (100, [2.0] * 6, 1), (200, [0.1] * 6, 2), (200, [0.1] * 6, 0)]  # ids again
    rows += [(i, list(rows[30][1]), 1) for i in range(500, 540)]  # ties
    rows += [(600, None, 1), (601, [0.1] * 6, None), (602, [None] * 6, 1), (603, [float("nan")] * 6, 1),
             (604, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (605, [1e300] * 6, 0), (700, [], 1), (701, [1.0, 2.0], 0),
             (800, [0.5] * 9, 0)]
    return [(*r, *EXTRA) for r in rows]


def test_strassen_is_exact_modulo_two_to_the_64():
    rng = np.random.default_rng(1)
    for m, d, n, leaf in [(1, 1, 1, 1), (5, 7, 3, 1), (33, 64, 20, 4), (17, 1, 9, 2), (40, 40, 40, 24), (3, 0, 4, 2)]:
        a, b = rng.integers(-(1 << 62), 1 << 62, (m, d)), rng.integers(-(1 << 62), 1 << 62, (d, n))
        with np.errstate(over="ignore"):
            assert (negatives.strassen(a, b, leaf) == a @ b).all()


def brute_negatives(rows, positives=5, negatives_=10):
    usable = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not sound(v):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        usable[i] = min(usable.get(i, (label, integer(v))), (label, integer(v)))
    out = []
    for a, (la, xa) in usable.items():
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(xa, x)), i, la == label) for i, (label, x) in usable.items() if i != a]
        for s, p, _ in sorted(t for t in scored if t[2])[:positives]:
            inside = sorted(t[:2] for t in scored if not t[2] and 30 * -s <= 100 * -t[0] <= 90 * -s)
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("stripe_values", [64, 1 << 20])
def test_hard_negatives(spark, vectors, stripe_values):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, relabelled, stripe_values=stripe_values)
    want = brute_negatives(vectors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_of_small_tables(spark, vectors):
    how = F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), *how).collect() == []
    for rows in ([(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [2.0], 2), (2, [1.0], 1)]):
        df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
        assert sorted(map(tuple, negatives.hard_negatives(df, *how).collect())) == brute_negatives(rows)


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, integer(v)) for i, v, *_ in rows if v is not None and len(v) == dims and sound(v)]
    digest = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() for i, _ in kept if i is not None}
    centers = [x for _, _, x in sorted((digest.get(i, "~"), i is None, x) for i, x in kept)[:k]]

    def nearest(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        mine = collections.defaultdict(list)
        for _, x in kept:
            mine[nearest(x)[1]].append(x)
        centers = [[sum(c) // len(mine[n]) for c in zip(*mine[n])] if n in mine else centers[n] for n in range(len(centers))]
    placed = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = collections.Counter()
    for _, c, d in placed:
        inertia[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name[c]) for i, c, d in placed), key=str)


@pytest.mark.parametrize("k,pivots", [(8, 3), (40, 16), (1000, 5)])
def test_pivot_clusters(spark, vectors, k, pivots):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    got = laesa.cluster(df, k=k, rounds=4, dims=6, pivots=pivots)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(vectors, k, 4, 6)


def test_pivot_bounds_spare_distances_and_keep_ties():
    rng = np.random.default_rng(2)
    centers = rng.integers(-1000, 1000, (40, 8))
    centers[7] = centers[3]
    x = centers[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 8))
    pivots = laesa.pick_pivots(centers, 12)
    table = np.stack([laesa.squares(x, p) for p in pivots], axis=1)
    near, best, measured = laesa.assign(x, table, centers, pivots)
    full = ((x[:, None] - centers) ** 2).sum(axis=2)
    assert (near == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert 7 not in near and measured < 0.2 * full.size


def test_clusters_of_small_tables(spark):
    assert laesa.cluster(spark.createDataFrame([], SCHEMA), dims=2).collect() == []
    rows = [(3, [1.0, -1.0], 0), (3, [1.0, -1.0], 0), (None, [0.5, 0.0], None)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    assert sorted(map(tuple, laesa.cluster(df, dims=2).collect()), key=str) == brute_clusters(rows, 40, 5, 2)


PAGES = "page_id long, url string, html string, n int, key string, sha1 string, size int, to string, copy int, bundle string"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(9)
    html = [None, "", "x", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "\U0001f600" * 50, "y" * 300_000]
    html += ["".join(rng.choices("abc <>é\n", k=rng.randint(1, 4000))) for _ in range(120)]
    rows = [(i, rng.choice([None, f"http://a.example/é {i}?q=%20#\r\n", f"http://b.example/{i}"]), rng.choice(html))
            for i in range(400)]
    rows += [(1000 + i, f"http://c.example/{i}", "hot") for i in range(200)]
    rows += [rows[3]] * 3 + [(None, None, None), (None, "u", "hot"), (1199, "http://z.example", "hot"), (7, "v", "w")]
    rows += [(5000, "same", "again")] * 5 + [(None, None, "only nulls")] * 2
    return [(*r, 1, "k", "s", 2, "t", 3, "b") for r in rows]


def brute_pages(rows):
    groups = collections.defaultdict(list)
    for page_id, _, html, *_ in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out += [(i, len(body), digest, "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_bundles_round_trip(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(bundles, "COPIES", 2)
    path = f"file://{tmp_path}/warc"
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    bundles.write_bundles(df, path, frame_bytes=5000, bundle_bytes=20_000)
    found = bundles.read_bundles(spark, path).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == brute_pages(pages)
    assert len({r.record_id for r in found}) == len(pages) and len({r.bundle for r in found}) > 2

    # any Zstandard reader sees one WARC file; every record is where the index says
    import zstandard
    records = {}
    for name in glob.glob(f"{tmp_path}/warc/*.zst"):
        with open(name, "rb") as f:
            data, at = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(), 0
        while at < len(data):
            head, block, end = bundles.parse_record(data, at)
            records[head["warc-record-id"].strip("<>")] = data[at:end]
            at = end
    assert records.keys() == {r.record_id for r in found}
    wanted = spark.createDataFrame([(i,) for i in sorted(records)[::7]] + [("urn:page:none:0",)], "record_id string")
    got = {r.record_id: bytes(r.record) for r in bundles.fetch(spark, path, wanted).collect()}
    assert got == {i: records[i] for i in sorted(records)[::7]}


def test_damaged_bundles_are_refused(spark, pages, tmp_path):
    path = f"{tmp_path}/warc"
    bundles.write_bundles(spark.createDataFrame(pages, PAGES).coalesce(1), path, frame_bytes=20_000)
    name = max(glob.glob(f"{path}/*.zst"), key=lambda f: len(open(f, "rb").read()))
    whole = open(name, "rb").read()
    for broken in (whole[:50] + bytes([whole[50] ^ 1]) + whole[51:], whole[:-1], whole[:-20] + whole[-8:], b""):
        with open(name, "wb") as f:
            f.write(broken)
        with pytest.raises(Exception, match="damaged|seek table"):
            bundles.read_bundles(spark, path).collect()


def test_bundles_of_an_empty_table(spark, tmp_path):
    assert bundles.archive(spark.createDataFrame([], PAGES), f"{tmp_path}/warc").collect() == []


def test_every_task_names_its_files_anew(spark, tmp_path):
    """A file that a lost attempt left behind is in no index, so it is not read."""
    path = f"{tmp_path}/warc"
    rows = [(1, "u", "one", *([None] * 7)), (2, "u", "two", *([None] * 7))]
    bundles.write_bundles(spark.createDataFrame(rows, PAGES), path)
    lost = bundles._Bundles(path, "part-00000-lost", 100, 1000, 3)
    lost.add("urn:page:9:x", 9, b"half a rec")
    lost.flush()
    lost.file.close()
    assert sorted(r.page_id for r in bundles.read_bundles(spark, path).collect()) == [1, 2]
