"""Removal of repeated passages by anchored fingerprints (operator 6).

This stands in for distributed prefix doubling, which sorts the pair of ranks of
every byte position in each round: one such round was measured to shuffle 87 times
the compressed input (sf0.01), against a disk budget of 4 times for the whole job.

A byte goes when it is covered by a string of ``LENGTH`` bytes that starts
somewhere else too. As in doubling, starts are named by ever longer prefixes, starts
whose name is unique drop out, and the rest are named again until the prefix has
reached the threshold; but names are hashes of the text, not ranks of rank pairs, and
they are first taken at anchors, then for runs, blocks and single starts:

1. Prefixes of 200 bytes. Equal 400-byte strings hold the same 200-byte string
   of least hash at the same place, so only these anchors (about one position in
   a hundred) are ranked. Neighbouring starts that share an anchor form a run.
2. The starts of a run are ranked together, by the 400-byte prefixes at both its
   ends: equal pairs mean equal runs, all of whose starts are repeated.
3. What is left is cut into blocks of 16 starts, aligned to the anchor. A block
   whose common core (385 bytes) is unique drops out; blocks of equal hull (415
   bytes, less where a run ends inside) are repeated.
4. The starts of what is left are ranked one by one by their 400 bytes.

When some members of a group are settled and others are not, one member of each
settled kind stays as a witness for the next step, so no repeat is missed and a
group of many copies costs one entry. A rank is the name of its string, 128 bits
of two polynomial hashes (64 bits for anchors and cores, which only narrow the
search); names need no dictionary to be sent back.

Edge cases: null text is empty; texts under 400 bytes keep everything; rows equal
in id and text repeat each other; matches never cross documents but may lie in
one document and overlap; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import chunks, discard, staged, utf8
from ledgermesh.llm.shingles import U, mix

LENGTH, ANCHOR, BLOCK = 400, 200, 16
PART = 1 << 20
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, PART + 4 * LENGTH), U(base))
        step[0] = 1
        have = _tables[base] = np.multiply.accumulate(step)
    return have


class Names:
    """Names of any substrings of one buffer, by prefix sums of polynomials."""

    def __init__(self, buf: np.ndarray):
        self.n = len(buf)
        self.sums = []
        value = buf.astype(U) + U(1)
        for base in _BASES:
            s = np.zeros(self.n + 1, U)
            np.cumsum(value * _powers(base, self.n)[:self.n], out=s[1:])
            self.sums.append(s)

    def of(self, i: np.ndarray, j: np.ndarray, which: int = 0) -> np.ndarray:
        s, back = self.sums[which], _powers(pow(_BASES[which], -1, 1 << 64), self.n + 1)
        return mix((s[j] - s[i]) * back[i] + (j - i).astype(U))


def _runs(buf: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Runs of starts with a common anchor: row, first start, starts, anchor's
    place, anchor's name, and the two names of the run; places within the row."""
    n, w = len(buf), length - anchor + 1
    size = np.diff(offsets)
    if not (size >= length).any():
        return None
    names = Names(buf)
    at = np.arange(n - anchor + 1)
    gram = names.of(at, at + anchor)
    key = (gram & U(0xFFFFFFFF00000000)) | at.astype(U)  # ties go to the first
    padded = np.concatenate([key, np.full(-len(key) % w, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(key) - w + 1
    least = (np.minimum(behind[:starts], ahead[w - 1:w - 1 + starts]) & U(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(n + 1, np.int64)
    np.add.at(fits, offsets[:-1][size >= length], 1)
    np.add.at(fits, offsets[1:][size >= length] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(fits)[:starts] > 0)
    row = np.searchsorted(offsets, p, "right") - 1
    first = np.ones(len(p), bool)
    first[1:] = (least[p[1:]] != least[p[:-1]]) | (row[1:] != row[:-1])
    f = np.flatnonzero(first)
    lo, hi, row = p[f], p[np.append(f[1:], len(p)) - 1], row[f]
    a = least[lo]
    return (row, lo - offsets[row], hi - lo + 1, a - offsets[row], gram[a],
            names.of(lo, hi + length), names.of(lo, hi + length, 1))


_RUN = "doc_id long, h long, lo long, n int, anchor long, k long, a long, b long"


def _list_runs(length: int, anchor: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            ids, h = batch.column(0), batch.column(1)
            for i, j in chunks(offsets, PART):
                begin, end = int(offsets[i]), int(offsets[j])
                for s in range(begin, max(end - length + 1, begin + 1), PART):  # a text over PART bytes in parts
                    stop = min(s + PART + length - 1, end) if j == i + 1 else end
                    at = np.array([0, stop - s]) if j == i + 1 else offsets[i:j + 1] - begin
                    found = _runs(buf[s:stop], at, length, anchor)
                    if found is not None:
                        row, lo, n, a, k, x, y = found
                        take = pa.array(row + i)
                        shift = s - begin if j == i + 1 else 0
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(take), h.take(take), pa.array(lo + shift), pa.array(n.astype(np.int32)),
                             pa.array(a + shift), *[pa.array(v.view(np.int64)) for v in (k, x, y)]],
                            ["doc_id", "h", "lo", "n", "anchor", "k", "a", "b"])
                    if j > i + 1:
                        break
    return run


def _settle(pieces: DataFrame, ref: list[str]) -> tuple[DataFrame, DataFrame]:
    """Repeated pieces (doc_id, h, lo, n), and the references to rank again:
    unmatched members and one witness of each matched kind, wherever a key has
    both unmatched members and others."""
    # written first: a join of two plain shuffles lets Spark split a hot key
    twice = staged(pieces.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k"), "twice")
    live = staged(pieces.join(twice, "k"), "live")
    kinds = staged(live.groupBy("k", "a", "b").agg(F.count("*").alias("c"), F.min(F.struct(*ref)).alias("ref")), "kinds")
    marks = staged(live.join(kinds.filter("c > 1").select("k", "a", "b"), ["k", "a", "b"]).select(
        "doc_id", "h", "lo", "n"), "marks")
    loose = staged(kinds.filter("c = 1").select("k").distinct(), "loose")
    rest = staged(kinds.join(loose, "k").select("ref.*"), "rest")
    discard(twice, live, kinds, loose)
    return marks, rest


def _cut(batches):
    """The bytes around each listed run of a text."""
    import pyarrow as pa
    for batch in batches:
        buf, offsets = utf8(batch.column(2))
        rows = []
        for r, listed in enumerate(batch.column(3).to_pylist()):
            for x in listed:
                at, end = max(0, x["lo"] - BLOCK), x["lo"] + x["n"] - 1 + LENGTH + BLOCK
                rows.append((r, x["lo"], x["n"], x["anchor"], at, buf[offsets[r] + at:min(offsets[r] + end, offsets[r + 1])].tobytes()))
        row, lo, n, anchor, at, data = zip(*rows, strict=True) if rows else ((),) * 6
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(lo, pa.int64()), pa.array(n, pa.int32()),
             pa.array(anchor, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.binary())],
            ["doc_id", "h", "lo", "n", "anchor", "at", "data"])


def _blocks(batches):
    """Blocks of starts: core name as key, hull names as kind."""
    import pyarrow as pa
    for batch in batches:
        buf, offsets = utf8(batch.column(6))
        lo, n, anchor, at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4, 5))
        for i, j in chunks(offsets):
            names = Names(buf[offsets[i]:offsets[j]])
            last_block, first_block = (anchor[i:j] - lo[i:j]) // BLOCK, (anchor[i:j] - lo[i:j] - n[i:j] + 1) // BLOCK
            count = last_block - first_block + 1
            r = np.repeat(np.arange(i, j), count)
            b = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first_block, count)
            head, tail = anchor[r] - BLOCK * b - BLOCK + 1, anchor[r] - BLOCK * b
            shift = offsets[r] - offsets[i] - at[r]
            core = names.of(tail + shift, head + LENGTH + shift)
            start, stop = np.maximum(lo[r], head), np.minimum(lo[r] + n[r] - 1, tail)
            # only the run's own starts: a block may straddle two runs, and must not be counted twice
            kind = [names.of(start + shift, stop + LENGTH + shift, w) for w in (0, 1)]
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(start),
                 pa.array((stop - start + 1).astype(np.int32)), pa.array(lo[r]),
                 *[pa.array(v.view(np.int64)) for v in (core, *kind)]],
                ["doc_id", "h", "lo", "n", "run", "k", "a", "b"])


def _starts(batches):
    """Single starts of the listed blocks, named by their 400 bytes."""
    import pyarrow as pa
    for batch in batches:
        buf, offsets = utf8(batch.column(3))
        at = batch.column(2).to_numpy()
        blocks = batch.column(4).to_pylist()
        for i, j in chunks(offsets):
            names = Names(buf[offsets[i]:offsets[j]])
            r = np.array([x for x in range(i, j) for _ in blocks[x]], np.int64)
            lo = np.array([v["lo"] for x in range(i, j) for v in blocks[x]], np.int64)
            n = np.array([v["n"] for x in range(i, j) for v in blocks[x]], np.int64)
            p = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            r = np.repeat(r, n)
            x = p - at[r] + offsets[r] - offsets[i]
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(p),
                 *[pa.array(names.of(x, x + LENGTH, w).view(np.int64)) for w in (0, 1)]],
                ["doc_id", "h", "lo", "a", "b"])


def _keep(batches):
    import pyarrow as pa
    for batch in batches:
        buf, offsets = utf8(batch.column(2))
        lows, highs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        out = []
        for r in range(batch.num_rows):
            size = int(offsets[r + 1] - offsets[r])
            cover = np.zeros(size + 1, np.int32)
            np.add.at(cover, lows[r], 1)
            np.add.at(cover, highs[r], -1)
            gone = np.cumsum(cover)[:size] > 0
            kept = buf[offsets[r]:offsets[r + 1]][~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        removed, spans, sha = zip(*out, strict=True) if out else ((),) * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(sha, pa.string())], ["d", "g", "n_removed", "n_spans", "kept_sha256"])


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``doc_id, h, lo, n``: every start whose 400 bytes also start elsewhere
    lies in one of these ranges of starts, and no other does."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    runs = staged(texts.mapInArrow(_list_runs(LENGTH, ANCHOR), _RUN), "runs")
    marks, rest = _settle(runs, ["doc_id", "h", "lo", "n", "anchor"])
    discard(runs)

    wanted = rest.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(
        F.collect_set(F.struct("lo", "n", "anchor")).alias("runs"))  # runs of one text
    one = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    cut = staged(one.select("doc_id", "h", "text", "runs").mapInArrow(
        _cut, "doc_id long, h long, lo long, n int, anchor long, at long, data binary")
        .dropDuplicates(["doc_id", "h", "lo"]), "cut")  # rows equal in id and text yield the same cut

    # a witness or an unmatched run is one position in the text, so equal rows add nothing here
    blocks = staged(cut.mapInArrow(_blocks, "doc_id long, h long, lo long, n int, run long, k long, a long, b long"), "blocks")
    more, rest_blocks = _settle(blocks, ["doc_id", "h", "lo", "n", "run"])
    discard(blocks, rest)

    listed = rest_blocks.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g"), "run").agg(
        F.collect_set(F.struct("lo", "n")).alias("blocks"))  # at most 13 of a run
    single = staged(cut.join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
                             & (F.col("lo") == F.col("run"))).select("doc_id", "h", "at", "data", "blocks")
                    .mapInArrow(_starts, "doc_id long, h long, lo long, a long, b long"), "starts")
    twice = staged(single.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").select("a", "b"), "twice")
    last = single.join(twice, ["a", "b"]).select("doc_id", "h", "lo", F.lit(1).alias("n"))
    return marks.union(more).union(last)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    spans = (repeated_starts(docs).select("doc_id", "h", "lo", (F.col("lo") + F.col("n") - 1 + LENGTH).alias("hi"))
             .distinct().groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g"))
             .agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs")))  # ranges of one text
    spans = staged(spans, "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
                        F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    cleaned = (texts.join(spans, same).select("d", "g", "text", "lows", "highs")
               .mapInArrow(_keep, "d long, g long, n_removed long, n_spans long, kept_sha256 string")
               .dropDuplicates(["d", "g"]))
    plain = texts.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"),
                         F.sha2("text", 256).alias("sha"))
    return plain.join(cleaned, same, "left").select(
        "doc_id", "h", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
