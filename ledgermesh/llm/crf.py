"""Line-labelling quality classifier (operator 2).

A linear-chain conditional random field labels every non-empty line of a text
good or bad. Its emissions see the line's own features and those of the lines
before and after it; forward-backward gives each line's probability of being
good, and the mean of these, weighted by line length, is the document's quality,
put on the scale of the labels by one logistic step.

Training: labels mark documents, not lines. Lines of good documents start as
good, lines of bad ones as bad; a line-wise fit then relabels the lines of bad
documents that look good (each keeps its worst line as bad), and the chain is
fitted to those labels. The fit uses at most ``sample_docs`` labelled documents,
those with the smallest hash of their id; their line features (not texts) come
to the driver. Whole texts are scored where they lie, 1 MB at a time.

Edge cases: null or blank text has no line and scores 0; a null doc_id is never
learned from and its ``held_out`` is null; repeated rows score alike; no usable labels give the score 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import chunks, utf8
from ledgermesh.llm.shingles import U, mix, word_hashes

SAMPLE_DOCS, THRESHOLD = 6000, 0.3
QUANTILES = (0.02, 0.05, *(k / 10 for k in range(1, 10)), 0.93, 0.96, 0.98, 0.995)
BINS = len(QUANTILES) + 1
FEATURES = ("words", "word_bytes", "upper", "digits", "symbols", "bars", "stops", "spaces", "again", "again_2",
            "distinct", "copied", "shift")
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#$%&*!@^~<>{}[]=+\\/_"]] = 3
_KIND[ord("|")] = 4
_KIND[[ord(c) for c in ".,;:?"]] = 5
_KIND[[9, 11, 12, 13, 32]] = 6


def line_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x features), bytes of each line, line bounds of each row."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    newline = buf == 10
    cut[1:][newline] = True
    cut[:-1][newline] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    kind = _KIND[buf]
    ink = np.concatenate([[0], np.cumsum((kind != 6) & ~newline)])
    real = ink[ends] > ink[starts]  # neither a line break nor blank
    starts, ends = starts[real], ends[real]
    k = len(starts)
    bounds = np.searchsorted(starts, offsets)
    x = np.zeros((k, len(FEATURES)), np.float32)
    size = (ends - starts).astype(np.float64)
    if not k:
        return x, size, bounds
    for column, value in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6)):
        total = np.concatenate([[0], np.cumsum(kind == value)])
        x[:, column] = (total[ends] - total[starts]) / size
    edges = np.append(starts, n)
    words, per_line = word_hashes(buf, edges)  # text before the first line, if any, is blank
    first = np.concatenate([[0], np.cumsum(per_line)])
    line = np.repeat(np.arange(k), per_line)
    count = np.maximum(per_line, 1)
    x[:, 0] = np.log1p(per_line)
    x[:, 1] = size / count
    for column, gap in ((8, 1), (9, 2)):
        same = (words[gap:] == words[:-gap]) & (line[gap:] == line[:-gap])
        x[:, column] = np.bincount(line[gap:][same], minlength=k) / count
    order = np.sort((line.astype(U) << U(40)) | (words >> U(24)))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    x[:, 10] = np.bincount((order[new] >> U(40)).astype(np.int64), minlength=k) / count
    sums = np.concatenate([np.zeros(1, U), np.cumsum(words)])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    print_ = mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(row.astype(U)))
    _, back, times = np.unique(print_, return_inverse=True, return_counts=True)
    x[:, 11] = times[back] > 1
    level = x[:, 2] + x[:, 4] + x[:, 5]
    jump = np.zeros(k)
    jump[1:] = np.where(row[1:] == row[:-1], np.abs(level[1:] - level[:-1]), 0)
    x[:, 12] = jump
    return x, size, bounds


@dataclass
class Model:
    edges: np.ndarray  # features x (bins - 1)
    own: np.ndarray    # features x bins: log odds of good
    near: np.ndarray   # 2 x features x bins: of the line before and after
    bias: float
    trans: np.ndarray  # 2 x 2, from bad/good to bad/good
    scale: tuple[float, float]

    def emissions(self, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        f = np.arange(bins.shape[1])
        e = self.bias + self.own[f, bins].sum(axis=1)
        before, after = self.near[0][f, bins].sum(axis=1), self.near[1][f, bins].sum(axis=1)
        inner = np.ones(len(bins), bool)
        starts = bounds[:-1][np.diff(bounds) > 0]
        inner[starts] = False
        e[1:] += np.where(inner[1:], before[:-1], 0)
        e[:-1] += np.where(inner[1:], after[1:], 0)
        return e

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f]) for f in range(x.shape[1])], axis=1) \
            if len(x) else np.zeros(x.shape, np.int64)

    def raw(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of good lines; nan without lines."""
        p = forward_backward(self.emissions(self.binned(x), bounds), self.trans, bounds)[0]
        total = np.concatenate([[0], np.cumsum(p * size)])
        weight = np.concatenate([[0], np.cumsum(size)])
        with np.errstate(invalid="ignore"):
            return (total[bounds[1:]] - total[bounds[:-1]]) / (weight[bounds[1:]] - weight[bounds[:-1]])

    def score(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        m = self.raw(x, size, bounds)
        a, b = self.scale
        return np.where(np.isnan(m), 0.0, _sigmoid(a * _logit(np.nan_to_num(m, nan=0.5)) + b))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def forward_backward(e: np.ndarray, trans: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for every line, and expected counts of the four
    transitions. Chains run side by side, longest first."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], bounds[:-1][order]
    steps = int(n[0]) if len(n) else 0
    score = np.zeros((len(e), 2))
    score[:, 1] = e
    fwd, bwd = np.zeros((len(e), 2)), np.zeros((len(e), 2))
    live = [int(np.searchsorted(-n, -t, "left")) for t in range(steps + 1)]  # chains longer than t
    for t in range(steps):
        i = at[:live[t]] + t
        if t == 0:
            fwd[i] = score[i]
        else:
            v = fwd[i - 1][:, :, None] + trans
            fwd[i] = np.logaddexp(v[:, 0], v[:, 1]) + score[i]
    for t in range(steps - 2, -1, -1):
        i = at[:live[t + 1]] + t
        v = trans + (score[i + 1] + bwd[i + 1])[:, None, :]
        bwd[i] = np.logaddexp(v[:, :, 0], v[:, :, 1])
    joint = fwd + bwd
    p = _sigmoid(joint[:, 1] - joint[:, 0])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(e), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    j = np.flatnonzero(inner)
    if len(j):
        v = fwd[j - 1][:, :, None] + trans + (score[j] + bwd[j])[:, None, :]
        v -= v.max(axis=(1, 2), keepdims=True)
        v = np.exp(v)
        pairs = (v / v.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, pairs


def _fit_logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on two parameters
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150) -> Model | None:
    """A model from (features, sizes, label) of each document."""
    docs = [d for d in docs if len(d[0])]
    labels = np.array([d[2] for d in docs], float)
    if not len(docs) or labels.min() == labels.max():
        return None
    x = np.concatenate([d[0] for d in docs])
    size = np.concatenate([d[1] for d in docs])
    bounds = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
    n_docs, width = len(docs), x.shape[1]
    edges = np.stack([np.concatenate([u := np.unique(np.quantile(x[:, f], QUANTILES)),
                                      np.full(BINS - 1 - len(u), np.inf)]) for f in range(width)])
    model = Model(edges, np.zeros((width, BINS)), np.zeros((2, width, BINS)), 0.0, np.zeros((2, 2)), (1.0, 0.0))
    bins = model.binned(x)
    flat = bins + np.arange(width) * BINS
    inner = np.ones(len(x), bool)
    inner[bounds[:-1]] = False
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    y = labels[doc]
    weight = 1 / np.sqrt(np.diff(bounds))[doc]  # long documents must not drown the others

    def sums(r):
        return np.bincount(flat.ravel(), np.repeat(r, width), width * BINS).reshape(width, BINS)

    theta = [model.own, model.near, np.zeros(1), model.trans]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        chain = step > rounds // 3
        model.bias = float(theta[2][0])
        e = model.emissions(bins, bounds)
        if step == rounds // 3 + 1:  # lines of bad documents that look good are good, but for the worst one
            relabel = (y == 0) & (e > 0)
            worst = np.minimum.reduceat(e, bounds[:-1])[doc]
            y = np.where(relabel & (e > worst), 1.0, y)
        p, pairs = forward_backward(e, model.trans, bounds) if chain else (_sigmoid(e), np.zeros((2, 2)))
        r = (y - p) * weight
        toward = np.zeros(len(x))
        toward[:-1] = np.where(inner[1:], r[1:], 0)
        back = np.where(inner, np.concatenate([[0], r[:-1]]), 0)
        seen = np.zeros((2, 2))
        if chain:
            j = np.flatnonzero(inner)
            np.add.at(seen, (y[j - 1].astype(int), y[j].astype(int)), 1)
            seen -= pairs
        grads = [sums(r) - 0.5 * theta[0], np.stack([sums(toward), sums(back)]) - 1.0 * theta[1],
                 np.array([r.sum()]), seen - 1.0 * theta[3]]
        for k, g in enumerate(grads):
            g = g / n_docs
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] += 0.08 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
        model.own, model.near, model.trans = theta[0], theta[1], theta[3]
    model.bias = float(theta[2][0])
    m = model.raw(x, size, bounds)
    model.scale = _fit_logistic(_logit(m), labels)
    return model


def _featurize(batches):
    import pyarrow as pa
    for batch in batches:
        buf, offsets = utf8(batch.column(1))
        xs, sizes = [], []
        for i, j in chunks(offsets):
            x, size, b = line_features(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            for r in range(j - i):
                xs.append(x[b[r]:b[r + 1]].tobytes())
                sizes.append(size[b[r]:b[r + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())],
                                         ["label", "x", "size"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``label, text`` of at most ``bound`` training documents, those with the
    smallest hash of their id."""
    chosen = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
              .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # repeated rows could pass the bound: one text per id
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, label: str = "quality") -> Model | None:
    rows = labelled_sample(docs, labels, label, sample_docs).mapInArrow(
        _featurize, "label int, x binary, size binary").collect()
    return fit([(np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)), np.frombuffer(r.size, np.float64), r.label)
                for r in rows])


def scorer(model: Model | None):
    """A column function: score of a text column."""
    def score(batches):
        import pandas as pd
        import pyarrow as pa
        for texts in batches:
            column = pa.array(texts, pa.large_string(), from_pandas=True)
            buf, offsets = utf8(column)
            out = np.full(len(texts), 0.5)
            if model is not None:
                for i, j in chunks(offsets):
                    out[i:j] = model.score(*line_features(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
            yield pd.Series(out)

    from collections.abc import Iterator

    import pandas as pd
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    score = scorer(train(docs, labels, **options))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` scored at least ``threshold``; columns stay as they are."""
    score = scorer(train(docs, labels, **options))
    return docs.withColumn("__score", score("text")).filter(F.col("__score") >= threshold).drop("__score")
