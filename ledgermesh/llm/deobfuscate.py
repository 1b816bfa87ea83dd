"""Toxicity of deobfuscated text (operator 4).

The channel writes a word's letters with look-alike symbols, doubles them and
puts separators between them. A token so disguised becomes a lattice: each
symbol has its readings, each run of a letter one or two of it, each separator
nothing or a word break. Viterbi decoding under a character trigram model, whose
counts are summed over all documents, picks the reading; a token with one
reading is taken as it is. Decoding is linear in a token's length, so texts without
blanks are decoded whole. A letter run spelled with spaces is one token.

The restored words are then scored by a logistic model over log counts of the
words and word starts (4 to 7 letters, so that a word's endings count together)
that mark toxic documents, both learned from at most ``sample_docs`` labelled
documents (smallest hash of their id), whatever their language; they are chosen
by log odds over their standard error, in Spark.

Edge cases: null or empty text has no words and scores as such; a null doc_id is
never learned from and its ``held_out`` is null; repeated rows score alike; without labels of both kinds every score is 0.5; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import chunks, utf8
from ledgermesh.llm.crf import held_out, labelled_sample

SAMPLE_DOCS, THRESHOLD, VOCABULARY, LEAST_Z, LEAST_DOCS = 20_000, 0.5, 1024, 4.0, 5
STARTS = (4, 5, 6, 7)
_KEPT, _LONG = 400_000, 200

#: Readings of look-alike symbols.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
            "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = ".-_*~'`"
READ, DOUBLE, LITERAL, BREAK = -1.0, -0.7, -9.0, -3.0  # log costs of the channel

SYMBOLS = 28  # 0 other, 1-26 letters, 27 any byte of another letter
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27


def _count_trigrams(batches):
    import pyarrow as pa
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in batches:
        buf, offsets = utf8(batch.column(0))
        for i, j in chunks(offsets):
            part, at = buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            code = np.zeros(len(part) + 2 * (j - i) + 2, np.int64)  # two breaks part the texts
            code[np.arange(len(part)) + 2 + 2 * np.repeat(np.arange(j - i), np.diff(at))] = _CODE[part]
            total += np.bincount(code[:-2] * SYMBOLS ** 2 + code[1:-1] * SYMBOLS + code[2:], minlength=SYMBOLS ** 3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) from the trigrams of all texts; 28^3 sums at most reach
    the driver, whatever the input."""
    counts = np.zeros(SYMBOLS ** 3)
    for r in docs.select("text").mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(
            F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi = tri.sum(axis=0)
    back = (bi + 0.5) / (bi + 0.5).sum(axis=1, keepdims=True)
    return np.log((tri + 2 * back) / (tri.sum(axis=2, keepdims=True) + 2))


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(token: str, model: np.ndarray, spelled: bool = False) -> str:
    """The likeliest words behind a disguised token (lower case)."""
    lattice, i = [], 0
    while i < len(token):
        c = token[i]
        j = i + 1
        while j < len(token) and token[j] == c:
            j += 1
        if c in READINGS:
            ways = [(x * k, READ * k) for x in READINGS[c] for k in {1, min(j - i, 2)}]
            ways.append((" ", LITERAL if c.isdigit() else BREAK))
        elif c.isalpha():
            ways = [(c, 0.0 if j - i == 1 else DOUBLE)] + ([(c * 2, 0.0 if j - i == 2 else DOUBLE)] if j - i > 1 else [])
        else:
            ways = [("", 0.0), (" ", BREAK)]
        lattice.append(ways)
        if spelled and j < len(token):
            lattice.append([("", 0.0), (" ", BREAK)])
        i = j
    states = {(0, 0): (0.0, None)}
    for ways in [*lattice, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple] = {}
        for (a, b), (score, path) in states.items():
            for text, cost in ways:
                x, y, s = a, b, score + cost
                for ch in text:
                    z = _code(ch)
                    s += model[x, y, z]
                    x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (path, text))
        states = after
    path, out = max(states.values(), key=lambda v: v[0])[1], []
    while path:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out)).strip()


_EDGE = "\"#%&()*,./:;<=>?[\\]^_`{}~'-¿¡"
_PLAIN = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_PAIR = re.compile(r"(.)\1+")
_TAIL = re.compile(r"([$!])\1{2,}$")


class Restorer:
    """Words of a text after deobfuscation, with a bounded memory of tokens."""

    def __init__(self, model: np.ndarray, squeezed: frozenset[str] = frozenset()):
        self.model, self.squeezed, self.known = model, squeezed, {}

    def token(self, raw: str) -> tuple[str, ...]:
        low = raw.lower()
        core = low.strip(_EDGE + "$!@+|€")
        if _PLAIN.fullmatch(core):
            disguised = _RUN.search(core) or _PAIR.sub(r"\1", core) in self.squeezed
            lead = low.strip(_EDGE)[:1] in "$@!|+€" or (len(core) <= 3 and low.rstrip(_EDGE)[-1:] in "$@!")
            if not disguised and not lead:
                return (core,)
            if lead:
                core = low.strip(_EDGE)
        elif not any(c.isalpha() for c in core):
            return ()  # numbers
        else:
            core = _TAIL.sub("", low.strip(_EDGE))
        return tuple(decode(core, self.model).split())

    def words(self, text: str) -> list[str]:
        known, out, spelled = self.known, [], []
        if len(known) > _KEPT:
            known.clear()
        tokens = text.split()
        for t in tokens:
            if len(t) == 1 and (t.isalnum() or t in "$@!"):
                spelled.append(t)
                continue
            if spelled:
                out += self._spelled(spelled)
                spelled = []
            w = known.get(t)
            if w is None:
                w = self.token(t)
                if len(t) <= _LONG:  # long tokens, texts without blanks, are not worth remembering
                    known[t] = w
            out += w
        return out + self._spelled(spelled)

    def _spelled(self, letters: list[str]) -> list[str]:
        if len(letters) < 3 or not any(c.isalpha() for c in letters):
            return [c.lower() for c in letters]
        return decode("".join(letters).lower(), self.model, spelled=True).split()


@dataclass
class Model:
    language: np.ndarray
    pieces: list[str]
    weights: np.ndarray
    bias: float

    def restorer(self) -> Restorer:
        return Restorer(self.language, frozenset(_PAIR.sub(r"\1", w) for w in self.pieces if w[-1] != "*"))


def _pieces(word: str) -> list[str]:
    """The word and its starts; no restored word holds a star."""
    return [word, *(word[:n] + "*" for n in STARTS if n < len(word))]


class _Counter:
    """Counts of the model's pieces in a text, with a bounded memory of words."""

    def __init__(self, model: Model):
        self.restorer, self.place, self.known = model.restorer(), {w: i for i, w in enumerate(model.pieces)}, {}

    def count(self, text: str) -> np.ndarray:
        place, known, out = self.place, self.known, np.zeros(len(self.place))
        if len(known) > _KEPT:
            known.clear()
        for w in self.restorer.words(text):
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(place[p] for p in _pieces(w) if p in place)
            for k in at:
                out[k] += 1
        return out


def _distinct_pieces(language: np.ndarray):
    def run(batches):
        import pyarrow as pa
        restorer = Restorer(language)
        for batch in batches:
            found = [sorted({p for w in set(restorer.words(t or "")) for p in _pieces(w)})
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["label", "pieces"])
    return run


def _features(model: Model):
    def run(batches):
        import pyarrow as pa
        counter = _Counter(model)
        for batch in batches:
            at, n = [], []
            for t in batch.column(1).to_pylist():
                x = counter.count(t or "")
                seen = np.flatnonzero(x)
                at.append(seen.astype("<u2").tobytes())
                n.append(x[seen].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                                             ["label", "at", "n"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps with a small ridge, over log counts; ``x`` holds counts and
    is read in blocks of rows."""
    k = x.shape[1] + 1
    ridge = np.full(k, 0.3)
    ridge[-1] = 1e-3
    w = np.zeros(k)
    for _ in range(30):
        hessian, slope = np.diag(ridge), ridge * w
        for i in range(0, len(x), 2000):
            part = np.column_stack([np.log1p(x[i:i + 2000].astype(float)), np.ones(len(x[i:i + 2000]))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            hessian += (part * (p * (1 - p))[:, None]).T @ part
            slope += part.T @ (p - y[i:i + 2000])
        step = np.linalg.solve(hessian, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY,
          label: str = "toxic") -> Model | None:
    language = language_model(docs)
    sample = labelled_sample(docs, labels, label, sample_docs).cache()
    try:
        sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        if not sizes.get(0) or not sizes.get(1):
            return None
        n1, n0 = sizes[1], sizes[0]
        odds = (sample.mapInArrow(_distinct_pieces(language), "label int, pieces array<string>")
                .select("label", F.explode("pieces").alias("piece")).groupBy("piece")
                .agg(F.sum("label").alias("a"), F.count("*").alias("n")).filter(F.col("a") >= LEAST_DOCS)
                .withColumn("b", F.col("n") - F.col("a"))
                .withColumn("z", (F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1)))
                            / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
                .filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "piece").limit(vocabulary))
        model = Model(language, [r.piece for r in odds.select("piece").collect()], np.zeros(0), 0.0)
        rows = sample.mapInArrow(_features(model), "label int, at binary, n binary").collect()
    finally:
        sample.unpersist()
    x = np.zeros((len(rows), len(model.pieces)), np.uint32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.n, "<u4")
    model.weights, model.bias = _logistic(x, np.array([r.label for r in rows], float))
    return model


def _score(model: Model | None):
    def run(batches):
        import pyarrow as pa
        if model is not None:
            counter = _Counter(model)
        for batch in batches:
            n = batch.num_rows
            score = np.full(n, 0.5)
            if model is not None:
                column = batch.column(1)
                for i in range(n):
                    x = counter.count(column[i].as_py() or "")
                    score[i] = 1 / (1 + np.exp(-np.clip(np.log1p(x) @ model.weights + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, **options)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
