"""Token files by static range asymmetric numeral systems (operator 1).

``write_tokens`` tokenizes every whole text, appends the end id, and counts ids
over all documents: one frequency table, shared by all blocks, scaled to 2^20.
Documents are range-partitioned by doc_id; each partition (a shard) is cut
into blocks of whole documents. A block is independent: ``lanes`` interleaved
64-bit coder states take tokens in turn, and every ``SEGMENT`` steps a checkpoint
stores the states, the place in the word stream and a checksum, so a reader can
start at any checkpoint. ``read_tokens`` decodes all checkpoints of a block at
once and checks every checksum; a damaged block raises ValueError.

Layout under the path: ``blocks`` (shard, block, n_tokens, doc_ids, lengths,
payload) and ``table`` (symbol, frequency), as Parquet. Payload: header
``<4sIIIII`` (magic, tokens, lanes, segment steps, segments, words), per segment
``<II`` (word position, crc32 of its ids as little-endian 32 bits) and its
states as 64 bits, then the words of 32 bits.

The tokenizer drops white space and never joins across it, so words are
encoded once and remembered in lower case (a bounded memory in each worker); a
trailing run of punctuation after a letter is a piece of its own. Pieces of ASCII
and Latin-1 letters reach the tokenizer's model already split, if its other steps
are the known ones; all other pieces go through the whole tokenizer. Symbols are
counted by the pass that tokenizes.

Edge cases: null text is empty and yields the end id alone; null ids come first;
rows of equal id stand in order of their text's hash; an empty table gives
empty files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermesh.llm.common import chunks, discard, scratch, staged, utf8
from ledgermesh.llm.shingles import mix

SCALE = 20
LANES, SEGMENT, BLOCK = 1024, 256, 1 << 19
MAGIC = b"RNS1"
HEADER, MARK = struct.Struct("<4sIIIII"), struct.Struct("<II")
U = np.uint64
_LOW = U(1 << 31)
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")  # composed letters that lower case leaves such: one part
_MIXED = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00ff]+|[0-9]|[^a-z\u00df-\u00ff0-9]+")  # of these in lower case
_BYTES = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))  # the characters of the byte level that are not the byte's own
_STEPS = [  # the normalizer, and the splitter that these follow
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]
_SPECIAL = b"<|"
_OTHER, _SPACE, _MARK, _LETTER = range(4)
_KIND = np.zeros(256, np.uint8)  # of a byte
for _k, _bytes in ((_SPACE, b" \t\n\r\x0b\x0c"), (_MARK, b"!#$%&*.,;:?"), (_LETTER, b"abcdefghijklmnopqrstuvwxyz")):
    _KIND[list(_bytes)] = _k
_PART, _BLANK = 1 << 18, re.compile(rb"\s")  # bytes worked on at once: work arrays of a few MB, which caches hold
_SLOTS = 21  # bits: 2 M slots, filled by half at most; some 60 MB in each worker
_BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_memory: dict[str, tuple] = {}
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n`` - 1 at least, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * _PART), U(base))
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 2 * _PART:  # tables for longer words are not kept
            _powers[base] = have
    return have


class Pieces:
    """The ids of word pieces, remembered in an open hash table of arrays that is
    searched for all pieces of many texts at once. A piece is known by 127 bits
    of two polynomial hashes; a full table is emptied, and made larger for texts
    that hold more pieces at once."""

    def __init__(self, encode, dtype, bits: int = _SLOTS):
        self.encode, self.dtype, self.bits = encode, dtype, bits
        self.clear()

    def clear(self, least: int = 0) -> None:
        self.bits = max(self.bits, (2 * least).bit_length())
        n = 1 << self.bits
        self.a, self.b = np.zeros(n, U), np.zeros(n, U)  # a is never 0 in a taken slot
        self.place = np.zeros(n, np.int64)  # of the piece's ids: their start times 2^32, and how many
        self.ids, self.used, self.count = np.zeros(1 << 16, self.dtype), 0, 0

    def _home(self, a: np.ndarray) -> np.ndarray:
        return (a >> U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not known."""
        out = self._home(a)
        k = self.a[out]
        hit = k == a
        hit &= self.b[out] == b
        live = np.flatnonzero(~hit)
        slot, k = out[live], k[live]
        out[live] = -1
        while len(live):
            on = k != 0
            live, slot = live[on], (slot[on] + 1) & (len(self.a) - 1)
            k = self.a[slot]
            hit = (k == a[live]) & (self.b[slot] == b[live])
            out[live[hit]] = slot[hit]
            live, slot, k = live[~hit], slot[~hit], k[~hit]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, pieces: list[bytes]) -> None:
        """Encode and remember pieces whose keys are not known and differ."""
        encoded = self.encode(pieces)
        n = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(encoded), self.dtype)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * len(flat), self.dtype)])
        self.ids[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.count += len(a)
        slot, live = self._home(a), np.arange(len(a))
        while len(live):  # the first of those that want a free slot gets it, the others go on
            s = slot[live]
            free = np.flatnonzero(self.a[s] == 0)
            won = free[np.unique(s[free], return_index=True)[1]]
            k, t = live[won], s[won]
            self.a[t], self.b[t], self.place[t] = a[k], b[k], (at[k] << 32) | n[k]
            live = np.delete(live, won)
            slot[live] = (slot[live] + 1) & (len(self.a) - 1)

    def slots(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The slots of the pieces ``data[start:stop]``."""
        value, size, keys = data.astype(U), (stops - starts).astype(U), []
        value += U(1)
        sums = np.zeros(len(data) + 1, U)
        for base in map(int, _BASES):
            np.multiply(value, _power(base, len(data))[:len(data)], out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
            key = sums[stops]
            key -= sums[starts]
            key *= _power(pow(base, -1, 1 << 64), len(data))[starts]
            key += size
            keys.append(mix(key))
        a, b = keys[0] | U(1), keys[1]
        slot, text = self.find(a, b), data.tobytes()
        while (lost := np.flatnonzero(slot < 0)).size:
            _, first = np.unique(a[lost], return_index=True)  # equal a, other b: in the next turn
            k = lost[first]
            if self.count + len(k) > len(self.a) // 2:
                self.clear(len(k))
                slot[:] = -1
                continue
            self.add(a[k], b[k], [text[i:j] for i, j in zip(starts[k].tolist(), stops[k].tolist(), strict=True)])
            slot[lost] = self.find(a[lost], b[lost])
        return slot


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case, one after the other, their places, and where pieces
    start and stop: words, and runs of punctuation that end a word after a letter."""
    low = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    kind = np.full(len(low) + 2, _SPACE, np.uint8)  # of byte i at i + 1
    kind[1:-1] = _KIND[low]
    mark, word = kind == _MARK, kind != _SPACE
    edge = np.flatnonzero(mark[1:] != mark[:-1])
    first, after = edge[::2], edge[1::2]
    cut = first[(kind[first] == _LETTER) & (kind[after + 1] == _SPACE)]
    starts, stops = word[1:] > word[:-1], word[1:] < word[:-1]
    starts[cut] = stops[cut] = True
    return low, np.cumsum([0, *(len(t) + 1 for t in texts)]), np.flatnonzero(starts), np.flatnonzero(stops)


def _encode_texts(known: Pieces, texts: list[bytes]) -> list[bytes]:
    """The ids of each text, as bytes; a long text is encoded in parts that end at
    white space."""
    if len(texts) == 1 and len(texts[0]) > _PART:
        text, parts, i = texts[0], [], 0
        while i < len(text):
            blank = _BLANK.search(text, i + _PART)
            j = blank.end() if blank else len(text)
            parts += _encode_some(known, [text[i:j]])
            i = j
        return [b"".join(parts)]
    return _encode_some(known, texts)


def _encode_some(known: Pieces, texts: list[bytes]) -> list[bytes]:
    data, at, starts, stops = _split(texts)
    if not len(starts):
        return [b""] * len(texts)
    slot = known.slots(data, starts, stops)  # may empty the table, so its places are looked up after
    place = known.place[slot]
    n = place & 0xFFFFFFFF
    ends = np.concatenate([[0], np.cumsum(n)])
    place >>= 32
    place -= ends[:-1]
    where = np.repeat(place, n)
    where += np.arange(ends[-1])
    flat = known.ids[where]
    cuts = ends[np.searchsorted(starts, at)].tolist()
    return [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]


def _for_parts(tokenizer):
    """The tokenizer's model alone, for text already split at blanks: the regular
    expression and the bookkeeping of the steps before it take half of the time. None
    for a tokenizer whose steps are not those that ``_WORD`` and ``_PARTS`` follow."""
    from tokenizers import Tokenizer, pre_tokenizers
    steps = [tokenizer.normalizer, tokenizer.pre_tokenizer]
    if None in steps or [json.loads(x.__getstate__()) for x in steps] != _STEPS:
        return None
    model = Tokenizer(tokenizer.model)  # shared, not a copy
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return model


def _encoder(tokenizer, dtype, for_parts=None):
    """Ids of pieces, each on its own, as bytes; ``for_parts`` (see ``_for_parts``)
    encodes those it can."""
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
    width = dtype.itemsize

    def batch(tok):  # without places in the text
        return getattr(tok, "encode_batch_fast", tok.encode_batch)

    def together(tok, which: list[int], texts: list[str], parts: list[int] | None, out: list) -> None:
        """Many pieces in one call: the last id of a part is marked as a word's end, so the ids of a piece stop at
        its last part's mark. Lines with other counts of marks (letters that stop being such in lower case, a
        vocabulary without marks) are left out."""
        cuts = range(0, len(which), 512)
        lines = [" ".join(texts[i:i + 512]) for i in cuts]
        if tok is for_parts:
            lines = [x.lower().encode().decode("latin-1") for x in lines]
            for byte, char in _BYTES:
                lines = [x.replace(byte, char) for x in lines]
        for c, e in zip(cuts, batch(tok)(lines, add_special_tokens=False), strict=True):
            line = which[c:c + 512]
            ids = np.array(e.ids, dtype)
            stops = np.flatnonzero(ends[ids]) + 1
            last = np.arange(len(line)) if parts is None else np.cumsum(parts[c:c + 512]) - 1
            if len(stops) != last[-1] + 1 or stops[-1] != len(ids):
                continue
            data, i = ids.tobytes(), 0
            for k, j in zip(line, (stops[last] * width).tolist(), strict=True):
                out[k] = data[i:j]
                i = j

    def encode(pieces: list[bytes]) -> list[bytes]:
        out: list = [None] * len(pieces)
        words = b" ".join(pieces).decode().split(" ")
        if for_parts is not None:
            letters = [k for k, w in enumerate(words) if _WORD.fullmatch(w)]
            together(for_parts, letters, [words[k] for k in letters], None, out)
            mixed = [k for k, x in enumerate(out) if x is None and _MIXED.fullmatch(words[k])]
            parts = [_PARTS.findall(words[k].lower()) for k in mixed]
            together(for_parts, mixed, [" ".join(x) for x in parts], [len(x) for x in parts], out)
        alpha = [k for k, x in enumerate(out) if x is None and words[k].isalpha()]
        together(tokenizer, alpha, [words[k] for k in alpha], None, out)
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, batch(tokenizer)([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype).tobytes()
        return out
    return encode


def _tokenize(path: str, end_id: int, dtype, vocabulary: int = 49_408):
    """Rows of documents with their ids, then a row per symbol that the task met, with its count."""
    def run(batches):
        import os

        import pyarrow as pa
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        names = ["doc_id", "h", "ids", "symbol", "n"]
        if path not in _memory:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            _memory[path] = tokenizer, Pieces(_encoder(tokenizer, dtype, _for_parts(tokenizer)), dtype)
        tokenizer, known = _memory[path]
        end, total = np.array([end_id], dtype).tobytes(), np.zeros(vocabulary, np.int64)
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            out = []
            for i, j in chunks(offsets, _PART):
                texts = [buf[offsets[r]:offsets[r + 1]].tobytes() for r in range(i, j)]
                # special ids are given to their exact spelling only, so such texts are encoded as they are
                odd = [k for k, t in enumerate(texts) if _SPECIAL in t]
                ids = _encode_texts(known, [b"" if k in odd else t for k, t in enumerate(texts)] if odd else texts)
                for k in odd:
                    ids[k] = np.array(tokenizer.encode(texts[k].decode(), add_special_tokens=False).ids, dtype).tobytes()
                ids = [x + end for x in ids]
                total += np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=vocabulary)
                out += ids
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), none, none], names)
        seen = np.flatnonzero(total)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen), pa.array(total[seen])],
                                         names)
    return run


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale, at least 1 for every counted symbol."""
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.zeros(len(counts), np.int64)
    exact = counts[seen] / counts.sum() * ((1 << scale) - len(seen))
    part = 1 + exact.astype(np.int64)
    order = np.argsort(part - 1 - exact, kind="stable")  # largest remainders first
    part[order[:(1 << scale) - part.sum()]] += 1
    out = np.zeros(len(counts), np.int64)
    out[seen] = part
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, lanes: int = LANES, segment: int = SEGMENT) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes:(t + 1) * lanes]
        k, f = len(s), freq[s]
        x = state[:k]
        over = x >= (f << U(63 - SCALE))
        spill = x[over]
        if len(spill):
            words.append((spill & U(0xFFFFFFFF)).astype(np.uint32))
            written += len(spill)
            x = np.where(over, x >> U(32), x)
        q = x // f
        state[:k] = (q << U(SCALE)) + (x - q * f) + cum[s]
        if t % segment == 0:
            marks.append((written, state.tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    out = [HEADER.pack(MAGIC, n, lanes, segment, len(marks), len(stream))]
    span = lanes * segment
    for g, (sofar, states) in enumerate(reversed(marks)):
        crc = zlib.crc32(ids[g * span:(g + 1) * span].astype("<u4").tobytes())
        out += [MARK.pack(len(stream) - sofar, crc), states]
    return b"".join([*out, stream.astype("<u4").tobytes()])


def decode_block(payload: bytes, freq: np.ndarray, cum: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Ids of a block; all its segments are decoded side by side."""
    magic, n, lanes, segment, segments, n_words = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at, place, crcs, states = HEADER.size, [], [], []
    for _ in range(segments):
        p, c = MARK.unpack_from(payload, at)
        states.append(np.frombuffer(payload, "<u8", lanes, at + MARK.size))
        place.append(p)
        crcs.append(c)
        at += MARK.size + 8 * lanes
    stream = np.frombuffer(payload, "<u4", n_words, at).astype(U)
    out = np.zeros(segments * segment * lanes, np.uint32)
    if segments:
        state, pos = np.stack(states), np.array(place)
        grid = out.reshape(segments, segment, lanes)
        lane = np.arange(lanes)
        length = np.minimum(n - np.arange(segments) * segment * lanes, segment * lanes)
        whole = int(length.min()) // lanes  # steps that all lanes of all segments take
        for t in range(segment):
            slot = state & U((1 << SCALE) - 1)
            s = symbol[slot.view(np.int64)]
            x = state >> U(SCALE)
            x *= freq[s]
            x += slot
            x -= cum[s]
            grid[:, t] = s
            need = x < _LOW
            if t >= whole:
                live = lane < (length - t * lanes)[:, None]  # the last step may be short
                if not live.any():
                    break
                need &= live
                x = np.where(live, x, state)
            upto = pos + np.count_nonzero(need, axis=1)
            if upto.max() > n_words:
                raise ValueError("token block is cut short")
            at = np.flatnonzero(need)  # the words of a segment are taken one after the other
            flat = x.reshape(-1)
            flat[at] = (flat[at] << U(32)) | np.concatenate(
                [stream[i:j] for i, j in zip(pos.tolist(), upto.tolist(), strict=True)])
            state, pos = x, upto
    out = out[:n]
    span = lanes * segment
    for g, crc in enumerate(crcs):
        if zlib.crc32(out[g * span:(g + 1) * span].astype("<u4").tobytes()) != crc:
            raise ValueError(f"token block: checksum of segment {g} differs")
    return out


def _tables(freq: np.ndarray):
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    return freq.astype(U), cum.astype(U), np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def _pack(freq: np.ndarray, dtype, block: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        shard, number = TaskContext.get().partitionId(), 0
        f, c, _ = _tables(freq)
        ids, docs, lengths, held = [], [], [], 0

        def flush():
            nonlocal number, ids, docs, lengths, held
            flat = np.concatenate(ids)
            row = [[shard], [number], [len(flat)], [docs], [lengths], [encode_block(flat, f, c)]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            number, ids, docs, lengths, held = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)],
                                              ["shard", "block", "n_tokens", "doc_ids", "lengths", "payload"])
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for r, doc in enumerate(batch.column(0).to_pylist()):
                part = buf[offsets[r]:offsets[r + 1]].view(dtype).astype(np.int64)
                ids.append(part)
                docs.append(doc)
                lengths.append(len(part))
                held += len(part)
                if held >= block:
                    yield flush()
        if ids:
            yield flush()
    return run


def _unpack(freq: np.ndarray):
    def run(batches):
        import pyarrow as pa
        f, c, symbol = _tables(freq)
        for batch in batches:
            for shard, block, docs, lengths, payload in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                flat = decode_block(payload, f, c, symbol).astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(flat[e - n:e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * k, pa.int64()), pa.array([block] * k, pa.int64()), pa.array(docs, pa.int64()),
                     pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "block", "doc_id", "ahead", "n_tokens", "ids_crc32"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int = 49_408, end_id: int = 2,
                 block: int = BLOCK) -> None:
    """Tokenize ``docs(doc_id, text)`` and write the token files under ``path``."""
    dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    if vocabulary > 1 << SCALE:
        raise ValueError(f"at most {1 << SCALE} symbols fit the frequency table")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    ids = staged(rows.mapInArrow(_tokenize(tokenizer, end_id, dtype, vocabulary),
                                 "doc_id long, h long, ids binary, symbol long, n long"), "ids")
    counts = np.zeros(vocabulary, np.int64)  # one row per symbol of the vocabulary, whatever the input
    for r in ids.filter("symbol is not null").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r.symbol] = r.n
    freq = scaled(counts)
    spark = docs.sparkSession
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(s), int(freq[s])) for s in seen], "symbol long, frequency long").coalesce(1).write.parquet(
        f"{path}/table")
    (ids.filter("symbol is null").repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
     .mapInArrow(_pack(freq, dtype, block), "shard long, block long, n_tokens long, doc_ids array<long>, "
                                            "lengths array<long>, payload binary").write.parquet(f"{path}/blocks"))
    discard(ids)


def read_tokens(spark: SparkSession, path: str, vocabulary: int = 49_408) -> DataFrame:
    """Decode token files: ``doc_id, start, n_tokens, ids_crc32, shard, block``."""
    freq = np.zeros(vocabulary, np.int64)
    for r in spark.read.parquet(f"{path}/table").collect():
        freq[r.symbol] = r.frequency
    blocks = spark.read.parquet(f"{path}/blocks")
    decoded = blocks.select("shard", "block", "doc_ids", "lengths", "payload").mapInArrow(
        _unpack(freq), "shard long, block long, doc_id long, ahead long, n_tokens long, ids_crc32 long")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(  # a row per written partition
        "shard", before(Window.orderBy("shard"), "n").alias("base"))
    starts = sizes.join(shards, "shard").select(
        "shard", "block", (F.col("base") + before(Window.partitionBy("shard").orderBy("block"), "n_tokens")).alias("from"))
    return decoded.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("from") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the token files (to a new shared folder unless ``path`` is given)
    and return what reading them back yields."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
