"""WARC records in seekable Zstandard bundles (operator 12).

``write_bundles`` writes one WARC record per page. The pages of equal payloads
are found by SHA-256: the one of the largest id becomes the response and carries
the payload, the others become revisits that refer to it. Payloads are shuffled once,
folded to one per digest on the map side, and revisits never carry them, so a page
that makes up a third of the table costs no more than its short revisit records.

Each task appends its records to bundles of its own: records are gathered into
frames of about ``frame_bytes``, every frame is an independent Zstandard frame,
and a bundle ends with the seek table of the Zstandard seekable format (a skippable
frame that lists each frame's sizes and checksum). Any Zstandard tool reads a
bundle as one WARC file. The index, a Parquet table, maps record identifiers to
the bundle, the frame and the offset and length inside the frame; ``fetch`` reads
one frame per record asked for. A task names its files anew in each attempt, and
the index, which Spark commits, names only files of tasks that succeeded: files
of lost attempts stay unread. Executors must reach ``path`` by one of Arrow's file
systems (a shared folder, HDFS, S3, ...).

``read_bundles`` reads every frame named in the index back by its seek table, checks
checksums, record counts and payload digests, and raises ValueError on damage.

Edge cases: null html is an empty payload; a null page_id is the smallest and
reads back as null; equal ids are legal, each row has a record, and of rows
equal in id and payload one (of the largest url) is the response; a null url leaves
out the target header, other characters than printable ASCII are percent-encoded in
it; a payload larger than a frame gets a frame of its own; an empty table gives
an index without rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.llm.common import discard, scratch, staged

FRAME_BYTES, BUNDLE_BYTES, LEVEL, TASK_FRAMES = 1 << 20, 1 << 28, 3, 64
DATE = "2000-01-01T00:00:00Z"
# The Zstandard seekable format and WARC 1.1
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
SKIP_HEADER, ENTRY, FOOTER = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("record_id string, page_id long, bundle string, frame long, frame_start long, frame_bytes long, "
         "offset long, length long")
RECORDS = ("record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, target_uri string, bundle string, frame long, offset long")
#: Copies of one row that a single row stands for at most while revisits are dealt out.
COPIES = 100_000


def filesystem(path: str):
    """Arrow's file system of ``path`` and the path inside it."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    tail = hashlib.blake2s(repr((url, digest, copy)).encode("utf-8", "surrogatepass"), digest_size=10).hexdigest()
    return f"urn:page:{'null' if page_id is None else page_id}:{tail}"


def page_of(identifier: str) -> int | None:
    page = identifier.strip("<>").split(":")[2]
    return None if page == "null" else int(page)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def warc_record(kind: str, identifier: str, url: str | None, digest: str, size: int, payload: bytes, refers: str | None,
                date: str) -> bytes:
    """A response, or a revisit: the HTTP header, that states the payload's size,
    and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers (names in lower case), block and end of the record at ``at``."""
    stop = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/", at) or stop < 0:
        raise ValueError(f"no WARC record at offset {at}")
    lines = data[at:stop].decode().split("\r\n")[1:]
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    begin = stop + 4
    end = begin + int(head["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError(f"the WARC record at offset {at} is cut short")
    return head, data[begin:end], end + 4


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame that ends a bundle: (compressed, plain, checksum) of each frame."""
    body = b"".join(ENTRY.pack(*e) for e in entries) + FOOTER.pack(len(entries), CHECKSUMS, SEEKABLE)
    return SKIP_HEADER.pack(SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int, int]]:
    """(start, compressed, plain, checksum) of each frame of an open bundle, by its footer."""
    size = file.size()
    tail = file.read_at(FOOTER.size, size - FOOTER.size) if size >= FOOTER.size else b""
    count, flags, magic = FOOTER.unpack(tail) if len(tail) == FOOTER.size else (0, 0, 0)
    length = SKIP_HEADER.size + count * ENTRY.size + FOOTER.size
    if magic != SEEKABLE or flags != CHECKSUMS or length > size:
        raise ValueError("no seek table at the end of the bundle")
    table = file.read_at(length, size - length)
    if SKIP_HEADER.unpack_from(table) != (SKIPPABLE, length - SKIP_HEADER.size):
        raise ValueError("the seek table of the bundle is damaged")
    out, start = [], 0
    for packed, plain, check in ENTRY.iter_unpack(table[SKIP_HEADER.size:-FOOTER.size]):
        out.append((start, packed, plain, check))
        start += packed
    if start + length != size:
        raise ValueError("the seek table does not cover the bundle")
    return out


def read_frame(file, entry: tuple[int, int, int, int]) -> bytes:
    import xxhash
    import zstandard
    start, packed, plain, check = entry
    try:
        data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, start), max_output_size=plain)
    except zstandard.ZstdError as damage:
        raise ValueError(f"the frame at {start} is damaged: {damage}") from damage
    if len(data) != plain or xxhash.xxh64(data).intdigest() & 0xFFFFFFFF != check:
        raise ValueError(f"the frame at {start} is damaged")
    return data


class _Bundles:
    """Appends records to frames, frames to bundles; returns index rows per frame."""

    def __init__(self, path: str, prefix: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard
        self.fs, self.root = filesystem(path)
        self.prefix, self.frame_bytes, self.bundle_bytes = prefix, frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.number, self.file = 0, None
        self.held, self.rows, self.size = [], [], 0

    def _open(self):
        return self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)  # else Arrow goes by the name

    def add(self, identifier: str, page_id: int | None, record: bytes) -> list:
        done = self.flush() if self.held and self.size + len(record) > self.frame_bytes else []
        self.rows.append((identifier, page_id, self.size, len(record)))
        self.held.append(record)
        self.size += len(record)
        return done

    def flush(self) -> list:
        import xxhash
        if not self.held:
            return []
        if self.file is None:
            self.name = f"{self.prefix}-{self.number:05d}.warc.zst"
            self.file, self.entries, self.written = self._open(), [], 0
        data = b"".join(self.held)
        frame = self.pack.compress(data)
        self.file.write(frame)
        index = [(i, p, self.name, len(self.entries), self.written, len(frame), at, n) for i, p, at, n in self.rows]
        self.entries.append((len(frame), len(data), xxhash.xxh64(data).intdigest() & 0xFFFFFFFF))
        self.written += len(frame)
        self.held, self.rows, self.size = [], [], 0
        if self.written >= self.bundle_bytes:
            self.close()
        return index

    def close(self) -> None:
        if self.file is not None:
            self.file.write(seek_table(self.entries))
            self.file.close()
            self.file, self.number = None, self.number + 1


def _arrow(rows: list, schema: str):
    """A record batch of ``rows`` by a schema of strings and longs."""
    import pyarrow as pa
    kinds = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.string() if t == "string" else pa.int64()) for (_, t), v in zip(kinds, columns, strict=True)],
        [n for n, _ in kinds])


def _write(path: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def run(batches):
        from pyspark import TaskContext
        bundles = _Bundles(path, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", frame_bytes,
                           bundle_bytes, level)
        for batch in batches:
            index = []
            for page_id, url, html, sha1, size, copy, to_page, to_url in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                digest = base32(sha1)
                own = record_id(page_id, url, digest, copy)
                if copy:
                    kind, payload, refers = "revisit", b"", record_id(to_page, to_url, digest, 0)
                else:
                    kind, payload, refers = "response", html, None
                index += bundles.add(own, page_id, warc_record(kind, own, url, digest, size, payload, refers, date))
            yield _arrow(index, INDEX)
        index = bundles.flush()
        bundles.close()
        yield _arrow(index, INDEX)
    return run


def _read(path: str):
    def run(batches):
        fs, root = filesystem(path)
        for batch in batches:
            out, name, file = [], None, None
            for bundle, frame, start, expected in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bundle != name:
                    file = fs.open_input_file(f"{root}/{bundle}")
                    name, table = bundle, read_seek_table(file)
                if frame >= len(table) or table[frame][0] != start:
                    raise ValueError(f"{bundle}: the index and the seek table differ at frame {frame}")
                data, at, count = read_frame(file, table[frame]), 0, 0
                while at < len(data):
                    head, block, end = parse_record(data, at)
                    out.append((*_fields(head, block), bundle, frame, at))
                    at, count = end, count + 1
                if count != expected:
                    raise ValueError(f"{bundle}: frame {frame} has {count} records, the index {expected}")
            yield _arrow(out, RECORDS)
    return run


def _fields(head: dict, block: bytes) -> tuple:
    """Record id, page, type, payload bytes and digest, page referred to, target."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    own, refers = head["warc-record-id"].strip("<>"), head.get("warc-refers-to")
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"{own}: the payload does not match its digest")
    return own, page_of(own), kind, size, digest, page_of(refers) if refers else None, head.get("warc-target-uri")


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  level: int = LEVEL, date: str = DATE) -> None:
    """Write ``pages(page_id, url, html)`` as bundles under ``path``, its index
    under ``path/index``."""
    spark = pages.sparkSession
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.cast("binary").alias("html"))
    digest = F.unhex(F.sha2("html", 256)).alias("key")
    # rows of equal id, url and payload are alike: they are counted, and their copies numbered
    alike = staged(rows.select(digest, F.unhex(F.sha1("html")).alias("sha1"), F.octet_length("html").cast("long").alias("size"),
                               "page_id", "url").groupBy("key", "sha1", "size", "page_id", "url")
                   .agg(F.count("*").alias("n")), "pages")
    first = F.max(F.struct("page_id", "url"))  # a null is the least
    again = alike.groupBy("key").agg(first.alias("to"), F.sum("n").alias("total")).filter("total > 1")
    again = staged(again.select("key", "to", F.lit(True).alias("again")), "groups")
    copies = (alike.join(again, "key").withColumn("n", F.col("n") - F.when(
        F.col("page_id").eqNullSafe(F.col("to.page_id")) & F.col("url").eqNullSafe(F.col("to.url")), 1).otherwise(0))
        .filter("n > 0")
        .withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(COPIES).cast("long")))))
    revisits = (copies.repartition("key", "page_id", "url", "from")  # a row of many copies is many rows from here on
                .withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + COPIES - 1))))
                .select("page_id", "url", F.lit(None).cast("binary").alias("html"), "sha1", "size", "copy",
                        F.col("to.page_id").alias("to_page"), F.col("to.url").alias("to_url")))
    responses = rows.groupBy(digest).agg(first.alias("own"), F.any_value("html").alias("html")).select(
        "own.page_id", "own.url", "html", F.unhex(F.sha1("html")).alias("sha1"),
        F.octet_length("html").cast("long").alias("size"), F.lit(0).cast("long").alias("copy"),
        F.lit(None).cast("long").alias("to_page"), F.lit(None).cast("string").alias("to_url"))
    written = responses.unionByName(revisits).mapInArrow(_write(path, frame_bytes, bundle_bytes, level, date), INDEX)
    written.write.parquet(f"{path}/index")
    discard(alike, again)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles under ``path``, checked."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    frames = index.groupBy("bundle", "frame", "frame_start").agg(F.count("*").alias("records")).select(
        "bundle", "frame", "frame_start", "records")
    return _dealt(frames).mapInArrow(_read(path), RECORDS)


def _dealt(frames: DataFrame) -> DataFrame:
    """Rows of the index in tasks of ``TASK_FRAMES`` neighbouring frames, or fewer for
    every core to have work; left to itself, Spark would judge by the size of
    these few numbers and read all frames in one task."""
    n = frames.select("bundle", "frame").distinct().count()
    cores = frames.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // TASK_FRAMES), min(n, 4 * cores))
    return frames.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``record_id, record`` (bytes) of the records that ``wanted(record_id)`` names,
    reading only their frames."""
    def run(batches):
        import pyarrow as pa
        fs, root = filesystem(path)
        for batch in batches:
            out, held, data = [], None, b""
            for bundle, frame, offset, length in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                if (bundle, frame) != held:
                    file = fs.open_input_file(f"{root}/{bundle}")
                    held, data = (bundle, frame), read_frame(file, read_seek_table(file)[frame])
                out.append(data[offset:offset + length])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["record_id", "record"])
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    found = _dealt(index.join(wanted.select("record_id").distinct(), "record_id"))
    return found.select("record_id", "bundle", "frame", "offset", "length").mapInArrow(run, "record_id string, record binary")


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the bundles (to a new shared folder unless ``path`` is given) and
    return what reading them back yields."""
    path = path or scratch(pages.sparkSession, "warc")
    write_bundles(pages, path, **options)
    return read_bundles(pages.sparkSession, path)


def oracle() -> str:
    """DuckDB statement of ``op12``."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = " || ".join(
        f"substr('{alphabet}', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {15 - 5 * i}) & 31), 1)"
        for g in range(8) for i in range(4))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h,
        max(page_id) OVER (PARTITION BY body) AS top,
        row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS place FROM p)
    SELECT page_id, payload_bytes, {letters} AS payload_digest,
      CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN place > 1 THEN top END AS refers_to
    FROM d"""
