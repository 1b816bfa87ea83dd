"""File adapter (SRC-1..3, SRC-5): NDJSON and CSV files as envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermesh.functions.binding import let

_EMPTY_TAGS = "map<string,string>"


def generated_key(*parts) -> F.Column:
    """Key of a record that brings none: a hash of where it stands, so a re-read
    of the same file gives the same keys (the reference draws a random UUID)."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def numbered(rows: DataFrame, cols: list[str], step: int = 10000) -> DataFrame:
    """Rows of ``cols`` with ``_nth``, 1..n among n equal rows (null in a stream,
    which cannot count them). Equal rows are counted map-side and dealt out
    again in pieces of ``step``, so no task or group holds them all."""
    if rows.isStreaming:
        return rows.select(*cols, F.lit(None).cast("bigint").alias("_nth"))
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counted.select(*cols, "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n", F.lit(step).cast("bigint")))
                            .alias("_from"))
    return pieces.select(*cols, F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + (step - 1))))
                         .alias("_nth"))


def with_keys(rows: DataFrame, key: F.Column, cols: list[str], source_system: str) -> DataFrame:
    """``cols`` and ``idempotency_key``: the row's own, else one generated from
    ``cols`` and the number among equal rows (equal rows stay separate records);
    in a stream a random one, as rows cannot be counted there."""
    df = rows.withColumn("_key", F.nullif(key, F.lit("")))
    own = df.filter(F.col("_key").isNotNull()).select(*cols, F.col("_key").alias("idempotency_key"))
    rest = numbered(df.filter(F.col("_key").isNull()), cols)
    made = F.uuid() if rows.isStreaming else generated_key(F.lit(source_system), *cols, F.col("_nth").cast("string"))
    return own.unionByName(rest.select(*cols, made.alias("idempotency_key")))


def _envelopes(rows: DataFrame, ref, source_system: str, adapter_type: str, payload, schema) -> DataFrame:
    return rows.select(
        "idempotency_key",
        F.coalesce(ref, F.lit("")).alias("transaction_ref"),
        F.lit(source_system).alias("source_system"),
        F.lit(adapter_type).alias("adapter_type"),
        payload.alias("payload_text"),
        F.lit(schema).cast("string").alias("payload_schema"),
        F.lit(None).cast("string").alias("trace_id"),
        F.create_map().cast(_EMPTY_TAGS).alias("tags"),
    )


def ndjson_lines_to_envelopes(lines: DataFrame, source_system: str, adapter_type: str = "file",
                              text_col: str = "value", path_col: str | None = "_path") -> DataFrame:
    """SRC-1 mapping: one JSON object per line; blank lines skipped; key and
    ref peeked from the line; a missing key is generated, one per line."""
    text = F.col(text_col)
    path = F.col(path_col) if path_col and path_col in lines.columns else F.lit("")
    rows = lines.filter(F.length(F.trim(text)) > 0).select(path.alias("_path"), text.alias("_text"))
    rows = with_keys(rows, F.get_json_object("_text", "$.idempotency_key"), ["_path", "_text"], source_system)
    return _envelopes(rows, F.get_json_object("_text", "$.transaction_ref"), source_system, adapter_type,
                      F.col("_text"), None)


def read_ndjson(spark: SparkSession, path: str, source_system: str, stream: bool = False,
                adapter_type: str = "file", max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-1 / SRC-5: NDJSON files (batch, or a file stream for landed pages)."""
    if stream:
        reader = spark.readStream.format("text")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = reader.load(path)
    else:
        lines = spark.read.text(path)
    lines = lines.withColumn("_path", F.col("_metadata.file_path"))
    return ndjson_lines_to_envelopes(lines, source_system, adapter_type)


_CSV = {"ignoreLeadingWhiteSpace": "true", "escape": '"'}


def _fields(text: str, width: int) -> F.Column:
    parsed = F.from_csv(F.col(text), ", ".join(f"c{i} string" for i in range(width)), _CSV)
    return let(parsed, lambda r: F.array(*[r[f"c{i}"] for i in range(width)]))


def csv_rows_to_envelopes(rows: DataFrame, source_system: str) -> DataFrame:
    """SRC-2 mapping: rows of ``_path``, ``_names`` (their file's header fields) and
    ``_values``. Header names are trimmed and lower-cased (the last of equal names
    counts); each row becomes a JSON object of all header fields (missing ones
    empty) with schema ``csv.v1``; fields beyond the header are ignored."""
    names = F.transform("_names", lambda x: F.lower(F.trim(x)))
    obj = let(F.struct(names.alias("n"), F.col("_values").alias("v")), lambda r: let(
        F.array_sort(F.filter(F.transform(r["n"], lambda name, i: F.struct(
            name.alias("k"), i.alias("i"), F.coalesce(F.get(r["v"], i), F.lit("")).alias("v"))),
            lambda e: e["k"].isNotNull())),
        lambda pairs: F.map_from_entries(F.transform(
            F.filter(pairs, lambda e, j: ~F.get(pairs, j + 1)["k"].eqNullSafe(e["k"])),
            lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))))
    # a generator's output is made once a row: filters and uses above it are not replaced by the parsing
    rows = rows.select("_path", F.explode(F.array(F.to_json(obj))).alias("_json"))
    rows = with_keys(rows, F.get_json_object("_json", "$.idempotency_key"), ["_path", "_json"], source_system)
    return _envelopes(rows, F.get_json_object("_json", "$.transaction_ref"), source_system, "file",
                      F.col("_json"), "csv.v1")


def csv_lines_to_envelopes(lines: DataFrame, source_system: str, width: int) -> DataFrame:
    """SRC-2 mapping of data lines (``value``) that each hold one record, with the
    header line of their own file (``_header``) and ``_path``; leading blanks are
    trimmed, blank lines skipped. ``width`` is the greatest number of header fields."""
    rows = lines.filter(F.length("value") > 0)
    return csv_rows_to_envelopes(rows.withColumn("_names", _fields("_header", width))
                                 .withColumn("_values", _fields("value", width)), source_system)


def read_csv(spark: SparkSession, path: str, source_system: str) -> DataFrame:
    """SRC-2: CSV files, each by its own header (its first record, on one line).

    Quoted fields may hold line ends, so a file is read as a whole by one task
    (the reference takes files up to 100 MB); many files make many tasks. The
    header is found by its place, so data rows equal to it are kept. Only the
    headers' greatest width comes to the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"),
                                         F.col("_metadata.file_block_start").alias("_start"))
    heads = (lines.filter((F.col("_start") == 0) & (F.length("value") > 0))
             .withColumn("_at", F.monotonically_increasing_id())  # grows along a file's first block
             .groupBy("_path").agg(F.min_by("value", "_at").alias("_header")))
    width = heads.agg(F.max(F.length("_header") - F.length(F.replace("_header", F.lit(","), F.lit(""))) + 1)).first()[0]
    names = [f"c{i}" for i in range(int(width or 1))]
    rows = (spark.read.schema(", ".join(f"{c} string" for c in names)).option("multiLine", "true").options(**_CSV)
            .csv(path).select(F.col("_metadata.file_path").alias("_path"), F.array(*names).alias("_values"))
            .withColumn("_at", F.monotonically_increasing_id()))  # grows along a file, which is one task's
    first = rows.groupBy("_path").agg(F.min_by("_values", "_at").alias("_names"), F.min("_at").alias("_first"))
    return csv_rows_to_envelopes(rows.join(first, "_path").filter(F.col("_at") > F.col("_first"))
                                 .select("_path", "_names", "_values"), source_system)


ALLOWED_EXTENSIONS = (".json", ".ndjson", ".csv")


def route_files(spark: SparkSession, directory: str, source_system: str) -> DataFrame:
    """SRC-3: ``.csv`` files as CSV, ``.json``/``.ndjson`` as NDJSON; other
    extensions are not read."""
    import os
    parts = []

    def has(pattern: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(directory, pattern))
        return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))

    if has("*.csv"):
        parts.append(read_csv(spark, os.path.join(directory, "*.csv"), source_system))
    for ext in ("json", "ndjson"):
        if has(f"*.{ext}"):
            parts.append(read_ndjson(spark, os.path.join(directory, f"*.{ext}"), source_system))
    if not parts:
        raise FileNotFoundError(f"no .csv/.json/.ndjson files in {directory}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
