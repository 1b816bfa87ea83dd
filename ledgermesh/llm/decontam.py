"""Benchmark decontamination by a prefix-filtered set join (operator 9).

A benchmark item is cut into windows of 13 consecutive words (a shorter item is
one window). A window is the ordered set of its word shingles (3 words, or the
whole of a 1-2 word window). Full containment is asked for, so the necessary
prefix of a window, its shingles ordered by rarity in the corpus, is its first:
the rarest one.

1. One pass over the documents keeps the positions whose shingle occurs in the
   benchmark; counting them gives the corpus rarity.
2. Positions that hold a window's rarest shingle give candidate windows; the
   shingle's offset bounds the start, the window's length the end.
3. A candidate is confirmed when every shingle of the window stands at its
   place: exact containment over item-sized windows.

DataFrame functions only. The shingles of the benchmark are broadcast while
they number at most ``broadcast_limit`` (checked by a count); beyond it the same
join shuffles narrow rows. Shingles are joined by their 64-bit hash and first word.

Edge cases: null text has no words; an item without words has no window; an
item without id marks words as hit but is not listed; rows equal in id and text
share their result; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import ascii_lower, staged

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 3


def words(text: Column) -> Column:
    """Splitting between words is twice as fast as extracting them."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _sid(tokens: str, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(F.col(tokens), at + j) for j in range(width)])


def _at_each(width: int):
    return lambda at: _sid("w", at, width)


def _windows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``wid, item, size, width, shingles`` of every distinct window of an item."""
    item = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    out = (item.filter(n > 0)
           .select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))).alias("at"))
           .select("item", F.slice("w", F.col("at") + 1, WINDOW).alias("w")).distinct()
           .select(F.xxhash64("item", "w").alias("wid"), "item", "w", F.size("w").alias("size"))
           .withColumn("width", F.least(F.lit(SHINGLE), "size")))
    one = F.when(F.col("width") == 1, F.transform("w", lambda x: F.xxhash64(F.lit(1), x)))
    for k in range(2, SHINGLE + 1):
        one = one.when(F.col("width") == k, F.transform(
            F.sequence(F.lit(0), F.col("size") - k), _at_each(k)))
    return out.withColumn("shingles", one)


def hits(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
         broadcast_limit: int = 1_000_000) -> DataFrame:
    """Confirmed windows: ``doc_id, h, start, size, item`` (start from 0)."""
    windows = staged(_windows(items, item_col, text_col), "windows")
    parts = windows.select("wid", "w", "width", F.posexplode("shingles").alias("off", "sid"))
    vocabulary = staged(parts.select("sid", F.get("w", F.col("off")).alias("word"), "width").distinct(), "vocabulary")
    small = vocabulary.count() <= broadcast_limit
    widths = [r.width for r in vocabulary.select("width").distinct().collect()]  # 1 to 3 values

    text = docs.select(F.col("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), words(F.col(text_col)).alias("w"))
    # the outer form: the inner one adds a filter that splits every text once more
    spread = text.select("doc_id", "h", "w", F.posexplode_outer("w").alias("pos", "word"))
    found = None
    for k in sorted(widths) or [SHINGLE]:
        known = vocabulary.filter(F.col("width") == k).select("sid", "word")
        part = spread.filter(F.col("pos") + k <= F.size("w")).select(
            "doc_id", "h", "pos", "word", _sid("w", F.col("pos"), k).alias("sid"))
        part = part.join(F.broadcast(known) if small else known, ["sid", "word"]).select("doc_id", "h", "pos", "sid")
        found = part if found is None else found.union(part)
    found = staged(found.dropDuplicates(["doc_id", "h", "pos", "sid"]), "positions")

    rarity = found.groupBy("sid").agg(F.count("*").alias("n"))
    prefix = (parts.join(rarity, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .groupBy("wid").agg(F.min(F.struct("n", "sid", "off")).alias("rare"))
              .filter("rare.n > 0")  # a shingle that occurs nowhere rules its window out
              .select("wid", F.col("rare.sid").alias("sid"), F.col("rare.off").alias("off")))
    probe = prefix.join(windows.select("wid", "item", "size", "shingles"), "wid")
    candidates = (found.join(probe, "sid").select("doc_id", "h", (F.col("pos") - F.col("off")).alias("start"), "wid",
                                                  "item", "size", "shingles").filter("start >= 0"))
    wanted = candidates.select("doc_id", "h", "start", "wid", "item", "size", F.size("shingles").alias("parts"),
                               F.posexplode("shingles").alias("j", "sid")
                               ).withColumn("pos", F.col("start") + F.col("j"))
    there = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("p"),
                         F.col("sid").alias("s"))
    same = (F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("pos") == F.col("p"))
            & (F.col("sid") == F.col("s")))
    return (wanted.join(there, same, "left_semi").groupBy("doc_id", "h", "start", "wid", "item", "size", "parts")
            .agg(F.count("*").alias("met")).filter("met = parts").select("doc_id", "h", "start", "size", "item"))


def _marks(confirmed: DataFrame) -> DataFrame:
    """Per document with hits: distinct hit words and items."""
    covered = (confirmed.select("doc_id", "h", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos"))
               .distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit")))
    listed = confirmed.select("doc_id", "h", "item").distinct().groupBy("doc_id", "h").agg(
        F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    other = listed.toDF("d", "g", "n_items", "items")
    return covered.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select(
        F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_hit", "n_items", "items")


def contamination(docs: DataFrame, items: DataFrame, share: int = 20, **options) -> DataFrame:
    """``doc_id, h, n_words, n_hit, n_items, items, contaminated`` of every
    document; contaminated: some word is hit and at least one in ``share``."""
    marks = _marks(hits(docs, items, **options))
    counted = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                         F.coalesce("items", F.lit("")).alias("items"),
                         ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: int = 20, **options) -> DataFrame:
    """``docs`` without contaminated documents; columns stay as they are."""
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    marks = _marks(hits(docs, items, **options)).select(F.col("d").alias("__d"), F.col("g").alias("__g"),
                                                        F.col("n_hit").alias("__n"))
    joined = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")), "left")
    keep = F.col("__n").isNull() | (F.col("__n") * share < F.size(words(F.col("text"))))
    return joined.filter(keep).select(*[F.col(f"`{c}`") for c in docs.columns])
