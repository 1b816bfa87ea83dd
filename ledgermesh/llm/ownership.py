"""Secret scan with corpus-wide ownership frequency (operator 3).

Candidates are found in every whole text: ``assign`` (a named credential is set),
``access`` (AKIA keys), ``hex`` (24 digits or more) and, beside those base
kinds, ``opaque`` (20 or more token characters of mixed kinds outside any base
span). Their values are hashed and counted over the corpus by distinct
repositories and owners. A value of more than ``max_owners`` owners or
``max_repos`` repositories is a widely copied example; one of few that looks live (mixed characters, no
placeholder words) is owner-specific. Opaque spans are reported only if live.

Positions are code points: splitting a text at its matches gives the gaps, and
gaps and matches add up to the starts. DataFrame functions only. Owners and
repositories are counted by three nested groupings, each with a partial count
before its shuffle, so one value in a third of all rows is no bottleneck.

The corpus at hand names no repository: the query takes ``source`` as owner and
source with language as repository.

Edge cases: null or empty text has no spans; a null owner is an owner of its
own; rows equal in id and text share their spans and count once per repository;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import staged

#: The base patterns, in the order that ties in start follow.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
MAX_OWNERS, MAX_REPOS, LIVE_CHARS, LIVE_DISTINCT = 2, 4, 16, 8
PLACEHOLDER = "(?i)example|sample|dummy|change_?me|your|test|xxxx|0000|1234567"

_SPAN = "struct<start:int,kind:int,end:int,value:string>"
KINDS = ("assign", "access", "hex", "opaque")
BLOCK = 64


def _found(text: Column, kind: int, quick: str, pattern: str, value: int) -> Column:
    """All matches as (start, kind, end, value); ``quick`` skips texts that
    can't hold one long enough."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else whole
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc.getField("at") + x.getField("gap")
        end = begin + F.char_length(x.getField("whole"))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        x.getField("part").alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc.getField("out"), span).alias("out"))

    # one gap more than matches; appending copies an array, so the matches of a text are placed in
    # blocks, each from its own start, and the blocks moved to theirs
    both = F.zip_with(whole, part, lambda a, b: F.struct(a.alias("whole"), b.alias("part")))
    rows = F.zip_with(F.slice(gaps, 1, F.size(whole)), both, lambda g, b: F.struct(
        g.alias("gap"), b.getField("whole").alias("whole"), b.getField("part").alias("part")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(BLOCK)),
                         lambda k: F.aggregate(F.slice(rows, k, F.lit(BLOCK)), start, step))
    from_ = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = lambda bs: F.aggregate(bs, from_, lambda acc, b: F.struct(
        (acc.getField("at") + b.getField("at")).alias("at"),
        F.array_append(acc.getField("out"), acc.getField("at")).alias("out")), lambda acc: acc.getField("out"))
    move = lambda b, o: F.transform(b.getField("out"), lambda s: F.struct(
        (s.getField("start") + o).alias("start"), s.getField("kind").alias("kind"), (s.getField("end") + o).alias("end"),
        s.getField("value").alias("value")))
    # a fold over one element binds the blocks, so that they are computed once
    spans = F.when(F.size(whole) > 0, F.flatten(F.aggregate(
        F.array(blocks), F.array().cast(f"array<array<{_SPAN}>>"),
        lambda _, bs: F.zip_with(bs, offsets(bs), move)))).otherwise(none)
    return F.when(F.regexp_like(text, F.lit(quick)), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def candidates(text: Column) -> Column:
    """Base spans and opaque ones outside them, unordered."""
    text = F.coalesce(text, F.lit(""))
    long = lambda n: lambda s: F.char_length(s.getField("value")) >= n
    base = F.concat(
        F.filter(_found(text, 0, ASSIGN, ASSIGN, 2), long(LEAST["assign"])),
        _found(text, 1, r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]{16,}", 0),  # a run shorter than this holds no longer one
        _found(text, 2, r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 0))
    mixed = lambda s: (F.regexp_like(s.getField("value"), F.lit("[0-9]"))
                       & F.regexp_like(s.getField("value"), F.lit("[a-z]"))
                       & F.regexp_like(s.getField("value"), F.lit("[A-Z]")))
    return F.struct(base.alias("base"), F.filter(_found(text, 3, OPAQUE, OPAQUE, 0), mixed).alias("opaque"))


def looks_live(value: Column) -> Column:
    return ((F.char_length(value) >= LIVE_CHARS) & ~F.regexp_like(value, F.lit(PLACEHOLDER))
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)
            & F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]")))


def scan(docs: DataFrame, owner: Column, repository: Column, max_owners: int = MAX_OWNERS,
         max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document: ``doc_id, h, base, spans`` (arrays of start, kind,
    end), ``n_live`` and ``n_example`` (spans by what the corpus says), and
    ``most_repos``, the repositories that share the most spread of its values."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), owner.alias("owner"), repository.alias("repo"),
                       candidates(F.col("text")).alias("c"))
    apart = F.expr("filter(c.opaque, o -> not exists(c.base, b -> b.start < o.end and o.start < b.end))")
    found = staged(rows.select("doc_id", "h", "owner", "repo", F.explode(F.concat("c.base", apart)).alias("s"))
                   .select("doc_id", "h", "owner", "repo", "s.start", "s.kind", "s.end", "s.value",
                           F.sha2("s.value", 256).alias("sha")), "candidates")
    frequency = staged(found.groupBy("sha", "owner", "repo").agg(F.count("*").alias("n"))
                 .groupBy("sha", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
                 .groupBy("sha").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n")), "owners")  # written: a join of two plain shuffles splits hot values
    judged = (found.dropDuplicates(["doc_id", "h", "kind", "start"]).join(frequency, "sha")
              .withColumn("copied", (F.col("owners") > max_owners) | (F.col("repos") > max_repos))
              .withColumn("live", ~F.col("copied") & looks_live(F.col("value")))
              .filter((F.col("kind") < 3) | F.col("live")))
    spans = judged.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum(F.col("copied").cast("long")).alias("n_example"), F.max("repos").alias("most_repos"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = docs.select("doc_id", F.xxhash64("text").alias("h")).join(
        spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    all_spans = F.coalesce("spans", none)
    return out.select("doc_id", "h", F.filter(all_spans, lambda s: s.getField("kind") < 3).alias("base"),
                      all_spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
                      F.coalesce("n_example", F.lit(0)).alias("n_example"),
                      F.coalesce("most_repos", F.lit(0)).alias("most_repos"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s.getField("kind")), s.getField("start"), s.getField("end"))), ",")


def report(docs: DataFrame, owner: Column, repository: Column, **options) -> DataFrame:
    """Digests of ``scan``."""
    found = scan(docs, owner, repository, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s.getField("kind") == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        "n_live", "n_example", "most_repos")


def oracle(max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> str:
    """DuckDB SQL for ``report`` with source as owner and source with language as
    repository, over the table documents."""
    quoted = {k: p.replace("'", "''") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, OPAQUE), strict=True)}
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, source, lang, {i} AS kind, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM (
      SELECT doc_id, source, lang, regexp_extract_all(text, '{quoted[k]}') AS m,
        regexp_extract_all(text, '{quoted[k]}', {2 if k == 'assign' else 0}) AS v,
        string_split_regex(text, '{quoted[k]}') AS g FROM documents WHERE regexp_matches(text, '{quoted[k]}'))"""
        for i, k in enumerate(KINDS))
    mixed = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"
    return f"""
    WITH raw AS ({parts}),
    placed AS MATERIALIZED (SELECT doc_id, source, lang, kind, v[i] AS v,
      (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS s,
      length(m[i]) AS n FROM raw),
    base AS MATERIALIZED (SELECT *, s + n AS e FROM placed WHERE kind = 0 AND length(v) >= {LEAST['assign']}
      OR kind = 1 AND n >= {LEAST['access']} OR kind = 2 AND n >= {LEAST['hex']}),
    opaque AS (SELECT *, s + n AS e FROM placed o WHERE kind = 3 AND {mixed} AND NOT EXISTS (
      SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.s + o.n AND o.s < b.e)),
    found AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM opaque),
    freq AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repos
      FROM found GROUP BY 1),
    judged AS (SELECT *, owners > {max_owners} OR repos > {max_repos} AS copied, NOT copied AND length(v) >= {LIVE_CHARS}
      AND NOT regexp_matches(v, '{PLACEHOLDER}') AND len(list_distinct(string_split(v, ''))) >= {LIVE_DISTINCT}
      AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live FROM found JOIN freq USING (v)),
    named AS (SELECT *, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || e AS t
      FROM judged WHERE kind < 3 OR live),
    per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
      count(*) FILTER (kind = 2) AS n_hex, string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS b,
      string_agg(t, ',' ORDER BY s, kind) AS a, count(*) FILTER (live) AS n_live,
      count(*) FILTER (copied) AS n_example, max(repos) AS most_repos FROM named GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live,
      coalesce(n_example, 0) AS n_example, coalesce(most_repos, 0) AS most_repos
    FROM documents LEFT JOIN per USING (doc_id)"""
