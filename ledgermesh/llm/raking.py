"""Mixing to target weights by iterative proportional fitting (operator 8).

Token counts are summed into cells (source, language, topic). Each round scales
the cell weights in turn to the target share of every source, language and
topic; after ``rounds`` rounds a cell's weight over its tokens is the rate at
which its documents are wanted. A document is drawn ``keep * rate`` times on average: the
whole part of it for certain, and once more with the rest as probability, decided
by a hash of seed, id and text, so the same document always gets the same draw,
whatever the partitioning. Documents of cells wanted more than once are thus
repeated, and the expected shares are the targets and ``keep``.

Targets are given as shares per value, or as an exponent per margin: share
proportional to tokens ** exponent (1: as observed, 0: all values equal).

The cell table has one row per combination that occurs and carries its goals; a
margin's sums are a window over it. A table of at most ``CELLS_IN_A_TASK`` rows
(counted) is fitted by one task without shuffles, a larger one with three shuffles a
round; nothing of it passes through the driver. DataFrame functions only.

Edge cases: null source, language or topic is a value of its own; null or empty
text has no tokens and takes its cell's rate (0 for a cell without tokens);
repeated rows get equal draws; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.llm.common import staged

#: Exponents of the production mix: flatten sources and topics, languages less.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS, KEEP, SEED = 10, 0.7, "mix-1"
ROUNDS_A_PLAN, CELLS_IN_A_TASK = 5, 20_000

TOKEN = r"[^\x20\x09-\x0D]+"
#: Topic rules, the first that matches; SQL regular expressions.
TOPICS = (("secrets", r"[0-9a-f]{24}"), ("contacts", r"@[a-z0-9]+\.|555-[0-9]"), ("tables", r" \| "),
          ("numbers", r"[0-9]{8}|[0-9]+\.[0-9]+\.[0-9]+"))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def topic(text: Column) -> Column:
    out = F.when(text.isNull(), F.lit("other"))
    for name, pattern in TOPICS:
        out = out.when(F.regexp_like(text, F.lit(pattern)), F.lit(name))
    return out.otherwise(F.lit("prose"))


def rates(cells: DataFrame, exponents: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the margins' columns and ``tokens``) with ``rate``, the fitted
    weight of the cell over its tokens, 1 on average."""
    now = cells.filter("tokens > 0").select(*exponents, "tokens", F.col("tokens").cast("double").alias("w"))
    for name, power in exponents.items():
        share = now.groupBy(F.col(name).alias("__v")).agg(F.sum("tokens").cast("double").alias("t")).withColumn(
            "g", F.pow("t", F.lit(power)))
        total = share.agg(F.sum("t").alias("all"), F.sum("g").alias("gs"))
        goal = share.crossJoin(total).select(  # one row of totals
            "__v", (F.col("g") / F.col("gs") * F.col("all")).alias(f"__goal_{name}"))
        now = staged(now.join(goal, F.col(name).eqNullSafe(F.col("__v"))).drop("__v"), "cells")
    few = now.count() <= CELLS_IN_A_TASK
    for k in range(rounds):
        if few and k % ROUNDS_A_PLAN == 0:
            now = now.coalesce(1)  # the windows of a plan need no shuffle then
        for name in exponents:
            have = F.sum("w").over(Window.partitionBy(name))
            now = now.withColumn("w", F.col("w") * (F.col(f"__goal_{name}") / have))
        if k % ROUNDS_A_PLAN == ROUNDS_A_PLAN - 1 or k == rounds - 1:
            now = staged(now, "cells")
    return now.select(*exponents, "tokens", (F.col("w") / F.col("tokens")).alias("rate"))


def _draw(seed: str) -> Column:
    """Per million, even over documents."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                               F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(1_000_000))


def _placed(docs: DataFrame, seed: str) -> DataFrame:
    return docs.withColumns({"__topic": topic(F.col("text")), "__n": n_tokens(F.col("text")), "__u": _draw(seed)})


def _chance(table: DataFrame, fitted: DataFrame, keep: float, names: dict[str, str]) -> DataFrame:
    """``table`` with ``__p``, the expected copies of its cell per million, and
    ``__copies``, those that the draw gives: the number of v = 0, 1, ... with
    u + v million < p."""
    cells = fitted.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(names)], F.col("rate").alias("__rate"))
    same = None
    for i, column in enumerate(names.values()):
        part = F.col(column).eqNullSafe(F.col(f"__c{i}"))
        same = part if same is None else same & part
    p = F.coalesce("__rate", F.lit(0.0)) * keep
    return table.join(cells, same, "left").withColumn("__p", F.floor(p * 1_000_000 + 0.5)).withColumn(
        "__copies", F.floor((F.col("__p") - F.col("__u") + 999_999) / 1_000_000).cast("long"))


def sample(docs: DataFrame, exponents: dict[str, float] | None = None, rounds: int = ROUNDS, keep: float = KEEP,
           seed: str = SEED) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, rate_ppm, copies`` of every document."""
    exponents = exponents or EXPONENTS
    slim = staged(_placed(docs.select("doc_id", "text", "source", "lang"), seed).select(
        "doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__n").alias("n_tokens"), "__u"), "mix")
    cells = slim.groupBy(*exponents).agg(F.sum("n_tokens").alias("tokens"))
    out = _chance(slim, rates(cells, exponents, rounds), keep, {k: k for k in exponents})
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.col("__p").alias("rate_ppm"),
                      F.col("__copies").alias("copies"))


def mix_documents(docs: DataFrame, exponents: dict[str, float] | None = None, rounds: int = ROUNDS,
                  keep: float = KEEP, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs``, each as often as it was drawn; columns stay as
    they are."""
    exponents = exponents or EXPONENTS
    names = {k: "__topic" if k == "topic" else k for k in exponents}
    placed = _placed(docs, seed)
    cells = placed.groupBy(*[F.col(v).alias(k) for k, v in names.items()]).agg(F.sum("__n").alias("tokens"))
    out = _chance(placed, rates(cells, exponents, rounds), keep, names).filter("__copies > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(exponents: dict[str, float] | None = None, rounds: int = ROUNDS, keep: float = KEEP, seed: str = SEED) -> str:
    """DuckDB SQL for ``sample`` over the table documents."""
    exponents = exponents or EXPONENTS
    rules = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps = [f"""slim AS MATERIALIZED (SELECT doc_id, source, lang,
      CASE WHEN text IS NULL THEN 'other' {rules} ELSE 'prose' END AS topic,
      len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS n_tokens,
      ('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 12))::BIGINT
        % 1000000 AS u FROM documents)""",
             f"""c0 AS MATERIALIZED (SELECT {', '.join(exponents)}, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS w
      FROM slim GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for name, power in exponents.items():
        steps.append(f"""g_{name} AS MATERIALIZED (SELECT v, pow(t, {power}) / sum(pow(t, {power})) OVER () * sum(t) OVER () AS goal
      FROM (SELECT {name} AS v, sum(tokens) AS t FROM c0 GROUP BY 1))""")
    k = 0
    for _ in range(rounds):
        for name in exponents:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT {', '.join(f'c.{x}' for x in exponents)}, tokens,
      w * (goal / sum(w) OVER (PARTITION BY c.{name})) AS w
      FROM c{k} c JOIN g_{name} ON c.{name} IS NOT DISTINCT FROM v)""")
            k += 1
    same = " AND ".join(f"s.{x} IS NOT DISTINCT FROM c.{x}" for x in exponents)
    return f"""WITH {', '.join(steps)}
    SELECT doc_id, s.source, s.lang, s.topic, n_tokens, p AS rate_ppm,
      CASE WHEN u < p THEN (p - u + 999999) // 1000000 ELSE 0 END AS copies FROM (
      SELECT s.*, floor(coalesce(w / tokens, 0) * {keep} * 1000000 + 0.5)::BIGINT AS p
      FROM slim s LEFT JOIN c{k} c ON {same}) s"""
