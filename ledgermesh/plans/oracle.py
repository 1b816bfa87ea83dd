"""DuckDB SQL for the correctness gate.

These strings are an independent statement of each query in plain SQL over
the same parquet tables, used only to check the Spark plans. They are written
for clarity (window functions, recursion), not speed.
"""

from __future__ import annotations

from ledgermesh.config import MatchRules, format_f64

F1_CTE = """
f1_o AS (SELECT o_orderkey k, CAST(o_totalprice AS DECIMAL(22,6)) p, o_orderdate d FROM orders),
f1 AS (
  SELECT concat('ORD-', CAST(k AS VARCHAR)) transaction_ref, 'erp_system' source_system,
         concat('erp-', CAST(k AS VARCHAR)) internal_id, CAST(p AS DECIMAL(22,6)) amount, 'USD' currency,
         CAST(d AS TIMESTAMP) server_received_at FROM f1_o
  UNION ALL
  SELECT concat('ORD-', CAST(k AS VARCHAR)), 'vendor_portal', concat('ven-', CAST(k AS VARCHAR)),
         CAST(CASE WHEN k % 7 = 0 THEN p + CAST(0.03 AS DECIMAL(22,6))
                   WHEN k % 7 = 1 THEN p + CAST(250 AS DECIMAL(22,6)) ELSE p END AS DECIMAL(22,6)),
         CASE WHEN k % 97 = 0 THEN 'EUR' ELSE 'USD' END, d + INTERVAL 60 SECOND FROM f1_o WHERE k % 10 <> 9
  UNION ALL
  SELECT concat('ORD-', CAST(k AS VARCHAR)), 'vendor_portal', concat('ven0-', CAST(k AS VARCHAR)),
         CAST(p + CAST(999 AS DECIMAL(22,6)) AS DECIMAL(22,6)), 'USD', d + INTERVAL 30 SECOND
  FROM f1_o WHERE k % 13 = 0 AND k % 10 <> 9
  UNION ALL
  SELECT concat('ORD-', CAST(k AS VARCHAR)), 'payment_gateway', concat('pay-', CAST(k AS VARCHAR)),
         CAST(CASE WHEN k % 11 = 0 THEN p - CAST(99.99 AS DECIMAL(22,6)) ELSE p END AS DECIMAL(22,6)),
         'USD', d + INTERVAL 120 SECOND FROM f1_o WHERE k % 10 IN (0, 1, 2, 3, 4, 5)
)"""


def f3_cte(null_every: int | None = None) -> str:
    amount = "CAST(value AS DECIMAL(22,6))"
    if null_every:
        amount = f"CASE WHEN event_id % {null_every} = 0 THEN NULL ELSE {amount} END"
    return f"""
f3 AS (
  SELECT concat('U-', CAST(user_id AS VARCHAR)) transaction_ref, event_type source_system,
         concat('ev-', CAST(event_id AS VARCHAR)) internal_id, {amount} amount, 'USD' currency,
         CAST(ts AS TIMESTAMP) server_received_at FROM events
)"""


def ts_lit(as_of) -> str:
    return f"TIMESTAMP '{as_of.isoformat(sep=' ')}'"


def within_sql(a: str, b: str, rules: MatchRules) -> str:
    return (f"(abs({a} - {b}) <= greatest(CAST('{rules.abs_text}' AS DECIMAL(22,6)), "
            f"greatest(abs({a}), abs({b})) * CAST('{rules.pct_factor}' AS DECIMAL(13,10))))")


def latest_sql(src: str, x: str = "") -> str:
    """WN-1 as a window query, plus the group order ``pos``."""
    return f"""
latest{x} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT transaction_ref, source_system, internal_id, amount, currency, server_received_at,
           row_number() OVER (PARTITION BY transaction_ref, source_system
                              ORDER BY server_received_at DESC, internal_id DESC) rn,
           count(*) OVER (PARTITION BY transaction_ref, source_system) n_records,
           min(server_received_at) OVER (PARTITION BY transaction_ref, source_system) first_seen_src
    FROM {src}) WHERE rn = 1),
ord{x} AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_ref ORDER BY server_received_at, source_system) pos
  FROM latest{x})"""


def decisions_sql(rules: MatchRules, as_of, x: str = "") -> str:
    """CTEs ``g`` (per-ref gates) and ``flags`` (per-source flags) after ``ord``.

    Strategy ``exact``/``tolerance`` only; majority has its own recursion.
    """
    exp = ", ".join(f"'{s}'" for s in rules.expected_sources)
    exp_list = f"[{exp}]::VARCHAR[]" if exp else "[]::VARCHAR[]"
    if rules.pending_timeout_secs is None:
        timed = "false"
    else:
        timed = f"age_secs >= {int(rules.pending_timeout_secs)}"
    if rules.strategy == "exact":
        bad = "coalesce(o.amount <> g.ref_amount, false)"
    else:
        bad = f"coalesce(NOT {within_sql('o.amount', 'g.ref_amount', rules)}, false)"
    return f"""
agg{x} AS (
  SELECT transaction_ref, sum(n_records) record_count, count(*) source_count,
         min(first_seen_src) first_seen_at,
         arg_min(amount, pos) FILTER (WHERE amount IS NOT NULL) ref_amount,
         arg_min(currency, pos) FILTER (WHERE currency IS NOT NULL) first_currency,
         count(DISTINCT currency) > 1 cur_mismatch,
         list(source_system ORDER BY pos) present
  FROM ord{x} GROUP BY transaction_ref),
g0{x} AS (
  SELECT *, CAST(greatest(0, floor(epoch({ts_lit(as_of)}) - epoch(first_seen_at))) AS BIGINT) age_secs,
         list_filter({exp_list}, lambda e: NOT list_contains(present, e)) missing
  FROM agg{x}),
g{x} AS (
  SELECT *, CASE
      WHEN len(missing) > 0 THEN CASE WHEN {timed} THEN 'missing_timeout' ELSE 'missing_wait' END
      WHEN source_count < 2 THEN CASE WHEN {timed} THEN 'single_timeout' ELSE 'single_wait' END
      WHEN cur_mismatch THEN 'currency' ELSE 'compare' END gate
  FROM g0{x}),
flags{x} AS (
  SELECT o.transaction_ref, o.source_system, o.internal_id, o.amount, o.currency, o.pos, g.gate,
         g.ref_amount, g.first_currency,
         (o.currency IS NOT NULL AND o.currency <> g.first_currency) cur_bad,
         CASE g.gate WHEN 'currency' THEN true WHEN 'compare' THEN {bad} ELSE false END flagged
  FROM ord{x} o JOIN g{x} g USING (transaction_ref))"""


def status_sql(rules: MatchRules, x: str = "") -> str:
    """CTE ``dec``: status, reason and source lists per ref."""
    exp = ", ".join(f'"{s}"' for s in rules.expected_sources)
    if rules.strategy == "exact":
        cmp_reason = "'exact match strategy: amounts differ'"
    else:
        cmp_reason = ("'tolerance strategy: amounts deviate beyond abs=%s / pct=%s%%'"
                      % (rules.abs_text, format_f64(rules.pct_tolerance)))
    return f"""
fl{x} AS (
  SELECT transaction_ref, bool_or(flagged) any_flag,
         string_agg(CASE WHEN cur_bad THEN source_system || '=' || currency END, ', ' ORDER BY pos) cur_list,
         string_agg(source_system, ',' ORDER BY source_system) all_sorted,
         string_agg(CASE WHEN flagged THEN source_system END, ',' ORDER BY source_system) flagged_sorted
  FROM flags{x} GROUP BY transaction_ref),
dec{x} AS (
  SELECT g.transaction_ref, g.record_count, g.source_count, g.gate,
    CASE WHEN g.gate IN ('missing_wait', 'single_wait') THEN 'PENDING'
         WHEN g.gate IN ('missing_timeout', 'single_timeout', 'currency') THEN 'MISMATCHED'
         WHEN fl.any_flag THEN 'MISMATCHED' ELSE 'MATCHED' END status,
    CASE WHEN g.gate = 'missing_timeout' THEN printf('pending timeout after %ds — missing sources: %s',
                                                     g.age_secs, array_to_string(g.missing, ', '))
         WHEN g.gate = 'missing_wait' THEN 'waiting for sources: [{exp}]; present: ['
              || array_to_string(list_transform(g.present, lambda x: '"' || x || '"'), ', ') || ']'
         WHEN g.gate = 'single_timeout' THEN printf('only 1 source present after %ds timeout (minimum 2 required)', g.age_secs)
         WHEN g.gate = 'single_wait' THEN 'only 1 source present; waiting for at least one more'
         WHEN g.gate = 'currency' THEN 'currency mismatch: expected ''' || g.first_currency
              || ''' (from first source), got: ' || fl.cur_list
         WHEN fl.any_flag THEN {cmp_reason} END reason,
    g.ref_amount, g.first_currency, fl.all_sorted, fl.flagged_sorted
  FROM g{x} g JOIN fl{x} fl USING (transaction_ref))"""


def state_report_sql(src_cte: str, src: str, rules: MatchRules, as_of) -> str:
    return f"""WITH {src_cte},
{latest_sql(src)},
{decisions_sql(rules, as_of)},
{status_sql(rules)}
SELECT transaction_ref, status, reason, CAST(record_count AS BIGINT) record_count,
       CAST(source_count AS INTEGER) source_count,
       CASE WHEN status = 'MATCHED' THEN all_sorted ELSE '' END matched_sources,
       CASE WHEN status = 'MISMATCHED' THEN coalesce(flagged_sorted, '') ELSE '' END mismatched_sources,
       CASE WHEN status = 'MATCHED' THEN ref_amount END reference_amount,
       CASE WHEN status = 'MATCHED' AND ref_amount IS NOT NULL THEN first_currency END currency
FROM dec"""


def details_report_sql(src_cte: str, src: str, rules: MatchRules, as_of) -> str:
    if rules.strategy == "exact":
        det = """'{"actual":' || to_json(CAST(f.amount AS VARCHAR)) || ',"diff":'
                 || to_json(CAST(CAST(abs(f.amount - f.ref_amount) AS DECIMAL(22,6)) AS VARCHAR))
                 || ',"reference":' || to_json(CAST(f.ref_amount AS VARCHAR)) || ',"strategy":"exact"}'"""
    else:
        det = f"""'{{"absolute_tolerance":"{rules.abs_text}","actual":' || to_json(CAST(f.amount AS VARCHAR))
                 || ',"diff":' || to_json(CAST(CAST(abs(f.amount - f.ref_amount) AS DECIMAL(22,6)) AS VARCHAR))
                 || ',"pct_tolerance":{repr(float(rules.pct_tolerance))},"reference":'
                 || to_json(CAST(f.ref_amount AS VARCHAR)) || ',"strategy":"tolerance"}}'"""
    return f"""WITH {src_cte},
{latest_sql(src)},
{decisions_sql(rules, as_of)},
{status_sql(rules)}
SELECT f.transaction_ref, f.source_system system_name, f.internal_id, f.amount, f.currency,
       f.flagged discrepancy_found,
       CASE WHEN NOT f.flagged THEN NULL
            WHEN f.gate = 'currency' THEN '{{"currency_mismatch":' || to_json('expected ''' || f.first_currency
                 || ''' (from first source), got: ' || d.cur_list) || '}}'
            ELSE {det} END discrepancy_details
FROM flags f JOIN (SELECT transaction_ref, status, fl.cur_list FROM dec JOIN fl USING (transaction_ref)) d
  USING (transaction_ref)
WHERE d.status <> 'PENDING'"""


def majority_details_sql(src_cte: str, src: str, rules: MatchRules) -> str:
    """MT-10 by peeling: the first unassigned record opens a bucket and takes
    every unassigned record within tolerance of it; NULL takes only itself."""
    hit = ("(u.pos = r[1].pos OR (u.amount IS NOT NULL AND r[1].amount IS NOT NULL AND "
           + within_sql("u.amount", "r[1].amount", rules) + "))")
    return f"""WITH RECURSIVE {src_cte},
{latest_sql(src)},
peel(transaction_ref, step, r, out) AS (
  SELECT transaction_ref, 0, list({{'pos': pos, 'amount': amount}} ORDER BY pos),
         []::STRUCT(pos BIGINT, bucket INTEGER)[]
  FROM ord GROUP BY transaction_ref
  UNION ALL
  SELECT transaction_ref, step + 1,
         list_filter(r, lambda u: NOT {hit}),
         list_concat(out, list_transform(list_filter(r, lambda u: {hit}),
                                         lambda u: {{'pos': u.pos, 'bucket': step}}))
  FROM peel WHERE len(r) > 0
),
final AS (SELECT transaction_ref, out FROM peel WHERE len(r) = 0),
asg AS (SELECT transaction_ref, b.pos, b.bucket FROM final, unnest(out) t(b)),
sized AS (SELECT a.*, count(*) OVER (PARTITION BY transaction_ref, bucket) bsize FROM asg a),
mx AS (SELECT transaction_ref, max(bsize) max_size FROM sized GROUP BY transaction_ref),
j AS (
  SELECT o.*, s.bucket, s.bsize, m.max_size, s.bsize = m.max_size win
  FROM ord o JOIN sized s ON o.transaction_ref = s.transaction_ref AND o.pos = s.pos
  JOIN mx m ON m.transaction_ref = o.transaction_ref),
maj AS (SELECT transaction_ref, arg_min(amount, pos) FILTER (WHERE win) majority_amount FROM j GROUP BY 1)
SELECT j.transaction_ref, j.source_system system_name, j.internal_id, j.amount,
       NOT j.win discrepancy_found,
       CASE WHEN j.win THEN NULL ELSE
         '{{"actual":' || coalesce(to_json(CAST(j.amount AS VARCHAR)), 'null') || ',"bucket_size":'
         || CAST(j.bsize AS VARCHAR) || ',"majority_amount":'
         || coalesce(to_json(CAST(maj.majority_amount AS VARCHAR)), 'null')
         || ',"strategy":"majority","winning_bucket_size":' || CAST(j.max_size AS VARCHAR) || '}}' END
         discrepancy_details
FROM j JOIN maj USING (transaction_ref)"""


F2_CTE = r"""
f2_o AS (
  SELECT o_orderkey k, o_totalprice tp, o_orderdate d,
    CASE WHEN o_orderkey % 101 = 0 THEN 'nokey' WHEN o_orderkey % 103 = 0 THEN 'noref'
         WHEN o_orderkey % 109 = 0 THEN 'nosrc' WHEN o_orderkey % 107 = 0 THEN 'bell'
         WHEN o_orderkey % 113 = 0 THEN 'notjson' WHEN o_orderkey % 127 = 0 THEN 'num'
         WHEN o_orderkey % 131 = 0 THEN 'comma' WHEN o_orderkey % 137 = 0 THEN 'neg'
         WHEN o_orderkey % 139 = 0 THEN 'xxx' WHEN o_orderkey % 149 = 0 THEN 'noamt'
         WHEN o_orderkey % 151 = 0 THEN 'yday' WHEN o_orderkey % 157 = 0 THEN 'future' ELSE 'ok' END rule
  FROM orders),
f2_b AS (
  SELECT k, d,
    CASE WHEN rule = 'nokey' THEN '' ELSE 'key-' || CAST(k AS VARCHAR) END idempotency_key,
    CASE WHEN rule = 'noref' THEN '' WHEN rule = 'bell' THEN 'ORD-' || CAST(k AS VARCHAR) || chr(7)
         ELSE 'ORD-' || CAST(k AS VARCHAR) END transaction_ref,
    CASE WHEN rule = 'nosrc' THEN '' ELSE ['erp_system', 'vendor_portal', 'payment_gateway'][(k % 3) + 1] END
      source_system,
    CASE WHEN k % 2 = 0 THEN 'file' ELSE 'webhook' END adapter_type,
    CASE WHEN rule = 'notjson' THEN 'not json' ELSE '{' ||
      CASE rule WHEN 'num' THEN '"amount":' || CAST(CAST(tp AS DECIMAL(12,2)) AS VARCHAR) || ','
                WHEN 'comma' THEN '"amount":"12,50",' WHEN 'neg' THEN '"amount":"-5.00",'
                WHEN 'noamt' THEN '' ELSE '"amount":"' || CAST(CAST(tp AS DECIMAL(12,2)) AS VARCHAR) || '",' END ||
      CASE WHEN rule = 'xxx' THEN '"currency":"XXX",' ELSE '"currency":" usd ",' END ||
      CASE rule WHEN 'yday' THEN '"event_time":"yesterday",'
                WHEN 'future' THEN '"event_time":"2999-01-01T00:00:00Z",'
                ELSE '"event_time":"2024-01-15T10:30:00Z",' END ||
      '"schema":"invoice.v1.json","extra":{"region":"IN"}}' END payload_text
  FROM f2_o),
f2 AS (
  SELECT k * 10 row_id, idempotency_key, transaction_ref, source_system, adapter_type, payload_text,
         CAST(d AS TIMESTAMP) server_received_at FROM f2_b
  UNION ALL
  SELECT k * 10 + 1, idempotency_key, transaction_ref, source_system, adapter_type,
         CASE WHEN k % 7 = 0 THEN replace(payload_text, 'invoice.v1', 'invoice.v2') ELSE payload_text END, d + INTERVAL 3600 SECOND FROM f2_b WHERE k % 19 = 0
  UNION ALL
  SELECT k * 10 + 2, idempotency_key, transaction_ref, source_system, adapter_type,
         CASE WHEN k % 7 = 0 THEN replace(payload_text, 'invoice.v1', 'invoice.v2') ELSE payload_text END, d + INTERVAL 90000 SECOND FROM f2_b WHERE k % 17 = 0
)"""


F2_VARIANTS = r""",
f2v AS (
  SELECT * REPLACE (
    CASE WHEN row_id // 10 % 3 = 1 THEN '' ELSE transaction_ref END AS transaction_ref,
    CASE WHEN row_id // 10 % 5 = 0 THEN ''
         WHEN row_id // 10 % 3 = 1 THEN regexp_replace(payload_text, '^\{',
           '{"transaction_ref":"PAY-' || CAST(row_id // 10 AS VARCHAR) || '",')
         ELSE replace(payload_text, '"extra":{"region":"IN"}', '"extra":{"adapter_type":"other","region":"IN"}')
    END AS payload_text) FROM f2)"""


def pipeline_sql(as_of, ttl_secs: int = 86400, src: str = "f2", max_payload: int = 33554432) -> str:
    """CTEs ``pv`` (every row with its first error) and ``lab`` (idempotency label)."""
    return F2_CTE + (F2_VARIANTS if src == "f2v" else "") + rf""",
p0 AS (
  SELECT v.* REPLACE (coalesce(nullif(v.transaction_ref, ''),
      CASE WHEN json_valid(payload_text) AND json_type(payload_text) = 'OBJECT'
           THEN nullif(json_extract_string(payload_text, '$.transaction_ref'), '') END, '') AS transaction_ref),
    CASE WHEN json_valid(payload_text) THEN json_type(payload_text) = 'OBJECT' ELSE false END is_obj,
         length(payload_text) > 0 non_empty
  FROM {src} v),
p1 AS (
  SELECT *,
    CASE WHEN is_obj THEN nullif(json_extract_string(payload_text, '$.amount'), '') END amount_text,
    CASE WHEN is_obj THEN upper(trim(nullif(json_extract_string(payload_text, '$.currency'), ''))) END currency,
    CASE WHEN is_obj THEN nullif(json_extract_string(payload_text, '$.event_time'), '') END ev_txt,
    CASE WHEN is_obj THEN nullif(json_extract_string(payload_text, '$.schema'), '') END payload_schema,
    CASE WHEN is_obj THEN json_extract_string(payload_text, '$.extra.region') END extra_region
  FROM p0),
p2 AS (
  SELECT *,
    coalesce(try_strptime(ev_txt, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(ev_txt, '%Y-%m-%dT%H:%M:%S.%fZ'),
             try_strptime(ev_txt, '%Y-%m-%dT%H:%M:%S'), try_strptime(ev_txt, '%Y-%m-%d %H:%M:%S')) record_timestamp,
    CASE WHEN amount_text IS NULL THEN NULL
         WHEN NOT regexp_full_match(amount_text, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
           THEN 'invalid_amount'
         WHEN try_cast(amount_text AS DECIMAL(22,6)) IS NULL
           OR CAST(try_cast(amount_text AS DECIMAL(22,6)) AS DECIMAL(38,12)) <> try_cast(amount_text AS DECIMAL(38,12))
           THEN 'amount_precision' END amount_err,
    try_cast(amount_text AS DECIMAL(22,6)) amount0
  FROM p1),
pv AS (
  SELECT *,
    CASE WHEN amount_err IS NULL THEN amount0 END amount,
    CASE WHEN idempotency_key = '' OR transaction_ref = '' OR source_system = '' THEN 'missing_field'
         WHEN NOT regexp_full_match(transaction_ref, '[\x20-\x7E]+') THEN 'invalid_format'
         WHEN octet_length(encode(payload_text)) > {max_payload} THEN 'payload_too_large'
         WHEN amount_err IS NOT NULL THEN amount_err
         WHEN currency IS NOT NULL AND currency <> ''
              AND currency NOT IN ('INR','USD','EUR','GBP','JPY','AUD','CAD','CHF','CNY','SGD','AED','MYR')
           THEN 'invalid_currency'
         WHEN record_timestamp > {ts_lit(as_of)} + INTERVAL 300 SECOND THEN 'future_timestamp'
         WHEN amount0 < 0 AND amount_err IS NULL THEN 'negative_amount' END error_reason
  FROM p2),
pv2 AS (
  SELECT *, error_reason IS NULL ok,
    CASE WHEN error_reason IS NULL THEN NULL
         WHEN idempotency_key = '' OR transaction_ref = '' OR source_system = ''
           OR NOT regexp_full_match(transaction_ref, '[\x20-\x7E]+') THEN 'validate'
         WHEN error_reason IN ('invalid_amount', 'amount_precision') THEN 'normalize' ELSE 'validate' END error_stage,
    array_to_string(list_sort(list_filter([
        'adapter_type=' || adapter_type,
        CASE WHEN non_empty AND NOT is_obj THEN 'parse_warning=non_json_payload' END,
        CASE WHEN ev_txt IS NOT NULL AND record_timestamp IS NULL THEN 'raw_event_time=' || ev_txt END,
        CASE WHEN extra_region IS NOT NULL THEN 'region=' || extra_region END], lambda x: x IS NOT NULL)), ';') tags_text,
    concat_ws('-', substr(sha256(idempotency_key), 1, 8), substr(sha256(idempotency_key), 9, 4),
              substr(sha256(idempotency_key), 13, 4), substr(sha256(idempotency_key), 17, 4),
              substr(sha256(idempotency_key), 21, 12)) internal_id
  FROM pv),
firsts AS (
  SELECT idempotency_key, arg_min(server_received_at, (server_received_at, row_id)) first_ts,
         arg_min(row_id, (server_received_at, row_id)) first_row, arg_min(internal_id, (server_received_at, row_id)) stored_internal_id
  FROM pv2 WHERE ok GROUP BY idempotency_key),
lab AS (
  SELECT v.*, f.stored_internal_id,
    CASE WHEN f.first_ts IS NULL THEN 'failed'
         WHEN v.server_received_at = f.first_ts AND v.row_id = f.first_row THEN 'stored'
         WHEN v.server_received_at < f.first_ts OR (v.server_received_at = f.first_ts AND v.row_id < f.first_row) THEN 'failed'
         WHEN v.server_received_at < f.first_ts + INTERVAL {int(ttl_secs)} SECOND THEN 'duplicate'
         WHEN v.ok THEN 'ignored_after_ttl' ELSE 'failed' END idem_label
  FROM pv2 v LEFT JOIN firsts f USING (idempotency_key))"""


def _state_rows(dec: str, as_of, x: str) -> str:
    return f"""
d{x} AS (
  SELECT transaction_ref, status, CAST(record_count AS BIGINT) record_count,
         CASE WHEN status = 'MATCHED' THEN all_sorted ELSE '' END matched_sources,
         CASE WHEN status = 'MISMATCHED' THEN coalesce(flagged_sorted, '') ELSE '' END mismatched_sources
  FROM {dec})"""


def _upsert(base: str, delta: str, as_of, out: str, max_retries: int = 3) -> str:
    now = ts_lit(as_of)
    return f"""
{out} AS (
  SELECT coalesce(b.transaction_ref, d.transaction_ref) transaction_ref,
    CASE WHEN d.status IS NOT NULL THEN d.status ELSE b.status END status,
    CASE WHEN d.status IS NOT NULL THEN d.record_count ELSE b.record_count END record_count,
    CASE WHEN d.status IS NOT NULL THEN d.matched_sources ELSE b.matched_sources END matched_sources,
    CASE WHEN d.status IS NOT NULL THEN d.mismatched_sources ELSE b.mismatched_sources END mismatched_sources,
    CAST(CASE WHEN d.status IS NOT NULL THEN CASE WHEN b.status IS NOT NULL THEN b.retry_count + 1 ELSE 1 END
         ELSE b.retry_count END AS INTEGER) retry_count,
    CAST(coalesce(b.max_retries, {max_retries}) AS INTEGER) max_retries,
    CASE WHEN d.status IS NOT NULL THEN {now} ELSE b.last_processed_at END last_processed_at,
    CASE WHEN d.status IN ('MATCHED', 'RESOLVED') THEN {now} ELSE b.resolved_at END resolved_at,
    coalesce(b.created_at, {now}) created_at
  FROM {base} b FULL OUTER JOIN {delta} d ON b.transaction_ref = d.transaction_ref)"""


def two_pass_sql(rules: MatchRules, as1, as2, backoff: int = 30) -> str:
    """CTEs through ``s2`` (state after pass 2), ``due2`` and ``s1``."""
    empty = f"""
s0 AS (SELECT NULL::VARCHAR transaction_ref, NULL::VARCHAR status, NULL::BIGINT record_count,
        NULL::VARCHAR matched_sources, NULL::VARCHAR mismatched_sources, NULL::INTEGER retry_count,
        NULL::INTEGER max_retries, NULL::TIMESTAMP last_processed_at, NULL::TIMESTAMP resolved_at,
        NULL::TIMESTAMP created_at WHERE false)"""
    return f"""WITH {F1_CTE},
r1 AS (SELECT * FROM f1 WHERE NOT (
        (source_system <> 'erp_system' AND CAST(substr(transaction_ref, 5) AS BIGINT) % 4 = 0)
     OR (source_system = 'payment_gateway' AND CAST(substr(transaction_ref, 5) AS BIGINT) % 4 = 1))),
{latest_sql('r1', '1')},
{decisions_sql(rules, as1, '1')},
{status_sql(rules, '1')},
{_state_rows('dec1', as1, '1')},
{empty},
{_upsert('s0', 'd1', as1, 's1', rules.max_retries)},
due2 AS (
  SELECT DISTINCT f.transaction_ref FROM f1 f LEFT JOIN s1 ON f.transaction_ref = s1.transaction_ref
  WHERE s1.transaction_ref IS NULL OR (s1.status = 'PENDING' AND s1.retry_count < s1.max_retries
        AND (s1.last_processed_at IS NULL OR s1.last_processed_at < {ts_lit(as2)} - INTERVAL {backoff} SECOND))),
r2 AS (SELECT * FROM f1 WHERE transaction_ref IN (SELECT transaction_ref FROM due2)),
{latest_sql('r2', '2')},
{decisions_sql(rules, as2, '2')},
{status_sql(rules, '2')},
{_state_rows('dec2', as2, '2')},
{_upsert('s1', 'd2', as2, 's2', rules.max_retries)}"""


def f4_sql(rules: MatchRules, as_of) -> str:
    """CTEs: state chain over f1 (suffix 4) and the F4 retry queue ``q4``."""
    now = ts_lit(as_of)
    return f"""{latest_sql('f1', '4')},
{decisions_sql(rules, as_of, '4')},
{status_sql(rules, '4')},
q4 AS (
  SELECT transaction_ref, CAST(k % 6 AS INTEGER) attempt_count, 5 max_attempts, NULL::TIMESTAMP last_attempted_at,
         {now} + to_minutes(CAST(k % 7 - 3 AS BIGINT)) next_retry_at,
         CASE k % 9 WHEN 0 THEN 'EXHAUSTED' WHEN 1 THEN 'RESOLVED' ELSE 'PENDING' END status
  FROM (SELECT transaction_ref, CAST(substr(transaction_ref, 5) AS BIGINT) k FROM dec4 WHERE status = 'MISMATCHED'))"""


FIX_CTE = """
fix AS (
  SELECT concat('ORD-', CAST(o_orderkey AS VARCHAR)) transaction_ref, 'vendor_portal' source_system,
         concat('venfix-', CAST(o_orderkey AS VARCHAR)) internal_id, CAST(o_totalprice AS DECIMAL(22,6)) amount,
         'USD' currency, o_orderdate + INTERVAL 600 SECOND server_received_at
  FROM orders WHERE o_orderkey % 7 = 1 AND o_orderkey % 10 <> 9 AND o_orderkey % 2 = 0),
f1x AS (SELECT * FROM f1 UNION ALL SELECT * FROM fix)"""
