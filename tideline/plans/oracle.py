"""SQL text of the input views for the checking engine, and a helper that prepends what a query needs."""

from __future__ import annotations

import re

K = "CAST(json_extract_string(props,'$.k') AS INT)"

WS = r"[\s\x{00A0}\x{3000}\x{FEFF}]"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def sql_fixed(c: str, digits: int) -> str:
    """A number with so many decimals, halves of its shortest decimal form rounded away from zero."""
    return f"CAST(CAST(round(CAST(CAST(abs({c}) AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS DECIMAL(38, {digits})) AS VARCHAR)"


def sql_signed_pct(c: str, digits: int) -> str:
    return f"CASE WHEN {c} IS NULL THEN '—' ELSE concat(CASE WHEN {c} < 0 THEN '-' ELSE '+' END, {sql_fixed(c, digits)}, '%') END"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_number(c: str) -> str:
    """NULL for blank and unparsable cells."""
    bare = f"regexp_replace(replace({sql_trim(c)}, ',', ''), '^\\+', '')"
    return f"CASE WHEN regexp_matches({bare}, '{DECIMAL}') THEN TRY_CAST({bare} AS DOUBLE) END"


def sql_status(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR regexp_matches({sql_trim(c)}, '^(-*|N/A|n/a)$') THEN 'blank' "
        f"WHEN ({sql_number(c)}) IS NULL THEN 'unparsable' ELSE 'parsed' END"
    )


def sql_roc(c: str) -> str:
    """Minguo compact text to a date."""
    y = f"CAST(TRY_CAST(regexp_extract({c}, '^([0-9]{{2,3}})[0-9]{{4}}$', 1) AS INT) + 1911 AS STRING)"
    md = f"regexp_extract({c}, '^[0-9]{{2,3}}([0-9]{{4}})$', 1)"
    return f"CASE WHEN regexp_matches({c}, '^[0-9]{{6,7}}$') THEN CAST(TRY_STRPTIME(concat({y}, {md}), '%Y%m%d') AS DATE) END"


def sql_ad(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]{{8}}$') THEN CAST(TRY_STRPTIME({c}, '%Y%m%d') AS DATE) END"


def sql_bound(c: str, side: int) -> str:
    p = f"trim(regexp_split_to_array({c}, '[～~]')[{side + 1}])"
    parts = f"string_split({p}, '/')"
    iso = f"concat(CAST(TRY_CAST({parts}[1] AS INT) + 1911 AS STRING), '-', lpad({parts}[2], 2, '0'), '-', lpad({parts}[3], 2, '0'))"
    return (
        f"CASE WHEN len(regexp_split_to_array({c}, '[～~]')) = 2 THEN CASE WHEN contains({p}, '/') "
        f"THEN CAST(TRY_STRPTIME({iso}, '%Y-%m-%d') AS DATE) ELSE {sql_roc(p)} END END"
    )


VIEWS: dict[str, str] = {
    "ticks": f"""SELECT event_id, ts, user_id AS code, CAST(ts AS DATE) AS d, event_type, value, {K} AS k FROM events""",
    "bars": """SELECT code, d, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
        max_by(value, ts) AS close, count(*) AS vol, CASE WHEN max(k) >= 98 THEN 'NOTE' END AS note
        FROM ticks GROUP BY code, d""",
    "cal": "SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM ticks) x",
    "roster": """SELECT c_custkey AS code, CASE WHEN c_custkey % 2 = 0 THEN 'M0' ELSE 'M1' END AS market,
        c_name AS name, c_nationkey AS industry FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "flows": """SELECT code, d,
        sum(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value END) AS net_a,
        sum(CASE event_type WHEN 'click' THEN value WHEN 'view' THEN -value END) AS net_b
        FROM ticks GROUP BY code, d""",
    "balances": """SELECT code, d, bal, lag(bal) OVER (PARTITION BY code ORDER BY d) AS prev
        FROM (SELECT code, d, CAST(sum(k) AS BIGINT) AS bal FROM ticks GROUP BY code, d) x""",
    "revenue": """SELECT o_custkey AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
        CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 9 DAY AS DATE) AS report_date,
        sum(o_totalprice) AS amount FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate)""",
    "actions": """SELECT event_id AS batch, code, d AS ex_date, round(value / 100, 4) AS cash,
        (k % 5) / CAST(100 AS DOUBLE) AS ratio, k % 10 = 0 AS rights FROM ticks WHERE event_type = 'signup'""",
    "merged": """SELECT code, ex_date, max_by(cash, batch) AS cash, max_by(ratio, batch) AS ratio,
        max_by(rights, batch) AS rights, max(batch) AS batch FROM actions GROUP BY code, ex_date""",
    "notices": """SELECT event_id AS pos, code, d AS start_d,
        CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(d + (k % 7) * INTERVAL 1 DAY AS DATE) END AS end_d, k
        FROM ticks WHERE event_type = 'error'""",
    "raw_text": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_suppkey % 11 = 0 THEN ' ---' WHEN l_suppkey % 13 = 0 THEN 'N/A'
             WHEN l_suppkey % 17 = 0 THEN '除息 ' WHEN l_suppkey % 19 = 0 THEN '1D'
             WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 2 = 0
             THEN concat('+', CAST(CAST(l_quantity AS INT) AS STRING), ',000 ')
             ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS raw FROM lineitem""",
    "ledger": """SELECT doc_id AS id, source AS source_id,
        CASE WHEN doc_id % 17 = 0 THEN NULL
             ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) * INTERVAL 1 DAY AS DATE) END AS data_as_of,
        CASE WHEN doc_id % 23 = 0 THEN 'invalid_json' WHEN doc_id % 17 = 0 THEN 'date_field_missing'
             ELSE 'single_date_in_payload' END AS reason,
        sha256(text) AS content_hash, CAST(length(text) AS BIGINT) AS content_length,
        concat(source, '/', sha256(text)) AS path FROM documents""",
    "bodies": """SELECT path, CASE WHEN doc_id % 37 = 0 THEN concat(text, '!') ELSE text END AS body FROM (
        SELECT concat(source, '/', sha256(text)) AS path, min_by(text, doc_id) AS text, min(doc_id) AS doc_id
        FROM documents GROUP BY 1) x WHERE doc_id % 29 <> 0""",
    "trades": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS shares,
        CAST(round(l_extendedprice * 100 / l_quantity, 0) AS BIGINT) AS entry_cents,
        CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity > 0""",
    "announce": """SELECT doc_id, source AS code, lang AS market,
        CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) * INTERVAL 1 DAY AS DATE) AS speak_date,
        text AS subject, text AS detail, concat('clause', CAST(doc_id % 9 AS STRING)) AS clause
        FROM documents""",
    "gold": """SELECT doc_id AS item_key, 1 AS revision, CASE WHEN toxic = 1 THEN 'veto' ELSE 'no_veto' END AS label
        FROM labels UNION ALL
        SELECT doc_id, 2, CASE WHEN quality = 0 THEN 'veto' ELSE 'no_veto' END FROM labels WHERE doc_id % 5 = 0""",
    "verdicts": """SELECT doc_id AS task_key,
        CASE WHEN n_chars < 300 AND doc_id % 31 <> 0 AND doc_id % 11 <> 0 THEN 'veto' ELSE 'no_veto' END AS verdict,
        doc_id % 31 <> 0 AS parse_ok, doc_id % 11 <> 0 AS evidence_verified
        FROM documents WHERE doc_id % 7 <> 0""",
    "payloads": """SELECT event_id AS id, event_type AS source_id, d,
        CASE WHEN event_id % 23 = 0 THEN '  <html>blocked</html>' WHEN event_id % 29 = 0 THEN concat('{"k":', k, '}')
          WHEN event_id % 31 = 0 THEN '[]'
          ELSE concat('[{"Date":"', CASE WHEN k % 4 = 0 THEN '' ELSE roc END, '","Code":"', code, '","Close":"',
            CAST(value AS STRING), '"}', CASE WHEN k % 3 = 0 THEN concat(',{"Date":"', CASE WHEN k % 2 = 0 THEN '1130131' ELSE roc END,
            '","Code":"","Volume":"1,234"}') ELSE '' END, CASE WHEN k % 5 = 0 THEN ',7' ELSE '' END, ']') END AS body,
        CASE WHEN k % 2 = 0 THEN 'unique' ELSE 'max' END AS selection
        FROM (SELECT *, concat(year(d) - 1911, strftime(d, '%m%d')) AS roc FROM ticks) x""",
    "payload_states": """SELECT *, CASE WHEN NOT json_valid(body) THEN 'invalid_json'
        WHEN json_type(body) <> 'ARRAY' THEN 'payload_not_an_array' WHEN json_array_length(body) = 0 THEN 'payload_empty' END AS state
        FROM payloads""",
    "payload_rows": """SELECT id, source_id, selection, unnest(range(len(a))) AS pos, unnest(a) AS elem FROM (
        SELECT id, source_id, selection, CAST(body AS JSON[]) AS a FROM payload_states WHERE state IS NULL) x""",
    "field_tables": """SELECT l_orderkey, l_linenumber, l_suppkey AS id, CASE WHEN l_suppkey % 10 = 0 THEN '{"fields":["part","supp no."]}'
        ELSE concat('{"fields":["part","supp no."," line"],"data":[', c, ',', c, ']}') END AS body FROM (SELECT *,
        concat('["', l_partkey, '","', l_suppkey, '"', CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE concat(',"', l_linenumber, '"') END, ']') AS c
        FROM lineitem) x""",
    "cells": """SELECT l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'TWSE' ELSE 'TPEx' END AS market,
        CASE WHEN l_suppkey % 37 = 0 THEN '  ' ELSE concat(' ', l_partkey) END AS code_cell,
        CASE WHEN l_suppkey % 11 = 0 THEN ' ---' WHEN l_suppkey % 13 = 0 THEN 'N/A'
             WHEN l_suppkey % 17 = 0 THEN '除息 ' WHEN l_suppkey % 19 = 0 THEN '1D'
             WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 2 = 0
             THEN concat('+', CAST(CAST(l_quantity AS INT) AS STRING), ',000 ')
             ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS number_cell,
        concat(l_returnflag, '　') AS text_cell, CASE WHEN l_linenumber = 7 THEN '1130230' ELSE roc END AS roc_cell,
        CASE WHEN l_linenumber = 6 THEN '' ELSE ad END AS ad_cell, CASE WHEN l_linenumber % 2 = 0 THEN roc ELSE ad END AS mixed_cell,
        CASE l_linenumber % 3 WHEN 0 THEN 'Ｙ' WHEN 1 THEN ' Y ' ELSE '' END AS flag_cell,
        CASE l_linenumber % 4 WHEN 0 THEN slashed WHEN 1 THEN concat(slashed, '～', slashed) ELSE concat(roc, '~', '1150827') END AS period_cell,
        CASE l_linenumber % 3 WHEN 0 THEN 'roc_compact' WHEN 1 THEN 'ad_compact' ELSE 'iso' END AS declared
        FROM (SELECT *, concat(year(l_shipdate) - 1911, strftime(l_shipdate, '%m%d')) AS roc, strftime(l_shipdate, '%Y%m%d') AS ad,
          concat(year(l_shipdate) - 1911, '/', month(l_shipdate), '/', day(l_shipdate)) AS slashed FROM lineitem) x""",
    "candidates": """SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS rank FROM (
        SELECT CAST(l_shipdate AS DATE) AS d, l_partkey AS code, floor(max(l_extendedprice / l_quantity) * 2.5::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS entry,
          CASE WHEN l_partkey % 23 <> 0 THEN 0.004::DOUBLE + (l_partkey % 41) / 250.0::DOUBLE END AS sigma, (l_partkey * 7919) % 1000 AS score
        FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2) x""",
    "risk_state": """SELECT d, day(d) % 8 AS entries, day(d) % 4 AS open_positions, (day(d) % 5) * 10.0::DOUBLE AS exposure_pct,
        day(d) % 17 AS drawdown_pct FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) x""",
    "barriers": """SELECT *, coalesce(entry > 0 AND sigma > 0 AND dist < 1, false) AS feasible,
        CASE WHEN entry > 0 AND sigma > 0 AND dist < 1 THEN entry * dist END AS risk FROM (
        SELECT *, 2.0::DOUBLE * sigma * sqrt(10) AS dist FROM candidates) x""",
    "priced": """SELECT *, CAST(round(entry * 100) AS BIGINT) AS e, CAST(round((entry - risk) * 100) AS BIGINT) AS s,
        CAST(round((entry + 2.0::DOUBLE * risk) * 100) AS BIGINT) AS g, CAST(floor(200.0::DOUBLE / risk) AS BIGINT) AS upper_n FROM barriers""",
    "returns": """SELECT a.code, a.d, ca.i, ln(a.close / b.close) AS r FROM bars a JOIN cal ca ON ca.d = a.d JOIN cal cb ON cb.i = ca.i - 1
        JOIN bars b ON b.code = a.code AND b.d = cb.d WHERE a.close > 0 AND b.close > 0""",
    "responses": """SELECT doc_id AS task_key, doc_id % 6 AS shape, regexp_replace(substring(text, 5, 24), '[^A-Za-z ]', '', 'g') AS q,
        regexp_replace(concat(text, chr(10), text), '[\\s\\x{00A0}\\x{3000}\\x{FEFF}]+', '', 'g') AS hay FROM documents""",
    "judged": """SELECT task_key, shape, shape IN (2, 3, 4) AS parse_ok, CASE WHEN shape = 0 THEN 'no_json' WHEN shape = 5 THEN 'no_json' WHEN shape = 1 THEN 'bad_verdict' END AS failure,
        CASE WHEN shape = 3 AND length(regexp_replace(q, '\\s', '', 'g')) >= 8 AND contains(hay, regexp_replace(q, '\\s', '', 'g')) THEN 'veto' ELSE 'no_veto' END AS verdict,
        CASE shape WHEN 3 THEN q WHEN 4 THEN 'short' ELSE '' END AS quoted_evidence,
        shape = 2 OR (shape = 3 AND length(regexp_replace(q, '\\s', '', 'g')) >= 8 AND contains(hay, regexp_replace(q, '\\s', '', 'g'))) AS evidence_verified FROM responses""",
    "msg": """SELECT event_id AS message_id, ts AS sent_at, code % 10 AS sender, event_type, k, value, lpad(CAST(code AS STRING), 4, '0') AS c4,
        CASE WHEN event_id % 41 = 0 THEN 'ignored' WHEN event_id % 43 = 0 THEN 'help' WHEN event_id % 47 = 0 OR event_id % 53 = 0 OR event_id % 59 = 0 THEN 'error'
          WHEN event_type IN ('purchase', 'error') THEN CASE WHEN k % 9 = 0 OR k % 10 = 0 THEN 'error' ELSE 'rec' END
          WHEN event_type = 'click' AND k % 8 = 0 THEN 'error' WHEN event_type = 'signup' AND k % 6 = 0 THEN 'error' ELSE 'rec' END AS kind,
        CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' WHEN 'view' THEN 'watch' WHEN 'click' THEN 'skip' ELSE 'note' END AS action FROM ticks""",
    "records": """SELECT message_id, sent_at, CAST(sent_at AS DATE) AS d, sender, action, CASE WHEN action <> 'note' THEN c4 END AS code,
        CASE WHEN action IN ('buy', 'sell') THEN CAST(k + 1 AS BIGINT) END AS shares, CASE WHEN action IN ('buy', 'sell') THEN value END AS price,
        CASE action WHEN 'buy' THEN CASE WHEN k % 4 = 0 THEN 'first note' END WHEN 'watch' THEN CASE WHEN k % 2 = 0 THEN 'wait a bit' END WHEN 'note' THEN 'market mood' END AS note
        FROM msg WHERE kind = 'rec'""",
    # ── derived chains ──
    "quoted": "SELECT b.* FROM bars b WHERE b.code IN (SELECT code FROM roster) AND close > 0 AND coalesce(vol, 0) > 0",
    "usable": "SELECT b.code, b.d, c.i, b.close FROM bars b JOIN cal c USING (d) WHERE close > 0 AND note IS NULL",
    "rev5": """SELECT t.code, t.d, t.close / z.close - 1 AS reversal FROM usable t
        JOIN usable z ON z.code = t.code AND z.i = t.i - 5
        WHERE (SELECT count(*) FROM usable m WHERE m.code = t.code AND m.i BETWEEN t.i - 5 AND t.i) = 6""",
    "growth": """SELECT a.code, a.period, a.report_date, 100 * (a.amount - b.amount) / nullif(b.amount, 0) AS yoy
        FROM revenue a LEFT JOIN revenue b ON b.code = a.code AND b.period = CAST(a.period - INTERVAL 12 MONTH AS DATE)""",
    "shifted": """SELECT code, CAST(period + INTERVAL 300 MONTH AS DATE) AS period,
        CAST(CAST(period + INTERVAL 301 MONTH AS DATE) + INTERVAL 9 DAY AS DATE) AS report_date, yoy FROM growth""",
    "known": """SELECT code, d, yoy FROM (SELECT q.code, q.d, g.yoy,
        row_number() OVER (PARTITION BY q.code, q.d ORDER BY g.period DESC, g.report_date DESC) AS rn
        FROM quoted q JOIN shifted g ON g.code = q.code AND g.report_date <= q.d) x WHERE rn = 1""",
    "factor_long": """SELECT d, code, factor, value FROM (
        SELECT q.d, q.code, 'rev_yoy_momentum_v1' AS factor, k.yoy AS value FROM quoted q JOIN known k USING (code, d)
        UNION ALL SELECT q.d, q.code, 'trust_net_buy_ratio_v1', f.net_a / nullif(q.vol, 0) FROM quoted q JOIN flows f USING (code, d)
        UNION ALL SELECT q.d, q.code, 'foreign_net_buy_ratio_v1', f.net_b / nullif(q.vol, 0) FROM quoted q JOIN flows f USING (code, d)
        UNION ALL SELECT q.d, q.code, 'margin_balance_change_v1', CASE WHEN b.prev > 0 THEN (b.bal - b.prev) / b.prev END
            FROM quoted q JOIN balances b USING (code, d)
        UNION ALL SELECT q.d, q.code, 'short_term_reversal_5d_v1', r.reversal FROM quoted q JOIN rev5 r USING (code, d)
        ) x WHERE value IS NOT NULL AND isfinite(value)""",
    "bounds": """SELECT d, factor, count(*) AS n, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
        FROM factor_long GROUP BY d, factor""",
    "clamped": """SELECT l.d, l.code, l.factor, l.value, b.n, greatest(least(l.value, b.hi), b.lo) AS winsorized
        FROM factor_long l JOIN bounds b USING (d, factor)""",
    "ranked_values": """SELECT *, rank() OVER (PARTITION BY d, factor ORDER BY winsorized)
        + (count(*) OVER (PARTITION BY d, factor, winsorized) - 1) / 2.0 AS midrank FROM clamped""",
    "scored": """SELECT *, CASE WHEN n = 1 THEN 0.5
        WHEN factor IN ('margin_balance_change_v1', 'short_term_reversal_5d_v1') THEN 1 - (midrank - 1) / (n - 1)
        ELSE (midrank - 1) / (n - 1) END AS score FROM ranked_values""",
    "factor_inputs": """SELECT d, factor, n, CASE WHEN i < needs THEN 'history_too_short' WHEN n = 0 THEN 'input_empty' ELSE 'active' END AS state FROM (
        SELECT c.d, c.i, f.factor, f.needs, CASE WHEN f.factor = 'rev_yoy_momentum_v1'
          THEN (SELECT count(*) FROM (SELECT code, min(report_date) AS first_d FROM shifted GROUP BY code) p WHERE p.first_d <= c.d)
          ELSE (SELECT count(*) FROM flows w WHERE w.d = c.d) END AS n
        FROM cal c CROSS JOIN (VALUES ('rev_yoy_momentum_v1', 1), ('trust_net_buy_ratio_v1', 1), ('margin_balance_change_v1', 1),
          ('short_term_reversal_5d_v1', 6), ('foreign_net_buy_ratio_v1', 1)) f(factor, needs)) z""",
    "active": "SELECT d, factor, n FROM factor_inputs WHERE state = 'active'",
    "composites": """SELECT q.d, q.code, avg(coalesce(s.score, 0.5)) AS composite, count(s.score) AS real_factors,
        count(*) AS active FROM quoted q JOIN active a ON a.d = q.d
        LEFT JOIN scored s ON s.d = q.d AND s.code = q.code AND s.factor = a.factor
        GROUP BY q.d, q.code HAVING count(s.score) > 0""",
    "slice_scores": """SELECT d, code, round(CASE WHEN n = 1 THEN 0.5 ELSE 1 - (midrank - 1) / (n - 1) END, 9) AS score FROM (
        SELECT *, rank() OVER (PARTITION BY d ORDER BY w) + (count(*) OVER (PARTITION BY d, w) - 1) / 2.0 AS midrank FROM (
          SELECT v.d, v.code, n, greatest(least(reversal, hi), lo) AS w FROM (SELECT r.* FROM rev5 r JOIN quoted q USING (code, d)) v
          JOIN (SELECT d, count(*) AS n, quantile_cont(reversal, 0.01) AS lo, quantile_cont(reversal, 0.99) AS hi
                FROM (SELECT r.* FROM rev5 r JOIN quoted q USING (code, d)) z GROUP BY d) b USING (d)) y) x""",
    "picks": """SELECT c.i * 10 + s.rank AS pick_id, s.code, s.d, c.i, s.rank, s.score, b.close AS entry,
        CASE WHEN s.rank % 2 = 0 THEN 0.9::DOUBLE * b.close END AS stop, CASE WHEN s.rank % 2 = 0 THEN 1.2::DOUBLE * b.close END AS target,
        CASE WHEN s.rank % 2 = 0 THEN 'trade_signal' ELSE 'watchlist' END AS list_kind
        FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS rank FROM slice_scores) s
        JOIN cal c ON c.d = s.d JOIN bars b ON b.code = s.code AND b.d = s.d WHERE s.rank <= 5""",
    "pick_events": """SELECT pick_id, ex_date, cash, ratio, rights, f, f / (1 + ratio) AS prior, sum(cash * f / (1 + ratio)) OVER (PARTITION BY pick_id ORDER BY ex_date) AS c,
        count(*) OVER (PARTITION BY pick_id ORDER BY ex_date) AS n, bool_or(rights) OVER (PARTITION BY pick_id ORDER BY ex_date) AS any_rights FROM (
        SELECT p.pick_id, e.*, product(1 + e.ratio) OVER (PARTITION BY p.pick_id ORDER BY e.ex_date) AS f FROM picks p JOIN merged e ON e.code = p.code AND e.ex_date > p.d) x""",
    "pick_days": """SELECT p.*, cd.i - p.i AS k, cd.d AS day, b.high, b.low, b.close, coalesce(e.f, 1.0) AS f, coalesce(e.c, 0.0) AS c, coalesce(e.n, 0) AS n, coalesce(e.any_rights, false) AS r
        FROM picks p JOIN cal cd ON cd.i > p.i AND cd.i <= p.i + 20 LEFT JOIN bars b ON b.code = p.code AND b.d = cd.d
        ASOF LEFT JOIN pick_events e ON e.pick_id = p.pick_id AND e.ex_date <= cd.d""",
    "touches": """SELECT pick_id, k, day, CASE WHEN low <= (stop - c) / f THEN 'stop' ELSE 'target' END AS kind FROM pick_days
        WHERE low <= (stop - c) / f OR high >= (target - c) / f""",
    "outcomes": """SELECT *, CASE WHEN status = 'computed' THEN 100 * (xclose / entry - 1) END AS raw_pct,
        CASE WHEN status = 'computed' THEN 100 * ((xclose * f + c) / entry - 1) END AS adj_pct FROM (
        SELECT p.pick_id, p.code, p.d, p.entry, p.list_kind, h.horizon, p.stop, x.day AS exit_date, x.close AS xclose,
          CASE WHEN x.pick_id IS NULL THEN 'not_mature' WHEN x.close > 0 THEN 'computed' ELSE 'no_price_at_exit' END AS status,
          coalesce(x.f, 1.0) AS f, coalesce(x.c, 0.0) AS c, coalesce(x.n, 0) AS n, coalesce(x.r, false) AS r,
          (SELECT min(k) FROM touches t WHERE t.pick_id = p.pick_id AND t.k <= h.horizon) AS touch_k
        FROM picks p CROSS JOIN (VALUES (5), (10), (20)) h(horizon) LEFT JOIN pick_days x ON x.pick_id = p.pick_id AND x.k = h.horizon) z""",
    "observed": """SELECT o.pick_id, o.horizon, o.list_kind, o.code, o.d, o.adj_pct AS asset_pct,
        CASE WHEN a.close > 0 AND b.close > 0 THEN 100 * ((b.close * coalesce(e.f, 1) + coalesce(e.c, 0)) / a.close - 1) END AS benchmark_pct
        FROM outcomes o LEFT JOIN bars a ON a.code = 3 AND a.d = o.d LEFT JOIN bars b ON b.code = 3 AND b.d = o.exit_date
        LEFT JOIN bench_adj e ON e.from_d = o.d AND e.to_d = o.exit_date WHERE o.status = 'computed'""",
    "bench_adj": """SELECT from_d, to_d, last(f ORDER BY ex_date) AS f, sum(cash * f / (1 + ratio)) AS c FROM (
        SELECT iv.*, e.ex_date, e.cash, e.ratio, product(1 + e.ratio) OVER (PARTITION BY iv.from_d, iv.to_d ORDER BY e.ex_date) AS f
        FROM (SELECT DISTINCT d AS from_d, exit_date AS to_d FROM outcomes WHERE exit_date IS NOT NULL) iv
        JOIN merged e ON e.code = 3 AND e.ex_date > iv.from_d AND e.ex_date <= iv.to_d) x GROUP BY from_d, to_d""",
    "tri": """SELECT code, d, i, close, 100 * product(CASE WHEN prev > 0 THEN (close * coalesce(f, 1) + coalesce(c, 0)) / prev ELSE 1 END) OVER (PARTITION BY code ORDER BY i) AS total_return_index
        FROM (SELECT b.code, b.d, b.i, b.close, b.prev, (SELECT last(e.f ORDER BY e.ex_date) FROM bar_events e WHERE e.code = b.code AND e.d = b.d) AS f,
          (SELECT sum(e.cash * e.f / (1 + e.ratio)) FROM bar_events e WHERE e.code = b.code AND e.d = b.d) AS c FROM steps b) x""",
    "steps": """SELECT b.code, b.d, c.i, b.close, lag(b.close) OVER w AS prev, lag(b.d) OVER w AS prev_d FROM bars b JOIN cal c USING (d) WINDOW w AS (PARTITION BY b.code ORDER BY b.d)""",
    "bar_events": """SELECT s.code, s.d, e.ex_date, e.cash, e.ratio, product(1 + e.ratio) OVER (PARTITION BY s.code, s.d ORDER BY e.ex_date) AS f
        FROM steps s JOIN merged e ON e.code = s.code AND e.ex_date > s.prev_d AND e.ex_date <= s.d""",
    # equal means may differ in their last bits between engines, so order on rounded values
    "ranked": """SELECT d, code, round(composite, 9) AS composite, real_factors, active,
        row_number() OVER (PARTITION BY d ORDER BY round(composite, 9) DESC, code) AS rank FROM composites""",
}


def views_for(sql: str, known: dict[str, str] = VIEWS) -> list[str]:
    """The views a statement mentions, each after the views it needs itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if word in known and word not in found and word not in visiting:
                visiting.add(word)
                visit(known[word])
                found.append(word)

    visiting: set[str] = set()
    visit(sql)
    return found


def with_views(sql: str, recursive: bool = False) -> str:
    """Prepend the needed views to a statement that may itself start with WITH."""
    body = sql.strip()
    views = views_for(body)
    heads = [f"{name} AS ({VIEWS[name]})" for name in views]
    word = "WITH RECURSIVE" if recursive or body.upper().startswith("WITH RECURSIVE") else "WITH"
    upper = body.upper()
    if upper.startswith("WITH RECURSIVE"):
        body = body[len("WITH RECURSIVE"):].strip()
        return f"{word} {', '.join([*heads, body])}"
    if upper.startswith("WITH"):
        return f"{word} {', '.join([*heads, body[len('WITH'):].strip()])}"
    return f"{word} {', '.join(heads)} {body}" if heads else body
