"""Payload observation, ledger, mapping and data-quality queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import dates, text
from tideline.operators import quality
from tideline.plans.catalogue import query
from tideline.plans.oracle import sql_ad, sql_bound, sql_fixed, sql_number, sql_roc, sql_signed_pct, sql_status, sql_trim
from tideline.plans.views import Tables
from tideline.sources import catalog, ledger as store, mapping, payloads as pay

# ── payloads ─────────────────────────────────────────────────────────────────


@query("payload_rows", """SELECT id, pos, json_extract_string(elem, '$.Code') AS code, json_extract_string(elem, '$.Close') AS close,
   json_extract_string(elem, '$.Volume') AS volume FROM payload_rows""")
def payload_rows(t: Tables) -> DataFrame:
    r = F.col("row")
    return pay.json_rows(t.payloads()).select(
        "id", F.col("pos").cast("bigint").alias("pos"), r["Code"].alias("code"), r["Close"].alias("close"), r["Volume"].alias("volume")
    )


@query("payload_states", """SELECT coalesce(state, 'rows') AS state, CASE WHEN coalesce(state, 'rows') NOT IN ('invalid_json', 'payload_not_an_array')
   THEN 'usable' WHEN starts_with(ltrim(substring(body, 1, 64)), '<') THEN 'html' ELSE 'unusable' END AS class, count(*) AS n
   FROM payload_states GROUP BY 1, 2""")
def payload_states(t: Tables) -> DataFrame:
    state = F.coalesce(pay.payload_state(F.col("body")), F.lit("rows"))
    p = t.payloads().select(state.alias("state"), "body")
    return p.groupBy("state", pay.classify(F.col("body"), F.col("state")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("field_table_rows", """SELECT id, CAST(cells[1] AS BIGINT) AS part, CAST(cells[2] AS BIGINT) AS supp, CAST(cells[3] AS BIGINT) AS line,
   len(cells) <> 3 AS wrong_arity FROM (SELECT id, unnest(CAST(json_extract(body, '$.data') AS VARCHAR[][])) AS cells FROM field_tables
   WHERE json_extract(body, '$.data') IS NOT NULL) x""")
def field_table_rows(t: Tables) -> DataFrame:
    r = F.col("row")
    return pay.fields_data_rows(t.field_tables()).select(
        "id", r["part"].cast("bigint").alias("part"), r["supp no."].cast("bigint").alias("supp"), r[" line"].cast("bigint").alias("line"), "wrong_arity"
    )


KEYS = """WITH ks AS (SELECT id, source_id, pos, CASE WHEN json_type(elem) = 'OBJECT' THEN list_sort(json_keys(elem)) END AS ks FROM payload_rows)"""


@query("observed_fields", KEYS + """ SELECT p.id, coalesce(fields, '') AS fields FROM payloads p LEFT JOIN (
   SELECT id, array_to_string(list_sort(list_distinct(flatten(list(ks)))), ',') AS fields FROM ks WHERE ks IS NOT NULL GROUP BY id) x ON x.id = p.id""")
def observed_fields(t: Tables) -> DataFrame:
    return pay.observed_fields(pay.json_rows(t.payloads(), every=True)).select("id", F.array_join("fields", ",").alias("fields"))


@query("heterogeneous_rows", KEYS + """, lead_row AS (SELECT id, min_by(ks, pos) AS k0 FROM ks WHERE ks IS NOT NULL GROUP BY id)
   SELECT p.id, count(ks.id) AS row_count, count(ks.id) FILTER (ks.ks IS DISTINCT FROM k0) AS heterogeneous
   FROM payloads p LEFT JOIN ks ON ks.id = p.id LEFT JOIN lead_row ON ks.id = lead_row.id GROUP BY p.id""")
def heterogeneous_rows(t: Tables) -> DataFrame:
    return pay.heterogeneous_rows(pay.json_rows(t.payloads(), every=True))


RAWDATE = f"""WITH rd AS (SELECT id, selection, pos, json_extract_string(elem, '$.Date') AS raw FROM payload_rows),
   pd AS (SELECT *, {sql_roc('raw')} AS dd FROM rd)"""


def dated_rows(t: Tables) -> DataFrame:
    rows = pay.json_rows(t.payloads(), carry=("selection",), every=True)
    return rows.select("id", "pos", F.col("row")["Date"].alias("raw"), "selection", "state")


@query("payload_dates", RAWDATE + """ SELECT s.id, CASE WHEN NOT many THEN mx END AS data_as_of,
   CASE WHEN s.state IS NOT NULL THEN s.state WHEN strings = 0 THEN 'date_field_missing' WHEN mx IS NULL THEN 'date_unparsable' WHEN x.selection = 'max' THEN 'max_date_in_payload'
     WHEN many THEN 'multiple_dates_in_payload' ELSE 'single_date_in_payload' END AS reason FROM payload_states s LEFT JOIN (
   SELECT id, max(selection) AS selection, count(raw) AS strings, max(dd) AS mx,
     max(selection) = 'unique' AND count(DISTINCT raw) > 1 AS many FROM pd GROUP BY id) x ON x.id = s.id""")
def payload_dates(t: Tables) -> DataFrame:
    return pay.resolve_as_of(dated_rows(t), "raw", F.lit(dates.ROC_COMPACT), F.col("selection"))


@query("observed_dates", RAWDATE + """ SELECT id, raw, first_pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_pos, raw) AS rank
   FROM (SELECT id, raw, min(pos) AS first_pos FROM pd WHERE raw IS NOT NULL GROUP BY id, raw) y) x WHERE rank <= 50""")
def observed_dates(t: Tables) -> DataFrame:
    return pay.observed_values(dated_rows(t), "raw").withColumn("first_pos", F.col("first_pos").cast("bigint"))


@query("payload_periods", """SELECT l_orderkey AS id, max(CASE WHEN CAST(m AS INT) BETWEEN 1 AND 12 THEN concat(CAST(y + 1911 AS STRING), '-', m) END) AS data_period
   FROM (SELECT l_orderkey, year(l_shipdate) - 1911 AS y, CASE WHEN l_linenumber = 7 THEN '13' ELSE strftime(l_shipdate, '%m') END AS m FROM lineitem) x GROUP BY l_orderkey""")
def payload_periods(t: Tables) -> DataFrame:
    month = F.when(F.col("l_linenumber") == 7, "13").otherwise(F.date_format("l_shipdate", "MM"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.concat((F.year("l_shipdate") - 1911).cast("string"), month).alias("raw"))
    return pay.resolve_period(rows, "raw")


# Two sources have a declared baseline, one of them with a field that never comes; the rest take their first snapshot's.
DECLARED = {"click": ["Close", "Code", "Date"], "view": ["Close", "Code", "Date", "Volume", "Turnover"]}
SOURCE_FIELDS = """WITH seen AS (SELECT p.id, p.source_id, p.state, o.fields FROM payload_states p LEFT JOIN (
     SELECT id, list_sort(list_distinct(flatten(list(json_keys(elem))))) AS fields FROM payload_rows WHERE json_type(elem) = 'OBJECT' GROUP BY id) o USING (id)),
   base AS (SELECT source_id, CASE source_id WHEN 'click' THEN ['Close', 'Code', 'Date'] WHEN 'view' THEN ['Close', 'Code', 'Date', 'Turnover', 'Volume'] ELSE min_by(fields, id) END AS baseline FROM seen WHERE len(fields) > 0 GROUP BY source_id),
   drift AS (SELECT s.id, s.source_id, s.state, list_sort(list_filter(coalesce(fields, []), lambda f: NOT list_contains(baseline, f))) AS added,
     list_sort(list_filter(baseline, lambda f: NOT list_contains(coalesce(fields, []), f))) AS removed FROM seen s JOIN base b USING (source_id))"""


def drifted(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, source_id, d, state, added, removed) from the rows of every payload; bodies stay where they lie."""
    seen = pay.observed_fields(rows, carry=("source_id", "d", "state"))
    base = catalog.baseline_fields(seen, declared=declared)
    added, removed = pay.field_drift(F.col("baseline"), F.col("fields"))
    return seen.join(base, "source_id").select("id", "source_id", "d", "state", added.alias("added"), removed.alias("removed"))


def declared_fields(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(DECLARED.items()), "source_id string, fields array<string>")


def observed_rows(t: Tables) -> DataFrame:
    """Rows of every payload, parsed once and written, as several steps read them."""
    return t.once("observed_rows", lambda t: pay.json_rows(t.payloads(), carry=("source_id", "d"), every=True))


@query("field_drift", SOURCE_FIELDS + """ SELECT id, source_id, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM drift
   WHERE len(added) + len(removed) > 0""")
def field_drift(t: Tables) -> DataFrame:
    d = drifted(observed_rows(t), declared_fields(t)).filter((F.size("added") + F.size("removed")) > 0)
    return d.select("id", "source_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


def health_log(t: Tables) -> DataFrame:
    """What each payload shows of itself; purchases are a source without a fixed set of fields, so they never drift."""
    rows = observed_rows(t)
    d = drifted(rows, declared_fields(t)).join(pay.heterogeneous_rows(rows), "id")
    state, drift = F.col("state"), (F.size("added") + F.size("removed")) > 0
    status = pay.health_status(
        F.coalesce(state.isin(pay.INVALID_JSON), F.lit(False)), drift & (F.col("source_id") != "purchase"), F.col("heterogeneous") > 0, F.coalesce(state == pay.EMPTY, F.lit(False))
    )
    return d.select("id", "source_id", "d", status.alias("status"))


HEALTH = SOURCE_FIELDS + """, ks AS (SELECT id, pos, CASE WHEN json_type(elem) = 'OBJECT' THEN list_sort(json_keys(elem)) END AS ks FROM payload_rows),
   mixed AS (SELECT DISTINCT ks.id FROM ks LEFT JOIN (SELECT id, min_by(ks, pos) AS k0 FROM ks WHERE ks IS NOT NULL GROUP BY id) l USING (id) WHERE ks.ks IS DISTINCT FROM k0),
   log AS (SELECT r.source_id, p.d, CASE WHEN r.state = 'invalid_json' THEN 'fetch_failed' WHEN len(added) + len(removed) > 0 AND r.source_id <> 'purchase' THEN 'schema_drift'
     WHEN r.id IN (SELECT id FROM mixed) THEN 'heterogeneous_rows' WHEN r.state = 'payload_empty' THEN 'date_unresolved' ELSE 'ok' END AS status FROM drift r JOIN payloads p USING (id))"""


@query("health_rollup", HEALTH + " SELECT source_id, status, count(*) AS n FROM log GROUP BY source_id, status")
def health_rollup(t: Tables) -> DataFrame:
    return store.health_rollup(health_log(t))


CLEAN_DAYS = """days AS (SELECT source_id, d, max(CASE WHEN status = 'schema_drift' AND day(d) % 3 = 0 THEN 1 ELSE 0 END) AS bad FROM log GROUP BY source_id, d),
   runs AS (SELECT *, sum(bad) OVER (PARTITION BY source_id ORDER BY d) AS island FROM days),
   lens AS (SELECT source_id, island, count(*) AS len, max(d) AS e FROM runs WHERE bad = 0 GROUP BY source_id, island),
   streaks AS (SELECT source_id, max(len) AS longest_streak, max_by(len, e) AS latest_streak FROM lens GROUP BY source_id)"""


@query("clean_streaks", f"{HEALTH}, {CLEAN_DAYS} SELECT source_id, longest_streak, latest_streak FROM streaks")
def clean_streaks(t: Tables) -> DataFrame:
    return store.clean_streaks(health_log(t), failed=(F.col("status") == "schema_drift") & (F.dayofmonth("d") % 3 == 0))


SOURCE_IDS = [(n, row[0], row[1]) for n, row in enumerate(catalog.SOURCES)]


@query("source_groups", f"""WITH declared AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{i}', '{g}')" for n, i, g in SOURCE_IDS)}) x(n, source_id, source_group))
   SELECT source_group, count(*) AS declared, count(c) AS seen, CAST(coalesce(sum(c), 0) AS BIGINT) AS snapshots FROM declared
   LEFT JOIN (SELECT doc_id % 37 AS n, count(*) AS c FROM documents GROUP BY 1) s USING (n) GROUP BY source_group""")
def source_groups(t: Tables) -> DataFrame:
    """Snapshots of all declared sources and of one that nobody declared."""
    ids = F.array(*[F.lit(i) for _, i, _ in SOURCE_IDS], F.lit("undeclared"))
    seen = t.documents.select(F.element_at(ids, (F.col("doc_id") % 37 + 1).cast("int")).alias("source_id"))
    return catalog.source_activity(seen, catalog.sources(t.spark))


# ── ledger ───────────────────────────────────────────────────────────────────

STORED = "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 10 = 3"


def landing_plan(t: Tables) -> DataFrame:
    batch = t.ledger().select("id", "source_id", "data_as_of", "reason", "content_length", "content_hash")
    stored = t.documents.filter("doc_id % 10 = 3").select(F.sha2("text", 256).alias("content_hash"))
    return store.plan_landing(batch, stored)


LANDING = f"""WITH plan AS (SELECT l.*, row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1
   AND content_hash NOT IN ({STORED}) AS written FROM ledger l)"""


@query("landing_plan", LANDING + """ SELECT id, concat_ws('/', source_id, coalesce(CAST(data_as_of AS STRING), 'unknown-date'), content_hash) AS path, written FROM plan""")
def landing(t: Tables) -> DataFrame:
    return landing_plan(t).select("id", "path", "written")


@query("ingest_run_summary", LANDING + """ SELECT id % 4 AS run_id, count(DISTINCT source_id) AS sources, count(*) FILTER (written) AS stored,
   count(*) FILTER (NOT written AND reason <> 'invalid_json') AS duplicate, count(*) FILTER (reason = 'invalid_json') AS failed,
   count(*) FILTER (reason <> 'invalid_json' AND id % 7 = 0) AS drift,
   array_to_string(list_sort(list_distinct(list(CAST(data_as_of AS STRING)) FILTER (data_as_of IS NOT NULL))), ',') AS dates FROM plan GROUP BY id % 4""")
def ingest_run_summary(t: Tables) -> DataFrame:
    failed = F.col("reason") == pay.INVALID_JSON
    runs = landing_plan(t).select(
        (F.col("id") % 4).alias("run_id"), "source_id", "data_as_of", "written", failed.alias("failed"),
        F.lit(True).alias("registered"), (F.col("id") % 7 == 0).alias("drifted"),
    )
    return store.run_summary(runs)


@query("ledger_rows", """SELECT id, source_id, data_as_of, reason AS data_as_of_reason, content_hash, content_length AS content_bytes, path AS body_path,
   CASE WHEN reason <> 'invalid_json' THEN 'file' END AS body_store FROM ledger""")
def ledger_rows(t: Tables) -> DataFrame:
    return store.to_ledger_rows(t.ledger())


@query("verified_bodies", """SELECT l.id, coalesce(sha256(b.body) = l.content_hash, false) AS verified FROM ledger l LEFT JOIN bodies b USING (path)""")
def verified_bodies(t: Tables) -> DataFrame:
    return store.verified_bodies(t.ledger(), t.bodies()).select("id", "verified")


@query("usable_snapshots", "SELECT id, source_id FROM ledger WHERE reason NOT IN ('invalid_json', 'payload_not_an_array')")
def usable_snapshots(t: Tables) -> DataFrame:
    return store.usable_refs(t.ledger()).select("id", "source_id")


@query("latest_snapshots", """SELECT source_id, max(id) AS id, max_by(content_hash, id) AS content_hash FROM ledger GROUP BY source_id""")
def latest_snapshots(t: Tables) -> DataFrame:
    return store.latest_ref(t.ledger()).select("source_id", "id", "content_hash")


@query("snapshots_by_date", "SELECT source_id, data_as_of, max(id) AS id FROM ledger GROUP BY source_id, data_as_of")
def snapshots_by_date(t: Tables) -> DataFrame:
    return store.latest_ref(t.ledger(), by_date=True).select("source_id", "data_as_of", "id")


@query("recent_days", """SELECT source_id, data_as_of, id FROM (SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY data_as_of DESC) AS r FROM (
   SELECT *, row_number() OVER (PARTITION BY source_id, data_as_of ORDER BY id DESC) AS n FROM ledger WHERE data_as_of IS NOT NULL) x WHERE n = 1) y WHERE r <= 6""")
def recent_days(t: Tables) -> DataFrame:
    return store.recent_days(t.ledger(), 6).select("source_id", "data_as_of", "id")


USAGE = """WITH f AS (SELECT path, min_by(content_length, id) AS n, min_by(coalesce(CAST(data_as_of AS STRING), ''), id) AS day FROM ledger GROUP BY path)"""


@query("storage_usage", USAGE + """ SELECT objects, used_bytes, undated_bytes, days, round(dated / days, 6) AS daily_rate,
   CAST(floor((1000000000 - used_bytes) / (dated / days)) AS BIGINT) AS remaining_days FROM (
   SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS used_bytes, CAST(sum(n) FILTER (day = '') AS BIGINT) AS undated_bytes,
     CAST(sum(n) FILTER (day <> '') AS BIGINT) AS dated, count(DISTINCT day) FILTER (day <> '') AS days FROM f) x""")
def storage_usage(t: Tables) -> DataFrame:
    return store.storage_usage(t.ledger(), 1_000_000_000).withColumn("daily_rate", F.round("daily_rate", 6))


@query("bytes_per_day", USAGE + " SELECT CAST(nullif(day, '') AS DATE) AS data_as_of, count(*) AS objects, CAST(sum(n) AS BIGINT) AS bytes FROM f GROUP BY day")
def bytes_per_day(t: Tables) -> DataFrame:
    return store.bytes_per_day(t.ledger())


AUDIT = """WITH e AS (SELECT path, min_by(content_hash, id) AS h, min_by(content_length, id) AS n FROM ledger GROUP BY path),
   a AS (SELECT e.path, CASE WHEN b.body IS NULL THEN 'missing' WHEN sha256(b.body) = h AND length(b.body) = n THEN 'match' ELSE 'mismatch' END AS state
     FROM e LEFT JOIN bodies b USING (path))"""


@query("integrity_audit", AUDIT + " SELECT path, state FROM a")
def integrity_audit(t: Tables) -> DataFrame:
    return store.integrity_audit(t.ledger(), t.bodies()).select("path", "state")


@query("integrity_audit_newest", AUDIT + " SELECT path, state FROM a ORDER BY path DESC LIMIT 100")
def integrity_audit_newest(t: Tables) -> DataFrame:
    return store.integrity_audit(t.ledger(), t.bodies(), limit=100).select("path", "state")


# ── cleaning ─────────────────────────────────────────────────────────────────


@query("clean_numeric", f"""SELECT l_orderkey, l_linenumber, l_suppkey, {sql_number('raw')} AS raw_value, {sql_status('raw')} AS status,
   CASE WHEN trim(raw) IN ('除權', '除息', '除權息') THEN trim(raw) END AS raw_note,
   CASE WHEN trim(raw) IN ('除權', '除息', '除權息') THEN 'noted' ELSE {sql_status('raw')} END AS noted_status FROM raw_text""")
def clean_numeric(t: Tables) -> DataFrame:
    raw = F.col("raw")
    return quality.clean_numeric(t.raw_text(), {"raw": "noted"}).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "raw_value", text.numeric_status(raw).alias("status"), "raw_note",
        F.col("raw_status").alias("noted_status"),
    )


@query("parse_statistics", f"""SELECT c AS "column", count(*) FILTER (s = 'parsed') AS parsed, count(*) FILTER (s = 'blank') AS blank,
   count(*) FILTER (s = 'noted') AS noted, count(*) FILTER (s = 'unparsable') AS unparsable FROM (
   SELECT 'raw' AS c, CASE WHEN trim(raw) = '除息' THEN 'noted' ELSE {sql_status('raw')} END AS s FROM raw_text
   UNION ALL SELECT 'qty', {sql_status('raw')} FROM raw_text) x GROUP BY c""")
def parse_statistics(t: Tables) -> DataFrame:
    raw = t.raw_text().select("raw", F.col("raw").alias("qty"))
    cleaned = quality.clean_numeric(raw, {"raw": "noted", "qty": "integer"})
    a, b = quality.parse_stats(cleaned, ["raw"]), quality.parse_stats(cleaned, ["qty"])
    return quality.merge_stats(a, b)


@query("unparsable_samples", f"""SELECT raw, count(*) AS n FROM raw_text WHERE {sql_status('raw')} = 'unparsable' GROUP BY raw ORDER BY raw LIMIT 10""")
def unparsable_samples(t: Tables) -> DataFrame:
    return quality.unparsable_samples(quality.clean_numeric(t.raw_text(), {"raw": "number"}), "raw")


@query("standardise_dates", f"""SELECT declared, n, parsed, failed FROM (SELECT declared, count(*) AS n, count(v) AS parsed, count(*) FILTER (v IS NULL) AS failed FROM (
   SELECT declared, CASE declared WHEN 'roc_compact' THEN {sql_roc('roc_cell')} WHEN 'ad_compact' THEN {sql_ad('roc_cell')} END AS v FROM cells) x GROUP BY declared) y""")
def standardise_dates(t: Tables) -> DataFrame:
    dated = quality.standardise_dates(t.cells().select("roc_cell", "declared"), "roc_cell", "declared")
    return quality.date_failures(dated, "roc_cell", "declared")


@query("date_conversions", f"""SELECT roc_cell, {sql_roc('roc_cell')} AS d, strftime({sql_roc('roc_cell')}, '%Y%m%d') AS compact, concat(lpad(CAST(year({sql_roc('roc_cell')}) - 1911 AS STRING), 3, '0'), strftime({sql_roc('roc_cell')}, '%m%d')) AS roc,
   {sql_bound('period_cell', 0)} AS start_d, {sql_bound('period_cell', 1)} AS end_d, CASE WHEN {sql_roc('roc_cell')} IS NULL THEN false ELSE true END AS valid FROM cells""")
def date_conversions(t: Tables) -> DataFrame:
    cells = t.cells().select("roc_cell", "period_cell")
    dated = cells.select(
        "roc_cell", dates.roc_date(F.col("roc_cell")).alias("d"),
        dates.interval_bound(F.col("period_cell"), 0).alias("start_d"), dates.interval_bound(F.col("period_cell"), 1).alias("end_d"))
    d = F.col("d")
    return dated.select(
        "roc_cell", "d", dates.iso_to_compact(d).alias("compact"), F.coalesce(dates.iso_to_roc(d), F.lit("")).alias("roc"),
        "start_d", "end_d", dates.is_valid_iso_date(d.cast("string")).alias("valid"),
    )


@query("display_moves", f"""SELECT code, d, CASE WHEN note IS NULL THEN round(close - change, 4) END AS prev_close, round(pct, 4) AS pct, {sql_signed_pct('pct', 2)} AS pct_text,
   CASE WHEN note IS NOT NULL OR change IS NULL THEN '' WHEN change > 0 THEN '▲' WHEN change < 0 THEN '▼' ELSE '—' END AS arrow, round(vol / 1000.0, 4) AS lots,
   CASE WHEN money >= 1e8 THEN concat({sql_fixed('money / 1e8', 2)}, ' 億') WHEN money >= 1e4 THEN concat({sql_fixed('money / 1e4', 1)}, ' 萬') ELSE concat(format('{{:,}}', CAST(floor(money + 0.5) AS BIGINT)), ' 元') END AS money,
   concat(CASE WHEN close < 0 THEN '-' ELSE '' END, {sql_fixed('close', 2)}) AS price_text FROM (
   SELECT *, CASE WHEN note IS NULL THEN 100 * change / nullif(close - change, 0) END AS pct, close * CASE code % 3 WHEN 0 THEN 3.7 WHEN 1 THEN 1234.5 ELSE 9876543.0 END::DOUBLE AS money
   FROM (SELECT *, close - open AS change FROM bars) y) x""")
def display_moves(t: Tables) -> DataFrame:
    b = t.bars().withColumn("change", F.col("close") - F.col("open"))
    close, change, note, k = F.col("close"), F.col("change"), F.col("note"), F.col("code") % 3
    pct = text.move_pct(close, change, note)
    money = close * F.when(k == 0, 3.7).when(k == 1, 1234.5).otherwise(9876543.0)
    return b.select(
        "code", "d", F.round(text.previous_close(close, change, note), 4).alias("prev_close"), F.round(pct, 4).alias("pct"), text.signed_pct(pct).alias("pct_text"),
        text.move_arrow(change, note.isNull()).alias("arrow"), F.round(text.lots(F.col("vol")), 4).alias("lots"), text.money_scale(money).alias("money"), text.format_price(close).alias("price_text"),
    )


# ── column maps ──────────────────────────────────────────────────────────────

CELL_OF = {
    "text": "text_cell", "number": "number_cell", "integer": "number_cell", "noted": "number_cell", "note": "number_cell",
    "zero": "number_cell", "positive": "number_cell", "per_thousand": "number_cell", "roc": "roc_cell", "ad": "ad_cell",
    "ad_or_roc": "mixed_cell", "flag": "flag_cell", "present": "flag_cell", "start": "period_cell", "end": "period_cell",
}
SQL_OF = {
    "text": sql_trim, "number": sql_number,
    "integer": lambda c: f"CASE WHEN ({sql_number(c)}) = floor({sql_number(c)}) THEN CAST({sql_number(c)} AS BIGINT) END",
    "noted": sql_number, "note": lambda c: f"CASE WHEN trim({c}) IN ('除權', '除息', '除權息') THEN trim({c}) END",
    "zero": lambda c: f"coalesce({sql_number(c)}, 0.0)", "positive": lambda c: f"coalesce({sql_number(c)}, 0.0) > 0",
    "per_thousand": lambda c: f"coalesce({sql_number(c)}, 0.0) / 1000.0", "roc": sql_roc, "ad": sql_ad,
    "ad_or_roc": lambda c: f"coalesce({sql_ad(c)}, {sql_roc(c)})", "flag": lambda c: f"trim({c}) IN ('Ｙ', 'Y')",
    "present": lambda c: f"trim({c}) <> ''", "start": lambda c: sql_bound(c, 0), "end": lambda c: sql_bound(c, 1),
}


def cell_for(name: str, field: str, kind: str, columns: dict) -> str:
    if name == "code":
        return "code_cell"
    shared = {k for f, k in columns.values() if f == field}
    return "period_cell" if shared & {"start", "end"} else CELL_OF[kind]


def source_rows(t: Tables, columns: dict) -> DataFrame:
    """Source rows with the publisher's field names, filled from the rendered cells."""
    return t.cells().select("market", source_row(columns))


def source_row(columns: dict) -> Column:
    """The row of named cells. It comes out of a generator, as each use of a field would otherwise render its cell again; the
    lambda keeps the cells out of the one generated method of the stage, which they make too long for the JVM to compile."""
    pairs = {field: cell_for(name, field, kind, columns) for name, (field, kind) in columns.items()}
    flat = [x for field, cell in pairs.items() for x in (F.lit(field), F.col(cell))]
    return F.explode(F.transform(F.array(F.create_map(*flat)), lambda row: row)).alias("row")


def map_sql(columns: dict, where: str = "true") -> str:
    exprs = ", ".join(f"{SQL_OF[kind](cell_for(n, f, kind, columns))} AS {n}" for n, (f, kind) in columns.items())
    need = " AND ".join([f"{n} IS NOT NULL" for n in columns if n in mapping.REQUIRED] + (["code <> ''"] if "code" in columns else []) or ["true"])
    return f"SELECT * FROM (SELECT market, {exprs} FROM cells WHERE {where}) x WHERE {need}"


def register_map(name: str, columns: dict) -> None:
    query(name, map_sql(columns))(lambda t: mapping.kept(mapping.normalize(source_rows(t, columns), columns, ("market",))))


def register_markets(name: str, maps: dict) -> None:
    names = list(dict.fromkeys(n for c in maps.values() for n in c))
    parts = []
    for m, columns in maps.items():
        present = ", ".join(n if n in columns else f"NULL AS {n}" for n in names)
        parts.append(f"SELECT market, {present} FROM ({map_sql(columns, f'market = {chr(39)}{m}{chr(39)}')}) y")

    def build(t: Tables) -> DataFrame:
        stacked = None
        for m, columns in maps.items():
            part = mapping.normalize(source_rows(t, columns).filter(F.col("market") == m), columns, ("market",))
            stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
        return mapping.kept(stacked).select("market", *names)

    query(name, " UNION ALL ".join(parts))(build)


register_markets("map_roster", mapping.ROSTER)
register_markets("map_quotes", mapping.QUOTES)
register_markets("map_valuations", mapping.VALUATIONS)
register_markets("map_flows", mapping.FLOWS)
register_markets("map_margins", mapping.MARGINS)
register_markets("map_attention", mapping.ATTENTION)
register_markets("map_disposition", mapping.DISPOSITION)
register_markets("map_suspension", mapping.SUSPENSION)
register_markets("map_altered", mapping.ALTERED)
register_map("map_margin_suspension", mapping.MARGIN_SUSPENSION)
register_markets("map_ex_right", mapping.EX_RIGHT)
register_map("map_ex_right_check", mapping.EX_RIGHT_CHECK)
register_markets("map_announcements", mapping.ANNOUNCEMENT)


REVENUE_CELLS = ", ".join(f"{SQL_OF[kind](cell_for(n, f, kind, mapping.REVENUE))} AS {n}" for n, (f, kind) in mapping.REVENUE.items())


@query("map_revenue", f"""SELECT market, {REVENUE_CELLS}, d AS report_date, period FROM (
     SELECT *, CASE WHEN id % 17 <> 0 THEN CAST(DATE '2024-01-01' + CAST(id % 30 AS INT) AS DATE) END AS d, CASE WHEN id % 9 <> 0 THEN strftime(DATE '2023-11-01' + CAST(id % 40 AS INT), '%Y-%m') END AS period FROM (
       SELECT c.*, l_suppkey % 100 AS id FROM cells c) y) x WHERE {SQL_OF['text']('code_cell')} <> '' AND d IS NOT NULL AND period IS NOT NULL""")
def map_revenue(t: Tables) -> DataFrame:
    """Revenue rows of a hundred snapshots, dated by them."""
    columns = mapping.REVENUE
    rows = t.cells(extra=(F.col("l_suppkey") % 100).alias("id")).select("market", "id", source_row(columns))
    i = F.col("id")
    ledger = t.spark.range(100).select(
        i, F.when(i % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int"))).alias("data_as_of"),
        F.when(i % 9 != 0, F.date_format(F.date_add(F.lit("2023-11-01").cast("date"), (i % 40).cast("int")), "yyyy-MM")).alias("data_period"))
    return mapping.kept(mapping.revenue_facts(rows, ledger, carry=("market",))).drop("id")


@query("map_official_index", f"SELECT market, d, value FROM ({map_sql(mapping.OFFICIAL_INDEX)}) x WHERE value > 0")
def map_official_index(t: Tables) -> DataFrame:
    return mapping.official_index(source_rows(t, mapping.OFFICIAL_INDEX), ("market",))


@query("skip_statistics", """SELECT market, CASE WHEN trim(code_cell) = '' THEN 'missing_code' ELSE 'kept' END AS outcome, count(*) AS n FROM cells GROUP BY 1, 2""")
def skip_statistics(t: Tables) -> DataFrame:
    columns = mapping.REVENUE
    return quality.skip_stats(mapping.normalize(source_rows(t, columns), columns, ("market",)), ["market"])


# ── audits ───────────────────────────────────────────────────────────────────


@query("constraint_audit_snapshots", f"""SELECT rule, rows, violations FROM (
   SELECT count(*) AS rows, count(*) FILTER (NOT regexp_matches(content_hash, '^[0-9a-f]{{64}}$')) AS content_hash_format,
     count(*) FILTER (NOT coalesce(data_period IS NULL OR regexp_matches(data_period, '^[0-9]{{4}}-[0-9]{{2}}$'), false)) AS data_period_format,
     count(*) FILTER (NOT coalesce(body_store IN ('file', 'r2'), false)) AS body_store,
     count(*) FILTER (NOT (reason IN ('single_date_in_payload', 'date_field_missing', 'invalid_json'))) AS date_reason FROM (
     SELECT *, CASE WHEN id % 9 = 0 THEN '2024-1' ELSE '2024-01' END AS data_period, CASE WHEN reason <> 'invalid_json' THEN 'file' END AS body_store FROM ledger) x) y
   UNPIVOT (violations FOR rule IN (content_hash_format, data_period_format, body_store, date_reason))""")
def constraint_audit_snapshots(t: Tables) -> DataFrame:
    rows = store.to_ledger_rows(t.ledger()).withColumn("data_period", F.when(F.col("id") % 9 == 0, "2024-1").otherwise("2024-01"))
    return quality.audit_table(rows, "snapshots")


@query("mutation_audit", """SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'inserted' WHEN b.k IS NULL THEN 'deleted'
   WHEN a.v <> b.v THEN 'changed' ELSE 'kept' END AS change FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 11 <> 0) a
   FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 13 <> 0) b ON a.k = b.k) x GROUP BY change""")
def mutation_audit(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = o.filter("o_orderkey % 11 <> 0")
    after = o.filter("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return quality.mutation_audit(before, after, ["o_orderkey"])


@query("no_backfill", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate >= DATE '1998-01-01'")
def no_backfill(t: Tables) -> DataFrame:
    return quality.no_backfill(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "d", "1998-01-01")


@query("exclude_probes", """SELECT o_orderkey, o_custkey, 'record' AS kind FROM orders WHERE o_orderkey % 1100 < 1000 AND o_orderkey < 900000000 AND o_orderkey % 7 <> 0
   UNION ALL SELECT o_orderkey, o_custkey, 'registry' FROM orders WHERE o_orderkey % 5 <> 0""")
def exclude_probes(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.orders.select(
        key, "o_custkey", (key % 1100).alias("revision"), F.concat(F.when(key % 7 == 0, "__probe").otherwise("m"), key.cast("string")).alias("message"),
        F.concat(F.when(key % 5 == 0, "probe_").when(key % 7 == 0, "__probe").otherwise("f"), key.cast("string")).alias("factor_key"))
    records = quality.exclude_probes(rows, revision="revision", key="message", ident="o_orderkey").withColumn("kind", F.lit("record"))
    registry = quality.exclude_probes(rows, key="factor_key", prefix=quality.REGISTRY_PROBE_PREFIX).withColumn("kind", F.lit("registry"))
    return records.unionByName(registry).select("o_orderkey", "o_custkey", "kind")
