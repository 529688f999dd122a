"""Calendar, roster, point-in-time and interval queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.operators import align, quality
from tideline.plans.catalogue import query
from tideline.plans.ranking_queries import quoted
from tideline.plans.views import Tables


@query("trading_calendar", "SELECT d, i FROM cal")
def trading_calendar(t: Tables) -> DataFrame:
    return t.cal()


@query("day_lookup", """WITH c2 AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (
     SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5) y)
   SELECT CAST(g AS DATE) AS d, (SELECT max(i) FROM c2 WHERE d <= g) AS prev_i, (SELECT min(i) FROM c2 WHERE d >= g) AS next_i
   FROM (SELECT unnest(generate_series((SELECT min(d) FROM c2), (SELECT max(d) FROM c2), INTERVAL 1 DAY)) AS g) x""")
def day_lookup(t: Tables) -> DataFrame:
    """Nobody trades on weekends."""
    cal = align.calendar(t.orders.filter(F.dayofweek("o_orderdate").between(2, 6)).select(F.col("o_orderdate").cast("date").alias("d")))
    return align.day_lookup(cal)


@query("dense_grid", """SELECT c.code, cal.i, cal.d, b.close, b.vol FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN cal
   LEFT JOIN bars b ON b.code = c.code AND b.d = cal.d""")
def dense_grid(t: Tables) -> DataFrame:
    return align.dense_grid(t.closes(), t.cal()).select("code", "i", "d", "close", "vol")


@query("calendar_faults", """SELECT i, d, CASE WHEN d <= prev THEN 'not_ascending' ELSE 'last_day_is_not_as_of' END AS fault FROM (
   SELECT *, lag(d) OVER (ORDER BY i) AS prev, lead(d) OVER (ORDER BY i) IS NULL AS is_last FROM (
     SELECT i, CASE WHEN i % 7 = 0 THEN CAST(d - INTERVAL 1 DAY AS DATE) ELSE d END AS d FROM cal) y) x WHERE d <= prev OR (is_last AND d <> DATE '2024-02-15')""")
def calendar_faults(t: Tables) -> DataFrame:
    cal = t.cal().withColumn("d", F.when(F.col("i") % 7 == 0, F.date_sub("d", 1)).otherwise(F.col("d")))
    return align.calendar_faults(cal, "2024-02-15")


@query("last_by_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_by_key(t: Tables) -> DataFrame:
    return align.last_by_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("merge_rosters", """SELECT coalesce(b.code, a.code) AS code, coalesce(b.name, a.name) AS name, CASE WHEN b.code IS NOT NULL THEN 'late' ELSE 'early' END AS origin
   FROM (SELECT c_custkey AS code, c_name AS name FROM customer WHERE c_custkey % 3 <> 0) a
   FULL JOIN (SELECT c_custkey AS code, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0) b ON a.code = b.code""")
def merge_rosters(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    early = c.filter("code % 3 <> 0").withColumn("origin", F.lit("early"))
    late = c.filter("code % 2 = 0").select("code", F.upper("name").alias("name"), F.lit("late").alias("origin"))
    return align.merge_rosters(early, late)


@query("inside_universe", "SELECT code, d, close FROM bars WHERE code IN (SELECT code FROM roster)")
def inside_universe(t: Tables) -> DataFrame:
    return align.in_universe(t.closes(), t.roster()).select("code", "d", "close")


@query("outside_universe", "SELECT d, count(*) AS n FROM bars WHERE code NOT IN (SELECT code FROM roster) GROUP BY d")
def outside_universe(t: Tables) -> DataFrame:
    return align.outside_universe(t.closes(), t.roster()).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query("missing_from_data", "SELECT code FROM roster WHERE code NOT IN (SELECT code FROM ticks)")
def missing_from_data(t: Tables) -> DataFrame:
    return align.missing_from_data(t.roster(), t.ticks())


def all_quotes(t: Tables) -> DataFrame:
    return t.closes().withColumn("vol", F.when(F.col("code") % 9 != 0, F.col("vol")))


UNIVERSE = """WITH q AS (SELECT code, max(CASE WHEN close > 0 AND code % 9 <> 0 THEN 1 ELSE 0 END) AS tradable, count(*) AS n FROM bars GROUP BY code),
   j AS (SELECT coalesce(r.market, 'NONE') AS market, r.code AS inside, q.tradable, q.n FROM roster r FULL JOIN q ON q.code = r.code),
   s AS (SELECT coalesce(market, 'ALL') AS market, count(inside) AS roster_size, count(*) FILTER (inside IS NOT NULL AND n IS NOT NULL) AS with_quote,
     count(*) FILTER (inside IS NOT NULL AND tradable = 1) AS tradable, CAST(coalesce(sum(n) FILTER (inside IS NULL), 0) AS BIGINT) AS excluded_rows FROM j GROUP BY ROLLUP (market))"""


@query("universe_summary", UNIVERSE + " SELECT * FROM s")
def universe_summary(t: Tables) -> DataFrame:
    return align.summarize_universe(t.roster(), all_quotes(t))


@query("coverage_gate", UNIVERSE + " SELECT market, round(with_quote / nullif(roster_size, 0), 9) AS coverage, coalesce(with_quote / nullif(roster_size, 0) > 0.99, false) AS passed FROM s")
def coverage_gate(t: Tables) -> DataFrame:
    gate = quality.coverage_gate(align.summarize_universe(t.roster(), all_quotes(t)))
    return gate.withColumn("coverage", F.round("coverage", 9))


@query("misaligned_sources", "SELECT source_id, id, data_as_of FROM ledger WHERE data_as_of IS DISTINCT FROM DATE '2024-01-15'")
def misaligned_sources(t: Tables) -> DataFrame:
    return align.misaligned_sources(t.ledger(), F.lit("2024-01-15").cast("date")).select("source_id", "id", "data_as_of")


@query("same_run", """SELECT a.event_id, coalesce(bool_or(b.event_id IS NOT NULL), false) AS same_run FROM (SELECT * FROM ticks WHERE event_type = 'click') a
   LEFT JOIN (SELECT * FROM ticks WHERE event_type = 'error') b ON a.code = b.code AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000 GROUP BY a.event_id""")
def same_run(t: Tables) -> DataFrame:
    e = t.ticks().select("event_id", "code", "ts", "event_type")
    return align.same_run(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), "ts", ["code"]).select("event_id", "same_run")


@query("source_usable", """WITH newest AS (SELECT event_type AS source_id, max_by(d, event_id) AS data_as_of, max_by(ts, event_id) AS fetched_at FROM ticks WHERE event_type <> 'signup' GROUP BY event_type),
   want AS (SELECT event_type AS source_id, max(ts) - INTERVAL 2 HOUR AS run_at, bool_or(event_type = 'click' OR event_type = 'view') AS needs_date, DATE '2024-01-30' AS signal_date FROM ticks GROUP BY event_type)
   SELECT source_id, state, state = 'ok' AS usable FROM (SELECT w.source_id, CASE WHEN n.source_id IS NULL THEN 'absent' WHEN abs(epoch_us(fetched_at) - epoch_us(run_at)) > 3600000000 * 6 THEN 'other_run'
     WHEN needs_date AND data_as_of IS DISTINCT FROM signal_date THEN 'other_date' ELSE 'ok' END AS state FROM want w LEFT JOIN newest n USING (source_id)) x""")
def source_usable(t: Tables) -> DataFrame:
    e = t.ticks()
    stamp = F.col("ts").cast("timestamp")
    ledger = e.filter("event_type <> 'signup'").select(F.col("event_type").alias("source_id"), F.col("event_id").alias("id"), F.col("d").alias("data_as_of"), stamp.alias("fetched_at"))
    want = e.groupBy(F.col("event_type").alias("source_id")).agg((F.max(stamp) - F.expr("INTERVAL 2 HOURS")).alias("run_at")).select(
        "source_id", "run_at", F.col("source_id").isin("click", "view").alias("needs_date"), F.lit("2024-01-30").cast("date").alias("signal_date"))
    return align.source_usable(want, ledger)


@query("union_markets", """SELECT code, d, close FROM bars WHERE code % 2 = 0 AND day(d) % 4 <> 0 UNION ALL
   SELECT code, d, close FROM bars WHERE code % 2 = 1 AND d IN (SELECT d FROM bars WHERE code % 2 = 0 AND day(d) % 4 <> 0)""")
def union_markets(t: Tables) -> DataFrame:
    b = t.closes().select("code", "d", "close")
    return align.union_markets(b.filter((F.col("code") % 2 == 0) & (F.dayofmonth("d") % 4 != 0)), b.filter("code % 2 = 1"))


def repeated_revenue(t: Tables) -> DataFrame:
    """Revenue facts as they arrive: some stated again, with another amount, for the same period and day."""
    r = t.revenue()
    again = r.filter("code % 3 = 0").select("code", "period", "report_date", (F.col("amount") * 2).alias("amount"), F.lit(1).alias("pos"))
    return r.withColumn("pos", F.lit(2)).unionByName(again)


@query("point_in_time_latest", """SELECT code, period, report_date, round(amount, 2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY period DESC, report_date DESC) AS n
   FROM (SELECT code, period, report_date, CASE WHEN code % 3 = 0 THEN amount * 2 ELSE amount END AS amount FROM revenue) r WHERE report_date <= DATE '1998-06-30') x WHERE n = 1""")
def point_in_time_latest(t: Tables) -> DataFrame:
    out = align.point_in_time_latest(repeated_revenue(t), F.lit("1998-06-30").cast("date"), pos="pos")
    return out.select("code", "period", "report_date", F.round("amount", 2).alias("amount"))


@query("asof_revenue", """WITH stated AS (SELECT code, period, report_date, CASE WHEN code % 3 = 0 THEN amount * 2 ELSE amount END AS amount FROM revenue)
   SELECT o.o_orderkey, r.period, r.report_date, round(r.amount, 2) AS amount FROM (SELECT o_orderkey, o_custkey AS code, CAST(o_orderdate AS DATE) AS d FROM orders) o
   ASOF LEFT JOIN stated r ON o.code = r.code AND o.d >= r.report_date""")
def asof_revenue(t: Tables) -> DataFrame:
    picks = t.orders.select("o_orderkey", F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("d"))
    return align.asof_join(picks, repeated_revenue(t), "d", ["amount"], pos="pos").select("o_orderkey", "period", "report_date", F.round("amount", 2).alias("amount"))


@query("interval_cover", """SELECT q.code, q.d, min(n.pos) AS pos FROM quoted q JOIN notices n ON n.code = q.code
   AND (n.start_d IS NULL OR n.end_d IS NULL OR q.d BETWEEN n.start_d AND n.end_d) GROUP BY q.code, q.d""")
def interval_cover(t: Tables) -> DataFrame:
    return align.interval_cover(quoted(t).select("code", "d"), t.notices().select("pos", "code", "start_d", "end_d"))


@query("open_interval_active", """SELECT q.code, q.d, min(n.pos) AS pos FROM quoted q JOIN notices n ON n.code = q.code AND (n.end_d IS NULL OR n.end_d > q.d) GROUP BY q.code, q.d""")
def open_interval_active(t: Tables) -> DataFrame:
    return align.open_interval_active(quoted(t).select("code", "d"), t.notices().select("pos", "code", F.col("end_d").alias("resume_d")))


@query("incremental_new", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS INT) FROM orders WHERE o_orderkey % 2 = 0)")
def incremental_new(t: Tables) -> DataFrame:
    existing = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return align.incremental_new(t.lineitem.select("l_orderkey", "l_linenumber"), existing, ["l_orderkey", "l_linenumber"])


@query("grouped_notices", "SELECT code, pos, k, row_number() OVER (PARTITION BY code ORDER BY pos) AS member_no FROM notices")
def grouped_notices(t: Tables) -> DataFrame:
    return align.group_rows(t.notices(), ["code"], ["k"], "pos")
