"""Outcome, corporate-action and benchmark queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.operators import benchmark, outcomes, ranking
from tideline.plans.catalogue import query
from tideline.plans.ranking_queries import DECIMALS, detail, reversal_scored
from tideline.plans.source_queries import CLEAN_DAYS, HEALTH, clean_streaks
from tideline.plans.views import Tables

BENCHMARK_CODE = 3


def stored_bars(t: Tables) -> DataFrame:
    """The daily bars as a stored table: evaluation reads them several times, their ticks are aggregated once."""
    return t.once("bars", lambda t: t.bars())


def picks(t: Tables) -> DataFrame:
    """The pick log: a stored table, written once per run and read by every evaluation step."""
    return t.once("picks", pick_rows)


def pick_rows(t: Tables) -> DataFrame:
    """Top-5 reversal names per day; even ranks are signals with barriers."""
    closes = stored_bars(t).select("code", "d", "close", "vol", "note")
    s = reversal_scored(t, closes).withColumn("score", F.round("score", DECIMALS))
    top = ranking.top_k(s, ["d"], [F.col("score").desc(), F.col("code")], ranking.WATCHLIST_SIZE).select("d", "code", "rank", "score")
    signal = F.col("rank") % 2 == 0
    placed = top.join(t.cal(), "d").join(closes.select("code", "d", F.col("close").alias("entry")), ["code", "d"])
    return placed.select(
        (F.col("i") * 10 + F.col("rank")).alias("pick_id"), "code", "d", F.col("rank").cast("bigint").alias("rank"), "score", "entry",
        F.when(signal, 0.9 * F.col("entry")).alias("stop"), F.when(signal, 1.2 * F.col("entry")).alias("target"),
        F.when(signal, "trade_signal").otherwise("watchlist").alias("list_kind"))


def scored_picks(t: Tables) -> DataFrame:
    """The outcome log, likewise stored once."""
    return t.once("outcomes", outcome_rows)


def outcome_rows(t: Tables) -> DataFrame:
    p = picks(t)
    done = outcomes.compute_outcomes(p.select("pick_id", "code", "d", "entry", "stop", "target"), stored_bars(t), t.cal(), t.actions())
    return done


@query("merged_actions", "SELECT code, ex_date, cash, ratio, rights, batch FROM merged")
def merged_actions(t: Tables) -> DataFrame:
    return outcomes.merge_events(t.actions())


def intervals(t: Tables) -> DataFrame:
    return t.closes().select("code", F.col("d").alias("from_d"), F.date_add("d", 9).alias("to_d"), "close")


ADJ = """WITH iv AS (SELECT code, d AS from_d, CAST(d + INTERVAL 9 DAY AS DATE) AS to_d, close FROM bars),
   ie AS (SELECT iv.code, from_d, to_d, e.ex_date, e.cash, e.ratio, e.rights, product(1 + e.ratio) OVER (PARTITION BY iv.code, from_d ORDER BY e.ex_date) AS f
     FROM iv JOIN merged e ON e.code = iv.code AND e.ex_date > from_d AND e.ex_date <= to_d),
   ia AS (SELECT code, from_d, last(f ORDER BY ex_date) AS f, sum(cash * f / (1 + ratio)) AS c, count(*) AS n, bool_or(rights) AS r FROM ie GROUP BY code, from_d)"""


@query("holding_adjustments", ADJ + """ SELECT iv.code, iv.from_d, round(coalesce(f, 1.0), 9) AS factor, round(coalesce(c, 0.0), 12) AS cash, coalesce(n, 0) AS events, coalesce(r, false) AS rights
   FROM iv LEFT JOIN ia ON ia.code = iv.code AND ia.from_d = iv.from_d""")
def holding_adjustments(t: Tables) -> DataFrame:
    out = outcomes.adjustment_for(intervals(t), t.actions())
    return out.select("code", "from_d", F.round("factor", 9).alias("factor"), F.round("cash", 12).alias("cash"), "events", "rights")


@query("adjusted_barriers", ADJ + """ SELECT iv.code, iv.from_d, round((0.9::DOUBLE * close - coalesce(c, 0.0)) / coalesce(f, 1.0), 6) AS adjusted FROM iv LEFT JOIN ia ON ia.code = iv.code AND ia.from_d = iv.from_d""")
def adjusted_barriers(t: Tables) -> DataFrame:
    levels = intervals(t).withColumn("level", 0.9 * F.col("close"))
    return outcomes.adjust_barrier(levels, t.actions(), "level").select("code", "from_d", F.round("adjusted", 6).alias("adjusted"))


@query("reference_prices", """SELECT a.code, a.ex_date, round((b.close - a.cash) / (1 + a.ratio), 6) AS computed,
   abs((b.close - a.cash) / (1 + a.ratio) - b.open) <= 5 AS agrees FROM merged a JOIN bars b ON b.code = a.code AND b.d = a.ex_date""")
def reference_prices(t: Tables) -> DataFrame:
    bars = t.bars().select("code", F.col("d").alias("ex_date"), F.col("close").alias("close_before"), F.col("open").alias("official"))
    checks = outcomes.merge_events(t.actions()).join(bars, ["code", "ex_date"])
    return outcomes.reference_check(checks, 5.0).select("code", "ex_date", F.round("computed", 6).alias("computed"), "agrees")


@query("pick_outcomes", """SELECT pick_id, horizon, status, exit_date, CASE WHEN status = 'computed' THEN xclose END AS exit_price, round(raw_pct, 6) AS raw_return_pct,
   round(adj_pct, 6) AS adjusted_return_pct, round(f, 9) AS share_factor, round(c, 6) AS cash_per_share, r AS has_rights, n AS ex_right_count,
   CASE WHEN status = 'not_mature' OR stop IS NULL THEN NULL WHEN touch_k IS NULL THEN 'time' ELSE (SELECT kind FROM touches t WHERE t.pick_id = o.pick_id AND t.k = touch_k) END AS barrier_touched,
   CASE WHEN status <> 'not_mature' THEN (SELECT day FROM touches t WHERE t.pick_id = o.pick_id AND t.k = touch_k) END AS touch_date,
   CASE WHEN status = 'not_mature' THEN 0 ELSE horizon END AS trading_days_used FROM outcomes o""")
def pick_outcomes(t: Tables) -> DataFrame:
    o = scored_picks(t)
    rounded = {"raw_return_pct": 6, "adjusted_return_pct": 6, "share_factor": 9, "cash_per_share": 6}
    return o.drop("code", "d").withColumns({c: F.round(c, n) for c, n in rounded.items()})


@query("outcome_status_counts", "SELECT horizon, status, count(*) AS n FROM outcomes GROUP BY horizon, status")
def outcome_status_counts(t: Tables) -> DataFrame:
    return outcomes.status_counts(scored_picks(t))


@query("outcome_summary", """SELECT horizon, count(*) AS n, round(avg(adj_pct), 6) AS mean_adjusted, round(list_sort(list(adj_pct))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS middle,
   round(avg(raw_pct), 6) AS mean_raw, round(avg(adj_pct) - avg(raw_pct), 6) AS gap, count(*) FILTER (n > 0) AS with_actions FROM outcomes WHERE status = 'computed' GROUP BY horizon""")
def outcome_summary(t: Tables) -> DataFrame:
    s = outcomes.outcome_summary(scored_picks(t))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_adjusted", "middle", "mean_raw", "gap")})


@query("stored_outcomes_skipped", "SELECT pick_id, horizon FROM outcomes WHERE status = 'computed' AND NOT (pick_id % 3 = 0 AND horizon = 5)")
def stored_outcomes_skipped(t: Tables) -> DataFrame:
    from tideline.operators.align import incremental_new

    done = scored_picks(t).filter(F.col("status") == outcomes.COMPUTED).select("pick_id", "horizon")
    stored = picks(t).filter("pick_id % 3 = 0").select("pick_id", F.lit(5).alias("horizon"))
    return incremental_new(done, stored, ["pick_id", "horizon"])


# ── benchmark ────────────────────────────────────────────────────────────────


def observations(t: Tables) -> DataFrame:
    done = scored_picks(t).filter(F.col("status") == outcomes.COMPUTED).select(
        "pick_id", "horizon", F.col("d").alias("from_d"), F.col("exit_date").alias("to_d"), F.col("adjusted_return_pct").alias("asset_pct"))
    asked = done.withColumn("code", F.lit(BENCHMARK_CODE).cast("bigint"))
    closes = t.closes().filter(F.col("code") == BENCHMARK_CODE)
    actions = t.actions().filter(F.col("code") == BENCHMARK_CODE)
    matched = benchmark.benchmark_return(asked, closes, actions)
    kinds = picks(t).select("pick_id", "list_kind")
    return matched.join(kinds, "pick_id").select(
        "pick_id", "horizon", "list_kind", "asset_pct", (100 * F.col("benchmark_return")).alias("benchmark_pct"))


@query("benchmark_returns", "SELECT pick_id, horizon, list_kind, round(asset_pct, 6) AS asset_pct, round(benchmark_pct, 6) AS benchmark_pct FROM observed")
def benchmark_returns(t: Tables) -> DataFrame:
    return observations(t).withColumns({c: F.round(c, 6) for c in ("asset_pct", "benchmark_pct")})


@query("excess_returns", "SELECT pick_id, horizon, round(asset_pct - benchmark_pct, 6) AS excess_pct FROM observed WHERE benchmark_pct IS NOT NULL")
def excess_returns(t: Tables) -> DataFrame:
    return benchmark.excess(observations(t)).select("pick_id", "horizon", F.round("excess_pct", 6).alias("excess_pct"))


COMPARE = """count(benchmark_pct) AS n, count(*) - count(benchmark_pct) AS unmatched, round(coalesce(avg(asset_pct) FILTER (benchmark_pct IS NOT NULL), 0), 6) AS mean_asset,
   round(coalesce(avg(benchmark_pct), 0), 6) AS mean_benchmark, round(coalesce(avg(asset_pct - benchmark_pct), 0), 6) AS mean_excess,
   round(coalesce(stddev_samp(asset_pct - benchmark_pct), 0), 6) AS stdev_excess, round(avg(asset_pct - benchmark_pct) / nullif(stddev_samp(asset_pct - benchmark_pct), 0), 6) AS mean_over_stdev,
   count(*) FILTER (asset_pct > benchmark_pct) AS beat_count, CASE WHEN count(benchmark_pct) < 30 THEN 'insufficient_sample' WHEN avg(asset_pct - benchmark_pct) > 0 THEN 'beats_benchmark' ELSE 'does_not_beat' END AS status"""
MEASURES = ("mean_asset", "mean_benchmark", "mean_excess", "stdev_excess", "mean_over_stdev")


def rounded(df: DataFrame, columns=MEASURES) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("benchmark_comparison", f"SELECT horizon, {COMPARE} FROM observed GROUP BY horizon")
def benchmark_comparison(t: Tables) -> DataFrame:
    return rounded(benchmark.compare_to_benchmark(observations(t), ["horizon"]))


@query("horizon_report", f"SELECT horizon, list_kind, {COMPARE} FROM observed GROUP BY CUBE (horizon, list_kind)")
def horizon_report(t: Tables) -> DataFrame:
    return rounded(benchmark.horizon_report(observations(t)))


@query("split_comparison", """WITH c AS (SELECT horizon, list_kind, avg(asset_pct - benchmark_pct) AS m, count(benchmark_pct) AS n FROM observed GROUP BY horizon, list_kind),
   w AS (SELECT horizon, max(m) FILTER (list_kind = 'watchlist') AS wm, max(n) FILTER (list_kind = 'watchlist') AS wn, max(m) FILTER (list_kind = 'trade_signal') AS sm, max(n) FILTER (list_kind = 'trade_signal') AS sn FROM c GROUP BY horizon)
   SELECT horizon, round(wm, 6) AS watch_excess, round(sm, 6) AS signal_excess, CASE WHEN coalesce(wn, 0) < 30 OR coalesce(sn, 0) < 30 THEN 'not_enough_samples' WHEN wm > 0 AND sm <= 0 THEN 'later_layers_lose'
     WHEN wm <= 0 AND sm > 0 THEN 'later_layers_help' WHEN wm > 0 THEN 'both_beat' ELSE 'both_lose' END AS reading FROM w""")
def split_comparison(t: Tables) -> DataFrame:
    return rounded(benchmark.compare_split(observations(t)), ("watch_excess", "signal_excess")).select("horizon", "watch_excess", "signal_excess", "reading")


@query("total_return_index", "SELECT code, d, round(log10(total_return_index), 8) AS log_index FROM tri WHERE total_return_index IS NOT NULL UNION ALL SELECT code, d, NULL FROM tri WHERE total_return_index IS NULL")
def total_return_index(t: Tables) -> DataFrame:
    out = benchmark.total_return_index(t.closes(), t.cal(), t.actions())
    # compared by its logarithm: an index may grow beyond what absolute rounding can compare
    return out.select("code", "d", F.round(F.log10("total_return_index"), 8).alias("log_index"))


@query("max_drawdown", """SELECT code, round(max(coalesce((peak - v) / nullif(peak, 0), 0)), 6) AS max_drawdown FROM (SELECT code, total_return_index AS v,
   max(total_return_index) OVER (PARTITION BY code ORDER BY i) AS peak FROM tri) x GROUP BY code""")
def max_drawdown(t: Tables) -> DataFrame:
    out = benchmark.max_drawdown(benchmark.placed_index(t.closes(), t.cal(), t.actions()))
    return out.withColumn("max_drawdown", F.round("max_drawdown", 6))


@query("period_returns", "SELECT code, round(max_by(close, d) / min_by(close, d) - 1, 6) AS period_return FROM bars GROUP BY code")
def period_returns(t: Tables) -> DataFrame:
    out = benchmark.period_return(t.closes(), "close")
    return out.withColumn("period_return", F.round("period_return", 6))


@query("official_index", """WITH s AS (SELECT code AS series, d, event_id AS pos, value FROM ticks WHERE event_type = 'view' AND d >= DATE '2024-01-05'),
   f AS (SELECT series, d, min_by(value, pos) AS v FROM s GROUP BY series, d), o AS (SELECT series, min_by(v, d) AS o FROM f GROUP BY series)
   SELECT f.series, f.d, v AS close, round(v / o * 100, 6) AS total_return_index FROM f JOIN o USING (series) WHERE o > 0""")
def official_index(t: Tables) -> DataFrame:
    snaps = t.ticks().filter("event_type = 'view'").select(F.col("code").alias("series"), "d", F.col("event_id").alias("pos"), "value")
    out = benchmark.official_index(snaps, "2024-01-05")
    return out.withColumn("total_return_index", F.round("total_return_index", 6))


R_MULTIPLES = "rm AS (SELECT o.*, adj_pct / 10.0 AS rmul FROM outcomes o WHERE status = 'computed' AND list_kind = 'trade_signal')"


def r_multiples(t: Tables) -> DataFrame:
    """Signals' adjusted return over the 10 % planned risk."""
    done = scored_picks(t).filter(F.col("status") == outcomes.COMPUTED)
    kinds = picks(t).filter("list_kind = 'trade_signal'").select("pick_id")
    return done.join(kinds, "pick_id", "left_semi").withColumn("r_multiple", F.col("adjusted_return_pct") / 10.0)


@query("signal_performance", f"""WITH {R_MULTIPLES} SELECT horizon, count(*) AS n, round(avg(rmul), 6) AS expectancy_r,
   round(coalesce(sum(rmul) FILTER (rmul > 0), 0) / nullif(coalesce(-sum(rmul) FILTER (rmul < 0), 0), 0), 6) AS profit_factor, count(*) FILTER (rmul > 0) AS wins FROM rm GROUP BY horizon""")
def signal_performance(t: Tables) -> DataFrame:
    return rounded(benchmark.signal_performance(r_multiples(t)), ("expectancy_r", "profit_factor"))


DECAY = """WITH ob AS (SELECT o.horizon, s.factor, s.d, s.score AS s, o.asset_pct - o.benchmark_pct AS e FROM observed o JOIN scored s ON s.d = o.d AND s.code = o.code WHERE o.benchmark_pct IS NOT NULL),
   days AS (SELECT horizon, factor, d, row_number() OVER (PARTITION BY horizon, factor ORDER BY d) AS n FROM (SELECT DISTINCT horizon, factor, d FROM ob) x),
   w AS (SELECT a.horizon, a.factor, a.d, a.n - b.n < {last} AS recent, s, e FROM days a JOIN days b ON b.horizon = a.horizon AND b.factor = a.factor AND b.n <= a.n JOIN ob ON ob.horizon = b.horizon AND ob.factor = b.factor AND ob.d = b.d),
   g AS (SELECT horizon, factor, d, avg(e) FILTER (recent) AS recent_excess, avg(e) AS mean_excess,
     CASE WHEN count(*) * sum(s * s) - sum(s) * sum(s) > 1e-9 * count(*) * sum(s * s) AND count(*) * sum(e * e) - sum(e) * sum(e) > 1e-9 * count(*) * sum(e * e) THEN corr(s, e) END AS corr,
     CASE WHEN count(*) FILTER (recent) * sum(s * s) FILTER (recent) - pow(sum(s) FILTER (recent), 2) > 1e-9 * count(*) FILTER (recent) * sum(s * s) FILTER (recent)
       AND count(*) FILTER (recent) * sum(e * e) FILTER (recent) - pow(sum(e) FILTER (recent), 2) > 1e-9 * count(*) FILTER (recent) * sum(e * e) FILTER (recent) THEN corr(s, e) FILTER (recent) END AS recent_corr FROM w GROUP BY horizon, factor, d)
   SELECT horizon, factor, d, round(recent_excess, 3) AS recent_excess, round(mean_excess, 3) AS mean_excess, round(corr, 4) AS corr, round(recent_corr, 4) AS recent_corr, round(corr - recent_corr, 4) AS decay FROM g"""


def decay_rows(t: Tables, last: int) -> DataFrame:
    seen = benchmark.excess(observations(t)).join(picks(t).select("pick_id", "d", "code"), "pick_id")
    scores = detail(t).filter("raw is not null").select("d", "code", "factor", "score")
    out = benchmark.factor_decay(seen.join(scores, ["d", "code"]), last, ("horizon", "factor"))
    places = {"recent_excess": 3, "mean_excess": 3, "corr": 4, "recent_corr": 4, "decay": 4}
    return out.select("horizon", "factor", "d", *[F.round(c, n).alias(c) for c, n in places.items()])


@query("factor_decay", DECAY.format(last=60))
def factor_decay(t: Tables) -> DataFrame:
    return decay_rows(t, 60)


@query("factor_decay_ten_days", DECAY.format(last=10))
def factor_decay_ten_days(t: Tables) -> DataFrame:
    return decay_rows(t, 10)


@query("watchlist_turnover", """SELECT p.d, count(*) AS names, count(*) FILTER (q.code IS NULL) AS entered, round(count(*) FILTER (q.code IS NULL) / count(*), 6) AS turnover
   FROM picks p LEFT JOIN picks q ON q.code = p.code AND q.i = p.i - 1 GROUP BY p.d""")
def watchlist_turnover(t: Tables) -> DataFrame:
    out = benchmark.turnover(picks(t).select("d", "code").join(t.cal(), "d"))
    return out.withColumn("turnover", F.round("turnover", 6))


@query("performance_gates", f"""{HEALTH}, {CLEAN_DAYS}, {R_MULTIPLES}, perf AS (SELECT horizon, avg(rmul) AS e, coalesce(sum(rmul) FILTER (rmul > 0), 0) / nullif(coalesce(-sum(rmul) FILTER (rmul < 0), 0), 0) AS pf FROM rm GROUP BY horizon),
   g1 AS (SELECT count(DISTINCT (d, code)) AS n, (year(max(d)) - year(min(d))) * 12 + month(max(d)) - month(min(d)) + (day(max(d)) - day(min(d))) / 31.0 AS m FROM picks WHERE list_kind = 'trade_signal'),
   g3 AS (SELECT horizon, count(benchmark_pct) AS n, avg(asset_pct - benchmark_pct) AS m FROM observed GROUP BY horizon),
   g4 AS (SELECT count(*) FILTER ((event_type = 'purchase') = ((t.d, t.code) IN (SELECT d, code FROM picks))) / count(*) AS share FROM ticks t WHERE event_type IN ('purchase', 'view'))
   SELECT 'G1' AS gate, CAST(NULL AS INT) AS horizon, round(n::DOUBLE, 6) AS measure, n >= 100 AND m >= 6 AS passed FROM g1
   UNION ALL SELECT 'G2', horizon, round(pf, 6), coalesce(e > 0 AND pf > 1.3, false) FROM perf
   UNION ALL SELECT 'G3', horizon, round(coalesce(m, 0), 6), coalesce(n >= 30 AND m > 0, false) FROM g3
   UNION ALL SELECT 'G4', NULL, round(share, 6), share > 0.9 FROM g4
   UNION ALL SELECT 'G5', NULL, min(latest_streak)::DOUBLE, min(latest_streak) >= 60 FROM streaks""")
def performance_gates(t: Tables) -> DataFrame:
    perf = benchmark.signal_performance(r_multiples(t))
    comp = benchmark.compare_to_benchmark(observations(t), ["horizon"])
    records = t.ticks().filter("event_type in ('purchase', 'view')").select(
        "d", "code", F.when(F.col("event_type") == "purchase", "buy").otherwise("watch").alias("action"))
    p = picks(t)
    out = benchmark.performance_gates(p.filter("list_kind = 'trade_signal'"), perf, comp, benchmark.record_agreement(p, records), clean_streaks(t))
    return out.withColumn("measure", F.round("measure", 6))
