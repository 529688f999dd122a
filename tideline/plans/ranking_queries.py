"""Ranking queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tideline.operators import align, ranking
from tideline.operators.scale import order_statistics
from tideline.plans.catalogue import query
from tideline.plans.oracle import sql_signed_pct
from tideline.plans.views import Tables
from tideline.session import materialise

FACTORS = list(ranking.FACTOR_DIRECTIONS)
DECIMALS = 9


def lower_is_better():
    return ranking.direction_of(F.col("factor"), ranking.FACTOR_DIRECTIONS) == ranking.LOWER


def quoted(t: Tables) -> DataFrame:
    bars = t.closes().filter(align.is_tradable())
    return align.in_universe(bars, t.roster())


def shifted_growth(t: Tables) -> DataFrame:
    """Yearly growth moved onto the bars' era, so that publication days fall inside it."""
    g = ranking.yearly_growth(t.revenue())
    period = F.add_months("period", 300)
    return g.select("code", period.alias("period"), F.date_add(F.add_months(period, 1), 9).alias("report_date"), "yoy")


def factor_long(t: Tables) -> DataFrame:
    """All five factors from one aggregation of the ticks and one window pass per code."""
    prev = F.lag("bal").over(W.partitionBy("code").orderBy("i"))
    # codes outside the roster leave before the windows: every window is per code
    daily = align.in_universe(t.daily(), t.roster()).join(t.cal(), "d").withColumn("prev", prev)
    q = ranking.with_reversal(daily).filter(align.is_tradable())
    facts = align.in_universe(shifted_growth(t), t.roster())
    wide = align.asof_join(q, facts, "d", ["yoy"], unique=True).select(
        "d", "code",
        F.col("yoy").alias("rev_yoy_momentum_v1"),
        ranking.factor_ratio(F.col("net_a"), F.col("vol")).alias("trust_net_buy_ratio_v1"),
        ranking.factor_change_rate(F.col("bal"), F.col("prev")).alias("margin_balance_change_v1"),
        F.col("reversal").alias("short_term_reversal_5d_v1"),
        ranking.factor_ratio(F.col("net_b"), F.col("vol")).alias("foreign_net_buy_ratio_v1"),
    )
    return ranking.factor_long(wide, ["d", "code"], FACTORS)


NEEDS = {f: 1 for f in FACTORS} | {"short_term_reversal_5d_v1": ranking.REVERSAL_DAYS + 1}


def activity(t: Tables) -> DataFrame:
    """State of every factor on every day, by the rows it is computed from."""
    rows = t.ticks().groupBy("d").agg(F.count_distinct("code").alias("n"))
    daily = rows.select("d", "n", F.explode(F.array(*[F.lit(f) for f in FACTORS if f != "rev_yoy_momentum_v1"])).alias("factor"))
    first = shifted_growth(t).groupBy("code").agg(F.min("report_date").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("_new"))
    # one row per calendar day: how many codes have published by then
    known = t.cal().select("d").withColumn("_asked", F.lit(True)).unionByName(first, allowMissingColumns=True)
    upto = F.sum(F.coalesce("_new", F.lit(0))).over(W.orderBy("d").rangeBetween(W.unboundedPreceding, W.currentRow))
    revenue = known.withColumn("n", upto).filter("_asked").select("d", "n", F.lit("rev_yoy_momentum_v1").alias("factor"))
    return ranking.factor_activity(daily.unionByName(revenue), NEEDS, t.cal().withColumnRenamed("i", "history_days"))


def scored(t: Tables) -> DataFrame:
    return ranking.score_cross_section(factor_long(t), lower_is_better())


def ranked(t: Tables) -> DataFrame:
    # each step is a job of its own; the activity, a row for each day and factor, is asked twice, the composites are sampled and dealt
    comp = ranking.composite(scored(t), t.step(activity(t))).withColumn("composite", F.round("composite", DECIMALS))
    return ranking.composite_rank(t.step(comp))


# ── minimum slice ────────────────────────────────────────────────────────────


def reversal_scored(t: Tables, closes: DataFrame | None = None) -> DataFrame:
    rev = ranking.reversal(align.in_universe(t.closes() if closes is None else closes, t.roster()), t.cal())
    long = rev.select(
        "d", "code", F.lit("short_term_reversal_5d_v1").alias("factor"), F.col("reversal").alias("value")
    )
    return ranking.score_cross_section(long, F.lit(True))


SLICE = """WITH v AS (SELECT r.* FROM rev5 r JOIN quoted q USING (code, d)),
  b AS (SELECT d, count(*) AS n, quantile_cont(reversal, 0.01) AS lo, quantile_cont(reversal, 0.99) AS hi FROM v GROUP BY d),
  w AS (SELECT v.d, v.code, v.reversal, n, greatest(least(reversal, hi), lo) AS winsorized FROM v JOIN b USING (d)),
  m AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY winsorized)
        + (count(*) OVER (PARTITION BY d, winsorized) - 1) / 2.0 AS midrank FROM w),
  s AS (SELECT *, CASE WHEN n = 1 THEN 0.5 ELSE 1 - (midrank - 1) / (n - 1) END AS score FROM m)"""


@query(
    "reversal_top5",
    SLICE + """ SELECT d, code, round(reversal, 9) AS reversal, round(score, 9) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY d ORDER BY round(score, 9) DESC, code) AS rank FROM s) z WHERE rank <= 5""",
)
def reversal_top5(t: Tables) -> DataFrame:
    s = reversal_scored(t).withColumn("score", F.round("score", DECIMALS))
    top = ranking.top_k(s, ["d"], [F.col("score").desc(), F.col("code")], ranking.WATCHLIST_SIZE)
    return top.select("d", "code", F.round("value", 9).alias("reversal"), "score", F.col("rank").cast("bigint").alias("rank"))


@query("reversal_values", "SELECT code, d, round(reversal, 9) AS reversal FROM rev5")
def reversal_values(t: Tables) -> DataFrame:
    return ranking.reversal(t.closes(), t.cal()).withColumn("reversal", F.round("reversal", 9))


@query("factor_values", "SELECT d, code, factor, round(value, 6) AS value FROM factor_long")
def factor_values(t: Tables) -> DataFrame:
    return factor_long(t).withColumn("value", F.round("value", 6))


@query("factor_coverage", """SELECT days.d, f.factor, count(l.code) AS n FROM (SELECT DISTINCT d FROM ticks) days
   CROSS JOIN (VALUES ('rev_yoy_momentum_v1'), ('trust_net_buy_ratio_v1'), ('margin_balance_change_v1'),
     ('short_term_reversal_5d_v1'), ('foreign_net_buy_ratio_v1')) f(factor)
   LEFT JOIN factor_long l ON l.d = days.d AND l.factor = f.factor GROUP BY days.d, f.factor""")
def factor_coverage(t: Tables) -> DataFrame:
    return ranking.coverage(factor_long(t), t.cal(), FACTORS)


@query("factor_activity", "SELECT d, factor, n, state FROM factor_inputs")
def factor_activity(t: Tables) -> DataFrame:
    return activity(t)


@query("factor_quantiles", """SELECT d, factor, n, round(lo, 6) AS lo, round(mid, 6) AS mid, round(hi, 6) AS hi FROM (
   SELECT d, factor, count(*) AS n, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.5) AS mid,
     quantile_cont(value, 0.99) AS hi FROM factor_long GROUP BY d, factor) x""")
def factor_quantiles(t: Tables) -> DataFrame:
    q = order_statistics(factor_long(t), ["d", "factor"], "value", {"lo": 0.01, "mid": 0.5, "hi": 0.99})
    return q.select("d", "factor", "n", *[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")])


@query("cross_section_scores", """SELECT d, code, factor, n, round(winsorized, 6) AS winsorized,
   round(midrank, 3) AS midrank, round(score, 9) AS score FROM scored""")
def cross_section_scores(t: Tables) -> DataFrame:
    return scored(t).select(
        "d", "code", "factor", "n", F.round("winsorized", 6).alias("winsorized"), F.round("midrank", 3).alias("midrank"),
        F.round("score", 9).alias("score"),
    )


@query("composite_ranking", "SELECT d, code, composite, real_factors, active, rank FROM ranked")
def composite_ranking(t: Tables) -> DataFrame:
    return ranked(t)


@query("daily_watchlist", "SELECT d, code, composite, rank FROM ranked WHERE rank <= 5")
def daily_watchlist(t: Tables) -> DataFrame:
    return ranking.watchlist(ranked(t)).select("d", "code", "composite", "rank")


def detail(t: Tables) -> DataFrame:
    return ranking.factor_detail(quoted(t).select("d", "code"), scored(t), activity(t))


DETAIL = """SELECT q.d, q.code, f.factor, CASE WHEN f.factor IN ('margin_balance_change_v1', 'short_term_reversal_5d_v1') THEN 'lower_is_better'
     ELSE 'higher_is_better' END AS direction, s.value AS raw, s.winsorized,
   coalesce(s.score, 0.5) AS score, s.score IS NULL AS imputed, a.n IS NOT NULL AS active
   FROM quoted q CROSS JOIN (VALUES ('rev_yoy_momentum_v1'), ('trust_net_buy_ratio_v1'), ('margin_balance_change_v1'),
     ('short_term_reversal_5d_v1'), ('foreign_net_buy_ratio_v1')) f(factor)
   LEFT JOIN active a ON a.d = q.d AND a.factor = f.factor
   LEFT JOIN scored s ON s.d = q.d AND s.code = q.code AND s.factor = a.factor"""


@query("factor_detail", f"""SELECT d, code, factor, direction, round(raw, 6) AS raw, round(winsorized, 6) AS winsorized,
   round(score, 9) AS score, imputed, active FROM ({DETAIL}) x""")
def factor_detail(t: Tables) -> DataFrame:
    return detail(t).select(
        "d", "code", "factor", "direction", F.round("raw", 6).alias("raw"), F.round("winsorized", 6).alias("winsorized"),
        F.round("score", 9).alias("score"), "imputed", "active",
    )


@query("factor_detail_nested", f"""SELECT d, code, count(*) AS entries, count(*) FILTER (direction = 'lower_is_better') AS lower_better, count(*) FILTER (imputed) AS imputed,
   round(sum(coalesce(score, 0)), 6) AS score_sum FROM ({DETAIL}) x GROUP BY d, code""")
def factor_detail_nested(t: Tables) -> DataFrame:
    n = ranking.nested_detail(detail(t))
    return n.select(
        "d", "code", F.size("factors").cast("bigint").alias("entries"),
        F.size(F.filter("factors", lambda e: e["direction"] == ranking.LOWER)).cast("bigint").alias("lower_better"),
        F.size(F.filter("factors", lambda e: e["imputed"])).cast("bigint").alias("imputed"),
        F.round(F.aggregate("factors", F.lit(0.0), lambda a, e: a + F.coalesce(e["score"], F.lit(0.0))), 6).alias("score_sum"),
    )


# Shown values are of the raw value to nine places, so that the last digit of a sum cannot turn a text.
SHOWN = "round(raw, 9)"
FACTOR_TEXT = f"""CASE factor WHEN 'rev_yoy_momentum_v1' THEN {sql_signed_pct(SHOWN, 1)} WHEN 'margin_balance_change_v1' THEN {sql_signed_pct(f'{SHOWN} * 100', 1)}
     WHEN 'short_term_reversal_5d_v1' THEN {sql_signed_pct(f'{SHOWN} * 100', 1)} ELSE concat('佔成交量 ', {sql_signed_pct(f'{SHOWN} * 100', 1)}) END"""


def coarse(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", F.round("raw", 9))


@query("factor_explanations", f"""SELECT d, code, factor,
   CASE factor WHEN 'rev_yoy_momentum_v1' THEN '月營收年增' WHEN 'trust_net_buy_ratio_v1' THEN '投信買超'
     WHEN 'margin_balance_change_v1' THEN '融資餘額' WHEN 'short_term_reversal_5d_v1' THEN '五日漲跌'
     ELSE '外資買超' END AS label,
   {FACTOR_TEXT} AS value_text,
   CASE WHEN factor IN ('margin_balance_change_v1', 'short_term_reversal_5d_v1') THEN 'lower' ELSE 'higher' END AS better_when
   FROM ({DETAIL}) x WHERE NOT imputed AND raw IS NOT NULL""")
def factor_explanations(t: Tables) -> DataFrame:
    return ranking.explain_factors(coarse(detail(t)))


@query("ranking_summary", """SELECT q.d, q.with_quote, q.tradable, coalesce(r.n, 0) AS ranked, q.tradable - coalesce(r.n, 0) AS no_data
   FROM (SELECT d, count(*) AS with_quote, count(*) FILTER (close > 0 AND coalesce(vol, 0) > 0) AS tradable
         FROM bars WHERE code IN (SELECT code FROM roster) GROUP BY d) q
   LEFT JOIN (SELECT d, count(*) AS n FROM ranked GROUP BY d) r USING (d)""")
def ranking_summary(t: Tables) -> DataFrame:
    return ranking.ranking_summary(align.in_universe(t.closes(), t.roster()), ranked(t))


@query("score_distribution", """SELECT d, count(*) AS n, max(composite) AS top, min(composite) AS low,
   list_sort(list(composite), 'DESC')[CAST(floor(count(*) / 2) AS INT) + 1] AS middle,
   count(*) FILTER (composite = top_c) AS ties_at_top
   FROM (SELECT *, max(composite) OVER (PARTITION BY d) AS top_c FROM ranked) x GROUP BY d""")
def score_distribution(t: Tables) -> DataFrame:
    return ranking.score_distribution(ranked(t))


def definitions(t: Tables) -> DataFrame:
    """A definition table: one row per factor seen in the data, with its own percentiles."""
    seen = factor_long(t).select("factor").distinct()
    return seen.select(
        "factor", F.lit(5.0).alias("lower_pct"), F.lit(95.0).alias("upper_pct"),
        ranking.direction_of(F.col("factor"), ranking.FACTOR_DIRECTIONS).alias("direction"),
    )


@query("ranking_from_definitions", """WITH b5 AS (SELECT d, factor, count(*) AS n, quantile_cont(value, 0.05) AS lo,
     quantile_cont(value, 0.95) AS hi FROM factor_long GROUP BY d, factor),
   w5 AS (SELECT l.d, l.code, l.factor, n, greatest(least(value, hi), lo) AS w FROM factor_long l JOIN b5 USING (d, factor)),
   m5 AS (SELECT *, rank() OVER (PARTITION BY d, factor ORDER BY w) + (count(*) OVER (PARTITION BY d, factor, w) - 1) / 2.0 AS m FROM w5),
   s5 AS (SELECT *, CASE WHEN n = 1 THEN 0.5 WHEN factor IN ('margin_balance_change_v1', 'short_term_reversal_5d_v1')
     THEN 1 - (m - 1) / (n - 1) ELSE (m - 1) / (n - 1) END AS score FROM m5),
   a5 AS (SELECT DISTINCT d, factor FROM active)
   SELECT q.d, q.code, round(avg(coalesce(s.score, 0.5)), 6) AS composite, count(s.score) AS real_factors
   FROM quoted q JOIN a5 a ON a.d = q.d LEFT JOIN s5 s ON s.d = q.d AND s.code = q.code AND s.factor = a.factor
   GROUP BY q.d, q.code HAVING count(s.score) > 0""")
def ranking_from_definitions(t: Tables) -> DataFrame:
    r = ranking.rank_on_definitions(factor_long(t), definitions(t), activity(t))
    return r.select("d", "code", F.round("composite", 6).alias("composite"), "real_factors")


LOOKBACKS = """v5 AS (SELECT a.d, a.code, k.factor, a.close / b.close - 1 AS value FROM bars a JOIN cal ca ON ca.d = a.d CROSS JOIN (VALUES ('reversal_5', 5), ('reversal_10', 10)) k(factor, days)
     JOIN cal cb ON cb.i = ca.i - k.days JOIN bars b ON b.code = a.code AND b.d = cb.d
     WHERE (SELECT count(*) FROM bars x JOIN cal cx ON cx.d = x.d WHERE x.code = a.code AND cx.i BETWEEN ca.i - k.days AND ca.i AND x.close > 0 AND x.note IS NULL) = k.days + 1)"""


def lookbacks(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("reversal_5", 5, 5.0, 95.0, ranking.LOWER), ("reversal_10", 10, 1.0, 99.0, ranking.HIGHER)], "factor string, days int, lower_pct double, upper_pct double, direction string")


@query("reversal_from_definitions", f"WITH {LOOKBACKS} SELECT d, code, factor, round(value, 9) AS value FROM v5")
def reversal_from_definitions(t: Tables) -> DataFrame:
    return ranking.reversal_by_definition(t.closes(), t.cal(), lookbacks(t)).withColumn("value", F.round("value", 9))


@query("ranking_from_lookbacks", f"""WITH {LOOKBACKS}, b AS (SELECT d, factor, count(*) AS n, quantile_cont(value, CASE factor WHEN 'reversal_5' THEN 0.05 ELSE 0.01 END) AS lo, quantile_cont(value, CASE factor WHEN 'reversal_5' THEN 0.95 ELSE 0.99 END) AS hi FROM v5 GROUP BY d, factor),
   w AS (SELECT v5.d, v5.code, v5.factor, n, greatest(least(value, hi), lo) AS w FROM v5 JOIN b USING (d, factor)),
   m AS (SELECT *, rank() OVER (PARTITION BY d, factor ORDER BY w) + (count(*) OVER (PARTITION BY d, factor, w) - 1) / 2.0 AS m FROM w),
   s AS (SELECT *, CASE WHEN n = 1 THEN 0.5 WHEN factor = 'reversal_5' THEN 1 - (m - 1) / (n - 1) ELSE (m - 1) / (n - 1) END AS score FROM m),
   a AS (SELECT DISTINCT d, factor FROM v5), q AS (SELECT DISTINCT d, code FROM v5)
   SELECT q.d, q.code, round(avg(coalesce(s.score, 0.5)), 6) AS composite, count(s.score) AS real_factors FROM q JOIN a ON a.d = q.d LEFT JOIN s ON s.d = q.d AND s.code = q.code AND s.factor = a.factor GROUP BY q.d, q.code""".replace("quantile_cont(value, CASE factor WHEN 'reversal_5' THEN 0.05 ELSE 0.01 END) AS lo, quantile_cont(value, CASE factor WHEN 'reversal_5' THEN 0.95 ELSE 0.99 END) AS hi",
   "CASE factor WHEN 'reversal_5' THEN quantile_cont(value, 0.05) ELSE quantile_cont(value, 0.01) END AS lo, CASE factor WHEN 'reversal_5' THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.99) END AS hi"))
def ranking_from_lookbacks(t: Tables) -> DataFrame:
    long = materialise(ranking.reversal_by_definition(t.closes(), t.cal(), lookbacks(t)))
    active = long.groupBy("d", "factor").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("active"))
    r = ranking.rank_on_definitions(long, lookbacks(t), active)
    return r.select("d", "code", F.round("composite", 6).alias("composite"), "real_factors")


@query("definition_mismatch", """SELECT factor, CASE WHEN a IS NULL THEN 'undefined' ELSE 'unimplemented' END AS problem FROM (
   SELECT coalesce(x.factor, y.factor) AS factor, x.factor AS a, y.factor AS b
   FROM (SELECT DISTINCT factor FROM factor_long UNION SELECT DISTINCT concat(p_brand, '/', p_size) FROM part) x
   FULL JOIN (SELECT DISTINCT factor FROM factor_long WHERE factor <> 'foreign_net_buy_ratio_v1'
     UNION SELECT DISTINCT concat(p_brand, '/', p_size + 1) FROM part) y ON x.factor = y.factor) z WHERE a IS NULL OR b IS NULL""")
def definition_mismatch(t: Tables) -> DataFrame:
    seen = factor_long(t).select("factor").distinct()
    brands = lambda n: t.part.select(F.concat("p_brand", F.lit("/"), (F.col("p_size") + n).cast("string")).alias("factor")).distinct()
    return ranking.definition_mismatch(
        seen.unionByName(brands(0)), seen.filter("factor <> 'foreign_net_buy_ratio_v1'").unionByName(brands(1))
    )
