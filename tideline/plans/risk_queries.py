"""Volatility, cost, sizing and limit queries over the driver tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from tideline.operators import cost, risk
from tideline.plans.catalogue import query
from tideline.plans.views import Tables

CONFIG = risk.RiskConfig()
FEE = "greatest(({0}) * 1425 // 100000000, 20)"
TAX = "(({0}) * {1} // 100000000)"


def fees(e: str, x: str, n: str, ppm: str = "3000") -> str:
    return f"({FEE.format(f'{e} * {n}')} + {FEE.format(f'{x} * {n}')} + {TAX.format(f'{x} * {n}', ppm)})"


def net(e: str, x: str, n: str, ppm: str = "3000") -> str:
    return f"(({x} - {e}) * {n} - 100 * {fees(e, x, n, ppm)})"


def half_up(a: str, b: str) -> str:
    return f"(CASE WHEN {a} < 0 THEN -((2 * -({a}) + {b}) // (2 * {b})) ELSE (2 * ({a}) + {b}) // (2 * {b}) END)"


# ── volatility ───────────────────────────────────────────────────────────────


def closes(t: Tables) -> DataFrame:
    return t.bars().select("code", "d", "close").join(t.cal(), "d")


def returns(t: Tables) -> DataFrame:
    return risk.log_returns(closes(t))


@query("log_returns", "SELECT code, d, round(r, 9) AS r FROM returns")
def log_returns(t: Tables) -> DataFrame:
    return returns(t).select("code", "d", F.round("r", 9).alias("r"))


EWM = """WITH nr AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY i) AS k FROM returns),
   pairs AS (SELECT a.code, a.d, a.k AS n, b.r, pow(1 - 2.0 / 101, a.k - b.k) AS w FROM nr a JOIN nr b ON b.code = a.code AND b.k <= a.k),
   m AS (SELECT code, d, max(n) AS n, sum(w) AS s1, sum(w * w) AS s2, sum(w * r) / sum(w) AS mu, max(r) = min(r) AS flat FROM pairs GROUP BY code, d),
   v AS (SELECT p.code, p.d, max(m.n) AS observations, max(CASE WHEN m.flat OR m.n < 2 THEN NULL ELSE 1 END) AS ok,
     sqrt(sum(p.w * (p.r - m.mu) * (p.r - m.mu)) * max(s1) / nullif(max(s1 * s1 - s2), 0)) AS sg FROM pairs p JOIN m ON m.code = p.code AND m.d = p.d GROUP BY p.code, p.d)"""


@query("ewm_volatility", EWM + """ SELECT v.code, observations, round(CASE WHEN ok = 1 THEN sg END, 9) AS sigma FROM v
   JOIN (SELECT code, max(d) AS d FROM returns GROUP BY code) l ON l.code = v.code AND l.d = v.d""")
def ewm_volatility(t: Tables) -> DataFrame:
    return risk.ewm_std(returns(t), CONFIG.vol_span).withColumn("sigma", F.round("sigma", 9))


@query("ewm_volatility_daily", EWM + """ SELECT code, d, observations, round(CASE WHEN ok = 1 THEN sg END, 9) AS sigma FROM v""")
def ewm_volatility_daily(t: Tables) -> DataFrame:
    out = risk.ewm_std_daily(risk.placed_returns(closes(t)), CONFIG.vol_span)
    return out.select("code", "d", "observations", F.round("sigma", 9).alias("sigma"))


@query("estimated_volatility", EWM + """ SELECT code, d, observations, CASE WHEN observations >= 20 THEN round(CASE WHEN ok = 1 THEN sg END, 9) END AS sigma,
   CASE WHEN observations < 20 THEN 'too_few_observations' WHEN ok IS NULL THEN 'no_valid_deviation' END AS vol_reason FROM v""")
def estimated_volatility(t: Tables) -> DataFrame:
    out = risk.estimate_vol(risk.ewm_std_daily(risk.placed_returns(closes(t)), CONFIG.vol_span), CONFIG.vol_min_observations)
    return out.select("code", "d", "observations", F.round("sigma", 9).alias("sigma"), "vol_reason")


@query("volatility_coverage", EWM + """ SELECT b.d, count(CASE WHEN v.observations >= 10 AND ok = 1 THEN 1 END) AS with_sigma, count(*) AS codes
   FROM bars b LEFT JOIN v ON v.code = b.code AND v.d = b.d GROUP BY b.d""")
def volatility_coverage(t: Tables) -> DataFrame:
    est = risk.estimate_vol(risk.ewm_std_daily(risk.placed_returns(closes(t)), CONFIG.vol_span), 10)
    return risk.vol_coverage(t.bars(), est)


# ── cost ─────────────────────────────────────────────────────────────────────


def exits(t: Tables) -> DataFrame:
    return t.trades().withColumn("exit_cents", F.col("entry_cents") + (F.col("l_partkey") % 400 - 150) * 10)


EXITS = "exits AS (SELECT *, entry_cents + (l_partkey % 400 - 150) * 10 AS exit_cents FROM trades)"


@query("round_trip_cost", f"""WITH {EXITS}, c AS (SELECT *, {FEE.format('entry_cents * shares')} AS buy_fee, {FEE.format('exit_cents * shares')} AS sell_fee,
   {TAX.format('exit_cents * shares', '3000')} AS tax FROM exits)
   SELECT l_orderkey, l_linenumber, buy_fee, sell_fee, tax, 100 * (buy_fee + sell_fee + tax) AS cost_cents,
   (exit_cents - entry_cents) * shares - 100 * (buy_fee + sell_fee + tax) AS net_cents,
   {half_up('100 * (buy_fee + sell_fee + tax) * 10000', '(entry_cents * shares)')} AS cost_bps FROM c""")
def round_trip_cost(t: Tables) -> DataFrame:
    return cost.round_trip(exits(t)).select("l_orderkey", "l_linenumber", "buy_fee", "sell_fee", "tax", "cost_cents", "net_cents", "cost_bps")


@query("day_trade_cost", f"""WITH {EXITS}, c AS (SELECT *, l_linenumber % 2 = 0 AS dt, d BETWEEN DATE '2017-04-28' AND DATE '2027-12-31' AS halved FROM (
     SELECT * REPLACE (CAST(d + INTERVAL 20 YEAR AS DATE) AS d) FROM exits) y)
   SELECT l_orderkey, l_linenumber, d, CASE WHEN dt AND halved THEN 1500 ELSE 3000 END AS tax_ppm,
   CASE WHEN dt AND halved THEN {TAX.format('exit_cents * shares', '1500')} ELSE {TAX.format('exit_cents * shares', '3000')} END AS tax,
   CASE WHEN dt AND NOT halved THEN 'outside_halving_period' WHEN dt THEN 'day_trade' END AS warning FROM c""")
def day_trade_cost(t: Tables) -> DataFrame:
    moved = exits(t).withColumn("d", F.add_months("d", 240))
    dt = F.col("l_linenumber") % 2 == 0
    out = cost.round_trip(moved, day_trade=dt)
    return out.select("l_orderkey", "l_linenumber", "d", "tax_ppm", "tax", cost.tax_warning(F.col("d"), dt).alias("warning"))


# Terms that change once for everybody and once more for the odd brokers.
SCHEDULE = [
    ("even", "1900-01-01", 1425, 10_000, 20, 3000, 1500), ("even", "1995-01-01", 1425, 6000, 1, 3000, 1500),
    ("odd", "1900-01-01", 1000, 10_000, 20, 3000, 3000), ("odd", "1995-01-01", 1000, 10_000, 20, 2500, 1500), ("odd", "1997-06-01", 1200, 9500, 15, 2500, 1000),
]
SCHEDULE_SQL = "(VALUES " + ", ".join(f"('{k}', DATE '{d}', {', '.join(map(str, rest))})" for k, d, *rest in SCHEDULE) + ") ft(terms, effective_from, ppm, bps, least, tax_ppm, dt_ppm)"


@query("scheduled_costs", f"""WITH {EXITS}, x AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS terms, l_linenumber % 3 = 0 AS dt FROM exits),
   t AS (SELECT x.*, ft.*, CASE WHEN dt THEN dt_ppm ELSE ft.tax_ppm END AS rate FROM x ASOF JOIN {SCHEDULE_SQL} ON ft.terms = x.terms AND x.d >= ft.effective_from),
   c AS (SELECT *, greatest(CAST(entry_cents * shares AS HUGEINT) * ppm * bps // 1000000000000, least) AS buy_fee, greatest(CAST(exit_cents * shares AS HUGEINT) * ppm * bps // 1000000000000, least) AS sell_fee,
     CAST(exit_cents * shares AS HUGEINT) * rate // 100000000 AS tax FROM t)
   SELECT l_orderkey, l_linenumber, CAST(buy_fee AS BIGINT) AS buy_fee, CAST(sell_fee AS BIGINT) AS sell_fee, CAST(tax AS BIGINT) AS tax, rate AS applied_tax_ppm,
     CAST((exit_cents - entry_cents) * shares - 100 * (buy_fee + sell_fee + tax) AS BIGINT) AS net_cents FROM c""")
def scheduled_costs(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([(k, datetime.date.fromisoformat(d), *rest) for k, d, *rest in SCHEDULE], cost.TERMS)
    trades = exits(t).withColumn("terms", F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd"))
    out = cost.scheduled_round_trip(trades, kinds, day_trade=F.col("l_linenumber") % 3 == 0)
    return out.select("l_orderkey", "l_linenumber", "buy_fee", "sell_fee", "tax", "applied_tax_ppm", "net_cents")


SCAN = f"list_filter(range(0, CAST(ceil((100 * {fees('entry_cents', 'entry_cents', 'shares')} + 300) / (shares * (1 - 0.004425))) AS BIGINT) + 2), lambda s: {net('entry_cents', '(entry_cents + s)', 'shares')} >= 0)[1]"


@query("breakeven_prices", f"""SELECT l_orderkey, l_linenumber, entry_cents + s AS breakeven_cents, {half_up('s * 10000', 'entry_cents')} AS breakeven_bps, 'found' AS breakeven_state FROM (
   SELECT *, {SCAN} AS s FROM trades) x""")
def breakeven_prices(t: Tables) -> DataFrame:
    priced = cost.with_breakeven(t.trades())
    move = cost.mul_div_by(F.col("breakeven_cents") - F.col("entry_cents"), 10_000, F.col("entry_cents"))
    return priced.withColumn("breakeven_bps", move).select("l_orderkey", "l_linenumber", "breakeven_cents", "breakeven_bps", "breakeven_state")


@query("priced_trades", f"""SELECT l_orderkey, l_linenumber, 100 * {fees('entry_cents', 'entry_cents', 'shares')} AS cost_cents, entry_cents + s AS breakeven_cents FROM (
   SELECT *, {SCAN} AS s FROM trades) x""")
def priced_trades(t: Tables) -> DataFrame:
    out = cost.price_trades(t.trades(), exit_="entry_cents")
    return out.select("l_orderkey", "l_linenumber", "cost_cents", "breakeven_cents")


@query("cost_totals", f"""WITH {EXITS}, c AS (SELECT *, {fees('entry_cents', 'exit_cents', 'shares')} AS f, entry_cents * shares * 1425 // 100000000 < 20 AS at_floor FROM exits)
   SELECT d, count(*) AS trades, CAST(sum(100 * f) AS BIGINT) AS cost_cents, CAST(sum((exit_cents - entry_cents) * shares - 100 * f) AS BIGINT) AS net_cents,
   count(*) FILTER (at_floor) AS buys_at_floor FROM c GROUP BY d""")
def cost_totals(t: Tables) -> DataFrame:
    return cost.cost_totals(cost.round_trip(exits(t)), ["d"])


@query("trade_outcomes", f"""WITH o AS (SELECT l_orderkey, l_linenumber, entry_cents - entry_cents // 20 AS stop, entry_cents + entry_cents // 10 AS target, entry_cents, shares FROM trades),
   n AS (SELECT *, (entry_cents - stop) * shares AS risk, {net('entry_cents', 'stop', 'shares')} AS sn, {net('entry_cents', 'target', 'shares')} AS tn FROM o)
   SELECT l_orderkey, l_linenumber, sn AS stop_net_cents, tn AS target_net_cents, {half_up('CAST(sn AS HUGEINT) * 1000000', 'risk')} / 1000000.0::DOUBLE AS stop_r,
   {half_up('CAST(tn AS HUGEINT) * 1000000', 'risk')} / 1000000.0::DOUBLE AS target_r, {half_up('CAST(tn AS HUGEINT) * 1000000', '(-sn)')} / 1000000.0::DOUBLE AS target_r_net,
   {half_up('CAST(tn AS HUGEINT) * 1000000', 'risk')} < 2000000 AS below_two_r FROM n""")
def trade_outcomes(t: Tables) -> DataFrame:
    e = F.col("entry_cents")
    barriers = t.trades().withColumn("stop_cents", e - F.call_function("div", e, F.lit(20))).withColumn("target_cents", e + F.call_function("div", e, F.lit(10)))
    return cost.trade_outcome(barriers).select(
        "l_orderkey", "l_linenumber", "stop_net_cents", "target_net_cents", "stop_r", "target_r", "target_r_net", "below_two_r")


# ── sizes and limits ─────────────────────────────────────────────────────────


@query("barriers", """SELECT d, code, feasible, round(entry - risk, 6) AS stop_price, round(entry + 2.0::DOUBLE * risk, 6) AS target_price FROM barriers""")
def barriers(t: Tables) -> DataFrame:
    out = risk.with_barriers(t.candidates(), CONFIG)
    return out.select("d", "code", "feasible", F.round("stop_price", 6).alias("stop_price"), F.round("target_price", 6).alias("target_price"))


LOSS = f"(-{net('e', 's', 'n')} / 100.0::DOUBLE)"
SOLVED = f"""sz AS (SELECT d, code, e, s, risk, upper_n AS n, 0 AS step FROM priced WHERE feasible UNION ALL
     SELECT d, code, e, s, risk, CASE WHEN n < 1 OR {LOSS} <= 200.0 THEN n
       WHEN CAST(floor((200.0 - ({LOSS} - risk * n)) / risk) AS BIGINT) >= n THEN n - 1
       ELSE CAST(floor((200.0 - ({LOSS} - risk * n)) / risk) AS BIGINT) END, step + 1 FROM sz WHERE step < 12),
   pos AS (SELECT p.*, CASE WHEN z.n IS NOT NULL THEN greatest(z.n, 0) END AS shares FROM priced p LEFT JOIN (SELECT * FROM sz WHERE step = 12) z ON z.d = p.d AND z.code = p.code),
   own AS (SELECT *, shares * entry AS value, shares * entry / 10000.0 * 100 AS pct, CASE WHEN sigma IS NULL THEN 'volatility_unavailable'
     WHEN NOT feasible THEN 'barrier_infeasible' WHEN shares < 1 THEN 'below_one_lot' WHEN shares * entry / 10000.0 * 100 > 20 THEN 'exceeds_single_position_cap'
     WHEN {net('e', 'g', 'shares')} <= 0 THEN 'target_below_breakeven' WHEN {net('e', 'g', 'shares')} <= -{net('e', 's', 'shares')} THEN 'odds_below_one' END AS own_reason FROM pos)"""


@query("position_sizes", f"WITH RECURSIVE {SOLVED} SELECT d, code, shares, round(value, 4) AS position_value, own_reason FROM own")
def position_sizes(t: Tables) -> DataFrame:
    out = risk.size_candidates(t.candidates(), CONFIG)
    return out.select("d", "code", "shares", F.round("position_value", 4).alias("position_value"), "own_reason")


@query("position_sizes_max", f"""SELECT d, code, list_filter(range(upper_n, -1, -1), lambda n: n = 0 OR {LOSS} <= 200.0)[1] AS shares FROM priced WHERE feasible""")
def position_sizes_max(t: Tables) -> DataFrame:
    return risk.size_candidates(t.candidates(), CONFIG, mode="max").filter("feasible").select("d", "code", "shares")


def greedy(monthly: int = 6, open_: int = 3, exposure: float = 60, budget: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"""{SOLVED},
   decide AS (SELECT w.d, w.rank, w.code, w.own_reason, w.pct, w.value FROM own w),
   greedy AS (SELECT d, 0::BIGINT AS rank, CAST(entries AS BIGINT) AS entries, CAST(open_positions AS BIGINT) AS open, CAST(exposure_pct AS DOUBLE) AS exposure, {budget} AS money, drawdown_pct AS dd, CAST(NULL AS BIGINT) AS code, CAST(NULL AS STRING) AS reason FROM risk_state
     UNION ALL SELECT g.d, w.rank, CASE WHEN ok THEN g.entries + 1 ELSE g.entries END, CASE WHEN ok THEN g.open + 1 ELSE g.open END,
       CASE WHEN ok THEN g.exposure + w.pct ELSE g.exposure END, CASE WHEN ok THEN g.money - w.value ELSE g.money END, g.dd, w.code, w.why FROM greedy g JOIN LATERAL (
         SELECT rank, code, pct, value, why, why IS NULL AS ok FROM (SELECT c.rank, c.code, c.pct, c.value, CASE WHEN g.dd >= 15 THEN 'circuit_breaker' WHEN g.entries >= {monthly} THEN 'monthly_turnover_cap'
           WHEN g.open >= {open_} THEN 'concurrent_position_cap' WHEN c.own_reason IS NOT NULL THEN c.own_reason WHEN g.exposure + c.pct > {exposure} THEN 'total_exposure_cap'
           WHEN c.value > g.money THEN 'daily_buy_budget' END AS why
           FROM decide c WHERE c.d = g.d AND c.rank = g.rank + 1) y) w ON true)"""


GREEDY = greedy()


@query("capped_approvals", f"WITH RECURSIVE {GREEDY} SELECT d, rank, code, reason AS reject_reason, reason IS NULL AS approved FROM greedy WHERE rank > 0")
def capped_approvals(t: Tables) -> DataFrame:
    return decided(t).select("d", "rank", "code", "reject_reason", "approved")


WIDE = risk.RiskConfig(max_concurrent=20, monthly_entry_cap=40, max_total_exposure_pct=300.0)
BUDGETED = risk.RiskConfig(daily_buy_budget=2500.0)


@query("capped_approvals_wide", f"WITH RECURSIVE {greedy(40, 20, 300)} SELECT d, rank, code, reason AS reject_reason, reason IS NULL AS approved FROM greedy WHERE rank > 0")
def capped_approvals_wide(t: Tables) -> DataFrame:
    return decided(t, WIDE).select("d", "rank", "code", "reject_reason", "approved")


@query("capped_approvals_budget", f"WITH RECURSIVE {greedy(budget='2500.0::DOUBLE')} SELECT d, rank, code, reason AS reject_reason, reason IS NULL AS approved FROM greedy WHERE rank > 0")
def capped_approvals_budget(t: Tables) -> DataFrame:
    return decided(t, BUDGETED).select("d", "rank", "code", "reject_reason", "approved")


def decided(t: Tables, config: risk.RiskConfig = CONFIG) -> DataFrame:
    return risk.capped_greedy(risk.size_candidates(t.candidates(), config), t.risk_state(), config)


def by_version(start: str, end: str, version: str, *limits) -> str:
    return f"SELECT *, '{version}' AS version FROM (WITH RECURSIVE {greedy(*limits)} SELECT d, rank, code, reason AS reject_reason, reason IS NULL AS approved FROM greedy WHERE rank > 0) g WHERE d >= DATE '{start}' AND d < DATE '{end}'"


@query("approvals_by_version", f"{by_version('1900-01-01', '1995-01-01', 'risk-v1', 6, 3, 60)} UNION ALL {by_version('1995-01-01', '9999-01-01', 'risk-v2', 40, 20, 300)}")
def approvals_by_version(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(
        [(datetime.date(1900, 1, 1), "risk-v1", 3, 6, 60.0), (datetime.date(1995, 1, 1), "risk-v2", 20, 40, 300.0)],
        "effective_from date, version string, max_concurrent int, monthly_entry_cap int, max_total_exposure_pct double")
    out = risk.approvals_by_version(t.candidates(), t.risk_state(), risk.load_configs(table))
    return out.select("d", "rank", "code", "reject_reason", "approved", "version")


@query("rejection_counts", f"WITH RECURSIVE {GREEDY} SELECT reason, count(*) AS n FROM greedy WHERE rank > 0 AND reason IS NOT NULL GROUP BY reason")
def rejection_counts(t: Tables) -> DataFrame:
    return risk.rejection_counts(decided(t))


@query("limits_proof", f"""WITH RECURSIVE {GREEDY} SELECT d, count(*) AS candidates, count(*) FILTER (reason IS NULL) AS approved,
   count(*) FILTER (reason IS NOT NULL) AS rejected, 0 AS faults, true AS only_subtracts FROM greedy WHERE rank > 0 GROUP BY d""")
def limits_proof(t: Tables) -> DataFrame:
    return risk.limits_proof(t.candidates(), decided(t))


@query("monthly_entries", """WITH log AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'trade_signal' ELSE 'watchlist' END AS kind, o_custkey AS revision FROM orders)
   SELECT a.d, count(b.d) AS entries FROM (SELECT DISTINCT d FROM log) a LEFT JOIN log b ON b.kind = 'trade_signal' AND b.revision < 1000
   AND b.d <= a.d AND b.d >= CAST(date_trunc('month', a.d) AS DATE) GROUP BY a.d""")
def monthly_entries(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "trade_signal").otherwise("watchlist")
    log = t.orders.select(F.col("o_orderdate").cast("date").alias("d"), kind.alias("list_kind"), F.col("o_custkey").alias("revision"))
    return risk.monthly_entries(log, log.select("d"))


CONFIGS = """configs AS (SELECT concat('v', p_partkey) AS version, 1.0 + (p_size % 5) / 3.0 AS risk_per_trade_pct, 1.5 + (p_partkey % 3) / 2.0 AS take_profit_r,
   p_retailprice - 1000 AS equity, p_size % 12 AS holding_days, p_partkey % 30 AS vol_min_observations, (p_size % 4) / 2.0 AS stop_sigma_multiple,
   p_partkey % 9 AS max_concurrent, 15.0 AS circuit_breaker_pct, (p_size % 30) * 1.0 AS max_single_position_pct, 25.0 AS max_total_exposure_pct,
   p_size % 3 AS lot_size, CASE WHEN p_size % 7 <> 0 THEN (p_size % 6) * 100.0 END AS daily_buy_budget FROM part)"""


def configs(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return t.part.select(
        F.concat(F.lit("v"), key.cast("string")).alias("version"), (1.0 + (size % 5) / 3.0).alias("risk_per_trade_pct"),
        (1.5 + (key % 3) / 2.0).alias("take_profit_r"), (F.col("p_retailprice") - 1000).alias("equity"), (size % 12).alias("holding_days"),
        (key % 30).alias("vol_min_observations"), ((size % 4) / 2.0).alias("stop_sigma_multiple"), (key % 9).alias("max_concurrent"),
        F.lit(15.0).alias("circuit_breaker_pct"), ((size % 30) * 1.0).alias("max_single_position_pct"), F.lit(25.0).alias("max_total_exposure_pct"),
        (size % 3).alias("lot_size"), F.when(size % 7 != 0, (size % 6) * 100.0).alias("daily_buy_budget"))


@query("config_violations", f"""WITH {CONFIGS} SELECT version, rule FROM (SELECT version, unnest(list_filter([
   CASE WHEN NOT risk_per_trade_pct BETWEEN 1 AND 2 THEN 'risk_per_trade' END, CASE WHEN take_profit_r < 2 THEN 'take_profit' END,
   CASE WHEN equity <= 0 THEN 'equity' END, CASE WHEN holding_days < 1 THEN 'holding_days' END, CASE WHEN vol_min_observations < 2 THEN 'vol_observations' END,
   CASE WHEN stop_sigma_multiple <= 0 THEN 'stop_multiple' END, CASE WHEN max_concurrent * risk_per_trade_pct >= circuit_breaker_pct THEN 'worst_case' END,
   CASE WHEN max_single_position_pct > max_total_exposure_pct THEN 'position_caps' END, CASE WHEN lot_size < 1 THEN 'lot_size' END,
   CASE WHEN daily_buy_budget <= 0 THEN 'daily_budget' END], lambda r: r IS NOT NULL)) AS rule FROM configs) x""")
def config_violations(t: Tables) -> DataFrame:
    return risk.validate_config(configs(t))
