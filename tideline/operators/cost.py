"""Trade costs in whole cents as column expressions over a trades table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.money import FLOOR, HALF_UP, div_round, mul_div, ratio6
from tideline.operators.align import asof_join

# Statutory rates and the halving period of the day-trade tax.
COMMISSION_PPM = 1425
TAX_PPM, DAY_TRADE_TAX_PPM = 3000, 1500
HALVING_START, HALVING_END = "2017-04-28", "2027-12-31"
PPM, BPS, CENTS = 1_000_000, 10_000, 100
MAX_SCAN_CENTS = 1_000_000
BREAKEVEN_STEPS, BREAKEVEN_FOLD = 8, 64


@dataclass(frozen=True)
class Broker:
    """Fee terms; the default is the least favourable one."""

    commission_ppm: int = COMMISSION_PPM
    discount_bps: int = 10_000
    min_commission: int = 20
    commission_rounding: str = FLOOR
    tax_rounding: str = FLOOR
    day_trade_discount_bps: int | None = None

    def __post_init__(self):
        if not 0 <= self.commission_ppm <= COMMISSION_PPM or not 0 <= self.discount_bps <= BPS or self.min_commission < 0:
            raise ValueError("broker terms are outside the legal range")


def commission(amount_cents: Column, broker: Broker, day_trade: Column | None = None) -> Column:
    """Whole units, rounded once, never below the minimum fee."""
    return F.greatest(_computed_fee(amount_cents, broker, day_trade), F.lit(broker.min_commission).cast("bigint"))


def hits_floor(amount_cents: Column, broker: Broker, day_trade: Column | None = None) -> Column:
    return _computed_fee(amount_cents, broker, day_trade) < broker.min_commission


def _computed_fee(amount_cents: Column, broker: Broker, day_trade: Column | None) -> Column:
    def fee(bps: int) -> Column:
        return mul_div(amount_cents, broker.commission_ppm * bps, PPM * BPS * CENTS, broker.commission_rounding, negative=False)

    if day_trade is None or broker.day_trade_discount_bps is None:
        return fee(broker.discount_bps)
    return F.when(day_trade, fee(broker.day_trade_discount_bps)).otherwise(fee(broker.discount_bps))


def sell_tax_ppm(trade_date: Column, day_trade: Column) -> Column:
    halved = trade_date.between(F.lit(HALVING_START).cast("date"), F.lit(HALVING_END).cast("date"))
    return F.when(day_trade & halved, DAY_TRADE_TAX_PPM).otherwise(TAX_PPM)


def tax_warning(trade_date: Column, day_trade: Column) -> Column:
    return F.when(day_trade & (sell_tax_ppm(trade_date, day_trade) == TAX_PPM), "outside_halving_period").when(day_trade, "day_trade")


def sell_tax(amount_cents: Column, ppm: Column | int, broker: Broker) -> Column:
    if isinstance(ppm, int):  # one constant rate
        return mul_div(amount_cents, ppm, PPM * CENTS, broker.tax_rounding, negative=False)
    full = mul_div(amount_cents, TAX_PPM, PPM * CENTS, broker.tax_rounding, negative=False)
    half = mul_div(amount_cents, DAY_TRADE_TAX_PPM, PPM * CENTS, broker.tax_rounding, negative=False)
    return F.when(ppm == DAY_TRADE_TAX_PPM, half).otherwise(full)


def fees_at(entry: Column, exit_: Column, shares: Column, ppm: Column | int, broker: Broker, day_trade: Column | None = None) -> Column:
    """Both commissions and the sales tax, in whole units."""
    return (
        commission(entry * shares, broker, day_trade) + commission(exit_ * shares, broker, day_trade)
        + sell_tax(exit_ * shares, ppm, broker)
    )


def net_cents(entry: Column, exit_: Column, shares: Column, ppm: Column | int, broker: Broker, day_trade: Column | None = None) -> Column:
    return (exit_ - entry) * shares - CENTS * fees_at(entry, exit_, shares, ppm, broker, day_trade)


def round_trip(trades: DataFrame, broker: Broker = Broker(), entry="entry_cents", exit_="exit_cents", shares="shares", day="d", day_trade: Column | None = None) -> DataFrame:
    """Cost and profit columns of a buy and a sell."""
    e, x, s = F.col(entry), F.col(exit_), F.col(shares)
    dt = F.lit(False) if day_trade is None else day_trade
    ppm = sell_tax_ppm(F.col(day), dt)
    out = (
        trades.withColumn("buy_cents", e * s).withColumn("sell_cents", x * s).withColumn("tax_ppm", ppm)
        .withColumn("buy_fee", commission(F.col("buy_cents"), broker, dt))
        .withColumn("sell_fee", commission(F.col("sell_cents"), broker, dt))
        .withColumn("buy_fee_floor", hits_floor(F.col("buy_cents"), broker, dt))
        .withColumn("sell_fee_floor", hits_floor(F.col("sell_cents"), broker, dt))
        .withColumn("tax", sell_tax(F.col("sell_cents"), F.col("tax_ppm"), broker))
        .withColumn("cost_cents", CENTS * (F.col("buy_fee") + F.col("sell_fee") + F.col("tax")))
        .withColumn("gross_cents", F.col("sell_cents") - F.col("buy_cents"))
        .withColumn("net_cents", F.col("gross_cents") - F.col("cost_cents"))
    )
    return out.withColumn("cost_bps", mul_div_by(F.col("cost_cents"), 10_000, F.col("buy_cents")))


def mul_div_by(value: Column, mul: int, div: Column) -> Column:
    return div_round(value * F.lit(mul).cast("bigint"), div, HALF_UP)


# ── terms by date ────────────────────────────────────────────────────────────

TERMS = "terms string, effective_from date, commission_ppm int, discount_bps int, min_commission long, tax_ppm int, day_trade_tax_ppm int"


def with_terms(trades: DataFrame, schedule: DataFrame, key: str = "terms", day: str = "d") -> DataFrame:
    """Each trade with the terms that were in force on its day.

    ``schedule`` (TERMS) has a row for each change; terms hold from their day on until the next. A
    trade before the first, or of unknown terms, is an error, as are terms outside the legal range.
    """
    ppm, bps, least = F.col("commission_ppm"), F.col("discount_bps"), F.col("min_commission")
    legal = ppm.between(0, COMMISSION_PPM) & bps.between(0, BPS) & (least >= 0) & (F.col("tax_ppm") >= 0) & (F.col("day_trade_tax_ppm") >= 0)
    values = ["commission_ppm", "discount_bps", "min_commission", "tax_ppm", "day_trade_tax_ppm"]
    checked = schedule.withColumn("commission_ppm", F.when(F.coalesce(legal, F.lit(False)), ppm).otherwise(F.raise_error(F.lit("broker terms are outside the legal range")).cast("int")))
    found = asof_join(trades, checked.withColumn("_one", F.lit(0)), day, values, key=key, known="effective_from", covers="_one").drop("_one")
    unknown = F.raise_error(F.concat(F.lit("no terms for "), F.coalesce(F.col(key), F.lit("NULL")), F.lit(" on "), F.coalesce(F.col(day).cast("string"), F.lit("NULL")))).cast("int")
    return found.withColumn("commission_ppm", F.coalesce("commission_ppm", unknown))


def scheduled_round_trip(trades: DataFrame, schedule: DataFrame, entry="entry_cents", exit_="exit_cents", shares="shares", day="d", key="terms", day_trade: Column | None = None) -> DataFrame:
    """:func:`round_trip` with fees and taxes of a table of terms with effective dates.

    Fees are rounded down once, as the default broker's are.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    share = lambda amount, part, whole: F.call_function("div", wide(amount) * wide(part), wide(F.lit(whole))).cast("bigint")
    e, x, n = F.col(entry), F.col(exit_), F.col(shares)
    fee = lambda amount: F.greatest(share(amount, F.col("commission_ppm").cast("long") * F.col("discount_bps"), PPM * BPS * CENTS), F.col("min_commission"))
    ppm = F.col("tax_ppm") if day_trade is None else F.when(day_trade, F.col("day_trade_tax_ppm")).otherwise(F.col("tax_ppm"))
    out = with_terms(trades, schedule, key, day).withColumn("applied_tax_ppm", ppm)
    out = out.withColumns({"buy_fee": fee(e * n), "sell_fee": fee(x * n), "tax": share(x * n, F.col("applied_tax_ppm"), PPM * CENTS)})
    out = out.withColumn("cost_cents", CENTS * (F.col("buy_fee") + F.col("sell_fee") + F.col("tax")))
    return out.withColumn("net_cents", (x - e) * n - F.col("cost_cents"))


def with_breakeven(trades: DataFrame, broker: Broker = Broker(), entry="entry_cents", shares="shares", ppm: Column | int = TAX_PPM, strict: bool = True) -> DataFrame:
    """Add the lowest exit price in cents, from the entry up, that loses nothing, and ``breakeven_state``.

    Net profit is not monotone in the price, so bisection would be wrong. The least solution of
    exit = entry + ceil(100 × fees(exit) ÷ shares) is found from below instead: fees never fall as
    the price rises, so every price that breaks even lies at or above each step, and the first
    fixed point is the answer. Each step grows by the fee rate times the one before, plus at most
    two single-unit fee steps, so few steps are needed: the first ones are projections that run as
    compiled code, and a row that moves on still walks further in a fold.

    State is found, or why there is no price: beyond_scan_limit or not_settled. That is an error
    unless ``strict`` is off, which leaves the price NULL.
    """
    e, s = F.col(entry), F.col(shares)

    def step(price: Column) -> Column:
        fees = F.col("_buy_fee") + commission(price * s, broker) + sell_tax(price * s, ppm, broker)
        return e + F.call_function("div", CENTS * fees + s - 1, s)

    out = trades.withColumn("_buy_fee", commission(e * s, broker)).withColumn("_exit", e)
    for _ in range(BREAKEVEN_STEPS):
        out = out.withColumn("_exit", step(F.col("_exit")))
    price = F.col("_exit")
    further = F.aggregate(F.sequence(F.lit(1), F.lit(BREAKEVEN_FOLD)), price, lambda acc, _: F.when(acc - e > MAX_SCAN_CENTS, acc).otherwise(step(acc)))
    out = out.withColumn("_exit", F.when(step(price) == price, price).otherwise(further))
    state = F.when(price - e > MAX_SCAN_CENTS, "beyond_scan_limit").when(step(price) != price, "not_settled").otherwise("found")
    out = out.withColumn("breakeven_state", state)
    found = F.when(F.col("breakeven_state") == "found", price)
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no break-even price: "), F.col("breakeven_state"))).cast("bigint"))
    return out.withColumn("breakeven_cents", found).drop("_exit", "_buy_fee")


def price_trades(trades: DataFrame, broker: Broker = Broker(), strict: bool = True, **columns) -> DataFrame:
    """:func:`round_trip` for every trade plus its break-even price and move in basis points."""
    entry = columns.get("entry", "entry_cents")
    priced = round_trip(trades, broker, **columns)
    out = with_breakeven(priced, broker, entry, columns.get("shares", "shares"), F.col("tax_ppm"), strict)
    return out.withColumn("breakeven_bps", mul_div_by(F.col("breakeven_cents") - F.col(entry), 10_000, F.col(entry)))


def cost_totals(priced: DataFrame, keys: list[str]) -> DataFrame:
    return priced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("cost_cents").alias("cost_cents"), F.sum("net_cents").alias("net_cents"),
        F.count_if(F.col("buy_fee_floor")).alias("buys_at_floor"),
    )


def trade_outcome(trades: DataFrame, broker: Broker = Broker(), entry="entry_cents", stop="stop_cents", target="target_cents", shares="shares", day="d") -> DataFrame:
    """Net result and R multiples at both barriers. Barriers on the wrong side are an error."""
    e, x, y, s = (F.col(c) for c in (entry, stop, target, shares))
    ordered = (x < e) & (y > e) & (x > 0) & (s > 0)
    checked = trades.filter(F.when(ordered, True).otherwise(F.raise_error(F.lit("barriers do not enclose the entry price")).cast("boolean")))
    ppm = sell_tax_ppm(F.col(day), F.lit(False))
    out = (
        checked.withColumn("nominal_risk_cents", (e - x) * s)
        .withColumn("stop_net_cents", net_cents(e, x, s, ppm, broker))
        .withColumn("target_net_cents", net_cents(e, y, s, ppm, broker))
    )
    return (
        out.withColumn("stop_r", ratio6(F.col("stop_net_cents"), F.col("nominal_risk_cents")))
        .withColumn("target_r", ratio6(F.col("target_net_cents"), F.col("nominal_risk_cents")))
        .withColumn("target_r_net", ratio6(F.col("target_net_cents"), -F.col("stop_net_cents")))
        .withColumn("below_two_r", F.col("target_r") < 2)
    )
