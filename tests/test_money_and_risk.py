import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.money import CEIL, FLOOR, HALF_UP, div_round
from tideline.operators import cost, risk


def test_rounding_modes_with_signs(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (6, 4), (-6, 4), (5, 10), (-5, 10), (9, 3), (7, -2)], "n long, d long")
    expect = {
        FLOOR: [3, -4, 1, -2, 0, -1, 3, -4], CEIL: [4, -3, 2, -1, 1, 0, 3, -3], HALF_UP: [4, -4, 2, -2, 1, -1, 3, -4],
    }
    for mode, want in expect.items():
        assert [r[0] for r in df.select(div_round(F.col("n"), F.col("d"), mode)).collect()] == want
    with pytest.raises(Exception, match="BY_ZERO"):
        df.select(div_round(F.col("n"), F.lit(0).cast("bigint"))).collect()


def test_round_trip_with_discount(spark):
    df = spark.sql("SELECT 10000L AS entry_cents, 10500L AS exit_cents, 1000L AS shares, DATE'2026-08-14' AS d")
    r = cost.round_trip(df, cost.Broker(discount_bps=6000)).first()
    assert (r["buy_fee"], r["sell_fee"], r["tax"], r["net_cents"], r["cost_bps"]) == (85, 89, 315, 451100, 49)


def test_round_trip_at_the_minimum_fee(spark):
    df = spark.sql("SELECT 1050L AS entry_cents, 1100L AS exit_cents, 100L AS shares, DATE'2026-08-14' AS d")
    r = cost.round_trip(df, cost.Broker(discount_bps=6000)).first()
    assert (r["buy_fee"], r["sell_fee"], r["tax"], r["net_cents"], r["cost_bps"]) == (20, 20, 3, 700, 410)
    assert r["buy_fee_floor"] and r["sell_fee_floor"]


def brute_net(e, x, n):
    fee = lambda a: max(20, a * 1425 // 100_000_000)
    return (x - e) * n - 100 * (fee(e * n) + fee(x * n) + x * n * 3000 // 100_000_000)


def test_breakeven_equals_a_full_scan(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(10, 200_000), rnd.choice([1, 7, 100, 1000, rnd.randrange(1, 50_000)])) for _ in range(400)]
    rows += [(200_000, 1_000_000), (10, 1), (99_999, 3)]
    got = cost.with_breakeven(spark.createDataFrame(rows, "entry_cents long, shares long")).collect()
    for r in got:
        e, n = r["entry_cents"], r["shares"]
        x = e
        while brute_net(e, x, n) < 0:
            x += 1
        assert r["breakeven_cents"] == x


def test_a_price_that_cannot_break_even_is_an_error(spark):
    df = spark.createDataFrame([(2_000_000_000, 10)], "entry_cents long, shares long")
    with pytest.raises(Exception, match="no break-even price: beyond_scan_limit"):
        cost.with_breakeven(df).collect()
    row = cost.with_breakeven(df, strict=False).first()
    assert (row["breakeven_cents"], row["breakeven_state"]) == (None, "beyond_scan_limit")


def test_sizes_never_exceed_the_budget(spark):
    rows = [(5.0 + i * 0.37, 0.001 + (i % 29) / 900) for i in range(600)]
    df = spark.createDataFrame(rows, "entry double, sigma double")
    for cfg in (risk.RiskConfig(), risk.RiskConfig(equity=3_000_000.0, lot_size=7)):
        sized = risk.size_candidates(df, cfg).select("shares", "loss_cents").toPandas().dropna()
        assert len(sized) and (sized["loss_cents"][sized["shares"] > 0] <= round(cfg.risk_budget * 100)).all()


def test_a_day_without_state_is_an_error(spark):
    sized = spark.createDataFrame([(1, 5, 1, None, 10, 1.0, 1.0)], "d int, code int, rank long, own_reason string, shares long, position_pct double, position_value double")
    state = spark.createDataFrame([], "d int, entries int, open_positions int, exposure_pct double, drawdown_pct double")
    with pytest.raises(Exception, match="no risk state"):
        risk.capped_greedy(sized, state, risk.RiskConfig()).collect()


def test_barriers_on_the_wrong_side_are_an_error(spark):
    row = (1000, 1000, 1100, 100, datetime.date(2026, 8, 14))
    df = spark.createDataFrame([row], "entry_cents long, stop_cents long, target_cents long, shares long, d date")
    with pytest.raises(Exception, match="barriers do not enclose"):
        cost.trade_outcome(df).collect()


def test_ewm_worked_number_and_pandas(spark):
    rows = [(1, i, float(v)) for i, v in enumerate((1, 2, 3, 4))]
    rnd = random.Random(1)
    long = [rnd.gauss(0, 0.02) for _ in range(300)]
    rows += [(2, i, v) for i, v in enumerate(long)] + [(3, i, 0.01) for i in range(5)]
    df = spark.createDataFrame(rows, "code long, i long, r double").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i").cast("int")))
    got = {r["code"]: r["sigma"] for r in risk.ewm_std(df, 3).collect()}
    assert abs(got[1] - math.sqrt(97 / 70)) < 1e-12
    assert abs(got[2] - pd.Series(long).ewm(span=3).std().iloc[-1]) < 1e-12
    assert got[3] is None
    daily = risk.ewm_std_daily(df.filter("code = 2"), 3).orderBy("i").toPandas()
    want = pd.Series(long).ewm(span=3).std()
    assert (daily["sigma"][1:] - want[1:]).abs().max() < 1e-12
    assert {r["sigma"] for r in risk.ewm_std_daily(df.filter("code = 3"), 3).collect()} == {None}


def test_sizing_worked_numbers(spark):
    cfg = risk.RiskConfig()
    df = spark.createDataFrame([(50.0, 0.02)], "entry double, sigma double")
    r = risk.size_candidates(df, cfg).first()
    assert (r["shares"], r["position_value"], round(r["position_pct"], 6), r["own_reason"]) == (24, 1200.0, 12.0, None)


def test_largest_size_is_never_below_the_rule(spark):
    rows = [(10.0 + i * 3.7, 0.005 + (i % 17) / 400) for i in range(200)]
    df = spark.createDataFrame(rows, "entry double, sigma double")
    cfg = risk.RiskConfig(equity=1_000_000.0)
    rule = risk.size_candidates(df, cfg).select("entry", "shares").toPandas()
    best = risk.size_candidates(df, cfg, mode="max").select("entry", F.col("shares").alias("best")).toPandas()
    both = rule.merge(best, on="entry").dropna()
    assert len(both) and (both["best"] >= both["shares"]).all()


def test_greedy_equals_a_plain_loop(spark):
    rnd = random.Random(11)
    cfg = risk.RiskConfig(max_concurrent=3, monthly_entry_cap=5, max_total_exposure_pct=60.0, daily_buy_budget=4000.0)
    sized, state = [], []
    for d in range(30):
        state.append((d, rnd.randrange(0, 7), rnd.randrange(0, 4), float(rnd.randrange(0, 50)), float(rnd.choice([0, 3, 20]))))
        for rank in range(1, rnd.randrange(0, 14)):
            value = float(rnd.randrange(500, 3000))
            sized.append((d, 100 + rank, rank, rnd.choice([None, None, None, "odds_below_one"]), 10, value / 100, value))
    s = spark.createDataFrame(sized, "d int, code int, rank long, own_reason string, shares long, position_pct double, position_value double")
    st = spark.createDataFrame(state, "d int, entries int, open_positions int, exposure_pct double, drawdown_pct double")
    got = {(r["d"], r["rank"]): (r["approved"], r["reject_reason"]) for r in risk.capped_greedy(s, st, cfg).collect()}
    assert len(got) == len(sized)
    for d, entries, open_, exposure, dd in state:
        halted = entries >= 5
        budget = 4000.0
        for _, _, rank, own, _, pct, value in sorted(x for x in sized if x[0] == d):
            if dd >= 15:
                want = "circuit_breaker"
            elif halted or entries >= 5:
                want = "monthly_turnover_cap"
            elif open_ >= 3:
                want = "concurrent_position_cap"
            elif own:
                want = own
            elif exposure + pct > 60:
                want = "total_exposure_cap"
            elif value > budget:
                want = "daily_buy_budget"
            else:
                want = None
                entries, open_, exposure, budget = entries + 1, open_ + 1, exposure + pct, budget - value
            assert got[(d, rank)] == (want is None, want)
