import datetime

import pytest
from pyspark.sql import functions as F

from tideline.operators import benchmark, outcomes

# eleven trading days with a weekend gap
DAYS = [datetime.date(2026, 8, d) for d in (13, 14, 17, 18, 19, 20, 21, 24, 25, 26, 27)]
EVENT = "code string, ex_date date, cash double, ratio double, rights boolean, batch long"


def cal_of(spark, days=DAYS):
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "d date, i long")


def bars_of(spark, rows):
    return spark.createDataFrame([("A", d, h, l, c) for d, h, l, c in rows], "code string, d date, high double, low double, close double")


def pick(spark, stop=None, target=None, day=DAYS[0]):
    return spark.createDataFrame([(1, "A", day, 100.0, stop, target)], "pick_id long, code string, d date, entry double, stop double, target double")


def run(spark, picks, bars, events=()):
    out = outcomes.compute_outcomes(picks, bars, cal_of(spark), spark.createDataFrame(list(events), EVENT))
    return {r["horizon"]: r for r in out.collect()}


def flat(spark, change=None):
    rows = [(d, 101.0, 99.0, 100.0) for d in DAYS]
    for i, bar in (change or {}).items():
        rows[i] = (DAYS[i], *bar)
    return bars_of(spark, rows)


def test_reference_price_anchor(spark):
    r = spark.range(1).select(outcomes.reference_price(F.lit(34.30), F.lit(1.74669389), F.lit(0.04990554083))).first()[0]
    assert abs(r - 31.0059) < 1e-4


def test_left_open_right_closed_and_growing_shares(spark):
    ev = [("A", DAYS[0], 9.0, 0.5, False, 1), ("A", DAYS[2], 1.0, 0.1, False, 1), ("A", DAYS[3], 1.0, 0.0, True, 1), ("A", DAYS[3], 2.0, 0.0, True, 2)]
    iv = spark.createDataFrame([("A", DAYS[0], DAYS[3])], "code string, from_d date, to_d date")
    r = outcomes.adjustment_for(iv, spark.createDataFrame(ev, EVENT)).first()
    assert abs(r["factor"] - 1.1) < 1e-12 and abs(r["cash"] - (1.0 + 2.0 * 1.1)) < 1e-12
    assert (r["events"], r["rights"]) == (2, True)


def test_horizons_count_trading_days(spark):
    out = run(spark, pick(spark), flat(spark, {5: (111.0, 109.0, 110.0)}))
    assert out[5]["exit_date"] == DAYS[5] and abs(out[5]["raw_return_pct"] - 10) < 1e-9
    assert out[10]["status"] == "computed" and out[20]["status"] == "not_mature"
    assert out[5]["barrier_touched"] is None


def test_signal_day_outside_the_calendar_is_not_mature(spark):
    out = run(spark, pick(spark, day=datetime.date(2026, 8, 15)), flat(spark))
    assert {r["status"] for r in out.values()} == {"not_mature"}


def test_stop_wins_on_a_day_that_touches_both(spark):
    out = run(spark, pick(spark, 90.0, 120.0), flat(spark, {3: (125.0, 85.0, 100.0), 2: (110.0, 95.0, 100.0)}))
    assert (out[5]["barrier_touched"], out[5]["touch_date"]) == ("stop", DAYS[3])
    assert run(spark, pick(spark, 90.0, 120.0), flat(spark))[5]["barrier_touched"] == "time"


def test_dividend_does_not_trip_the_stop(spark):
    fall = {i: (90.5, 89.0, 90.0) for i in range(2, 11)}
    ev = [("A", DAYS[2], 10.0, 0.0, False, 1)]
    out = run(spark, pick(spark, 95.0, 130.0), flat(spark, fall), ev)
    assert out[5]["barrier_touched"] == "time" and abs(out[5]["adjusted_return_pct"]) < 1e-9 and abs(out[5]["raw_return_pct"] + 10) < 1e-9
    assert run(spark, pick(spark, 95.0, 130.0), flat(spark, fall))[5]["barrier_touched"] == "stop"


def test_missing_exit_bar_keeps_adjustment_and_touch(spark):
    rows = [(d, 101.0, 99.0, 100.0) for d in DAYS if d != DAYS[5]]
    out = run(spark, pick(spark, 90.0, 120.0), bars_of(spark, rows), [("A", DAYS[1], 1.0, 0.0, False, 1)])
    assert out[5]["status"] == "no_price_at_exit" and out[5]["cash_per_share"] == 1.0 and out[5]["barrier_touched"] == "time"
    assert out[5]["adjusted_return_pct"] is None and out[10]["status"] == "computed"


def test_benchmark_adds_the_dividend_back(spark):
    days = [datetime.date(2026, 8, d) for d in (14, 17, 18, 19)]
    closes = spark.createDataFrame([("B", d, c) for d, c in zip(days, (100.0, 101.0, 99.0, 102.0))], "code string, d date, close double")
    ev = spark.createDataFrame([("B", days[2], 2.0, 0.0, False, 1)], EVENT)
    iv = spark.createDataFrame([("B", days[0], days[2]), ("B", days[0], datetime.date(2026, 8, 16))], "code string, from_d date, to_d date")
    got = {r["to_d"]: r["benchmark_return"] for r in benchmark.benchmark_return(iv, closes, ev).collect()}
    assert abs(got[days[2]] - 0.01) < 1e-12 and got[datetime.date(2026, 8, 16)] is None
    idx = benchmark.total_return_index(closes, cal_of(spark, days), ev)
    values = [r["total_return_index"] for r in idx.orderBy("i").collect()]
    assert values[0] == 100.0 and abs(values[2] - 101.0) < 1e-9 and abs(values[1] - 101.0) < 1e-9
    assert benchmark.max_drawdown(idx).first()["max_drawdown"] == 0.0


def test_action_on_a_day_without_a_bar_counts_on_the_next_bar(spark):
    days = DAYS[:4]
    closes = spark.createDataFrame([("B", days[0], 100.0), ("B", days[3], 99.0)], "code string, d date, close double")
    ev = spark.createDataFrame([("B", days[1], 1.0, 0.0, False, 1)], EVENT)
    values = [r["total_return_index"] for r in benchmark.total_return_index(closes, cal_of(spark, days), ev).orderBy("i").collect()]
    assert abs(values[-1] - 100.0) < 1e-9


def test_fewer_than_thirty_give_no_verdict(spark):
    rows = [(5, "watchlist", 2.0, 1.0)] * 29
    df = spark.createDataFrame(rows, "horizon int, list_kind string, asset_pct double, benchmark_pct double")
    r = benchmark.compare_to_benchmark(df, ["horizon"]).first()
    assert r["status"] == "insufficient_sample" and r["stdev_excess"] == 0 and r["mean_over_stdev"] is None
    more = df.unionByName(spark.createDataFrame([(5, "watchlist", 2.0, 1.0), (5, "watchlist", 2.0, None)], df.schema))
    r = benchmark.compare_to_benchmark(more, ["horizon"]).first()
    assert (r["status"], r["n"], r["unmatched"]) == ("beats_benchmark", 30, 1)


def test_entry_price_must_be_positive(spark):
    with pytest.raises(Exception, match="entry price"):
        spark.range(1).select(outcomes.raw_return(F.lit(0.0), F.lit(1.0))).collect()
