import datetime

from pyspark.sql import functions as F

from tideline.operators import align, ranking

DAY = datetime.date(2026, 1, 5)


def days(n):
    return [DAY + datetime.timedelta(days=i) for i in range(n)]


def test_midrank_averages_ties(spark):
    df = spark.createDataFrame([("d", "f", i, v) for i, v in enumerate((10.0, 20.0, 20.0, 30.0))], "d string, factor string, code long, value double")
    out = ranking.score_cross_section(df, F.lit(False), lower_pct=0, upper_pct=100).orderBy("code").collect()
    assert [r["midrank"] for r in out] == [1, 2.5, 2.5, 4]
    assert [round(r["score"], 6) for r in out] == [0, 0.5, 0.5, 1]


def test_single_value_is_neutral_and_direction_turns_scores(spark):
    one = spark.createDataFrame([("d", "f", 1, 5.0)], "d string, factor string, code long, value double")
    assert ranking.score_cross_section(one, F.lit(True)).first()["score"] == 0.5
    two = spark.createDataFrame([("d", "f", 1, 5.0), ("d", "f", 2, 9.0)], "d string, factor string, code long, value double")
    out = ranking.score_cross_section(two, F.lit(True), lower_pct=0, upper_pct=100).orderBy("code").collect()
    assert [r["score"] for r in out] == [1.0, 0.0]


def test_missing_factor_counts_as_neutral_and_no_data_is_dropped(spark):
    rows = [("d", "a", 1, 1.0), ("d", "a", 2, 0.0), ("d", "b", 1, 0.8)]
    scored = spark.createDataFrame(rows, "d string, factor string, code long, score double")
    out = {r["code"]: r for r in ranking.composite(scored, spark.createDataFrame([("d", "a", "active"), ("d", "b", "active")], "d string, factor string, state string")).collect()}
    assert abs(out[1]["composite"] - 0.9) < 1e-12 and abs(out[2]["composite"] - 0.25) < 1e-12
    assert out[2]["real_factors"] == 1 and set(out) == {1, 2}


def bars_of(spark, closes, notes=None):
    rows = [(1, d, float(c), (notes or {}).get(i)) for i, (d, c) in enumerate(zip(days(len(closes)), closes)) if c is not None]
    return spark.createDataFrame(rows, "code long, d date, close double, note string")


def cal_of(spark, n):
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(days(n))], "d date, i long")


def test_reversal_needs_six_clean_days(spark):
    full = ranking.reversal(bars_of(spark, [10, 11, 12, 13, 14, 12.0]), cal_of(spark, 6)).collect()
    assert len(full) == 1 and abs(full[0]["reversal"] - 0.2) < 1e-12
    assert ranking.reversal(bars_of(spark, [10, 11, None, 13, 14, 12.0]), cal_of(spark, 6)).count() == 0
    assert ranking.reversal(bars_of(spark, [10, 11, 12, 13, 14, 12.0], {3: "除息"}), cal_of(spark, 6)).count() == 0


def test_facts_published_later_change_nothing(spark):
    picks = spark.createDataFrame([(1, datetime.date(2026, 8, 10)), (1, datetime.date(2026, 8, 20))], "code long, d date")
    facts = [(1, "2026-06", datetime.date(2026, 7, 10), 1.0), (1, "2026-07", datetime.date(2026, 8, 15), 2.0)]
    schema = "code long, period string, report_date date, v double"
    out = align.asof_join(picks, spark.createDataFrame(facts, schema), "d", ["v"]).orderBy("d").collect()
    assert [r["v"] for r in out] == [1.0, 2.0]
    later = spark.createDataFrame(facts + [(1, "2026-08", datetime.date(2026, 9, 10), 99.0)], schema)
    assert [r["v"] for r in align.asof_join(picks, later, "d", ["v"]).orderBy("d").collect()] == [1.0, 2.0]


def test_first_of_equal_facts_counts(spark):
    picks = spark.createDataFrame([(1, datetime.date(2026, 8, 10))], "code long, d date")
    facts = spark.createDataFrame([(1, "2026-06", DAY, 5.0, 0), (1, "2026-06", DAY, 9.0, 1)], "code long, period string, report_date date, v double, pos long")
    for unique in (True, False):
        assert [r["v"] for r in align.asof_join(picks, facts, "d", ["v"], unique=unique, pos="pos").collect()] == [5.0]


def test_unique_picks_ride_through_the_asof_window(spark):
    picks = spark.createDataFrame([(1, datetime.date(2026, 8, 10), "x"), (2, datetime.date(2026, 8, 20), "y")], "code long, d date, tag string")
    facts = spark.createDataFrame([(1, "2026-06", datetime.date(2026, 7, 10), 1.0)], "code long, period string, report_date date, v double")
    out = {r["tag"]: r["v"] for r in align.asof_join(picks, facts, "d", ["v"], unique=True).collect()}
    assert out == {"x": 1.0, "y": None}


def test_calendar_grid_has_no_gap(spark):
    bars = bars_of(spark, [10, None, 12.0])
    grid = align.dense_grid(bars, cal_of(spark, 3)).orderBy("i").collect()
    assert [r["close"] for r in grid] == [10.0, None, 12.0]


def test_unreadable_interval_covers_every_day(spark):
    cands = spark.createDataFrame([(1, DAY), (2, DAY)], "code long, d date")
    notes = spark.createDataFrame([(5, 1, None, DAY), (6, 2, DAY + datetime.timedelta(days=1), DAY + datetime.timedelta(days=3))], "pos long, code long, start_d date, end_d date")
    assert [r["code"] for r in align.interval_cover(cands, notes).collect()] == [1]
