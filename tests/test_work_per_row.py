"""Work of a row: cells rendered and parsed once, sizes found in a narrow bracket."""

import datetime

import pytest
from pyspark.sql import functions as F

from tideline.functions import dates, text
from tideline.operators import risk
from tideline.operators.cost import Broker
from tideline.plans import load_queries

QUERIES = load_queries()[0]
DAY = datetime.date(2024, 1, 5)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with a few line items of its own."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, i % 40, i % 90, i % 7 + 1, float(i % 50 + 1), 100.0 + i, "R", datetime.datetime(1995, 1, 1) + datetime.timedelta(i % 60)) for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_largest_size_equals_a_scan(spark):
    brokers = [Broker(), Broker(commission_rounding="ceil", tax_rounding="half_up"), Broker(min_commission=0, discount_bps=2800)]
    priced = [(e, sigma) for e in (0.3, 0.52, 1.0, 7.77, 50.0, 123.45, 900.0, 9999.0) for sigma in (0.001, 0.004, 0.03, 0.15, None, 0.5)]
    df = spark.createDataFrame([(DAY, i, e, s) for i, (e, s) in enumerate(priced)], "d date, code long, entry double, sigma double")
    for broker in brokers:
        for lot, equity in ((1, 10_000.0), (7, 10_000.0), (1, 1_500.0)):
            config = risk.RiskConfig(lot_size=lot, equity=equity, broker=broker)
            sized = risk.size_candidates(df, config, mode="max")
            upper = F.floor(F.lit(config.risk_budget) / F.col("risk_per_share") / lot).cast("bigint")
            every = sized.where("feasible").select("code", "entry_cents", "stop_cents", F.explode(F.sequence(F.lit(0).cast("bigint"), upper)).alias("_lots"))
            fits = every.where((F.col("_lots") == 0) | (risk._stop_loss(F.col("_lots") * lot, config) <= config.risk_budget))
            expected = {r.code: r.n for r in fits.groupBy("code").agg((F.max("_lots") * lot).alias("n")).collect()}
            got = {r.code: r.shares for r in sized.select("code", "shares").collect()}
            assert {k: v for k, v in got.items() if v is not None} == expected
            assert len(expected) == 32 and (any(expected.values()) or equity < 2_000)


def test_largest_size_halves_a_bracket_of_its_row(spark, folder):
    sized = plan(QUERIES["position_sizes_max"](spark, folder))
    assert "log2" in sized.lower() and f"[{', '.join(map(str, range(1, 41)))}]" not in sized and "sequence(1, 40" not in sized


def test_cells_are_rendered_once(spark, folder):
    for name, most in (("map_disposition", 20), ("map_ex_right", 8), ("date_conversions", 8)):
        shown = plan(QUERIES[name](spark, folder))
        assert shown.count("date_format(") + shown.count("dateformatclass(") <= most, name
        assert QUERIES[name](spark, folder).count() > 0


def test_dates_need_no_formatter(spark):
    c = F.col("c")
    cells = ["1150814", "1150230", "001231", "0001231", "1150814\n", "115/8/1", "00/1/1", "20240229", "20230229", "2024-02-29", "2024-02-29\n", None, ""]
    df = spark.createDataFrame([(x,) for x in cells], "c string")
    parsed = df.select("c", dates.roc_date(c).alias("roc"), dates.roc_slashed_date(c).alias("slashed"), dates.ad_date(c).alias("ad"), dates.iso_date(c).alias("iso"))
    got = {r.c: tuple(None if v is None else str(v) for v in r[1:]) for r in parsed.collect()}
    none = (None,) * 4
    assert got == {
        "1150814": ("2026-08-14", None, None, None), "1150230": none, "001231": none, "0001231": none, "1150814\n": ("2026-08-14", None, None, None),
        "115/8/1": (None, "2026-08-01", None, None), "00/1/1": (None, "1911-01-01", None, None), "20240229": (None, None, "2024-02-29", None),
        "20230229": none, "2024-02-29": (None, None, None, "2024-02-29"), "2024-02-29\n": none, None: none, "": none}
    assert "gettimestamp" not in plan(parsed).lower()
    bounds = df.sparkSession.createDataFrame([(x,) for x in ("115/08/12～1150825", "1150812~", "~115/2/30", "a~b~c")], "c string")
    found = [(r.a and str(r.a), r.b and str(r.b)) for r in bounds.select(dates.interval_bound(c, 0).alias("a"), dates.interval_bound(c, 1).alias("b")).collect()]
    assert found == [("2026-08-12", "2026-08-25"), ("2026-08-12", None), (None, None), (None, None)]


def test_numbers_are_looked_for_once(spark):
    cells = {"+1,234": 1234.0, "++5": 5.0, "+-5": -5.0, "--5": None, "1D": None, "1e999": None, "N/A": None, "---": None, "": None, ".5": 0.5, "　7 ": 7.0}
    df = spark.createDataFrame([(x,) for x in cells], "c string").select("c", text.numeric_value(F.col("c")).alias("v"))
    assert {r.c: r.v for r in df.collect()} == cells
    assert plan(df).count("trim") == 1
