"""Exports that count only once their manifest is there, and digests of any number of lines."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import reports, textqueue
from tideline.sources import mapping


def test_export_is_read_back_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "a,b", 'say "x"', "two\nlines", "é"]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, s string, v double").repartition(7)
    outcomes = spark.createDataFrame([(5, 1.0), (5, 3.0), (10, None)], "horizon int, adjusted_return_pct double")
    folder = str(tmp_path / "out")
    for fmt in ("csv", "parquet"):
        first = reports.export_sheets({"all": (df, [F.col("v").desc()]), "none": (df.where("false"), [F.col("k")])}, f"{folder}-{fmt}", fmt, reports.horizon_averages(outcomes))
        second = reports.export_sheets({"all": (df.where("k < 5"), [F.col("k")])}, f"{folder}-{fmt}", fmt)
        back = reports.read_export(spark, f"{folder}-{fmt}", first, fmt)
        got = [tuple(r) for r in back["all"].orderBy("row_no").collect()]
        assert got == [(n, *r) for n, r in enumerate(sorted(rows, key=lambda r: -r[2]), 1)]
        assert back["none"].count() == 0
        assert {r.label: r.value for r in back["summary"].collect()} == {"rows all": 300.0, "rows none": 0.0, "mean T+5": 2.0}
        assert set(reports.read_export(spark, f"{folder}-{fmt}", fmt=fmt)) == {"all", "summary"} and second != first
        # files of an export that never got its manifest are not an export
        df.write.parquet(f"{folder}-{fmt}/export=broken/all")
        with pytest.raises(ValueError, match="no export"):
            reports.read_export(spark, f"{folder}-{fmt}", "broken", fmt)


def test_exam_digests_stream_their_lines(spark):
    rows = [(i, random.Random(i).choice(["veto", "no_veto"])) for i in range(5000)]
    gold = spark.createDataFrame(rows, "item_key long, label string").repartition(6)
    lines = sorted(f"{k}={v}" for k, v in rows)
    assert textqueue.gold_set_hash(gold).first()[0] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    buckets = {}
    for line in lines:
        buckets.setdefault(hashlib.sha256(line.encode()).hexdigest()[:3], []).append(line)
    tree = sorted(f"{b}={hashlib.sha256(chr(10).join(x).encode()).hexdigest()}" for b, x in buckets.items())
    assert textqueue.gold_tree_hash(gold).first()[0] == hashlib.sha256("\n".join(tree).encode()).hexdigest()
    assert textqueue.gold_set_hash(gold.where("false")).first()[0] == hashlib.sha256(b"").hexdigest()


def test_revenue_rows_are_dated_by_their_snapshot(spark):
    row = lambda code: {"公司代號": code, "營業收入-當月營收": "1,000", "營業收入-去年同月增減(%)": "5.5", "營業收入-上月比較增減(%)": "-"}
    rows = spark.createDataFrame([(1, row("2330")), (1, row(" ")), (2, row("2317")), (3, row("1101")), (9, row("1102"))], "id long, row map<string,string>")
    ledger = spark.sql("SELECT * FROM VALUES (1, DATE '2026-08-15', '2026-07'), (2, NULL, '2026-07'), (3, DATE '2026-08-15', NULL) AS l(id, data_as_of, data_period)")
    out = mapping.revenue_facts(rows, ledger)
    assert [(r.code, str(r.report_date), r.period, r.revenue, r.yoy_pct, r.mom_pct) for r in mapping.kept(out).collect()] == [("2330", "2026-08-15", "2026-07", 1000.0, 5.5, None)]
    assert sorted((r.id, r.skip_reason) for r in out.where("skip_reason is not null").collect()) == [(1, "missing_code"), (2, "missing_report_date"), (3, "missing_period"), (9, "missing_report_date")]
