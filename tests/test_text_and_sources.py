import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tideline.functions import dates, hashing, judging, text
from tideline.operators import quality, textqueue
from tideline.sources import catalog, ledger, mapping, payloads as pay


def column(spark, values, name="c"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_numbers_blank_and_unparsable(spark):
    raw = ["1,234.5", " +7 ", "---", "", None, "N/A", "1D", "NaN", "Infinity", "0x10", "-3", "　5　", "1e3", ",", "1e999"]
    out = column(spark, raw).select("i", text.numeric_value(F.col("c")).alias("v"), text.numeric_status(F.col("c")).alias("s")).orderBy("i").collect()
    assert [r["v"] for r in out] == [1234.5, 7.0, None, None, None, None, None, None, None, None, -3.0, 5.0, 1000.0, None, None]
    b, u, p = "blank", "unparsable", "parsed"
    assert [r["s"] for r in out] == [p, p, b, b, b, b, u, u, u, u, p, p, p, u, u]


def test_integers_are_not_rounded_and_notes_are_kept(spark):
    c = F.col("c")
    out = column(spark, ["1,000", "1.5", "除息 ", "3"]).select("i", text.integer_value(c).alias("n"), text.integer_status(c).alias("s"), text.change_note(c).alias("note"), text.noted_status(c).alias("ns")).orderBy("i").collect()
    assert [r["n"] for r in out] == [1000, None, None, 3]
    assert out[1]["s"] == "unparsable" and out[2]["note"] == "除息" and out[2]["ns"] == "noted"


def test_dates(spark):
    c = F.col("c")
    out = column(spark, ["1150814", "1150230", "840102", "115081", "20260814"]).select("i", dates.roc_date(c).alias("roc"), dates.ad_date(c).alias("ad")).orderBy("i").collect()
    assert [r["roc"] for r in out] == [datetime.date(2026, 8, 14), None, datetime.date(1995, 1, 2), None, None]
    assert out[4]["ad"] == datetime.date(2026, 8, 14)
    both = column(spark, ["115/08/12～115/08/25", "1150812~1150825", "115/8/1", "115/08/12～bad"]).select("i", dates.interval_bound(c, 0).alias("a"), dates.interval_bound(c, 1).alias("b")).orderBy("i").collect()
    start, end = datetime.date(2026, 8, 12), datetime.date(2026, 8, 25)
    assert [(r["a"], r["b"]) for r in both] == [(start, end), (start, end), (None, None), (start, None)]
    assert column(spark, ["11507", "11513"]).select(dates.roc_period(c)).collect()[0][0] == "2026-07"


def test_first_json_object_ignores_braces_in_strings(spark):
    raw = ['x {"a":"}{\\"","b":{"c":1}} y }', "none", '{"open": "', '{"a":1', '{"s":"multi\nline"} {"t":2}']
    out = [r[0] for r in column(spark, raw).orderBy("i").select(judging.first_json_object(F.col("c"))).collect()]
    assert out == ['{"a":"}{\\"","b":{"c":1}}', None, None, None, '{"s":"multi\nline"}']


def test_invented_quotes_void_a_veto(spark):
    rows = [
        (1, '{"verdict":"veto","quote":"被 主管機關處以罰鍰五百萬元","reason":"r"}'), (2, '{"verdict":"veto","quote":"沒有出現過的一段話語","reason":"r"}'),
        (3, '{"verdict":"no_veto"}'), (4, '{"verdict":"buy"}'), (5, '{"verdict":"veto","quote":12345678,"reason":"r"}'), (6, '{"verdict": veto}'),
    ]
    df = spark.createDataFrame(rows, "k int, raw_response string").withColumn("subject", F.lit("公告")).withColumn("detail", F.lit("本公司被主管機關\n處以罰鍰五百萬元 12345678"))
    out = {r["k"]: (r["verdict"], r["evidence_verified"], r["parse_ok"]) for r in judging.judge_responses(df).collect()}
    assert out == {1: ("veto", True, True), 2: ("no_veto", False, True), 3: ("no_veto", True, True), 4: ("no_veto", False, False), 5: ("no_veto", False, True), 6: ("no_veto", False, False)}


def test_commands(spark):
    raw = ["/rec 買 2330 100 580.5", "/rec 賣 2330 100", "/rec 觀望 6121 想再等等", "/rec 備註 今天 怪怪的", "hi", "/help", "/rec 買 23 1 1", "/rec 買 2330 1.5 10", "/rec 略過"]
    msgs = column(spark, raw, "text")
    out = [r for r in judging.parse_commands(msgs).orderBy("i").collect()]
    assert [r["kind"] for r in out] == ["rec", "error", "rec", "rec", "ignored", "help", "error", "error", "error"]
    assert [r["error"] for r in out] == [None, "missing_shares_or_price", None, None, None, None, "bad_code", "bad_shares", "missing_code"]
    assert (out[0]["action"], out[0]["code"], out[0]["shares"], out[0]["price"]) == ("buy", "2330", 100, 580.5)
    assert out[2]["note"] == "想再等等" and out[3]["note"] == "今天 怪怪的" and out[3]["code"] is None


def test_payload_observation(spark):
    bodies = [(1, '[{"a":1,"b ":2},{"a":1},7]'), (2, "<html>"), (3, '{"a":1}'), (4, "[]"), (5, '[{"b.c":"x"}]')]
    df = spark.createDataFrame(bodies, "id long, body string")
    states = {r[0]: r[1] for r in df.select("id", pay.payload_state(F.col("body"))).collect()}
    assert states == {1: None, 2: "invalid_json", 3: "payload_not_an_array", 4: "payload_empty", 5: None}
    rows = pay.json_rows(df)
    assert {r["id"]: r["fields"] for r in pay.observed_fields(rows).collect()} == {1: ["a", "b "], 5: ["b.c"]}
    het = {r["id"]: (r["row_count"], r["heterogeneous"]) for r in pay.heterogeneous_rows(rows).collect()}
    assert het == {1: (3, 2), 5: (1, 0)}


def test_every_payload_answers_in_one_pass(spark):
    bodies = [(1, '[{"a":1,"b ":2},{"a":1},7]'), (2, "\n\u00a0<html>"), (3, ' {"a":1}'), (4, "[]"), (5, "[null]"), (6, None), (7, "[7]"), (8, '"["'), (9, "[1")]
    df = spark.createDataFrame(bodies, "id long, body string")
    rows = pay.json_rows(df, every=True)
    assert {r.id: r.state for r in rows.collect()} == {1: None, 2: "invalid_json", 3: "payload_not_an_array", 4: "payload_empty", 5: None, 6: "invalid_json", 7: None, 8: "payload_not_an_array", 9: "invalid_json"}
    assert {r.id: r.fields for r in pay.observed_fields(rows).collect()} == {1: ["a", "b "]} | {i: [] for i in range(2, 10)}
    het = {r.id: (r.row_count, r.heterogeneous) for r in pay.heterogeneous_rows(rows).collect()}
    assert het == {1: (3, 2), 5: (1, 0), 7: (1, 0)} | {i: (0, 0) for i in (2, 3, 4, 6, 8, 9)}
    html = {r.id for r in df.where(pay.looks_like_html(F.col("body"))).collect()}
    assert html == {2}


def test_files_are_keyed_by_their_bytes(spark, tmp_path):
    files = {"plain.json": b'[{"a":1}]', "bom.json": b'\xef\xbb\xbf[{"a":1}]', "bad.json": b'[{"a":"\xff\xfe"}]', "cut.json": "[{\"a\":\"é".encode()[:-1], "mark.html": b"\xef\xbb\xbf <html>"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.json").write_bytes(b"")  # no payload
    found = pay.with_text(pay.read_payload_files(spark, str(tmp_path)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.withColumns({
        "hash": hashing.content_hash(F.col("content")), "state": pay.payload_state(F.col("body")), "html": pay.looks_like_html(F.col("body"))}).collect()}
    assert {n: r.hash for n, r in rows.items()} == {n: hashlib.sha256(c).hexdigest() for n, c in files.items()}
    assert {n: bytes(r.content) for n, r in rows.items()} == files and {n: r.length for n, r in rows.items()} == {n: len(c) for n, c in files.items()}
    assert {n: r.decode_fault for n, r in rows.items()} == {"plain.json": None, "bom.json": "byte_order_mark", "bad.json": "invalid_utf8", "cut.json": "invalid_utf8", "mark.html": "byte_order_mark"}
    assert {n: r.state for n, r in rows.items()} == {"plain.json": None, "bad.json": None} | dict.fromkeys(("bom.json", "cut.json", "mark.html"), "invalid_json")
    assert rows["bad.json"].body == '[{"a":"\ufffd\ufffd"}]' and {n for n, r in rows.items() if r.html} == {"mark.html"}

    # landed as bytes, each content once, the same bytes back
    numbered = found.select(F.xxhash64("path").alias("id"), F.lit("s").alias("source_id"), F.lit(None).cast("date").alias("data_as_of"), "content")
    store = str(tmp_path / "store")
    twice = numbered.unionByName(numbered.withColumn("id", F.col("id") + 1))
    plan = ledger.land(twice, store, body="content")
    assert "content" not in plan.columns and plan.where("written").count() == len(files)
    assert {r.content_hash: bytes(r.content) for r in spark.read.parquet(store).collect()} == {hashlib.sha256(c).hexdigest(): c for c in files.values()}


def test_declared_baselines_come_first(spark, tmp_path):
    seen = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["x", "y"]), (3, "b", []), (4, "b", ["z"])], "id long, source_id string, fields array<string>")
    (tmp_path / "base.jsonl").write_text('{"source_id":"a","fields":["y","x"]}\n{"source_id":"c","fields":["q"]}\n')
    declared = catalog.read_baselines(spark, str(tmp_path / "base.jsonl"))
    assert {r.source_id: r.baseline for r in catalog.baseline_fields(seen, declared=declared).collect()} == {"a": ["x", "y"], "b": ["z"], "c": ["q"]}
    assert {r.source_id: r.baseline for r in catalog.baseline_fields(seen).collect()} == {"a": ["x"], "b": ["z"]}


def test_announcement_maps_read_each_markets_own_names(spark):
    twse = {"發言日期": "1150815", "公司代號": "7835", "主旨 ": "主旨帶空格欄位", "符合條款": "第51款", "說明": "說明內容"}
    tpex = {"發言日期": "1150815", "SecuritiesCompanyCode": "6488", "主旨": "主旨無空格欄位", "符合條款": "第26款", "說明": "說明內容"}
    rows = spark.createDataFrame([("TWSE", twse), ("TPEx", tpex), ("TPEx", twse), ("TWSE", {**twse, "發言日期": ""})], "market string, row map<string,string>")
    out = mapping.per_market(rows, mapping.ANNOUNCEMENT)
    kept = {r["code"]: r["subject"] for r in mapping.kept(out).collect()}
    assert kept == {"7835": "主旨帶空格欄位", "6488": "主旨無空格欄位"}
    reasons = sorted(r["outcome"] for r in quality.skip_stats(out).collect())
    assert reasons == ["kept", "missing_code", "missing_speak_date"]


def test_content_key_ignores_day_and_layout(spark):
    base = ("TWSE", "1721", "第51款", "更名公告", "1.事實發生日：民國115年06月29日 2.公司名稱：國慶")
    rows = [base, base[:4] + ("1.事實發生日：民國115年06月29日\r\n  2.公司名稱：國慶",), base[:4] + (base[4] + "(更正)",), ("TPEx", *base[1:]), (base[0], "3708", *base[2:])]
    df = spark.createDataFrame(rows, "market string, code string, clause string, subject string, detail string")
    keys = [r["content_key"] for r in textqueue.content_keyed(df).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4


def test_landing_is_written_once_per_content(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(1, "s", None, "x"), (2, "s", None, "x"), (3, "t", datetime.date(2026, 1, 2), "y")]
    df = spark.createDataFrame(rows, "id long, source_id string, data_as_of date, body string")
    first = {r["id"]: r["written"] for r in ledger.land(df, store).collect()}
    assert first == {1: True, 2: False, 3: True}
    again = spark.createDataFrame([(4, "s", None, "x"), (5, "s", None, "z")], df.schema)
    assert {r["id"]: r["written"] for r in ledger.land(again, store).collect() if r["id"] == 4} in ({4: False},)
    assert spark.read.parquet(store).count() == 3


def test_changed_body_stops_the_load(spark):
    led = spark.createDataFrame([("p", "0" * 64)], "path string, content_hash string")
    body = spark.createDataFrame([("p", "text")], "path string, body string")
    with pytest.raises(Exception, match="does not match its hash"):
        ledger.load_verified(led, body).collect()


def test_source_catalogue(spark):
    rows = catalog.SOURCES
    assert len(rows) == 36 and len({r[0] for r in rows}) == 36
    groups = {r["source_group"]: r["declared"] for r in catalog.source_activity(spark.createDataFrame([("twse_attention",)], "source_id string"), catalog.sources(spark)).collect()}
    assert groups == {"quotes": 4, "filings": 6, "derivatives": 3, "flows": 4, "status": 8, "ex_right": 3, "extended": 8}


def test_every_rule_set_runs(spark):
    df = spark.sql("SELECT 'x' AS content_hash, CAST(NULL AS STRING) AS data_period, 'file' AS body_store, 'payload_empty' AS data_as_of_reason")
    out = {r["rule"]: r["violations"] for r in quality.audit_table(df, "snapshots").collect()}
    assert out == {"content_hash_format": 1, "data_period_format": 0, "body_store": 0, "date_reason": 0}
    models = spark.sql("SELECT 'champion' AS role, 'ollama' AS provider, 'http://localhost:11434/x' AS endpoint, 0.9D AS gold_accuracy, 40 AS gold_sample_size, 'h' AS gold_set_hash, CAST(NULL AS INT) AS gold_false_negatives")
    out = {r["rule"]: r["violations"] for r in quality.audit_table(models, "models").collect()}
    assert out["champion_needs_score"] == 1 and out["local_endpoint"] == 0
    bad = models.withColumn("endpoint", F.lit("http://example.com/"))
    assert {r["rule"]: r["violations"] for r in quality.audit_table(bad, "models").collect()}["local_endpoint"] == 1
    with pytest.raises(Exception, match="rule role is violated"):
        quality.enforce(bad.withColumn("role", F.lit("x")), quality.ROW_RULES["models"]).collect()
