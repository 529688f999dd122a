"""The driver tables seen as the inputs of the operators: bars, calendar, roster, notices and so on.

Each view is one projection or one aggregation, so column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tideline.operators.align import calendar
from tideline.session import materialise, release


class Tables:
    """Lazily opened driver tables of one scale-factor folder plus the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.written: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # opened once: reading the footer is a job of its own
        return table

    def once(self, name: str, build) -> DataFrame:
        """A table several steps of one query read: written to the shared folder on first use."""
        if name not in self.written:
            self.written[name] = self.step(build(self))
        return self.written[name]

    def step(self, df: DataFrame) -> DataFrame:
        """``df`` written as a job of its own, of which the driver keeps nothing."""
        table = materialise(df)
        release(self.spark)
        return table

    # ── time series ──────────────────────────────────────────────────────────

    def ticks(self) -> DataFrame:
        return self.events.select(
            "event_id", "ts", F.col("user_id").alias("code"), F.col("ts").cast("date").alias("d"),
            "event_type", "value", event_k().alias("k"),
        )

    def daily(self) -> DataFrame:
        """Everything known of a code on a day, from one aggregation; unused columns are pruned."""
        kind, value = F.col("event_type"), F.col("value")

        def net(plus: str, minus: str) -> Column:
            return F.sum(F.when(kind == plus, value).when(kind == minus, -value))

        return self.ticks().groupBy("code", "d").agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.count(F.lit(1)).alias("vol"),
            F.when(F.max("k") >= 98, "NOTE").alias("note"),
            net("purchase", "error").alias("net_a"),
            net("click", "view").alias("net_b"),
            F.sum("k").cast("bigint").alias("bal"),
        )

    def bars(self) -> DataFrame:
        return self.daily().select("code", "d", "open", "high", "low", "close", "vol", "note")

    def closes(self) -> DataFrame:
        return self.bars().select("code", "d", "close", "vol", "note")

    def cal(self) -> DataFrame:
        return calendar(self.events.select(F.col("ts").cast("date").alias("d")))

    def roster(self) -> DataFrame:
        return self.customer.filter("c_mktsegment <> 'MACHINERY'").select(
            F.col("c_custkey").alias("code"),
            F.when(F.col("c_custkey") % 2 == 0, "M0").otherwise("M1").alias("market"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("industry"),
        )

    def flows(self) -> DataFrame:
        return self.daily().select("code", "d", "net_a", "net_b")

    def balances(self) -> DataFrame:
        # one row per code and day: a code's window is bounded by the calendar
        prev = F.lag("bal").over(W.partitionBy("code").orderBy("d"))
        return self.daily().select("code", "d", "bal", prev.alias("prev"))

    def revenue(self) -> DataFrame:
        month = F.date_trunc("month", F.col("o_orderdate")).cast("date")
        return (
            self.orders.groupBy(F.col("o_custkey").alias("code"), month.alias("period"))
            .agg(F.sum("o_totalprice").alias("amount"))
            .select(
                "code", "period", F.date_add(F.add_months("period", 1), 9).alias("report_date"), "amount"
            )
        )

    def actions(self) -> DataFrame:
        return self.ticks().filter("event_type = 'signup'").select(
            F.col("event_id").alias("batch"), "code", F.col("d").alias("ex_date"),
            F.round(F.col("value") / 100, 4).alias("cash"),
            ((F.col("k") % 5) / F.lit(100.0)).alias("ratio"),
            (F.col("k") % 10 == 0).alias("rights"),
        )

    def notices(self) -> DataFrame:
        k = F.col("k")
        return self.ticks().filter("event_type = 'error'").select(
            F.col("event_id").alias("pos"), "code", F.col("d").alias("start_d"),
            F.when(k % 13 != 0, F.date_add("d", k % 7)).alias("end_d"), "k",
        )

    # ── text and ledger ──────────────────────────────────────────────────────

    def raw_text(self) -> DataFrame:
        return self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _raw_cell().alias("raw"))

    def ledger(self) -> DataFrame:
        i = F.col("doc_id")
        return self.documents.select(
            i.alias("id"), F.col("source").alias("source_id"),
            F.when(i % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int"))).alias("data_as_of"),
            F.when(i % 23 == 0, "invalid_json").when(i % 17 == 0, "date_field_missing")
            .otherwise("single_date_in_payload").alias("reason"),
            F.sha2("text", 256).alias("content_hash"),
            F.length("text").cast("bigint").alias("content_length"),
            F.concat(F.col("source"), F.lit("/"), F.sha2("text", 256)).alias("path"),
        )

    def bodies(self) -> DataFrame:
        """What the object store holds, one object per path; some lost, some damaged."""
        i = F.col("doc_id")
        path = F.concat(F.col("source"), F.lit("/"), F.sha2("text", 256))
        objects = self.documents.groupBy(path.alias("path")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
        return objects.filter(i % 29 != 0).select(
            "path", F.when(i % 37 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body")
        )

    def trades(self) -> DataFrame:
        return self.lineitem.filter("l_quantity > 0").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_quantity").cast("bigint").alias("shares"),
            F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity"), 0).cast("bigint").alias("entry_cents"),
            F.col("l_shipdate").cast("date").alias("d"),
        )

    def candidates(self) -> DataFrame:
        """Ranked candidates per ship day with an entry price and a volatility; one row per (d, code)."""
        from tideline.operators.scale import number_rows

        code = F.col("code")
        grouped = self.lineitem.filter("l_quantity > 0").groupBy(
            F.col("l_shipdate").cast("date").alias("d"), F.col("l_partkey").alias("code")
        ).agg((F.floor(F.max(F.col("l_extendedprice") / F.col("l_quantity")) * 2.5 + 0.5) / 100.0).alias("entry"))
        sigma = F.when(code % 23 != 0, 0.004 + (code % 41) / 250.0)
        scored = grouped.withColumn("sigma", sigma).withColumn("score", (code * 7919) % 1000)
        return number_rows(scored, ["d"], [F.col("score").desc(), F.col("code")])

    def risk_state(self) -> DataFrame:
        day = F.dayofmonth("d")
        return self.lineitem.select(F.col("l_shipdate").cast("date").alias("d")).distinct().select(
            "d", (day % 8).cast("int").alias("entries"), (day % 4).cast("int").alias("open_positions"),
            ((day % 5) * 10.0).alias("exposure_pct"), (day % 17).cast("double").alias("drawdown_pct"),
        )

    def announce(self) -> DataFrame:
        return self.documents.select(
            "doc_id", F.col("source").alias("code"), F.col("lang").alias("market"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("speak_date"),
            F.col("text").alias("subject"), F.col("text").alias("detail"),
            F.concat(F.lit("clause"), (F.col("doc_id") % 9).cast("string")).alias("clause"),
        )

    def responses(self) -> DataFrame:
        """Judge answers of every shape: no JSON, another verdict, nested and quoted text, cut off."""
        i = F.col("doc_id")
        quote = F.regexp_replace(F.substring("text", 5, 24), "[^A-Za-z ]", "")
        shape = i % 6
        raw = (
            F.when(shape == 0, "no json here")
            .when(shape == 1, '{"verdict":"buy","quote":"","reason":"r"}')
            .when(shape == 2, 'Answer: {"verdict":"no_veto","quote":"","reason":"ok {a} \\"b\\" }","extra":{"x":1}} tail }')
            .when(shape == 3, F.concat(F.lit('{"verdict": " veto ", "quote":"'), quote, F.lit('","reason":"bad"} {"verdict":"no_veto"}')))
            .when(shape == 4, '{"verdict":"veto","quote":"short","reason":"s"}')
            .otherwise('{"verdict":"veto", "quote": "cut')
        )
        return self.documents.select(
            i.alias("task_key"), raw.alias("raw_response"), F.col("text").alias("subject"), F.col("text").alias("detail"))

    def messages(self) -> DataFrame:
        return self.message_rows(self.ticks())

    @staticmethod
    def message_rows(ticks: DataFrame) -> DataFrame:
        """Chat messages: records, commands, mistakes and plain talk; every fiftieth is sent twice."""
        code, value = F.lpad(F.col("code").cast("string"), 4, "0"), F.col("value").cast("string")
        kind, k, i = F.col("event_type"), F.col("k"), F.col("event_id")
        qty = F.when(k % 9 == 0, "0").when(k % 10 == 0, "x").otherwise((k + 1).cast("string"))
        join = lambda *parts: F.concat_ws(" ", *parts)
        text = (
            F.when(i % 41 == 0, "hello").when(i % 43 == 0, "/help").when(i % 47 == 0, "/what now").when(i % 53 == 0, "/rec").when(i % 59 == 0, "/rec 偷看 2330")
            .when(kind == "purchase", join(F.lit("/rec 買"), code, qty, value, F.when(k % 4 == 0, "first  note")))
            .when(kind == "error", join(F.lit("/rec 賣出"), code, qty, value))
            .when(kind == "view", join(F.lit(" /REC 觀望"), code, F.when(k % 2 == 0, "wait a bit")))
            .when(kind == "click", join(F.lit("/rec 略過"), F.when(k % 8 == 0, "no-code").otherwise(code)))
            .otherwise(join(F.lit("/rec 備註"), F.when(k % 6 != 0, "market mood")))
        )
        copies = F.explode(F.when(i % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
        return ticks.select(
            i.alias("message_id"), F.col("ts").alias("sent_at"), (F.col("code") % 10).alias("sender"), text.alias("text"), copies
        ).drop("copy")

    def gold(self) -> DataFrame:
        def revision(n: int, is_veto: Column) -> list[Column]:
            return [
                F.col("doc_id").alias("item_key"), F.lit(n).cast("bigint").alias("revision"),
                F.when(is_veto, "veto").otherwise("no_veto").alias("label"),
            ]

        second = self.labels.filter("doc_id % 5 = 0").select(*revision(2, F.col("quality") == 0))
        return self.labels.select(*revision(1, F.col("toxic") == 1)).unionByName(second)

    def verdicts(self) -> DataFrame:
        i, n = F.col("doc_id"), F.col("n_chars")
        return self.documents.filter("doc_id % 7 <> 0").select(
            i.alias("task_key"),
            F.when((n < 300) & (i % 31 != 0) & (i % 11 != 0), "veto").otherwise("no_veto").alias("verdict"),
            (i % 31 != 0).alias("parse_ok"),
            (i % 11 != 0).alias("evidence_verified"),
        )

    def payloads(self) -> DataFrame:
        """One raw payload per tick: arrays of objects, plus blocked pages, objects and empty arrays."""
        i, k, code = F.col("event_id"), F.col("k"), F.col("code").cast("string")
        day = F.concat((F.year("d") - 1911).cast("string"), F.date_format("d", "MMdd"))
        first = F.concat(
            F.lit('{"Date":"'), F.when(k % 4 == 0, "").otherwise(day), F.lit('","Code":"'), code,
            F.lit('","Close":"'), F.col("value").cast("string"), F.lit('"}'),
        )
        second = F.concat(F.lit(',{"Date":"'), F.when(k % 2 == 0, "1130131").otherwise(day), F.lit('","Code":"","Volume":"1,234"}'))
        body = (
            F.when(i % 23 == 0, "  <html>blocked</html>").when(i % 29 == 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}")))
            .when(i % 31 == 0, "[]")
            .otherwise(F.concat(F.lit("["), first, F.when(k % 3 == 0, second).otherwise(""), F.when(k % 5 == 0, ",7").otherwise(""), F.lit("]")))
        )
        return self.ticks().select(
            i.alias("id"), F.col("event_type").alias("source_id"), F.col("d"), body.alias("body"),
            F.when(k % 2 == 0, "unique").otherwise("max").alias("selection"),
        )

    def field_tables(self) -> DataFrame:
        """``{fields, data}`` payloads, some with short rows, some without their data."""
        s = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]
        cells = F.concat(F.lit('["'), s[0], F.lit('","'), s[1], F.lit('"'), F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.concat(F.lit(',"'), s[2], F.lit('"'))), F.lit("]"))
        body = F.when(F.col("l_suppkey") % 10 == 0, F.lit('{"fields":["part","supp no."]}')).otherwise(
            F.concat(F.lit('{"fields":["part","supp no."," line"],"data":['), cells, F.lit(","), cells, F.lit("]}"))
        )
        return self.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("id"), body.alias("body"))

    def cells(self, extra: Column | None = None) -> DataFrame:
        """Source cells of every kind, rendered from line items the messy way sources do."""
        year = F.year("l_shipdate") - 1911
        roc = F.concat(year.cast("string"), F.date_format("l_shipdate", "MMdd"))
        slashed = F.concat(year.cast("string"), F.date_format("l_shipdate", "'/'M'/'d"))
        n = F.col("l_linenumber")
        return self.lineitem.select(
            F.when(F.col("l_suppkey") % 2 == 0, "TWSE").otherwise("TPEx").alias("market"),
            F.when(F.col("l_suppkey") % 37 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).alias("code_cell"),
            _raw_cell().alias("number_cell"),
            F.concat(F.col("l_returnflag"), F.lit("　")).alias("text_cell"),
            F.when(n == 7, "1130230").otherwise(roc).alias("roc_cell"),
            F.when(n == 6, "").otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("ad_cell"),
            F.when(n % 2 == 0, roc).otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("mixed_cell"),
            F.when(n % 3 == 0, "Ｙ").when(n % 3 == 1, " Y ").otherwise("").alias("flag_cell"),
            F.when(n % 4 == 0, slashed).when(n % 4 == 1, F.concat(slashed, F.lit("～"), slashed))
            .otherwise(F.concat(roc, F.lit("~"), F.lit("1150827"))).alias("period_cell"),
            F.when(n % 3 == 0, "roc_compact").when(n % 3 == 1, "ad_compact").otherwise("iso").alias("declared"),
            *([] if extra is None else [extra]),
        )


def _raw_cell() -> Column:
    qty = F.col("l_quantity").cast("int").cast("string")
    s = F.col("l_suppkey")
    return (
        F.when(s % 11 == 0, " ---").when(s % 13 == 0, "N/A").when(s % 17 == 0, "除息 ").when(s % 19 == 0, "1D")
        .when(s % 7 == 0, "").when(s % 2 == 0, F.concat(F.lit("+"), qty, F.lit(",000 "))).otherwise(qty)
    )


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")
