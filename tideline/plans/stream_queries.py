"""Streaming queries: each drains the driver tables as a stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions.judging import record_rows
from tideline.operators import outcomes
from tideline.plans.catalogue import query
from tideline.plans.outcome_queries import picks
from tideline.plans.views import Tables, event_k
from tideline.session import materialise
from tideline.streaming import barriers, streams
from tideline.streaming.daily import DailyStream, bar_days, health_days
from tideline.streaming.store import PrefixStore
from tideline.streaming.streams import scratch


SLICES = 3


def arriving(t: Tables, rows: DataFrame, label: str, run) -> None:
    """Let rows arrive in slices (column ``s``) and start the stream anew after each, from its checkpoint."""
    folder, checkpoint = scratch(t.spark, label), scratch(t.spark, "checkpoint")
    kind = rows.drop("s").schema
    for n in range(SLICES):
        rows.where(F.col("s") == n).drop("s").write.mode("append").parquet(folder)
        # one batch a slice, so that what is late does not hang on the number of files
        run(streams.stream_files(t.spark, folder, "*.parquet", kind, files_per_trigger=None), checkpoint)


def tick_slices(t: Tables) -> DataFrame:
    """Ticks by thirds of the days; every fiftieth arrives a third later. A watermark needs a zone (UTC)."""
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("code"), "event_type", "value", event_k().alias("k"))
    day = F.unix_date(F.col("ts").cast("date"))
    lo, hi = e.agg(F.min(day), F.max(day)).first()
    third = F.floor((day - lo) * SLICES / (hi - lo + 1)) if lo is not None else F.lit(0)
    return e.withColumn("s", F.least(F.lit(SLICES - 1), third + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).cast("int"))


TAGGED = """WITH sl AS (SELECT t.*, least(2, CAST(floor((d - lo) * 3 / (hi - lo + 1)) AS INT) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS s FROM ticks t CROSS JOIN (SELECT min(d) AS lo, max(d) AS hi FROM ticks) b),
   tops AS (SELECT s, max(ts) AS top FROM sl GROUP BY s),
   marks AS (SELECT a.s, max(b.top) - INTERVAL 6 HOUR AS mark FROM tops a LEFT JOIN tops b ON b.s < a.s GROUP BY a.s),
   tagged AS (SELECT sl.*, coalesce(d + INTERVAL 1 DAY <= mark, false) AS late, d + INTERVAL 1 DAY <= (SELECT max(top) - INTERVAL 6 HOUR FROM tops) AS closed FROM sl JOIN marks USING (s))"""


def both_ends(days: DailyStream) -> DataFrame:
    """Settled days and those still open."""
    return days.closed().withColumn("closed", F.lit(True)).unionByName(days.flush().withColumn("closed", F.lit(False)))


@query("stream_land", """SELECT doc_id AS id, source AS source_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id % 3, doc_id) = 1 AS written FROM documents""")
def stream_land(t: Tables) -> DataFrame:
    snaps = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit(None).cast("date").alias("data_as_of"), F.col("text").alias("body"), (F.col("doc_id") % SLICES).alias("s"))
    store, ledger = streams.body_store(t.spark, scratch(t.spark, "store")), scratch(t.spark, "ledger")
    arriving(t, snaps, "snapshots", lambda rows, checkpoint: streams.stream_land(rows, store, ledger, checkpoint))
    return t.spark.read.parquet(ledger).select("id", "source_id", "content_hash", "written")


def message_stream(t: Tables) -> DataFrame:
    """Messages derived from the tick stream; every fiftieth arrives twice."""
    raw = streams.stream_files(t.spark, t.folder, "events.parquet", t.events.schema)
    return t.message_rows(raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("code"), "event_type", "value", event_k().alias("k")))


@query("stream_records", "SELECT message_id, d, action, code, shares, round(price, 4) AS price, note FROM records WHERE sender IN (1, 2, 3, 4)")
def stream_records(t: Tables) -> DataFrame:
    out = scratch(t.spark, "records")
    streams.stream_records(message_stream(t), out, scratch(t.spark, "checkpoint"), allowed=[1, 2, 3, 4])
    return t.spark.read.parquet(out).select("message_id", "d", "action", "code", "shares", F.round("price", 4).alias("price"), "note")


@query("stream_last_wins", "SELECT d, code, max_by(action, sent_at) AS action, max(message_id) AS message_id FROM records GROUP BY d, code")
def stream_last_wins(t: Tables) -> DataFrame:
    store = streams.effective_store(t.spark, scratch(t.spark, "effective"))
    messages = t.message_rows(tick_slices(t))
    arriving(t, record_rows(messages).withColumn("s", F.col("message_id") % SLICES), "messages", lambda rows, checkpoint: streams.stream_last_wins(rows, store, checkpoint))
    return store.rows().select("d", "code", "action", "message_id")


STATUS = "CASE WHEN k % 10 = 0 THEN 'fetch_failed' WHEN k % 7 = 0 THEN 'schema_drift' ELSE 'ok' END"


def health_stream(t: Tables) -> DailyStream:
    log = tick_slices(t).select("ts", F.col("event_type").alias("source_id"), F.expr(STATUS).alias("status"), "s")
    days = health_days(t.spark, scratch(t.spark, "health"))
    arriving(t, log, "log", days.run)
    return days


@query("stream_health", f"""{TAGGED} SELECT d, event_type AS source_id, {STATUS} AS status, count(*) AS n, closed FROM tagged WHERE NOT late GROUP BY ALL""")
def stream_health(t: Tables) -> DataFrame:
    return both_ends(health_stream(t))


@query("stream_health_late", f"{TAGGED} SELECT event_type AS source_id, d, count(*) AS n FROM tagged WHERE late GROUP BY ALL")
def stream_health_late(t: Tables) -> DataFrame:
    return health_stream(t).late()


@query("stream_bars", f"""{TAGGED} SELECT code, d, first(value ORDER BY ts, value) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, value) AS close, count(*) AS vol, closed
   FROM tagged WHERE NOT late GROUP BY code, d, closed""")
def stream_bars(t: Tables) -> DataFrame:
    days = bar_days(t.spark, scratch(t.spark, "bars"))
    arriving(t, tick_slices(t).select("ts", "code", "value", "s"), "ticks", days.run)
    return both_ends(days)


def watched_days(t: Tables, horizon: int) -> DataFrame:
    """(pick, following trading day) rows with the bar and the actions folded since the signal."""
    cal = t.cal()
    p = picks(t).filter("stop is not null").join(cal, "d")
    last = cal.select(F.col("d").alias("_last"), (F.col("i") - horizon).alias("i"))
    # a deadline after the calendar's end is put where it lies at the latest
    p = p.join(last, "i", "left").withColumn("deadline", F.coalesce("_last", F.date_add("d", 3 * horizon)))
    ahead = p.select("pick_id", "code", F.col("d").alias("from_d"), "i", "stop", "target", "deadline", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
    days = ahead.withColumn("j", F.col("i") + F.col("k")).join(cal.select(F.col("d").alias("to_d"), F.col("i").alias("j")), "j")
    adjusted = outcomes.adjustment_for(days.drop("i", "j"), t.actions())
    bars = t.bars().select("code", F.col("d").alias("to_d"), "high", "low")
    return adjusted.join(bars, ["code", "to_d"], "left").select(
        "pick_id", F.col("k").cast("int").alias("k"), F.col("to_d").alias("day"), "deadline", "stop", "target", "high", "low", "factor", "cash")


@query("stream_barriers", """WITH s AS (SELECT p.pick_id, (SELECT min(k) FROM touches t WHERE t.pick_id = p.pick_id AND t.k <= 10) AS tk, (SELECT max(k) FROM pick_days x WHERE x.pick_id = p.pick_id AND x.k <= 10) AS reach FROM picks p WHERE stop IS NOT NULL)
   SELECT s.pick_id, CASE WHEN tk IS NULL THEN 'time' ELSE (SELECT kind FROM touches t WHERE t.pick_id = s.pick_id AND t.k = tk) END AS exit_kind, coalesce(tk, 10) AS days_used FROM s WHERE tk IS NOT NULL OR reach = 10""")
def stream_barriers(t: Tables) -> DataFrame:
    """The days come in three slices; those of every fourth pick that lie three days or less before a border come one slice late."""
    horizon = 10
    days = materialise(watched_days(t, horizon))
    lo, hi = days.agg(F.min(F.unix_date("day")), F.max(F.unix_date("day"))).first()
    day = F.unix_date("day") + F.when(F.col("pick_id") % 4 == 0, 3).otherwise(0)
    days = days.withColumn("s", F.least(F.lit(SLICES - 1), F.floor((day - lo) * SLICES / (hi - lo + 1)).cast("int")) if lo is not None else F.lit(0))
    out = scratch(t.spark, "exits")
    arriving(t, days, "pick-days", lambda rows, checkpoint: barriers.stream_barriers(rows, out, checkpoint, horizon))
    return t.spark.read.schema(barriers.OUTPUT).parquet(out).select("pick_id", "exit_kind", F.col("days_used").cast("bigint").alias("days_used"))


@query("stream_queue", "SELECT doc_id AS task_key, source AS code FROM documents WHERE doc_id NOT IN (SELECT task_key FROM verdicts)")
def stream_queue(t: Tables) -> DataFrame:
    """Every tenth item comes again in the slice after its own."""
    items = t.documents.select(F.col("doc_id").alias("task_key"), F.col("source").alias("code"), (F.col("doc_id") % SLICES).alias("s"))
    items = items.unionByName(items.where("task_key % 10 = 0 and s < 2").withColumn("s", F.col("s") + 1))
    judged = PrefixStore(t.spark, scratch(t.spark, "judged"), ["task_key"], "task_key long")
    judged.append(t.verdicts().select("task_key"), 0)
    store = streams.queue_store(t.spark, scratch(t.spark, "queue"))
    arriving(t, items, "items", lambda rows, checkpoint: streams.stream_queue(rows, judged, store, checkpoint))
    return store.rows()
