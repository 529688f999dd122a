"""The append-only snapshot ledger and the content-addressed object store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions.hashing import content_hash
from tideline.operators.align import first_by_key, last_by_key
from tideline.session import materialise
from tideline.sources.payloads import UNUSABLE_REASONS

UNKNOWN_DATE = "unknown-date"


def plan_landing(snapshots: DataFrame, stored: DataFrame, body: str = "body", pos: str = "id") -> DataFrame:
    """Every snapshot with its hash, its store path, and whether its bytes are new. Bodies are left out.

    The first snapshot of a hash writes it. The hash is taken of the body, text or bytes, in the scan,
    unless the snapshots have a ``content_hash``; from there on only narrow rows are shuffled. Firsts are
    found by aggregation and matched back on the unique snapshot id, so a body that makes up a third of
    the batch never meets in one task.
    """
    hashed = snapshots if "content_hash" in snapshots.columns else snapshots.withColumn("content_hash", content_hash(F.col(body)))
    hashed = hashed.drop(body)
    firsts = (
        hashed.groupBy("content_hash").agg(F.min(pos).alias(pos))
        .join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
        .select(pos, F.lit(True).alias("_first"))
    )
    folder = F.coalesce(F.col("data_as_of").cast("string"), F.lit(UNKNOWN_DATE))
    return hashed.join(firsts, pos, "left").select(
        *hashed.columns,
        F.concat_ws("/", "source_id", folder, "content_hash").alias("path"),
        F.coalesce("_first", F.lit(False)).alias("written"),
    )


def new_bodies(snapshots: DataFrame, plan: DataFrame, body: str = "body", pos: str = "id") -> DataFrame:
    """The bodies that a plan says are to be written, each once."""
    rows = plan.filter("written").select(pos, "source_id", "data_as_of", "content_hash", "path")
    return rows.join(snapshots.select(pos, body), pos)


def land(snapshots: DataFrame, store: str, body: str = "body") -> DataFrame:
    """Append new bodies to the store (partitioned by source and date) and return the plan rows.

    The plan is written first: once the bodies lie in the store, planning again would call none of them new.
    """
    spark = snapshots.sparkSession
    snapshots.select("source_id", F.lit("").alias("data_as_of"), F.lit("").alias("content_hash"), F.lit("").alias("path"), body).limit(0).write.mode("ignore").partitionBy("source_id", "data_as_of").parquet(store)
    stored = spark.read.schema("content_hash string").parquet(store)
    plan = materialise(plan_landing(snapshots, stored, body))
    new = new_bodies(snapshots, plan, body).withColumn("data_as_of", F.coalesce(F.col("data_as_of").cast("string"), F.lit(UNKNOWN_DATE)))
    new.drop("id").write.mode("append").partitionBy("source_id", "data_as_of").parquet(store)
    return plan


def append_ledger(rows: DataFrame, path: str) -> None:
    """One row per fetch, repeats and failures included; nothing is rewritten."""
    rows.write.mode("append").parquet(path)


def to_ledger_rows(snapshots: DataFrame) -> DataFrame:
    """Snapshot → ledger projection; missing values stay NULL."""
    return snapshots.select(
        F.col("id"), F.col("source_id"), F.col("data_as_of"), F.col("reason").alias("data_as_of_reason"),
        F.col("content_hash"), F.col("content_length").alias("content_bytes"), F.col("path").alias("body_path"),
        F.when(F.col("reason").isin(*UNUSABLE_REASONS), F.lit(None)).otherwise(F.lit("file")).alias("body_store"),
    )


def verified_bodies(ledger: DataFrame, bodies: DataFrame) -> DataFrame:
    """Ledger rows with their body and whether the recomputed hash agrees.

    The store has one object per path, so the hash is taken once per object, not once per row.
    """
    hashed = bodies.select("path", "body", content_hash(F.col("body")).alias("_actual"))
    return ledger.join(hashed, "path", "left").withColumn(
        "verified", F.coalesce(F.col("_actual") == F.col("content_hash"), F.lit(False))
    ).drop("_actual")


def load_verified(ledger: DataFrame, bodies: DataFrame) -> DataFrame:
    """As :func:`verified_bodies`, but any missing or changed body stops the job."""
    checked = verified_bodies(ledger, bodies)
    fail = F.raise_error(F.concat(F.lit("body does not match its hash: "), F.col("path"))).cast("string")
    return checked.withColumn("body", F.when(F.col("verified"), F.col("body")).otherwise(fail)).drop("verified")


def usable_refs(ledger: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows whose payload could be read; other reasons are facts about the date, not defects."""
    return ledger.filter(~F.col(reason).isin(*UNUSABLE_REASONS) & F.col("path").isNotNull())


def latest_ref(ledger: DataFrame, by_date: bool = False) -> DataFrame:
    keys = ["source_id", "data_as_of"] if by_date else ["source_id"]
    return last_by_key(ledger, keys, ["id"])


def recent_days(ledger: DataFrame, n: int) -> DataFrame:
    """Newest write of each (source, date), then each source's ``n`` newest dates.

    After the first step a source has one row per calendar day, which bounds the window.
    """
    newest = latest_ref(ledger.filter("data_as_of is not null"), by_date=True)
    w = W.partitionBy("source_id").orderBy(F.col("data_as_of").desc())
    return newest.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def run_summary(results: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per ingest run: counts and the distinct dates it saw (bounded by the calendar)."""
    return results.groupBy(run).agg(
        F.count_distinct("source_id").alias("sources"),
        F.count_if(F.col("written")).alias("stored"),
        F.count_if(~F.col("written") & ~F.col("failed")).alias("duplicate"),
        F.count_if(F.col("failed")).alias("failed"),
        F.count_if(F.col("registered") & ~F.col("failed") & F.col("drifted")).alias("drift"),
        F.array_join(F.transform(F.array_sort(F.collect_set("data_as_of")), lambda d: d.cast("string")), ",").alias("dates"),
    )


# ── audits ───────────────────────────────────────────────────────────────────


def storage_usage(ledger: DataFrame, capacity: int) -> DataFrame:
    """Bytes per distinct object (size of its first sized row) and the days that still fit."""
    sized = ledger.filter("content_length is not null")
    per_path = first_by_key(sized.select("path", "id", "content_length", "data_as_of"), ["path"], ["id"])
    dated = F.col("data_as_of").isNotNull()
    size = F.col("content_length")
    total = per_path.agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum(size), F.lit(0)).alias("used_bytes"),
        F.coalesce(F.sum(F.when(~dated, size)), F.lit(0)).alias("undated_bytes"),
        F.coalesce(F.sum(F.when(dated, size)), F.lit(0)).alias("_dated"),
        F.count_distinct("data_as_of").alias("days"),
    )
    rate = F.col("_dated") / F.nullif(F.col("days"), F.lit(0))
    return total.select(
        "objects", "used_bytes", "undated_bytes", "days", rate.alias("daily_rate"),
        F.floor((F.lit(capacity) - F.col("used_bytes")) / F.nullif(rate, F.lit(0.0))).cast("bigint").alias("remaining_days"),
    )


def bytes_per_day(ledger: DataFrame) -> DataFrame:
    sized = ledger.filter("content_length is not null")
    per_path = first_by_key(sized.select("path", "id", "content_length", "data_as_of"), ["path"], ["id"])
    return per_path.groupBy("data_as_of").agg(F.count(F.lit(1)).alias("objects"), F.sum("content_length").alias("bytes"))


def integrity_audit(ledger: DataFrame, bodies: DataFrame, limit: int | None = None) -> DataFrame:
    """Each stored path: match, missing or mismatched by hash and length. ``limit`` takes newest paths."""
    expected = first_by_key(ledger.select("path", "id", "content_hash", "content_length"), ["path"], ["id"])
    if limit is not None:
        expected = expected.orderBy(F.col("path").desc()).limit(limit)
    actual = bodies.select("path", content_hash(F.col("body")).alias("_hash"), F.length("body").cast("bigint").alias("_length"))
    state = (
        F.when(F.col("_hash").isNull(), "missing")
        .when((F.col("_hash") == F.col("content_hash")) & (F.col("_length") == F.col("content_length")), "match")
        .otherwise("mismatch")
    )
    return expected.join(actual, "path", "left").select("path", "content_hash", "content_length", state.alias("state"))


def health_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"))


def clean_streaks(log: DataFrame, day: str = "d", failed: Column | None = None) -> DataFrame:
    """Longest run of consecutive logged days without a failure, per source.

    Reduced to one row per source and day first, so a window holds at most the calendar.
    """
    failed = (F.col("status") == "fetch_failed") if failed is None else failed
    days = log.groupBy("source_id", day).agg(F.max(failed).alias("_bad"))
    w = W.partitionBy("source_id").orderBy(day)
    runs = days.withColumn("_island", F.count_if(F.col("_bad")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lengths = runs.filter(~F.col("_bad")).groupBy("source_id", "_island").agg(F.count(F.lit(1)).alias("_len"), F.max(day).alias("_end"))
    return lengths.groupBy("source_id").agg(F.max("_len").alias("longest_streak"), F.max_by("_len", "_end").alias("latest_streak"))
