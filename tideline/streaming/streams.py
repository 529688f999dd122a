"""Streams over arriving payloads, records, ticks and queue items.

Each stream reuses the batch operator of the same name inside ``foreachBatch`` or as a plain
transformation, runs until the input on hand is consumed (``availableNow``), and writes to the
shared folder, so a restart resumes from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tideline.functions.hashing import content_hash
from tideline.functions.judging import parse_commands
from tideline.operators.align import last_by_key
from tideline.session import shared_table_path
from tideline.sources.ledger import new_bodies, plan_landing
from tideline.streaming.store import PrefixStore

FILES_PER_TRIGGER = 64


def stream_files(spark: SparkSession, folder: str, name_pattern: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """Files of ``folder`` as a stream, with the file's own schema declared and not inferred."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", name_pattern)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Start, drain what is there and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


STORED_BODY = "source_id string, data_as_of date, content_hash string, path string, body string"


def body_store(spark: SparkSession, path: str, **options) -> PrefixStore:
    return PrefixStore(spark, path, ["content_hash"], STORED_BODY, **options)


def stream_land(snapshots: DataFrame, store: PrefixStore, ledger: str, checkpoint: str) -> None:
    """Content-addressed landing, exactly once per content.

    A batch is planned against what earlier batches stored under the prefixes of its own hashes; the rest
    of the store is not read. Store and ledger rows lie in folders named by the batch, so a batch
    repeated after a failure replaces itself.
    """

    def land_batch(batch: DataFrame, batch_id: int) -> None:
        store.begin(batch_id)
        keys = batch.select(content_hash(F.col("body")).alias("content_hash"))
        plan = plan_landing(batch, store.lookup(keys, batch_id).select("content_hash"))
        store.append(new_bodies(batch, plan), batch_id, keys)
        rows = plan.select("id", "source_id", "data_as_of", "content_hash", "path", "written")
        rows.write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")

    run_available(snapshots.writeStream.foreachBatch(land_batch), checkpoint)


def stream_records(messages: DataFrame, out: str, checkpoint: str, allowed: list[int] | None = None, lateness: str = "1 hour") -> None:
    """Valid records from a message stream; resends within the watermark are dropped."""
    own = messages if allowed is None else messages.filter(F.col("sender").isin(*allowed))
    once = own.withWatermark("sent_at", lateness).dropDuplicatesWithinWatermark(["message_id"])
    records = parse_commands(once).filter("kind = 'rec'").select(
        "message_id", "sent_at", F.col("sent_at").cast("date").alias("d"), "sender", "action", "code", "shares", "price", "note"
    )
    run_available(records.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


EFFECTIVE = "d date, code string, sent_at timestamp, message_id long, action string, shares long, price double"


def effective_store(spark: SparkSession, path: str, **options) -> PrefixStore:
    """A store of the effective record of each (day, code); compaction keeps one row a key."""
    def newest(versions: DataFrame) -> DataFrame:
        return last_by_key(versions, ["d", "code"], ["batch"])

    return PrefixStore(spark, path, ["d", "code"], EFFECTIVE, newest=newest, **options)


def stream_last_wins(records: DataFrame, store: PrefixStore, checkpoint: str) -> None:
    """Effective record per (day, code): the last sent counts, whatever batch it comes in.

    A batch's last records meet the stored ones of their own prefixes; those that win are stored as new
    versions. Nothing is held in memory between batches.
    """
    last = F.struct("sent_at", "message_id")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        store.begin(batch_id)
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in store.kind.fields])
        own = last_by_key(rows, store.keys, ["sent_at", "message_id"])
        stored = store.newest(store.lookup(own, batch_id)).select(*[F.col(k).alias(f"_{k}") for k in store.keys], last.alias("_stored"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in store.keys]
        won = own.join(stored, same, "left").where(F.col("_stored").isNull() | (last > F.col("_stored"))).select(*own.columns)
        store.append(won, batch_id, own)

    run_available(records.writeStream.foreachBatch(upsert), checkpoint)


def queue_store(spark: SparkSession, path: str, **options) -> PrefixStore:
    return PrefixStore(spark, path, ["task_key"], "task_key long, code string", **options)


def stream_queue(items: DataFrame, judged: DataFrame | PrefixStore, store: PrefixStore, checkpoint: str) -> None:
    """New items minus those already judged or queued by an earlier batch.

    Of the queue, and of the judged items where they are a store as well, a batch reads the prefixes of its own keys.
    """

    def enqueue(batch: DataFrame, batch_id: int) -> None:
        store.begin(batch_id)
        fresh = batch.select("task_key", "code").groupBy("task_key").agg(F.min("code").alias("code"))
        known = store.lookup(fresh, batch_id).select("task_key")
        done = judged.lookup(fresh, 2**62) if isinstance(judged, PrefixStore) else judged
        store.append(fresh.join(known.unionByName(done.select("task_key")), "task_key", "left_anti"), batch_id, fresh)

    run_available(items.writeStream.foreachBatch(enqueue), checkpoint)


def scratch(spark: SparkSession, label: str) -> str:
    return shared_table_path(spark, label)
