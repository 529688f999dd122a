"""Which notice covers a day: an interval sweep in which a notice costs two rows whatever its length."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.session import materialise

# Kinds of rows in the order they are met on a day.
_OPEN_BEFORE, _START, _ASKED, _END = -1, 0, 1, 2
# Days before and after any other, for a bound that is missing.
_FIRST_DAY, _LAST_DAY = -(2**31), 2**31 - 1


def first_cover(notices: DataFrame, asked: DataFrame, key: str, start: str, end: str, pos: str, day: str) -> DataFrame:
    """(key, day, pos): for each asked day the first notice, by ``pos``, that covers it; none for others.

    Starts, ends and asked days are sorted by key and day into range partitions, so a key may lie in
    many. A task sweeps its part of the days with a heap of the open notices, the smallest ``pos`` on top,
    which drops a notice when its end has passed. A notice that ends in a later part enters that part as
    open; of those that cover a part as a whole only the first counts, and which one that is is the same
    question on a line of parts, answered by the same sweep. A missing bound leaves its side open.
    ``pos`` names a notice; several rows of one ``pos`` count as one each. A NULL key covers nothing.
    """
    name = F.col(key).alias("_key")
    spans = notices.where(F.col(key).isNotNull()).groupBy(
        name, F.coalesce(F.unix_date(start), F.lit(_FIRST_DAY)).alias("_s"), F.coalesce(F.unix_date(end), F.lit(_LAST_DAY)).alias("_e")
    ).agg(F.min(pos).alias("_pos")).where("_s <= _e")
    both = spans.select("_key", F.explode(F.array(
        F.struct(F.col("_s").alias("_day"), F.lit(_START).alias("_kind")), F.struct(F.col("_e").alias("_day"), F.lit(_END).alias("_kind")))).alias("_x"), "_s", "_e", "_pos")
    days = asked.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(name, F.unix_date(day).alias("_day")).distinct()
    none = F.lit(None)
    rows = both.select("_key", "_x._day", "_x._kind", "_s", "_e", "_pos").unionByName(
        days.select("_key", "_day", F.lit(_ASKED).alias("_kind"), none.cast("int").alias("_s"), none.cast("int").alias("_e"), none.cast(dict(spans.dtypes)["_pos"]).alias("_pos")))
    placed = materialise(rows.repartitionByRange("_key", "_day", "_kind", "_pos").withColumn("_part", F.spark_partition_id()))

    # the parts in which a notice starts and ends, where they differ
    at = F.when(F.col("_kind") == _START, F.col("_part")), F.when(F.col("_kind") == _END, F.col("_part"))
    long = placed.where(F.col("_kind") != _ASKED).groupBy("_key", "_s", "_e", "_pos").agg(F.max(at[0]).alias("_a"), F.max(at[1]).alias("_b")).where("_a < _b")
    long = materialise(long)
    ending = long.select("_key", F.lit(_FIRST_DAY).alias("_day"), F.lit(_OPEN_BEFORE).alias("_kind"), "_e", "_pos", F.col("_b").alias("_part"))
    across = long.where("_b - _a > 1").groupBy("_key", (F.col("_a") + 1).alias("_from"), (F.col("_b") - 1).alias("_to")).agg(F.min("_pos").alias("_pos"))
    line = across.select("_key", F.col("_from").alias("_day"), F.lit(_START).alias("_kind"), F.col("_to").alias("_e"), "_pos").unionByName(
        placed.where(F.col("_kind") == _ASKED).select("_key", F.col("_part").alias("_day")).distinct().join(across.select("_key").distinct(), "_key", "left_semi")
        .select("_key", "_day", F.lit(_ASKED).alias("_kind"), none.cast("int").alias("_e"), none.cast(dict(spans.dtypes)["_pos"]).alias("_pos")))
    covering = _swept(line.withColumn("_part", F.lit(0)), ["_key"]).select(
        "_key", F.lit(_FIRST_DAY).alias("_day"), F.lit(_OPEN_BEFORE).alias("_kind"), F.lit(_LAST_DAY).alias("_e"), "_pos", F.col("_day").alias("_part"))

    columns = ["_key", "_day", "_kind", "_e", "_pos", "_part"]
    events = placed.where(F.col("_kind") != _END).select(*columns).unionByName(ending.select(*columns)).unionByName(covering.select(*columns))
    found = _swept(events, ["_part"])
    return found.select(F.col("_key").alias(key), F.date_from_unix_date("_day").alias(day), F.col("_pos").alias(pos))


def _swept(events: DataFrame, together: list[str]) -> DataFrame:
    """(_key, _day, _pos) of the asked rows with an open notice, by one pass over the sorted rows."""
    ordered = events.repartition(*together).sortWithinPartitions("_part", "_key", "_day", "_kind", "_pos")
    types = dict(events.dtypes)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, heap = None, []
        for batch in batches:
            rows, found = [], []
            columns = (batch.column(c).to_pylist() for c in ("_part", "_key", "_day", "_kind", "_e", "_pos"))
            for i, (part, key, day, kind, end, pos) in enumerate(zip(*columns)):
                if (part, key) != place:
                    place, heap = (part, key), []
                if kind != _ASKED:
                    heapq.heappush(heap, (pos, end))
                    continue
                while heap and heap[0][1] < day:
                    heapq.heappop(heap)
                if heap:
                    rows.append(i)
                    found.append(heap[0][0])
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("_key"), taken.column("_day"), pa.array(found, batch.schema.field("_pos").type)], ["_key", "_day", "_pos"])

    return ordered.mapInArrow(sweep, f"_key {types['_key']}, _day int, _pos {types['_pos']}")
