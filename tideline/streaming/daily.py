"""Daily aggregates of a stream, with late rows counted and the open days at hand.

Spark's own watermark drops late rows unseen. Here each batch records the latest time it has met, so
that the next one knows the watermark and splits its rows by it, and every row ends in one of three
places: a closed day, an open day, or a count of late rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.streaming.streams import run_available

_HOUR = 3_600_000_000


def _end(day: str = "d") -> Column:
    """When a day is over, in microseconds."""
    return F.unix_micros(F.date_add(day, 1).cast("timestamp"))


class DailyStream:
    """Aggregates by ``keys`` and day ``d`` of a time column.

    ``parts`` are the aggregates of a batch, ``merged`` those of such partial rows, by the same names, and
    ``final`` makes the result of merged rows. Late rows are counted by ``late_keys`` and day. The
    folders ``partial``, ``closed``, ``late`` and ``top`` have a folder for each batch, which a batch repeated
    after a failure overwrites. A day is closed once it ended ``lateness_hours`` before the latest time
    of all batches so far; rows without a time count as late under no day.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: dict[str, Column], merged: dict[str, Column],
                 final: Callable[[DataFrame], DataFrame] = lambda rows: rows, time: str = "ts", lateness_hours: int = 6, late_keys: Sequence[str] | None = None):
        self.spark, self.path, self.keys, self.parts, self.merged, self.final = spark, path.rstrip("/"), list(keys), parts, merged, final
        self.time, self.lateness, self.late_keys = time, lateness_hours * _HOUR, list(keys if late_keys is None else late_keys)

    def run(self, rows: DataFrame, checkpoint: str) -> None:
        """Drain the stream; a later call with the same checkpoint goes on where this one stopped."""
        run_available(rows.writeStream.foreachBatch(self._batch), checkpoint)

    def _top(self, upto: int | None = None) -> int | None:
        """The watermark after batch ``upto``, or after all, in microseconds; None as long as no time was met."""
        tops = self.spark.read.schema("top long, batch long").parquet(f"{self.path}/top")
        top = (tops if upto is None else tops.where(F.col("batch") <= upto)).agg(F.max("top")).first()[0]
        return None if top is None else top - self.lateness

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        micros = F.unix_micros(F.col(self.time).cast("timestamp"))
        batch.agg(F.max(micros).alias("top")).write.mode("overwrite").parquet(f"{self.path}/top/batch={batch_id}")
        before, after = self._top(batch_id - 1), self._top(batch_id)
        dated = batch.withColumn("d", F.col(self.time).cast("date"))
        late = F.col("d").isNull() if before is None else F.coalesce(_end() <= before, F.lit(True))
        counted = dated.where(late).groupBy(*self.late_keys, "d").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        partial = dated.where(~late).groupBy(*self.keys, "d").agg(*[v.alias(n) for n, v in self.parts.items()])
        partial.write.mode("overwrite").partitionBy("d").parquet(f"{self.path}/partial/batch={batch_id}")
        # all batches' partial rows of the days that the watermark passes now; other days are not read
        rows = self._partials(partial).where(F.col("batch") <= batch_id)
        closing = rows.where(F.lit(False) if after is None else (_end() <= after) & (F.lit(True) if before is None else _end() > before))
        self.final(self._merge(closing)).write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id}")

    def _partials(self, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path}/partial")
        if like is not None:
            reader = reader.schema(like.withColumn("batch", F.lit(0).cast("long")).schema)
        return reader.parquet(f"{self.path}/partial").withColumn("d", F.col("d").cast("date"))

    def _merge(self, partial: DataFrame) -> DataFrame:
        return partial.groupBy(*self.keys, "d").agg(*[v.alias(n) for n, v in self.merged.items()])

    def closed(self) -> DataFrame:
        """Days that are settled: no row of them counts any more."""
        return self.spark.read.parquet(f"{self.path}/closed").drop("batch")

    def flush(self) -> DataFrame:
        """The days still open, as they stand."""
        mark = self._top()
        rows = self._partials()
        return self.final(self._merge(rows if mark is None else rows.where(_end() > mark)))

    def late(self) -> DataFrame:
        """How many rows of each late key and day came after their day was settled."""
        return self.spark.read.parquet(f"{self.path}/late").groupBy(*self.late_keys, "d").agg(F.sum("n").alias("n"))


def health_days(spark: SparkSession, path: str, time: str = "ts", lateness_hours: int = 6) -> DailyStream:
    """Status counts per source and day; late rows are counted per source and day."""
    return DailyStream(spark, path, ["source_id", "status"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, lambda rows: rows.select("d", "source_id", "status", "n"),
                       time, lateness_hours, ["source_id"])


def bar_days(spark: SparkSession, path: str, time: str = "ts", lateness_hours: int = 6) -> DailyStream:
    """Daily bars from ticks; late ticks are counted per code and day."""
    at = F.struct(F.col(time).alias("t"), F.col("value").alias("v"))
    parts = {"first": F.min(at), "high": F.max("value"), "low": F.min("value"), "last": F.max(at), "vol": F.count(F.lit(1))}
    merged = {"first": F.min("first"), "high": F.max("high"), "low": F.min("low"), "last": F.max("last"), "vol": F.sum("vol")}
    bars = ["code", "d", F.col("first.v").alias("open"), "high", "low", F.col("last.v").alias("close"), "vol"]
    return DailyStream(spark, path, ["code"], parts, merged, lambda rows: rows.select(*bars), time, lateness_hours)
