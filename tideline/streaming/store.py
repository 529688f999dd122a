"""A keyed table that a stream appends to and looks its keys up in, by key prefix.

Rows lie in folders ``data/part=<n>/prefix=p<hex digits>`` by the leading digits of a hash of their key; a
small manifest names the folders that count and their rows. A batch reads the prefixes that its own keys
have and nothing else. Compaction puts all folders into one and takes as many digits as keep a prefix
at its target size, so what a batch reads grows with the batch and not with the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

#: Most digits of a prefix: 16 ** 4 short strings are the most that a batch's prefixes can be at the driver.
MOST_DIGITS = 4
_NOTE = "prefix string, rows long, read long, batch long, compacted boolean, part string"


class PrefixStore:
    """``rows_per_prefix`` is the target of compaction, which runs once ``compact_every`` batches have come since the last.

    ``newest``, given versions of rows with their ``batch``, keeps one a key and so makes this a table of
    current rows; without it every row stays. One stream at a time writes a store, and its
    batches are numbered upwards.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, rows_per_prefix: int = 100_000, compact_every: int = 16,
                 newest: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.kind = T._parse_datatype_string(schema)
        self.rows_per_prefix, self.compact_every, self.newest = rows_per_prefix, compact_every, newest
        # an empty manifest, which a later start finds and leaves as it is
        spark.createDataFrame([], _NOTE).write.mode("ignore").parquet(f"{self.path}/manifest/entry=none")

    def hash(self) -> Column:
        """The key's hash as hex digits."""
        return F.lower(F.lpad(F.hex(F.xxhash64(*self.keys)), 16, "0"))

    def manifest(self, before: int | None = None) -> list[Row]:
        """Folders that count: those of the newest compaction and of the batches after it, all before batch ``before``."""
        notes = [r for r in self._notes() if before is None or r["batch"] < before]
        start = max((r["batch"] for r in notes if r["compacted"]), default=None)
        current = notes if start is None else [r for r in notes if r["batch"] > start or (r["compacted"] and r["batch"] == start)]
        return [r for r in current if r["prefix"] is not None]

    def _notes(self) -> list[Row]:
        return self.spark.read.schema(_NOTE).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest").collect()

    def begin(self, batch_id: int) -> None:
        """Compact what lies before this batch if it is time. A batch repeated after a failure finds that done."""
        entries = self.manifest(batch_id)
        if len({r["part"] for r in entries}) > self.compact_every:
            self._compact(entries, max(r["batch"] for r in entries))

    def lookup(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Stored rows of earlier batches, with their ``batch``, under the prefixes that the batch's keys have."""
        return self._read(self._touched(batch, batch_id))

    def _touched(self, batch: DataFrame, batch_id: int) -> list[Row]:
        entries = self.manifest(batch_id)
        digits = max((len(r["prefix"]) for r in entries), default=0)
        if not digits:
            return entries
        own = {r[0] for r in batch.select(F.substring(self.hash(), 1, digits)).distinct().collect()}
        cut = {n: {p[:n] for p in own} for n in range(digits + 1)}
        return [r for r in entries if r["prefix"] in cut[len(r["prefix"])]]

    def _read(self, entries: list[Row]) -> DataFrame:
        versioned = T.StructType([*self.kind.fields, T.StructField("batch", T.LongType())])
        if not entries:
            return self.spark.createDataFrame([], versioned)
        folders = [f"{self.path}/data/part={r['part']}/prefix=p{r['prefix']}" for r in entries]
        return self.spark.read.schema(versioned).parquet(*folders)

    def rows(self) -> DataFrame:
        """The whole table: current rows where the store keeps those, else all."""
        return self._current(self._read(self.manifest()))

    def _current(self, versions: DataFrame) -> DataFrame:
        return (self.newest(versions) if self.newest else versions).select(*self.kind.names)

    def append(self, rows: DataFrame, batch_id: int, asked: DataFrame | None = None) -> None:
        """Store a batch, which counts once its note is written; repeated, it replaces itself.

        ``asked`` is what was looked up, so that the note can say how many rows that has read.
        """
        digits = max((len(r["prefix"]) for r in self.manifest(batch_id)), default=0)
        read = 0 if asked is None else sum(r["rows"] for r in self._touched(asked, batch_id))
        self._write(rows.withColumn("batch", F.lit(batch_id).cast("long")), batch_id, str(batch_id), digits, read)

    def _compact(self, entries: list[Row], batch_id: int) -> None:
        versions = self._read(entries)
        rows = (self.newest(versions) if self.newest else versions).select(*self.kind.names, "batch")
        total = sum(r["rows"] for r in entries)
        digits = next((n for n in range(MOST_DIGITS) if total <= self.rows_per_prefix * 16**n), MOST_DIGITS)
        self._write(rows, batch_id, f"{batch_id}-compact", digits, 0)
        # what has been replaced is emptied, not only forgotten
        for part in sorted({r["part"] for r in entries}):
            self.spark.createDataFrame([], self.kind).write.mode("overwrite").parquet(f"{self.path}/data/part={part}")

    def _write(self, rows: DataFrame, batch_id: int, part: str, digits: int, read: int) -> None:
        data = f"{self.path}/data/part={part}"
        named = rows.select(*self.kind.names, "batch", F.concat(F.lit("p"), F.substring(self.hash(), 1, digits) if digits else F.lit("")).alias("prefix"))
        (named.repartition("prefix") if digits else named).write.mode("overwrite").partitionBy("prefix").parquet(data)
        counts = self.spark.read.schema(T.StructType([*self.kind.fields, T.StructField("prefix", T.StringType())])).parquet(data).groupBy(F.expr("substring(prefix, 2)").alias("prefix")).agg(F.count("*").alias("rows"))
        compacted = part.endswith("-compact")
        notes = [(r["prefix"], r["rows"], read, batch_id, compacted, part) for r in counts.collect()]
        # a batch without rows still says what it has read
        self.spark.createDataFrame([(None, 0, read, batch_id, compacted, part), *notes], _NOTE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/entry={part}")

    def read_by(self, batch_id: int) -> int:
        """Stored rows that a batch has looked at."""
        return max((r["read"] for r in self._notes() if r["batch"] == batch_id and not r["compacted"]), default=0)
