"""Expressions and helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but the six ASCII separators; none for NULL."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare != "", F.split(bare, SEPARATORS)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def marked(value: Column) -> Column:
    """A value as text that keeps NULL apart from any text and ends where the value ends."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """A 128-bit key of several values, NULL being a value of its own."""
    return F.unhex(F.md5(F.concat(*(marked(v) for v in values))))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for a keyed shuffle: the session's number, which grows with the cluster's input."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
