"""Cumulative snapshots of logged conversations collapsed to the longest, then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import digest, marked
from tideline.session import materialise

#: Turns of a conversation that are rendered together at most.
SPAN = 256
_WIDE = "decimal(38,0)"


def _hash_of(value: Column, half: int) -> Column:
    """Half of a 128-bit digest as a number that sums without overflow."""
    return F.conv(F.substring(F.hex(value), 1 + 16 * half, 16), 16, 10).cast("decimal(20,0)")


def ordered_turns(turns: DataFrame, *, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Each turn with its place (from 1) and the rolling hash of the prefix that ends with it.

    Turns are ordered by (turn, role, text), NULL first; rows equal in all four columns are one turn.
    The rolling hash is the sum of digests of (place, role, text), so prefixes of pieces add up. Pieces are
    cut by range partitions of the order itself: a conversation of any length is ordered by many tasks,
    whatever its turn numbers.
    """
    rows = turns.select(
        F.col(id_column).alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
        F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text"),
    ).distinct()
    rows = rows.withColumn("conv_key", marked(F.col("conv_id")))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # range partitions are sampled, so the placement is written once
    dealt = materialise(rows.repartitionByRange("conv_key", *order).withColumn("piece", F.spark_partition_id()))
    counts = dealt.groupBy("conv_key", "piece").agg(F.count("*").alias("n"))
    # a row for each piece at most
    earlier = Window.partitionBy("conv_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_key", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("turns_before"))
    placed = (
        dealt.withColumn("i", F.row_number().over(Window.partitionBy("conv_key", "piece").orderBy(*order)))
        .join(before, ["conv_key", "piece"])
        .withColumn("place", F.col("turns_before") + F.col("i"))
        .withColumn("turn_hash", digest(F.col("place"), F.col("role"), F.col("text")))
        .withColumn("h0", _hash_of(F.col("turn_hash"), 0)).withColumn("h1", _hash_of(F.col("turn_hash"), 1))
        .drop("i", "turns_before", "turn_hash", "turn")
    )
    placed = materialise(placed)
    sums = placed.groupBy("conv_key", "piece").agg(F.sum("h0").cast(_WIDE).alias("s0"), F.sum("h1").cast(_WIDE).alias("s1"))
    none = F.lit(0).cast(_WIDE)
    sums = sums.select("conv_key", "piece", F.coalesce(F.sum("s0").over(earlier).cast(_WIDE), none).alias("b0"), F.coalesce(F.sum("s1").over(earlier).cast(_WIDE), none).alias("b1"))
    running = Window.partitionBy("conv_key", "piece").orderBy("place")
    return (
        placed.withColumn("r0", F.sum("h0").over(running).cast(_WIDE)).withColumn("r1", F.sum("h1").over(running).cast(_WIDE))
        .join(sums, ["conv_key", "piece"])
        .withColumn("prefix", F.concat_ws("/", F.col("place").cast("string"), (F.col("r0") + F.col("b0")).cast("string"), (F.col("r1") + F.col("b1")).cast("string")))
        .select("conv_id", "conv_key", "place", "role", "text", "prefix")
    )


def maximal_conversations(ordered: DataFrame) -> DataFrame:
    """(conv_key, turns, copies): conversations that are no proper prefix of another, one of equals.

    A conversation's last prefix hash is looked up among the inner prefix hashes of all others; hashes
    that many conversations share, like a common first turn, are made distinct before the anti-join.
    Of equal conversations the smallest id stays, NULL being smallest.
    """
    whole = ordered.groupBy("conv_key").agg(F.max_by("prefix", "place").alias("prefix"), F.max("place").alias("turns"), F.first("conv_id").alias("conv_id"))
    last = ordered.groupBy("conv_key").agg(F.max("place").alias("turns"))
    inner = ordered.join(last, "conv_key").where("place < turns").select("prefix").distinct()
    order = F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id").alias("conv_id"), F.col("conv_key").alias("conv_key"))
    return (
        whole.groupBy("prefix").agg(F.min(order).alias("least"), F.max("turns").alias("turns"), F.count("*").alias("copies"))
        .join(inner, "prefix", "left_anti")
        .select(F.col("least.conv_key").alias("conv_key"), "turns", "copies")
    )


def rendered(turns: DataFrame, *, opening: str = "<|", closing: str = "|>", end: str = "<|end|>", span: int = SPAN, **columns: str) -> DataFrame:
    """Maximal conversations as chat text: (conv_id, part, turns, copies, rendered).

    A turn becomes opening, role, closing, newline, text, end, newline; NULL role or text is empty. A
    conversation is rendered in parts of ``span`` turns in their order (part 0, 1, ...), whatever their
    numbers, so even one with a large share of all rows is never built in one task; most have part 0
    only. Turns without a number come first, rows equal in all four columns are one turn, other
    columns are not read, and an empty table gives no rows.
    """
    ordered = materialise(ordered_turns(turns, **columns))
    kept = maximal_conversations(ordered)
    blank = F.lit("")
    line = F.concat(F.lit(opening), F.coalesce("role", blank), F.lit(closing + "\n"), F.coalesce("text", blank), F.lit(end + "\n"))
    return (
        ordered.join(kept, "conv_key")
        .groupBy("conv_key", F.expr(f"cast((place - 1) div {span} as int)").alias("part"))
        .agg(F.first("conv_id").alias("conv_id"), F.first("turns").alias("turns"), F.first("copies").alias("copies"),
             F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        .select("conv_id", "part", "turns", "copies", F.array_join(F.col("lines.line"), "").alias("rendered"))
    )
