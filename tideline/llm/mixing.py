"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import marked, word_count
from tideline.session import materialise

#: The golden ratio's fraction as a 32-bit step: slot i stands at i * GOLDEN mod 2^32.
GOLDEN = 2654435769
_RING = 1 << 32
#: Points are looked up among the cumulative weights by cells of 2^20 points.
_CELL = 1 << 20
_CHUNK = 1 << 16
BLOCK_TOKENS = 128
_BUCKET_DOCUMENTS = 512
SALTS = 32


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """Target of each source: (source_key, source, source_size, documents, target, lo, hi).

    ``sizes`` has (source_key, source, size). Sources in code point order, NULL last, take the weights
    in turn and share the sum of all sizes; what lies above ``most_repeats`` times a source's size goes
    to the others by weight. That is one level for all uncapped sources: in the order of cap over
    weight, a source is capped while its cap is below its share of what is left. [lo, hi) is the part
    of the ring of 2^32 points that the source owns. Without any words all targets are 0.
    """
    every = Window.partitionBy(F.lit(0))  # a row for each source, not for each document
    ranked = (
        sizes.groupBy("source_key", "source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
        .withColumn("no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", most_repeats * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every))
    )
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), "no")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    capped = (
        ranked.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("capped", F.col("cap").cast(wide) * F.col("weights_left").cast("decimal(12,0)") <= F.col("rest").cast(wide) * F.col("weight").cast("decimal(12,0)"))
        .withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every))
        .withColumn("free_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("free_words") / F.col("free_weight")))
    )
    upto = F.sum(F.round("target").cast("long")).over(every.orderBy("no"))
    ring = F.when(F.col("total") > 0, (F.lit(float(_RING)) * upto / F.sum(F.round("target").cast("long")).over(every)).cast("long")).otherwise(0)
    return (
        capped.withColumn("hi", ring)
        .withColumn("lo", F.coalesce(F.lag("hi").over(every.orderBy("no")), F.lit(0).cast("long")))
        .select("source_key", "source", "source_size", "documents", "target", "total", "lo", "hi")
    )


def slot_schedule(targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix as slots of ``block_tokens`` words: (slot, source_key, block).

    Slot i stands at a golden-ratio point, belongs to the source that owns the point, and takes the
    source's next block: its rank among the source's slots, counted in chunks of slots so that a large
    source never needs one window over all its slots.
    """
    spark = targets.sparkSession
    total = targets.agg(F.max("total")).first()[0] or 0
    half = 1 << 16
    low, high = F.col("slot") % half, F.expr(f"(slot div {half}) % {half}")
    # i * GOLDEN mod 2^32 without overflow, the upper half of i counting mod 2^16 only
    point = F.pmod(F.pmod(high * GOLDEN, F.lit(half)) * half + low * GOLDEN, F.lit(_RING))
    slots = spark.range(-(-total // block_tokens)).select(F.col("id").alias("slot")).withColumn("point", point)
    cells = (
        targets.where("hi > lo")
        .select("source_key", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {_CELL}"), F.expr(f"(hi - 1) div {_CELL}"))).alias("cell"))
    )
    owned = (
        slots.withColumn("cell", F.expr(f"point div {_CELL}"))
        .join(cells, "cell")
        .where("point >= lo and point < hi")
        .select("slot", "source_key", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    )
    chunks = owned.groupBy("source_key", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("source_key", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_key", "chunk").orderBy("slot")
    return (
        owned.withColumn("i", F.row_number().over(inside))
        .join(chunks, ["source_key", "chunk"])
        .select("slot", "source_key", (F.col("before") + F.col("i") - 1).alias("block"))
    )


def shuffled_places(sized: DataFrame, documents: int) -> DataFrame:
    """Where each document starts in its source's shuffled stream of words, as column ``start``.

    The shuffle orders by a hash; a source is cut into hash ranges of some thousand documents, whose
    sums are added up first, so that no window holds a whole source.
    """
    buckets = max(1, documents // _BUCKET_DOCUMENTS)
    ranged = sized.withColumn("bucket", F.expr(f"cast((shiftright(shuffle_key, 32) + 2147483648) * {buckets} div {_RING} as long)"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        ranged.groupBy("source_key", "bucket").agg(F.sum("size").alias("n"))
        .select("source_key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return (
        ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["source_key", "bucket"])
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("bucket", "before", "inside")
    )


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows joined with one row per source; a large source's rows are dealt to several tasks by a salt."""
    salt = F.pmod(F.xxhash64("start"), F.lit(SALTS)).cast("int")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(salted, ["source_key", "salt"]).drop("salt")


def mixed_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                    weights: Sequence[int] = (5, 2, 1), most_repeats: int = 3, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Words that the mix takes of each document: (doc_id, size, source_size, target, taken).

    Block k of a source is words [k * block_tokens, (k + 1) * block_tokens) of its shuffled stream,
    read up to ``most_repeats`` times over; the schedule's blocks are joined with the documents they
    cut. NULL and empty texts have size 0 and taken 0, a NULL source is a source; repeated rows are
    documents of their own; an empty table gives no rows; other columns are not read.
    """
    sized = materialise(
        docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
                    word_count(F.col(text_column).cast("string")).alias("size"),
                    F.xxhash64(F.col(id_column), F.col(text_column)).alias("shuffle_key"))
        .withColumn("source_key", marked(F.col("source")))
    )
    targets = materialise(source_targets(sized, weights, most_repeats))
    slots = slot_schedule(targets, block_tokens)
    documents = targets.agg(F.max("documents")).first()[0] or 0
    placed = materialise(
        _with_source(shuffled_places(sized, documents), targets.select("source_key", "source_size", "target"))
        .select("doc_id", "source_key", "size", "source_size", "target", "start")
    )
    taken = slots.groupBy("source_key").agg(F.count("*").alias("blocks"))
    pieces = (
        _with_source(placed.where("size > 0"), taken)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))))
        .withColumn("a", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("blocks") * block_tokens))
        .where("a < b")
        .withColumn("block", F.explode(F.sequence(F.expr(f"a div {block_tokens}"), F.expr(f"(b - 1) div {block_tokens}"))))
        .withColumn("words", F.least("b", (F.col("block") + 1) * block_tokens) - F.greatest("a", F.col("block") * block_tokens))
        .select("source_key", "start", "block", "words")
    )
    used = pieces.join(slots, ["source_key", "block"]).groupBy("source_key", "start").agg(F.sum("words").alias("used"))
    return placed.join(used, ["source_key", "start"], "left").select(
        "doc_id", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("used", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))
