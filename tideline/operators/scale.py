"""Ordered positions inside groups of any size.

A window function keeps one group in one task, which is wrong when a single day, factor or source can
hold a third of all rows. Every ordered operator here goes through :func:`prefix_total`, which spreads
each group over range partitions and adds the totals of the partitions before. The placement of rows
has to be the same for both uses, so it is written once when the operator is applied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import WindowSpec

from tideline.session import materialise

def prefix_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column | None = None, out: str = "before", total: str | None = None) -> DataFrame:
    """Add the total weight of the rows that sort before each row inside its group, and as ``total`` the group's.

    ``order`` must be a total order inside a group.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    earlier = (W.unboundedPreceding, -1)
    # Range partitions are sampled, so the placement is written once and read by both branches.
    placed = materialise(
        df.withColumn("_w", weight)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    pieces = placed.groupBy(*keys, "_part").agg(F.sum("_w").alias("_piece"))
    by_piece = W.partitionBy(*keys).orderBy("_part").rowsBetween(*earlier)
    offsets = pieces.select(
        *keys, "_part", F.coalesce(F.sum("_piece").over(by_piece), F.lit(0)).alias("_offset"),
        *([F.sum("_piece").over(W.partitionBy(*keys)).cast("bigint").alias(total)] if total else []),
    )
    local = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(*earlier)
    joined = placed.alias("p").join(
        offsets.alias("o"),
        _same([*keys, "_part"], "p", "o"),
    )
    return joined.select(
        *[F.col(f"p.{c}") for c in placed.columns], F.col("o._offset"), *([F.col(f"o.{total}")] if total else [])
    ).withColumn(
        out, (F.col("_offset") + F.coalesce(F.sum("_w").over(local), F.lit(0))).cast("bigint")
    ).drop("_w", "_part", "_offset")


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Position 1..n inside each group under a total order."""
    return prefix_total(df, keys, order, out=out).withColumn(out, F.col(out) + 1)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float | Column]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, position (n−1)·p.

    Values are counted first, so repeats cost one row, and no task ever buffers a group.
    """
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_eq"))
    hist = prefix_total(hist, keys, [F.col(value)], F.col("_eq"), out="_lt")
    totals = hist.groupBy(*keys).agg(F.sum("_eq").alias("_n"))
    return _quantiles(hist.join(totals, list(keys)), keys, value, fractions)


def _quantiles(hist: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float | Column]) -> DataFrame:
    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_lt") <= position) & (position < F.col("_lt") + F.col("_eq")), F.col(value)))

    aggs = []
    for name, p in fractions.items():
        h = (F.col("_n") - 1) * (p if isinstance(p, Column) else F.lit(float(p)))
        aggs += [
            at(F.floor(h)).alias(f"_{name}_a"),
            at(F.ceil(h)).alias(f"_{name}_b"),
            F.max(h - F.floor(h)).alias(f"_{name}_f"),
        ]
    out = hist.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)
    return out.select(
        *keys,
        "n",
        *[
            (F.col(f"_{x}_a") + (F.col(f"_{x}_b") - F.col(f"_{x}_a")) * F.col(f"_{x}_f")).alias(x)
            for x in fractions
        ],
    )


# ── running values of any associative step ───────────────────────────────────


@dataclass(frozen=True)
class Scan:
    """A running value that partial results of pieces can be put together from.

    ``local`` is the value inside a row's own piece, given the ordered window; ``whole`` sums a piece up,
    given the row's place in it; ``earlier`` is that over the pieces before, given the frame; ``joined``
    puts the two together, the first being NULL where no piece comes before.
    """

    local: Callable[[WindowSpec], Column]
    whole: Callable[[Column], Column]
    earlier: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def running_max(value: Column) -> Scan:
    """The greatest value so far."""
    return Scan(lambda w: F.max(value).over(_upto(w)), lambda _: F.max(value), lambda c, w: F.max(c).over(w), F.greatest)


def running_sum(value: Column) -> Scan:
    """The sum of the values so far; NULL counts as nothing."""
    return Scan(
        lambda w: F.sum(value).over(_upto(w)), lambda _: F.sum(value), lambda c, w: F.sum(c).over(w),
        lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))


def running_product(value: Column) -> Scan:
    """The product of the values so far; NULL counts as one."""
    value = F.coalesce(value.cast("double"), F.lit(1.0))
    return Scan(
        lambda w: F.product(value).over(_upto(w)), lambda _: F.product(value), lambda c, w: F.product(c).over(w),
        lambda a, b: F.coalesce(a, F.lit(1.0)) * b)


def running_last(value: Column) -> Scan:
    """The last value so far that is not NULL."""
    known = value.isNotNull()
    return Scan(
        lambda w: F.last(value, True).over(_upto(w)), lambda at: F.max_by(F.when(known, value), F.when(known, at)),
        lambda c, w: F.last(c, True).over(w), lambda a, b: F.coalesce(b, a))


def previous(value: Column) -> Scan:
    """The value of the row right before, which may itself be NULL."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        lambda w: F.lag(boxed).over(w), lambda at: F.max_by(boxed, at), lambda c, w: F.last(c).over(w),
        lambda a, b: F.coalesce(b, a)["v"])


class Placed:
    """Rows dealt to range partitions of (keys, order) and written: one placement for any number of scans.

    A key's rows may lie in many partitions; the part of them in one is a piece. A scan works on the pieces,
    then over one row for each piece, and joins the two, so no task has to see a whole key.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]):
        self.rows, self.keys, self.order = rows, list(keys), list(order)

    def _pieces(self) -> list[str]:
        return ["_part", *self.keys]

    def scan(self, **scans: Scan) -> Placed:
        """Add a column for each scan."""
        w = W.partitionBy(*self._pieces()).orderBy(*self.order)
        local = self.rows.withColumns({f"_own_{n}": s.local(w) for n, s in scans.items()} | {"_n": F.row_number().over(w)})
        whole = local.groupBy(*self._pieces()).agg(*[s.whole(F.col("_n")).alias(f"_all_{n}") for n, s in scans.items()])
        before = W.partitionBy(*self.keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        return self._joined(local, whole.select(*self._pieces(), *[s.earlier(F.col(f"_all_{n}"), before).alias(f"_old_{n}") for n, s in scans.items()]), {
            n: s.joined(F.col(f"o._old_{n}"), F.col(f"p._own_{n}")) for n, s in scans.items()})

    def fold(self, out: str, inputs: Sequence[str], state: str, start: tuple, step: Callable[..., tuple], merged: Callable[[Column, Column], Column]) -> Placed:
        """Add the struct ``out`` of type ``state``: ``step(state, *inputs)`` folded over the rows so far.

        The steps run in Arrow batches, a piece at a time; ``merged(before, own)`` is the struct of two
        stretches put one after the other, which is what makes the fold associative.
        """
        kind = T._parse_datatype_string(state)
        names = [f.name for f in kind.fields]
        pieces = self._pieces()
        schema = T.StructType([*self.rows.schema.fields, T.StructField("_own", kind), T.StructField("_n", T.LongType())])
        ordered = self.rows.repartition(*pieces).sortWithinPartitions(*pieces, *self.order)
        own = list(to_arrow_type(kind))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, now, n = None, start, 0
            for batch in batches:
                places = zip(*(batch.column(c).to_pylist() for c in pieces))
                found, numbers = [], []
                for place, values in zip(places, zip(*(batch.column(c).to_pylist() for c in inputs))):
                    if place != key:
                        key, now, n = place, start, 0
                    now, n = step(now, *values), n + 1
                    found.append(now)
                    numbers.append(n)
                fields = [pa.array(c, t.type) for c, t in zip(zip(*found) if found else [[]] * len(names), own)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fields, names), pa.array(numbers, pa.int64())], [*batch.schema.names, "_own", "_n"])

        done = ordered.mapInArrow(local, schema)
        whole = done.groupBy(*pieces).agg(F.max_by("_own", "_n").alias("_all"))
        before = W.partitionBy(*self.keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        # one element for each earlier piece of the key: never more than there are partitions
        none = F.lit(None).cast(kind)
        older = F.aggregate(F.collect_list("_all").over(before), none, lambda a, b: F.when(a.isNull(), b).otherwise(merged(a, b).cast(kind)))
        a, b = F.col("o._old"), F.col("p._own")
        return self._joined(done, whole.select(*pieces, older.alias("_old")), {out: F.when(a.isNull(), b).otherwise(merged(a, b).cast(kind))})

    def _joined(self, local: DataFrame, older: DataFrame, columns: dict[str, Column]) -> Placed:
        both = local.alias("p").join(older.alias("o"), _same(self._pieces(), "p", "o"))
        kept = [c for c in self.rows.columns if c not in columns]
        return Placed(both.select(*[F.col(f"p.{c}") for c in kept], *[v.alias(n) for n, v in columns.items()]), self.keys, self.order)

    def done(self) -> DataFrame:
        return self.rows.drop("_part")


def place(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> Placed:
    """Deal and write the rows; ``order`` is a total order inside a key."""
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    return Placed(materialise(dealt), keys, order)
