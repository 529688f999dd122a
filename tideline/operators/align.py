"""Calendars, rosters, last-wins lookups and point-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators.sweep import first_cover

# Fixed value: two fetches belong to one run when they are at most this far apart.
SAME_RUN_HOURS = 6


# ── calendar ─────────────────────────────────────────────────────────────────


def calendar(df: DataFrame, day: str = "d") -> DataFrame:
    """Trading days seen in the data, numbered from 1. Never built from date arithmetic.

    The days are made distinct first; the unpartitioned window then sees one row per day.
    """
    days = df.select(F.col(day).alias("d")).filter("d is not null").distinct()
    return days.select("d", F.row_number().over(W.orderBy("d")).cast("bigint").alias("i"))


def day_lookup(cal: DataFrame) -> DataFrame:
    """Every natural day of the calendar's span with the trading day at or before / after it."""
    span = cal.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo is not null")
    natural = span.select(F.explode(F.sequence("lo", "hi")).alias("d")).join(cal, "d", "left")
    back = W.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.orderBy("d").rowsBetween(0, W.unboundedFollowing)
    return natural.select("d", F.max("i").over(back).alias("prev_i"), F.min("i").over(ahead).alias("next_i"))


def dense_grid(bars: DataFrame, cal: DataFrame, code: str = "code", day: str = "d") -> DataFrame:
    """One row per code and trading day, NULL where the code has no bar.

    The day numbers are generated inside each code's row, so there is no join without a key.
    """
    codes = bars.select(code).distinct()
    width = cal.agg(F.max("i")).scalar()
    numbered = codes.select(code, F.explode(F.sequence(F.lit(1).cast("bigint"), width)).alias("i"))
    grid = numbered.join(cal.select(F.col("d").alias(day), "i"), "i")
    return grid.join(bars, [code, day], "left")


def calendar_faults(cal: DataFrame, as_of) -> DataFrame:
    """Rows only where a supplied calendar is not ascending and unique, or does not end at as-of."""
    prev = F.lag("d").over(W.orderBy("i"))
    last = F.lead("d").over(W.orderBy("i")).isNull()
    return (
        cal.select("i", "d", prev.alias("prev_d"), last.alias("is_last"))
        .select(
            "i", "d",
            F.when(F.col("d") <= F.col("prev_d"), "not_ascending")
            .when(F.col("is_last") & ~F.col("d").eqNullSafe(F.lit(as_of).cast("date")), "last_day_is_not_as_of")
            .alias("fault"),
        )
        .filter("fault is not null")
    )


# ── last wins / first wins ───────────────────────────────────────────────────


def last_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, by one map-side combined aggregation."""
    return _pick(df, keys, order, F.max_by)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = chooser(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def merge_rosters(*rosters: DataFrame, key: str = "code") -> DataFrame:
    """Union of rosters; for a repeated code the later roster wins."""
    tagged = [r.withColumn("_prio", F.lit(n)) for n, r in enumerate(rosters)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    return last_by_key(merged, [key], ["_prio"]).drop("_prio")


def union_markets(primary: DataFrame, secondary: DataFrame, keys=("code", "d"), day: str = "d") -> DataFrame:
    """Both markets on the primary market's trading days; a day the secondary lacks stays missing."""
    days = primary.select(day).distinct()
    return primary.unionByName(secondary.join(days, day, "left_semi"), allowMissingColumns=True)


# ── universe ─────────────────────────────────────────────────────────────────


def is_tradable(close: str = "close", vol: str = "vol") -> Column:
    return (F.col(close) > 0) & (F.coalesce(F.col(vol), F.lit(0)) > 0)


def in_universe(df: DataFrame, roster: DataFrame, key: str = "code") -> DataFrame:
    return df.join(roster.select(key), key, "left_semi")


def outside_universe(df: DataFrame, roster: DataFrame, key: str = "code") -> DataFrame:
    return df.join(roster.select(key), key, "left_anti")


def missing_from_data(roster: DataFrame, df: DataFrame, key: str = "code") -> DataFrame:
    return roster.join(df.select(key), key, "left_anti").select(key).orderBy(key)


def summarize_universe(roster: DataFrame, quotes: DataFrame, key: str = "code") -> DataFrame:
    """Per market and in total: roster size, codes with a quote, tradable codes, rows outside it."""
    state = quotes.groupBy(key).agg(F.max(F.when(is_tradable(), 1).otherwise(0)).alias("_tradable"), F.count(F.lit(1)).alias("_rows"))
    joined = roster.select(key, "market").withColumn("_in", F.lit(1)).join(state, key, "full_outer")
    inside = F.col("_in") == 1
    return (
        joined.withColumn("market", F.coalesce("market", F.lit("NONE")))
        .rollup("market")
        .agg(
            F.count_if(inside).alias("roster_size"),
            F.count_if(inside & F.col("_rows").isNotNull()).alias("with_quote"),
            F.count_if(inside & (F.col("_tradable") == 1)).alias("tradable"),
            F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("_rows"))), F.lit(0)).alias("excluded_rows"),
        )
        .select(F.coalesce("market", F.lit("ALL")).alias("market"), "roster_size", "with_quote", "tradable", "excluded_rows")
    )


# ── source alignment ─────────────────────────────────────────────────────────


def misaligned_sources(sources: DataFrame, expected: Column) -> DataFrame:
    """Dated inputs whose day is not the expected one. Empty means aligned."""
    return sources.filter(~F.col("data_as_of").eqNullSafe(expected))


def same_run(left: DataFrame, right: DataFrame, time: str = "fetched_at", keys: Sequence[str] = (), hours: int = SAME_RUN_HOURS) -> DataFrame:
    """Left rows with ``same_run``: is any right row of the key at most ``hours`` away?

    Time is cut into buckets as wide as the band. A right row in the same bucket always matches;
    of the bucket before only its last time counts and of the one after only its first. The right
    side is reduced to those three facts per bucket, so no pair of rows is ever formed.
    """
    width = hours * 3600 * 1_000_000
    keys = list(keys)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    buckets = right.select(*keys, micros.alias("_t")).groupBy(*keys, F.floor(F.col("_t") / width).alias("_b")).agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi")
    )
    none = F.lit(None).cast("bigint")
    shifted = F.array(
        F.struct(F.col("_b").alias("_b"), F.col("_lo").alias("same"), none.alias("prev_hi"), none.alias("next_lo")),
        F.struct((F.col("_b") + 1).alias("_b"), none.alias("same"), F.col("_hi").alias("prev_hi"), none.alias("next_lo")),
        F.struct((F.col("_b") - 1).alias("_b"), none.alias("same"), none.alias("prev_hi"), F.col("_lo").alias("next_lo")),
    )
    facts = buckets.select(*keys, F.explode(shifted).alias("_f")).select(*keys, "_f.*").groupBy(*keys, "_b").agg(
        *[F.max(c).alias(c) for c in ("same", "prev_hi", "next_lo")]
    )
    asked = left.withColumn("_t", micros).withColumn("_b", F.floor(F.col("_t") / width))
    near = F.col("same").isNotNull() | (F.col("_t") - F.col("prev_hi") <= width) | (F.col("next_lo") - F.col("_t") <= width)
    return asked.join(facts, [*keys, "_b"], "left").select(
        *[F.col(c) for c in left.columns], F.coalesce(near, F.lit(False)).alias("same_run")
    )


def source_usable(expected: DataFrame, ledger: DataFrame, tolerance_hours: int = SAME_RUN_HOURS) -> DataFrame:
    """Each expected source with whether today's snapshot may be used, and why not."""
    newest = last_by_key(ledger.select("source_id", "id", "data_as_of", "fetched_at"), ["source_id"], ["id"])
    gap = F.abs(F.unix_micros("fetched_at") - F.unix_micros("run_at"))
    reason = (
        F.when(F.col("id").isNull(), "absent")
        .when(gap > tolerance_hours * 3600 * 1_000_000, "other_run")
        .when(F.col("needs_date") & ~F.col("data_as_of").eqNullSafe(F.col("signal_date")), "other_date")
        .otherwise("ok")
    )
    return expected.join(newest, "source_id", "left").select("source_id", reason.alias("state"), (reason == "ok").alias("usable"))


# ── point in time ────────────────────────────────────────────────────────────


def point_in_time_latest(facts: DataFrame, as_of: Column, key="code", known="report_date", covers="period", pos: str | None = None) -> DataFrame:
    """Newest period already published at ``as_of``; among equals the later report, then the first row."""
    visible = facts.filter(F.col(known) <= as_of)
    order = F.struct(covers, known) if pos is None else F.struct(F.col(covers), F.col(known), (-F.col(pos)).alias("_p"))
    rest = [c for c in facts.columns if c != key]
    best = visible.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def asof_join(picks: DataFrame, facts: DataFrame, as_of: str, value: Sequence[str], key="code", known="report_date", covers="period", unique: bool = False, pos: str | None = None) -> DataFrame:
    """:func:`point_in_time_latest` for every as-of day at once, with no look-ahead.

    Both sides are stacked and one running maximum per code carries the newest visible fact
    forward. Facts are first reduced to one per (code, publication day), so a window's size is
    bounded by calendar days and no pair of rows is ever built. ``unique`` states that ``picks``
    has one row per (key, as-of day): its rows then ride through the window and need no join back.
    Among facts of equal period and report date the first by ``pos`` counts; without ``pos`` facts are
    taken to be unique there.
    """
    first = [] if pos is None else [(-F.col(pos)).alias("_first")]
    fact = F.struct(F.col(covers), F.col(known), *first, *[F.col(v) for v in value])
    published = facts.groupBy(key, F.col(known).alias("_t")).agg(F.max(fact).alias("_fact"))
    carried = [c for c in picks.columns if c not in (key, as_of)] if unique else []
    asked = picks.select(key, F.col(as_of).alias("_t"), *carried)
    asked = asked if unique else asked.distinct()
    stacked = asked.withColumn("_ask", F.lit(True)).unionByName(published, allowMissingColumns=True)
    running = W.partitionBy(key).orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    known_at = (
        stacked.withColumn("_best", F.max("_fact").over(running))
        .filter("_ask")
        .select(key, F.col("_t").alias(as_of), *carried, *[F.col(f"_best.{c}").alias(c) for c in (covers, known, *value)])
    )
    return known_at if unique else picks.join(known_at, [key, as_of], "left")


# ── intervals ────────────────────────────────────────────────────────────────


def cover_days(notices: DataFrame, days: DataFrame, start="start_d", end="end_d", key="code", pos="pos", day="d") -> DataFrame:
    """(key, day, pos): the first notice in input order that covers each asked day.

    A missing bound means coverage cannot be ruled out, so the notice covers every day. No day of a
    notice is ever opened; see :func:`tideline.operators.sweep.first_cover`.
    """
    unknown = F.col(start).isNull() | F.col(end).isNull()
    bounded = notices.select(key, pos, *[F.when(~unknown, F.col(c)).alias(n) for n, c in (("_from", start), ("_to", end))])
    return first_cover(bounded, days, key, "_from", "_to", pos, day)


def interval_cover(candidates: DataFrame, notices: DataFrame, key="code", day="d", **cols) -> DataFrame:
    """Candidates covered by at least one notice, each with its first covering notice."""
    return candidates.join(cover_days(notices, candidates, key=key, day=day, **cols), [key, day])


def open_interval_active(candidates: DataFrame, halts: DataFrame, resume="resume_d", key="code", day="d", pos="pos") -> DataFrame:
    """Candidates with a halt not yet resumed on their day; the halt date itself is not consulted."""
    before = halts.select(key, pos, F.lit(None).cast("date").alias("_from"), F.date_sub(resume, 1).alias("_to"))
    return candidates.join(first_cover(before, candidates, key, "_from", "_to", pos, day), [key, day])


# ── increments ───────────────────────────────────────────────────────────────


def incremental_new(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(existing.select(*keys), list(keys), "left_anti")


def group_rows(df: DataFrame, keys: Sequence[str], members: Sequence[str], pos: str) -> DataFrame:
    """Multi-valued index as rows: each key's members numbered in input order.

    A list column would gather a whole key into one row; numbered rows keep the same access path.
    """
    from tideline.operators.scale import number_rows

    return number_rows(df.select(*keys, *members, pos), list(keys), [F.col(pos)], out="member_no")
