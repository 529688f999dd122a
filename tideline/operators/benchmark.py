"""Benchmark series, drawdown and comparison of pick returns with the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators.align import first_by_key
from tideline.operators.outcomes import adjustment_for, events_by_trading_day, total_return
from tideline.operators.scale import Placed, place, previous, running_max, running_product, running_sum

# Fewest observations for a verdict, and the gates of the evaluation.
MIN_SAMPLE = 30
GATE_SIGNALS, GATE_MONTHS, GATE_PROFIT_FACTOR, GATE_AGREEMENT, GATE_STREAK = 100, 6, 1.3, 0.9, 60
INSUFFICIENT, BEATS, DOES_NOT = "insufficient_sample", "beats_benchmark", "does_not_beat"


def benchmark_return(intervals: DataFrame, closes: DataFrame, events: DataFrame) -> DataFrame:
    """Total return of each code over (from, to]; NULL when either close is missing or not positive."""
    start = closes.select("code", F.col("d").alias("from_d"), F.col("close").alias("_a"))
    end = closes.select("code", F.col("d").alias("to_d"), F.col("close").alias("_b"))
    adjusted = adjustment_for(intervals, events).join(start, ["code", "from_d"], "left").join(end, ["code", "to_d"], "left")
    usable = (F.col("_a") > 0) & (F.col("_b") > 0)
    value = F.when(usable, total_return(F.when(usable, F.col("_a")).otherwise(1.0), F.col("_b"), F.col("factor"), F.col("cash")))
    return adjusted.select(*intervals.columns, value.alias("benchmark_return"))


def total_return_index(closes: DataFrame, cal: DataFrame, events: DataFrame, base: float = 100.0) -> DataFrame:
    """Chained daily total returns per code, starting at ``base``.

    A previous close that is not positive leaves the index where it was.
    """
    return placed_index(closes, cal, events, base).done()


def placed_index(closes: DataFrame, cal: DataFrame, events: DataFrame, base: float = 100.0) -> Placed:
    """:func:`total_return_index` in its placement: a code's days may lie in any number of tasks."""
    numbered = closes.select("code", "d", "close").join(cal, "d")
    acts = events_by_trading_day(events, cal).select("code", "i", F.col("factor").alias("_f"), F.col("cash").alias("_c"))
    # an action on a day without a bar counts on the code's next bar
    stacked = numbered.join(acts, ["code", "i"], "full_outer")
    is_bar = F.col("close").isNotNull().cast("long")
    placed = place(stacked, ["code"], [F.col("i")]).scan(_bars=running_sum(is_bar))
    # what lies between two bars, few rows, is folded into the later one
    run = W.partitionBy("code", "_bar").orderBy("i")
    prior = F.coalesce(F.product(F.coalesce("_f", F.lit(1.0))).over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
    folded = placed.rows.withColumn("_bar", F.col("_bars") - is_bar).withColumn("_prior", prior)
    upto = run.rowsBetween(W.unboundedPreceding, 0)
    folded = folded.withColumn("factor", F.product(F.coalesce("_f", F.lit(1.0))).over(upto)).withColumn(
        "cash", F.sum(F.coalesce(F.col("_c") * F.col("_prior"), F.lit(0.0))).over(upto)
    )
    bars = Placed(folded.filter("close is not null").select("code", "d", "i", "close", "factor", "cash", "_part"), placed.keys, placed.order).scan(_prev=previous(F.col("close")))
    step = F.when(F.col("_prev") > 0, (F.col("close") * F.col("factor") + F.col("cash")) / F.col("_prev")).otherwise(1.0)
    chained = bars.scan(_index=running_product(step))
    index = (F.lit(base) * F.col("_index")).alias("total_return_index")
    return Placed(chained.rows.select("code", "d", "i", "close", index, "_part"), chained.keys, chained.order)


def max_drawdown(points: DataFrame | Placed, value: str = "total_return_index") -> DataFrame:
    """Largest fall from a running peak, per code."""
    placed = points if isinstance(points, Placed) else place(points, ["code"], [F.col("i")])
    fall = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col(value)) / F.col("_peak"))
    return placed.scan(_peak=running_max(F.col(value))).rows.groupBy("code").agg(F.coalesce(F.max(fall), F.lit(0.0)).alias("max_drawdown"))


def official_index(snapshots: DataFrame, start: str, base: float = 100.0) -> DataFrame:
    """One series from overlapping snapshots: the first value seen for a day stays, first day = base.

    A later correction must not leak into the past, so this is the one place where first wins.
    """
    kept = snapshots.filter(F.col("d") >= F.lit(start).cast("date"))
    first = first_by_key(kept.select("series", "d", "pos", "value"), ["series", "d"], ["pos"])
    origin = first.groupBy("series").agg(F.min_by("value", "d").alias("_origin"))
    return first.join(origin, "series").filter("_origin > 0").select("series", "d", F.col("value").alias("close"), (F.col("value") / F.col("_origin") * base).alias("total_return_index"))


def period_return(points: DataFrame, value: str = "total_return_index") -> DataFrame:
    return points.groupBy("code").agg((F.max_by(value, "d") / F.nullif(F.min_by(value, "d"), F.lit(0.0)) - 1).alias("period_return"))


def excess(observations: DataFrame) -> DataFrame:
    """Asset minus benchmark where both exist."""
    return observations.filter("benchmark_pct is not null").withColumn("excess_pct", F.col("asset_pct") - F.col("benchmark_pct"))


def _comparison() -> list[Column]:
    e = F.col("asset_pct") - F.col("benchmark_pct")
    matched = F.col("benchmark_pct").isNotNull()
    mean = F.coalesce(F.avg(e), F.lit(0.0))
    sd = F.coalesce(F.stddev_samp(e), F.lit(0.0))
    n = F.count_if(matched)
    return [
        n.alias("n"), F.count_if(~matched).alias("unmatched"),
        F.coalesce(F.avg(F.when(matched, F.col("asset_pct"))), F.lit(0.0)).alias("mean_asset"),
        F.coalesce(F.avg("benchmark_pct"), F.lit(0.0)).alias("mean_benchmark"),
        mean.alias("mean_excess"), sd.alias("stdev_excess"), F.when(sd > 0, mean / sd).alias("mean_over_stdev"),
        F.count_if(e > 0).alias("beat_count"),
        F.when(n < MIN_SAMPLE, INSUFFICIENT).when(mean > 0, BEATS).otherwise(DOES_NOT).alias("status"),
    ]


def compare_to_benchmark(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Descriptive comparison; fewer than 30 observations give no verdict."""
    return observations.groupBy(*keys).agg(*_comparison())


def horizon_report(observations: DataFrame) -> DataFrame:
    """Horizon × list kind plus both margins and the grand total, in one pass."""
    return observations.cube("horizon", "list_kind").agg(*_comparison())


def compare_split(observations: DataFrame) -> DataFrame:
    """Watchlist against signals per horizon: where does the system gain or lose?"""
    per = compare_to_benchmark(observations, ["horizon", "list_kind"])
    side = lambda kind, c: F.max(F.when(F.col("list_kind") == kind, F.col(c)))
    wide = per.groupBy("horizon").agg(
        side("watchlist", "mean_excess").alias("watch_excess"), side("trade_signal", "mean_excess").alias("signal_excess"),
        F.coalesce(side("watchlist", "status"), F.lit(INSUFFICIENT)).alias("watch_status"),
        F.coalesce(side("trade_signal", "status"), F.lit(INSUFFICIENT)).alias("signal_status"),
    )
    w, s = F.coalesce("watch_excess", F.lit(0.0)), F.coalesce("signal_excess", F.lit(0.0))
    reading = (
        F.when((F.col("watch_status") == INSUFFICIENT) | (F.col("signal_status") == INSUFFICIENT), "not_enough_samples")
        .when((w > 0) & (s <= 0), "later_layers_lose")
        .when((w <= 0) & (s > 0), "later_layers_help")
        .when(w > 0, "both_beat")
        .otherwise("both_lose")
    )
    return wide.withColumn("reading", reading)


# ── gates ────────────────────────────────────────────────────────────────────


def signal_performance(outcomes: DataFrame) -> DataFrame:
    """Expectancy in R, profit factor and win count per horizon; R = adjusted return ÷ planned risk."""
    r = F.col("r_multiple")
    gain, loss = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0))
    return outcomes.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("expectancy_r"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"),
        F.count_if(r > 0).alias("wins"),
    )


def factor_decay(observations: DataFrame, last: int = 60, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """Per key and day: mean excess and score/excess correlation over the last ``last`` days with
    observations, against the whole history up to that day.

    Observations are summed per key and day first; the frames then run over calendar days. A correlation
    needs both sides to vary by more than rounding makes of equal values.
    """
    s, e = F.col("score"), F.col("excess_pct")
    daily = observations.groupBy(*keys, "d").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(s).alias("_s"), F.sum(e).alias("_e"), F.sum(s * e).alias("_se"), F.sum(s * s).alias("_ss"), F.sum(e * e).alias("_ee")
    )
    w = W.partitionBy(*keys).orderBy("d")

    def over(frame) -> tuple[Column, Column]:
        n, ss, ee, se, a, b = (F.sum(c).over(frame) for c in ("_n", "_ss", "_ee", "_se", "_s", "_e"))
        x, y = n * ss - a * a, n * ee - b * b
        return b / n, F.when((x > 1e-9 * n * ss) & (y > 1e-9 * n * ee), (n * se - a * b) / F.sqrt(x * y))

    recent_mean, recent_corr = over(w.rowsBetween(-(last - 1), 0))
    mean, corr = over(w.rowsBetween(W.unboundedPreceding, 0))
    return daily.select(
        *keys, "d", recent_mean.alias("recent_excess"), recent_corr.alias("recent_corr"), mean.alias("mean_excess"), corr.alias("corr")
    ).withColumn("decay", F.col("corr") - F.col("recent_corr"))


def turnover(signals: DataFrame) -> DataFrame:
    """Names entering the list per day, as a share of the list."""
    w = W.partitionBy("code").orderBy("i")
    fresh = signals.withColumn("_new", F.coalesce(F.lag("i").over(w) < F.col("i") - 1, F.lit(True)))
    return fresh.groupBy("d").agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("_new")).alias("entered")).withColumn(
        "turnover", F.col("entered") / F.col("names")
    )


def performance_gates(signals: DataFrame, performance: DataFrame, comparison: DataFrame, agreement: DataFrame, streaks: DataFrame) -> DataFrame:
    """One row per gate, and per horizon where a gate has one, with its measure and whether it holds.

    ``signals``: (d, code); ``performance``: :func:`signal_performance`; ``comparison``: one comparison row
    per horizon; ``agreement``: one row with ``share``; ``streaks``: one row per source with
    ``latest_streak``, as :func:`tideline.sources.ledger.clean_streaks` counts them.
    """
    distinct, whole = signals.select("d", "code").distinct(), F.lit(None).cast("int")
    g1 = distinct.agg(F.count(F.lit(1)).alias("n"), F.months_between(F.max("d"), F.min("d")).alias("m")).select(
        F.lit("G1").alias("gate"), whole, F.col("n").cast("double").alias("measure"), (F.col("n") >= GATE_SIGNALS) & (F.col("m") >= GATE_MONTHS)
    )
    g2 = performance.select(F.lit("G2"), F.col("horizon").cast("int"), F.col("profit_factor"), (F.col("expectancy_r") > 0) & (F.col("profit_factor") > GATE_PROFIT_FACTOR))
    g3 = comparison.select(F.lit("G3"), F.col("horizon").cast("int"), F.col("mean_excess"), F.col("status") == BEATS)
    g4 = agreement.select(F.lit("G4"), whole, F.col("share"), F.col("share") > GATE_AGREEMENT)
    g5 = streaks.agg(F.min("latest_streak").alias("s")).select(F.lit("G5"), whole, F.col("s").cast("double"), F.col("s") >= GATE_STREAK)
    out = g1.union(g2).union(g3).union(g4).union(g5).toDF("gate", "horizon", "measure", "passed")
    return out.withColumn("passed", F.coalesce("passed", F.lit(False)))


def record_agreement(picks: DataFrame, records: DataFrame) -> DataFrame:
    """Share of effective user records whose action matches the system's list (buy ⇔ listed)."""
    listed = picks.select("d", "code").distinct().withColumn("_listed", F.lit(True))
    acted = records.filter("code is not null").join(listed, ["d", "code"], "left")
    same = (F.col("action") == "buy") == F.coalesce("_listed", F.lit(False))
    return acted.agg((F.count_if(same) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"))
