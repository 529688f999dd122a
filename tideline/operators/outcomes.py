"""Scoring stored picks at fixed horizons, with corporate actions put back.

Days are calendar numbers (``i``), so "the n-th trading day after" is an equality and no range
join is needed. A corporate action is moved to the first trading day at or after its own day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators.align import day_lookup, last_by_key

# Observation periods in trading days.
HORIZONS = (5, 10, 20)
NOT_MATURE, NO_PRICE, COMPUTED = "not_mature", "no_price_at_exit", "computed"
STOP, TARGET, TIME = "stop", "target", "time"


def merge_events(events: DataFrame) -> DataFrame:
    """One corporate action per code and ex-day: the last batch's figures win."""
    return last_by_key(events, ["code", "ex_date"], ["batch"])


def total_return(entry: Column, exit_: Column, factor: Column, cash: Column) -> Column:
    return F.when(entry > 0, (exit_ * factor + cash) / entry - 1).otherwise(F.raise_error(F.lit("entry price must be positive")).cast("double"))


def raw_return(entry: Column, exit_: Column) -> Column:
    return F.when(entry > 0, exit_ / entry - 1).otherwise(F.raise_error(F.lit("entry price must be positive")).cast("double"))


def reference_price(close: Column, cash: Column, ratio: Column) -> Column:
    """The exchange's opening reference after an ex-right day."""
    return (close - cash) / (1 + ratio)


def reference_check(checks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Our reference price beside the official one."""
    ours = reference_price(F.col("close_before"), F.col("cash"), F.col("ratio"))
    return checks.withColumn("computed", ours).withColumn("agrees", F.abs(ours - F.col("official")) <= tolerance)


def _fold(events: Column) -> Column:
    """(factor, cash) over events in ex-day order; a dividend is paid on the shares held before it."""
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("cash"))
    return F.aggregate(
        F.array_sort(events), start,
        lambda acc, e: F.struct(
            (acc["factor"] * (1 + e["ratio"])).alias("factor"), (acc["cash"] + e["cash"] * acc["factor"]).alias("cash")
        ),
    )


def running_actions(events: DataFrame) -> DataFrame:
    """Per code and ex-day what all actions up to then make of one first share: factor, cash, counts.

    A code has at most one merged action per day, so its window is bounded by the calendar.
    """
    upto = W.partitionBy("code").orderBy("ex_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("code").orderBy("ex_date").rowsBetween(W.unboundedPreceding, -1)
    grown = 1 + F.coalesce("ratio", F.lit(0.0))
    # a dividend is paid on the shares held before its day
    paid = F.coalesce("cash", F.lit(0.0)) * F.coalesce(F.product(grown).over(earlier), F.lit(1.0))
    return (
        merge_events(events).withColumn("_paid", paid)
        .select("code", "ex_date", F.product(grown).over(upto).alias("factor"), F.sum("_paid").over(upto).alias("cash"),
                F.count(F.lit(1)).over(upto).alias("events"), F.sum(F.coalesce(F.col("rights"), F.lit(False)).cast("int")).over(upto).alias("rights"))
    )


def adjustment_for(intervals: DataFrame, events: DataFrame, from_="from_d", to="to_d") -> DataFrame:
    """Share factor and cash per original share over (from, to], for any set of intervals.

    Running totals per code are looked up at both ends: factor = F(to) ÷ F(from) and
    cash = (C(to) − C(from)) ÷ F(from). Equal days of a code are asked once and no interval meets an
    action, so a code that all intervals share costs its calendar, not their product.
    """
    totals = F.struct("factor", "cash", "events", "rights")
    known = running_actions(events).select("code", F.col("ex_date").alias("_t"), totals.alias("_have"))
    asked = intervals.select("code", F.col(from_).alias("_t")).unionByName(intervals.select("code", F.col(to).alias("_t"))).where("_t is not null").distinct()
    stacked = asked.withColumn("_ask", F.lit(True)).unionByName(known, allowMissingColumns=True)
    running = W.partitionBy("code").orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    none = F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("cash"), F.lit(0).cast("bigint").alias("events"), F.lit(0).cast("bigint").alias("rights"))
    at = stacked.withColumn("_at", F.coalesce(F.last("_have", ignorenulls=True).over(running), none)).where("_ask").select("code", "_t", "_at")
    start = at.select("code", F.col("_t").alias(from_), F.col("_at").alias("_a"))
    end = at.select("code", F.col("_t").alias(to), F.col("_at").alias("_b"))
    a, b = F.coalesce("_a", none), F.coalesce("_b", "_a", none)
    return intervals.join(start, ["code", from_], "left").join(end, ["code", to], "left").withColumns({"_a": a, "_b": b}).select(
        *intervals.columns, (F.col("_b.factor") / F.col("_a.factor")).alias("factor"), ((F.col("_b.cash") - F.col("_a.cash")) / F.col("_a.factor")).alias("cash"),
        (F.col("_b.events") - F.col("_a.events")).alias("events"), (F.col("_b.rights") > F.col("_a.rights")).alias("rights"),
    )


def adjust_barrier(levels: DataFrame, events: DataFrame, level: str, from_="from_d", to="to_d") -> DataFrame:
    """A price level moved to the scale of a later day: (level − cash) ÷ factor of the interval.

    Applying each event's (level − dividend) ÷ (1 + ratio) in turn gives exactly this.
    """
    return adjustment_for(levels, events, from_, to).withColumn("adjusted", (F.col(level) - F.col("cash")) / F.col("factor"))


def events_by_trading_day(events: DataFrame, cal: DataFrame) -> DataFrame:
    """(code, i, factor, cash, events, rights): actions folded per trading day they first matter on."""
    days = day_lookup(cal).select(F.col("d").alias("ex_date"), F.col("next_i").alias("i"))
    entry = F.struct("ex_date", "cash", "ratio")
    # several ex-days can fall between two trading days; their number is bounded by that gap
    placed = merge_events(events).join(days, "ex_date")
    folded = placed.groupBy("code", "i").agg(
        _fold(F.collect_list(entry)).alias("_f"), F.count(F.lit(1)).alias("n_events"), F.max("rights").alias("rights")
    )
    return folded.select("code", "i", F.col("_f.factor").alias("factor"), F.col("_f.cash").alias("cash"), "n_events", "rights")


def compute_outcomes(picks: DataFrame, bars: DataFrame, cal: DataFrame, events: DataFrame, horizons=HORIZONS) -> DataFrame:
    """One row per pick and horizon.

    ``picks``: pick_id, code, d, entry, stop, target (barriers NULL on the watchlist). Each pick is
    opened into its following trading days, met with bars and actions by equality on (code, i), and
    one window over those at most ``max(horizons)`` rows carries the adjustment forward.
    """
    longest = max(horizons)
    last_i = cal.agg(F.max("i")).scalar()
    placed = picks.join(cal, "d", "left").withColumn("_last", last_i)
    ahead = placed.filter("i is not null").select(
        "pick_id", "code", "i", "stop", "target", "_last", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")
    ).filter("i + k <= _last").select("pick_id", "code", (F.col("i") + F.col("k")).alias("i"), "k", "stop", "target")
    numbered = bars.select("code", "d", "high", "low", "close").join(cal, "d")
    acts = events_by_trading_day(events, cal).select(
        "code", "i", F.col("factor").alias("_f"), F.col("cash").alias("_c"), "n_events", "rights"
    )
    # one side each per (code, trading day), so neither join multiplies rows
    met = ahead.join(numbered.drop("d"), ["code", "i"], "left").join(acts, ["code", "i"], "left")

    run = W.partitionBy("pick_id").orderBy("k")
    upto, before = run.rowsBetween(W.unboundedPreceding, 0), run.rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.col("_f"), F.lit(1.0))
    walked = met.withColumn("_prior", F.coalesce(F.product(own).over(before), F.lit(1.0)))
    walked = walked.select(
        "pick_id", "k", "high", "low", "close", "stop", "target",
        (F.col("_prior") * own).alias("factor"),
        F.sum(F.coalesce(F.col("_c") * F.col("_prior"), F.lit(0.0))).over(upto).alias("cash"),
        F.coalesce(F.sum("n_events").over(upto), F.lit(0)).alias("events"),
        F.coalesce(F.max("rights").over(upto), F.lit(False)).alias("rights"),
    )
    scale = lambda level: (F.col(level) - F.col("cash")) / F.col("factor")
    hit_stop, hit_target = F.col("low") <= scale("stop"), F.col("high") >= scale("target")
    kind = F.when(hit_stop, STOP).when(hit_target, TARGET)
    at = lambda c, h: F.max(F.when(F.col("k") == h, F.col(c)))
    per_pick = walked.withColumn("_kind", kind).groupBy("pick_id").agg(
        F.min(F.when(F.col("_kind").isNotNull(), F.struct("k", "_kind"))).alias("_touch"),
        F.max("k").alias("_reach"),
        *[
            F.struct(
                F.lit(h).alias("horizon"), at("close", h).alias("exit_price"), at("factor", h).alias("factor"),
                at("cash", h).alias("cash"), at("events", h).alias("events"), at("rights", h).alias("rights"),
            ).alias(f"_h{h}")
            for h in horizons
        ],
    )
    lone = F.array(*[F.lit(h) for h in horizons])
    wide = placed.join(per_pick, "pick_id", "left").withColumn("horizon", F.explode(lone))
    chosen = F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"_h{h}")) for h in horizons])
    one = wide.withColumn("_x", chosen).withColumn("exit_i", F.col("i") + F.col("horizon"))
    mature = F.col("exit_i").isNotNull() & (F.col("exit_i") <= F.col("_last"))
    priced = F.col("_x.exit_price") > 0
    status = F.when(~mature, NOT_MATURE).when(F.coalesce(priced, F.lit(False)), COMPUTED).otherwise(NO_PRICE)
    done = status == COMPUTED
    touched = F.when(
        mature & F.col("stop").isNotNull(), F.when(F.col("_touch.k") <= F.col("horizon"), F.col("_touch._kind")).otherwise(TIME)
    )
    touch_i = F.when(mature & F.col("stop").isNotNull() & (F.col("_touch.k") <= F.col("horizon")), F.col("i") + F.col("_touch.k"))
    exits = cal.select(F.col("i").alias("exit_i"), F.col("d").alias("exit_date"))
    touches = cal.select(F.col("i").alias("touch_i"), F.col("d").alias("touch_date"))
    entry, exit_, factor, cash = F.col("entry"), F.col("_x.exit_price"), F.coalesce("_x.factor", F.lit(1.0)), F.coalesce("_x.cash", F.lit(0.0))
    return (
        one.withColumn("status", status)
        .withColumn("touch_i", touch_i)
        .join(exits, "exit_i", "left").join(touches, "touch_i", "left")
        .select(
            "pick_id", "code", "d", "horizon", "status",
            F.when(mature, F.col("exit_date")).alias("exit_date"),
            F.when(done, exit_).alias("exit_price"),
            F.when(done, raw_return(entry, exit_) * 100).alias("raw_return_pct"),
            F.when(done, total_return(entry, exit_, factor, cash) * 100).alias("adjusted_return_pct"),
            F.when(mature, factor).otherwise(1.0).alias("share_factor"),
            F.when(mature, cash).otherwise(0.0).alias("cash_per_share"),
            F.when(mature, F.coalesce("_x.rights", F.lit(False))).otherwise(False).alias("has_rights"),
            F.when(mature, F.coalesce("_x.events", F.lit(0))).otherwise(0).alias("ex_right_count"),
            touched.alias("barrier_touched"), "touch_date",
            F.when(mature, F.col("horizon")).otherwise(0).alias("trading_days_used"),
        )
    )


def status_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("horizon", "status").agg(F.count(F.lit(1)).alias("n"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """n, mean, upper middle of the ascending list, mean raw, gap, and how many had actions."""
    from tideline.operators.scale import prefix_total

    done = outcomes.filter(F.col("status") == COMPUTED)
    hist = done.groupBy("horizon", "adjusted_return_pct").agg(F.count(F.lit(1)).alias("_eq"))
    hist = prefix_total(hist, ["horizon"], [F.col("adjusted_return_pct")], F.col("_eq"), out="_lt")
    totals = done.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("adjusted_return_pct").alias("mean_adjusted"), F.avg("raw_return_pct").alias("mean_raw"),
        F.count_if(F.col("ex_right_count") > 0).alias("with_actions"),
    )
    pos = F.floor(F.col("n") / 2)
    middle = hist.join(totals.select("horizon", "n"), "horizon").filter((F.col("_lt") <= pos) & (pos < F.col("_lt") + F.col("_eq")))
    return totals.join(middle.select("horizon", F.col("adjusted_return_pct").alias("middle")), "horizon", "left").select(
        "horizon", "n", "mean_adjusted", "middle", "mean_raw", (F.col("mean_adjusted") - F.col("mean_raw")).alias("gap"), "with_actions"
    )
