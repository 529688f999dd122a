"""Factor values, cross-sectional scores and ranked lists, for every trading day in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators.align import is_tradable
from tideline.operators.scale import number_rows, place, prefix_total, running_sum
from tideline.session import materialise

HIGHER, LOWER = "higher_is_better", "lower_is_better"

# The pre-registered definition of each factor.
REVERSAL_DAYS = 5
WINSOR_LOWER_PCT, WINSOR_UPPER_PCT = 1.0, 99.0
NEUTRAL_SCORE = 0.5
WATCHLIST_SIZE = 5
FACTOR_DIRECTIONS = {
    "rev_yoy_momentum_v1": HIGHER,
    "trust_net_buy_ratio_v1": HIGHER,
    "margin_balance_change_v1": LOWER,
    "short_term_reversal_5d_v1": LOWER,
    "foreign_net_buy_ratio_v1": HIGHER,
}
FACTOR_LABELS = {
    "rev_yoy_momentum_v1": "月營收年增",
    "trust_net_buy_ratio_v1": "投信買超",
    "margin_balance_change_v1": "融資餘額",
    "short_term_reversal_5d_v1": "五日漲跌",
    "foreign_net_buy_ratio_v1": "外資買超",
}
SHARE_OF_VOLUME = ("trust_net_buy_ratio_v1", "foreign_net_buy_ratio_v1")
ALREADY_PERCENT = ("rev_yoy_momentum_v1",)


# ── factor values ────────────────────────────────────────────────────────────


def factor_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0))


def factor_change_rate(current: Column, previous: Column) -> Column:
    return F.when(previous > 0, (current - previous) / previous)


def with_reversal(bars: DataFrame, days: int = REVERSAL_DAYS) -> DataFrame:
    """Add ``reversal`` = close[t] ÷ close[t−days] − 1; ``i`` numbers the trading days.

    A value needs all days+1 trading days present, positive and without an ex-right note. The
    range frame runs over calendar numbers, so a gap shortens the count and no dense grid is built.
    """
    usable = F.when((F.col("close") > 0) & F.col("note").isNull(), 1)
    frame = W.partitionBy("code").orderBy("i").rangeBetween(-days, 0)
    complete = F.count(usable).over(frame) == days + 1
    return bars.withColumn("reversal", F.when(complete, F.col("close") / F.first("close").over(frame) - 1))


def reversal(bars: DataFrame, cal: DataFrame, days: int = REVERSAL_DAYS) -> DataFrame:
    """(code, d, reversal) rows where the value exists."""
    return with_reversal(bars.join(cal, "d"), days).filter("reversal is not null").select("code", "d", "reversal")


def reversal_by_definition(bars: DataFrame, cal: DataFrame, definitions: DataFrame) -> DataFrame:
    """(d, code, factor, value): :func:`reversal` for every definition, each with the look-back (``days``) that its row names.

    A frame cannot vary by row, so the bar ``days`` trading days back is met by its calendar number. All
    bars between count if their running number has grown by as many; no day is opened and no grid is built.
    """
    usable = F.coalesce((F.col("close") > 0) & F.col("note").isNull(), F.lit(False)).cast("long")
    counted = place(bars.join(cal, "d").select("code", "d", "i", "close", "note"), ["code"], [F.col("i")]).scan(_upto=running_sum(usable)).done()
    wanted = definitions.agg(F.collect_list(F.struct("factor", F.col("days").cast("long").alias("days")))).scalar()
    now = counted.select("code", "d", "i", "close", "_upto", F.explode(wanted).alias("_w")).select(
        "code", "d", "close", "_upto", "_w.factor", "_w.days", (F.col("i") - F.col("_w.days")).alias("_start"))
    then = counted.select("code", F.col("i").alias("_start"), F.col("close").alias("_from"), (F.col("_upto") - usable).alias("_before"))
    complete = F.col("_upto") - F.col("_before") == F.col("days") + 1
    return now.join(then, ["code", "_start"]).filter(complete).select("d", "code", "factor", (F.col("close") / F.col("_from") - 1).alias("value"))


def yearly_growth(revenue: DataFrame) -> DataFrame:
    """Percent change of each covered month against the same month a year before.

    A code has one row per month; the month a year earlier is a range frame of exactly −12 months.
    """
    month = F.year("period") * 12 + F.month("period")
    prior = F.sum("amount").over(W.partitionBy("code").orderBy("_m").rangeBetween(-12, -12))
    return revenue.withColumn("_m", month).withColumn("_prior", prior).select(
        "code", "period", "report_date",
        (100 * (F.col("amount") - F.col("_prior")) / F.nullif(F.col("_prior"), F.lit(0.0))).alias("yoy"),
    )


def factor_long(wide: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """Stack factor columns into (…, factor, value) without NULL, NaN or infinite values."""
    v = F.col("value")
    return (
        wide.unpivot(keys, factors, "factor", "value")
        .filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )


def factor_activity(inputs: DataFrame, wanted: dict[str, int], history: DataFrame) -> DataFrame:
    """Per day and factor: active, or why not (no input rows that day, or too short a history).

    ``inputs`` (d, factor, n) counts the rows a factor is computed from, not its values: a factor whose
    values are all missing is still active. ``wanted`` is the history in days each factor needs.
    """
    state = (
        F.when(F.col("history_days") < F.col("needs_days"), "history_too_short")
        .when(F.coalesce("n", F.lit(0)) == 0, "input_empty")
        .otherwise("active")
    )
    days = history.select("d", "history_days", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(n).alias("needs_days")) for f, n in wanted.items()])).alias("_f"))
    return (
        days.select("d", "history_days", "_f.factor", "_f.needs_days")
        .join(inputs.select("d", "factor", "n"), ["d", "factor"], "left")
        .select("d", "factor", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))
    )


def coverage(long: DataFrame, days: DataFrame, factors: list[str]) -> DataFrame:
    """Non-null values per day and factor, zero rows included."""
    grid = days.select("d", F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor"))
    counts = long.groupBy("d", "factor").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["d", "factor"], "left").select("d", "factor", F.coalesce("n", F.lit(0)).alias("n"))


# ── scores ───────────────────────────────────────────────────────────────────


def direction_of(factor: Column, directions: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: acc.when(factor == kv[0], kv[1]), directions.items(), F.when(F.lit(False), ""))


def rank_score(midrank: Column, n: Column, lower_is_better: Column) -> Column:
    share = (midrank - 1) / F.nullif(n - 1, F.lit(0))
    return F.coalesce(F.when(lower_is_better, 1 - share).otherwise(share), F.lit(NEUTRAL_SCORE))


def score_cross_section(
    long: DataFrame,
    lower_is_better: Column,
    keys: tuple[str, ...] = ("d", "factor"),
    lower_pct: float | Column = WINSOR_LOWER_PCT,
    upper_pct: float | Column = WINSOR_UPPER_PCT,
) -> DataFrame:
    """Clamp each group to its percentiles, rank with ties at their average, map to 0..1.

    Adds ``winsorized``, ``midrank``, ``n`` and ``score``. Counts of distinct values are ranked across
    tasks, so a group of any size is spread.
    """
    scored = _score_from_counts(long, list(keys), _share(lower_pct), _share(upper_pct))
    return scored.withColumn("score", rank_score(F.col("midrank"), F.col("n"), lower_is_better))


def _share(pct) -> Column:
    return (pct if isinstance(pct, Column) else F.lit(float(pct))) / 100.0


def _score_from_counts(long: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    # the factors behind the values are computed once: they are counted, sampled for the range partitions, and joined
    long = materialise(long.withColumn("_lo", lo).withColumn("_hi", hi))
    hist = long.groupBy(*keys, "_lo", "_hi", "value").agg(F.count(F.lit(1)).alias("_eq"))
    hist = prefix_total(hist, keys, [F.col("value")], F.col("_eq"), out="_lt", total="n")
    bounds = hist.groupBy(*keys).agg(*_around(F.col("_lo"), "lo"), *_around(F.col("_hi"), "hi"))
    at = lambda side, edge, field: F.col(f"_{side}_{edge}.{field}")
    value = lambda side: (at(side, "a", "value") + (at(side, "b", "value") - at(side, "a", "value")) * F.col(f"_{side}_f")).alias(side)
    bounds = bounds.select(*keys, value("lo"), value("hi"), "_lo_a", "_lo_b", "_hi_a")
    # how many values are at most lo, and how many below hi, follows from the values on either side
    bounds = bounds.select(
        *keys, "lo", "hi",
        F.when(F.col("lo") < at("lo", "b", "value"), at("lo", "a", "upto")).otherwise(at("lo", "b", "upto")).alias("_at_lo"),
        F.when(F.col("hi") > at("hi", "a", "value"), at("hi", "a", "upto")).otherwise(at("hi", "a", "lt")).alias("_below_hi"))
    hist = hist.join(bounds, keys)
    v, n = F.col("value"), F.col("n")
    midrank = (
        F.when(F.col("lo") == F.col("hi"), (n + 1) / 2.0)
        .when(v <= F.col("lo"), (F.col("_at_lo") + 1) / 2.0)
        .when(v >= F.col("hi"), F.col("_below_hi") + (n - F.col("_below_hi") + 1) / 2.0)
        .otherwise(F.col("_lt") + (F.col("_eq") + 1) / 2.0)
    )
    clamp = F.greatest(F.least(v, F.col("hi")), F.col("lo"))
    per_value = hist.select(*keys, "value", "n", clamp.alias("winsorized"), midrank.alias("midrank"))
    return long.drop("_lo", "_hi").join(per_value, [*keys, "value"])


def _around(share: Column, side: str) -> list[Column]:
    """The values at the places below and above position (n−1)·share, and how far the position lies between them."""
    h = (F.col("n") - 1) * share
    held = F.struct("value", F.col("_lt").alias("lt"), (F.col("_lt") + F.col("_eq")).alias("upto"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_lt") <= position) & (position < F.col("_lt") + F.col("_eq")), held))

    return [at(F.floor(h)).alias(f"_{side}_a"), at(F.ceil(h)).alias(f"_{side}_b"), F.max(h - F.floor(h)).alias(f"_{side}_f")]


# ── composite and lists ──────────────────────────────────────────────────────


def active_only(scored: DataFrame, activity: DataFrame) -> DataFrame:
    """Scores of factors that are active on their day."""
    return scored.join(activity.filter("state = 'active'").select("d", "factor"), ["d", "factor"])


def composite(scored: DataFrame, activity: DataFrame) -> DataFrame:
    """Mean score over the day's active factors, a missing factor counting as neutral.

    ``activity`` (d, factor, state) says which factors are active. Missing scores need no rows of their
    own: (sum(score) + neutral × (active − present)) ÷ active.
    """
    active = activity.filter("state = 'active'").groupBy("d").agg(F.count_distinct("factor").alias("active"))
    own = active_only(scored, activity).groupBy("d", "code").agg(F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("real_factors"))
    neutral = NEUTRAL_SCORE * (F.col("active") - F.col("real_factors"))
    return own.join(active, "d").select(
        "d", "code", ((F.col("_sum") + neutral) / F.col("active")).alias("composite"), "real_factors", "active")


def composite_rank(composites: DataFrame) -> DataFrame:
    """Rank by composite score, equal scores by code."""
    return number_rows(composites, ["d"], [F.col("composite").desc(), F.col("code").asc()], out="rank")


def watchlist(ranked: DataFrame, k: int = WATCHLIST_SIZE) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key. The row-number limit is applied before the shuffle as well, so even
    a day with a third of all rows sends only k rows per input task."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def factor_detail(codes: DataFrame, scored: DataFrame, activity: DataFrame, directions: dict[str, str] = FACTOR_DIRECTIONS) -> DataFrame:
    """One row per day, code and declared factor with direction, raw, clamped, score and whether imputed.

    A factor without a score, or not active that day, is imputed with the neutral score.
    """
    full = codes.join(activity.select("d", "factor", (F.col("state") == "active").alias("active")), "d")
    got = active_only(scored, activity).select("d", "code", "factor", "value", "winsorized", F.col("score").alias("_score"))
    return full.join(got, ["d", "code", "factor"], "left").select(
        "d", "code", "factor", direction_of(F.col("factor"), directions).alias("direction"), F.col("value").alias("raw"), "winsorized",
        F.coalesce("_score", F.lit(NEUTRAL_SCORE)).alias("score"), F.col("_score").isNull().alias("imputed"), "active",
    )


def nested_detail(detail: DataFrame) -> DataFrame:
    """The same detail as one array per day and code; its length is the number of factors."""
    entry = F.struct("factor", "direction", "raw", "winsorized", "score", "imputed")
    return detail.groupBy("d", "code").agg(F.array_sort(F.collect_list(entry)).alias("factors"))


def ranking_summary(universe_days: DataFrame, ranked: DataFrame) -> DataFrame:
    """Universe, tradable, ranked and dropped-for-no-data counts per day."""
    base = universe_days.groupBy("d").agg(
        F.count(F.lit(1)).alias("with_quote"), F.count_if(is_tradable()).alias("tradable")
    )
    done = ranked.groupBy("d").agg(F.count(F.lit(1)).alias("_ranked"))
    n = F.coalesce("_ranked", F.lit(0))
    return base.join(done, "d", "left").select("d", "with_quote", "tradable", n.alias("ranked"), (F.col("tradable") - n).alias("no_data"))


def score_distribution(ranked: DataFrame) -> DataFrame:
    """Best, lowest and the element floor(n/2) of the descending list, plus ties at the top.

    Ranks already number the list, so the middle element is one row, not a sorted array.
    """
    n = ranked.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("composite").alias("top"), F.min("composite").alias("low"))
    joined = ranked.join(n, "d")
    return joined.groupBy("d").agg(
        F.max("n").alias("n"), F.max("top").alias("top"), F.max("low").alias("low"),
        F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("composite"))).alias("middle"),
        F.count_if(F.col("composite") == F.col("top")).alias("ties_at_top"),
    )


def build_pick_rows(ranked: DataFrame, bars: DataFrame, signals: DataFrame, k: int = WATCHLIST_SIZE, revision: int = 1) -> DataFrame:
    """Rows of the pick log: the watchlist without barriers and the signals with all of them.

    A signal with a missing barrier field is an error, not a row with gaps.
    """
    needed = ["entry_price", "stop_price", "target_price", "time_exit_days", "shares", "sigma_daily"]
    complete = reduce(lambda a, c: a & F.col(c).isNotNull(), needed, F.lit(True))
    price = bars.select("d", "code", F.col("close").alias("price_at_push"))
    watch = watchlist(ranked, k).select("d", "code", "rank", "composite", F.lit("watchlist").alias("list_kind"))
    signal = signals.withColumn(
        "entry_price", F.when(complete, F.col("entry_price")).otherwise(F.raise_error(F.lit("signal without barrier fields")).cast("double"))
    ).select("d", "code", "rank", "composite", F.lit("trade_signal").alias("list_kind"), *needed)
    return (
        watch.unionByName(signal, allowMissingColumns=True)
        .join(price, ["d", "code"], "left")
        .withColumn("revision", F.lit(revision).cast("bigint"))
    )


def explain_factors(detail: DataFrame) -> DataFrame:
    """Readable rows for factors a code really has; an unlabelled factor shows its raw value."""
    from tideline.functions.text import signed_pct

    factor, raw = F.col("factor"), F.col("raw")
    label = reduce(lambda acc, kv: acc.when(factor == kv[0], kv[1]), FACTOR_LABELS.items(), F.when(F.lit(False), ""))
    shown = (
        F.when(factor.isin(*ALREADY_PERCENT), signed_pct(raw, 1))
        .when(factor.isin(*SHARE_OF_VOLUME), F.concat(F.lit("佔成交量 "), signed_pct(raw * 100, 1)))
        .when(factor.isin(*FACTOR_LABELS), signed_pct(raw * 100, 1))
        .otherwise(raw.cast("string"))
    )
    better = F.when(direction_of(factor, FACTOR_DIRECTIONS) == LOWER, "lower").otherwise("higher")
    return detail.filter(~F.col("imputed") & raw.isNotNull()).select(
        "d", "code", "factor", F.coalesce(label, factor).alias("label"), shown.alias("value_text"), better.alias("better_when")
    )


def rank_on_definitions(long: DataFrame, definitions: DataFrame, activity: DataFrame) -> DataFrame:
    """Score and rank with percentiles and directions read from the definition table."""
    defined = long.join(definitions.select("factor", "lower_pct", "upper_pct", "direction"), "factor")
    scored = score_cross_section(defined, F.col("direction") == LOWER, lower_pct=F.col("lower_pct"), upper_pct=F.col("upper_pct"))
    return composite_rank(composite(scored, activity))


def definition_mismatch(definitions: DataFrame, implemented: DataFrame) -> DataFrame:
    """Factors defined but not computed, or computed but not defined."""
    both = definitions.select("factor", F.lit(True).alias("_d")).join(
        implemented.select("factor").distinct().withColumn("_i", F.lit(True)), "factor", "full_outer"
    )
    return both.filter("_d is null or _i is null").select(
        "factor", F.when(F.col("_d").isNull(), "undefined").otherwise("unimplemented").alias("problem")
    )
