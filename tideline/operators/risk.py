"""Volatility, barriers, position sizes and hard limits, for every candidate of every day at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tideline.functions.money import to_cents
from tideline.operators.cost import BPS, PPM, TAX_PPM, Broker, net_cents
from tideline.operators.scale import Placed, place, previous
from tideline.session import materialise

SIZING_STEPS, COMPILED_STEPS, BISECTION_STEPS = 12, 2, 40


@dataclass(frozen=True)
class RiskConfig:
    """Versioned limits; the defaults are the fixed values of the current version."""

    version: str = "risk-v2"
    equity: float = 10_000.0
    risk_per_trade_pct: float = 2.0
    vol_span: int = 100
    vol_min_observations: int = 20
    holding_days: int = 10
    stop_sigma_multiple: float = 2.0
    take_profit_r: float = 2.0
    max_concurrent: int = 3
    monthly_entry_cap: int = 6
    max_single_position_pct: float = 20.0
    max_total_exposure_pct: float = 60.0
    circuit_breaker_pct: float = 15.0
    lot_size: int = 1
    daily_buy_budget: float | None = None
    broker: Broker = field(default_factory=Broker)

    @property
    def risk_budget(self) -> float:
        return self.equity * self.risk_per_trade_pct / 100

    def as_row(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "broker"}


# The rules a configuration must satisfy.
CONFIG_RULES = {
    "risk_per_trade": "risk_per_trade_pct between 1 and 2",
    "take_profit": "take_profit_r >= 2",
    "equity": "equity > 0",
    "holding_days": "holding_days >= 1",
    "vol_observations": "vol_min_observations >= 2",
    "stop_multiple": "stop_sigma_multiple > 0",
    "worst_case": "max_concurrent * risk_per_trade_pct < circuit_breaker_pct",
    "position_caps": "max_single_position_pct <= max_total_exposure_pct",
    "lot_size": "lot_size >= 1 and lot_size = floor(lot_size)",
    "daily_budget": "daily_buy_budget is null or daily_buy_budget > 0",
}


def validate_config(configs: DataFrame) -> DataFrame:
    """(version, rule) for every violated rule of every registered configuration."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), name) for name, sql in CONFIG_RULES.items()])
    )
    return configs.select("version", F.explode(broken).alias("rule"))


# ── volatility ───────────────────────────────────────────────────────────────


def log_returns(bars: DataFrame) -> DataFrame:
    """(code, d, i, r): ln of close over the close of the trading day right before."""
    return placed_returns(bars).done()


def placed_returns(bars: DataFrame) -> Placed:
    """:func:`log_returns` in their placement, for running values over them; a code may span many tasks."""
    near = place(bars.select("code", "d", "i", "close"), ["code"], [F.col("i")]).scan(_prev=previous(F.struct("close", "i")))
    close, old = F.col("close"), F.col("_prev.close")
    paired = near.rows.filter((F.col("_prev.i") == F.col("i") - 1) & (close > 0) & (old > 0))
    return Placed(paired.select("code", "d", "i", F.ln(close / old).alias("r"), "_part"), near.keys, near.order)


def ewm_std(returns: DataFrame, span: int) -> DataFrame:
    """Exponentially weighted, bias-corrected standard deviation of each code's returns.

    Weight (1−α)^(n−1−k) for the k-th of n returns, α = 2/(span+1). The mean is taken first and
    deviations from it are summed, which keeps the variance stable. Equal returns give NULL by
    comparing the extremes, since rounding could leave a tiny positive variance.
    """
    decay = 1 - 2.0 / (span + 1)
    by_code = W.partitionBy("code")
    age = F.row_number().over(by_code.orderBy(F.col("i").desc())) - 1
    weighted = returns.withColumn("_w", F.pow(F.lit(decay), age))
    mean = F.sum(F.col("_w") * F.col("r")).over(by_code) / F.sum("_w").over(by_code)
    sums = weighted.withColumn("_dev", F.col("r") - mean).groupBy("code").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("_w").alias("_s1"), F.sum(F.col("_w") * F.col("_w")).alias("_s2"),
        F.sum(F.col("_w") * F.col("_dev") * F.col("_dev")).alias("_ss"), (F.max("r") == F.min("r")).alias("_flat"),
    )
    room = F.col("_s1") * F.col("_s1") - F.col("_s2")
    variance = F.when((F.col("observations") >= 2) & (room > 0) & ~F.col("_flat"), F.col("_ss") * F.col("_s1") / room)
    return sums.select("code", "observations", F.when(variance > 0, F.sqrt(variance)).alias("sigma"))


MOMENTS = "n long, w double, w2 double, mean double, s double, lo double, hi double"


def ewm_std_daily(returns: DataFrame | Placed, span: int) -> DataFrame:
    """The same estimate as of every day: a running value over all returns up to it, none left out.

    Its state is the number of returns, the sums of their weights and squared weights, the weighted mean
    and the weighted squared deviations from it. A further return ages the state by 1−α and moves the
    mean, so no square of a return is ever formed; two stretches are put together by ageing the older by
    as many returns as the newer has. A code's returns may so lie in any number of tasks.
    """
    decay = 1 - 2.0 / (span + 1)
    placed = returns if isinstance(returns, Placed) else place(returns.select("code", "d", "i", "r"), ["code"], [F.col("i")])

    def step(state, r):
        n, w, w2, mean, s, lo, hi = state
        old = decay * w
        off = r - mean
        w = old + 1.0
        return n + 1, w, decay * decay * w2 + 1.0, mean + off / w, decay * s + old / w * off * off, r if n == 0 else min(lo, r), r if n == 0 else max(hi, r)

    def merged(a: Column, b: Column) -> Column:
        aged = F.pow(F.lit(decay), b["n"])
        old = a["w"] * aged
        w = old + b["w"]
        off = a["mean"] - b["mean"]
        return F.struct(
            (a["n"] + b["n"]).alias("n"), w.alias("w"), (a["w2"] * aged * aged + b["w2"]).alias("w2"),
            ((old * a["mean"] + b["w"] * b["mean"]) / w).alias("mean"), (a["s"] * aged + b["s"] + old * b["w"] / w * off * off).alias("s"),
            F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))

    m = placed.fold("m", ["r"], MOMENTS, (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), step, merged).done().select("code", "d", "i", "m.*")
    room = F.col("w") * F.col("w") - F.col("w2")
    variance = F.when((F.col("n") >= 2) & (room > 0) & (F.col("lo") < F.col("hi")), F.col("s") * F.col("w") / room)
    return m.select("code", "d", "i", F.col("n").alias("observations"), F.when(variance > 0, F.sqrt(variance)).alias("sigma"))


def estimate_vol(estimates: DataFrame, min_observations: int) -> DataFrame:
    """Sigma only from enough observations; otherwise NULL with the reason."""
    n, s = F.col("observations"), F.col("sigma")
    reason = F.when(n < min_observations, "too_few_observations").when(s.isNull() | ~(s < F.lit(float("inf"))), "no_valid_deviation")
    return estimates.withColumn("vol_reason", reason).withColumn("sigma", F.when(reason.isNull(), s))


def vol_coverage(candidates: DataFrame, estimates: DataFrame) -> DataFrame:
    joined = candidates.select("d", "code").join(estimates.select("d", "code", "sigma"), ["d", "code"], "left")
    return joined.groupBy("d").agg(F.count("sigma").alias("with_sigma"), F.count(F.lit(1)).alias("codes"))


# ── barriers and sizes ───────────────────────────────────────────────────────


def with_barriers(candidates: DataFrame, config: RiskConfig) -> DataFrame:
    """Stop and target at k·σ·√N; a distance of the whole price or more cannot be traded."""
    distance = config.stop_sigma_multiple * F.col("sigma") * F.sqrt(F.lit(config.holding_days))
    feasible = (F.col("entry") > 0) & (F.col("sigma") > 0) & (distance < 1)
    risk = F.when(feasible, F.col("entry") * distance)
    return (
        candidates.withColumn("stop_distance", distance).withColumn("feasible", F.coalesce(feasible, F.lit(False)))
        .withColumn("risk_per_share", risk)
        .withColumn("stop_price", F.col("entry") - F.col("risk_per_share"))
        .withColumn("target_price", F.col("entry") + config.take_profit_r * F.col("risk_per_share"))
    )


def _floor_lot(shares: Column, lot: int) -> Column:
    return (F.floor(shares / lot) * lot).cast("bigint")


def _stop_loss(shares: Column, config: RiskConfig) -> Column:
    """Loss at the stop with all fees, in currency units."""
    return -net_cents(F.col("entry_cents"), F.col("stop_cents"), shares, TAX_PPM, config.broker) / 100.0


def _halved(acc: Column, lot: int, budget: Column, config: RiskConfig) -> Column:
    """One step of the search for the most lots in [lo, hi] whose loss fits the budget."""
    mid = F.call_function("div", acc["lo"] + acc["hi"] + 1, F.lit(2))

    def halves(m: Column) -> Column:
        above = F.struct(m.alias("lo"), acc["hi"].alias("hi"))
        return F.when(_stop_loss(m * lot, config) <= budget, above).otherwise(F.struct(acc["lo"].alias("lo"), F.greatest(m - 1, acc["lo"]).alias("hi")))

    return F.get(F.transform(F.array(mid), halves), F.lit(0))


def _most_lots(upper: Column, config: RiskConfig, cents: float) -> Column:
    """The most lots up to ``upper`` whose loss, unrounded, is at most ``cents``.

    Without rounding the loss is the greatest of four straight lines, as either fee is the least one or a share
    of its amount; so it is within ``cents`` where every line is.
    """
    e, s, broker = F.col("entry_cents").cast("double"), F.col("stop_cents").cast("double"), config.broker
    rate, least = broker.commission_ppm / PPM * broker.discount_bps / BPS, 100.0 * broker.min_commission
    bare = e - s + s * (TAX_PPM / PPM)
    lines = [(2 * least, bare), (least, bare + e * rate), (least, bare + s * rate), (0.0, bare + (e + s) * rate)]
    shares = F.least(*[F.when(slope > 0, F.lit(cents - fixed) / slope) for fixed, slope in lines])
    return F.greatest(F.least(F.floor(shares / config.lot_size), upper), F.lit(0).cast("bigint"))


def with_shares(barriers: DataFrame, config: RiskConfig, mode: str = "rule") -> DataFrame:
    """Add ``shares``: a size whose loss at the stop, fees included, stays within the risk budget.

    ``rule`` corrects the fee-free size by the fees of the size at hand, at most twelve times: the
    first corrections are compiled projections, the rest a fold for rows that need them; ``max`` finds the largest such size, inside
    bounds taken from the unrounded loss (the loss never falls as shares rise, so bisection holds).
    """
    budget, lot, risk = F.lit(config.risk_budget), config.lot_size, F.col("risk_per_share")
    upper = _floor_lot(budget / risk, lot)
    if mode == "max":
        # the three rounded amounts are off by less than a whole unit each, which leaves a narrow bracket to halve
        most, cents, spread = F.call_function("div", upper, F.lit(lot)), 100 * config.risk_budget, 301
        lo, hi = F.col("_lo"), F.col("_hi")
        out = barriers.withColumn("_upper", most)
        out = out.withColumn("_lo", F.greatest(_most_lots(F.col("_upper"), config, cents - spread) - 1, F.lit(0).cast("bigint")))
        out = out.withColumn("_hi", F.least(_most_lots(F.col("_upper"), config, cents + spread) + 1, F.greatest("_upper", lo)))
        steps = F.sequence(F.lit(1), F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int"))
        start = F.struct(lo.alias("lo"), hi.alias("hi"))
        best = F.aggregate(steps, start, lambda acc, _: _halved(acc, lot, budget, config), lambda acc: acc["lo"])
        return out.withColumn("shares", F.when(F.col("feasible"), F.when(lo < hi, best).otherwise(lo) * lot)).drop("_upper", "_lo", "_hi")

    def correct(shares: Column, loss: Column) -> Column:
        smaller = _floor_lot((budget - (loss - risk * shares)) / risk, lot)
        return F.when(smaller >= shares, shares - lot).otherwise(smaller)

    def again(shares: Column, _: Column) -> Column:
        loss = _stop_loss(shares, config)
        return F.when((shares < lot) | (loss <= budget), shares).otherwise(correct(shares, loss))

    out, n = barriers.withColumn("shares", F.when(F.col("feasible"), upper)), F.col("shares")
    over = F.coalesce(F.col("_loss") > budget, F.lit(False))
    for _ in range(COMPILED_STEPS):
        out = out.withColumn("_loss", F.when(n >= lot, _stop_loss(n, config)))
        out = out.withColumn("shares", F.when(over, correct(n, F.col("_loss"))).otherwise(n))
    # almost no row is still over its budget here; only such rows walk the remaining corrections, and
    # then, lot by lot, down to the first size that fits: the largest, as the loss never falls as shares rise
    def closed(shares: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("lo"), F.call_function("div", shares, F.lit(lot)).alias("hi"))
        down = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTION_STEPS)), start, lambda acc, _: _halved(acc, lot, budget, config), lambda acc: acc["lo"] * lot)
        return F.greatest(F.when((shares >= lot) & (_stop_loss(shares, config) > budget), down).otherwise(shares), F.lit(0).cast("bigint"))

    rest = F.aggregate(F.sequence(F.lit(COMPILED_STEPS + 1), F.lit(SIZING_STEPS)), n, again, closed)
    settled = F.when(over, rest).otherwise(n)
    return out.withColumn("shares", F.when(n.isNotNull(), F.greatest(settled, F.lit(0).cast("bigint")))).drop("_loss")


def size_candidates(candidates: DataFrame, config: RiskConfig, mode: str = "rule") -> DataFrame:
    """Shares, value, exposure and the first reason that rejects a candidate on its own."""
    lot = config.lot_size
    n, value = F.col("shares"), F.col("position_value")
    cents = (
        with_barriers(candidates, config)
        .withColumn("entry_cents", to_cents(F.col("entry"))).withColumn("stop_cents", to_cents(F.col("stop_price")))
        .withColumn("target_cents", to_cents(F.col("target_price")))
    )
    sized = (
        with_shares(cents, config, mode)
        .withColumn("position_value", n * F.col("entry"))
        .withColumn("position_pct", value / config.equity * 100)
        .withColumn("win_cents", net_cents(F.col("entry_cents"), F.col("target_cents"), n, TAX_PPM, config.broker))
        .withColumn("loss_cents", -net_cents(F.col("entry_cents"), F.col("stop_cents"), n, TAX_PPM, config.broker))
    )
    reason = (
        F.when(F.col("sigma").isNull(), "volatility_unavailable")
        .when(~F.col("feasible"), "barrier_infeasible")
        .when(n < lot, "below_one_lot")
        .when(F.col("position_pct") > config.max_single_position_pct, "exceeds_single_position_cap")
        .when(F.col("win_cents") <= 0, "target_below_breakeven")
        .when(F.col("win_cents") <= F.col("loss_cents"), "odds_below_one")
    )
    return sized.withColumn("lots", n / lot).withColumn("own_reason", reason)


# ── limits in rank order ─────────────────────────────────────────────────────


def capped_greedy(sized: DataFrame, state: DataFrame, config: RiskConfig) -> DataFrame:
    """Approve in rank order under the caps; a skipped candidate consumes nothing.

    ``state`` has one row per day: entries so far this month, open positions, exposure and drawdown; a
    candidate of a day without state is an error. (d, rank) is unique.

    Candidates that fail on their own move no total, so only the others are walked. They lie in
    range partitions by (d, rank); what a day has in one of them is a piece. In each round every day
    that can still approve walks its next piece, starting from the totals that its last one left, in a
    task of its own; a day whose entry or position cap is reached is closed and takes no further part. A
    day of any size so costs one task per piece and the totals, not the rows, go from piece to piece.
    Last, rows after a day's close get its reason, and rows with an own reason get that one.
    """
    kept = ["d", "code", "rank", "own_reason", "shares", "position_pct", "position_value"]
    base = materialise(sized.select(*kept))
    placed = place(base.where("own_reason is null").drop("own_reason"), ["d"], [F.col("rank")]).rows
    dealt = materialise(placed.select("d", "_part").distinct().withColumn("_turn", F.row_number().over(W.partitionBy("d").orderBy("_part"))))
    rounds = dealt.agg(F.max("_turn")).first()[0] or 0
    # what is left of the day's budget is a total as well; NULL is no budget
    totals = state.select("d", *LIMITS, F.lit(config.daily_buy_budget).cast("double").alias("budget_left")).withColumn("closed_by", _closed(config))
    totals = materialise(totals.withColumn("closed_at", F.when(F.col("closed_by").isNotNull(), F.lit(-(2**63)))))
    reasons = None
    for turn in range(1, rounds + 1):
        due = dealt.where(F.col("_turn") == turn).join(totals.where("closed_by is null"), "d")
        if turn > 1 and not due.limit(1).count():
            break
        walked = materialise(_walked(placed, due, config))
        reasons = walked if reasons is None else reasons.unionByName(walked)
        totals = materialise(_left(totals, walked))
    days = totals.select("d", "closed_at", "closed_by", F.lit(True).alias("_known"))
    failing = base.where("own_reason is not null").withColumn("_reason", F.col("own_reason"))
    passing = placed.drop("_part").withColumn("own_reason", F.lit(None).cast("string"))
    if reasons is None:
        passing = passing.withColumn("_reason", F.lit(None).cast("string"))
    else:
        passing = passing.join(reasons.select("d", "rank", "_reason"), ["d", "rank"], "left")
    every = failing.select(*kept, "_reason").unionByName(passing.select(*kept, "_reason")).join(days, "d", "left")
    reason = F.coalesce(F.when(F.col("rank") > F.col("closed_at"), F.col("closed_by")), F.col("_reason"))
    unknown = F.raise_error(F.concat(F.lit("no risk state for "), F.coalesce(F.col("d").cast("string"), F.lit("NULL")))).cast("string")
    return every.select(*kept, F.when(F.col("_known"), reason).otherwise(unknown).alias("reject_reason")).withColumn("approved", F.col("reject_reason").isNull())


def load_configs(rows: DataFrame) -> list[tuple]:
    """(effective_from, RiskConfig) in order, from a table with a column for each field that differs from the default.

    A table of versions is written by hand; its rows are few.
    """
    names = set(RiskConfig.__dataclass_fields__) - {"broker"}
    kept = [c for c in rows.columns if c in names]
    found = rows.select("effective_from", *kept).orderBy("effective_from").collect()
    return [(r["effective_from"], RiskConfig(**{c: r[c] for c in kept if r[c] is not None})) for r in found]


def approvals_by_version(candidates: DataFrame, state: DataFrame, versions: list[tuple], mode: str = "rule") -> DataFrame:
    """:func:`capped_greedy` of sized candidates under the limits that are in force on each day, with their ``version``.

    Days before the first version are an error. The plan grows with the versions, not with the days.
    """
    if not versions:
        raise ValueError("no version of the limits")
    starts = [start for start, _ in versions]
    early = F.raise_error(F.concat(F.lit("no limits in force on "), F.col("d").cast("string"))).cast("boolean")
    checked = candidates.where(F.when(F.col("d") >= F.lit(starts[0]), F.lit(True)).otherwise(early))
    parts = []
    for (start, config), end in zip(versions, [*starts[1:], None]):
        inside = (F.col("d") >= F.lit(start)) & (F.lit(True) if end is None else F.col("d") < F.lit(end))
        decided = capped_greedy(size_candidates(checked.where(inside), config, mode), state.where(inside), config)
        parts.append(decided.withColumn("version", F.lit(config.version)))
    return reduce(DataFrame.unionByName, parts)


LIMITS = ("entries", "open_positions", "exposure_pct", "drawdown_pct")
TOTALS = ("entries", "open_positions", "exposure_pct", "budget_left")


def _closed(config: RiskConfig) -> Column:
    """Why a day takes nothing more whatever comes, or NULL."""
    return (
        F.when(F.col("drawdown_pct") >= config.circuit_breaker_pct, "circuit_breaker").when(F.col("entries") >= config.monthly_entry_cap, "monthly_turnover_cap")
        .when(F.col("open_positions") >= config.max_concurrent, "concurrent_position_cap"))


def _left(totals: DataFrame, walked: DataFrame) -> DataFrame:
    """The totals after a round; days that walked nothing in it keep theirs."""
    ends = [F.max_by(f"_{c}", "rank").alias(f"_{c}") for c in (*TOTALS, "closed_by")]
    last = walked.groupBy("d").agg(F.lit(True).alias("_moved"), F.min(F.when(F.col("_closed_by").isNotNull(), F.col("rank").cast("bigint"))).alias("_closed_at"), *ends)
    new = [F.when(F.col("_moved"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in (*TOTALS, "closed_by", "closed_at")]
    return totals.join(last, "d", "left").select("d", *new)


def _walked(placed: DataFrame, due: DataFrame, config: RiskConfig) -> DataFrame:
    """(d, rank, _reason) and the day's totals after each row of the pieces that are due."""
    rows = placed.select("d", "rank", "position_pct", "position_value", "_part").join(due.select("d", "_part", *TOTALS), ["d", "_part"])
    kinds = dict(rows.dtypes)
    schema = f"d {kinds['d']}, rank {kinds['rank']}, _reason string, _closed_by string, " + ", ".join(f"_{c} {kinds[c]}" for c in TOTALS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, totals = None, None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("d", "position_pct", "position_value", *TOTALS)}
            found = []
            for i in range(batch.num_rows):
                if totals is None or columns["d"][i] != day:
                    day, totals = columns["d"][i], _Totals(config, *(columns[c][i] for c in TOTALS))
                found.append((totals.decide(columns["position_pct"][i], columns["position_value"][i]), totals.closed(), totals.entries, totals.open, totals.exposure, totals.budget))
            kind = [pa.string(), pa.string(), *(batch.schema.field(c).type for c in TOTALS)]
            made = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("rank"), *made], ["d", "rank", "_reason", "_closed_by", *(f"_{c}" for c in TOTALS)])

    return rows.repartition("d", "_part").sortWithinPartitions("d", "rank").mapInArrow(walk, schema)


class _Totals:
    """Running totals of one day."""

    def __init__(self, config: RiskConfig, entries, open_positions, exposure_pct, budget_left):
        self.config, self.entries, self.open, self.exposure, self.budget = config, entries, open_positions, exposure_pct, budget_left

    def closed(self) -> str | None:
        if self.entries >= self.config.monthly_entry_cap:
            return "monthly_turnover_cap"
        return "concurrent_position_cap" if self.open >= self.config.max_concurrent else None

    def decide(self, pct: float, value: float) -> str | None:
        """Why a candidate without a reason of its own is rejected, or None, in which case it is counted."""
        reason = self.closed()
        if reason:
            return reason
        if self.exposure + pct > self.config.max_total_exposure_pct:
            return "total_exposure_cap"
        if self.budget is not None:
            if value > self.budget:
                return "daily_buy_budget"
            self.budget -= value
        self.entries, self.open, self.exposure = self.entries + 1, self.open + 1, self.exposure + pct
        return None


def rejection_counts(decided: DataFrame) -> DataFrame:
    return (
        decided.filter(~F.col("approved")).groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "reason")
    )


def limits_proof(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """Per day: approved plus rejected codes must be exactly the candidates, each decided once."""
    a = candidates.groupBy("d", "code").agg(F.count(F.lit(1)).alias("_c"))
    b = decided.groupBy("d", "code").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("approved").cast("int")).alias("_ok"), F.count_if(F.col("approved") == F.col("reject_reason").isNotNull()).alias("_odd"))
    joined = a.join(b, ["d", "code"], "full_outer")
    ok = F.coalesce(F.col("_ok"), F.lit(0))
    out = joined.groupBy("d").agg(
        F.count("_c").alias("candidates"), F.sum(ok).alias("approved"), F.count_if(F.col("_n").isNotNull() & (ok == 0)).alias("rejected"),
        F.count_if(F.col("_c").isNull() | F.col("_n").isNull() | (F.col("_n") > 1) | (F.col("_odd") > 0)).alias("faults"),
    )
    return out.withColumn("only_subtracts", (F.col("faults") == 0) & (F.col("approved") + F.col("rejected") == F.col("candidates")))


def monthly_entries(log: DataFrame, as_of_days: DataFrame, probe_revision: int = 1000) -> DataFrame:
    """Signals logged from the month's start up to each day. Every revision counts here.

    Counted per day first; the running sum then sees one row per calendar day of a month.
    """
    daily = log.filter((F.col("list_kind") == "trade_signal") & (F.col("revision") < probe_revision)).groupBy("d").agg(F.count(F.lit(1)).alias("_n"))
    days = as_of_days.select("d").distinct().join(daily, "d", "full_outer")
    run = W.partitionBy(F.trunc("d", "MM")).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    summed = days.select("d", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("entries"))
    return as_of_days.select("d").distinct().join(summed, "d")
