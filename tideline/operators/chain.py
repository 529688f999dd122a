"""The daily chain in one plan: rank, rule vetoes, text vetoes, limits, and the rows that are stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tideline.operators import ranking, risk, veto
from tideline.session import materialise

RULES, TEXT = "rules", "text"


@dataclass(frozen=True)
class DailyChain:
    """What a run of the chain leaves: every ranked code is passed or vetoed, every passed one approved or rejected."""

    passed: DataFrame
    hits: DataFrame
    decided: DataFrame
    picks: DataFrame
    veto_events: DataFrame


def veto_chain(ranked: DataFrame, rule_hits: list[DataFrame], tasks: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, hits): the rules first, then stored text verdicts on what the rules let pass.

    ``hits`` names the ``layer`` of each. Both layers only take away; a code that the rules stop is not
    asked for its texts, and a text without a verdict stops nobody.
    """
    by_rules, found = veto.apply_vetoes(ranked, *rule_hits)
    by_rules = materialise(by_rules)
    by_text = materialise(veto.veto_text(by_rules, tasks, verdicts))
    hits = found.withColumn("layer", F.lit(RULES)).unionByName(by_text.select(*found.columns).withColumn("layer", F.lit(TEXT)))
    return by_rules.join(by_text.select("d", "code"), ["d", "code"], "left_anti"), hits


def daily_chain(ranked: DataFrame, bars: DataFrame, rule_hits: list[DataFrame], tasks: DataFrame, verdicts: DataFrame, volatility: DataFrame, state: DataFrame,
                roster: DataFrame, config: risk.RiskConfig = risk.RiskConfig(), k: int = ranking.WATCHLIST_SIZE, revision: int = 1, market: str = "") -> DailyChain:
    """All days at once.

    ``ranked``: d, code, rank, composite; ``bars``: d, code, close; ``volatility``: d, code, sigma, NULL where it
    could not be estimated; ``state``: the risk state of each day as it is stored. The watchlist is
    the first ``k`` by rank, whatever is vetoed or rejected; signals are what the limits approve, in rank
    order among those that passed, with all their barrier fields.
    """
    ranked = materialise(ranked.select("d", "code", "rank", "composite"))
    passed, hits = veto_chain(ranked, rule_hits, tasks, verdicts)
    hits = materialise(hits)
    price = bars.select("d", "code", F.col("close").alias("entry"))
    candidates = passed.join(price, ["d", "code"], "left").join(volatility.select("d", "code", "sigma"), ["d", "code"], "left")
    sized = materialise(risk.size_candidates(candidates, config))
    decided = risk.capped_greedy(sized, state, config)
    approved = decided.filter("approved").select("d", "code").join(sized, ["d", "code"])
    signals = approved.select(
        "d", "code", "rank", "composite", F.col("entry").alias("entry_price"), "stop_price", "target_price", F.lit(config.holding_days).alias("time_exit_days"), "shares",
        F.col("sigma").alias("sigma_daily"))
    return DailyChain(
        passed, hits, decided, ranking.build_pick_rows(ranked, bars, signals, k=k, revision=revision), veto.with_rank(hits, ranked, roster, market))
