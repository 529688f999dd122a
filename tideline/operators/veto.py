"""Vetoes: evidence-carrying set subtraction. A veto can remove a candidate, never add one.

Hits are rows (d, code, rule_id, reason, evidence). Candidates are (d, code) rows, one per pair,
so one job covers every trading day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.functions.text import evidence_or_fixed
from tideline.operators.align import cover_days, last_by_key

KEYS = ["d", "code"]
HIT = ["d", "code", "rule_id", "reason", "evidence"]

# Rule id → (display name, how sure the rule is), most certain first.
RULES = {
    "suspended": ("暫停交易", "certain"),
    "disposition": ("處置股（處置期間內）", "certain"),
    "altered_trading": ("變更交易方法／分盤／管理股票／停止交易", "certain"),
    "attention": ("注意股", "suspected"),
    "margin_suspension": ("停資停券期間", "suspected"),
    "llm_material_news": ("重大訊息負面事件（本機 LLM 判讀）", "suspected"),
    "source_unavailable": ("否決所需資料缺漏（fail-closed）", "certain"),
}
# The flag columns of an altered-trading row and what each is called.
FLAG_NAMES = {"altered": "變更交易方法", "periodic": "分盤交易", "managed": "管理股票", "halted": "停止交易"}
# Inputs without which nothing may pass.
REQUIRED_SOURCES = ("attention", "disposition", "suspended", "altered_trading")


def rule_dimension(spark: SparkSession) -> DataFrame:
    rows = [(rule, name, sure) for rule, (name, sure) in RULES.items()]
    return spark.createDataFrame(rows, "rule_id string, display_name string, confidence string")


def unlabelled_rules(hits: DataFrame, dimension: DataFrame) -> DataFrame:
    return hits.select("rule_id").distinct().join(dimension, "rule_id", "left_anti")


def _hits(df: DataFrame, rule: str, reason: Column, evidence: Column) -> DataFrame:
    return df.select(
        "d", "code", F.lit(rule).alias("rule_id"), reason.alias("reason"), evidence_or_fixed(evidence).alias("evidence")
    )


def _covered(candidates: DataFrame, notices: DataFrame) -> DataFrame:
    """Candidates with their first covering notice's own columns. ``pos`` is the input order."""
    first = candidates.select(*KEYS).join(cover_days(notices, candidates), KEYS)
    return first.join(notices.drop("code"), "pos")


def veto_suspended(candidates: DataFrame, halts: DataFrame) -> DataFrame:
    """Halted and not yet resumed: no resumption day, or one after the signal day.

    A code's last halt row is the one that counts, so the join meets one row per code.
    """
    current = last_by_key(halts.select("code", "pos", "resume_d", "evidence"), ["code"], ["pos"])
    active = candidates.select(*KEYS).join(current, "code").filter("resume_d is null or resume_d > d")
    return _hits(active, "suspended", F.lit("停牌中，復牌日未到或未公布"), F.col("evidence"))


def veto_interval(candidates: DataFrame, notices: DataFrame, rule: str = "disposition") -> DataFrame:
    """Inside a closed interval, or listed with an interval that could not be read."""
    unknown = F.col("start_d").isNull() | F.col("end_d").isNull()
    reason = F.when(unknown, "有公告但期間無法解析").otherwise(
        F.concat(F.lit("期間 "), F.col("start_d").cast("string"), F.lit(" ~ "), F.col("end_d").cast("string"), F.lit(" 涵蓋訊號日"))
    )
    return _hits(_covered(candidates, notices), rule, reason, F.col("evidence"))


def veto_margin_suspension(candidates: DataFrame, notices: DataFrame) -> DataFrame:
    """As :func:`veto_interval`; its source is optional, so it never takes part in fail-closed."""
    return veto_interval(candidates, notices, "margin_suspension")


def veto_flags(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """Any set flag; the reason names them all."""
    named = [F.when(F.coalesce(F.col(c), F.lit(False)), name) for c, name in FLAG_NAMES.items()]
    reason = F.array_join(F.array_compact(F.array(*named)), "、")
    joined = candidates.select(*KEYS).join(flags, KEYS if "d" in flags.columns else ["code"])
    return _hits(joined.withColumn("_reason", reason).filter("_reason <> ''"), "altered_trading", F.col("_reason"), F.col("evidence"))


def veto_point(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """Listed on the signal day, or listed without a readable day."""
    dated = points.filter("d is not null").groupBy(*KEYS).agg(F.max_by("info", "pos").alias("evidence"), F.max("pos").alias("_p"))
    undated = points.filter("d is null").groupBy("code").agg(F.max_by("info", "pos").alias("_any"), F.max("pos").alias("_q"))
    joined = candidates.select(*KEYS).join(dated, KEYS, "left").join(undated, "code", "left")
    newest = F.when(F.coalesce("_q", F.lit(-1)) > F.coalesce("_p", F.lit(-1)), F.col("_any")).otherwise(F.col("evidence"))
    return _hits(joined.filter("_p is not null or _q is not null"), "attention", F.lit("訊號日列於注意名單"), newest)


def stale_points(points: DataFrame, days: DataFrame) -> DataFrame:
    """Listed rows that belong to none of the asked days."""
    return points.filter("d is not null").join(days.select("d").distinct(), "d", "left_anti").agg(F.count(F.lit(1)).alias("stale"))


def fail_closed(candidates: DataFrame, availability: DataFrame, required: tuple[str, ...] = REQUIRED_SOURCES) -> DataFrame:
    """Every candidate of a day on which a required source was missing.

    ``availability`` has one row per day and usable source: days × sources, a small table.
    """
    got = availability.filter(F.col("source").isin(*required) & F.col("usable")).groupBy("d").agg(
        *[F.max((F.col("source") == r)).alias(r) for r in required]
    )
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.col(r), F.lit(False)), r) for r in required])), ",")
    joined = candidates.select(*KEYS).join(got, "d", "left").withColumn("_missing", missing).filter("_missing <> ''")
    return _hits(joined, "source_unavailable", F.lit("必要來源缺漏"), F.col("_missing"))


def apply_vetoes(candidates: DataFrame, *hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, hits): all hits stay on record, one candidate may have several."""
    every = reduce(DataFrame.unionByName, [h.select(*HIT) for h in hits])
    return candidates.join(every.select(*KEYS), KEYS, "left_anti"), every


def merge_layers(*layers: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [h.select(*HIT) for h in layers])


def subtraction_proof(candidates: DataFrame, passed: DataFrame, hits: DataFrame) -> DataFrame:
    """Per day: sizes, strangers and repeats among the passed, and whether the layer only subtracted."""
    tag = lambda df, name: df.select(*KEYS, F.lit(1).alias(name))
    sides = [
        candidates.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_c")),
        passed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_p")),
        tag(hits.select(*KEYS).distinct(), "_v"),
    ]
    joined = reduce(lambda a, b: a.join(b, KEYS, "full_outer"), sides)
    c, p, v = (F.coalesce(F.col(x), F.lit(0)) for x in ("_c", "_p", "_v"))
    out = joined.groupBy("d").agg(
        F.sum(c).alias("candidates"), F.sum(p).alias("passed"), F.sum(v).alias("vetoed"),
        F.count_if((p > 0) & (c == 0)).alias("strangers"), F.count_if(p > 1).alias("repeats"),
    )
    return out.withColumn(
        "only_subtracts",
        (F.col("strangers") == 0) & (F.col("repeats") == 0) & (F.col("passed") + F.col("vetoed") == F.col("candidates")),
    )


def veto_counts(hits: DataFrame) -> DataFrame:
    """Per day and rule: hits; plus the day's distinct codes and codes with more than one rule."""
    per_code = hits.groupBy(*KEYS).agg(F.count_distinct("rule_id").alias("_rules"))
    day = per_code.groupBy("d").agg(F.count(F.lit(1)).alias("codes"), F.count_if(F.col("_rules") > 1).alias("multi_rule_codes"))
    return hits.groupBy("d", "rule_id").agg(F.count(F.lit(1)).alias("hits")).join(day, "d")


def with_rank(hits: DataFrame, ranked: DataFrame, roster: DataFrame, default_market: str) -> DataFrame:
    """Veto events with the rank and score a code had, and its market."""
    joined = hits.join(ranked.select(*KEYS, "rank", "composite"), KEYS, "left").join(roster.select("code", "market"), "code", "left")
    return joined.withColumn("market", F.coalesce("market", F.lit(default_market)))


def top_k_vetoed(watch: DataFrame, hits: DataFrame, dimension: DataFrame) -> DataFrame:
    """Watchlist codes that were vetoed, with the labels of the rules that did it (at most all rules)."""
    labels = hits.join(watch.select(*KEYS), KEYS, "left_semi").join(dimension, "rule_id")
    names = labels.select(*KEYS, "display_name").distinct().groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list("display_name")), "、").alias("blocked_by"))
    return watch.join(names, KEYS)


def rank_distribution(events: DataFrame, width: int = 10) -> DataFrame:
    """Vetoed rows per rank bucket and rule: does the layer stop good names or bad ones?"""
    bucket = F.floor((F.col("rank") - 1) / width).cast("bigint")
    return events.groupBy("rule_id", bucket.alias("rank_bucket")).agg(F.count(F.lit(1)).alias("n"))


def veto_text(candidates: DataFrame, tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hits from stored text verdicts: the first vetoing task of a code in task order.

    A task without a verdict does not veto: a missing judge must not stop everything.
    """
    judged = tasks.join(verdicts.filter("verdict = 'veto'"), "task_key")
    first = judged.groupBy(*KEYS).agg(F.min_by(F.struct("task_key", "subject", "evidence"), "task_pos").alias("_t"))
    joined = candidates.select(*KEYS).join(first, KEYS)
    return _hits(joined, "llm_material_news", F.lit("文字判讀結果為否決"), F.col("_t.evidence"))


def text_verdict_counts(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    joined = tasks.join(verdicts, "task_key", "left")
    return joined.groupBy("d").agg(
        F.count_if(F.col("verdict").isNull()).alias("pending"),
        F.count_if(~F.col("parse_ok")).alias("parse_failures"),
        F.count_if(F.col("parse_ok") & ~F.col("evidence_verified")).alias("evidence_failures"),
    )
