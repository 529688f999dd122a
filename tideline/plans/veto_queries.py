"""Veto queries: candidates are the tradable codes of each day, notices come from error ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.operators import ranking, veto
from tideline.plans.catalogue import query
from tideline.plans.ranking_queries import quoted, ranked
from tideline.plans.views import Tables
from tideline.session import materialise


def candidates(t: Tables) -> DataFrame:
    return quoted(t).select("d", "code")


def dispositions(t: Tables) -> DataFrame:
    return t.notices().filter("k < 20").select("pos", "code", "start_d", "end_d", F.concat(F.lit("k="), F.col("k").cast("string")).alias("evidence"))


def margin_notices(t: Tables) -> DataFrame:
    return t.notices().filter("k >= 90").select("pos", "code", "start_d", "end_d", F.lit(" ").alias("evidence"))


def halts(t: Tables) -> DataFrame:
    return t.notices().filter("k between 40 and 59").select(
        "pos", "code", F.col("end_d").alias("resume_d"), F.concat(F.lit("k="), F.col("k").cast("string")).alias("evidence"))


def flags(t: Tables) -> DataFrame:
    k = F.col("k")
    daily = t.ticks().groupBy("code", "d").agg(F.max("k").alias("k"))
    return daily.select(
        "code", "d", (k % 11 == 0).alias("altered"), (k % 7 == 0).alias("periodic"), (k % 13 == 0).alias("managed"),
        F.lit(False).alias("halted"), F.concat(F.lit("k="), k.cast("string")).alias("evidence"))


def points(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.ticks().filter("event_type = 'purchase' and k >= 60").select(
        "code", F.when(k % 12 != 0, F.col("d")).alias("d"), F.col("event_id").alias("pos"), F.concat(F.lit("p"), k.cast("string")).alias("info"))


def availability(t: Tables) -> DataFrame:
    """One row per day and source; one source is missing on some days."""
    sources = F.explode(F.array(*[F.lit(s) for s in veto.REQUIRED_SOURCES])).alias("source")
    day = F.dayofmonth("d")
    return t.cal().select("d", sources).select("d", "source", (~((F.col("source") == "attention") & (day % 9 == 0))).alias("usable"))


def layers(t: Tables, c: DataFrame | None = None) -> list[DataFrame]:
    """All rule layers. The candidates are written once, since every rule reads them."""
    c = materialise(candidates(t)) if c is None else c
    return [
        veto.veto_suspended(c, halts(t)), veto.veto_interval(c, dispositions(t)), veto.veto_flags(c, flags(t)),
        veto.veto_point(c, points(t)), veto.veto_margin_suspension(c, margin_notices(t)), veto.fail_closed(c, availability(t)),
    ]


def hits(t: Tables) -> DataFrame:
    return veto.merge_layers(*layers(t))


def stored_hits(t: Tables) -> DataFrame:
    """The same hits, each layer a job of its own: the driver holds the plan and the tasks of one rule at a time."""
    return veto.merge_layers(*map(t.step, layers(t)))


def ranked_hits(t: Tables) -> DataFrame:
    """Veto events. Hits and ranks are written before they meet, as either alone is a large plan."""
    return veto.with_rank(stored_hits(t), t.once("ranked", ranked), t.roster(), "M0")


SUSPENDED = """SELECT q.d, q.code, 'suspended' AS rule_id, concat('k=', h.k) AS evidence FROM quoted q JOIN (
   SELECT code, max_by(coalesce(CAST(end_d AS STRING), ''), pos) AS resume, max_by(k, pos) AS k FROM notices WHERE k BETWEEN 40 AND 59 GROUP BY code) h
   ON h.code = q.code AND (resume = '' OR CAST(nullif(resume, '') AS DATE) > q.d)"""
INTERVAL = """SELECT q.d, q.code, '{rule}' AS rule_id, min_by({evidence}, n.pos) AS evidence FROM quoted q JOIN notices n ON n.code = q.code AND {where}
   AND (n.start_d IS NULL OR n.end_d IS NULL OR q.d BETWEEN n.start_d AND n.end_d) GROUP BY q.d, q.code"""
DISPOSITION = INTERVAL.format(rule="disposition", evidence="concat('k=', n.k)", where="n.k < 20")
MARGIN = INTERVAL.format(rule="margin_suspension", evidence="'（無原文）'", where="n.k >= 90")
FLAGS = """SELECT q.d, q.code, 'altered_trading' AS rule_id, concat('k=', k) AS evidence FROM quoted q JOIN (SELECT code, d, max(k) AS k FROM ticks GROUP BY code, d) f
   ON f.code = q.code AND f.d = q.d WHERE k % 11 = 0 OR k % 7 = 0 OR k % 13 = 0"""
POINT = """SELECT q.d, q.code, 'attention' AS rule_id, max_by(concat('p', p.k), p.event_id) AS evidence FROM quoted q JOIN ticks p
   ON p.code = q.code AND p.event_type = 'purchase' AND p.k >= 60 AND (p.k % 12 = 0 OR p.d = q.d) GROUP BY q.d, q.code"""
CLOSED = "SELECT d, code, 'source_unavailable' AS rule_id, 'attention' AS evidence FROM quoted WHERE day(d) % 9 = 0"
HITS = f"hits AS ({SUSPENDED} UNION ALL {DISPOSITION} UNION ALL {FLAGS} UNION ALL {POINT} UNION ALL {MARGIN} UNION ALL {CLOSED})"


def _register(name: str, sql: str, build) -> None:
    query(name, sql)(lambda t: build(t).select("d", "code", "rule_id", "evidence"))


_register("veto_suspended", SUSPENDED, lambda t: veto.veto_suspended(candidates(t), halts(t)))
_register("veto_disposition", DISPOSITION, lambda t: veto.veto_interval(candidates(t), dispositions(t)))
_register("veto_altered_trading", FLAGS, lambda t: veto.veto_flags(candidates(t), flags(t)))
_register("veto_attention", POINT, lambda t: veto.veto_point(candidates(t), points(t)))
_register("veto_margin_suspension", MARGIN, lambda t: veto.veto_margin_suspension(candidates(t), margin_notices(t)))
_register("veto_source_unavailable", CLOSED, lambda t: veto.fail_closed(candidates(t), availability(t)))


@query("veto_flag_reasons", """SELECT q.d, q.code, concat_ws('、', CASE WHEN k % 11 = 0 THEN '變更交易方法' END, CASE WHEN k % 7 = 0 THEN '分盤交易' END,
   CASE WHEN k % 13 = 0 THEN '管理股票' END) AS reason FROM quoted q JOIN (SELECT code, d, max(k) AS k FROM ticks GROUP BY code, d) f
   ON f.code = q.code AND f.d = q.d WHERE k % 11 = 0 OR k % 7 = 0 OR k % 13 = 0""")
def veto_flag_reasons(t: Tables) -> DataFrame:
    return veto.veto_flags(candidates(t), flags(t)).select("d", "code", "reason")


@query("stale_attention", "SELECT count(*) AS stale FROM ticks WHERE event_type = 'purchase' AND k >= 60 AND k % 12 <> 0 AND d NOT IN (SELECT d FROM cal WHERE i % 2 = 0)")
def stale_attention(t: Tables) -> DataFrame:
    return veto.stale_points(points(t), t.cal().filter("i % 2 = 0"))


@query("vetoes_applied", f"WITH {HITS} SELECT d, code FROM quoted WHERE (d, code) NOT IN (SELECT d, code FROM hits)")
def vetoes_applied(t: Tables) -> DataFrame:
    c = materialise(candidates(t))
    return veto.apply_vetoes(c, *layers(t, c))[0]


@query("veto_subtraction_proof", f"""WITH {HITS} SELECT d, count(*) AS candidates, count(*) FILTER (NOT v) AS passed, count(*) FILTER (v) AS vetoed,
   0 AS strangers, 0 AS repeats, true AS only_subtracts FROM (SELECT d, (d, code) IN (SELECT d, code FROM hits) AS v FROM quoted) x GROUP BY d""")
def veto_subtraction_proof(t: Tables) -> DataFrame:
    c = materialise(candidates(t))
    passed, every = veto.apply_vetoes(c, *layers(t, c))
    return veto.subtraction_proof(c, passed, every)


@query("veto_counts", f"""WITH {HITS}, pc AS (SELECT d, code, count(DISTINCT rule_id) AS rules FROM hits GROUP BY d, code),
   pd AS (SELECT d, count(*) AS codes, count(*) FILTER (rules > 1) AS multi_rule_codes FROM pc GROUP BY d)
   SELECT h.d, h.rule_id, count(*) AS hits, codes, multi_rule_codes FROM hits h JOIN pd USING (d) GROUP BY ALL""")
def veto_counts(t: Tables) -> DataFrame:
    return veto.veto_counts(hits(t))


@query("veto_events", f"""WITH {HITS} SELECT h.d, h.code, h.rule_id, r.rank, r.composite, coalesce(m.market, 'M0') AS market
   FROM hits h LEFT JOIN ranked r ON r.d = h.d AND r.code = h.code LEFT JOIN roster m ON m.code = h.code""")
def veto_events(t: Tables) -> DataFrame:
    return ranked_hits(t).select("d", "code", "rule_id", "rank", "composite", "market")


@query("veto_rank_distribution", f"""WITH {HITS} SELECT rule_id, CAST(floor((r.rank - 1) / 10) AS BIGINT) AS rank_bucket, count(*) AS n
   FROM hits h LEFT JOIN ranked r ON r.d = h.d AND r.code = h.code GROUP BY 1, 2""")
def veto_rank_distribution(t: Tables) -> DataFrame:
    return veto.rank_distribution(ranked_hits(t))


LABELS = "(VALUES " + ", ".join(f"('{r}', '{n}', '{c}')" for r, (n, c) in veto.RULES.items()) + ") dim(rule_id, display_name, confidence)"


@query("watchlist_vetoed", f"""WITH {HITS}, lab AS (SELECT DISTINCT h.d, h.code, display_name FROM hits h JOIN {LABELS} ON dim.rule_id = h.rule_id)
   SELECT r.d, r.code, r.rank, string_agg(display_name, '、' ORDER BY display_name COLLATE "C") AS blocked_by FROM ranked r JOIN lab ON lab.d = r.d AND lab.code = r.code
   WHERE r.rank <= 5 GROUP BY r.d, r.code, r.rank""".replace(' COLLATE "C"', ""))
def watchlist_vetoed(t: Tables) -> DataFrame:
    watch = ranking.watchlist(ranked(t)).select("d", "code", "rank")
    return veto.top_k_vetoed(watch, hits(t), veto.rule_dimension(t.spark))


@query("rule_labels", f"""WITH {HITS} SELECT h.rule_id, display_name, confidence, count(*) AS hits FROM hits h JOIN {LABELS} ON dim.rule_id = h.rule_id GROUP BY ALL""")
def rule_labels(t: Tables) -> DataFrame:
    n = hits(t).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return n.join(veto.rule_dimension(t.spark), "rule_id")


def text_tasks(t: Tables) -> DataFrame:
    a = t.announce()
    return a.select(
        F.col("doc_id").alias("task_key"), F.col("doc_id").alias("task_pos"), F.regexp_replace("code", "src", "").cast("bigint").alias("code"),
        F.col("speak_date").alias("d"), "subject", F.col("detail").alias("evidence"))


TASKS = """tasks AS (SELECT doc_id AS task_key, CAST(replace(code, 'src', '') AS BIGINT) AS code, speak_date AS d, subject, detail AS evidence FROM announce)"""


@query("veto_text", f"""WITH {TASKS} SELECT q.d, q.code, min_by(t.task_key, t.task_key) AS task_key FROM quoted q JOIN tasks t ON t.d = q.d AND t.code = q.code
   JOIN verdicts v ON v.task_key = t.task_key AND v.verdict = 'veto' GROUP BY q.d, q.code""")
def veto_text(t: Tables) -> DataFrame:
    tasks = text_tasks(t).withColumn("evidence", F.concat(F.lit("task "), F.col("task_key").cast("string")))
    out = veto.veto_text(candidates(t), tasks, t.verdicts())
    return out.select("d", "code", F.regexp_replace("evidence", "task ", "").cast("bigint").alias("task_key"))


@query("text_verdict_counts", f"""WITH {TASKS} SELECT t.d, count(*) FILTER (v.verdict IS NULL) AS pending, count(*) FILTER (NOT parse_ok) AS parse_failures,
   count(*) FILTER (parse_ok AND NOT evidence_verified) AS evidence_failures FROM tasks t LEFT JOIN verdicts v USING (task_key) GROUP BY t.d""")
def text_verdict_counts(t: Tables) -> DataFrame:
    return veto.text_verdict_counts(text_tasks(t), t.verdicts())
