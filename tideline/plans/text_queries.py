"""Text queue, verdict, exam, registry and report queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions import hashing, judging
from tideline.operators import chain, quality, ranking, registry, reports, risk, textqueue as tq, veto
from tideline.plans.catalogue import query
from tideline.plans.outcome_queries import picks, scored_picks
from tideline.plans.oracle import sql_fixed, sql_signed_pct
from tideline.plans.ranking_queries import FACTOR_TEXT, coarse, detail, factor_activity, ranked
from tideline.plans.risk_queries import EWM, greedy
from tideline.plans.veto_queries import HITS, LABELS, TASKS, hits, layers as rule_layers, ranked_hits, text_tasks
from tideline.plans.views import Tables
from tideline.session import shared_table_path

# ── keys ─────────────────────────────────────────────────────────────────────

SEP = "chr(31)"
WSX = r"'[\s\x{00A0}\x{3000}\x{FEFF}]+'"
TRIMX = r"'^[\s\x{00A0}\x{3000}\x{FEFF}]+|[\s\x{00A0}\x{3000}\x{FEFF}]+$'"
CONTENT_KEY = f"sha256(concat_ws({SEP}, market, code, " + ", ".join(f"regexp_replace({c}, {WSX}, '', 'g')" for c in ("clause", "subject", "detail")) + "))"
ITEM_HASH = f"sha256(concat_ws({SEP}, market, code, strftime(speak_date, '%Y-%m-%d'), clause, " + ", ".join(f"regexp_replace({c}, {TRIMX}, '', 'g')" for c in ("subject", "detail")) + "))"
KEYED = f"keyed AS (SELECT *, {CONTENT_KEY} AS content_key FROM announce)"


@query("announcement_keys", f"""SELECT doc_id, concat_ws(':', market, code, strftime(speak_date, '%Y-%m-%d'), substring({ITEM_HASH}, 1, 12)) AS item_key, {CONTENT_KEY} AS content_key FROM announce""")
def announcement_keys(t: Tables) -> DataFrame:
    c = {n: F.col(n) for n in ("market", "code", "speak_date", "clause", "subject", "detail")}
    full = hashing.announcement_hash(*c.values())
    keyed = tq.content_keyed(t.announce())
    return keyed.select("doc_id", hashing.announcement_key(c["market"], c["code"], c["speak_date"], full).alias("item_key"), "content_key")


@query("repeat_groups", f"""WITH anon AS (SELECT doc_id, market, 'x' AS code, speak_date, '' AS clause, subject, detail FROM announce), k AS (SELECT doc_id, {CONTENT_KEY} AS content_key FROM anon)
   SELECT content_key, count(*) AS copies, min(doc_id) AS first_item FROM k GROUP BY content_key HAVING count(*) > 1""")
def repeat_groups(t: Tables) -> DataFrame:
    same_issuer = t.announce().withColumns({"code": F.lit("x"), "clause": F.lit("")})
    return tq.repeat_groups(tq.content_keyed(same_issuer))


@query("repeated_bodies", "SELECT sha256(text) AS content_key, count(*) AS copies, min(doc_id) AS first_item FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_bodies(t: Tables) -> DataFrame:
    return tq.repeat_groups(t.documents.select("doc_id", F.sha2("text", 256).alias("content_key")))


@query("canonical_hashes", """SELECT p_partkey, sha256(concat('{"brand":"', p_brand, '","name":"', p_name, '","size":"', p_size, '","type":', CASE WHEN p_size % 5 = 0 THEN 'null' ELSE concat('"', p_type, '"') END, '}')) AS definition_hash FROM part""")
def canonical_hashes(t: Tables) -> DataFrame:
    m = F.create_map(
        F.lit("type"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")), F.lit("size"), F.col("p_size").cast("string"),
        F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return t.part.select("p_partkey", hashing.canonical_hash(m).alias("definition_hash"))


@query("definition_hashes", """SELECT p_partkey, sha256(concat('{"bounds":[', p_size, ',', p_size + 1, '],"direction":"', p_brand, '",', CASE WHEN p_size % 5 <> 0 THEN concat('"note":"a\\"', p_type, '\\n",') ELSE '' END,
   '"winsorize":{"lower":', CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE concat(p_size // 2, '.5') END, ',"upper":99}}')) AS definition_hash FROM part""")
def definition_hashes(t: Tables) -> DataFrame:
    size = F.col("p_size")
    definition = F.struct(
        F.struct(F.lit(99.0).alias("upper"), (size / 2.0).alias("lower")).alias("winsorize"), F.col("p_brand").alias("direction"),
        F.when(size % 5 != 0, F.concat(F.lit('a"'), F.col("p_type"), F.lit("\n"))).alias("note"), F.array(size, size + 1).alias("bounds"))
    rows = t.part.select("p_partkey", definition.alias("definition"))
    return rows.select("p_partkey", hashing.definition_hash(F.col("definition"), rows.schema["definition"].dataType).alias("definition_hash"))


# ── judging ──────────────────────────────────────────────────────────────────


@query("judged_responses", "SELECT task_key, verdict, quoted_evidence, evidence_verified, parse_ok, failure FROM judged")
def judged_responses(t: Tables) -> DataFrame:
    j = judging.judge_responses(t.responses())
    return j.select("task_key", "verdict", "quoted_evidence", "evidence_verified", "parse_ok", "failure")


@query("judge_batch_alarm", "SELECT task_key % 6 AS batch, count(*) AS n, count(*) FILTER (NOT parse_ok) AS unusable, count(*) FILTER (NOT parse_ok) * 2 > count(*) AS alarm FROM judged GROUP BY 1")
def judge_batch_alarm(t: Tables) -> DataFrame:
    j = judging.judge_responses(t.responses()).withColumn("batch", F.col("task_key") % 6)
    return judging.batch_alarm(j, ["batch"])


@query("verdict_rules", """SELECT rule, rows, violations FROM (SELECT count(*) AS rows, count(*) FILTER (NOT parse_ok AND v = 'veto') AS parse_fail_cannot_veto,
   count(*) FILTER (v = 'veto' AND NOT (evidence_verified AND trim(quoted_evidence) <> '')) AS veto_needs_evidence FROM (
   SELECT *, CASE WHEN task_key % 10 = 0 THEN 'veto' ELSE verdict END AS v FROM judged) x) y UNPIVOT (violations FOR rule IN (parse_fail_cannot_veto, veto_needs_evidence))""")
def verdict_rules(t: Tables) -> DataFrame:
    forced = judging.judge_responses(t.responses()).withColumn("verdict", F.when(F.col("task_key") % 10 == 0, "veto").otherwise(F.col("verdict")))
    names = ("parse_fail_cannot_veto", "veto_needs_evidence")
    return quality.constraint_audit(forced, {n: quality.ROW_RULES["verdicts"][n] for n in names})


# ── queue ────────────────────────────────────────────────────────────────────


@query("eligible_texts", "SELECT doc_id, speak_date FROM announce WHERE speak_date <= DATE '2024-01-20'")
def eligible_texts(t: Tables) -> DataFrame:
    return tq.eligible_items(t.announce(), F.lit("2024-01-20").cast("date")).select("doc_id", "speak_date")


@query("eligibility_counts", """SELECT count(*) FILTER (speak_date <= DATE '2024-01-20') AS eligible, count(*) FILTER (speak_date > DATE '2024-01-15' AND speak_date <= DATE '2024-01-20') AS after_signal,
   count(*) FILTER (speak_date > DATE '2024-01-20') AS future FROM announce""")
def eligibility_counts(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    return tq.eligibility_counts(t.announce(), day("2024-01-15"), day("2024-01-20"))


def queue(t: Tables) -> DataFrame:
    return t.announce().select(F.col("doc_id").alias("id"), F.col("doc_id").alias("task_key"), F.col("speak_date").alias("d"))


def results(t: Tables) -> DataFrame:
    model = F.when(F.col("task_key") % 3 == 0, "model-a").otherwise("model-b")
    return t.verdicts().withColumn("model", model)


@query("enqueue_new", "SELECT doc_id AS task_key FROM announce WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT task_key FROM verdicts)")
def enqueue_new(t: Tables) -> DataFrame:
    items = queue(t).withColumn("same_run", F.col("id") % 4 != 0)
    return tq.enqueue_new(items, t.verdicts()).select("task_key")


@query("pending_tasks", "SELECT doc_id AS task_key, speak_date AS d FROM announce WHERE doc_id NOT IN (SELECT task_key FROM verdicts WHERE task_key % 3 = 0)")
def pending_tasks(t: Tables) -> DataFrame:
    return tq.pending(queue(t), results(t), "model-a").select("task_key", "d")


@query("pending_batch", "SELECT doc_id AS task_key, speak_date AS d FROM announce WHERE doc_id NOT IN (SELECT task_key FROM verdicts WHERE task_key % 3 <> 0) ORDER BY speak_date DESC, doc_id DESC LIMIT 25")
def pending_batch(t: Tables) -> DataFrame:
    return tq.pending(queue(t), results(t), "model-b", limit=25).select("task_key", "d")


@query("reused_verdicts", """SELECT a.doc_id AS task_key, v.verdict AS stored_verdict, v.verdict IS NULL AS to_judge FROM announce a LEFT JOIN (SELECT * FROM verdicts WHERE task_key % 3 = 0) v ON v.task_key = a.doc_id""")
def reused_verdicts(t: Tables) -> DataFrame:
    return tq.reuse_judged(queue(t), results(t), "model-a").select("task_key", "stored_verdict", "to_judge")


# ── exam ─────────────────────────────────────────────────────────────────────

LATEST = "latest AS (SELECT item_key, max(revision) AS revision, max_by(label, revision) AS label FROM gold GROUP BY item_key)"


@query("latest_labels", f"WITH {LATEST} SELECT * FROM latest")
def latest_labels(t: Tables) -> DataFrame:
    return tq.latest_revisions(t.gold())


def exam(t: Tables) -> DataFrame:
    return tq.latest_revisions(t.gold())


@query("baseline_score", f"""WITH {LATEST} SELECT count(*) AS n, count(*) FILTER (label <> 'veto') AS correct, round(count(*) FILTER (label <> 'veto') / count(*), 9) AS accuracy,
   count(*) FILTER (label = 'veto') AS false_negatives, 0 AS false_positives, count(*) FILTER (label = 'veto') AS veto_labels FROM latest""")
def baseline_score(t: Tables) -> DataFrame:
    return tq.baseline_score(exam(t)).withColumn("accuracy", F.round("accuracy", 9))


SCORE = """SELECT count(verdict) AS n, count(*) FILTER (verdict = label) AS correct, round(count(*) FILTER (verdict = label) / count(verdict), 9) AS accuracy,
   count(*) FILTER (verdict <> label AND label = 'veto') AS false_negatives, count(*) FILTER (verdict <> label AND label <> 'veto') AS false_positives, count(*) FILTER (label = 'veto') AS veto_labels,
   count(*) FILTER (NOT parse_ok) AS parse_failures, count(*) FILTER (parse_ok AND NOT evidence_verified) AS evidence_failures FROM latest LEFT JOIN verdicts ON task_key = item_key"""


@query("score_against_gold", f"WITH {LATEST} {SCORE}")
def score_against_gold(t: Tables) -> DataFrame:
    return tq.score_against_gold(exam(t), t.verdicts()).withColumn("accuracy", F.round("accuracy", 9))


@query("gold_set_hash", f"""WITH {LATEST} SELECT sha256(array_to_string(list_sort(list(concat(item_key, '=', label))), chr(10))) AS gold_set_hash FROM latest""")
def gold_set_hash(t: Tables) -> DataFrame:
    return tq.gold_set_hash(exam(t))


@query("gold_tree_hash", f"""WITH {LATEST}, l AS (SELECT concat(item_key, '=', label) AS line FROM latest), b AS (SELECT substring(sha256(line), 1, 3) AS bucket, sha256(array_to_string(list_sort(list(line)), chr(10))) AS digest FROM l GROUP BY 1)
   SELECT sha256(array_to_string(list_sort(list(concat(bucket, '=', digest))), chr(10))) AS gold_tree_hash FROM b""")
def gold_tree_hash(t: Tables) -> DataFrame:
    return tq.gold_tree_hash(exam(t))


@query("exam_flags", f"WITH {LATEST} SELECT count(DISTINCT label) < 2 AS degenerate, count(DISTINCT sha256(text)) < count(*) AS has_repeats FROM latest JOIN documents ON doc_id = item_key")
def exam_flags(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("item_key"), F.sha2("text", 256).alias("content_key"))
    return tq.exam_flags(exam(t).join(texts, "item_key"))


CHALLENGER = "CASE WHEN v.task_key % 4 = 0 THEN l.label ELSE v.verdict END"


EXAM_HASH = "(SELECT sha256(array_to_string(list_sort(list(concat(item_key, '=', label))), chr(10))) FROM {0})"
GATES = f"""WITH {LATEST}, first_exam AS (SELECT item_key, label FROM gold WHERE revision = 1),
   a AS (SELECT l.label, {CHALLENGER} AS better FROM latest l JOIN verdicts v ON v.task_key = l.item_key), o AS (SELECT l.label, v.verdict FROM {{champion}} l JOIN verdicts v ON v.task_key = l.item_key),
   s AS (SELECT count(*) AS n, count(*) FILTER (better = label) / count(*) AS ca, count(*) FILTER (better <> label AND label = 'veto') AS cf FROM a),
   c AS (SELECT count(*) FILTER (verdict = label) / count(*) AS oa, count(*) FILTER (verdict <> label AND label = 'veto') AS of FROM o),
   b AS (SELECT count(*) FILTER (label <> 'veto') / count(*) AS ba FROM latest)
   SELECT gate, passed FROM (SELECT n >= 30 AS sample_size, {EXAM_HASH.format('latest')} = {EXAM_HASH.format('{champion}')} AS same_exam, ca > ba AS beats_baseline, ca > oa AS beats_champion, cf <= of AS no_more_misses FROM s, b, c) x
   UNPIVOT (passed FOR gate IN (sample_size, same_exam, beats_baseline, beats_champion, no_more_misses))"""


def gates_against(t: Tables, champions_exam: DataFrame) -> DataFrame:
    """The challenger on the exam as it is now, the champion on the exam that it once took."""
    e = exam(t)
    better = t.verdicts().join(e.select(F.col("item_key").alias("task_key"), "label"), "task_key").withColumn(
        "verdict", F.when(F.col("task_key") % 4 == 0, F.col("label")).otherwise(F.col("verdict"))).drop("label")
    hashed = lambda df, taken: df.withColumn("gold_set_hash", tq.gold_set_hash(taken).scalar())
    return tq.promotion_gates(
        hashed(tq.score_against_gold(e, better), e), hashed(tq.score_against_gold(champions_exam, t.verdicts()), champions_exam), hashed(tq.baseline_score(e), e))


@query("promotion_gates", GATES.format(champion="latest"))
def promotion_gates(t: Tables) -> DataFrame:
    return gates_against(t, exam(t))


@query("promotion_gates_other_exam", GATES.format(champion="first_exam"))
def promotion_gates_other_exam(t: Tables) -> DataFrame:
    return gates_against(t, t.gold().filter("revision = 1"))


@query("errors_by_clause", f"""WITH {LATEST}, a AS (SELECT label, verdict, concat('clause', item_key % 9) AS clause FROM latest JOIN verdicts ON task_key = item_key)
   SELECT clause, count(*) AS n, count(*) FILTER (verdict <> label) AS wrong FROM a GROUP BY clause""")
def errors_by_clause(t: Tables) -> DataFrame:
    clauses = t.announce().select(F.col("doc_id").alias("item_key"), "clause")
    return tq.error_by_clause(tq.answers(exam(t), t.verdicts()).join(clauses, "item_key"))


@query("exam_answers", f"""WITH {LATEST} SELECT item_key, label, CASE WHEN verdict IS NULL THEN 'unanswered' WHEN verdict = label THEN 'correct' WHEN label = 'veto' THEN 'false_negative' ELSE 'false_positive' END AS outcome
   FROM latest LEFT JOIN verdicts ON task_key = item_key""")
def exam_answers(t: Tables) -> DataFrame:
    return tq.answers(exam(t), t.verdicts()).select("item_key", "label", "outcome")


@query("queue_status", f"""WITH {LATEST} SELECT (SELECT count(*) FROM announce) AS queued, (SELECT count(*) FROM announce WHERE doc_id IN (SELECT task_key FROM verdicts)) AS judged,
   (SELECT count(*) FROM announce WHERE doc_id NOT IN (SELECT task_key FROM verdicts)) AS unjudged, (SELECT count(*) FROM latest) AS gold_items, (SELECT count(*) FROM latest WHERE label = 'veto') AS gold_vetoes""")
def queue_status(t: Tables) -> DataFrame:
    return tq.queue_status(queue(t), t.verdicts(), t.gold())


def exam_candidates(t: Tables) -> tuple[DataFrame, DataFrame]:
    keyed = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("item_key"), F.sha2("text", 256).alias("content_key"))
    gold = t.gold().join(keyed.select("item_key", "content_key"), "item_key")
    return keyed, gold


@query("exam_candidates", """WITH g AS (SELECT DISTINCT doc_id, sha256(text) AS ck FROM documents WHERE doc_id IN (SELECT item_key FROM gold)),
   n AS (SELECT doc_id, sha256(text) AS ck FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) AND sha256(text) NOT IN (SELECT ck FROM g))
   SELECT min(doc_id) AS item_key FROM n GROUP BY ck""")
def exam_candidate_items(t: Tables) -> DataFrame:
    keyed, gold = exam_candidates(t)
    return tq.dedupe_repeats(keyed, gold).select("item_key")


@query("label_problems", """SELECT item_key, rule FROM (SELECT doc_id AS item_key, unnest(list_filter([CASE WHEN lab NOT IN ('veto', 'no_veto') THEN 'label' END, CASE WHEN length(replace(why, ' ', '')) < 4 THEN 'reason' END,
   CASE WHEN doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) THEN 'unknown_item' END], lambda r: r IS NOT NULL)) AS rule FROM (
   SELECT doc_id, CASE WHEN toxic = 1 THEN 'maybe' ELSE 'veto' END AS lab, CASE WHEN quality = 0 THEN 'a b c' ELSE 'long enough' END AS why FROM labels) x) y""")
def label_problems(t: Tables) -> DataFrame:
    labels = t.labels.select(
        F.col("doc_id").alias("item_key"), F.when(F.col("toxic") == 1, "maybe").otherwise("veto").alias("label"),
        F.when(F.col("quality") == 0, "a b c").otherwise("long enough").alias("label_reason"))
    return tq.validate_labels(labels, t.documents.filter("n_chars > 500").select(F.col("doc_id").alias("item_key")))


@query("imported_labels", """WITH g AS (SELECT item_key, revision, sha256(text) AS ck FROM gold JOIN documents ON doc_id = item_key),
   own AS (SELECT ck, min(item_key) AS a, max(item_key) AS b FROM g GROUP BY ck), rev AS (SELECT item_key, max(revision) AS r FROM g GROUP BY item_key)
   SELECT d.doc_id AS item_key, coalesce(r, 0) + 1 AS revision, own.a IS NOT NULL AND (own.a <> d.doc_id OR own.b <> d.doc_id) AS rejected
   FROM documents d LEFT JOIN own ON own.ck = sha256(d.text) LEFT JOIN rev ON rev.item_key = d.doc_id""")
def imported_labels(t: Tables) -> DataFrame:
    keyed, gold = exam_candidates(t)
    ok, bad = tq.import_labels(keyed.drop("id"), gold)
    return ok.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True))).select(
        "item_key", F.col("revision").cast("bigint").alias("revision"), "rejected")


@query("current_champion", """SELECT source AS family, max_by(doc_id, speak * 100000000 + doc_id) AS id FROM (SELECT *, doc_id % 30 AS speak FROM documents WHERE n_chars > 400) x GROUP BY source""")
def current_champion(t: Tables) -> DataFrame:
    reg = t.documents.select(
        F.col("source").alias("family"), F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 400, "champion").otherwise("challenger").alias("role"),
        (F.col("doc_id") % 30).alias("registered_at"))
    return tq.current_champion(reg).select("family", "id")


# ── registry ─────────────────────────────────────────────────────────────────


def local_definitions(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    m = F.create_map(F.lit("size"), size.cast("string"), F.lit("brand"), F.col("p_brand"))
    return t.part.select(
        F.concat(F.lit("factor_"), key.cast("string")).alias("factor_key"), key.alias("n"), hashing.canonical_hash(m).alias("definition_hash"),
        F.when(size % 2 == 0, "higher_is_better").otherwise("lower_is_better").alias("direction"), (3.0 + size % 3).alias("t_threshold"))


def registered_definitions(t: Tables) -> DataFrame:
    n = F.col("n")
    return local_definitions(t).filter("n % 7 <> 0").withColumn("definition_hash", F.when(n % 11 == 0, F.sha2(F.col("definition_hash"), 256)).otherwise(F.col("definition_hash"))).withColumn(
        "direction", F.when(n % 13 == 0, "higher_is_better").otherwise(F.col("direction"))).withColumn("t_threshold", F.when(n % 17 == 0, 9.0).otherwise(F.col("t_threshold")))


def status_events(t: Tables) -> DataFrame:
    """Status log from orders: a few keys are archived, some get later events."""
    n = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("factor_"), (n % 500).cast("string")).alias("factor_key"), n.alias("seq"),
        F.when(n % 97 == 0, "archived").when(n % 2 == 0, "tested").otherwise("reviewed").alias("status"))


LOCAL = """loc AS (SELECT concat('factor_', p_partkey) AS factor_key, p_partkey AS n, sha256(concat('{"brand":"', p_brand, '","size":"', p_size, '"}')) AS h,
     CASE WHEN p_size % 2 = 0 THEN 'higher_is_better' ELSE 'lower_is_better' END AS dir, 3.0 + p_size % 3 AS tt FROM part),
   reg AS (SELECT factor_key, n, CASE WHEN n % 11 = 0 THEN sha256(h) ELSE h END AS h, CASE WHEN n % 13 = 0 THEN 'higher_is_better' ELSE dir END AS dir, CASE WHEN n % 17 = 0 THEN 9.0 ELSE tt END AS tt FROM loc WHERE n % 7 <> 0),
   ev AS (SELECT concat('factor_', o_orderkey % 500) AS factor_key, o_orderkey AS seq, CASE WHEN o_orderkey % 97 = 0 THEN 'archived' WHEN o_orderkey % 2 = 0 THEN 'tested' ELSE 'reviewed' END AS status FROM orders),
   arc AS (SELECT DISTINCT factor_key FROM ev WHERE status = 'archived')"""


@query("definition_lock", f"""WITH {LOCAL} SELECT factor_key, problem FROM (SELECT l.factor_key, unnest(list_filter(CASE WHEN r.factor_key IS NULL THEN ['unregistered'] ELSE [
   CASE WHEN l.h <> r.h THEN 'definition_hash' END, CASE WHEN l.dir <> r.dir THEN 'direction' END, CASE WHEN l.tt <> r.tt THEN 't_threshold' END,
   CASE WHEN l.factor_key IN (SELECT factor_key FROM arc) THEN 'archived' END] END, lambda p: p IS NOT NULL)) AS problem FROM loc l LEFT JOIN reg r ON r.factor_key = l.factor_key) x""")
def definition_lock(t: Tables) -> DataFrame:
    return registry.definition_lock(local_definitions(t), registered_definitions(t), registry.archived_keys(status_events(t)))


@query("registration_violations", """SELECT factor_key, rule FROM (SELECT factor_key, unnest(list_filter([CASE WHEN NOT regexp_matches(factor_key, '^[a-z][a-z0-9_]{2,63}$') THEN 'factor_key' END,
   CASE WHEN length(trim(rationale)) < 50 THEN 'rationale' END, CASE WHEN ps IS NULL THEN 'period_start' END, CASE WHEN ps >= DATE '2024-02-15' THEN 'period_order' END,
   CASE WHEN tt < 3 THEN 'threshold' END, CASE WHEN u NOT IN ('TWSE', 'TPEx', 'BOTH') THEN 'universe' END], lambda r: r IS NOT NULL)) AS rule FROM (
   SELECT CASE WHEN doc_id % 9 = 0 THEN concat('F', doc_id) ELSE concat('f_', doc_id) END AS factor_key, text AS rationale,
     CASE WHEN doc_id % 10 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INT) * INTERVAL 1 DAY AS DATE) END AS ps, 2.5 + doc_id % 3 AS tt, CASE WHEN lang = 'en' THEN 'BOTH' ELSE lang END AS u FROM documents) x) y""")
def registration_violations(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    regs = t.documents.select(
        F.when(i % 9 == 0, F.concat(F.lit("F"), i.cast("string"))).otherwise(F.concat(F.lit("f_"), i.cast("string"))).alias("factor_key"),
        F.lit("name").alias("display_name"), F.col("text").alias("rationale"), F.lit("higher_is_better").alias("direction"),
        F.when(i % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int"))).alias("period_start"), F.lit("2024-02-15").cast("date").alias("period_end"),
        (2.5 + i % 3).alias("t_threshold"), F.when(F.col("lang") == "en", "BOTH").otherwise(F.col("lang")).alias("universe"), F.lit("me").alias("registered_by"),
        F.create_map(F.lit("a"), F.lit("b")).alias("definition"))
    return registry.validate_registrations(regs)


def test_results(t: Tables) -> DataFrame:
    base = t.orders.select(
        F.col("o_orderkey").alias("result_id"), F.concat(F.lit("factor_"), (F.col("o_orderkey") % 2100).cast("string")).alias("factor_key"),
        (F.col("o_totalprice") / 50000.0).alias("t_statistic"), F.when(F.col("o_orderstatus") == "F", "lower_is_better").otherwise("higher_is_better").alias("observed_direction"),
        (F.col("o_custkey") % 100).alias("sample_size"), (F.col("o_orderkey") % 3 == 0).alias("claimed_passed"),
        F.when(F.col("o_orderpriority") == "5-LOW", "kfold").otherwise("walk_forward").alias("method"))
    known = local_definitions(t).select("factor_key", "definition_hash")
    return base.join(known, "factor_key", "left").withColumn("definition_hash", F.coalesce("definition_hash", F.lit("none")))


RESULTS = """res AS (SELECT o_orderkey AS result_id, concat('factor_', o_orderkey % 2100) AS factor_key, o_totalprice / 50000.0::DOUBLE AS ts, CASE WHEN o_orderstatus = 'F' THEN 'lower_is_better' ELSE 'higher_is_better' END AS od,
     o_custkey % 100 AS n, o_orderkey % 3 = 0 AS claim, CASE WHEN o_orderpriority = '5-LOW' THEN 'kfold' ELSE 'walk_forward' END AS method, coalesce(l.h, 'none') AS h
     FROM orders LEFT JOIN loc l ON l.factor_key = concat('factor_', o_orderkey % 2100))"""


@query("test_result_violations", f"""WITH {LOCAL}, {RESULTS} SELECT result_id, rule FROM (SELECT result_id, unnest(list_filter([CASE WHEN h = 'none' THEN 'definition_hash' END, CASE WHEN n < 30 THEN 'sample_size' END,
   CASE WHEN method = 'kfold' THEN 'method' END], lambda r: r IS NOT NULL)) AS rule FROM res) x""")
def test_result_violations(t: Tables) -> DataFrame:
    return registry.validate_test_results(test_results(t))


@query("recomputed_passes", f"""WITH {LOCAL}, {RESULTS}, j AS (SELECT s.*, r.h AS rh, coalesce(s.ts >= r.tt AND s.od = r.dir, false) AS passed, s.factor_key IN (SELECT factor_key FROM arc) AS archived FROM res s LEFT JOIN reg r ON r.factor_key = s.factor_key)
   SELECT result_id, factor_key, passed, CASE WHEN rh IS NULL THEN 'unregistered' WHEN rh <> h THEN 'hash_mismatch' WHEN archived THEN 'archived' WHEN passed <> claim THEN 'claim_differs' ELSE 'ok' END AS state FROM j""")
def recomputed_passes(t: Tables) -> DataFrame:
    return registry.recompute_passed(test_results(t), registered_definitions(t), registry.archived_keys(status_events(t)))


@query("status_after_archive", f"""WITH {LOCAL}, f AS (SELECT factor_key, min(seq) AS s0 FROM ev WHERE status = 'archived' GROUP BY factor_key) SELECT factor_key, seq, status FROM ev JOIN f USING (factor_key) WHERE seq > s0""")
def status_after_archive(t: Tables) -> DataFrame:
    return registry.status_after_archive(status_events(t))


@query("seeded_status", f"WITH {LOCAL} SELECT factor_key, status, seq FROM ev UNION ALL SELECT factor_key, 'registered', 0 FROM reg")
def seeded_status(t: Tables) -> DataFrame:
    return registry.with_seed_status(registered_definitions(t), status_events(t))


@query("trial_summary", f"""WITH {LOCAL}, {RESULTS} SELECT (SELECT count(*) FROM reg) AS registrations, (SELECT count(*) FROM reg WHERE n % 10 = 3) AS probes, (SELECT count(*) FROM reg WHERE n % 10 <> 3) AS real_registrations,
   (SELECT count(*) FROM res) AS tests, (SELECT count(*) FROM res WHERE claim) AS passed, (SELECT count(*) FROM arc) AS archived""")
def trial_summary(t: Tables) -> DataFrame:
    r = test_results(t).withColumn("passed", F.col("claimed_passed"))
    return registry.trial_summary(registered_definitions(t), r, status_events(t), F.col("n") % 10 == 3)


@query("archived_keys", f"WITH {LOCAL} SELECT factor_key FROM arc")
def archived_keys(t: Tables) -> DataFrame:
    return registry.archived_keys(status_events(t))


@query("pending_registrations", f"WITH {LOCAL} SELECT factor_key, h AS definition_hash FROM loc WHERE factor_key NOT IN (SELECT factor_key FROM reg)")
def pending_registrations(t: Tables) -> DataFrame:
    return registry.pending_registrations(local_definitions(t), registered_definitions(t))


@query("registration_read_back", f"WITH {LOCAL} SELECT factor_key FROM loc l LEFT JOIN reg r USING (factor_key) WHERE l.h IS DISTINCT FROM r.h")
def registration_read_back(t: Tables) -> DataFrame:
    return registry.read_back(local_definitions(t), registered_definitions(t))


@query("config_lock", f"""WITH {LOCAL} SELECT version, problem FROM (SELECT l.factor_key AS version, unnest(list_filter([CASE WHEN l.n % 19 = 0 THEN 'invalid' END, CASE WHEN r.h IS NULL THEN 'unregistered' END,
   CASE WHEN r.h <> l.h THEN 'hash' END], lambda p: p IS NOT NULL)) AS problem FROM loc l LEFT JOIN reg r USING (factor_key)) x""")
def config_lock(t: Tables) -> DataFrame:
    shape = lambda df: df.select(F.col("factor_key").alias("version"), F.col("definition_hash").alias("config_hash"), "n")
    local = shape(local_definitions(t))
    return registry.config_lock(local.drop("n"), shape(registered_definitions(t)).drop("n"), local.filter("n % 19 = 0"))


# ── records and reports ──────────────────────────────────────────────────────


@query("message_kinds", "SELECT message_id, kind FROM msg UNION ALL SELECT message_id, kind FROM msg WHERE message_id % 50 = 0")
def message_kinds(t: Tables) -> DataFrame:
    return judging.parse_commands(t.messages()).select("message_id", "kind")


@query("message_errors", """SELECT error, count(*) AS n FROM (SELECT CASE WHEN message_id % 47 = 0 THEN 'unknown_command' WHEN message_id % 53 = 0 THEN 'missing_action' WHEN message_id % 59 = 0 THEN 'unknown_action'
   WHEN event_type IN ('purchase', 'error') THEN CASE WHEN k % 9 = 0 THEN 'bad_shares' ELSE 'missing_shares_or_price' END WHEN event_type = 'click' THEN 'bad_code' ELSE 'empty_note' END AS error
   FROM (SELECT * FROM msg UNION ALL SELECT * FROM msg WHERE message_id % 50 = 0) m WHERE kind = 'error') x GROUP BY error""")
def message_errors(t: Tables) -> DataFrame:
    return judging.parse_commands(t.messages()).filter("kind = 'error'").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("message_records", "SELECT message_id, d, action, code, shares, round(price, 4) AS price, note FROM records")
def message_records(t: Tables) -> DataFrame:
    r = reports.distinct_messages(judging.record_rows(t.messages()))
    return r.select("message_id", "d", "action", "code", "shares", F.round("price", 4).alias("price"), "note")


@query("effective_records", "SELECT d, code, max_by(action, sent_at) AS action, max(message_id) AS message_id FROM records GROUP BY d, code")
def effective_records(t: Tables) -> DataFrame:
    return reports.effective_records(judging.record_rows(t.messages())).select("d", "code", "action", "message_id")


def pick_log(t: Tables) -> DataFrame:
    p = picks(t)
    first = p.withColumn("revision", F.lit(1))
    again = p.filter(F.dayofmonth("d") % 3 == 0).withColumn("revision", F.lit(2))
    return first.unionByName(again)


LOG = "log AS (SELECT *, 1 AS revision FROM picks UNION ALL SELECT *, 2 FROM picks WHERE day(d) % 3 = 0)"


@query("latest_list", f"WITH {LOG} SELECT d, revision, rank, code FROM log WHERE d = (SELECT max(d) FROM log) AND revision = (SELECT max(revision) FROM log WHERE d = (SELECT max(d) FROM log))")
def latest_list(t: Tables) -> DataFrame:
    return reports.latest_list(pick_log(t)).select("d", F.col("revision").cast("bigint").alias("revision"), "rank", "code")


@query("distinct_signals", "SELECT count(DISTINCT (d, code)) AS signals FROM picks WHERE list_kind = 'trade_signal'")
def distinct_signals(t: Tables) -> DataFrame:
    return reports.distinct_signals(pick_log(t))


@query("mean_outcomes", "SELECT horizon, list_kind, count(adj_pct) AS n, round(avg(adj_pct), 6) AS mean_return_pct FROM outcomes GROUP BY horizon, list_kind")
def mean_outcomes(t: Tables) -> DataFrame:
    o = scored_picks(t).join(picks(t).select("pick_id", "list_kind"), "pick_id")
    return reports.mean_outcome(o).withColumn("mean_return_pct", F.round("mean_return_pct", 6))


def vetoes(t: Tables) -> DataFrame:
    return t.once("veto_events", ranked_hits)


@query("todays_vetoes", f"WITH {HITS} SELECT h.d, h.code, h.rule_id, r.rank FROM hits h LEFT JOIN ranked r ON r.d = h.d AND r.code = h.code WHERE h.d = (SELECT max(d) FROM hits)")
def todays_vetoes(t: Tables) -> DataFrame:
    return reports.todays_vetoes(vetoes(t)).select("d", "code", "rule_id", "rank")


@query("daily_funnel", f"""WITH {HITS}, act AS (SELECT c.d, count(DISTINCT a.factor) AS n FROM cal c LEFT JOIN active a ON a.d = c.d GROUP BY c.d)
   SELECT r.d, count(*) AS ranked, (SELECT count(DISTINCT code) FROM hits h WHERE h.d = r.d) AS vetoed, (SELECT count(*) FROM picks p WHERE p.d = r.d AND list_kind = 'trade_signal') AS approved,
   5 - max(act.n) AS inactive_factors FROM ranked r JOIN act ON act.d = r.d GROUP BY r.d""")
def daily_funnel(t: Tables) -> DataFrame:
    return reports.funnel(t.once("ranked", ranked), vetoes(t), picks(t).filter("list_kind = 'trade_signal'"), factor_activity(t))


@query("daily_report", f"""WITH {HITS}, lab AS (SELECT DISTINCT h.d, h.code, display_name FROM hits h JOIN {LABELS} ON dim.rule_id = h.rule_id),
   blocked AS (SELECT d, code, string_agg(display_name, '、' ORDER BY display_name) AS blocked_by FROM lab GROUP BY d, code),
   texts AS (SELECT d, code, string_agg(concat(CASE factor WHEN 'rev_yoy_momentum_v1' THEN '月營收年增' WHEN 'trust_net_buy_ratio_v1' THEN '投信買超' WHEN 'margin_balance_change_v1' THEN '融資餘額' WHEN 'short_term_reversal_5d_v1' THEN '五日漲跌' ELSE '外資買超' END, ' ', {FACTOR_TEXT}), '；'
     ORDER BY concat(CASE factor WHEN 'rev_yoy_momentum_v1' THEN '月營收年增' WHEN 'trust_net_buy_ratio_v1' THEN '投信買超' WHEN 'margin_balance_change_v1' THEN '融資餘額' WHEN 'short_term_reversal_5d_v1' THEN '五日漲跌' ELSE '外資買超' END, ' ', {FACTOR_TEXT})) AS factors
     FROM (SELECT d, code, factor, value AS raw FROM scored) x GROUP BY d, code)
   SELECT p.d, p.code, p.rank, CASE WHEN list_kind = 'trade_signal' THEN 0 ELSE 1 END AS section, {sql_fixed('b.close', 2)} AS price_text, {sql_signed_pct('(CASE WHEN b.note IS NULL THEN 100 * (b.close - b.open) / nullif(b.close - (b.close - b.open), 0) END)', 2)} AS move_text,
   bl.blocked_by, texts.factors
   FROM picks p JOIN bars b ON b.code = p.code AND b.d = p.d LEFT JOIN blocked bl ON bl.d = p.d AND bl.code = p.code LEFT JOIN texts ON texts.d = p.d AND texts.code = p.code""")
def daily_report(t: Tables) -> DataFrame:
    p = picks(t)
    quotes = t.bars().withColumn("change", F.col("close") - F.col("open"))
    blocked = veto.top_k_vetoed(p.select("d", "code"), hits(t), veto.rule_dimension(t.spark))
    rows = reports.daily_report_rows(
        p.filter("list_kind = 'trade_signal'"), p.filter("list_kind = 'watchlist'"), quotes, ranking.explain_factors(coarse(detail(t))), blocked)
    return rows.select("d", "code", "rank", F.col("section").cast("bigint").alias("section"), "price_text", "move_text", "blocked_by", "factors")


@query("veto_chain", f"""WITH {HITS}, {TASKS}, ruled AS (SELECT d, code FROM ranked WHERE (d, code) NOT IN (SELECT d, code FROM hits)),
   texted AS (SELECT DISTINCT r.d, r.code FROM ruled r JOIN tasks t ON t.d = r.d AND t.code = r.code JOIN verdicts v ON v.task_key = t.task_key AND v.verdict = 'veto')
   SELECT r.d, r.code, r.rank, CASE WHEN h.code IS NOT NULL THEN 'rules' WHEN x.code IS NOT NULL THEN 'text' END AS stopped_by, coalesce(h.n, 0) AS rule_hits
   FROM ranked r LEFT JOIN (SELECT d, code, count(*) AS n FROM hits GROUP BY d, code) h ON h.d = r.d AND h.code = r.code LEFT JOIN texted x ON x.d = r.d AND x.code = r.code""")
def veto_chain(t: Tables) -> DataFrame:
    r = t.once("ranked", ranked)
    passed, found = chain.veto_chain(r.select("d", "code", "rank", "composite"), rule_layers(t, r.select("d", "code")), text_tasks(t), t.verdicts())
    by_code = found.groupBy("d", "code").agg(F.min("layer").alias("stopped_by"), F.count_if(F.col("layer") == chain.RULES).alias("rule_hits"))
    stopped = r.join(by_code, ["d", "code"], "left").select("d", "code", "rank", "stopped_by", F.coalesce("rule_hits", F.lit(0)).alias("rule_hits"))
    kept = passed.select("d", "code", F.lit(True).alias("_kept"))
    # a code is either stopped or among the passed, never both or neither
    wrong = F.raise_error(F.lit("a code is both or neither")).cast("string")
    both = stopped.join(kept, ["d", "code"], "left")
    return both.withColumn("stopped_by", F.when(F.col("stopped_by").isNull() == F.coalesce("_kept", F.lit(False)), F.col("stopped_by")).otherwise(wrong)).drop("_kept")


# The sizing and greedy SQL of the risk queries, over what the vetoes let pass and for an equity of a million.
_SIZED = greedy(20, 10, 60).replace("FROM priced", "FROM ch_priced").replace("FROM risk_state", "FROM ch_state").replace("200.0", "20000.0").replace("10000.0", "1000000.0").replace("1000000.00", "1000000.0")
CHAIN = f"""WITH RECURSIVE {HITS}, {TASKS}, {EWM.strip().removeprefix('WITH')},
   passed AS (SELECT r.d, r.code, r.rank, r.composite FROM ranked r WHERE (r.d, r.code) NOT IN (SELECT d, code FROM hits)
     AND NOT EXISTS (SELECT 1 FROM tasks t JOIN verdicts v ON v.task_key = t.task_key AND v.verdict = 'veto' WHERE t.d = r.d AND t.code = r.code)),
   ch_state AS (SELECT d, day(d) % 4 AS entries, 0 AS open_positions, 0.0::DOUBLE AS exposure_pct, 0.0::DOUBLE AS drawdown_pct FROM cal),
   ch_candidates AS (SELECT p.d, p.code, p.rank AS full_rank, p.composite, row_number() OVER (PARTITION BY p.d ORDER BY p.rank) AS rank, b.close AS entry, CASE WHEN v.observations >= 10 AND v.ok = 1 THEN v.sg END AS sigma
     FROM passed p LEFT JOIN bars b ON b.d = p.d AND b.code = p.code LEFT JOIN v ON v.d = p.d AND v.code = p.code),
   ch_barriers AS (SELECT *, coalesce(entry > 0 AND sigma > 0 AND dist < 1, false) AS feasible, CASE WHEN entry > 0 AND sigma > 0 AND dist < 1 THEN entry * dist END AS risk FROM (
     SELECT *, 0.1::DOUBLE * sigma * sqrt(10) AS dist FROM ch_candidates) x),
   ch_priced AS (SELECT *, CAST(round(entry * 100) AS BIGINT) AS e, CAST(round((entry - risk) * 100) AS BIGINT) AS s, CAST(round((entry + 2.0::DOUBLE * risk) * 100) AS BIGINT) AS g, CAST(floor(20000.0::DOUBLE / risk) AS BIGINT) AS upper_n FROM ch_barriers),
   {_SIZED}
   SELECT r.d, r.code, r.rank, 'watchlist' AS list_kind, r.composite, CAST(NULL AS DOUBLE) AS stop_price, CAST(NULL AS BIGINT) AS shares, b.close AS price_at_push FROM ranked r LEFT JOIN bars b ON b.d = r.d AND b.code = r.code WHERE r.rank <= 5
   UNION ALL SELECT o.d, o.code, o.full_rank, 'trade_signal', o.composite, round(o.entry - o.risk, 6), o.shares, o.entry FROM greedy x JOIN own o ON o.d = x.d AND o.rank = x.rank WHERE x.rank > 0 AND x.reason IS NULL"""


@query("daily_chain", CHAIN)
def daily_chain(t: Tables) -> DataFrame:
    """Watchlist and signals of every day, as the whole chain leaves them."""
    r = t.once("ranked", ranked)
    estimates = risk.estimate_vol(risk.ewm_std_daily(risk.placed_returns(t.bars().select("code", "d", "close").join(t.cal(), "d")), 100), 10)
    day = F.dayofmonth("d")
    state = t.cal().select("d", (day % 4).cast("int").alias("entries"), F.lit(0).alias("open_positions"), F.lit(0.0).alias("exposure_pct"), F.lit(0.0).alias("drawdown_pct"))
    made = chain.daily_chain(r, t.closes(), rule_layers(t, r.select("d", "code")), text_tasks(t), t.verdicts(), estimates, state, t.roster(),
                             risk.RiskConfig(equity=1_000_000.0, stop_sigma_multiple=0.1, max_concurrent=10, monthly_entry_cap=20))
    return made.picks.select("d", "code", "rank", "list_kind", F.round("composite", 9).alias("composite"), F.round("stop_price", 6).alias("stop_price"), "shares", "price_at_push")


@query("export_summary", """SELECT 'bars' AS sheet, count(*) AS rows FROM bars UNION ALL SELECT 'ledger', count(*) FROM ledger UNION ALL SELECT 'notices', count(*) FROM notices
   UNION ALL SELECT 'gold', count(*) FROM gold UNION ALL SELECT 'verdicts', count(*) FROM verdicts UNION ALL SELECT 'trades', count(*) FROM trades""")
def export_summary(t: Tables) -> DataFrame:
    return reports.export_summary({"bars": t.bars(), "ledger": t.ledger(), "notices": t.notices(), "gold": t.gold(), "verdicts": t.verdicts(), "trades": t.trades()})


def exported(t: Tables) -> dict[str, DataFrame]:
    """The six sheets and their summary, written as one export and read back."""
    done = scored_picks(t)
    sheets = {
        "picks": (picks(t).select("pick_id", "d", "list_kind", "rank", "code"), [F.col("d").desc(), F.col("list_kind"), F.col("rank")]),
        "vetoes": (hits(t).select("d", "code", "rule_id", "evidence"), [F.col("d").desc(), F.col("code"), F.col("rule_id"), F.col("evidence")]),
        "records": (t.ticks().filter("event_type = 'purchase'").select("event_id", "d", "code", "value"), [F.col("d").desc(), F.col("event_id")]),
        "outcomes": (done.select("pick_id", "horizon", "status", F.round("adjusted_return_pct", 6).alias("adjusted_return_pct")), [F.col("pick_id").desc(), F.col("horizon")]),
        "labels": (t.gold(), [F.col("item_key"), F.col("revision")]),
        "texts": (t.documents.select("doc_id", "text"), [F.col("doc_id")]),
    }
    folder = shared_table_path(t.spark, "export")
    reports.export_sheets(sheets, folder, averages=reports.horizon_averages(done))
    return reports.read_export(t.spark, folder)


# how each sheet is ordered, and what is shown of its rows
SHEETS = {
    "picks": ("d DESC, list_kind, rank", "concat_ws('|', pick_id, d, list_kind, rank, code)", "picks"),
    "vetoes": ("d DESC, code, rule_id, evidence", "concat_ws('|', d, code, rule_id, evidence)", "hits"),
    "records": ("d DESC, event_id", "concat_ws('|', event_id, d, code)", "(SELECT * FROM ticks WHERE event_type = 'purchase') z"),
    "outcomes": ("pick_id DESC, horizon", "concat_ws('|', pick_id, horizon, status)", "outcomes"),
    "labels": ("item_key, revision", "concat_ws('|', item_key, revision, label)", "gold"),
    "texts": ("doc_id", "concat_ws('|', doc_id, sha256(text))", "documents"),
}


@query("export_sheets", f"WITH {HITS} " + " UNION ALL ".join(f"SELECT '{n}' AS sheet, row_number() OVER (ORDER BY {order}) AS row_no, {shown} AS shown FROM {table}" for n, (order, shown, table) in SHEETS.items()))
def export_sheets(t: Tables) -> DataFrame:
    sheets = exported(t)
    rows = None
    for n, (_, shown, _) in SHEETS.items():
        part = sheets[n].select(F.lit(n).alias("sheet"), "row_no", F.expr(shown.replace("sha256(text)", "sha2(text, 256)")).alias("shown"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("export_averages", f"WITH {HITS} SELECT concat('mean T+', horizon) AS label, round(avg(adj_pct), 6) AS value FROM outcomes WHERE adj_pct IS NOT NULL GROUP BY horizon "
       + " ".join(f"UNION ALL SELECT 'rows {n}', count(*) FROM {table}" for n, (_, _, table) in SHEETS.items()))
def export_averages(t: Tables) -> DataFrame:
    return exported(t)["summary"].select("label", F.round("value", 6).alias("value"))


@query("pick_rows", """SELECT r.d, r.code, r.rank, 'watchlist' AS list_kind, CAST(NULL AS DOUBLE) AS stop_price, b.close AS price_at_push FROM ranked r JOIN bars b ON b.code = r.code AND b.d = r.d WHERE r.rank <= 5
   UNION ALL SELECT r.d, r.code, r.rank, 'trade_signal', round(0.9 * b.close, 6), b.close FROM ranked r JOIN bars b ON b.code = r.code AND b.d = r.d WHERE r.rank <= 2""")
def pick_rows(t: Tables) -> DataFrame:
    r = t.once("ranked", ranked)
    closes = t.closes()
    entry = F.col("close")
    signals = r.filter("rank <= 2").join(closes, ["d", "code"]).select(
        "d", "code", "rank", "composite", entry.alias("entry_price"), F.round(0.9 * entry, 6).alias("stop_price"), (1.2 * entry).alias("target_price"),
        F.lit(10).alias("time_exit_days"), F.lit(100).alias("shares"), F.lit(0.02).alias("sigma_daily"))
    return ranking.build_pick_rows(r, closes, signals).select("d", "code", "rank", "list_kind", "stop_price", "price_at_push")


@query("constraint_audit_picks", """SELECT rule, rows, violations FROM (SELECT count(*) AS rows, count(*) FILTER (rank < 1) AS rank, count(*) FILTER (NOT (score >= 0 AND score <= 1)) AS score_range,
   count(*) FILTER (entry <= 0) AS price_positive, count(*) FILTER (NOT coalesce(stop IS NULL OR (stop > 0 AND stop < entry AND target > entry), false)) AS barrier_order FROM picks) x UNPIVOT (violations FOR rule IN (rank, score_range, price_positive, barrier_order))
   UNION ALL SELECT 'unique_key', CAST(sum(n) AS BIGINT), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM picks GROUP BY d, rank % 2) y""")
def constraint_audit_picks(t: Tables) -> DataFrame:
    rows = picks(t).select(
        "d", (F.col("rank") % 2).alias("half"), "rank", F.col("score").alias("composite_score"), F.col("entry").alias("price_at_push"), F.when(F.col("stop").isNotNull(), F.col("entry")).alias("entry_price"),
        F.col("stop").alias("stop_price"), F.col("target").alias("take_profit_price"))
    rules = {n: quality.ROW_RULES["picks"][n] for n in ("rank", "score_range", "price_positive", "barrier_order")}
    return quality.constraint_audit(rows, rules, ["d", "half"])


def audited_tables(t: Tables) -> dict[str, DataFrame]:
    """Stored tables with some rows spoiled, so that rules have something to find."""
    i, key = F.col("message_id"), F.col("item_key")
    records = judging.record_rows(t.messages()).withColumns({
        "shares": F.when(i % 13 != 0, F.col("shares")), "raw_text": F.when(i % 17 == 0, "  ").otherwise(F.col("raw_text"))})
    p = picks(t).select("pick_id", "list_kind", F.col("entry").alias("entry_price"))
    done = scored_picks(t).filter("status = 'computed'").join(p, "pick_id").withColumnRenamed("d", "data_as_of")
    done = done.withColumn("horizon", F.when(F.col("pick_id") % 11 == 0, 7).otherwise(F.col("horizon")))
    events = vetoes(t).select(
        F.col("d").alias("run_id"), "code", "rule_id", F.col("rank").alias("rank_at_signal"), F.col("composite").alias("composite_score"),
        F.when(F.col("code") % 9 == 0, " ").otherwise(F.col("evidence")).alias("evidence"))
    bench = t.closes().select("code", "d", (F.col("close") - 20).alias("close"), (F.col("close") - 5).alias("total_return_index"), (F.col("vol") - 1).alias("cash_dividend"), F.lit(0.0).alias("stock_dividend_ratio"))
    gold = t.gold().withColumns({"label_reason": F.when(key % 4 == 0, "ok").otherwise("because"), "labeled_by": F.when(key % 6 == 0, "").otherwise("someone")})
    queue = t.announce().select(F.col("doc_id").alias("task_key"), "speak_date", F.lit("2024-01-15 10:00:00").cast("timestamp").alias("enqueued_at"))
    return {"records": records, "outcomes": done, "vetoes": events, "benchmark": bench, "gold_set": gold, "queue": queue}


AUDITS = {
    "records": ("(SELECT * FROM records UNION ALL SELECT * FROM records WHERE message_id % 50 = 0) z", {
        "source": "0", "action": "0", "trade_fields": "count(*) FILTER (action IN ('buy', 'sell') AND message_id % 13 = 0)", "target": "count(*) FILTER (action IN ('watch', 'skip') AND code IS NULL)",
        "raw_text_not_blank": "count(*) FILTER (message_id % 17 = 0)"}, "message_id"),
    "outcomes": ("(SELECT *, CASE WHEN pick_id % 11 = 0 THEN 7 ELSE horizon END AS h FROM outcomes WHERE status = 'computed') z", {
        "horizon": "count(*) FILTER (h = 7)", "prices_positive": "count(*) FILTER (NOT (entry > 0 AND xclose > 0))", "exit_after_signal": "count(*) FILTER (exit_date <= d)",
        "trading_days": "count(*) FILTER (h <> horizon)", "share_factor": "count(*) FILTER (f < 1)", "barrier": "0", "barrier_by_kind": "count(*) FILTER ((list_kind = 'trade_signal') <> (stop IS NOT NULL))"}, "pick_id, h"),
    "vetoes": ("(SELECT h.*, r.rank, r.composite FROM hits h LEFT JOIN ranked r ON r.d = h.d AND r.code = h.code) z", {
        "rule_id": "0", "rank": "count(*) FILTER (rank < 1)", "score_range": "count(*) FILTER (NOT composite BETWEEN 0 AND 1)", "evidence_not_blank": "count(*) FILTER (code % 9 = 0)"}, "d, code, rule_id"),
    "benchmark": ("bars", {"close_positive": "count(*) FILTER (close <= 20)", "index_positive": "count(*) FILTER (close <= 5)", "dividend": "count(*) FILTER (vol < 1)"}, "code, d"),
    "gold_set": ("gold", {"label": "0", "reason": "count(*) FILTER (item_key % 4 = 0)", "revision": "count(*) FILTER (revision < 1)", "labeler": "count(*) FILTER (item_key % 6 = 0)"}, "item_key, revision"),
    "queue": ("announce", {"not_future": "count(*) FILTER (speak_date > DATE '2024-01-15')"}, "doc_id"),
}


def audit_sql(name: str) -> str:
    table, rules, unique = AUDITS[name]
    each = [f"SELECT '{name}' AS stored_table, '{rule}' AS rule, count(*) AS rows, CAST({found} AS BIGINT) AS violations FROM {table}" for rule, found in rules.items()]
    return " UNION ALL ".join([*each, f"SELECT '{name}', 'unique_key', CAST(sum(n) AS BIGINT), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {table} GROUP BY {unique}) v"])


@query("constraint_audit_tables", f"WITH {HITS} " + " UNION ALL ".join(map(audit_sql, AUDITS)))
def constraint_audit_tables(t: Tables) -> DataFrame:
    # a report is a row for each rule; written one after the other, so that the driver plans one table's audit at a time
    parts = [t.step(quality.audit_table(df, name).withColumn("stored_table", F.lit(name))) for name, df in audited_tables(t).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("stored_table", "rule", "rows", "violations")
