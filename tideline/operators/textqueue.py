"""The text queue: what to judge, stored verdicts, the labelled exam and model promotion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.hashing import content_key_ignoring_date
from tideline.functions.text import strip_ws
from tideline.operators.align import last_by_key

# Promotion needs at least this many answers.
MIN_GOLD_SAMPLE = 30
LABELS = ("veto", "no_veto")
HASH_BUCKET_DIGITS = 3


def eligible_items(items: DataFrame, today: Column) -> DataFrame:
    """Texts already published; the future is never queued."""
    return items.filter(F.col("speak_date") <= today)


def eligibility_counts(items: DataFrame, signal_day: Column, today: Column) -> DataFrame:
    d = F.col("speak_date")
    return items.agg(
        F.count_if(d <= today).alias("eligible"), F.count_if((d > signal_day) & (d <= today)).alias("after_signal"),
        F.count_if(d > today).alias("future"),
    )


def enqueue_new(items: DataFrame, queue: DataFrame, key: str = "task_key") -> DataFrame:
    """Items not queued yet. Items carry ``same_run`` when their fetch was compared with the quotes'."""
    fresh = items.filter("same_run") if "same_run" in items.columns else items
    return fresh.join(queue.select(key), key, "left_anti")


def pending(queue: DataFrame, results: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Tasks this model has not judged, newest day first. ``limit`` is one worker's batch size."""
    done = results.filter(F.col("model") == model).select("task_key")
    order = [F.col("d").desc(), F.col("id").desc()]
    todo = queue.join(done, "task_key", "left_anti").orderBy(*order)
    return todo.limit(limit) if limit is not None else todo


def content_keyed(items: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("market", "code", "clause", "subject", "detail")]
    return items.withColumn("content_key", content_key_ignoring_date(*cols))


def repeat_groups(keyed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Contents published more than once, with their first item. Combined map-side, so one text
    repeated a billion times is one row per input task."""
    groups = keyed.groupBy("content_key").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_item"))
    return groups.filter("copies > 1")


def dedupe_repeats(queue: DataFrame, gold: DataFrame, key: str = "item_key", pos: str = "id") -> DataFrame:
    """Exam candidates: not labelled under their key, and one item per content not in the exam yet."""
    new = queue.join(gold.select(key), key, "left_anti").join(gold.select("content_key"), "content_key", "left_anti")
    firsts = new.groupBy("content_key").agg(F.min(pos).alias(pos)).select(pos)
    # matched on the unique position, so a widely repeated content is not gathered
    return new.join(firsts, pos, "left_semi")


def validate_labels(labels: DataFrame, known: DataFrame, key: str = "item_key") -> DataFrame:
    """(item, rule) for every problem of a label import."""
    marked = labels.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    short = F.length(strip_ws(F.coalesce("label_reason", F.lit("")))) < 4
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label"), F.when(short, "reason"),
        F.when(F.col("_known").isNull(), "unknown_item"),
    ))
    return marked.select(key, F.explode(problems).alias("rule"))


def import_labels(labels: DataFrame, gold: DataFrame, key: str = "item_key") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). A known content under another key is rejected; a relabelled item gets
    the next revision."""
    owners = gold.groupBy("content_key").agg(F.min(key).alias("_owner"), F.max(key).alias("_owner2"))
    newest = gold.groupBy(key).agg(F.max("revision").alias("_rev"))
    joined = labels.join(owners, "content_key", "left").join(newest, key, "left")
    clash = F.col("_owner").isNotNull() & ((F.col("_owner") != F.col(key)) | (F.col("_owner2") != F.col(key)))
    rows = joined.withColumn("_clash", clash).withColumn("revision", F.coalesce(F.col("_rev"), F.lit(0)) + 1)
    pick = [*labels.columns, "revision"]
    return rows.filter(~F.col("_clash")).select(*pick), rows.filter("_clash").select(*pick)


def latest_revisions(gold: DataFrame, key: str = "item_key") -> DataFrame:
    return last_by_key(gold, [key], ["revision"]).orderBy(key)


def baseline_score(gold: DataFrame) -> DataFrame:
    """What a judge that never vetoes would score."""
    n, vetoes = F.count(F.lit(1)), F.count_if(F.col("label") == "veto")
    return gold.agg(
        n.alias("n"), (n - vetoes).alias("correct"), F.coalesce((n - vetoes) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("accuracy"),
        vetoes.alias("false_negatives"), F.lit(0).cast("bigint").alias("false_positives"), vetoes.alias("veto_labels"),
    )


def answers(gold: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each exam item with its verdict and how it came out."""
    joined = gold.join(verdicts, gold["item_key"] == verdicts["task_key"], "left")
    right = F.col("verdict") == F.col("label")
    outcome = (
        F.when(F.col("verdict").isNull(), "unanswered").when(right, "correct").when(F.col("label") == "veto", "false_negative")
        .otherwise("false_positive")
    )
    return joined.withColumn("outcome", outcome)


def score_against_gold(gold: DataFrame, verdicts: DataFrame) -> DataFrame:
    a = answers(gold, verdicts)
    answered = F.count_if(F.col("outcome") != "unanswered")
    correct = F.count_if(F.col("outcome") == "correct")
    return a.agg(
        answered.alias("n"), correct.alias("correct"), F.coalesce(correct / F.nullif(answered, F.lit(0)), F.lit(0.0)).alias("accuracy"),
        F.count_if(F.col("outcome") == "false_negative").alias("false_negatives"),
        F.count_if(F.col("outcome") == "false_positive").alias("false_positives"),
        F.count_if(F.col("label") == "veto").alias("veto_labels"),
        F.count_if(~F.col("parse_ok")).alias("parse_failures"),
        F.count_if(F.col("parse_ok") & ~F.col("evidence_verified")).alias("evidence_failures"),
    )


def gold_set_hash(gold: DataFrame) -> DataFrame:
    """Fingerprint of an exam: SHA-256 over its sorted ``key=label`` lines, one to a line.

    One digest over all lines has to see them one after the other. Spark sorts them, spilling as it
    needs, and they stream past the digest's state in one task, which holds a batch of them at a time.
    """
    line = F.concat(F.col("item_key").cast("string"), F.lit("="), F.col("label"))
    return _streamed_digest(gold.select(line.alias("line")), "gold_set_hash")


def _streamed_digest(lines: DataFrame, out: str) -> DataFrame:
    """One row with the SHA-256 of the sorted lines, joined by line feeds; NULL is no line."""
    # one row without a line, so that no lines have a digest as well
    ordered = lines.unionAll(lines.sparkSession.range(1).select(F.lit(None).cast("string"))).repartition(1).sortWithinPartitions("line")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = hashlib.sha256(), True
        for batch in batches:
            for line in filter(None.__ne__, batch.column(0).to_pylist()):
                state.update(line.encode() if first else b"\n" + line.encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], [out])

    return ordered.mapInArrow(digest, f"{out} string")


def gold_tree_hash(gold: DataFrame) -> DataFrame:
    """Fingerprint of any set of labels, independent of row order and sensitive to every key and label.

    SHA-256 over the sorted ``key=label`` lines, in two levels: lines are hashed within buckets
    named by the first digits of each line's own hash, then the sorted bucket digests are hashed.
    The buckets stream by in sorted tasks, each past a digest of its own, so no list is ever gathered.
    """
    line = F.concat(F.col("item_key").cast("string"), F.lit("="), F.col("label"))
    lines = gold.select(line.alias("line")).where("line is not null").withColumn("bucket", F.substring(F.sha2("line", 256), 1, HASH_BUCKET_DIGITS))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, state = None, None
        for batch in batches:
            done = []
            for name, text in zip(batch.column("bucket").to_pylist(), batch.column("line").to_pylist()):
                if name != bucket:
                    if bucket is not None:
                        done.append(f"{bucket}={state.hexdigest()}")
                    bucket, state = name, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["line"])
        if bucket is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{bucket}={state.hexdigest()}"])], ["line"])

    buckets = lines.repartition("bucket").sortWithinPartitions("bucket", "line").mapInArrow(digests, "line string")
    return _streamed_digest(buckets, "gold_tree_hash")


def exam_flags(gold: DataFrame) -> DataFrame:
    """One label only cannot tell judges apart; repeated contents count twice."""
    return gold.agg(
        (F.count_distinct("label") < 2).alias("degenerate"),
        (F.count_distinct("content_key") < F.count(F.lit(1))).alias("has_repeats"),
    )


def promotion_gates(challenger: DataFrame, champion: DataFrame | None, baseline: DataFrame) -> DataFrame:
    """(gate, passed) rows. Each input is one score row; scores carry ``gold_set_hash``."""
    tag = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("n", "accuracy", "false_negatives") if c in df.columns], *([F.col("gold_set_hash").alias(f"{p}_hash")] if "gold_set_hash" in df.columns else []), F.lit(1).alias("_one"))
    one = tag(challenger, "c").join(tag(baseline, "b").drop("b_hash"), "_one")
    if champion is not None:
        one = one.join(tag(champion, "o"), "_one", "left")
    else:
        one = one.selectExpr("*", "cast(null as double) o_accuracy", "cast(null as bigint) o_false_negatives", "cast(null as string) o_hash")
    no_champion = F.col("o_accuracy").isNull()
    gates = {
        "sample_size": F.col("c_n") >= MIN_GOLD_SAMPLE,
        "same_exam": no_champion | F.col("o_hash").isNull() | (F.col("o_hash") == F.col("c_hash")),
        "beats_baseline": F.col("c_accuracy") > F.col("b_accuracy"),
        "beats_champion": no_champion | (F.col("c_accuracy") > F.col("o_accuracy")),
        "no_more_misses": no_champion | (F.col("c_false_negatives") <= F.col("o_false_negatives")),
    }
    wide = one.select(*[ok.alias(name) for name, ok in gates.items()])
    return wide.unpivot([], list(gates), "gate", "passed")


def current_champion(registry: DataFrame) -> DataFrame:
    """Newest champion row per judge family (``family`` may be one constant)."""
    return last_by_key(registry.filter("role = 'champion'"), ["family"], ["registered_at", "id"])


def reuse_judged(tasks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Tasks with their stored verdict of this model version; ``to_judge`` marks the others."""
    stored = cache.filter(F.col("model") == model).select("task_key", F.col("verdict").alias("stored_verdict"))
    return tasks.join(stored, "task_key", "left").withColumn("to_judge", F.col("stored_verdict").isNull())


def error_by_clause(scored: DataFrame) -> DataFrame:
    wrong = F.count_if(F.col("outcome").isin("false_negative", "false_positive"))
    return scored.filter("outcome <> 'unanswered'").groupBy("clause").agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong")).orderBy(F.col("wrong").desc(), "clause")


def queue_status(queue: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of queue and exam sizes."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    judged = results.select("task_key").distinct()
    q = queue.join(judged.withColumn("_j", F.lit(1)), "task_key", "left").agg(
        F.count(F.lit(1)).alias("queued"), F.count("_j").alias("judged"), F.count_if(F.col("_j").isNull()).alias("unjudged")
    )
    g = latest_revisions(gold).agg(F.count(F.lit(1)).alias("gold_items"), F.count_if(F.col("label") == "veto").alias("gold_vetoes"))
    return one(q).join(one(g), "_one").drop("_one")
