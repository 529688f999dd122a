"""Quality scores by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import UPPER, words_of

#: Word buckets; labelled rows that a model is fitted on at most; rank of the pairwise interactions.
BUCKETS = 1 << 12
TRAIN_ROWS = 8_000
RANK = 4
_STATISTICS = ("size", "variety", "stutter", "word_length", "upper", "digits", "marks", "pipes", "symbols", "lines", "line_variety", "breaks", "declared")
#: Characters that are counted together, each kind turned into one mark in a single pass over the text.
_KINDS = {"upper": UPPER, "digits": "0123456789", "marks": "!?;:", "pipes": "|<>{}[]\\/_", "symbols": "#*$%&", "breaks": ".,"}
_MARKS = dict(zip(_KINDS, "\x01\x02\x03\x04\x05\x06"))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; never for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(part: Column, whole: Column) -> Column:
    return F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))


def _count(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def features(docs: DataFrame, text_column: str = "text", size_column: str | None = "n_chars") -> DataFrame:
    """The rows with a vector ``features``: L2-scaled hashed words, then structure in 0 to 1.

    Words and structure come from the whole text; the one metadata input is the declared size against
    the real one. NULL texts are empty texts, whose word part is all zero; a NULL size is a size of 0.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    declared = F.coalesce(F.col(size_column).cast("double"), F.lit(0.0)) if size_column else F.lit(0.0)
    marked = F.translate(F.translate(text, "".join(_MARKS.values()), ""), "".join(_KINDS.values()), "".join(_MARKS[k] * len(v) for k, v in _KINDS.items()))
    rows = docs.withColumns({"_text": text, "_words": words_of(text), "_marked": marked, "_declared": declared}).withColumns({
        "_n": F.size("_words"), "_chars": F.length("_text"), "_lines": F.split("_text", "\n"),
    })
    n, chars, kinds = F.col("_n"), F.col("_chars"), {k: _count(F.col("_marked"), m) for k, m in _MARKS.items()}
    rows = rows.withColumns({
        "_size": F.least(F.lit(1.0), F.log1p(n) / 12.0),
        "_variety": _share(F.size(F.array_distinct("_words")), n),
        "_stutter": _share(F.expr("size(filter(_words, (w, i) -> w = get(_words, i - 1)))"), n),
        "_word_length": F.least(F.lit(1.0), chars / F.greatest(n, F.lit(1)) / 20.0),
        "_upper": _share(kinds["upper"], chars),
        "_digits": _share(kinds["digits"], chars),
        "_marks": _share(kinds["marks"], n),
        "_pipes": _share(kinds["pipes"], n),
        "_symbols": _share(kinds["symbols"], n),
        "_lines": F.least(F.lit(1.0), F.size("_lines") / F.greatest(n, F.lit(1))),
        "_line_variety": _share(F.size(F.array_distinct("_lines")), F.size("_lines")),
        "_breaks": _share(kinds["breaks"], n),
        "_declared": _share(F.col("_declared"), F.greatest(chars * 2, F.col("_declared"))),
    })
    rows = HashingTF(numFeatures=BUCKETS, inputCol="_words", outputCol="_counts").transform(rows)
    rows = Normalizer(p=2.0, inputCol="_counts", outputCol="_hashed").transform(rows)
    names = [f"_{s}" for s in _STATISTICS]
    return VectorAssembler(inputCols=["_hashed", *names], outputCol="features").transform(rows)


def training_rows(docs: DataFrame, labels: DataFrame, at_most: int = TRAIN_ROWS) -> DataFrame:
    """(label, features) of at most ``at_most`` labelled rows outside the held-out part.

    The sample is the ids with the smallest hashes; being bounded, its ids and labels are small enough to
    be sent to every task. Rows without a label or an id are not learnt from; of an id with both labels
    the greater counts, and of an id with several texts the smallest, so no id counts twice.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isin(0.0, 1.0) & ~is_held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(at_most)
    )
    columns = [F.col(c) for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    rows = docs.select(*columns).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    least = F.min(F.struct(*[c for c in ("text", "n_chars") if c in docs.columns])).alias("_row")
    rows = rows.groupBy("doc_id", "label").agg(least).select("doc_id", "label", "_row.*")
    return features(rows, size_column="n_chars" if "n_chars" in docs.columns else None).select("label", "features")


def fit(training: DataFrame, *, rank: int = RANK, iterations: int = 60, seed: int = 7) -> FMClassificationModel:
    """A logistic factorisation machine: bias, linear weights and ``rank`` factors for each input.

    The score of a vector x is b + <w, x> + 0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2): all
    pairwise interactions in time linear in the non-zero inputs.
    """
    held = training.persist()
    try:
        return FMClassifier(factorSize=rank, maxIter=iterations, stepSize=0.05, regParam=1e-4, initStd=0.05, solver="adamW", seed=seed).fit(held)
    finally:
        held.unpersist()


def scored(docs: DataFrame, model: FMClassificationModel, *, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; empty and NULL texts are scored by structure."""
    columns = [F.col(c) for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    rows = features(docs.select(*columns), size_column="n_chars" if "n_chars" in docs.columns else None)
    score = F.element_at(vector_to_array(F.col("probability")), 2)
    return (
        model.transform(rows.select("doc_id", "features"))
        .select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def quality_scores(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, threshold: float = 0.7) -> DataFrame:
    """Fit on the labelled rows that are not held out and score every document.

    Neither labels nor lang, source or doc_id are inputs of a score, so equal texts of equal size have equal
    scores and every repeated row gets its own. NULL and empty texts are scored by their structure. With
    no labelled row of either class there is nothing to learn, and every score is 0.5 (predicted 0);
    an empty table gives no rows, a NULL id is never learnt from, other columns are not read.
    """
    training = training_rows(docs, labels, train_rows)
    if training.select("label").distinct().count() < 2:
        return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    return scored(docs, fit(training), threshold=threshold)
