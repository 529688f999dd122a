"""Quality rules by cross-document line frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SEPARATORS, SPACES, ascii_lower, digest, words_of
from tideline.session import materialise

#: Largest number of different texts of a host that may share a line.
MAX_DOCUMENTS = 100
#: A document with less than this share of its words outside frequent lines is depleted.
LEAST_SHARE = 0.3
SALTS = 16


def document_rules(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
                   max_documents: int = MAX_DOCUMENTS, least_share: float = LEAST_SHARE, least_words: int = 50,
                   most_repeated_percent: int = 50) -> DataFrame:
    """One row per input row: text statistics, ``base_failed`` and ``kept``.

    Lines are normalised (A-Z lowered, runs of separators made one space, digits made 0) and hashed;
    a line found in more than ``max_documents`` different texts of a host (NULL is a host of its own)
    does not count, and a document that keeps less than ``least_share`` of its words is rejected.
    Equal texts count as one document, so plain copies never condemn each other; dropping copies is
    the work of the deduplication operators. A NULL or empty text has no words and fails the base
    rules; repeated rows get equal verdicts; other columns are not read.
    """
    rows = _keyed(docs, id_column, text_column, host_column)
    lines = _lines(rows)
    return _rules(rows, lines, _frequent(lines, max_documents), least_share, least_words, most_repeated_percent)


def _keyed(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("doc_id"), F.col(host_column).cast("string").alias("host"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    ).withColumn("row_key", digest(F.col("doc_id"), F.col("host"), F.col("text")))


def _rules(rows: DataFrame, lines: DataFrame, frequent: DataFrame, least_share: float, least_words: int, most_repeated_percent: int) -> DataFrame:
    counts = _line_counts(lines, frequent)
    return (
        _statistics(rows)
        .join(counts, "row_key", "left")
        .withColumn("base_failed", (F.col("n_words") < least_words)
                    | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words")))
        .withColumn("depleted", F.coalesce(F.col("line_words") - F.col("frequent") < least_share * F.col("line_words"), F.lit(False)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "depleted",
                # repeated rows count their lines together, so the share is taken first
                F.coalesce((F.col("n_words") * F.col("frequent") / F.col("line_words")).cast("long"), F.lit(0).cast("long"))
                .alias("n_frequent_words"), "row_key")
    )


def kept_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", size_column: str | None = "n_chars",
                   max_documents: int = MAX_DOCUMENTS, least_share: float = LEAST_SHARE, least_words: int = 50, most_repeated_percent: int = 50) -> DataFrame:
    """The documents that the rules keep, less their frequent lines.

    Where a line goes, the text is joined from the others and the size counted anew; documents without
    frequent lines and all other columns are unchanged. Verdicts and places of lines are joined on a
    digest of id, host and text, so repeated ids keep their own.
    """
    rows = _keyed(docs, id_column, text_column, host_column)
    lines = _lines(rows, places=True)
    frequent = materialise(_frequent(lines, max_documents))
    rules = _rules(rows, lines, frequent, least_share, least_words, most_repeated_percent)
    dropped = rules.where(~F.col("kept")).select("row_key", F.lit(True).alias("_drop")).distinct()
    places = _salted(lines).join(frequent, ["line_key", "salt"]).groupBy("row_key").agg(F.array_sort(F.collect_set("place")).alias("_places"))
    changed = dropped.join(places, "row_key", "full").withColumnRenamed("row_key", "_changed")
    key = digest(docs[id_column], docs[host_column].cast("string"), F.coalesce(docs[text_column].cast("string"), F.lit("")))
    found = docs.join(changed, key == changed["_changed"], "left").where(changed["_drop"].isNull())
    found = found.select(*(docs[c] for c in docs.columns), changed["_places"], F.when(changed["_places"].isNotNull(), F.split(docs[text_column].cast("string"), "\n")).alias("_lines"))
    # the stretches between frequent lines, so the work is the text's length whatever their number
    stretches = F.expr("flatten(transform(sequence(0, size(_places)), j -> slice(_lines, coalesce(get(_places, j - 1), -1) + 2,"
                       " coalesce(get(_places, j), size(_lines)) - coalesce(get(_places, j - 1), -1) - 1)))")
    found = found.withColumn("_rest", F.when(F.col("_places").isNotNull(), F.array_join(stretches, "\n")))
    new = {text_column: F.col("_rest")} | ({size_column: F.length("_rest").cast("long")} if size_column in docs.columns else {})
    return found.select(*(F.when(F.col("_rest").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns))


def _statistics(rows: DataFrame) -> DataFrame:
    """Counts of each text, made inside its row: windows are sorted there, nothing is exploded."""
    return (
        rows.select("doc_id", "row_key", words_of(F.col("text")).alias("words"),
                    F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
                    (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                    F.expr(r"filter(split(text, '\n'), x -> translate(x, ' \t\u000b\u000c\r', '') <> '')").alias("lines"))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("marks", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("hashes", F.expr(
            "if(n_words < 3, array(), transform(sequence(0, cast(n_words as int) - 3),"
            " i -> xxhash64(marks[i], marks[i + 1], marks[i + 2])))"))
        # most texts repeat no window and are done here; the others sort their windows
        .withColumn("windows", F.expr(
            "if(size(array_distinct(hashes)) = size(hashes), array(), sort_array(transform(hashes, (h, i) -> struct(h, i))))"))
        .withColumn("starts", F.expr(
            "filter(transform(windows, (x, j) -> if(x.h = get(windows, j - 1).h or x.h = get(windows, j + 1).h, x.i, null)),"
            " i -> i is not null)"))
        .select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                F.expr("size(array_distinct(flatten(transform(starts, i -> array(i, i + 1, i + 2)))))").cast("long")
                .alias("n_repeat_words"))
    )


def _lines(rows: DataFrame, places: bool = False) -> DataFrame:
    """Every line with words of every row, with its place in the text if asked for."""
    normal = F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(F.col("line")), SEPARATORS, " "), "[0-9]", "0"))
    place = ["place"] if places else []
    split = F.split("text", "\n")
    line = F.posexplode(split).alias("place", "line") if places else F.explode(split).alias("line")
    return materialise(
        rows.select("row_key", "host", F.xxhash64("text").alias("content"), line)
        .select("row_key", "content", "host", normal.alias("line"), *place)
        .where("line <> ''")
        .select("row_key", "content", digest(F.col("host"), F.col("line")).alias("line_key"),
                F.size(F.split("line", " ")).alias("n"), *place)
    )


def _frequent(lines: DataFrame, max_documents: int) -> DataFrame:
    """Lines that are too frequent in their host, once for each salt."""
    return (
        lines.groupBy("line_key", "content").agg(F.lit(1).alias("one"))
        .groupBy("line_key").agg(F.count("*").alias("documents"))
        .where(F.col("documents") > max_documents)
        .select("line_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("found"))
    )


def _salted(lines: DataFrame) -> DataFrame:
    """A line of a third of all documents is dealt to several tasks by its salt."""
    return lines.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))


def _line_counts(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Words of each row's lines, and of those lines that are too frequent in their host."""
    return (
        _salted(lines)
        .join(frequent, ["line_key", "salt"], "left")
        .groupBy("row_key")
        .agg(F.sum("n").alias("line_words"), F.sum(F.when(F.col("found"), F.col("n")).otherwise(0)).alias("frequent"))
    )
