"""Secret candidates in texts, judged by a random forest that removes false positives."""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise

#: Labelled findings that a forest is fitted on at most, half of them of each label; its trees and their depth; decision threshold.
TRAIN_FINDINGS = 20_000
TREES = 40
DEPTH = 8
THRESHOLD = 0.5
#: Words around a candidate whose hashed presence it is judged by, and their buckets.
NEIGHBOURS = 2
_BUCKETS = 16
_PATH_BUCKETS = 4

_TOKEN = "A-Za-z0-9_+/=\\-"
_DIGIT_RUN = re.compile(r"[0-9]+")
_LONG_RUN = re.compile(f"[{_TOKEN}]{{20,}}")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PLAIN = re.compile(r"[a-z]{3,}")
_WORD = re.compile(r"\S+")
_BREAK = re.compile("\n")
_LEAST = 8

# Formats by which known issuers' secrets and known harmless numbers are labelled.
_KNOWN_SECRETS = (
    re.compile(r"AKIA[0-9A-Z]{16}"),
    re.compile(r"gh[pousr]_[0-9A-Za-z]{36}"),
    re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    re.compile(r"sk_live_[0-9A-Za-z]{16,}"),
    re.compile(r"AIza[0-9A-Za-z_-]{35}"),
)
_KNOWN_NAMES = re.compile(r"(?:password|passwd|secret|token|api_?key|access_?key|auth)[\"']?\s*[:=]\s*[\"']?$", re.IGNORECASE)
_KNOWN_VALUE = re.compile(r"(?=.*[0-9])[0-9A-Za-z+/_-]{16,}={0,2}")
_HARMLESS = (
    # numbers, dates, telephone numbers, words and paths of them, rules of dashes; no letter beside a digit
    re.compile(r"[/_+=-]*(?:(?:[A-Z]?[a-z]+|[0-9]+)(?:[/_+=-]+(?:[A-Z]?[a-z]+|[0-9]+))*[/_+=-]*)?"),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
)
_DIGEST_NAMES = re.compile(r"(?:md5|sha-?(?:1|256|512)|commit|checksum|digest|etag)[\"']?\s*[:= ]\s*[\"']?$", re.IGNORECASE)
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})", re.IGNORECASE)
# End of fixed values.

FEATURES = (
    "length", "digits", "upper", "lower", "other", "hex", "entropy", "class_changes", "letter_digit_changes", "case_changes",
    "repeats", "rare_pairs", "covered", "longest_word", "padding", "all_digits", "quoted", "assigned", "line_share", "words_near",
    "path_depth",
)
FINDINGS = "doc_id long, text_key long, start long, stop long, candidate string, known int, features array<double>"


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of token characters that are long, or at least eight long with a digit among them."""
    found = {m.span() for m in _LONG_RUN.finditer(text)}
    done = 0
    for m in _DIGIT_RUN.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > 0 and text[a - 1] in _TOKEN_CHARS:
            a -= 1
        while b < len(text) and text[b] in _TOKEN_CHARS:
            b += 1
        done = b
        if b - a >= _LEAST:
            found.add((a, b))
    for a, b in sorted(found):
        # name=value is a name and a value; padding stays with the value
        body = text[a:b].rstrip("=")
        cut = body.rfind("=") + 1
        if b - a - cut >= _LEAST:
            yield a + cut, b


def known_label(text: str, start: int, stop: int) -> int | None:
    """1 for a known secret format, 0 for a known harmless one, None for a token that no format knows.

    A value behind a secret's name, or before the @ of an address, is never known to be harmless. Names are
    looked for in the 40 characters before it.
    """
    value, before = text[start:stop], text[max(0, start - 40) : start]
    if any(p.fullmatch(value) for p in _KNOWN_SECRETS):
        return 1
    if _KNOWN_NAMES.search(before):
        return 1 if _KNOWN_VALUE.fullmatch(value) else None
    if any(p.fullmatch(value) for p in _HARMLESS) and text[stop : stop + 1] != "@":
        return 0
    return 0 if _DIGEST.fullmatch(value) and _DIGEST_NAMES.search(before) else None


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.strip("\"'.,;:()[]{}").lower().encode()) % buckets


def finding_features(text: str, start: int, stop: int, dictionary: set[str], pairs: set[str], path: str | None, breaks: list[int]) -> list[float]:
    """FEATURES, then which buckets neighbouring words and the path fall into; ``breaks`` are the text's line feeds.

    Neighbouring words are read from the 80 characters on either side; of a word that reaches further
    only the part inside counts, so a text without blanks costs its length.
    """
    value = text[start:stop]
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    changes = Counter(a + b for a, b in zip(kinds, kinds[1:]) if a != b)
    counts = Counter(value)
    lower = value.lower()
    runs = [m.group().lower() for m in _LETTERS.finditer(value)]
    known = [r for r in runs if r in dictionary]
    before, after = text[max(0, start - 80) : start], text[stop : stop + 80]
    at = bisect.bisect_left(breaks, start)
    line_length = (breaks[at] if at < len(breaks) else len(text)) - (breaks[at - 1] + 1 if at else 0)
    row = [
        n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("o") / n,
        sum(c in "0123456789abcdef" for c in lower) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(changes.values()) / n, (changes["ld"] + changes["dl"] + changes["ud"] + changes["du"]) / n, (changes["ul"] + changes["lu"]) / n,
        sum(a == b for a, b in zip(value, value[1:])) / n,
        sum(lower[i : i + 2] not in pairs for i in range(n - 1)) / max(1, n - 1),
        sum(map(len, known)) / n, max(map(len, known), default=0), n - len(value.rstrip("=")), float(value.isdigit()),
        float(before[-1:] in ("'", '"')), float(before.rstrip("\"' ")[-1:] in ("=", ":")), n / max(1, line_length),
        len(before.split()) + len(after.split()), (path or "").count("/"),
    ]
    near = [0.0] * _BUCKETS
    left = _WORD.findall(before.replace("=", " = "))[-NEIGHBOURS:]
    for word in [*left, *_WORD.findall(after)[:NEIGHBOURS]]:
        near[_bucket(word, _BUCKETS)] = 1.0
    ways = [0.0] * _PATH_BUCKETS
    if path:
        ways[_bucket(path.rsplit(".", 1)[-1] if "." in path else path, _PATH_BUCKETS)] = 1.0
    return [float(x) for x in row] + near + ways


def findings(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None) -> DataFrame:
    """Every candidate of every text with its features and the label that known formats give it.

    The dictionary that a candidate's letters are compared with is the words of its own document, and
    its character pairs are judged by those words. A NULL or empty text has no candidates; a NULL path
    is no path. A text of any length, in one line or many, costs about its length. Positions count code points.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("candidate", pa.string()),
                            ("known", pa.int32()), ("features", pa.list_(pa.float64()))])
        for batch in batches:
            rows = []
            for doc_id, key, text, path in zip(*(batch.column(c) for c in ("doc_id", "text_key", "text", "path"))):
                text = text.as_py()
                spans = list(candidates(text)) if text else []
                if not spans:
                    continue
                dictionary = set(_PLAIN.findall(text.lower()))
                for a, b in spans:  # a candidate is no word of its own dictionary
                    dictionary -= set(_PLAIN.findall(text[a:b].lower()))
                pairs = {w[i : i + 2] for w in dictionary for i in range(len(w) - 1)}
                breaks = [m.start() for m in _BREAK.finditer(text)]
                for a, b in spans:
                    rows.append((doc_id.as_py(), key.as_py(), a, b, text[a:b], known_label(text, a, b), finding_features(text, a, b, dictionary, pairs, path.as_py(), breaks)))
                    if len(rows) >= 5000:
                        yield _batch(rows, schema)
                        rows = []
            if rows:
                yield _batch(rows, schema)

    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_key"),
                       F.col(text_column).cast("string").alias("text"), path.alias("path"))
    return rows.mapInArrow(find, FINDINGS)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def training_sample(labelled: DataFrame, *, at_most: int = TRAIN_FINDINGS) -> DataFrame:
    """(label double, features) of at most ``at_most`` labelled findings, at most half of them of each label.

    All rows of a label that has no more are taken; of a larger one those with the smallest hashes of
    place and text, the same on every run. Rows that repeat place and text (or, where there is no place,
    label and features) are one. Hashes above what the bound can need are dropped where they are made,
    so only about as many rows as are taken leave their tasks.
    """
    place = [c for c in ("doc_id", "text_key", "start", "candidate") if c in labelled.columns] if "candidate" in labelled.columns else ["features"]
    rows = labelled.where(F.col("label").isin(0, 1)).select(F.col("label").cast("double").alias("label"), "features", F.xxhash64(*place).alias("draw"))
    each = max(1, at_most // 2)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not sizes:
        return rows.drop("draw")
    # the counts are within a few hundredths of the truth, and draws of this many rows scatter little
    shares = {label: (1.3 * each + 1000) / n for label, n in sizes.items()}
    wanted = F.lit(False)
    for label, share in shares.items():
        drawn = F.lit(True) if share >= 1 else F.col("draw") < min(2**63 - 1, int(-(2**63) + 2**64 * share))
        wanted = wanted | ((F.col("label") == label) & drawn)
    drawn = materialise(rows.where(wanted).dropDuplicates(["label", "draw"]))
    parts = [drawn.where(F.col("label") == label).orderBy("draw").limit(each) for label in sorted(sizes)]
    sample = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return materialise(sample.drop("draw"))


def fit(labelled: DataFrame, *, trees: int = TREES, depth: int = DEPTH, at_most: int = TRAIN_FINDINGS, seed: int = 11) -> RandomForestClassificationModel:
    """A forest over a sample of labelled findings (features array, label 0 or 1), as training_sample draws it."""
    return _fitted(training_sample(labelled, at_most=at_most), trees, depth, seed)


def _fitted(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> RandomForestClassificationModel:
    rows = sample.select("label", array_to_vector("features").alias("vector"))
    return RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed).fit(rows)


def judged(found: DataFrame, model: RandomForestClassificationModel | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """Findings with ``score``, the forest's share for a secret, and ``is_secret``."""
    kept = ["doc_id", "text_key", "start", "stop", "candidate", "score"]
    if model is None:
        rows = found.withColumn("score", F.lit(0.0))
    else:
        rows = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return rows.select(*kept, (F.col("score") >= threshold).alias("is_secret"))


def labelled_by_format(found: DataFrame) -> DataFrame:
    """Labelled findings where a table of reviewed ones is not at hand, by known formats; others have no label."""
    return found.withColumn("label", F.col("known"))


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, *, id_column: str = "doc_id", text_column: str = "text",
                    path_column: str | None = None, threshold: float = THRESHOLD, at_most: int = TRAIN_FINDINGS) -> DataFrame:
    """(doc_id, start, stop, candidate, score, is_secret) of every candidate in every document.

    ``labelled`` has (features, label) of reviewed findings; without it findings are labelled by known
    formats, and what no format knows is judged without having been taught. Where only one class is labelled nothing can be learnt: every score is 1 if all known
    findings are secrets, else 0. Repeated rows give repeated findings; an empty table gives none.
    """
    # written once: they are counted, drawn from and judged
    found = materialise(findings(docs, id_column=id_column, text_column=text_column, path_column=path_column))
    training = labelled if labelled is not None else labelled_by_format(found)
    sample = training_sample(training, at_most=at_most)
    classes = {int(r.label) for r in sample.select("label").distinct().collect()}
    if classes == {1}:
        return judged(found, None, threshold=threshold).withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    return judged(found, _fitted(sample) if classes == {0, 1} else None, threshold=threshold)


def _without(text: str, spans, marker: str) -> str:
    pieces, done = [], 0
    for start, stop in spans:
        pieces += [text[done:start], marker]
        done = stop
    return "".join([*pieces, text[done:]])


def redacted(docs: DataFrame, found: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size_column: str | None = "n_chars",
             marker: str = "[SECRET]") -> DataFrame:
    """The documents with their secrets replaced by ``marker``, other columns but the size unchanged.

    Rows are matched by id and text, so repeated ids keep apart; documents without secrets keep their
    text and size as they are.
    """
    spans = (
        found.where("is_secret").groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
        .select(F.col("doc_id").alias("_span_id"), F.col("text_key").alias("_span_key"), "_spans")
    )
    rows = docs.join(spans, docs[id_column].eqNullSafe(spans["_span_id"]) & (F.xxhash64(docs[text_column]) == spans["_span_key"]), "left")
    found_spans = spans["_spans"]

    @F.pandas_udf("string")
    def blacked(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else _without(text, places, marker) for text, places in zip(texts, lists)], dtype=object)

    # only texts with a secret go to Python
    rebuilt = blacked(F.when(found_spans.isNotNull(), docs[text_column].cast("string")), F.transform(found_spans, lambda x: F.array(x["start"], x["stop"])))
    changed = {text_column: rebuilt} | ({size_column: F.length(rebuilt).cast("long")} if size_column in docs.columns else {})
    return rows.select(*(F.when(found_spans.isNotNull(), changed[c]).otherwise(docs[c]).alias(c) if c in changed else docs[c] for c in docs.columns))
