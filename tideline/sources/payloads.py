"""Raw payloads as rows: JSON arrays, field/data tables, and what a payload shows about itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.dates import by_declared_format, roc_period
from tideline.functions.text import WHITESPACE_CHARS

# Reasons recorded for a payload's own date.
INVALID_JSON, NOT_AN_ARRAY, EMPTY = "invalid_json", "payload_not_an_array", "payload_empty"
FIELD_MISSING, UNPARSABLE_DATE = "date_field_missing", "date_unparsable"
MULTIPLE, MAX_DATE, SINGLE = "multiple_dates_in_payload", "max_date_in_payload", "single_date_in_payload"
UNUSABLE_REASONS = (INVALID_JSON, NOT_AN_ARRAY)
INVALID_UTF8, BYTE_ORDER_MARK = "invalid_utf8", "byte_order_mark"
# How many distinct raw values are kept, how many leading bytes decide "this is HTML".
OBSERVED_CAP, HTML_PROBE = 50, 64

ROW_TYPE = "map<string,string>"


def read_payload_files(spark, path: str) -> DataFrame:
    """One payload per file: (path, content, length), the content being the file's bytes as they are.

    Hashes and sizes are taken of the bytes (:func:`tideline.functions.hashing.content_hash`); text comes
    from :func:`with_text`, so nothing is decoded before it is hashed. A file without a byte is no payload:
    Spark's file sources leave it out.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def with_text(payloads: DataFrame, content: str = "content") -> DataFrame:
    """Add ``body``, the bytes read as UTF-8, and ``decode_fault``: invalid_utf8, byte_order_mark or NULL.

    Decoding never stops a job: each sequence that is no UTF-8 becomes one U+FFFD, so a file's fault shows
    in its own row, and a byte order mark stays, which makes its JSON invalid.
    """
    raw = F.col(content).cast("string")
    fault = F.when(~F.is_valid_utf8(raw), INVALID_UTF8).when(F.startswith(F.make_valid_utf8(raw), F.lit("\ufeff")), BYTE_ORDER_MARK)
    return payloads.withColumns({"body": F.make_valid_utf8(raw), "decode_fault": fault})


def _probe(body: Column) -> Column:
    """(valid, first letter, empty) of a body, parsed once."""
    return F.struct(F.try_parse_json(body).alias("json"), F.substring(F.ltrim(body, F.lit(" \t\r\n")), 1, 1).alias("opens"))


def _state(json: Column, opens: Column) -> Column:
    return (
        F.when(json.isNull(), INVALID_JSON).when(opens != "[", NOT_AN_ARRAY)
        .when(F.try_variant_get(json, "$[0]", "variant").isNull(), EMPTY)
    )


def payload_state(body: Column) -> Column:
    """Why a payload has no rows; NULL for a usable array. Nothing raises."""
    probe = _probe(body)
    return _state(probe["json"], probe["opens"])


def probed(payloads: DataFrame, carry: tuple[str, ...], body: str = "body") -> DataFrame:
    """The carried columns, the body and its ``state``. Behind a generator, so no later step parses again."""
    once = payloads.select(*carry, F.col(body).alias("_body"), F.explode(F.array(_probe(F.col(body)))).alias("_p"))
    return once.select(*carry, "_body", F.explode(F.array(_state(F.col("_p.json"), F.col("_p.opens")))).alias("state"))


def json_rows(payloads: DataFrame, key: str = "id", body: str = "body", carry: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """(key, carried columns, pos, row) for each element of a usable array.

    A row is a map, so odd field names survive verbatim; an element that is no object has a NULL row.
    With ``every`` a payload without rows stays as one row of NULL ``pos``, and all rows carry the
    payload's ``state``, which is decided in the same pass.
    """
    known = probed(payloads, (key, *carry), body)
    elements = F.when(F.col("state").isNull(), F.from_json("_body", "array<string>"))
    rows = known.select(key, *carry, "state", F.posexplode_outer(elements).alias("pos", "_element"))
    row = F.when(F.startswith(F.ltrim("_element"), F.lit("{")), F.from_json("_element", ROW_TYPE)).alias("row")
    return rows.select(key, *carry, "state", "pos", row) if every else rows.filter("pos is not null").select(key, *carry, "pos", row)


def fields_data_rows(payloads: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``{fields: [...], data: [[...]]}`` → named rows; either part missing gives no rows.

    A short row leaves its last fields NULL; surplus cells have no name and are dropped.
    """
    parsed = payloads.select(key, F.from_json(body, "struct<fields:array<string>,data:array<array<string>>>").alias("_p"))
    rows = parsed.filter("_p.fields is not null and _p.data is not null").select(
        key, F.col("_p.fields").alias("fields"), F.posexplode("_p.data").alias("pos", "_cells")
    )
    named = F.map_from_entries(
        F.transform("fields", lambda name, i: F.struct(name, F.get(F.col("_cells"), i)))
    )
    return rows.filter("_cells is not null").select(key, "pos", named.alias("row"), (F.size("_cells") != F.size("fields")).alias("wrong_arity"))


# ── observation ──────────────────────────────────────────────────────────────


def observed_fields(rows: DataFrame, key: str = "id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Sorted union of field names per payload, with the columns that are the same for all its rows.

    Names are made distinct before they are gathered. Of the rows of ``json_rows(every=True)`` a payload without
    fields has an empty list.
    """
    names = rows.select(key, *carry, F.explode_outer(F.map_keys("row")).alias("name")).distinct()
    return names.groupBy(key, *carry).agg(F.array_sort(F.collect_list("name")).alias("fields"))


def signature(row: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(row)), "\u001f", "\u0000")


def heterogeneous_rows(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose field names differ from those of the first object row; non-objects count too.

    Signatures are counted first, so a payload with millions of equal rows joins as one row. Of the rows
    of ``json_rows(every=True)`` a payload without rows has none of either.
    """
    counted = rows.groupBy(key, signature(F.col("row")).alias("_sig")).agg(F.count("pos").alias("_n"), F.min("pos").alias("_first"))
    lead = counted.groupBy(key).agg(
        F.min_by("_sig", F.when(F.col("_sig").isNotNull(), F.col("_first"))).alias("_lead"),
        # a payload has few signatures, whatever its rows
        F.collect_list(F.struct(F.col("_sig").alias("sig"), F.col("_n").alias("n"))).alias("_all"))
    differ = F.aggregate("_all", F.lit(0).cast("long"), lambda n, s: n + F.when(s["sig"].eqNullSafe(F.col("_lead")), 0).otherwise(s["n"]))
    total = F.aggregate("_all", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    return lead.select(key, total.alias("row_count"), differ.alias("heterogeneous"))


def resolve_as_of(rows: DataFrame, raw: str, fmt: Column, selection: Column, key: str = "id") -> DataFrame:
    """Date of each payload with the reason it was, or was not, resolved.

    Given the rows of ``json_rows(every=True)``, every payload answers: one that is no usable array has its state
    for a reason.
    """
    seen = rows.groupBy(key).agg(
        F.count(raw).alias("_strings"),
        (F.max(raw) > F.min(raw)).alias("_several"),
        F.max(by_declared_format(F.col(raw), fmt)).alias("_max"),
        F.max(selection).alias("_selection"),
        (F.max("state") if "state" in rows.columns else F.lit(None).cast("string")).alias("_state"),
    )
    unique_many = F.coalesce((F.col("_selection") == "unique") & F.col("_several"), F.lit(False))
    reason = (
        F.when(F.col("_state").isNotNull(), F.col("_state"))
        .when(F.col("_strings") == 0, FIELD_MISSING)
        .when(F.col("_max").isNull(), UNPARSABLE_DATE)
        .when(F.col("_selection") == "max", MAX_DATE)
        .when(unique_many, MULTIPLE)
        .otherwise(SINGLE)
    )
    return seen.select(key, F.when(~unique_many, F.col("_max")).alias("data_as_of"), reason.alias("reason"))


def resolve_period(rows: DataFrame, raw: str, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.max(roc_period(F.col(raw))).alias("data_period"))


def observed_values(rows: DataFrame, raw: str, key: str = "id", cap: int = OBSERVED_CAP) -> DataFrame:
    """The first ``cap`` distinct raw values of each payload in order of appearance, one per row."""
    from tideline.operators.ranking import top_k

    first = rows.filter(F.col(raw).isNotNull()).groupBy(key, raw).agg(F.min("pos").alias("first_pos"))
    return top_k(first, [key], [F.col("first_pos"), F.col(raw)], cap).withColumn("rank", F.col("rank").cast("bigint"))


def looks_like_html(body: Column) -> Column:
    """Is the first sign among the leading bytes that is no blank an opening bracket?"""
    return F.startswith(F.ltrim(F.substring(body, 1, HTML_PROBE), F.lit(WHITESPACE_CHARS)), F.lit("<"))


def classify(body: Column, reason: Column) -> Column:
    """usable / html / unusable."""
    return (
        F.when(~reason.isin(*UNUSABLE_REASONS), "usable").when(looks_like_html(body), "html").otherwise("unusable")
    )


def field_drift(baseline: Column, observed: Column) -> tuple[Column, Column]:
    """(added, removed); a payload that shows no fields has lost all of them."""
    seen = F.coalesce(observed, F.array().cast("array<string>"))
    return F.array_sort(F.array_except(seen, baseline)), F.array_sort(F.array_except(baseline, seen))


def health_status(failed: Column, drift: Column, heterogeneous: Column, undated: Column) -> Column:
    """First that applies, in this order."""
    steps = (("fetch_failed", failed), ("schema_drift", drift), ("heterogeneous_rows", heterogeneous), ("date_unresolved", undated))
    return reduce(lambda acc, s: acc.when(s[1], s[0]), steps, F.when(F.lit(False), "")).otherwise("ok")
