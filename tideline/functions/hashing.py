"""Content hashes and keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F, types as T

from tideline.functions.text import parse_text, strip_ws

SEPARATOR = "\u001f"


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_map_json(m: Column) -> Column:
    """Flat JSON object with sorted keys: equal content gives equal text."""
    quoted = F.transform(
        F.array_sort(F.map_entries(m)),
        lambda e: F.concat(_json_string(e["key"]), F.lit(":"), _json_string(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """JSON of any nesting with sorted keys: structs and string-keyed maps as objects, lists in order.

    A missing struct field is left out, as an absent property is; a missing list element or map value
    is null. Whole doubles are written without a fraction.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.when(c[f.name].isNotNull(), F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical_json(c[f.name], f.dataType))) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        text = F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))
    elif isinstance(kind, T.StringType):
        text = _quoted(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def _quoted(c: Column) -> Column:
    """A string as JSON text with every control character escaped."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def definition_hash(c: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(c, kind), 256)


def _json_string(c: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    for raw, shown in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        escaped = F.regexp_replace(escaped, raw, shown)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def canonical_hash(m: Column) -> Column:
    return F.sha2(canonical_map_json(m), 256)


def announcement_hash(market, code, speak_date, clause, subject, detail) -> Column:
    """Identity of one published text; the report date is left out on purpose."""
    return F.sha2(
        F.concat_ws(
            SEPARATOR, market, code, F.date_format(speak_date, "yyyy-MM-dd"), parse_text(clause),
            parse_text(subject), parse_text(detail),
        ),
        256,
    )


def announcement_key(market, code, speak_date, full_hash) -> Column:
    return F.concat_ws(":", market, code, F.date_format(speak_date, "yyyy-MM-dd"), F.substring(full_hash, 1, 12))


def content_key_ignoring_date(market, code, clause, subject, detail) -> Column:
    """The same text published again on another day, or laid out differently, keeps this key."""
    return F.sha2(
        F.concat_ws(
            SEPARATOR, market, code, *(strip_ws(F.coalesce(c, F.lit(""))) for c in (clause, subject, detail))
        ),
        256,
    )
