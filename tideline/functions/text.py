"""Column expressions that clean source text. All stay inside JVM expressions.

"Not given" is always NULL here, never 0: a missing number must not look like a measured one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters removed by a full Unicode trim (a plain SQL trim strips ASCII blanks only).
WHITESPACE_CLASS = (
    r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WHITESPACE_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# How sources spell "no value", "ex-right day" and a set flag.
BLANK_WORDS = ("", "N/A", "n/a")
CHANGE_NOTES = ("除權", "除息", "除權息")
FLAG_VALUES = ("Ｙ", "Y")
# Plain decimal syntax; keeps out what a lenient cast would accept (1D, NaN, Infinity).
DECIMAL_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# The same after a further plus sign, as its first group.
SIGNED_DECIMAL = r"^\+?([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?:\r\n|[\r\n])?\z"
NO_EVIDENCE = "（無原文）"

PARSED, BLANK, NOTED, UNPARSABLE = "parsed", "blank", "noted", "unparsable"


def trim_all(c: Column) -> Column:
    """Trim both ends, full-width blanks included; NULL stays NULL."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def parse_text(c: Column) -> Column:
    return F.coalesce(trim_all(c), F.lit(""))


def strip_ws(c: Column) -> Column:
    """Remove every blank and nothing else, so layout does not decide a comparison."""
    return F.regexp_replace(c, f"[{WHITESPACE_CLASS}]+", "")


def matched(c: Column, pattern: str, group: int) -> Column:
    """A group of the match, looked for once; NULL without one, as a failing cast raises and catches for every such cell."""
    return F.get(F.filter(F.array(F.regexp_extract(c, pattern, group)), lambda found: found != ""), F.lit(0))


def _number(trimmed: Column) -> Column:
    plain = F.replace(trimmed, F.lit(","), F.lit(""))
    value = F.array(matched(plain, SIGNED_DECIMAL, 1).try_cast("double"))
    return F.get(F.filter(value, lambda v: F.abs(v) < F.lit(float("inf"))), F.lit(0))


def _is_blank(c: Column, trimmed: Column) -> Column:
    return c.isNull() | trimmed.isin(*BLANK_WORDS) | (F.replace(trimmed, F.lit("-"), F.lit("")) == "")


def numeric_value(c: Column) -> Column:
    """No spelling of a blank cell is a number, so it needs no look of its own."""
    return _number(trim_all(c))


def numeric_status(c: Column) -> Column:
    t = trim_all(c)
    return (
        F.when(_is_blank(c, t), BLANK).when(_number(t).isNull(), UNPARSABLE).otherwise(PARSED)
    )


def integer_value(c: Column) -> Column:
    """Whole numbers only; a fraction is unparsable rather than rounded."""
    v = numeric_value(c)
    return F.when(v == F.floor(v), v.try_cast("bigint"))


def integer_status(c: Column) -> Column:
    v = numeric_value(c)
    return F.when(numeric_status(c) != PARSED, numeric_status(c)).otherwise(
        F.when(v == F.floor(v), PARSED).otherwise(UNPARSABLE)
    )


def change_note(c: Column) -> Column:
    t = trim_all(c)
    return F.when(t.isin(*CHANGE_NOTES), t)


def noted_value(c: Column) -> Column:
    """A number, or NULL when the cell carries an ex-right note instead."""
    return F.when(change_note(c).isNull(), numeric_value(c))


def noted_status(c: Column) -> Column:
    return F.when(change_note(c).isNotNull(), NOTED).otherwise(numeric_status(c))


def flag(c: Column) -> Column:
    return F.coalesce(trim_all(c).isin(*FLAG_VALUES), F.lit(False))


def evidence_or_fixed(c: Column) -> Column:
    """Evidence columns may not be blank; a fixed text says that the source gave none."""
    return F.coalesce(F.nullif(trim_all(c), F.lit("")), F.lit(NO_EVIDENCE))


# ── display columns ──────────────────────────────────────────────────────────


def previous_close(close: Column, change: Column, note: Column) -> Column:
    """close − change, unless an ex-right note makes the two days incomparable."""
    return F.when(F.coalesce(trim_all(note), F.lit("")) == "", close - change)


def move_pct(close: Column, change: Column, note: Column) -> Column:
    return 100 * change / F.nullif(previous_close(close, change, note), F.lit(0.0))


def move_arrow(change: Column, comparable: Column) -> Column:
    return (
        F.when(~comparable | change.isNull(), "").when(change > 0, "▲").when(change < 0, "▼").otherwise("—")
    )


def lots(shares: Column) -> Column:
    return shares / F.lit(1000.0)


def money_scale(amount: Column) -> Column:
    """Readable magnitude: 億 from 1e8, 萬 from 1e4, whole units below."""
    size = F.abs(amount)
    return (
        F.when(amount.isNull(), "—")
        .when(size >= 1e8, F.format_string("%.2f 億", amount / 1e8))
        .when(size >= 1e4, F.format_string("%.1f 萬", amount / 1e4))
        .otherwise(F.format_string("%,d 元", F.floor(amount + 0.5).cast("bigint")))
    )


def signed_pct(v: Column, digits: int = 2) -> Column:
    return F.when(v.isNull(), "—").otherwise(F.format_string(f"%+.{digits}f%%", v))


def format_price(v: Column) -> Column:
    return F.when(v.isNull(), "—").otherwise(F.format_string("%.2f", v))
