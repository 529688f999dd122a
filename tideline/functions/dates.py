"""Dates in the declared source formats. A format is declared per source, never guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tideline.functions.text import matched, trim_all

# The Minguo calendar starts 1911 years after the common era.
ROC_OFFSET = 1911
ROC_COMPACT, AD_COMPACT, ISO = "roc_compact", "ad_compact", "iso"


# A cell is read by one expression each and never through a formatter, which raises and catches for every cell that is
# no real day: the casts below give NULL for it.


def _day_of_digits(digits: Column) -> Column:
    """20260814 → 2026-08-14; NULL unless it is a real day."""
    dash = F.lit("-")
    return F.overlay(F.overlay(digits, dash, 7, 0), dash, 5, 0).try_cast("date")


def _roc_year(c: Column, pattern: str) -> Column:
    return (F.regexp_extract(c, pattern, 1).try_cast("int") + ROC_OFFSET).cast("string")


def roc_date(c: Column) -> Column:
    """1150814 → 2026-08-14; NULL unless it is a real day."""
    digits = matched(c, r"^(?!0{2,3}\d{4}$)(\d{6,7})$", 1).try_cast("int")
    return _day_of_digits((digits + ROC_OFFSET * 10_000).cast("string"))


def roc_slashed_date(c: Column) -> Column:
    t = trim_all(c)
    year = (matched(t, r"^(\d{2,3})/\d{1,2}/\d{1,2}$", 1).try_cast("int") + ROC_OFFSET).cast("string")
    rest = F.regexp_extract(t, r"^\d{2,3}(/\d{1,2}/\d{1,2})$", 1)
    return F.concat(year, F.translate(rest, "/", "-")).try_cast("date")


def ad_date(c: Column) -> Column:
    return _day_of_digits(matched(c, r"^(\d{8})$", 1))


def iso_date(c: Column) -> Column:
    return matched(c, r"^\d{4}-\d{2}-\d{2}\z", 0).try_cast("date")


def is_valid_iso_date(c: Column) -> Column:
    return F.coalesce(iso_date(c).isNotNull(), F.lit(False))


def iso_to_compact(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def iso_to_roc(d: Column) -> Column:
    year = F.year(d) - ROC_OFFSET
    return F.when(year > 0, F.concat(F.lpad(year.cast("string"), 3, "0"), F.date_format(d, "MMdd")))


def roc_period(c: Column) -> Column:
    """11507 → 2026-07, months 1 to 12 only."""
    pattern = r"^(\d{2,3})(\d{2})$"
    month = F.regexp_extract(c, pattern, 2)
    return F.when(
        c.rlike(pattern) & month.try_cast("int").between(1, 12),
        F.concat(F.lpad(_roc_year(c, pattern), 4, "0"), F.lit("-"), month),
    )


FORMATS = {ROC_COMPACT: roc_date, AD_COMPACT: ad_date, ISO: iso_date}


def by_declared_format(c: Column, declared: Column) -> Column:
    """Parse with the format its own row declares; an unknown format gives NULL."""
    return reduce(
        lambda acc, item: acc.when(declared == item[0], item[1](c)),
        FORMATS.items(),
        F.when(F.lit(False), F.lit(None).cast("date")),
    )


def interval_bound(c: Column, side: int) -> Column:
    """One bound (0 start, 1 end) of ``start～end``; either spelling of dates and tilde."""
    t = trim_all(matched(c, r"^([^～~]*)[～~]([^～~]*)\z", side + 1))
    return F.get(F.transform(F.array(t), lambda x: F.coalesce(roc_slashed_date(x), roc_date(x))), F.lit(0))
