"""Source rows → typed facts by declared column maps. One engine, one small map per source.

Field names are the publishers' own, odd spellings and blanks included: a corrected name would
silently read nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import dates, text

MISSING_CODE = "missing_code"

Kind = str  # text | number | integer | noted | note | count0 | roc | ad | ad_or_roc | flag | period_start | period_end


def _cell(row: Column, field: str) -> Column:
    return row.getItem(field)


def _zero_if_missing(c: Column) -> Column:
    """Corporate-action numbers: here a missing amount does mean that none is paid."""
    return F.coalesce(text.numeric_value(c), F.lit(0.0))


KINDS = {
    "text": text.parse_text,
    "number": text.numeric_value,
    "integer": text.integer_value,
    "noted": text.noted_value,
    "note": text.change_note,
    "zero": _zero_if_missing,
    "positive": lambda c: _zero_if_missing(c) > 0,
    "per_thousand": lambda c: _zero_if_missing(c) / 1000.0,
    "roc": lambda c: dates.roc_date(text.parse_text(c)),
    "ad": lambda c: dates.ad_date(text.parse_text(c)),
    "ad_or_roc": lambda c: F.coalesce(dates.ad_date(text.parse_text(c)), dates.roc_date(text.parse_text(c))),
    "flag": text.flag,
    "present": lambda c: F.length(text.parse_text(c)) > 0,
    "start": lambda c: dates.interval_bound(c, 0),
    "end": lambda c: dates.interval_bound(c, 1),
}

# Column maps, output column → (source field, kind).
ROSTER = {
    "TWSE": {
        "code": ("公司代號", "text"), "name": ("公司簡稱", "text"), "industry": ("產業別", "text"),
        "listing_date": ("上市日期", "ad"), "capital": ("實收資本額", "number"),
        "issued_shares": ("已發行普通股數或TDR原股發行股數", "number"),
    },
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "name": ("CompanyAbbreviation", "text"),
        "industry": ("SecuritiesIndustryCode", "text"), "listing_date": ("DateOfListing", "ad"),
        "capital": ("Paidin.Capital.NTDollars", "number"), "issued_shares": ("IssueShares", "number"),
    },
}
QUOTES = {
    "TWSE": {
        "code": ("Code", "text"), "open": ("OpeningPrice", "number"), "high": ("HighestPrice", "number"),
        "low": ("LowestPrice", "number"), "close": ("ClosingPrice", "number"), "change": ("Change", "noted"),
        "change_note": ("Change", "note"), "volume_shares": ("TradeVolume", "integer"),
        "turnover_value": ("TradeValue", "integer"), "transactions": ("Transaction", "integer"),
    },
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "open": ("Open", "number"), "high": ("High", "number"),
        "low": ("Low", "number"), "close": ("Close", "number"), "change": ("Change", "noted"),
        "change_note": ("Change", "note"), "volume_shares": ("TradingShares", "integer"),
        "turnover_value": ("TransactionAmount", "integer"), "transactions": ("TransactionNumber", "integer"),
    },
}
VALUATIONS = {
    "TWSE": {"code": ("Code", "text"), "pe": ("PEratio", "number"), "dividend_yield": ("DividendYield", "number"), "pb": ("PBratio", "number")},
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "pe": ("PriceEarningRatio", "number"),
        "dividend_yield": ("YieldRatio", "number"), "pb": ("PriceBookRatio", "number"),
    },
}
FLOWS = {
    "TWSE": {
        "code": ("證券代號", "text"), "foreign_net": ("外陸資買賣超股數(不含外資自營商)", "integer"),
        "trust_net": ("投信買賣超股數", "integer"), "dealer_net": ("自營商買賣超股數", "integer"),
        "total_net": ("三大法人買賣超股數", "integer"),
    },
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"),
        "foreign_net": ("Foreign Investors include Mainland Area Investors (Foreign Dealers excluded)-Difference", "integer"),
        "trust_net": ("SecuritiesInvestmentTrustCompanies-Difference", "integer"),
        "dealer_net": ("Dealers-Difference", "integer"), "total_net": ("TotalDifference", "integer"),
    },
}
MARGINS = {
    "TWSE": {
        "code": ("股票代號", "text"), "margin_prev": ("融資前日餘額", "number"), "margin": ("融資今日餘額", "number"),
        "short_prev": ("融券前日餘額", "number"), "short": ("融券今日餘額", "number"),
    },
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "margin_prev": ("MarginPurchaseBalancePreviousDay", "number"),
        "margin": ("MarginPurchaseBalance", "number"), "short_prev": ("ShortSaleBalancePreviousDay", "number"),
        "short": ("ShortSaleBalance", "number"),
    },
}
REVENUE = {
    "code": ("公司代號", "text"), "revenue": ("營業收入-當月營收", "number"),
    "yoy_pct": ("營業收入-去年同月增減(%)", "number"), "mom_pct": ("營業收入-上月比較增減(%)", "number"),
}
ATTENTION = {
    "TWSE": {"code": ("Code", "text"), "date": ("Date", "roc"), "info": ("TradingInfoForAttention", "text")},
    "TPEx": {"code": ("SecuritiesCompanyCode", "text"), "date": ("Date", "roc"), "info": ("TradingInformation", "text")},
}
DISPOSITION = {
    "TWSE": {
        "code": ("Code", "text"), "announced": ("Date", "roc"), "start_d": ("DispositionPeriod", "start"),
        "end_d": ("DispositionPeriod", "end"), "period_raw": ("DispositionPeriod", "text"),
        "reason": ("ReasonsOfDisposition", "text"), "measure": ("DispositionMeasures", "text"),
    },
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "announced": ("Date", "roc"), "start_d": ("DispositionPeriod", "start"),
        "end_d": ("DispositionPeriod", "end"), "period_raw": ("DispositionPeriod", "text"), "reason": ("DispositionReasons", "text"),
    },
}
SUSPENSION = {
    "TWSE": {"code": ("Code", "text"), "halt_d": ("TradingHaltDate", "roc"), "resume_d": ("TradingResumptionDate", "roc")},
    "TPEx": {"code": ("SecuritiesCompanyCode", "text"), "halt_d": ("暫停交易", "ad_or_roc"), "resume_d": ("恢復交易", "ad_or_roc")},
}
ALTERED = {
    # being listed here is the fact itself; the payload has no flag for it and no date
    "TWSE": {"code": ("Code", "text"), "periodic": ("PeriodicCallAuctionTrading", "present")},
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "date": ("Date", "roc"), "altered": ("AlteredTrading", "flag"),
        "periodic": ("PeriodicTrading", "flag"), "managed": ("ManagedStock", "flag"), "halted": ("SuspensionOfTrading", "flag"),
    },
}
MARGIN_SUSPENSION = {
    "code": ("Code", "text"), "start_d": ("StartDate", "roc"), "end_d": ("EndDate", "roc"), "reason": ("Reason", "text"),
}
EX_RIGHT = {
    "TWSE": {
        "code": ("Code", "text"), "ex_date": ("Date", "roc"), "cash": ("CashDividend", "zero"),
        "ratio": ("StockDividendRatio", "zero"), "rights": ("SubscriptionRatio", "positive"), "kind": ("Exdividend", "text"),
    },
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "ex_date": ("ExRrightsExDividendDate", "roc"), "cash": ("CashDividend", "zero"),
        "ratio": ("StockDividendRatio", "zero"), "rights": ("SubscriptionRatioToNewSharesIssued", "positive"),
        "kind": ("ExRrightsExDividend", "text"),
    },
}
EX_RIGHT_CHECK = {
    "code": ("SecuritiesCompanyCode", "text"), "ex_date": ("Date", "roc"),
    "close_before": ("ClosePriceBeforeExRightsDiviend", "zero"), "official": ("ExRightsDiviendQuote", "zero"),
    "cash": ("CashDivdend", "zero"), "ratio": ("StockDivdendThousandShares", "per_thousand"),
}
OFFICIAL_INDEX = {"d": ("Date", "roc"), "value": ("TAIEXTotalReturnIndex", "number")}
ANNOUNCEMENT = {
    "TWSE": {
        "code": ("公司代號", "text"), "speak_date": ("發言日期", "roc"), "subject": ("主旨 ", "text"),
        "clause": ("符合條款", "text"), "detail": ("說明", "text"),
    },
    "TPEx": {
        "code": ("SecuritiesCompanyCode", "text"), "speak_date": ("發言日期", "roc"), "subject": ("主旨", "text"),
        "clause": ("符合條款", "text"), "detail": ("說明", "text"),
    },
}

REQUIRED = {"ex_date", "speak_date", "d", "value"}


def normalize(rows: DataFrame, columns: dict[str, tuple[str, Kind]], carry: tuple[str, ...] = (), row: str = "row") -> DataFrame:
    """Typed columns for every source row plus ``skip_reason`` (NULL for rows to keep).

    Rows are not dropped here: kept and skipped counts come from the same pass.
    """
    r = F.col(row)
    out = rows.select(*carry, *[KINDS[kind](_cell(r, field)).alias(name) for name, (field, kind) in columns.items()])
    reason = F.when(F.col("code") == "", MISSING_CODE) if "code" in columns else F.when(F.lit(False), "")
    for name in columns:
        if name in REQUIRED:
            reason = F.when(reason.isNotNull(), reason).when(F.col(name).isNull(), f"missing_{name}")
    return out.withColumn("skip_reason", reason)


def kept(normalized: DataFrame) -> DataFrame:
    return normalized.filter("skip_reason is null").drop("skip_reason")


def per_market(rows: DataFrame, maps: dict[str, dict], carry: tuple[str, ...] = (), market: str = "market") -> DataFrame:
    """Apply each market's own map to its rows and stack the results."""
    parts = [normalize(rows.filter(F.col(market) == m), columns, (*carry, market)) for m, columns in maps.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked


def altered_facts(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Altered-trading rows of both markets; a row of the list without flags is the fact by presence."""
    out = per_market(rows, ALTERED, carry)
    return out.withColumn("altered", F.coalesce("altered", F.lit(True))).na.fill(False, ["managed", "halted"])


def revenue_facts(rows: DataFrame, ledger: DataFrame, snapshot: str = "id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Revenue rows with the day their report came out and the month it covers, both of their snapshot.

    ``rows`` carry the snapshot's id; ``ledger`` has (id, data_as_of, data_period). What is known on a day
    goes by ``report_date``: taking ``period`` for it would look weeks ahead. A snapshot without its day or
    month gives rows that are skipped for it.
    """
    dated = ledger.select(F.col("id").alias(snapshot), F.col("data_as_of").alias("report_date"), F.col("data_period").alias("period"))
    out = normalize(rows, REVENUE, (snapshot, *carry)).join(dated, snapshot, "left")
    reason = F.coalesce("skip_reason", F.when(F.col("report_date").isNull(), "missing_report_date").when(F.col("period").isNull(), "missing_period"))
    return out.withColumn("skip_reason", reason)


def official_index(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return kept(normalize(rows, OFFICIAL_INDEX, carry)).filter("value > 0")
