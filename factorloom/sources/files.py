"""Readers of landed files.

Each format has a reader (``read_*``, a thin ``spark.read``) and a parser (``parse_*``) that
works on rows of text, so many files are parsed as one distributed job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.scalars import accounting_number, clean_ticker, pad_cik

# Footer mark of the listing files.
LISTING_FOOTER = "File Creation Time"


def lines_of(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per line with its number; other columns repeat."""
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def read_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Whole text files: (file, value)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


# ------------------------------------------------------------------------------- listings


def read_listing(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Pipe-delimited listing file; ``kind`` is ``nasdaq`` or ``other``."""
    return parse_listing(spark.read.csv(path, sep="|", header=True), kind)


def parse_listing(raw: DataFrame, kind: str) -> DataFrame:
    first = raw.columns[0]
    rows = raw.where(~F.coalesce(F.col(f"`{first}`").startswith(LISTING_FOOTER), F.lit(False)))
    col = lambda n: F.col(f"`{n}`")
    exchange = F.lit("NASDAQ") if kind == "nasdaq" else col("Exchange")
    symbol = "Symbol" if kind == "nasdaq" else "ACT Symbol"
    flags = [col(n).alias(a) for n, a in (("Test Issue", "test_issue"), ("ETF", "etf")) if n in raw.columns]
    return rows.select(col(symbol).alias("ticker"), col("Security Name").alias("name"),
                       exchange.alias("exchange"), *flags)


# -------------------------------------------------------------------------- factor series


def read_factor_file(spark: SparkSession, path: str, names: Sequence[str], skip: int = 0) -> DataFrame:
    return parse_factor_lines(lines_of(read_documents(spark, path)), names, by=["file"], skip=skip).drop("file")


def parse_factor_lines(lines: DataFrame, names: Sequence[str], by: Sequence[str] = ("file",), skip: int = 0) -> DataFrame:
    """The first block of lines that start with a digit: YYYYMM, then values in percent.

    Lines before it are a preamble, and whatever follows its end (an annual block, notes) is
    ignored. Values become decimals and the month its last day.
    """
    by = list(by)
    numeric = F.trim("line").rlike(r"^[0-9]")
    rows = lines.where(F.col("line_no") >= skip).withColumn("_num", numeric)
    first = rows.groupBy(*by).agg(F.min(F.when(F.col("_num"), F.col("line_no"))).alias("_first"))
    marked = rows.join(first, by)
    stop = marked.where(~F.col("_num") & (F.col("line_no") > F.col("_first"))).groupBy(*by).agg(
        F.min("line_no").alias("_stop"))
    block = marked.join(stop, by, "left").where(
        F.col("_num") & (F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))))
    parts = F.split(F.trim("line"), r"\s*,\s*")
    month = F.last_day(F.to_date(F.substring(F.get(parts, F.lit(0)), 1, 6), "yyyyMM"))
    return block.select(*by, month.alias("date"), *(
        (F.get(parts, F.lit(i + 1)).try_cast("double") / 100).alias(n) for i, n in enumerate(names)))


def join_factors(base: DataFrame, momentum: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Five-factor series with momentum attached, within the dates."""
    from factorloom.sources.tables import date_range

    return date_range(base.join(momentum.select("date", "mom"), "date", "left"), start, end)


def read_macro_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Two-column series (date, value); values that are no number become null."""
    raw = spark.read.csv(path, header=True)
    d, v = raw.columns[:2]
    return raw.select(F.to_date(F.col(f"`{d}`")).alias("date"), F.col(f"`{v}`").try_cast("double").alias(name))


def monthly_macro(long_rate: DataFrame, short_rate: DataFrame, credit: DataFrame, vix: DataFrame) -> DataFrame:
    """Month-end macro table from (date, value) series: the last value of each month."""
    curve = long_rate.toDF("date", "l").join(short_rate.toDF("date", "s"), "date", "full_outer").select(
        "date", (F.col("l") - F.col("s")).alias("value"))
    parts = [df.toDF("date", "value").withColumn("series", F.lit(n))
             for n, df in (("yield_curve", curve), ("vix", vix), ("credit_spread", credit))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy(F.last_day("date").alias("date")).agg(*(
        F.max_by("value", F.when((F.col("series") == n) & F.col("value").isNotNull(), F.col("date"))).alias(n)
        for n in ("yield_curve", "vix", "credit_spread")))


# -------------------------------------------------------------------------------- filings

# Company fact documents have no fixed schema: namespaces, tags and units are keys, and a filer may
# add its own. They stay VARIANT until single figures are taken out of them.
_FIGURES = """
SELECT d.ticker, d.cik, n.key AS ns, t.key AS tag, u.key AS unit, r.pos AS seq, r.value AS figure
FROM {documents} AS d,
  LATERAL variant_explode(try_variant_get(d.doc, '$.facts', 'variant')) AS n,
  LATERAL variant_explode(n.value) AS t,
  LATERAL variant_explode(try_variant_get(t.value, '$.units', 'variant')) AS u,
  LATERAL variant_explode(u.value) AS r
WHERE n.key IS NOT NULL AND t.key IS NOT NULL AND u.key IS NOT NULL"""
_FIELDS = {"start": "date", "end": "date", "val": "double", "filed": "date", "form": "string"}


def read_filings(spark: SparkSession, path: str | Sequence[str], tickers: DataFrame) -> DataFrame:
    """Company fact documents -> filing records; ``tickers`` maps cik to ticker."""
    docs = spark.read.text(path, wholetext=True).withColumn("doc", F.try_parse_json("value"))
    rows = docs.select(pad_cik(F.expr("try_variant_get(doc, '$.cik', 'string')")).alias("cik"), "doc")
    return parse_filings(rows.join(tickers.select("cik", "ticker"), "cik"))[0]


def parse_filings(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, cik, doc) with a VARIANT doc -> filing records, and what had to be rejected.

    Records: one row per reported figure, in document order, whatever its namespace, tag or
    unit. Rejects: (ticker, cik, place, reason, body) for documents that are no JSON (doc is null) or
    have no object of facts, for entries that are no figures, and for figures with a field
    of the wrong type. A missing or null field is a null, not a fault.
    """
    spark = documents.sparkSession
    figures = spark.sql(_FIGURES, documents=documents.select("ticker", "cik", "doc"))
    raw = {c: F.expr(f"try_variant_get(figure, '$.{c}', 'variant')") for c in _FIELDS}
    typed = {c: F.expr(f"try_variant_get(figure, '$.{c}', '{kind}')") for c, kind in _FIELDS.items()}
    shaped = F.schema_of_variant("figure").startswith("OBJECT")
    wrong = [F.when(raw[c].isNotNull() & ~F.is_variant_null(raw[c]) & typed[c].isNull(), F.lit(c)) for c in _FIELDS]
    read = figures.withColumns(typed | {"_fault": F.when(~shaped, "no figure").otherwise(
        F.concat(F.lit("wrong type: "), F.nullif(F.concat_ws(", ", *wrong), F.lit(""))))})
    records = read.where(F.col("_fault").isNull()).select("ticker", "cik", "ns", "tag", "unit", F.col("seq").cast("int").alias("seq"), *_FIELDS)
    kind = F.schema_of_variant(F.expr("try_variant_get(doc, '$.facts', 'variant')"))
    broken = documents.withColumn("_fault", F.when(F.col("doc").isNull(), "no document").when(
        ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "no facts")).where(F.col("_fault").isNotNull())
    faulty = read.where(F.col("_fault").isNotNull())
    rejects = broken.select("ticker", "cik", F.lit("").alias("place"), F.col("_fault").alias("reason"), F.to_json("doc").alias("body")).unionByName(
        faulty.select("ticker", "cik", F.concat_ws("/", "ns", "tag", "unit", "seq").alias("place"), F.col("_fault").alias("reason"),
                      F.to_json("figure").alias("body")))
    return records, rejects


def parse_ticker_map(documents: DataFrame, text: str = "value") -> DataFrame:
    """Ticker directory document -> (ticker, cik) with clean tickers and padded numbers."""
    entry = F.from_json(text, "map<string, struct<cik_str: string, ticker: string>>")
    rows = documents.select(F.explode(entry).alias("k", "v"))
    return rows.select(clean_ticker(F.col("v.ticker")).alias("ticker"), pad_cik(F.col("v.cik_str")).alias("cik"))


def latest_filing_date(submissions: DataFrame, text: str = "value") -> DataFrame:
    """Submission documents (ticker, value) -> (ticker, latest_filing, sic)."""
    doc = F.from_json(text, "struct<sic: string, sicDescription: string, "
                            "filings: struct<recent: struct<filingDate: array<string>>>>")
    dates = F.transform("d.filings.recent.filingDate", lambda s: F.to_date(s))
    return submissions.select("ticker", doc.alias("d")).select(
        "ticker", F.array_max(dates).alias("latest_filing"), F.col("d.sic").alias("sic"),
        F.col("d.sicDescription").alias("industry"))


# ---------------------------------------------------------------------- broker positions

# Header words of position exports, in order of preference, and row marks.
TICKER_HEADERS = ["symbol", "ticker"]
SHARE_HEADERS = ["quantity", "shares", "qty"]
COST_HEADERS = ["cost basis total", "cost basis", "cost_basis", "total cost"]
VALUE_HEADERS = ["market value", "current value", "value"]
HEADER_LINE = r"(?i)\b(symbol|ticker)\b"
CASH_ROW = r"(?i)(?:cash|money market|sweep|core|\*\*|pending)"
TOTAL_ROW = r"(?i)(?:account total|^total$|^--$)"
_CSV_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_positions(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Many position exports at once; the file name is the account."""
    docs = read_documents(spark, path)
    name = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return parse_positions(lines_of(docs.select(name.alias("account_id"), "value")))


def _cells(line: Column) -> Column:
    clean = F.regexp_replace(line, "^﻿", "")
    return F.transform(F.split(clean, _CSV_SPLIT), lambda c: F.trim(F.regexp_replace(F.trim(c), r'^"|"$', "")))


def _first_match(header: Column, names: Sequence[str]) -> Column:
    """1-based index of the first preferred name present in the header, else null."""
    spots = [F.nullif(F.array_position(header, F.lit(n)), F.lit(0)) for n in names]
    return F.coalesce(*spots)


def parse_positions(lines: DataFrame) -> DataFrame:
    """Lines (account_id, line_no, line) -> (account_id, ticker, shares, cost_basis).

    The first line naming a symbol column is the header; lines before it are a preamble.
    Cash rows are folded into one ``$CASH`` row per account (shares = dollars, by market
    value); total rows are dropped. Accounts without a usable header have no rows (see
    :func:`unreadable_accounts`).
    """
    from factorloom.schema import CASH_TICKER

    rows = _position_rows(lines)
    ticker = F.upper(F.trim(F.col("_ticker")))
    kept = rows.where(F.col("_ticker").isNotNull() & (F.col("_ticker") != "")).withColumn("ticker", ticker)
    kept = kept.where(~F.col("ticker").rlike(TOTAL_ROW))
    is_cash = F.col("ticker").rlike(CASH_ROW) | F.col("_qty").isNull() | (F.col("_qty") == "")
    kept = kept.withColumn("_cash", is_cash)
    shares = accounting_number(F.col("_qty"))
    stock = kept.where(~F.col("_cash")).select(
        "account_id", F.replace("ticker", F.lit("."), F.lit("-")).alias("ticker"), shares.alias("shares"),
        accounting_number(F.col("_cost")).alias("cost_basis")).where(F.col("shares") > 0)
    cash = kept.where("_cash").select(
        "account_id", F.lit(CASH_TICKER).alias("ticker"), accounting_number(F.col("_value")).alias("shares"),
        F.lit(None).cast("double").alias("cost_basis"))
    return (stock.unionByName(cash).groupBy("account_id", "ticker")
            .agg(F.sum("shares").alias("shares"), F.sum("cost_basis").alias("cost_basis"))
            .where(F.col("shares").isNotNull()))


def _headers(lines: DataFrame) -> DataFrame:
    hits = lines.where(F.col("line").rlike(HEADER_LINE))
    first = hits.groupBy("account_id").agg(F.min(F.struct("line_no", "line")).alias("h"))
    names = F.transform(_cells(F.col("h.line")), lambda c: F.lower(F.trim(c)))
    return first.select("account_id", F.col("h.line_no").alias("_at"), names.alias("_names")).select(
        "account_id", "_at", _first_match(F.col("_names"), TICKER_HEADERS).alias("_it"),
        _first_match(F.col("_names"), SHARE_HEADERS).alias("_iq"),
        _first_match(F.col("_names"), COST_HEADERS).alias("_ic"),
        _first_match(F.col("_names"), VALUE_HEADERS).alias("_iv"))


def _position_rows(lines: DataFrame) -> DataFrame:
    heads = _headers(lines).where(F.col("_it").isNotNull() & F.col("_iq").isNotNull())
    # one short row per account is hashed; the lines are not sorted
    body = lines.join(heads.hint("shuffle_hash"), "account_id").where(F.col("line_no") > F.col("_at")).where(F.trim("line") != "")
    cell = lambda i: F.get("_cells", (F.col(i) - 1).cast("int"))
    return body.withColumn("_cells", _cells(F.col("line"))).select(
        "account_id", cell("_it").alias("_ticker"), cell("_iq").alias("_qty"),
        cell("_ic").alias("_cost"), cell("_iv").alias("_value"))


def unreadable_accounts(lines: DataFrame) -> DataFrame:
    """Accounts whose export has no line with both a symbol and a quantity column."""
    usable = _headers(lines).where(F.col("_it").isNotNull() & F.col("_iq").isNotNull())
    return lines.select("account_id").distinct().join(usable, "account_id", "left_anti")

