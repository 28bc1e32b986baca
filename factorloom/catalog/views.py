"""Market-shaped views over the star-schema tables, in Spark and in SQL.

The library works on bars, sectors, facts and so on; these adapters derive such frames from
``lineitem``, ``supplier`` and the other tables. Money is summed in whole cents, so both
engines get the same bits whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table written once per application to the shared scratch folder.

    Queries that start from a panel or from predictions share it, as they would share the
    stored tables of a deployment; it is read back from files, never from memory.
    """
    from factorloom.session import settle

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = settle(build(spark, sf_dir), name)
    return _STORED[key]


def forget_stored() -> None:
    """Make the next query derive its inputs again."""
    _STORED.clear()


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def _lines(spark, sf_dir, ticker=None, day=None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({
        "ticker": ticker if ticker is not None else F.col("l_suppkey"),
        "date": day if day is not None else F.col("l_shipdate").cast("date")})


def _dealt(lines: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The lines' needed columns, dealt once by the keys that the steps after them group by.

    Lines of one group hardly ever meet in one file split, so nothing would be combined before a shuffle.
    The partitions are many: groups and windows of a task then need little memory, and no bytes merge them.
    """
    from factorloom.session import fine_parts

    return lines.select(*dict.fromkeys([*keys, *values])).repartition(fine_parts(lines.sparkSession), *keys)


def _bars(lines: DataFrame) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = _dealt(lines, ["ticker"], "date", "l_extendedprice", "l_quantity")
    return lines.groupBy("ticker", "date").agg(
        (F.sum(cents("l_extendedprice")) / 100 / F.sum("l_quantity")).alias("close"),
        F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"))


def bars_d(spark, sf_dir) -> DataFrame:
    """Daily bars per supplier (sparse: about a fifth of the days trade)."""
    return _bars(_lines(spark, sf_dir))


def bars_w(spark, sf_dir) -> DataFrame:
    """Weekly sessions per group of five suppliers (nearly every session trades)."""
    group = F.floor(F.col("l_suppkey") / 5).cast("bigint") * 5
    return _bars(_lines(spark, sf_dir, group, F.trunc(F.col("l_shipdate").cast("date"), "WEEK")))


def close_m(spark, sf_dir) -> DataFrame:
    from factorloom.operators.prices import monthly_close

    return monthly_close(bars_d(spark, sf_dir))


def sectors(spark, sf_dir) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    label = F.when(F.col("s_nationkey") != 24, F.concat(F.lit("S"), F.col("n_regionkey").cast("string")))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("ticker"), label.alias("gics_sector"))


def n_names(spark, sf_dir) -> int:
    """Number of names: an upper bound on any cross-section, read from the footer."""
    return table(spark, sf_dir, "supplier").count()


def facts(spark, sf_dir) -> DataFrame:
    """Twelve concepts per supplier and quarter; ``l_linenumber`` plays the filing."""
    quarter = F.last_day(F.add_months(F.trunc("date", "QUARTER"), 2))
    li = _dealt(_lines(spark, sf_dir).withColumn("period_end", quarter), ["ticker", "period_end"],
                "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    pct = F.round(F.col("l_discount") * 100).cast("bigint") - 2
    base = li.groupBy("ticker", "period_end", F.col("l_linenumber").alias("k")).agg(
        (F.sum(cents("l_extendedprice")) / 100).alias("rev"),
        (F.sum(cents("l_extendedprice") * pct) / 10000).alias("ni"),
        F.sum("l_quantity").alias("qty"))
    c = F.col
    concepts = {
        "revenue": F.when(c("ticker") % 10 != 7, c("rev")), "net_income": c("ni"),
        "gross_profit": c("rev") * 0.5, "operating_income": c("ni") * 2, "dna": c("qty"),
        "op_cashflow": c("ni") + c("qty") * 100, "equity": c("rev") * 10, "assets": c("rev") * 20,
        "cash": c("rev") * 0.25, "debt_lt": F.when(c("k") != 2, c("rev") * 5), "debt_cur": c("rev"),
        "shares": c("qty") * 1000,
    }
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("concept"), v.alias("value"))
                                for n, v in concepts.items())))
    return base.select("ticker", "period_end", F.expr("date_add(period_end, 30 * k)").alias("filed_date"),
                       cells.alias("c")).select("ticker", "c.concept", "period_end", "filed_date", "c.value")


def macro_m(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("date")).agg(
        (F.sum(cents("o_totalprice")) / 100000 / F.count(F.lit(1))).alias("vix"),
        (F.max("o_totalprice") - F.min("o_totalprice")).alias("credit_spread"),
        (F.max("o_totalprice") / 1000).alias("yield_curve"))


def sessions(spark, sf_dir, unit: str) -> DataFrame:
    """Calendar of ship dates by day, week or month end, from that one column."""
    from factorloom.operators.calendar import calendar

    d = F.col("l_shipdate").cast("date")
    at = {"day": d, "week": F.trunc(d, "WEEK"), "month": F.last_day(d)}[unit]
    return calendar(table(spark, sf_dir, "lineitem").select(at.alias("date")))


def closes(spark, sf_dir) -> DataFrame:
    """The monthly closes as a stored table."""
    return stored(spark, sf_dir, "close_m", close_m)


def rets_m(spark, sf_dir) -> DataFrame:
    from factorloom.operators.prices import simple_returns

    return simple_returns(closes(spark, sf_dir)).select("ticker", "date", "close", "ret")


def preds(spark, sf_dir) -> DataFrame:
    """The predictions as a stored table."""
    return stored(spark, sf_dir, "preds", build_preds)


def build_preds(spark, sf_dir) -> DataFrame:
    """Score = mean return of six months; the newest month has no forward return."""
    from factorloom.functions.windows import Positional
    from factorloom.operators.calendar import calendar, densify

    raw = rets_m(spark, sf_dir)
    grid = densify(raw, calendar(raw))
    p = Positional()
    out = grid.withColumns({"pred": F.round(p.rolling_mean("ret", 6), 9), "forward_return": p.following("ret")})
    return out.where(F.col("pred").isNotNull()).select("date", "ticker", "pred", "forward_return")


def ff_m(spark, sf_dir) -> DataFrame:
    """Seven monthly factor series from return spreads between groups of names."""
    r = rets_m(spark, sf_dir).where(F.col("ret").isNotNull()).join(sectors(spark, sf_dir), "ticker", "left")

    def spread(a, b):
        return F.avg(F.when(a, F.col("ret"))) - F.avg(F.when(b, F.col("ret")))

    s, t = F.col("gics_sector"), F.col("ticker")
    return r.groupBy("date").agg(
        (F.avg("ret") - 0.001).alias("mkt_rf"), spread(s == "S0", s == "S1").alias("smb"),
        spread(s == "S2", s == "S3").alias("hml"), spread(t % 2 == 0, t % 2 == 1).alias("rmw"),
        spread(t % 3 == 0, t % 3 == 1).alias("cma"), spread(t % 5 == 0, t % 5 == 1).alias("mom"),
        F.lit(0.001).alias("rf"))


def filings(spark, sf_dir) -> DataFrame:
    """Year-to-date and three-month records per supplier, restated by later filings."""
    li = _lines(spark, sf_dir).where(F.col("date").isNotNull())
    base = li.groupBy("ticker", F.year("date").alias("y"), F.quarter("date").alias("q"),
                      (F.col("l_linenumber") % 3).alias("m")).agg(F.sum(cents("l_extendedprice")).alias("v"))
    w = Window.partitionBy("ticker", "y", "m").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("ytd", F.sum("v").over(w)).withColumns({
        "qs": F.make_date("y", F.col("q") * 3 - 2, F.lit(1)), "ys": F.make_date("y", F.lit(1), F.lit(1))})
    base = base.withColumn("end", F.last_day(F.add_months("qs", 2))).withColumns({
        "filed": F.expr("date_add(end, 40 + 45 * m)"),
        "form": F.when(F.col("q") == 4, "10-K").otherwise("10-Q")})
    ytd = base.select("ticker", F.lit("revenue").alias("concept"), F.col("ys").alias("start"), "end",
                      (F.col("ytd") / 100).alias("val"), "filed", "form")
    quarter = base.where("q < 4 AND ticker % 2 = 1 AND m < 2").select(
        "ticker", F.lit("revenue").alias("concept"), F.col("qs").alias("start"), "end",
        (F.col("v") / 100).alias("val"), "filed", "form")
    return ytd.unionByName(quarter)


# ------------------------------------------------------------------- the same views as SQL

_BARS = """SELECT {t} AS ticker, {d} AS date,
  SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 / SUM(l_quantity) AS close,
  MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low,
  SUM(l_quantity) AS volume FROM lineitem GROUP BY 1, 2"""

SQL_VIEWS: dict[str, str] = {
    "bars_d": _BARS.format(t="l_suppkey", d="CAST(l_shipdate AS DATE)"),
    "bars_w": _BARS.format(t="(l_suppkey // 5) * 5",
                           d="CAST(date_trunc('week', l_shipdate) AS DATE)"),
    "close_m": "SELECT ticker, last_day(date) AS date, arg_max(close, date) AS close FROM bars_d GROUP BY 1, 2",
    "sectors": """SELECT s_suppkey AS ticker,
  CASE WHEN s_nationkey <> 24 THEN 'S' || n_regionkey END AS gics_sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "fact_base": """SELECT l_suppkey AS ticker,
  last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
  l_linenumber AS k, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 AS rev,
  SUM(CAST(round(l_extendedprice * 100) AS BIGINT) * (CAST(round(l_discount * 100) AS BIGINT) - 2)) / 10000 AS ni,
  SUM(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3""",
    "facts": """SELECT ticker, concept, CAST(period_end AS DATE) AS period_end,
  CAST(period_end + CAST(30 * k AS INTEGER) AS DATE) AS filed_date,
  CASE concept WHEN 'revenue' THEN CASE WHEN ticker % 10 <> 7 THEN rev END
    WHEN 'net_income' THEN ni WHEN 'gross_profit' THEN rev * 0.5
    WHEN 'operating_income' THEN ni * 2 WHEN 'dna' THEN qty WHEN 'op_cashflow' THEN ni + qty * 100
    WHEN 'equity' THEN rev * 10 WHEN 'assets' THEN rev * 20 WHEN 'cash' THEN rev * 0.25
    WHEN 'debt_lt' THEN CASE WHEN k <> 2 THEN rev * 5 END WHEN 'debt_cur' THEN rev
    ELSE qty * 1000 END AS value
  FROM fact_base CROSS JOIN (VALUES ('revenue'), ('net_income'), ('gross_profit'), ('operating_income'),
    ('dna'), ('op_cashflow'), ('equity'), ('assets'), ('cash'), ('debt_lt'), ('debt_cur'), ('shares')) AS c(concept)""",
    "macro_m": """SELECT last_day(CAST(o_orderdate AS DATE)) AS date,
  SUM(CAST(round(o_totalprice * 100) AS BIGINT)) / 100000 / COUNT(*) AS vix,
  MAX(o_totalprice) - MIN(o_totalprice) AS credit_spread, MAX(o_totalprice) / 1000 AS yield_curve
  FROM orders GROUP BY 1""",
    "grid_m": """SELECT a.ticker, b.date FROM (SELECT DISTINCT ticker FROM close_m) AS a
  CROSS JOIN (SELECT DISTINCT date FROM close_m) AS b""",
    "rets_m": """SELECT g.ticker, g.date, p.close,
  p.close / lag(p.close) OVER (PARTITION BY g.ticker ORDER BY g.date) - 1 AS ret
  FROM grid_m AS g LEFT JOIN close_m AS p ON p.ticker = g.ticker AND p.date = g.date""",
    "preds": """SELECT date, ticker, round(m, 9) AS pred, fwd AS forward_return FROM (
  SELECT date, ticker, AVG(ret) OVER w6 AS m, COUNT(ret) OVER w6 AS n,
    lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS fwd
  FROM rets_m WINDOW w6 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) AS q
  WHERE n = 6""",
    "ff_m": """SELECT r.date, AVG(r.ret) - 0.001 AS mkt_rf,
  AVG(CASE WHEN s.gics_sector = 'S0' THEN r.ret END) - AVG(CASE WHEN s.gics_sector = 'S1' THEN r.ret END) AS smb,
  AVG(CASE WHEN s.gics_sector = 'S2' THEN r.ret END) - AVG(CASE WHEN s.gics_sector = 'S3' THEN r.ret END) AS hml,
  AVG(CASE WHEN r.ticker % 2 = 0 THEN r.ret END) - AVG(CASE WHEN r.ticker % 2 = 1 THEN r.ret END) AS rmw,
  AVG(CASE WHEN r.ticker % 3 = 0 THEN r.ret END) - AVG(CASE WHEN r.ticker % 3 = 1 THEN r.ret END) AS cma,
  AVG(CASE WHEN r.ticker % 5 = 0 THEN r.ret END) - AVG(CASE WHEN r.ticker % 5 = 1 THEN r.ret END) AS mom,
  CAST(0.001 AS DOUBLE) AS rf
  FROM rets_m AS r LEFT JOIN sectors AS s ON s.ticker = r.ticker WHERE r.ret IS NOT NULL GROUP BY r.date""",
    "filings_base": """SELECT ticker, y, q, m, v, SUM(v) OVER (PARTITION BY ticker, y, m ORDER BY q) AS ytd,
  make_date(y, q * 3 - 2, 1) AS qs, make_date(y, 1, 1) AS ys,
  last_day(make_date(y, q * 3, 1)) AS qe
  FROM (SELECT l_suppkey AS ticker, year(l_shipdate) AS y, quarter(l_shipdate) AS q, l_linenumber % 3 AS m,
    CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v
    FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2, 3, 4) AS b""",
    "filings": """SELECT ticker, ys AS start, qe AS "end", ytd / 100 AS val,
  CAST(qe + CAST(40 + 45 * m AS INTEGER) AS DATE) AS filed, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form
  FROM filings_base UNION ALL
  SELECT ticker, qs, qe, v / 100, CAST(qe + CAST(40 + 45 * m AS INTEGER) AS DATE),
  CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END FROM filings_base WHERE q < 4 AND ticker % 2 = 1 AND m < 2""",
}

_DEPENDS = {
    "close_m": ["bars_d"], "facts": ["fact_base"], "grid_m": ["close_m"], "rets_m": ["grid_m", "close_m"],
    "preds": ["rets_m"], "ff_m": ["rets_m", "sectors"], "filings": ["filings_base"],
}


def with_views(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the named views (and what they need) as CTEs."""
    ordered: list[str] = []

    def visit(name):
        for d in _DEPENDS.get(name, []):
            visit(d)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    ctes = [f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in ordered]
    ctes += [f"{n} AS MATERIALIZED ({q})" for n, q in (extra or {}).items()]
    return "WITH " + ",\n".join(ctes) + "\n" + query
