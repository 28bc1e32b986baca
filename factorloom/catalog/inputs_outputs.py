"""Registered queries: file formats, filings, sinks, checks and incremental loads.

File formats are exercised on text that Spark renders from the tables, so parsing grows
with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.catalog import views as v
from factorloom.catalog.base import ORACLES, query, r, rounded, rs
from factorloom.catalog.market import fund_table, panel_table
from factorloom.catalog.sqlparts import FUND_CTES, PANEL_CTES, PANEL_VIEWS
from factorloom.catalog.views import with_views
from factorloom.functions import scalars
from factorloom.operators import facts as fx
from factorloom.operators import quality
from factorloom.sinks import tables as sink
from factorloom.sources import files, tables
from factorloom.session import scratch_dir, settle

# ----------------------------------------------------------------------------------- filings


@query("instant_changepoints", """WITH rec AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS e,
    CAST(l_shipdate AS DATE) + CAST(20 + 30 * (l_linenumber % 4) AS INTEGER) AS filed, round(l_quantity / 25) AS val,
    CASE WHEN l_linestatus = 'O' THEN '10-K' ELSE '' END AS form FROM lineitem),
  snapped AS (SELECT *, CASE WHEN date_diff('day', CAST(date_trunc('quarter', e) - INTERVAL 1 DAY AS DATE), e)
      < date_diff('day', e, CAST(date_trunc('quarter', e) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE))
    THEN CAST(date_trunc('quarter', e) - INTERVAL 1 DAY AS DATE)
    ELSE CAST(date_trunc('quarter', e) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS q FROM rec),
  states AS (SELECT ticker, q, filed, arg_max(val, (e, val)) AS val FROM snapped GROUP BY 1, 2, 3),
  forms AS (SELECT ticker, filed, arg_max(form, (e, val)) FILTER (WHERE form <> '') AS form FROM snapped GROUP BY 1, 2),
  pts AS (SELECT *, lag(val) OVER (PARTITION BY ticker, q ORDER BY filed) AS prev FROM states)
  SELECT ticker, 'equity' AS concept, q AS period_end, CAST(filed AS DATE) AS filed_date, val AS value, coalesce(form, '') AS form
  FROM pts LEFT JOIN forms USING (ticker, filed) WHERE prev IS NULL OR prev <> val""")
def instant_changepoints(spark, sf):
    li = v.table(spark, sf, "lineitem")
    end = F.col("l_shipdate").cast("date")
    rec = li.select(F.col("l_suppkey").alias("ticker"), F.lit("equity").alias("concept"), end.alias("end"),
                    F.round(F.col("l_quantity") / 25).alias("val"),
                    F.expr("date_add(cast(l_shipdate as date), 20 + 30 * (l_linenumber % 4))").alias("filed"),
                    F.when(F.col("l_linestatus") == "O", "10-K").otherwise("").alias("form"))
    return fx.instant_changepoints(rec)


# All year-to-date chains start in January, so a quarter has one chain and one direct value.
_FLOW = {
    "cum": """SELECT DISTINCT ticker, start, "end" AS q, filed, val FROM filings WHERE start = make_date(year(start), 1, 1)
  AND date_diff('day', start, "end") <= 380""",
    "three": """SELECT ticker, "end" AS q, filed, max(val) AS direct FROM filings
  WHERE date_diff('day', start, "end") BETWEEN 80 AND 100 GROUP BY 1, 2, 3""",
    # a chain's entries at each filing day of the chain, as known that day
    "days": "SELECT DISTINCT ticker, start, filed FROM cum",
    "known": """SELECT d.ticker, d.start, d.filed, c.q, arg_max(c.val, c.filed) AS val FROM days AS d JOIN cum AS c
  ON c.ticker = d.ticker AND c.start = d.start AND c.filed <= d.filed GROUP BY 1, 2, 3, 4""",
    "stepped": """SELECT ticker, filed, q, val - coalesce(lag(val) OVER (PARTITION BY ticker, start, filed ORDER BY q), 0) AS d FROM known""",
    "events": """SELECT ticker, q, filed FROM stepped UNION SELECT ticker, q, filed FROM three""",
    "states": """SELECT e.ticker, e.q, e.filed, coalesce(t.direct, s.d) AS val FROM events AS e
  ASOF LEFT JOIN three AS t ON t.ticker = e.ticker AND t.q = e.q AND e.filed >= t.filed
  ASOF LEFT JOIN stepped AS s ON s.ticker = e.ticker AND s.q = e.q AND e.filed >= s.filed""",
    "forms": """SELECT ticker, filed, arg_max(form, "end") AS form FROM filings GROUP BY 1, 2""",
    "pts": "SELECT *, lag(val) OVER (PARTITION BY ticker, q ORDER BY filed) AS prev FROM states",
}

@query("flow_changepoints", with_views("""SELECT ticker, 'revenue' AS concept, q AS period_end, filed AS filed_date,
    round(val, 2) + 0.0 AS value, form FROM pts JOIN forms USING (ticker, filed) WHERE prev IS NULL OR prev <> val""",
                                       "filings", extra=_FLOW))
def flow_changepoints(spark, sf):
    return rounded(fx.flow_changepoints(v.filings(spark, sf)), 2)


@query("flow_changepoints_stream", ORACLES["flow_changepoints"])
def flow_changepoints_stream(spark, sf):
    """Filings land in files that each mix all days; two starts of a stateful stream keep the table of change points."""
    from factorloom.streaming.filings import ingest_flow_changepoints, rocksdb_state
    from factorloom.streaming.incremental import file_stream

    base = scratch_dir(spark, "filings")
    records = settle(v.filings(spark, sf).withColumn("part", F.pmod(F.xxhash64("ticker", "start", "end", "filed"), F.lit(6))), "records")
    with rocksdb_state(spark):
        for parts in ("part < 4", "part >= 4"):
            records.where(parts).drop("part").repartition(2, F.xxhash64("end", "ticker")).write.mode("append").parquet(f"{base}/landed")
            stream = file_stream(spark, f"{base}/landed", records.drop("part").schema, max_files=2)
            ingest_flow_changepoints(stream, f"{base}/points", f"{base}/checkpoint")
    return rounded(sink.read_table(spark, f"{base}/points").drop("year"), 2)


@query("guarded_facts", """SELECT replace(upper(c_name), '#', '-') AS ticker, CASE WHEN c_custkey % 3 = 0 THEN 2 * c_acctbal ELSE c_acctbal END AS value FROM customer""")
def guarded_facts(spark, sf):
    """Two good batches of facts are written, and a bad one in between is refused whole."""
    path = f"{scratch_dir(spark, 'facts')}/facts"
    c, end = v.table(spark, sf, "customer"), F.lit("2000-06-30").cast("date")
    rows = c.select(
        F.upper(F.regexp_replace("c_name", "#", "-")).alias("ticker"), scalars.pad_cik(F.col("c_custkey")).alias("cik"), F.lit("revenue").alias("concept"),
        F.lit("Revenues").alias("gaap_tag"), end.alias("period_end"), F.lit("Q2").alias("fiscal_period"), F.lit(91).alias("duration_days"),
        end.alias("filed_date"), F.lit("10-Q").alias("form"), F.col("c_acctbal").alias("value"), F.lit("USD").alias("unit"))
    sink.write_facts(spark, path, rows)
    again = rows.where(F.col("cik").cast("long") % 3 == 0).withColumn("value", 2 * F.col("value"))
    try:
        sink.write_facts(spark, path, rows.withColumns({"value": F.lit(0.0), "cik": F.when(F.col("cik").cast("long") % 7 > 0, F.col("cik")).otherwise("7")}))
        raise AssertionError("a bad batch was written")
    except ValueError:
        sink.write_facts(spark, path, again)
    return sink.read_table(spark, path).select("ticker", "value")


def _tagged(spark, sf):
    """Filing records under competing tags: two tags, two units, two namespaces."""
    rec = v.filings(spark, sf).drop("concept")
    t = F.col("ticker")
    return rec.withColumns({
        "cik": scalars.pad_cik(t), "ns": F.when(t % 5 == 0, "dei").otherwise("us-gaap"),
        "tag": F.when(t % 3 == 0, "SalesRevenueNet").when(t % 3 == 1, "Revenues").otherwise("Unrelated"),
        "unit": F.when(t % 4 == 0, "shares").otherwise("USD"), "ticker": F.col("ticker").cast("string")})


@query("match_concepts", with_views("""SELECT CAST(ticker AS VARCHAR) AS ticker, 'revenue' AS concept,
    CASE WHEN ticker % 3 = 0 THEN 'SalesRevenueNet' ELSE 'Revenues' END AS tag, count(*) AS n
  FROM filings WHERE ticker % 3 <> 2 GROUP BY 1, 2, 3
  UNION ALL SELECT CAST(ticker AS VARCHAR), 'revenue', 'RevenueFromContractWithCustomerExcludingAssessedTax', count(*)
  FROM filings WHERE ticker % 3 = 2 GROUP BY 1""", "filings"))
def match_concepts(spark, sf):
    rec = _tagged(spark, sf)
    better = rec.where("tag = 'Unrelated'").withColumn("tag", F.lit("RevenueFromContractWithCustomerExcludingAssessedTax"))
    matched = fx.match_concepts(rec.unionByName(better))
    return matched.groupBy("ticker", "concept", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("extract_facts", with_views("""SELECT CAST(ticker AS VARCHAR) AS ticker, lpad(CAST(ticker AS VARCHAR), 10, '0') AS cik,
    'revenue' AS concept, CASE WHEN ticker % 3 = 0 THEN 'SalesRevenueNet' ELSE 'Revenues' END AS gaap_tag, q AS period_end,
    concat('Q', quarter(q)) AS fiscal_period, 91 AS duration_days, filed AS filed_date, form,
    round(val, 2) + 0.0 AS value, CASE WHEN ticker % 4 = 0 THEN 'shares' ELSE 'USD' END AS unit
  FROM pts JOIN forms USING (ticker, filed) WHERE ticker % 3 <> 2 AND (prev IS NULL OR prev <> val)""", "filings", extra=_FLOW))
def extract_facts(spark, sf):
    return rounded(fx.extract_facts(_tagged(spark, sf)), 2)


@query("filing_documents", with_views("""SELECT CAST(ticker AS VARCHAR) AS ticker, lpad(CAST(ticker AS VARCHAR), 10, '0') AS cik,
    'us-gaap' AS ns, 'Revenues' AS tag, 'USD' AS unit, start, "end", val, filed, form FROM filings""", "filings"))
def filing_documents(spark, sf):
    """Records -> one JSON document per company -> records again."""
    return files.parse_filings(_documents(spark, sf))[0].drop("seq")


@query("odd_filing_documents", with_views("""SELECT CAST(ticker AS VARCHAR) AS ticker, 'own-' || ticker % 7 AS ns, 'USD' AS unit, val, filed
  FROM filings WHERE ticker % 11 <> 0 AND form <> '10-K'""", "filings"))
def odd_filing_documents(spark, sf):
    """Namespaces that filers make up are read; a tenth of the documents is cut off, yearly figures are no numbers."""
    return files.parse_filings(_documents(spark, sf, odd=True))[0].select("ticker", "ns", "unit", "val", "filed")


@query("filing_rejects", with_views("""SELECT CAST(ticker AS VARCHAR) AS ticker, 'wrong type: val' AS reason, count(*) AS n FROM filings
  WHERE ticker % 11 <> 0 AND form = '10-K' GROUP BY 1
  UNION ALL SELECT DISTINCT CAST(ticker AS VARCHAR), 'no document', 1 FROM filings WHERE ticker % 11 = 0""", "filings"))
def filing_rejects(spark, sf):
    rejects = files.parse_filings(_documents(spark, sf, odd=True))[1]
    return rejects.groupBy("ticker", "reason").agg(F.count(F.lit(1)).alias("n"))


def _documents(spark, sf, odd=False):
    """One JSON document per company."""
    rec = v.filings(spark, sf)
    text = lambda c: F.col(c).cast("string")
    val = F.when(F.col("form") == "10-K", F.concat(F.lit("about "), text("val"))).otherwise(text("val")) if odd else F.col("val")
    item = F.struct(text("start").alias("start"), text("end").alias("end"), val.alias("val"), text("filed").alias("filed"), "form")
    per = rec.groupBy("ticker").agg(F.collect_list(item).alias("items"))  # one company's filing days
    ns = F.concat(F.lit("own-"), F.col("ticker") % 7) if odd else F.lit("us-gaap")
    facts = F.create_map(ns, F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("items")).alias("units"))))
    value = F.to_json(F.struct(text("ticker").alias("cik"), facts.alias("facts")))
    if odd:
        value = F.when(F.col("ticker") % 11 == 0, F.substr(value, F.lit(1), F.lit(60))).otherwise(value)
    return per.select(text("ticker").alias("ticker"), scalars.pad_cik(F.col("ticker")).alias("cik"), F.try_parse_json(value).alias("doc"))


@query("latest_filing", """SELECT CAST(o_custkey AS VARCHAR) AS ticker, max(CAST(o_orderdate AS DATE)) AS latest_filing FROM orders GROUP BY 1""")
def latest_filing(spark, sf):
    o = v.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    per = o.groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(F.collect_set(day).alias("d"))
    recent = F.struct(F.struct(F.col("d").alias("filingDate")).alias("recent"))
    docs = per.select("ticker", F.to_json(F.struct(F.lit("100").alias("sic"), recent.alias("filings"))).alias("value"))
    return files.latest_filing_date(docs).select("ticker", "latest_filing")


@query("tickers_to_refresh", """WITH st AS (SELECT o_custkey AS t, max(CAST(o_orderdate AS DATE)) AS f FROM orders
    WHERE o_orderstatus = 'F' GROUP BY 1), su AS (SELECT o_custkey AS t, max(CAST(o_orderdate AS DATE)) AS f FROM orders
    WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
  SELECT c_custkey AS ticker FROM customer LEFT JOIN st ON st.t = c_custkey LEFT JOIN su ON su.t = c_custkey
  WHERE st.f IS NULL OR su.f IS NULL OR su.f > st.f""")
def tickers_to_refresh(spark, sf):
    o = v.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    stored = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("ticker"), day.alias("filed_date"))
    subs = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("ticker"), day.alias("latest_filing"))
    return fx.tickers_to_refresh(v.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker")), stored, subs)


# ------------------------------------------------------------------------------ file formats


@query("ticker_map", """SELECT upper(replace(trim(' n' || s_suppkey || '.a '), '.', '-')) AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier""")
def ticker_map(spark, sf):
    s = v.table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    entry = F.create_map(k, F.struct(k.alias("cik_str"), F.concat(F.lit(" n"), k, F.lit(".a ")).alias("ticker")))
    return files.parse_ticker_map(s.select(F.to_json(entry).alias("value")))


@query("listing_file", """SELECT 'P' || p_partkey AS ticker, p_name AS name, 'NASDAQ' AS exchange,
    CASE WHEN p_size % 11 = 0 THEN 'Y' ELSE 'N' END AS test_issue, CASE WHEN p_size % 7 = 0 THEN 'Y' ELSE 'N' END AS etf FROM part""")
def listing_file(spark, sf):
    p = v.table(spark, sf, "part")
    flag = lambda m: F.when(F.col("p_size") % m == 0, "Y").otherwise("N")
    raw = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Symbol"), F.col("p_name").alias("Security Name"),
                   flag(11).alias("Test Issue"), flag(7).alias("ETF"))
    footer = p.where("p_partkey % 500 = 0").select(
        F.lit("File Creation Time: 0101").alias("Symbol"), *(F.lit(None).cast("string").alias(c) for c in raw.columns[1:]))
    return files.parse_listing(raw.unionByName(footer), "nasdaq")


@query("factor_file", f"""SELECT o_orderpriority AS file, last_day(CAST(o_orderdate AS DATE)) AS date,
    {r("count(*) / 100.0", 'mkt_rf')}, {r("CAST(max(o_orderkey) % 100 AS DOUBLE) / 100.0", 'rf')} FROM orders GROUP BY 1, 2""")
def factor_file(spark, sf):
    """One text file per priority: preamble, monthly block, blank line, annual block."""
    o = v.table(spark, sf, "orders").withColumn("m", F.date_format("o_orderdate", "yyyyMM"))
    month = o.groupBy(F.col("o_orderpriority").alias("file"), "m").agg(
        F.count(F.lit(1)).alias("n"), (F.max("o_orderkey") % 100).alias("k"))
    index = (F.substring("m", 1, 4).cast("int") - 1990) * 12 + F.substring("m", 5, 2).cast("int")
    lines = month.select("file", (index + 10).alias("line_no"), F.concat_ws(", ", F.concat(F.lit("  "), "m"), F.col("n").cast("string"), F.col("k").cast("string")).alias("line"))
    names = month.select("file").distinct()
    extra = names.select("file", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("This file was created").alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.lit(",Mkt-RF,RF").alias("line")),
        F.struct(F.lit(5000).alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(5001).alias("line_no"), F.lit("  1995, 1, 1").alias("line")))).alias("x")).select("file", "x.*")
    return rounded(files.parse_factor_lines(lines.unionByName(extra), ["mkt_rf", "rf"]))


@query("monthly_macro", f"""SELECT last_day(d) AS date, {r("arg_max(CASE WHEN ok THEN hi - lo END, d) FILTER (WHERE ok)", 'yield_curve', 4)},
    {r("arg_max(hi, d) FILTER (WHERE ok)", 'vix', 4)}, {r("arg_max(lo, d)", 'credit_spread', 4)}
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS hi, min(o_totalprice) AS lo, max(o_orderkey) % 3 <> 0 AS ok
    FROM orders GROUP BY 1) GROUP BY 1""")
def monthly_macro(spark, sf):
    """Daily text series with '.' for missing values -> month-end table."""
    d = v.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), (F.max("o_orderkey") % 3 != 0).alias("ok"))
    text = d.withColumns({"hi_t": F.when(F.col("ok"), F.col("hi").cast("string")).otherwise("."), "lo_t": F.col("lo").cast("string")})
    series = lambda c: text.select("date", F.col(c).try_cast("double").alias("value"))
    return rounded(files.monthly_macro(series("hi_t"), series("lo_t"), series("lo_t"), series("hi_t")), 4)


_POS = """WITH p AS (SELECT o_custkey AS account_id, 'T.' || (o_orderkey % 40) AS sym, floor(o_totalprice / 1000) AS sh, o_totalprice AS cost,
    o_orderpriority FROM orders)
  SELECT account_id, replace(sym, '.', '-') AS ticker, round(sum(sh), 4) AS shares, round(sum(cost), 2) + 0.0 AS cost_basis FROM p
  WHERE o_orderpriority <> '5-LOW' AND sh > 0 GROUP BY 1, 2
  UNION ALL SELECT account_id, '$CASH', round(sum(CASE WHEN account_id % 2 = 0 THEN -cost ELSE cost END), 2) + 0.0, NULL FROM p WHERE o_orderpriority = '5-LOW' GROUP BY 1"""


@query("position_exports", _POS)
def position_exports(spark, sf):
    """One broker export per customer, in two header families, parsed in one job."""
    o = v.table(spark, sf, "orders").withColumn("account_id", F.col("o_custkey"))
    money = lambda c: F.concat(F.lit('"$'), F.format_number(c, 2), F.lit('"'))
    even = F.col("account_id") % 2 == 0
    sym = F.concat(F.lit("T."), (F.col("o_orderkey") % 40).cast("string"))
    qty = F.concat(F.lit('"'), F.format_number(F.floor(F.col("o_totalprice") / 1000), 0), F.lit('"'))
    cash = F.col("o_orderpriority") == "5-LOW"
    value = F.when(even, F.concat(F.lit('"($'), F.format_number("o_totalprice", 2), F.lit(')"'))).otherwise(money("o_totalprice"))
    a = F.concat_ws(",", F.when(cash, "Cash & Cash Investments").otherwise(sym), F.when(cash, "--").otherwise(qty),
                    F.when(cash, value).otherwise(money("o_totalprice")), F.when(cash, "--").otherwise(money("o_totalprice")))
    b = F.concat_ws(",", F.when(cash, "CORE**").otherwise(sym), F.lit("some name"), F.when(cash, "").otherwise(qty),
                    F.when(cash, "").otherwise(money("o_totalprice")), F.when(cash, value).otherwise(money("o_totalprice")))
    rows = o.select("account_id", (F.col("o_orderkey") + 10).alias("line_no"), F.when(even, a).otherwise(b).alias("line"))
    accounts = o.select("account_id").distinct()
    head = F.when(even, "Symbol,Quantity,Market Value,Cost Basis").otherwise("Symbol,Description,Quantity,Cost Basis Total,Current Value")
    frame = accounts.select("account_id", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("Positions for account ...1").alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(2).alias("line_no"), head.alias("line")),
        F.struct(F.lit(2_000_000_000).alias("line_no"), F.lit("Account Total,1,$9,$9").alias("line")))).alias("x")).select(
        "account_id", F.col("x.line_no").cast("bigint").alias("line_no"), "x.line")
    out = files.parse_positions(rows.unionByName(frame))
    return out.withColumns({"shares": F.round("shares", 4), "cost_basis": F.round("cost_basis", 2)}).withColumn(
        "shares", F.when(F.col("ticker") == "$CASH", F.round("shares", 2)).otherwise(F.col("shares")))


@query("holdings_snapshot", f"""WITH h AS ({_POS}) SELECT account_id, ticker, shares, cost_basis, DATE '2001-12-01' AS as_of FROM h
  UNION ALL SELECT account_id, '$CASH', 0.0, NULL, DATE '2001-12-01' FROM h GROUP BY 1 HAVING count(*) FILTER (ticker = '$CASH') = 0""")
def holdings_snapshot(spark, sf):
    return sink.holdings_rows(position_exports(spark, sf), "2001-12-01")


@query("accounting_numbers", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN NULL ELSE floor(o_totalprice) END AS amount FROM orders""")
def accounting_numbers(spark, sf):
    o = v.table(spark, sf, "orders")
    k, p = F.col("o_orderkey") % 4, F.col("o_totalprice")
    text = (F.when(k == 0, F.concat(F.lit("$"), F.format_number(p, 2))).when(k == 1, F.concat(F.lit(" ("), F.format_number(p, 2), F.lit(") ")))
            .when(k == 2, F.lit("--")).otherwise(F.format_number(F.floor(p), 0)))
    return o.select("o_orderkey", scalars.accounting_number(text).alias("amount"))


@query("clean_labels", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS label,
    upper(replace(trim(' ' || c_name || '.x '), '.', '-')) AS ticker, TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END || c_custkey AS INTEGER) AS n FROM customer""")
def clean_labels(spark, sf):
    c = v.table(spark, sf, "customer")
    k = F.col("c_custkey")
    junk = F.when(k % 10 == 0, "NaN").when(k % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", scalars.junk_to_null(junk).alias("label"),
                    scalars.clean_ticker(F.concat(F.lit(" "), "c_name", F.lit(".x "))).alias("ticker"),
                    scalars.safe_int(F.concat(F.when(k % 3 == 0, "x").otherwise(""), k.cast("string"))).alias("n"))


# ------------------------------------------------------------------------------ SQL and sinks


@query("sql_placeholders", with_views("SELECT gics_sector, count(*) AS n, max(date) AS last_date FROM close_m JOIN sectors USING (ticker) GROUP BY 1", "close_m", "sectors"))
def sql_placeholders(spark, sf):
    return tables.sql(spark, "SELECT gics_sector, count(*) AS n, max(date) AS last_date FROM {prices} JOIN {sectors} USING (ticker) GROUP BY 1",
                      prices=v.closes(spark, sf), sectors=v.sectors(spark, sf))


@query("bound_parameters", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '2-HIGH' GROUP BY 1")
def bound_parameters(spark, sf):
    v.table(spark, sf, "orders").createOrReplaceTempView("orders_in")
    return tables.read_sql(spark, "SELECT o_orderstatus, count(*) AS n FROM orders_in WHERE o_orderdate >= cast(:d AS timestamp_ntz) AND o_orderpriority = :p GROUP BY 1",
                           d="1998-01-01", p="2-HIGH")


@query("keyed_upsert", """SELECT c_custkey, CASE WHEN u.k IS NOT NULL THEN u.bal ELSE c_acctbal END AS c_acctbal,
    CASE WHEN u.k IS NOT NULL THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (
    SELECT o_custkey AS k, max(o_totalprice) AS bal FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) AS u ON u.k = c_custkey""")
def keyed_upsert(spark, sf):
    target = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    upd = v.table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal")).withColumn("c_mktsegment", F.lit("NEW"))
    return sink.upsert(target, upd, ["c_custkey"])


@query("column_scoped_upsert", """SELECT coalesce(c.c_custkey, u.k) AS c_custkey, c_name, CASE WHEN u.k IS NOT NULL THEN u.seg ELSE c_mktsegment END AS c_mktsegment
  FROM customer AS c FULL OUTER JOIN (SELECT o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 1000000 ELSE 0 END AS k,
    max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS seg FROM orders GROUP BY 1) AS u ON u.k = c.c_custkey""")
def column_scoped_upsert(spark, sf):
    target = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.col("o_custkey") + F.when(F.col("o_orderkey") % 97 == 0, 1000000).otherwise(0)
    upd = v.table(spark, sf, "orders").groupBy(key.alias("c_custkey")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("c_mktsegment"))
    return sink.column_scoped_upsert(target, upd, ["c_custkey"])


@query("nans_to_nulls", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def nans_to_nulls(spark, sf):
    e = v.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return scalars.nans_to_nulls(e)


@query("renamed_macro", with_views(f"SELECT date, {rs(['vix', 'credit_spread'], 4)} FROM macro_m", "macro_m"))
def renamed_macro(spark, sf):
    old = v.macro_m(spark, sf).withColumnRenamed("credit_spread", "hy_spread")
    return rounded(tables.renamed_macro(old).select("date", "vix", "credit_spread"), 4)


@query("replaced_slices", """SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN max(o_totalprice) ELSE min(o_totalprice) END AS px
  FROM orders GROUP BY 1, 2""")
def replaced_slices(spark, sf):
    """Write all slices, then replace one priority's slices only, and read back."""
    o, path = v.table(spark, sf, "orders"), scratch_dir(spark, "slices")
    keys = ["o_orderstatus", "o_orderpriority"]
    sink.replace_slices(o.groupBy(*keys).agg(F.min("o_totalprice").alias("px")), path, keys)
    sink.replace_slices(o.where("o_orderpriority = '1-URGENT'").groupBy(*keys).agg(F.max("o_totalprice").alias("px")), path, keys)
    return spark.read.parquet(path).select(*(F.col(k).cast("string").alias(k) for k in keys), "px")


@query("recommendation_rows", with_views("""SELECT date AS as_of, 'm-1' AS model_version, CAST(row_number() OVER (ORDER BY pred DESC, ticker) AS INTEGER) AS rank,
    ticker, gics_sector, pred AS score FROM preds LEFT JOIN sectors USING (ticker) WHERE date = (SELECT max(date) FROM preds)""", "preds", "sectors"))
def recommendation_rows(spark, sf):
    from factorloom.models.training import cross_section_at, rank_cross_section

    cross = cross_section_at(v.preds(spark, sf)).join(v.sectors(spark, sf), "ticker", "left")
    return sink.recommendation_rows(rank_cross_section(cross), "m-1").drop("scored_at")


@query("stats_json", """SELECT o_orderstatus, '{"n":' || count(*) || ',"top":null}' AS stats FROM orders GROUP BY 1""")
def stats_json(spark, sf):
    o = v.table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.lit(float("nan"))).alias("top"))
    return sink.stats_json(o, ["n", "top"], "stats")


# ------------------------------------------------------------------------------------ checks


def _passed(df):
    return df.select("check", "passed")


@query("dq_facts", with_views("""SELECT 'fundamentals_no_lookahead' AS "check", count(*) FILTER (date_diff('day', filed_date, period_end) > 60) = 0 AS passed FROM facts
  UNION ALL SELECT 'fundamentals_concepts', count(DISTINCT concept) >= 10 FROM facts
  UNION ALL SELECT 'fundamentals_unique_keys', (SELECT count(*) FROM (SELECT 1 FROM facts GROUP BY ticker, concept, period_end, filed_date HAVING count(*) > 1)) = 0""", "facts"))
def dq_facts(spark, sf):
    return _passed(quality.fact_checks(v.facts(spark, sf)))


@query("dq_features", with_views("""SELECT 'fundamental_features_no_lookahead' AS "check", count(*) FILTER (date_diff('day', availability_date, period_end) > 60) = 0 AS passed FROM fund
  UNION ALL SELECT 'fundamental_features_row_count', count(*) >= 1000 FROM fund
  UNION ALL SELECT 'fundamental_features_filing_lag', count(*) FILTER (availability_date < period_end) = 0 FROM fund
  UNION ALL SELECT 'fundamental_features_unique_keys', (SELECT count(*) FROM (SELECT 1 FROM fund GROUP BY ticker, period_end HAVING count(*) > 1)) = 0""",
    "facts", "sectors", extra=FUND_CTES))
def dq_features(spark, sf):
    return _passed(quality.feature_checks(fund_table(spark, sf), min_rows=1000))


@query("dq_prices", with_views("""SELECT 'prices_positive' AS "check", count(*) FILTER (close IS NULL OR close <= 0) = 0 AS passed FROM close_m
  UNION ALL SELECT 'prices_freshness', date_diff('day', max(date), DATE '2002-01-10') <= 45 FROM close_m
  UNION ALL SELECT 'prices_row_count', count(*) >= 500000 FROM close_m""", "close_m"))
def dq_prices(spark, sf):
    return _passed(quality.price_checks(v.closes(spark, sf), "2002-01-10"))


@query("dq_panel", with_views("""SELECT 'panel_monthly_target_coverage' AS "check", count(target) >= 0.8 * count(forward_return) AND count(forward_return) > 0
    AND count(momentum_12_2) > 0 AS passed FROM panel WHERE date > (SELECT max(date) FROM panel) - INTERVAL 12 MONTH
  UNION ALL SELECT 'panel_monthly_return_bounds', count(*) FILTER (NOT (forward_return BETWEEN -0.95 AND 3.0)) = 0 FROM panel
  UNION ALL SELECT 'panel_monthly_row_count', count(*) >= 500000 FROM panel
  UNION ALL SELECT 'panel_monthly_rank_bounds', count(*) FILTER (roe > 1.0001 OR momentum_12_2 > 1.0001 OR book_to_price > 1.0001 OR target > 1.0001) = 0 FROM panel
  UNION ALL SELECT 'panel_monthly_unique_keys', (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY date, ticker HAVING count(*) > 1)) = 0""",
    *PANEL_VIEWS, extra=PANEL_CTES))
def dq_panel(spark, sf):
    return _passed(quality.panel_checks(panel_table(spark, sf)))


@query("dq_universe", """SELECT 'universe_active_band' AS "check", count(*) FILTER (c_acctbal > 0) BETWEEN 100 AND 500000 AS passed FROM customer
  UNION ALL SELECT 'universe_sector_coverage', count(*) FILTER (c_acctbal > 0 AND c_mktsegment <> 'MACHINERY') >= 0.9 * count(*) FILTER (c_acctbal > 0)
    AND count(*) FILTER (c_acctbal > 0 AND c_mktsegment <> 'MACHINERY') >= 100 FROM customer""")
def dq_universe(spark, sf):
    c = v.table(spark, sf, "customer")
    u = c.select((F.col("c_acctbal") > 0).alias("is_active"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("gics_sector"))
    return _passed(quality.universe_checks(u, 100, 500_000, 0.9, 100))


@query("dq_series", with_views("""SELECT 'ff_factors_fresh' AS "check", date_diff('day', max(date), DATE '2002-01-10') <= 75 AND count(*) FILTER (mkt_rf IS NULL) = 0 AS passed FROM ff_m
  UNION ALL SELECT 'macro_fresh', date_diff('day', max(date), DATE '2002-01-10') <= 75 AND count(yield_curve) > 0 FROM macro_m""", "ff_m", "macro_m"))
def dq_series(spark, sf):
    return _passed(quality.series_checks(v.ff_m(spark, sf), v.macro_m(spark, sf), "2002-01-10"))


@query("boundary_violations", """SELECT 'ticker_pattern' AS rule, count(*) FILTER (NOT regexp_full_match(upper(c_name), '[A-Z0-9.\\-]+')) AS violations FROM customer
  UNION ALL SELECT 'cik_pattern', count(*) FILTER (c_custkey % 4 = 0) FROM customer UNION ALL SELECT 'concept_known', count(*) FILTER (c_mktsegment = 'MACHINERY') FROM customer
  UNION ALL SELECT 'gaap_tag_present', 0 UNION ALL SELECT 'period_end_present', 0 UNION ALL SELECT 'fiscal_period_known', count(*) FILTER (c_custkey % 6 = 0) FROM customer
  UNION ALL SELECT 'duration_known', count(*) FILTER (c_nationkey % 2 = 1) FROM customer UNION ALL SELECT 'filed_date_present', 0 UNION ALL SELECT 'form_present', count(*) FILTER (c_custkey % 9 = 0) FROM customer
  UNION ALL SELECT 'unit_present', 0 UNION ALL SELECT 'pit_no_lookahead', count(*) FILTER (c_custkey % 100 > 60) FROM customer""")
def boundary_violations(spark, sf):
    c, k = v.table(spark, sf, "customer"), F.col("c_custkey")
    end = F.lit("2000-06-30").cast("date")
    rows = c.select(
        F.upper("c_name").alias("ticker"), F.when(k % 4 == 0, "12").otherwise(scalars.pad_cik(k)).alias("cik"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "other").otherwise("revenue").alias("concept"), F.lit("Revenues").alias("gaap_tag"),
        end.alias("period_end"), F.when(k % 6 == 0, "Q5").otherwise("Q2").alias("fiscal_period"),
        F.when(F.col("c_nationkey") % 2 == 1, 90).otherwise(91).alias("duration_days"),
        F.expr("date_sub(date'2000-06-30', cast(c_custkey % 100 as int))").alias("filed_date"),
        F.when(k % 9 != 0, "10-Q").alias("form"), F.col("c_acctbal").alias("value"), F.lit("USD").alias("unit"))
    return quality.violation_counts(rows)


# ------------------------------------------------------------------------------- incremental


@query("incremental_upsert", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts,
    arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def incremental_upsert(spark, sf):
    """Land the events in pieces, stream them into a keyed table, read its final state."""
    from factorloom.streaming.incremental import file_stream, upsert_stream

    base = scratch_dir(spark, "events")
    events = v.table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    events.repartition(6, "event_id").write.parquet(f"{base}/landed")
    stream = file_stream(spark, f"{base}/landed", events.schema, max_files=3)
    upsert_stream(stream, f"{base}/table", ["user_id", "event_type"], f"{base}/checkpoint", prefer=["ts", "event_id"])
    return sink.read_table(spark, f"{base}/table")


@query("incremental_prices", with_views("SELECT ticker, date, close FROM close_m", "close_m"))
def incremental_prices(spark, sf):
    """Daily bars land in files that each mix all days, read one at a time through one checkpoint."""
    from factorloom.streaming.incremental import file_stream, ingest_prices

    base = scratch_dir(spark, "bars")
    bars = v.bars_d(spark, sf).select("ticker", "date", "close")
    bars.repartition(3, F.xxhash64("ticker", "date")).write.parquet(f"{base}/staged")
    ingest_prices(file_stream(spark, f"{base}/staged", bars.schema, max_files=1), f"{base}/prices", f"{base}/checkpoint")
    return sink.read_table(spark, f"{base}/prices").select("ticker", "date", "close")


@query("daily_bars_table", with_views("""SELECT ticker, date, round(CASE WHEN year(date) = 1997 THEN 2 ELSE 1 END * close + 1e-8, 6) + 0.0 AS close,
    round(high + 1e-8, 6) + 0.0 AS high, volume FROM bars_d WHERE date >= DATE '1996-07-01'""", "bars_d"))
def daily_bars_table(spark, sf):
    """Daily bars are stored, one year is loaded again with other closes and rows without one, and all are read since a day."""
    from factorloom.sources.tables import Warehouse

    base = scratch_dir(spark, "warehouse")
    bars = v.bars_d(spark, sf).withColumn("open", F.col("close"))
    sink.write_prices_daily(spark, f"{base}/prices_daily", bars)
    year = bars.where(F.year("date") == 1997)
    again = year.withColumn("close", 2 * F.col("close")).unionByName(
        year.withColumns({"close": F.lit(0.0), "ticker": F.col("ticker") + 1_000_000}))
    sink.write_prices_daily(spark, f"{base}/prices_daily", again)
    out = Warehouse(spark, base).prices_daily(since="1996-07-01")
    close = (F.col("close") + 1e-8).alias("close")  # off the ties that the order of a sum decides
    return rounded(out.select("ticker", "date", close, (F.col("high") + 1e-8).alias("high"), "volume"))
