"""Filing records -> quarterly facts with their restatement history.

A filing repeats earlier figures, mixes three-month with year-to-date values and restates
old ones. The operators here turn such records into *change points*: one row each time the
public knowledge of a quarter's value changes. Everything is a grouped aggregate or a
window whose partition holds one row per filing day, so no group of records ever has to be
replayed in one task, whichever company holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.dates import nearest_quarter_end, quarter_label, quarter_start, quarters_between
from factorloom.schema import FACT_COLUMNS, FLOW_CONCEPTS

# Candidate tags per concept (first present wins), namespaces and units in
# order of preference.
CONCEPT_TAGS: dict[str, list[str]] = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "net_income": ["NetIncomeLoss"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "dna": ["DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet",
            "DepreciationAndAmortization"],
    "op_cashflow": ["NetCashProvidedByUsedInOperatingActivities",
                    "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "equity": ["StockholdersEquity",
               "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "assets": ["Assets"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue",
             "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"],
    "debt_lt": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "debt_cur": ["LongTermDebtCurrent", "DebtCurrent"],
    "shares": ["EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding"],
}
NAMESPACES = ["us-gaap", "dei"]
UNITS = ["USD", "shares", "USD/shares"]
# Day counts: longest cumulative period, and the span read as one quarter.
CUMULATIVE_MAX_DAYS = 380
QUARTER_DAYS = (80, 100)

# Quarters from a chain's fiscal start to a point on it: a period of at most 380 days that
# starts anywhere in its first quarter ends between the quarter before and the sixth.
_SLOTS = range(-1, 6)


def _index_of(c: Column, values: Sequence[str]) -> Column:
    out = F
    for i, v in enumerate(values):
        out = out.when(c == v, F.lit(i))
    return out


def match_concepts(records: DataFrame, tags: dict[str, list[str]] | None = None,
                   key: str = "ticker") -> DataFrame:
    """Keep, per (key, concept), the records of the best namespace, then tag, then unit.

    ``records`` carry ``ns``, ``tag`` and ``unit``; the result adds ``concept``.
    """
    tags = tags or CONCEPT_TAGS
    concept, place = F, F
    for name, candidates in tags.items():
        for i, tag in enumerate(candidates):
            concept = concept.when(F.col("tag") == tag, F.lit(name))
            place = place.when(F.col("tag") == tag, F.lit(i))
    rated = records.withColumns({
        "concept": concept,
        "_prio": _index_of(F.col("ns"), NAMESPACES) * 10_000 + place * 100
        + _index_of(F.col("unit"), UNITS),
    }).where(F.col("concept").isNotNull() & F.col("_prio").isNotNull())
    best = rated.groupBy(key, "concept").agg(F.min("_prio").alias("_best"))
    return rated.join(best, [key, "concept"]).where("_prio = _best").drop("_prio", "_best")


def _ordered(records: DataFrame, seq: str | None, extra: Sequence[str]) -> Column:
    """Order of records inside one filing: by period end, then as listed."""
    return F.struct("end", *([seq] if seq else extra))


def _filing_forms(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Form of a filing day: its last non-empty one."""
    named = F.when(F.col("form") != "", F.col("form"))
    return parsed.groupBy(*by, "filed").agg(
        F.max_by(named, F.when(named.isNotNull(), F.col("_ord"))).alias("_form"))


def _emit(states: DataFrame, forms: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows where the known value of a quarter differs from the one before."""
    w = Window.partitionBy(*by, "qend").orderBy("filed")
    before = F.lag("val").over(w)
    points = states.withColumn("_prev", before).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("val")))
    return points.join(forms, [*by, "filed"], "left").select(
        *by, F.col("qend").alias("period_end"), F.col("filed").alias("filed_date"),
        F.col("val").alias("value"), F.coalesce("_form", F.lit("")).alias("form"))


def instant_changepoints(records: DataFrame, by: Sequence[str] = ("ticker", "concept"),
                         seq: str | None = None) -> DataFrame:
    """Change points of balance-sheet values: records (by, end, val, filed, form)."""
    by = list(by)
    parsed = records.where(
        F.col("val").isNotNull() & F.col("end").isNotNull() & (F.col("end") <= F.col("filed"))
    ).withColumns({"qend": nearest_quarter_end(F.col("end")), "_ord": _ordered(records, seq, ["val"])})
    states = parsed.groupBy(*by, "qend", "filed").agg(F.max_by("val", "_ord").alias("val"))
    return _emit(states, _filing_forms(parsed, by), by)


def flow_changepoints(records: DataFrame, by: Sequence[str] = ("ticker", "concept"),
                      seq: str | None = None) -> DataFrame:
    """Change points of discrete quarterly flows: records (by, start, end, val, filed, form).

    Year-to-date values form a chain per fiscal start; neighbours on a chain are differenced
    as known at each filing. A reported three-month value overrides the difference, and of
    several chains that reach a quarter the one seen last for the first time counts.
    """
    by = list(by)
    usable = (F.col("val").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
              & (F.col("end") <= F.col("filed")))
    parsed = records.where(usable).withColumns({
        "qend": nearest_quarter_end(F.col("end")),
        "fy": quarter_start(F.col("start")),
        "days": F.datediff("end", "start"),
        "_ord": _ordered(records, seq, ["start", "val"]),
    })
    first_seen = F.struct("filed", "_ord")

    # 1. chains: one row per filing day that touches a chain, one slot per quarter on it
    entries = (parsed.where(F.col("days").between(0, CUMULATIVE_MAX_DAYS))
               .groupBy(*by, "fy", "qend", "filed")
               .agg(F.max_by("val", "_ord").alias("val"), F.min(first_seen).alias("_seen")))
    slot = quarters_between(F.col("fy"), F.col("qend"))
    touched = entries.groupBy(*by, "fy", "filed").agg(
        F.min("_seen").alias("_seen"),
        *(F.max(F.when(slot == j, F.col("val"))).alias(f"c{j}") for j in _SLOTS))
    chain = Window.partitionBy(*by, "fy").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    known = touched.select(
        *by, "fy", "filed", F.min("_seen").over(chain).alias("_seen"),
        *(F.last(f"c{j}", ignorenulls=True).over(chain).alias(f"c{j}") for j in _SLOTS))

    # 2. differences between neighbours, as known that day
    def step(j):
        lower = [F.col(f"c{i}") for i in reversed(_SLOTS) if i < j]
        return F.struct(F.lit(j).alias("j"),
                        (F.col(f"c{j}") - F.coalesce(*lower, F.lit(0.0))).alias("d"))

    steps = known.select(*by, "fy", "filed", "_seen",
                         F.explode(F.array(*(step(j) for j in _SLOTS))).alias("s")
                         ).where(F.col("s.d").isNotNull())
    from_chains = steps.select(
        *by, F.last_day(F.expr("add_months(fy, 3 * s.j + 2)")).alias("qend"), "filed",
        F.col("s.j").alias("j"), F.struct("_seen", F.col("s.d").alias("d")).alias("cand"))

    # 3. reported three-month values
    direct = (parsed.where(F.col("days").between(*QUARTER_DAYS))
              .groupBy(*by, "qend", "filed").agg(F.max_by("val", "_ord").alias("direct")))

    # 4. per quarter and filing day: latest state of every chain and of the direct value
    merged = from_chains.unionByName(direct, allowMissingColumns=True)
    days = merged.groupBy(*by, "qend", "filed").agg(
        F.max("direct").alias("direct"),
        *(F.max(F.when(F.col("j") == j, F.col("cand"))).alias(f"k{j}") for j in _SLOTS))
    quarter = Window.partitionBy(*by, "qend").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    carried = days.select(
        *by, "qend", "filed", F.last("direct", ignorenulls=True).over(quarter).alias("direct"),
        *(F.last(f"k{j}", ignorenulls=True).over(quarter).alias(f"k{j}") for j in _SLOTS))
    newest_chain = F.array_max(F.filter(F.array(*(F.col(f"k{j}") for j in _SLOTS)),
                                        lambda k: k.isNotNull()))
    states = carried.select(*by, "qend", "filed",
                            F.coalesce("direct", newest_chain["d"]).alias("val"))
    return _emit(states, _filing_forms(parsed, by), by)


def extract_facts(records: DataFrame, flows: Sequence[str] = FLOW_CONCEPTS) -> DataFrame:
    """Filing records (ticker, cik, ns, tag, unit, start, end, val, filed, form[, seq]) -> facts."""
    seq = "seq" if "seq" in records.columns else None
    by = ["ticker", "cik", "concept", "tag", "unit"]
    matched = match_concepts(records)
    is_flow = F.col("concept").isin(list(flows))
    flow = flow_changepoints(matched.where(is_flow), by, seq).withColumn("duration_days", F.lit(91))
    stock = instant_changepoints(matched.where(~is_flow), by, seq).withColumn("duration_days", F.lit(0))
    out = flow.unionByName(stock).withColumnRenamed("tag", "gaap_tag")
    return out.withColumn("fiscal_period", quarter_label(F.col("period_end"))).select(*FACT_COLUMNS)


def tickers_to_refresh(tickers: DataFrame, stored: DataFrame, submissions: DataFrame) -> DataFrame:
    """Tickers to read again: nothing stored, unknown latest filing, or a newer one.

    ``submissions`` holds (ticker, latest_filing).
    """
    have = stored.groupBy("ticker").agg(F.max("filed_date").alias("_stored"))
    joined = tickers.join(have, "ticker", "left").join(
        submissions.groupBy("ticker").agg(F.max("latest_filing").alias("_latest")), "ticker", "left")
    fresh = F.col("_stored").isNull() | F.col("_latest").isNull() | (F.col("_latest") > F.col("_stored"))
    return joined.where(fresh).drop("_stored", "_latest")
