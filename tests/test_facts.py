import datetime as dt
import random

import pytest

from factorloom.operators import facts as fx
from factorloom.operators.asof import as_known_on
from factorloom.operators.fundamentals import derive_fundamental_features
from factorloom.operators.quality import validate_facts
from factorloom.schema import FUNDAMENTAL_COLUMNS

D = dt.date
FLOW = "ticker string, concept string, start date, end date, val double, filed date, form string, seq int"


def flow(spark, rows):
    data = [("A", "revenue", *r, i) for i, r in enumerate(rows)]
    out = fx.flow_changepoints(spark.createDataFrame(data, FLOW), seq="seq").collect()
    return sorted((r.period_end, r.filed_date, r.value, r.form) for r in out)


def near_quarter(d):
    ends = [D(y, m, 31 if m in (3, 12) else 30) for y in range(d.year - 1, d.year + 2) for m in (3, 6, 9, 12)]
    return min(ends, key=lambda e: (abs((e - d).days), e < d))


def by_hand(rows):
    """Slow check: rebuild what is known on each filing day from scratch."""
    known, out = {}, set()
    rows = sorted(((f, e, i, s, v) for i, (s, e, v, f, _) in enumerate(rows) if e <= f), key=lambda r: r[:3])
    for day in sorted({r[0] for r in rows}):
        chain, order, direct = {}, [], {}
        for f, e, _, s, v in rows:
            if f > day:
                continue
            fy, q, n = (s.year, (s.month - 1) // 3), near_quarter(e), (e - s).days
            if 0 <= n <= 380:
                if fy not in order:
                    order.append(fy)
                chain[fy, q] = v
            if 80 <= n <= 100:
                direct[q] = v
        now = {}
        for fy in order:
            last = 0.0
            for q in sorted(k[1] for k in chain if k[0] == fy):
                now[q] = chain[fy, q] - last
                last = chain[fy, q]
        now |= direct
        out |= {(q, day, v) for q, v in now.items() if known.get(q) != v}
        known = now
    return sorted(out)


def test_fourth_quarter_comes_from_differencing(spark):
    y = D(2022, 1, 1)
    rows = [(y, D(2022, 3, 31), 100.0, D(2022, 5, 1), "10-Q"), (y, D(2022, 6, 30), 220.0, D(2022, 8, 1), "10-Q"),
            (y, D(2022, 9, 30), 330.0, D(2022, 11, 1), "10-Q"), (y, D(2022, 12, 31), 500.0, D(2023, 2, 15), "10-K")]
    got = {(p, v) for p, _, v, _ in flow(spark, rows)}
    assert got == {(D(2022, 3, 31), 100.0), (D(2022, 6, 30), 120.0), (D(2022, 9, 30), 110.0), (D(2022, 12, 31), 170.0)}


def test_restatement_is_a_new_row_and_repeats_are_not(spark):
    y, q = D(2022, 1, 1), D(2022, 3, 31)
    rows = [(y, q, 100.0, D(2022, 5, 1), "10-Q"), (y, q, 100.0, D(2022, 8, 1), "10-Q"), (y, q, 90.0, D(2023, 2, 1), "10-K")]
    assert flow(spark, rows) == [(q, D(2022, 5, 1), 100.0, "10-Q"), (q, D(2023, 2, 1), 90.0, "10-K")]
    future = [(y, D(2022, 6, 30), 5.0, D(2022, 6, 1), "8-K")]
    assert flow(spark, future) == []


@pytest.mark.parametrize("seed", range(6))
def test_flow_changepoints_match_replay(spark, seed):
    rng = random.Random(seed)
    rows = []
    for year in (2019, 2020, 2021):
        shift = rng.choice([0, 0, 27, -20])
        for q in range(4):
            qs = D(year, 3 * q + 1, 1) + dt.timedelta(days=shift)
            end = qs + dt.timedelta(days=rng.choice([89, 90, 91, 92]))
            for _ in range(rng.randint(1, 3)):
                filed = end + dt.timedelta(days=rng.randint(-5, 400))
                start = rng.choice([qs, D(year, 1, 1) + dt.timedelta(days=shift), D(year, 1, 1) + dt.timedelta(days=shift)])
                rows.append((start, end, float(rng.randint(1, 50)), filed, rng.choice(["10-Q", "", "10-K"])))
    assert [r[:3] for r in flow(spark, rows)] == by_hand(rows)


def test_instants_snap_to_nearest_quarter_and_drop_future(spark):
    rows = [("A", "equity", D(2022, 4, 14), 10.0, D(2022, 5, 1), "10-Q"), ("A", "equity", D(2022, 4, 14), 10.0, D(2022, 6, 1), ""),
            ("A", "equity", D(2022, 4, 14), 11.0, D(2022, 7, 1), ""), ("A", "equity", D(2030, 1, 1), 99.0, D(2022, 7, 1), "10-Q")]
    df = spark.createDataFrame(rows, "ticker string, concept string, end date, val double, filed date, form string")
    got = sorted((r.period_end, r.filed_date, r.value, r.form) for r in fx.instant_changepoints(df).collect())
    assert got == [(D(2022, 3, 31), D(2022, 5, 1), 10.0, "10-Q"), (D(2022, 3, 31), D(2022, 7, 1), 11.0, "")]
    known = as_known_on(fx.instant_changepoints(df), ["ticker", "concept", "period_end"], "2022-06-15")
    assert known.collect()[0].value == 10.0


QUARTERS = [D(2022, 3, 31), D(2022, 6, 30), D(2022, 9, 30), D(2022, 12, 31), D(2023, 3, 31)]


def facts_rows():
    steps = {"revenue": [100, 110, 120, 130, 140], "net_income": [10, 10, 15, 15, 10], "gross_profit": [50, 55, 60, 65, 70],
             "operating_income": [20] * 5, "dna": [5] * 5, "op_cashflow": [11] * 5, "equity": [200] * 5, "assets": [500, 500, 500, 500, 550],
             "cash": [10] * 5, "debt_lt": [100] * 5, "debt_cur": [20] * 5, "shares": [1000] * 5}
    return [("A", c, q, q + dt.timedelta(days=45), float(x)) for c, xs in steps.items() for q, x in zip(QUARTERS, xs)]


def derive(spark, rows, sectors=(("A", "Energy"),)):
    df = spark.createDataFrame(rows, "ticker string, concept string, period_end date, filed_date date, value double")
    sec = spark.createDataFrame(list(sectors), "ticker string, gics_sector string")
    out = derive_fundamental_features(df, sec)
    assert out.columns == FUNDAMENTAL_COLUMNS
    return {(r.ticker, r.period_end): r for r in out.collect()}


def test_trailing_year_and_ratios(spark):
    last = derive(spark, facts_rows())["A", QUARTERS[-1]]
    assert (last.revenue_ttm, last.net_income_ttm, last.ebitda_ttm, last.debt) == (500.0, 50.0, 100.0, 120.0)
    assert last.roe == 0.25 and last.gross_margin == 0.5 and last.accruals == pytest.approx((50 - 44) / 550)
    assert last.revenue_growth_yoy == pytest.approx(0.4) and last.availability_date == QUARTERS[-1] + dt.timedelta(days=45)
    assert last.gics_sector == "Energy"


def test_first_reported_value_wins_and_four_quarters_are_needed(spark):
    late = ("A", "revenue", QUARTERS[0], QUARTERS[0] + dt.timedelta(days=445), 9999.0)
    got = derive(spark, facts_rows() + [late], [("A", "NaN")])
    assert got["A", QUARTERS[3]].revenue_ttm == 460.0 and got["A", QUARTERS[2]].revenue_ttm is None
    assert got["A", QUARTERS[0]].gics_sector is None
    first = got["A", QUARTERS[0]]
    assert first.availability_date == QUARTERS[0] + dt.timedelta(days=45)


def test_gate_drops_names_without_revenue(spark):
    other = [("B", c, q, f, x) for _, c, q, f, x in facts_rows() if c != "revenue"]
    assert {t for t, _ in derive(spark, facts_rows() + other)} == {"A"}


GOOD = ("ABC-D", "0000000001", "revenue", "Revenues", D(2022, 3, 31), "Q1", 91, D(2022, 5, 1), "10-Q", 1.0, "USD")
FACT = ("ticker string, cik string, concept string, gaap_tag string, period_end date, fiscal_period string, "
        "duration_days int, filed_date date, form string, value double, unit string")


def test_boundary_schema(spark):
    ok = lambda *rows: spark.createDataFrame(list(rows), FACT)
    assert validate_facts(ok(GOOD)).count() == 1 and validate_facts(ok()).count() == 0
    edge = GOOD[:7] + (GOOD[4] - dt.timedelta(days=60),) + GOOD[8:]
    assert validate_facts(ok(edge)).count() == 1
    early = GOOD[:7] + (GOOD[4] - dt.timedelta(days=61),) + GOOD[8:]
    with pytest.raises(ValueError, match="pit_no_lookahead"):
        validate_facts(ok(early))
    with pytest.raises(ValueError, match="cik_pattern.*concept_known|concept_known"):
        validate_facts(ok(GOOD[:1] + ("12", "other") + GOOD[3:]))
    with pytest.raises(ValueError, match="unexpected column"):
        from pyspark.sql import functions as F
        validate_facts(ok(GOOD).withColumn("more", F.lit(1)))


def test_documents_without_a_schema(spark):
    """Unknown namespaces pass, broken documents and wrong types are rejected and named, absent fields are nulls."""
    from pyspark.sql import functions as F

    from factorloom.sources import files

    good = '{"cik": 7, "facts": {"own": {"Widgets": {"label": "x", "units": {"pure": [{"end": "2020-03-31", "val": 4, "filed": "2020-05-01", "more": [1]}]}}}}}'
    mixed = ('{"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "soon", "val": 1}, {"end": "2020-03-31", "val": "n/a", "form": 7}, 5, null,'
             ' {"val": null, "form": "10-Q"}]}}, "Odd": 3, "Bare": {"units": [1]}}}}')
    docs = [("A", good), ("B", mixed), ("C", '{"facts": {"us-g'), ("D", '{"cik": 1}'), ("E", "[1, 2]"), ("F", None), ("G", '{"facts": {}}')]
    rows = spark.createDataFrame(docs, "ticker string, value string").select(
        "ticker", F.lit("0000000001").alias("cik"), F.try_parse_json("value").alias("doc"))
    records, rejects = files.parse_filings(rows)
    got = sorted((r.ticker, r.ns, r.tag, r.unit, r.seq, r.val, r.form) for r in records.collect())
    assert got == [("A", "own", "Widgets", "pure", 0, 4.0, None), ("B", "us-gaap", "Revenues", "USD", 4, None, "10-Q")]
    assert sorted((r.ticker, r.place, r.reason) for r in rejects.collect()) == [
        ("B", "us-gaap/Revenues/USD/0", "wrong type: end"), ("B", "us-gaap/Revenues/USD/1", "wrong type: val"),
        ("B", "us-gaap/Revenues/USD/2", "no figure"), ("B", "us-gaap/Revenues/USD/3", "no figure"),
        ("C", "", "no document"), ("D", "", "no facts"), ("E", "", "no facts"), ("F", "", "no document")]
