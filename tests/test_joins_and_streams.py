"""Bitemporal lookups, first-match ranges and the stateful filing stream against plain versions."""

import datetime as dt
import random

import pytest

from factorloom.operators.asof import asof_known, asof_without_key
from factorloom.operators.facts import flow_changepoints
from factorloom.operators.ranges import elementary_intervals, first_match
from factorloom.sinks import tables as sink
from factorloom.streaming.filings import ingest_flow_changepoints, rocksdb_state
from factorloom.streaming.incremental import file_stream

DAY = dt.date(2020, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day(n):
    return DAY + dt.timedelta(days=n)


# ------------------------------------------------------------------------------ what was known on a day


@pytest.mark.parametrize("bucket", [None, "month", "year"])
def test_known_on_each_rows_own_day(spark, bucket):
    rng = random.Random(3)
    facts = [(rng.choice("ab"), day(rng.randrange(400)), day(rng.randrange(400)), float(rng.randrange(50))) for _ in range(120)]
    facts += [("hot", day(i), day(i + rng.randrange(-20, 90)), float(i)) for i in range(300)] + [("a", None, day(1), 1.0), ("a", day(1), None, 1.0)]
    asked = [(rng.choice(["a", "b", "c", "hot"]), i, day(rng.randrange(500))) for i in range(300)] + [("a", 900, None)]
    left = spark.createDataFrame(asked, "ticker string, id int, known_on date")
    right = spark.createDataFrame(facts, "ticker string, period_end date, filed_date date, value double")
    got = {r.id: (r.period_end, r.filed_date, r.value) for r in asof_known(left, right, ["ticker"], "known_on", bucket=bucket).collect()}
    for ticker, i, x in asked:
        seen = [(p, f, v) for t, p, f, v in facts if t == ticker and x and p and f and p <= x and f <= x]
        assert got[i] == max(seen, default=(None, None, None)), (ticker, x)
    assert "Cartesian" not in plan_of(asof_known(left, right, ["ticker"], "known_on", bucket=bucket))


def test_as_of_without_a_key(spark):
    rng = random.Random(4)
    starts, asked = sorted(rng.sample(range(1000), 60)), [rng.randrange(-20, 1020) for _ in range(200)] + [500] * 300 + [None]
    left = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "id int, x long")
    right = spark.createDataFrame([(s, f"s{s}") for s in starts], "start long, label string")
    got = {r.id: r.label for r in asof_without_key(left, right, "x", "start").collect()}
    assert len(got) == len(asked)
    for i, x in enumerate(asked):
        best = max((s for s in starts if x is not None and s <= x), default=None)
        assert got[i] == (None if best is None else f"s{best}")


# ------------------------------------------------------------------------------ first match of many ranges


@pytest.mark.parametrize(("block", "n"), [(2, 40), (3, 120), (16, 300), (1024, 120)])
def test_first_match_equals_trying_every_range(spark, block, n):
    rng = random.Random(block)
    ranges = []
    for k in range(n):
        lo = rng.randrange(500)
        ranges.append((lo, lo + rng.choice([0, 1, 5, 40, 400, -1]), 1000 - k if k % 2 else k, f"r{k}"))
    ranges += [(10, 20, 5000 + k, "same ends") for k in range(200)] + [(None, 5, -1, "null"), (5, None, -2, "null")]
    asked = [(i, x) for i, x in enumerate([rng.randrange(-5, 950) for _ in range(400)] + [15] * 100 + [None])]
    table = spark.createDataFrame(ranges, "lo long, hi long, rank long, label string")
    out = first_match(spark.createDataFrame(asked, "id int, x long"), "x", table, block=block)
    got = {r.id: r.label for r in out.collect()}
    assert len(got) == len(asked)
    for i, x in asked:
        hit = [(rank, label) for lo, hi, rank, label in ranges if x is not None and lo is not None and hi is not None and lo <= x <= hi]
        assert got[i] == (min(hit)[1] if hit else None), x
    plan = plan_of(out)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_of_no_ranges(spark):
    none = spark.createDataFrame([], "lo long, hi long, rank long, label string")
    assert elementary_intervals(none).count() == 0
    rows = spark.createDataFrame([("7",), ("x",), (None,)], "x string")
    assert [tuple(r) for r in first_match(rows, "x", none).collect()].count((None, None)) == 1
    one = spark.createDataFrame([(5, 9, 1, "five")], "lo long, hi long, rank long, label string")
    assert {r.x: r.label for r in first_match(rows, "x", one).collect()} == {"7": "five", "x": None, None: None}


# ------------------------------------------------------------------------------ filings as a stream

FLOW = "ticker string, concept string, start date, end date, val double, filed date, form string"


def filing_rows(rng, n):
    """Cumulative and three-month records of a few quarters, restated, reordered and partly unusable."""
    out = []
    for _ in range(n):
        year, q = rng.choice([2019, 2020]), rng.randrange(1, 5)
        end = dt.date(year + (q == 4), (3 * q) % 12 + 1, 1) - dt.timedelta(days=1 + rng.choice([0, 0, 0, 3, 40]))
        start = rng.choice([dt.date(year, 1, 1), dt.date(year, 3 * q - 2, 1), dt.date(year - 1, 1, 1)])
        filed = end + dt.timedelta(days=rng.choice([-3, 20, 50, 50, 400]))
        out.append((rng.choice(["A", "B"]), rng.choice(["revenue", "dna"]), rng.choice([start, start, start, None]), end,
                    rng.choice([None, *[float(rng.randrange(9)) for _ in range(5)]]), filed, rng.choice(["10-K", "10-Q", "", None])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stream_of_filings_ends_where_the_batch_does(spark, tmp_path, seed):
    """Records come in any order over three starts; each start finds the state that the one before it left."""
    rng = random.Random(seed)
    rows = filing_rows(rng, 150)
    df = spark.createDataFrame(rows, FLOW)
    landed, target = str(tmp_path / "in"), str(tmp_path / "points")
    with rocksdb_state(spark):
        for k in range(3):
            part = spark.createDataFrame(rows[k * 50 : k * 50 + 50], FLOW)
            part.repartition(2).write.mode("append").parquet(landed)
            ingest_flow_changepoints(file_stream(spark, landed, df.schema, max_files=1), target, str(tmp_path / "ck"))
            so_far = flow_changepoints(spark.createDataFrame(rows[: k * 50 + 50], FLOW))
            want = sorted(map(tuple, so_far.collect()), key=str)
            got = sorted(map(tuple, sink.read_table(spark, target).select(*so_far.columns).collect()), key=str)
            assert got == want and want
        ingest_flow_changepoints(file_stream(spark, landed, df.schema), target, str(tmp_path / "ck"))  # nothing new
        assert sink.read_table(spark, target).count() == len(want)


def test_late_filing_takes_points_back(spark, tmp_path):
    a = ("A", "revenue", dt.date(2020, 1, 1), dt.date(2020, 3, 31))
    landed, target, schema = str(tmp_path / "in"), str(tmp_path / "points"), spark.createDataFrame([], FLOW).schema
    with rocksdb_state(spark):
        for value, filed in ((5.0, dt.date(2020, 8, 1)), (5.0, dt.date(2020, 5, 1))):
            spark.createDataFrame([(*a, value, filed, "10-Q")], FLOW).write.mode("append").parquet(landed)
            ingest_flow_changepoints(file_stream(spark, landed, schema), target, str(tmp_path / "ck"))
    assert [(r.filed_date, r.value) for r in sink.read_table(spark, target).collect()] == [(dt.date(2020, 5, 1), 5.0)]


def test_bucketed_tables_join_and_window_without_a_shuffle(spark):
    from factorloom.catalog.market import bucketed_fundamentals
    from factorloom.functions.windows import Positional
    from factorloom.sinks.bucketed import write_bucketed

    assert "Exchange" not in plan_of(bucketed_fundamentals(spark, "/root/testdata/sf0.001"))
    rows = spark.createDataFrame([(t, p, float(p)) for t in "abc" for p in range(50)], "ticker string, pos int, ret double")
    table = spark.table(write_bucketed(rows, "ticker", ["pos"], buckets=3))
    p = Positional()
    plan = plan_of(p.centred(table, "ret").withColumn("vol", p.rolling_std("ret", 40)))
    assert "Exchange" not in plan and table.count() == 150
