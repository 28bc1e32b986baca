"""Filing records as a stream: what is known of each quarter, kept as state per (ticker, concept).

The batch form is :func:`factorloom.operators.facts.flow_changepoints`. Here records arrive in any
order over any number of runs. A record touches one chain of year-to-date values or one
three-month value, and so at most a few quarters; only those are derived again, from the stored
chains that reach them, and the change points that came, moved or went are handed on.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from factorloom.functions.dates import nearest_quarter_end, quarter_start
from factorloom.operators.facts import CUMULATIVE_MAX_DAYS, QUARTER_DAYS
from factorloom.session import ship_package
from factorloom.sinks.tables import fold_into, year_of
from factorloom.streaming.incremental import drain

# Quarters from a chain's fiscal start to a point on it, as in the batch form.
SLOTS = range(-1, 6)
#: Neighbouring quarters, and filing days, whose state is one value: reading or writing one is a round trip to the store.
QUARTERS_HELD, DAYS_HELD = 16, 1461
#: The state store that this operator needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)


def quarter_number(day: int) -> int:
    """Quarters since year 0 of a day since 1970."""
    d = _EPOCH + dt.timedelta(day)
    return 4 * d.year + (d.month - 1) // 3


def quarter_last_day(number: int) -> dt.date:
    year, month = divmod(3 * number + 3, 12)
    return dt.date(year, month + 1, 1) - dt.timedelta(1)


def chain_states(chain: dict) -> list[tuple[int, list, dict[int, float]]]:
    """(filed, first seen, difference by slot) on every filing day of a chain, as known that day.

    ``chain`` maps a filing day to slot -> [order, value] and ``seen``, the least order of the day.
    """
    seen, known, out = None, {}, []
    for day in sorted(chain, key=int):
        cell = chain[day]
        first = [int(day), cell["seen"]]
        seen = first if seen is None else min(seen, first)
        known |= {int(j): v for j, (_, v) in cell["slots"].items()}
        steps, lower = {}, 0.0
        for j in sorted(known):
            steps[j] = known[j] - lower
            lower = known[j]
        out.append((int(day), seen, steps))
    return out


def quarter_points(quarter: int, chains: dict[int, dict], direct: dict) -> list[tuple[int, float]]:
    """(filed, value) of each change of the quarter's known value.

    ``chains`` maps a fiscal start to its states, ``direct`` a filing day to [order, value]. A three-month
    value counts before differences, and among chains the one seen last for the first time.
    """
    events: dict[int, list[tuple[int | None, Any]]] = {}
    for start, states in chains.items():
        for day, seen, steps in states:
            if quarter - start in steps:
                events.setdefault(day, []).append((start, (seen, steps[quarter - start])))
    for day, (_, value) in direct.items():
        events.setdefault(int(day), []).append((None, value))
    latest, stated, last, out = {}, None, None, []
    for day in sorted(events):
        for start, cell in events[day]:
            if start is None:
                stated = cell
            else:
                latest[start] = cell
        value = stated if stated is not None else max(latest.values())[1]
        if last is None or value != last:
            out.append((day, value))
        last = value
    return out


class Held:
    """A map state as one call sees it: bodies by day or quarter, kept in blocks of ``width`` neighbours.

    A block is read once and, if anything in it changed, written once by ``save``. A block's size is
    bounded by the filings of its years, whatever the length of a key's history.
    """

    def __init__(self, state, width: int):
        self.state, self.width, self.blocks, self.read = state, width, {}, {}

    def _block(self, at: int) -> dict:
        n = at // self.width
        if n not in self.blocks:
            row = self.state.getValue((n,))
            self.read[n] = row[0] if row is not None else "{}"
            self.blocks[n] = json.loads(self.read[n])
        return self.blocks[n]

    def get(self, at: int, default):
        return self._block(at).get(str(at), default)

    def put(self, at: int, body) -> None:
        self._block(at)[str(at)] = body

    def setdefault(self, at: int, default):
        return self._block(at).setdefault(str(at), default)

    def save(self) -> None:
        for n, block in self.blocks.items():
            body = json.dumps(block)
            if body != self.read[n]:
                self.state.updateValue((n,), (body,))


class FilingState(StatefulProcessor):
    """State of one (ticker, concept): chains, three-month values, forms and emitted change points, each a map by day or quarter."""

    def __init__(self, by: Sequence[str], schema: StructType):
        self.by, self.names = list(by), schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = [handle.getMapState(f"{name}_held", "block int", "bodies string") for name in ("chains", "direct", "forms", "points")]

    def _record(self, r, chains: Held, direct: Held, forms: Held, touched: set[int]) -> None:
        """Fold one record into the maps."""
        filed, order, end = str(r.filed), list(r.ord), quarter_number(r.qend)
        if 0 <= r.days <= CUMULATIVE_MAX_DAYS:
            start = quarter_number(r.fy)
            cell = chains.setdefault(start, {}).setdefault(filed, {"seen": order, "slots": {}})
            cell["seen"] = min(cell["seen"], order)
            slot = str(end - start)
            if end - start in SLOTS and (slot not in cell["slots"] or cell["slots"][slot] < [order, r.val]):
                cell["slots"][slot] = [order, r.val]
            touched |= {start + j for j in SLOTS}
        if QUARTER_DAYS[0] <= r.days <= QUARTER_DAYS[1]:
            cell = direct.setdefault(end, {})
            if filed not in cell or cell[filed] < [order, r.val]:
                cell[filed] = [order, r.val]
            touched.add(end)
        if r.form:
            form = forms.setdefault(r.filed, {"order": None, "form": "", "quarters": []})
            if form["order"] is None or [form["order"], form["form"]] < [order, r.form]:
                form |= {"order": order, "form": r.form}
                touched |= set(form["quarters"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [Held(state, width) for state, width in zip(self.maps, (QUARTERS_HELD, QUARTERS_HELD, DAYS_HELD, QUARTERS_HELD), strict=True)]
        chains, direct, forms, points = held
        touched: set[int] = set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                self._record(r, chains, direct, forms, touched)
        states: dict[int, list] = {}
        out = []
        for quarter in sorted(touched):
            near = [quarter - j for j in SLOTS]
            for start in near:
                if start not in states:
                    states[start] = chain_states(chains.get(start, {}))
            now = {}
            for filed, value in quarter_points(quarter, {s: states[s] for s in near}, direct.get(quarter, {})):
                form = forms.setdefault(filed, {"order": None, "form": "", "quarters": []})
                if quarter not in form["quarters"]:
                    form["quarters"].append(quarter)
                now[str(filed)] = [value, form["form"]]
            before = points.get(quarter, {})
            out += [(quarter, int(d), *v, False) for d, v in now.items() if before.get(d) != v]
            out += [(quarter, int(d), *v, True) for d, v in before.items() if d not in now]
            if now != before:
                points.put(quarter, now)
        for state in held:
            state.save()
        if out:
            cells = [(*key, quarter_last_day(q), _EPOCH + dt.timedelta(d), value, form, gone) for q, d, value, form, gone in out]
            yield pd.DataFrame(cells, columns=self.names)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The session's state store is RocksDB inside the block, and what it was after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def flow_changes(stream: DataFrame, by: Sequence[str] = ("ticker", "concept"), seq: str | None = None) -> DataFrame:
    """Changes of the change points: (by, period_end, filed_date, value, form, gone) for records (by, start, end, val, filed, form).

    ``gone`` rows take back a point that earlier output gave. Usable records are the batch
    form's. State needs the RocksDB store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship_package(stream.sparkSession)
    by = list(by)
    usable = F.col("val").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") <= F.col("filed"))
    day = lambda c: F.unix_date(c).cast("int")
    order = [F.col(seq).cast("double")] if seq else [day(F.col("start")).cast("double"), F.col("val").cast("double")]
    records = stream.where(usable).select(
        *by, day(F.col("filed")).alias("filed"), day(nearest_quarter_end(F.col("end"))).alias("qend"), day(quarter_start(F.col("start"))).alias("fy"),
        F.datediff("end", "start").alias("days"), F.col("val").cast("double").alias("val"), F.coalesce("form", F.lit("")).alias("form"),
        F.array(day(F.col("end")).cast("double"), *order).alias("ord"))
    schema = StructType([records.schema[c] for c in by]).add("period_end", "date").add("filed_date", "date").add(
        "value", "double").add("form", "string").add("gone", "boolean")
    return records.groupBy(*by).transformWithStateInPandas(FilingState(by, schema), schema, "Update", "None")


def ingest_flow_changepoints(stream: DataFrame, target: str, checkpoint: str, by: Sequence[str] = ("ticker", "concept"),
                             seq: str | None = None) -> StreamingQuery:
    """Keep a stored table of change points, by year of filing, in step with a stream of filing records.

    A batch replaces the points it names and removes those it takes back; a batch that runs
    again after a failure starts from the same state and writes the same rows.
    """
    spark = stream.sparkSession
    key = [*by, "period_end", "filed_date"]

    def merge(stored: DataFrame | None, changes: DataFrame) -> DataFrame:
        fresh = changes.where(~F.col("gone")).drop("gone")
        return fresh if stored is None else stored.join(changes.select(*key), key, "left_anti").unionByName(fresh)

    def apply(batch: DataFrame, _: int) -> None:
        changes = year_of(batch, "filed_date").persist()
        try:
            fold_into(spark, target, changes, merge, ["year"], key, marks=["gone"])
        finally:
            changes.unpersist()

    return drain(flow_changes(stream, by, seq), apply, checkpoint, mode="update")
