"""Writers: stored tables, keyed upserts, slice replacement and guards that measure what is being written.

A table is a folder of Parquet files, partitioned or not. What is to be written is computed once into
the shared scratch folder, measured in that same job, and then replaces the partitions it has rows
of (or the whole table): a job that fails, or rows that a guard refuses, leave the table as it was.
"""

from __future__ import annotations

import csv
import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from urllib.parse import unquote, urlsplit
from urllib.request import url2pathname

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factorloom import params
from factorloom.schema import CASH_TICKER, FACTOR_NAMES, FACTS, FUNDAMENTAL_COLUMNS, PANEL_COLUMNS, require_columns
from factorloom.session import fine_parts, settle


@dataclass
class Guard:
    """Aggregates over the rows of a write, and what is wrong with their values (nothing: an empty list)."""

    measures: dict[str, Column]
    problems: Callable[[dict], list[str]]

    def judge(self, got: dict) -> None:
        """Raise for what is wrong; counts over no rows are missing and read as 0."""
        found = self.problems({name: got.get(name) or 0 for name in self.measures})
        if found:
            raise ValueError("; ".join(found))


def staged(df: DataFrame, guard: Guard | None = None) -> DataFrame:
    """``df`` in the shared scratch folder. The guard's aggregates are observed while it is written, so it is computed once."""
    if guard is None:
        return settle(df, "staged")
    seen = Observation()
    out = settle(df.observe(seen, *(e.alias(name) for name, e in guard.measures.items())), "staged")
    guard.judge(seen.get)
    return out


def find_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, None if there is none yet or it never had a row."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = find_table(spark, path)
    if df is None:
        raise FileNotFoundError(f"no table at {path}")
    return df


def _publish(rows: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str], mode: str) -> None:
    """Replace the partitions that ``rows`` has (mode dynamic) or the table (static).

    Rows are rebalanced on the partition columns: the adaptive plan splits a partition that
    holds most rows over many tasks and merges small ones.
    """
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), guard: Guard | None = None) -> None:
    """``df`` becomes the whole table; it may be computed from the table's present rows."""
    _publish(staged(df, guard), path, partition_by, sort_by, "static")


# -------------------------------------------------------------------------------- upserts


def one_per_key(df: DataFrame, keys: Sequence[str], prefer: Sequence[str] = ()) -> DataFrame:
    """One row per key: the largest ``prefer``, then the largest row; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    row = F.struct(*rest)
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*prefer, row)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def _same_key(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_k_{k}"]) for k in keys))


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``updates`` replace or extend ``target`` by key; with key columns only,
    existing rows stay as they are.

    Of several updates with one key the largest row counts. Null keys match null keys.
    """
    keys = list(keys)
    updates = one_per_key(updates, keys)
    if set(updates.columns) == set(keys):
        have = _keyed(target.select(*keys), keys)
        fresh = updates.join(have, _same_key(updates, have, keys), "left_anti")
        return target.unionByName(fresh, allowMissingColumns=True)
    if set(updates.columns) >= set(target.columns):
        new = _keyed(updates.select(*keys), keys)
        kept = target.join(new, _same_key(target, new, keys), "left_anti")
        return kept.unionByName(updates, allowMissingColumns=True)
    return column_scoped_upsert(target, updates, keys)


def column_scoped_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the supplied columns overwrite, nulls included; other columns keep their values."""
    keys = list(keys)
    updates = one_per_key(updates, keys)
    supplied = [c for c in updates.columns if c not in keys]
    new = updates.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_n_{c}") for c in supplied), F.lit(True).alias("_new"))
    joined = target.join(new, _same_key(target, new, keys), "full_outer")
    hit = F.coalesce("_new", F.lit(False))
    cols = []
    for c in dict.fromkeys([*target.columns, *supplied]):
        if c in keys:
            cols.append(F.coalesce(F.col(c), F.col(f"_k_{c}")).alias(c))
        elif c not in supplied:
            cols.append(F.col(c))
        elif c in target.columns:
            cols.append(F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(f"_n_{c}").alias(c))
    return joined.select(*cols)


def fold_into(spark: SparkSession, path: str, updates: DataFrame, merge, partition_by: Sequence[str] = (),
              sort_by: Sequence[str] = (), touching: DataFrame | None = None, marks: Sequence[str] = ()) -> None:
    """``merge(stored rows, updates)`` becomes the table's new state.

    With ``partition_by`` only the partitions that ``updates`` (or ``touching``) has rows of are
    read and replaced; the merge must not move a row to another partition. The values of touched
    partitions go through the driver: a few, since each is a folder. A merge that leaves a
    touched partition without rows, or a column that is neither stored nor one of the ``marks``
    the merge takes off again, has the whole table written again.
    """
    have = find_table(spark, path)
    if have is None:
        write_table(merge(None, updates), path, partition_by, sort_by)
        return
    if not partition_by or not set(updates.columns) <= {*have.columns, *marks}:
        write_table(merge(have, updates), path, partition_by, sort_by)
        return
    values = lambda df: {tuple(r) for r in df.select(*partition_by).distinct().collect()}
    touched = values(updates if touching is None else touching)
    if not touched:
        return
    same = lambda row: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(partition_by, row, strict=True)))
    among = reduce(lambda a, b: a | b, map(same, touched))
    rows = staged(merge(have.where(among), updates))
    if touched <= values(rows):
        _publish(rows, path, partition_by, sort_by, "dynamic")
    else:
        write_table(have.where(~among).unionByName(rows), path, partition_by, sort_by)


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str],
                 partition_by: Sequence[str] = ()) -> None:
    """Upsert into a stored table. Partition columns must follow from the key."""
    def merge(stored, new):
        return one_per_key(new, keys) if stored is None else upsert(stored, new, keys)

    fold_into(spark, path, updates, merge, partition_by, [k for k in keys if k not in partition_by])


def replace_slices(df: DataFrame, path: str, slices: Sequence[str]) -> None:
    """Replace exactly the slices (partition values) present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*slices).parquet(path))


# --------------------------------------------------------------------------- table writers


def year_of(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("year", F.year(date))


def write_prices(spark: SparkSession, path: str, prices: DataFrame, volume: DataFrame | None = None) -> None:
    """Present, positive closes only, upserted by (ticker, date)."""
    from factorloom.operators.prices import valid_prices

    rows = valid_prices(prices, volume)
    upsert_table(spark, path, year_of(rows.withColumn("date", F.col("date").cast("date"))),
                 ["ticker", "date"], ["year"])


def write_prices_daily(spark: SparkSession, path: str, bars: DataFrame) -> None:
    """Daily bars with a present, positive close, upserted by (ticker, date); a load rewrites only its years."""
    from factorloom.operators.prices import valid_prices

    rows = valid_prices(bars).withColumn("date", F.col("date").cast("date"))
    fields = [c for c in ("open", "high", "low", "close", "volume") if c in rows.columns]
    upsert_table(spark, path, year_of(rows.select("ticker", "date", *fields)), ["ticker", "date"], ["year"])


def write_panel(panel: DataFrame, path: str, min_coverage: float = params.PANEL_MIN_TARGET_COVERAGE) -> None:
    """Panel in contract order, refused when too few rows with a return have a target."""
    require_columns(panel, PANEL_COLUMNS, "panel")
    write_table(year_of(panel.select(*PANEL_COLUMNS)), path, ["year"], ["date", "ticker"], target_coverage(min_coverage))


def target_coverage(min_coverage: float = params.PANEL_MIN_TARGET_COVERAGE) -> Guard:
    """Enough of the rows with a forward return must have a target."""
    has = F.col("forward_return").isNotNull()

    def problems(got: dict) -> list[str]:
        coverage = got["targets"] / got["returns"] if got["returns"] else 0.0
        return [] if coverage >= min_coverage else [
            f"panel not written: only {coverage:.1%} of rows with a forward return carry a target, and {min_coverage:.0%} are required"]

    return Guard({"returns": F.count_if(has), "targets": F.count_if(has & F.col("target").isNotNull())}, problems)


def prediction_rows(preds: DataFrame, model_version: str, horizon: str = "1m") -> DataFrame:
    """Scores in table shape: pred becomes score, stamped with model and horizon."""
    return preds.select("date", "ticker", F.lit(horizon).alias("horizon"),
                        F.lit(model_version).alias("model_version"), F.col("pred").alias("score"))


def write_predictions(preds: DataFrame, path: str, model_version: str, horizon: str = "1m") -> None:
    replace_slices(prediction_rows(preds, model_version, horizon), path, ["horizon", "model_version"])


def recommendation_rows(ranked: DataFrame, model_version: str, scored_at=None) -> DataFrame:
    """A ranked cross-section (date, ticker, pred, rank[, gics_sector]) in table shape."""
    sector = F.col("gics_sector") if "gics_sector" in ranked.columns else F.lit(None).cast("string")
    at = F.lit(scored_at).cast("timestamp") if scored_at else F.current_timestamp()
    return ranked.select(F.col("date").alias("as_of"), F.lit(model_version).alias("model_version"),
                         F.col("rank").cast("int").alias("rank"), "ticker", sector.alias("gics_sector"),
                         F.col("pred").alias("score"), at.alias("scored_at"))


def write_recommendations(ranked: DataFrame, path: str, model_version: str) -> None:
    replace_slices(recommendation_rows(ranked, model_version), path, ["as_of", "model_version"])


def stats_json(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Pack statistics into one JSON column; NaN and missing become null."""
    def clean(c):
        kind = df.schema[c].dataType.typeName()
        if kind in ("double", "float"):
            return F.when(~F.isnan(c), F.col(c)).alias(c)
        return F.col(c)

    packed = F.to_json(F.struct(*(clean(c) for c in cols)), {"ignoreNullFields": "false"})
    return df.withColumn(out, packed).drop(*cols)


def write_backtest(result, summary_path: str, returns_path: str, settings: dict) -> None:
    """Months first, summary last: a summary is never visible without its months."""
    key = ["model_version", "strategy"]
    months = result.returns.select(*key, F.col("date").alias("month"), "gross", "cost", "net", "benchmark", "turnover")
    replace_slices(months, returns_path, ["model_version"])
    perf = ["ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "hit_rate", "n_months"]
    spans = months.groupBy(*key).agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"),
                                     F.count(F.lit(1)).cast("int").alias("n_months"), F.avg("turnover").alias("avg_turnover"))
    out = spans.join(stats_json(result.strategy.select(*key, *perf), perf, "strategy_stats"), key)
    out = out.join(stats_json(result.benchmark.select(*key, *perf), perf, "benchmark_stats"), key)
    if result.attribution is not None:
        cols = [c for c in result.attribution.columns if c not in key]
        out = out.join(stats_json(result.attribution, cols, "attribution"), key, "left")
    out = out.withColumns({k: F.lit(v) for k, v in settings.items()} | {"computed_at": F.current_timestamp()})
    replace_slices(out, summary_path, ["model_version"])


def holdings_rows(positions: DataFrame, as_of: str) -> DataFrame:
    """Parsed positions (with their ``$CASH`` rows) stamped with the snapshot date.

    Accounts without a cash row get one of 0 dollars. Positions are read twice, so they are written once.
    """
    positions = settle(positions, "positions")
    cash = positions.groupBy("account_id").agg(
        F.count_if(F.col("ticker") == CASH_TICKER).alias("_n")).where("_n = 0").select(
        "account_id", F.lit(CASH_TICKER).alias("ticker"), F.lit(0.0).alias("shares"),
        F.lit(None).cast("double").alias("cost_basis"))
    return positions.unionByName(cash).withColumn("as_of", F.lit(as_of).cast("date"))


def write_holdings(positions: DataFrame, path: str, as_of: str) -> None:
    replace_slices(holdings_rows(positions, as_of), path, ["as_of"])


def latest_holdings(holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, cash per account) of the newest snapshot."""
    newest = holdings.where(F.col("as_of") == holdings.agg(F.max("as_of")).scalar())
    cash = newest.where(F.col("ticker") == CASH_TICKER).select("account_id", F.col("shares").alias("cash"))
    return newest.where(F.col("ticker") != CASH_TICKER).select("account_id", "ticker", "shares", "cost_basis"), cash


def factor_rows(factors: DataFrame) -> DataFrame:
    """Library factor names to column names, date as DATE."""
    back = {v: k for k, v in FACTOR_NAMES.items()}
    out = factors.withColumnsRenamed(back)
    return out.select(F.col("date").cast("date").alias("date"), *(c for c in FACTOR_NAMES if c in out.columns))


def write_factors(spark: SparkSession, path: str, factors: DataFrame) -> None:
    upsert_table(spark, path, factor_rows(factors), ["date"])


def write_macro(spark: SparkSession, path: str, macro: DataFrame) -> None:
    from factorloom.sources.tables import renamed_macro

    rows = renamed_macro(macro)
    cols = [c for c in ("yield_curve", "vix", "credit_spread") if c in rows.columns]
    upsert_table(spark, path, rows.select(F.col("date").cast("date").alias("date"), *cols), ["date"])


def write_facts(spark: SparkSession, path: str, facts: DataFrame) -> None:
    """Facts upserted by key; a batch with any violation of the table's rules is refused before the table is touched."""
    from factorloom.operators.quality import fact_measures, fact_problems

    marked, measures = fact_measures(facts)
    rows = staged(marked, Guard(measures, fact_problems)).select(*(f.name for f in FACTS.fields))
    upsert_table(spark, path, rows, ["ticker", "concept", "period_end", "filed_date"])


def write_fundamental_features(spark: SparkSession, path: str, features: DataFrame) -> None:
    upsert_table(spark, path, features.select(*FUNDAMENTAL_COLUMNS), ["ticker", "period_end"])


def write_universe(spark: SparkSession, path: str, listing: DataFrame) -> None:
    """Only the supplied columns are written, so a listing refresh keeps the sectors."""
    cols = ["ticker", *(c for c in ("name", "exchange", "sic", "gics_sector", "is_active") if c in listing.columns)]
    upsert_table(spark, path, listing.select(*cols), ["ticker"])


#: How Spark names the folder of a partition without a value, and what it writes as % and two digits in others.
NO_VALUE, UNSAFE = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_trades_csv(plan: DataFrame, path: str) -> None:
    """Trade lists as CSV, one folder per account, actions that trade only.

    An account is one file. Making files is the cost here, not bytes, so accounts are dealt over more tasks than
    cores by number (a size-based merge would leave one). On a disk, Hadoop's file system starts a process for each
    file's and folder's mode, which takes far longer than the file; there the tasks make the files themselves
    (``_fill_folders``, without Hadoop's ``.crc`` files). On other stores Spark's writer makes them, and each task
    moves its own files when it commits. A task that runs again writes files of the same names.
    """
    spark = plan.sparkSession
    trades = plan.where(F.col("action").isin("SELL", "TRIM", "BUY", "ADD"))
    write = lambda df: df.write.mode("overwrite").partitionBy("account_id").option("header", "true")
    # an empty list clears the folder wherever Spark finds it; a folder on a disk is then seen from here, too
    write(spark.createDataFrame([], trades.schema)).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").csv(path)
    folder = _on_disk(path)
    if folder:
        _fill_folders(trades, folder)
        return
    dealt = trades.repartition(fine_parts(spark), "account_id")
    write(dealt).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path)


def _on_disk(path: str) -> str | None:
    """The folder's place if it is on a disk (its own or a shared one) that this process sees, else nothing."""
    at = urlsplit(path)
    folder = url2pathname(at.path) if at.scheme == "file" else path
    return os.path.abspath(folder) if at.scheme in ("", "file") and os.path.isdir(folder) else None


def _fill_folders(trades: DataFrame, folder: str) -> None:
    """The files of ``write_trades_csv`` below a folder that all executors see: Spark's lines and folder names, one open file a task.

    A file gets its name when it is whole; ``_SUCCESS`` comes when all are.
    """
    spark = trades.sparkSession
    rest = [c for c in trades.columns if c != "account_id"]
    header = spark.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(f"c{i}") for i, c in enumerate(rest))))).first()[0]
    account = F.coalesce(F.nullif(F.col("account_id").cast("string"), F.lit("")), F.lit(NO_VALUE))
    lines = trades.select(account.alias("account"), F.to_csv(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("line"))
    dealt = lines.repartition(fine_parts(spark), "account").sortWithinPartitions("account")
    run = uuid.uuid4().hex

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{run}.csv"
        unnamed = f".{name}.{task.taskAttemptId()}"
        out = at = now = None
        n = 0

        def close() -> None:
            out.close()
            os.replace(f"{at}/{unnamed}", f"{at}/{name}")

        for batch in batches:
            for key, line in zip(batch["account"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if key != now:
                    if out is not None:
                        close()
                    now, at = key, f"{folder}/account_id={UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', key)}"
                    os.makedirs(at, exist_ok=True)
                    out = open(f"{at}/{unnamed}", "w", encoding="utf-8", newline="")  # noqa: SIM115
                    out.write(header + "\n")
                out.write(line + "\n")
            n += batch.num_rows
        if out is not None:
            close()
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    dealt.mapInArrow(fill, "n long").write.format("noop").mode("overwrite").save()
    open(f"{folder}/_SUCCESS", "w").close()


def read_trades_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """What :func:`write_trades_csv` wrote for a plan of ``columns``, as text.

    On a disk one task streams the names of the folders, and many tasks read them: Spark's own reader copies its whole
    configuration for each file. On other stores that reader lists the folders once, as the schema is given, by a few
    tasks a core instead of one task a folder.
    """
    rest = [c for c in columns if c != "account_id"]
    folder = _on_disk(path)
    if folder:
        return _read_folders(spark, folder, rest)
    schema = ", ".join(f"`{c}` string" for c in [*rest, "account_id"])
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    finally:
        spark.conf.set(name, before)


def _read_folders(spark: SparkSession, folder: str, rest: Sequence[str]) -> DataFrame:
    """The rows of ``read_trades_csv`` from a folder that all executors see; a file with other columns is refused."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with os.scandir(folder) as entries:
                found = (e.name for e in entries if e.name.startswith("account_id="))
                while some := list(islice(found, 10_000)):
                    yield pa.record_batch({"name": pa.array(some, pa.string())})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, accounts, rows = set(), [], []

        def full() -> pa.RecordBatch:
            return pa.record_batch({"account": pa.array(accounts, pa.string()), "line": pa.array(rows, pa.string())})

        for batch in batches:
            for name in batch["name"].to_pylist():
                value = unquote(name.removeprefix("account_id="))
                account = None if value == NO_VALUE else value
                for file in os.listdir(f"{folder}/{name}"):
                    if file.startswith((".", "_")):
                        continue
                    with open(f"{folder}/{name}/{file}", encoding="utf-8", errors="replace") as source:
                        header = next(source, None)
                        if header and header not in known:
                            if next(csv.reader([header.rstrip("\n")], escapechar="\\")) != rest:
                                raise ValueError(f"columns of {name}/{file} are {header.strip()}, not {', '.join(rest)}")
                            known.add(header)
                        while some := list(islice(source, 10_000)):
                            own = [line.removesuffix("\n") for line in some if line.strip()]
                            accounts += [account] * len(own)
                            rows += own
                            if len(rows) >= 10_000:
                                yield full()
                                accounts, rows = [], []
        if rows:
            yield full()

    found = spark.range(1).mapInArrow(names, "name string").repartition(fine_parts(spark), "name")
    split = F.from_csv("line", ", ".join(f"`{c}` string" for c in rest)).alias("row")
    return found.mapInArrow(lines, "account string, line string").select("account", split).select("row.*", F.col("account").alias("account_id"))
