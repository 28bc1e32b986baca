"""Incremental ingestion as file-source streams.

``availableNow`` drains what has landed and stops, so the same code serves a schedule or a
running service. Each micro-batch is folded into a stored table by key; a batch seen
again after a failure writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factorloom import params
from factorloom.operators.prices import rebased_tickers
from factorloom.session import settle
from factorloom.sinks.tables import find_table, fold_into, one_per_key, year_of


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def drain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available now, then stop."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def upsert_stream(stream: DataFrame, target: str, keys: Sequence[str], checkpoint: str,
                  prefer: Sequence[str] = (), partition_date: str | None = None) -> StreamingQuery:
    """Fold a stream into a keyed table.

    Within a batch, and against the stored row, the row with the largest ``prefer`` columns
    wins, then the largest row, so the result does not depend on how files fall into batches.
    With ``partition_date`` (a key column) the table is kept by year, and a batch rewrites
    only the years it has rows of.
    """
    spark = stream.sparkSession

    def merge(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        return one_per_key(new if stored is None else stored.unionByName(new), keys, prefer)

    def apply(batch: DataFrame, _: int) -> None:
        rows = one_per_key(batch, keys, prefer)
        by = []
        if partition_date:
            rows, by = year_of(rows, partition_date), ["year"]
        fold_into(spark, target, rows, merge, by, keys)

    return drain(stream, apply, checkpoint)


def ingest_prices(stream: DataFrame, target: str, checkpoint: str, *,
                  full_history: Callable[[DataFrame], DataFrame] | None = None,
                  tolerance: float = params.REBASE_TOLERANCE) -> StreamingQuery:
    """Daily bars -> monthly closes (ticker, date, close, day), folded into the stored ones.

    ``day`` is the day of the close. The later day of a month wins whatever order the bars
    arrive in; bars of one day are replaced by the later arrival. Tickers whose fresh
    closes disagree with the stored ones on completed months were re-based; ``full_history``
    (tickers -> daily bars) supplies their whole history, which replaces what is stored.
    A batch rewrites only the years it touches, unless a re-based history touches more.
    """
    spark = stream.sparkSession

    def dated_close(bars: DataFrame) -> DataFrame:
        last = F.max(F.struct(F.col("date").alias("day"), "close")).alias("_last")
        months = bars.where(F.col("close") > 0).groupBy("ticker", F.last_day("date").alias("date")).agg(last)
        return year_of(months.select("ticker", "date", F.col("_last.close").alias("close"), F.col("_last.day").alias("day")))

    def merge(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        if stored is None:
            return new.drop("_moved")
        kept = stored.join(new.where("_moved").select("ticker").distinct(), "ticker", "left_anti")
        ranked = kept.withColumn("_src", F.lit(0)).unionByName(new.drop("_moved").withColumn("_src", F.lit(1)))
        return one_per_key(ranked, ["ticker", "date"], ["day", "_src"]).drop("_src")

    def apply(batch: DataFrame, _: int) -> None:
        fresh = dated_close(batch).withColumn("_moved", F.lit(False))
        stored = find_table(spark, target)
        if full_history is not None and stored is not None:
            newest = stored.agg(F.max("date")).scalar()
            # a month that is still open in the batch says nothing about re-basing
            same_day = fresh.join(stored.select("ticker", "day"), ["ticker", "day"], "left_semi")
            moved = settle(rebased_tickers(same_day, stored, newest, tol=tolerance).select("ticker"), "moved")
            history = dated_close(full_history(moved)).withColumn("_moved", F.lit(True))
            gone = stored.join(moved, "ticker", "left_semi").select(*stored.columns, F.lit(True).alias("_moved"))
            dated = history.unionByName(gone.join(history.select("ticker", "date"), ["ticker", "date"], "left_anti"))
            fresh = fresh.join(moved, "ticker", "left_anti").unionByName(history)
            years = dated.select("year").union(fresh.select("year")).distinct()
            fold_into(spark, target, fresh, merge, ["year"], ["ticker", "date"], years, marks=["_moved"])
        else:
            fold_into(spark, target, fresh, merge, ["year"], ["ticker", "date"], marks=["_moved"])

    return drain(stream, apply, checkpoint)


def ingest_facts(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Filing facts into the bitemporal table; a restatement is a new row, so nothing is late.

    Rows of one key that disagree resolve to the largest, in one batch or in several.
    """
    return upsert_stream(stream, target, ["ticker", "concept", "period_end", "filed_date"], checkpoint,
                         partition_date="filed_date")
