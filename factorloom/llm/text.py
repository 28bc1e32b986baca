"""Column helpers the corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.session import ship_package

#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 512
#: Runs of these separate words; everything else belongs to a word.
GAP = r"[\x20\x09-\x0D]+"


def body(column: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a non-null text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefix_sums(lengths: Column, block: int = 512) -> Column:
    """Sums of all elements before each element of an int array; in blocks, so arrays grow only to ``block``."""
    begin = lambda b: F.array(b.cast("int"))
    running = lambda xs, b: F.aggregate(xs, begin(b), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    inside = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)

    def use(xs):
        last = F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

        def joined(bs):
            starts = running(F.transform(bs, inside), F.lit(0))
            return let(starts, lambda at: F.flatten(F.transform(bs, lambda b, i: F.slice(running(b, F.get(at, i)), F.lit(1), F.size(b)))))

        return let(blocks, joined)

    return let(lengths, use)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to write."""
    lost = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lost])


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns of these names renamed, and the columns that bring back the old names."""
    taken = {n.lower() for n in names}
    own = [c if c.lower() not in taken else fresh(df, f"{c}_kept")[0] for c in df.columns]
    moved = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, own, strict=True)])
    return moved, [F.col(f"`{n}`").alias(c) for c, n in zip(df.columns, own, strict=True)]


def ready_for_python(spark: SparkSession) -> None:
    """Before whole texts go to Python workers: the package's source is there, and batches are small.

    A batch of BATCH_ROWS long texts is held several times over, in the JVM and in the worker.
    """
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def small_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A driver-made table of bounded size, read by the JVM from one JSON literal."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
