"""Tables laid out by key: bucketed and sorted, so that joins and windows on the key need no shuffle.

Join, window or co-group such tables, but don't union two of them as they are: Spark 4.1 then takes the
union for co-located by key and skips a shuffle that it needs (a group comes out once a table).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from factorloom.session import scratch_dir


def write_bucketed(df: DataFrame, key: str, sort_by: Sequence[str] = (), *, buckets: int, table: str | None = None,
                   path: str | None = None) -> str:
    """Store ``df`` as a table of ``buckets`` buckets of ``key``, rows sorted in each; returns its name.

    Rows are shuffled once, here, so every bucket is one file; tables with the same key and number
    of buckets are then co-located. The files go to ``path``, by default below the shared
    scratch folder; the name is the session catalog's.
    """
    spark = df.sparkSession
    table = table or f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *sort_by)
    writer.option("path", path or scratch_dir(spark, table)).mode("overwrite").format("parquet").saveAsTable(table)
    return table
