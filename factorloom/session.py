"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_local_scratch: list[str] = []
_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "factorloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FACTORLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.buffer.pageSize", "2m")  # small data: many short sorts per task
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, label: str = "run") -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder. Only a local master may fall back to a
    folder of this machine; a cluster without the setting is an error, because executors
    could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_scratch:  # kept here: the setting is fixed once a session runs
            _local_scratch.append(tempfile.mkdtemp(prefix="factorloom-"))
        base = _local_scratch[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df, label: str = "settled"):
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with files that outlive lost executors.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fine_parts(spark: SparkSession) -> int:
    """Partitions for steps that need far more memory or time than the bytes they read tell.

    Named to ``repartition`` this many stay: adaptive execution would merge them by their bytes.
    """
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once an application.

    Functions that run in Python workers are found there by module name.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="factorloom-source-")) / "factorloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
