"""Session settings and the scratch folder shared by the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: SQL settings every operator relies on: timestamps are read and shown in UTC.
REQUIRED_CONF = {"spark.sql.session.timeZone": "UTC"}


#: Applications that already got the package.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Workers import the library by name.  Executors get it as a file; the helper process that
    starts a stateful stream runs beside the driver and needs the path in its environment.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tickspark-")) / "tickspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root.parent), known]))
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Prepare an existing session: its settings, and the package on the workers."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    cores = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickspark")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession) -> str:
    """Root for written intermediate tables and stream checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only a local master (tests, a
    laptop) may leave it unset and gets a local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "tickspark-scratch")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where several operators start from the same expensive rows (bars, features), so
    that a lost executor re-reads a file instead of recomputing everything from the ticks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
