"""Session helpers: where intermediate tables go and how they are written."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_shipped: set[str] = set()
_written: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no path of their own to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="postloom-code-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/postloom.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(f"{folder}/postloom.zip")


def build_session(app: str = "postloom", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "200")
        .config("spark.driver.memory", os.environ.get("POSTLOOM_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    ``spark.checkpoint.dir`` of the session decides. Where it is unset, a temporary folder is made, which
    only a local master can use: on a cluster the executors would not share it, so that raises.
    """
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="postloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate; a failure to do so is not an error."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    Cuts the lineage, so losing an executor later costs no recomputation, and fixes values that would
    change if computed again (row positions, sampled range bounds). Later readers prune columns. The
    table is dropped when the Python process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(clear_stages, spark)
    _written.add(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stage_path = path
    return kept


def clear_stages(spark: SparkSession) -> None:
    """Delete all stages written so far, for sessions that live long; results that were not read to the end are lost."""
    while _written:
        remove(spark, _written.pop())


def drop_stage(df: DataFrame) -> None:
    """Delete a written stage that nothing will read again, as in loops that write one table a step."""
    if (path := getattr(df, "_stage_path", None)) is not None:
        _written.discard(path)
        remove(df.sparkSession, path)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


PARTITION_BYTES = 128 << 20
SPREAD_BYTES = 1 << 30
_MOST_PARTITIONS = 1 << 16


def sized_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle whose number can't adapt at run time: by the size that the optimizer estimates."""
    return max(default_partitions(df.sparkSession), min(_MOST_PARTITIONS, -(-estimated_bytes(df) // PARTITION_BYTES)))


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of a table to be."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer partitions than there are cores, as one file gives, spread over all cores.

    A table that has enough partitions, or is estimated at more than 1 GB, stays as it is, so no corpus is shuffled:
    ``spark.sql.files.maxPartitionBytes`` and ``minPartitionNum`` decide how its scan is split.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
