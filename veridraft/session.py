"""Session helpers: table access, the shared folder and written intermediates."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Prefix of every helper column, so that user columns never clash with ours.
RESERVED = "_vd_"


def local_session(cores: int | str = "*", app: str = "veridraft", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application; Python operators import it there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    place = tempfile.mkdtemp(prefix="veridraft-ship-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, place, True)
    built = Path(place, "build", package.name)
    shutil.copytree(package, built, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{place}/veridraft", "zip", built.parent))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or, where that is
    unset (tests, one machine), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="veridraft-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop, _ = _fs(spark, path)
    return fs.exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, hadoop, _ = _fs(spark, path)
    fs.delete(hadoop, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the session may be gone
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/veridraft-{os.getpid()}/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove_quietly, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends there, and the loss
    of an executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes a task reads before splitting small inputs further pays no more.
TASK_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small and comes in few partitions, which would leave most of them idle; any
    larger input stays as it is read. Sizes are the optimizer's, so no list of files comes to the driver."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) >= cores * TASK_BYTES:
        return df
    few = execution.toRdd().getNumPartitions() < cores / 2
    return df.repartition(cores) if few else df
