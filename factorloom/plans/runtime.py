"""Session settings, shared work folders and lineage cuts."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_with_tasks(module_name: str) -> None:
    """Send a module's functions along with the tasks that use them, so executors need no copy of
    this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def local_session(cores: str = "*", app: str = "factorloom", **conf) -> SparkSession:
    """A session for tests and benches. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A folder of our own is made only on local masters."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
            configured = tempfile.mkdtemp(prefix="factorloom-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once; what follows reads them from there, also after
    an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the result of an expensive query to the shared folder once, and read it from there."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return as_stored(df.sparkSession.read.parquet(path))


def as_stored(df: DataFrame) -> DataFrame:
    """Mark a table in the shared folder, or a cheap view of one: it may be read several times."""
    df._stored = True
    return df


def is_stored(df: DataFrame) -> bool:
    return vars(df).get("_stored", False)


def as_tiled(df: DataFrame) -> DataFrame:
    """Mark pairs (i, j) of which a task has only a few classes of i and of j by their remainders: they are stored by such
    classes without another shuffle."""
    df._tiled = True
    return df


def is_tiled(df: DataFrame) -> bool:
    return vars(df).get("_tiled", False)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
