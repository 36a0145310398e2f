"""Session helpers: a tuned local session for tests and benches, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "charlascope", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster, submit with your own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is made up only in local mode; on a cluster without the setting this fails early.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="charlascope-")


def run_folder(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; ``drop_stored`` removes it."""
    return f"{shared_folder(spark).rstrip('/')}/charlascope-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Remove all tables that this application stored. Call it once the results built on them are written."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Store a frame as a table in the shared folder and read it back, so that later plans start from the files.

    The table outlives lost executors, its size is known to the optimizer, and it stays until ``drop_stored``.
    """
    path = f"{run_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def work_partitions(spark: SparkSession) -> int:
    """Tasks for stages whose work does not follow from their input bytes, which adaptive execution would merge."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan over all cores when its files give fewer splits than there are cores; larger ones stay as read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
