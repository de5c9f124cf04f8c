"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime-adaptive execution does the physical choices: it turns a join into a
# broadcast join only when the measured side is below the threshold, coalesces
# small shuffle partitions and splits skewed ones.  The library gives no
# broadcast hints, so a dimension that outgrows the threshold falls back to a
# shuffled join by itself.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "weirgauge") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC; every timestamp in the data model is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the session runs on one machine (tests) a local folder
    is made; executors elsewhere would not see it.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: the session runs on {master!r}")
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="weirgauge-stage-")
    return _own_folder


_noted: list[list[str]] = []  # open lists of ``noting``


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    Used where a small result of a large scan is needed several times: the scan runs
    once, a lost executor costs a re-read and not a re-scan, and the file sizes let
    Spark see that the result is small enough to broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/weirgauge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _noted:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting() -> Iterator[list[str]]:
    """The folders that ``staged`` writes inside the block."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted.remove(paths)


def release(spark: SparkSession, paths: list[str], kept: DataFrame) -> list[str]:
    """Delete staged folders that ``kept`` does not read; those that it reads are returned.

    Only for folders whose results were written elsewhere.  The driver's memory is collected as
    well: Spark removes the shuffle files of plans that nobody holds any more only then.
    """
    read = kept.inputFiles()
    held = [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in read)]
    for path in set(paths) - set(held):
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    spark._jvm.System.gc()
    return held
