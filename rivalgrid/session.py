"""Session defaults and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the submitter owns these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rivalgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, local_folder: str | None = None) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local master without that
    setting takes ``local_folder``, or else a scratch folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = local_folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_cuts: dict[str, list[str]] = {}
_drops: dict[str, int] = {}


def written(df: DataFrame) -> str:
    """Write ``df`` as a table of its own in the shared folder and say where."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return path


def cuts(spark: SparkSession) -> list[str]:
    """The tables this application has written so far, oldest first."""
    return list(_cuts.get(spark.sparkContext.applicationId, []))


def drop_tables(spark: SparkSession, paths: list[str]) -> int:
    """Delete tables this application wrote; how many went.

    For callers that are done with every DataFrame built from them: those can no longer be read.
    """
    held = _cuts.get(spark.sparkContext.applicationId, [])
    gone = [p for p in paths if p in held]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        held.remove(path)
    return len(gone)


def drop_cuts(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this application wrote, but for the first ``since``; how many went."""
    gone = drop_tables(spark, cuts(spark)[since:])
    _drops[spark.sparkContext.applicationId] = drops(spark) + 1
    return gone


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries. Executors delete them once the driver has collected
    what refers to them, which a driver with memory to spare puts off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Compressed input per shuffle partition: its rows take some tens of times that in a sort.
PARTITION_BYTES = 6 << 20


@contextmanager
def partitions_for(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """Shuffle partitions that grow with the input while a table is written, so that no sort outgrows its
    task. Never fewer than the session's own; adaptive execution joins small ones again."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    n = max(int(own), -(-input_bytes // PARTITION_BYTES))
    spark.conf.set(name, str(n))
    try:
        yield n
    finally:
        spark.conf.set(name, own)


def drops(spark: SparkSession) -> int:
    """How often this application has deleted its tables."""
    return _drops.get(spark.sparkContext.applicationId, 0)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read that instead.

    A lost executor can no longer change it, readers scan only the columns they use, and the table's
    size is known to the planner when it picks a join.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))
