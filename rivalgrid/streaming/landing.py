"""Micro-batches landed as folders and folded now and then.

A fold is a function from rows to fewer rows of the same columns that can be repeated: folding what has
been folded together with new rows gives what folding everything at once would. So no streaming state is
held: a batch is written under its own number, every few batches all rows are folded into one folder,
and a reader folds the newest folded folder with the batches after it. A batch that runs again overwrites
its own folder, and its fold starts again from the fold before it, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalgrid.operators.ranking import first_row
from rivalgrid.sources.tables import scratch

Fold = Callable[[DataFrame], DataFrame]


class Landing:
    """One stream's landed rows. ``every`` batches are folded into one folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, fold: Fold, every: int = 8):
        self.spark, self.folder, self.schema, self.fold, self.every = spark, folder, schema, fold, every

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        child = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and fs.exists(child(f"{self.folder}/{n}/_SUCCESS")))

    def folders(self, upto: int | None = None, before: int | None = None) -> list[str]:
        """What a reader needs: the newest fold (older than ``before``), and the batches after it up to ``upto``."""
        folds = [n for n in self._numbers("folded") if before is None or n < before]
        last = folds[-1] if folds else -1
        batches = [n for n in self._numbers("batch") if n > last and (upto is None or n <= upto)]
        return ([f"{self.folder}/folded-{last}"] if folds else []) + [f"{self.folder}/batch-{n}" for n in batches]

    def land(self, batch: DataFrame, number: int) -> None:
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        if (number + 1) % self.every == 0:
            rows = self.spark.read.schema(self.schema).parquet(*self.folders(number, number))
            self.fold(rows).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/folded-{number}")

    def read(self) -> DataFrame:
        found = self.folders()
        return self.fold(self.spark.read.schema(self.schema).parquet(*found)) if found else self.spark.createDataFrame([], self.schema)


def land_stream(stream: DataFrame, fold: Fold, name: str, every: int = 8, folder: str | None = None) -> DataFrame:
    """Land all that the stream has and return the folded rows. How much a batch holds is the source's
    rate limit (``maxFilesPerTrigger``). With ``folder`` a later run goes on where this one stopped."""
    folder = folder or scratch(stream.sparkSession, name)
    landing = Landing(stream.sparkSession, f"{folder}/rows", stream.schema, fold, every)
    query = stream.writeStream.foreachBatch(landing.land).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return landing.read()


def newest(keys: Sequence[str], order: Sequence[str]) -> Fold:
    """Keep the newest row of each key. ``order`` says what is newer and should be unique within a key."""
    def fold(rows: DataFrame) -> DataFrame:
        return first_row(rows, keys, [F.col(c).desc_nulls_last() for c in order])

    return fold


def log_until_mark(key: str, lateness_us: int | None = None) -> Fold:
    """Fold of an estimate log (key, ts_us, seq, value, is_mark): the first mark of each key, and the
    estimates before it that may still matter.

    A mark may come after estimates that it makes void, so estimates cannot be dropped for a newer one at
    once. With ``lateness_us``, no mark is expected that is older than the newest row by more than that:
    of the estimates before that time only the newest per key is kept, so a key holds one row and what
    came within the allowed lateness. Counting, ordering and cutting are Spark's; nothing is held per key.
    """
    def fold(rows: DataFrame) -> DataFrame:
        first = rows.where("is_mark").groupBy(key).agg(F.min("ts_us").alias("_first"))
        marks = first.select(key, F.col("_first").alias("ts_us"), F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"),
                             F.lit(None).cast(rows.schema["value"].dataType).alias("value"), F.lit(True).alias("is_mark"))
        open_ = rows.where(~F.col("is_mark")).join(first, key, "left").where(F.col("_first").isNull() | (F.col("ts_us") < F.col("_first"))).drop("_first")
        if lateness_us is not None:
            newest_ts = rows.agg(F.max("ts_us").alias("t")).first()["t"]
            if newest_ts is not None:
                settled = F.col("ts_us") < newest_ts - lateness_us
                open_ = first_row(open_.where(settled), [key], _latest()).select(*open_.columns).unionByName(open_.where(~settled))
        return open_.select(*rows.columns).unionByName(marks.select(*rows.columns))

    return fold


def _latest() -> list[Column]:
    return [F.col("ts_us").desc(), F.col("seq").desc()]


def logged(folded: DataFrame, key: str) -> DataFrame:
    """The estimate that stands per key, and whether its period is processed. A key without one is not listed."""
    best = first_row(folded.where(~F.col("is_mark")), [key], _latest(), ["value"])
    marked = folded.where("is_mark").select(key, F.lit(True).alias("frozen"))
    return best.join(marked, key, "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
