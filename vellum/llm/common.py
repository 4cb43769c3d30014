"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are runs of anything but these (space and 0x09-0x0D).
SPACE = " \t\n\x0b\x0c\r"
#: Keys of more rows than total / MOST_HOT, and of LEAST_HOT, are hot: there are at most MOST_HOT of them.
LEAST_HOT, MOST_HOT = 2048, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or a temporary one in local mode where it is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder; what comes after survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder between steps; unlike checkpoints they are columnar, of known size, and can go."""

    folders: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0
        self.folders.append(self.at)

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.at}/{self.made}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found.scratch_path = path
        return found

    def free(self, *tables: DataFrame | None) -> None:
        """Deletes tables of save() that nothing reads any more."""
        for t in tables:
            if t is not None:
                delete(self.spark, t.scratch_path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables of Scratch that this driver has made: to be called when the results that rest on them are written."""
    while Scratch.folders:
        delete(spark, Scratch.folders.pop())


def split_join(rows: DataFrame, known: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with known (one row a key; column size: the key's count of rows, total in all).

    Hot keys are joined by a broadcast, which their number bounds, so that no task receives all rows of one. The others
    are always shuffled, so a plan for few rows is that for many.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot = F.broadcast(known.where(F.col(size) > limit))
    cold = rows.join(hot.select(*([on] if isinstance(on, str) else on)), on, "left_anti").join(known.where(F.col(size) <= limit).hint("merge"), on, how)
    return rows.join(hot, on).unionByName(cold)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unit_hash(*cols) -> F.Column:
    """A number in [0, 1) from the columns' values, the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))
