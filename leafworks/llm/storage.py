"""Tables between jobs: written to the folder that all executors share, so that no lineage is needed to reread them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leafworks.functions.folders import shared_dir
from leafworks.functions.shipping import ship


#: Folders written since each open Stage began.
_STAGES: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def deleted(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: the lineage ends here and survives lost executors.

    Results may read the table, so it stays until the driver ends, and is deleted then; inside a Stage it goes with the stage.
    """
    out, path = _write(df)
    if _STAGES:
        _STAGES[-1].append(path)
    files, at = _path(df.sparkSession, path)
    files.deleteOnExit(at)
    return out


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafworks-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Stage:
    """A step whose written() tables nothing reads once its result has been kept: they are deleted at the end of the with block, its result with drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], None

    def __enter__(self) -> Stage:
        _STAGES.append(self.made)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes the step's result."""
        out, self.kept = _write(df)
        files, at = _path(self.spark, self.kept)
        files.deleteOnExit(at)
        return out

    def drop(self) -> None:
        if self.kept:
            deleted(self.spark, self.kept)

    def __exit__(self, *_) -> None:
        _STAGES.remove(self.made)
        for path in self.made:
            deleted(self.spark, path)


class Scratch:
    """Written tables that an operator needs only until its results are written: each goes when dropped, all go at the end of the with block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in list(self.paths.values()):
            self._delete(path)
        self.paths.clear()

    def write(self, df: DataFrame) -> DataFrame:
        out, path = _write(df)
        self.paths[id(out)] = path
        # the table must not be confused with a later one at the same address
        out._leafworks_scratch = self
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table_ in tables:
            if path := self.paths.pop(id(table_), None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        deleted(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Readies the session for Python tasks: sends them the package, and bounds what one Arrow batch holds, so that workers need little memory whatever the texts' lengths."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
