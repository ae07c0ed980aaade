"""Intermediate tables in the shared folder: they cut lineage and outlive any executor.

Each application has one folder of its own below the shared one; it goes when the application ends, and what
is known to be no longer read goes earlier (`drop`).
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}  # by application


class NoSharedFolder(RuntimeError):
    pass


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir (or setCheckpointDir) names; one of our own only in local mode without either."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = given.get() if given.isDefined() else None
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise NoSharedFolder("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='corollary-')}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def root(spark: SparkSession) -> str:
    """This application's folder, made on first use; the file system deletes it when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        folder = f"{shared(spark)}/corollary-{app}-{uuid.uuid4().hex[:8]}"
        fs, p = _path(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _folders[app] = folder
    return _folders[app]


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; DataFrames that read them can't be used any more."""
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder:
        fs, p = _path(spark, folder)
        fs.delete(p, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing will read again."""
    for path in paths:
        fs, p = _path(spark, path)
        fs.delete(p, True)


@dataclass
class Table:
    """A written relation: parts that are read as one."""

    schema: object
    paths: list[str]
    rows: int

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*self.paths) if self.paths else spark.createDataFrame([], self.schema)

    def plus(self, other: Table) -> Table:
        return Table(self.schema, [*self.paths, *other.paths], self.rows + other.rows)


@dataclass
class Given:
    """A relation that is a table already, in the place of a written one."""

    frame: DataFrame

    @property
    def schema(self) -> object:
        return self.frame.schema

    def df(self, spark: SparkSession) -> DataFrame:
        return self.frame

    def plus(self, other: Table) -> Given:
        return Given(self.frame.unionByName(other.df(self.frame.sparkSession)))


def write(df: DataFrame, name: str, folder: str | None = None) -> Table:
    """Writes df once, into the scratch folder unless another is given; the rows are counted as they go by."""
    spark = df.sparkSession
    path = f"{folder or root(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return Table(df.schema, [path], int(seen.get["n"]))
