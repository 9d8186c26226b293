"""What the corpus operators share: tables written to the shared folder and text expressions."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class.
WHITE = r"[\x20\x09-\x0D]"


#: Lets Spark remove a statement's shuffle files when the statement ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse.

    A warehouse on the driver's own disk serves only where executors run in the driver.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master) and warehouse.startswith(("file:", "/")):
        raise ValueError(f"executors can't share {warehouse}: set spark.checkpoint.dir to a folder that all machines reach")
    return f"{warehouse}/_scratch"


#: Runs whose tables are still there.
_LIVE: list[Scratch] = []


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Statements that end here leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def drop_scratch() -> None:
    """Remove the tables of all operator runs so far, once their results are no longer read; else they go when the driver ends."""
    while _LIVE:
        _LIVE.pop().drop()


class Scratch:
    """Tables of one operator run, as Parquet under the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of the
    running stage, and numbering done before the write can't change later.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/larkspur/{label}-{uuid.uuid4().hex}"
        if not _LIVE:
            atexit.register(drop_scratch)
        _LIVE.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Remove tables whose last reader is done; without names, all."""
        for where in [f"{self.path}/{name}" for name in names] or [self.path]:
            self._remove(where)

    def _remove(self, where: str) -> None:
        try:
            jvm, jsc = self.spark._jvm, self.spark._jsc
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # at exit the JVM may be gone; the folder is scratch space
            pass


def collapsed(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " ")
