"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a Parquet table and reading it
back: the copy survives the loss of any executor, is columnar, and gives the
planner sizes.  The folder is ``spark.checkpoint.dir`` of the session; where that
is unset, a local master (tests, a laptop) gets a local one, and on a cluster it
is an error, as executors would not see the driver's folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def free_name(columns: list[str], base: str) -> str:
    """base, with underscores after it as long as columns (in any case) have that name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


class Scratch:
    """A folder of tables for one run of one operator; gone when the JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and return the table."""
        schema = df.schema
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
