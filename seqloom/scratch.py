"""Written tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Rows of a few numbers that a file of a table of known size has: many small files cost more than the rows in them.
ROWS_A_FILE = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where driver and executors are one process may it be unset: then a temporary one serves until the end."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        folder = _own[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + _own[context.applicationId]


class Scratch:
    """Tables of one computation under the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: dict[str, DataFrame] = {}

    def write(self, df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
        """The table read back, and its path. rows: how many there are at most, where that is known; the last stage then has tasks by it."""
        path = f"{self.root}/{self.count}"
        df = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        table = self.tables[path] = self.spark.read.schema(df.schema).parquet(path)
        return table, path

    def cut(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        return self.write(df, rows)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.tables.pop(path, None)

    def release(self, *keep: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        for path in [p for p, t in self.tables.items() if not any(t is k for k in keep)]:
            self.drop(path)

    def clean(self) -> None:
        """Spark deletes the files of shuffles that are over when their owner is collected, which may be long after."""
        gc.collect()
        self.spark._jvm.System.gc()
