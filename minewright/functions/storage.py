"""Materialising intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and Spark runs locally (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the planner a true size, so a
    later join broadcasts it only if it is under the session's threshold.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_blocks(df: DataFrame, rows: int, name: str = "blocks") -> list[tuple[str, ...]]:
    """Write df to the shared folder for tasks to read with read_block(): the files of each block of about `rows` rows.

    For a stated query set that meets all rows of a large table: however large it is, a task holds a block, and nothing
    of it passes through the driver but the names of files.
    """
    total, each = df.count(), max(1, rows // 8)
    if not total:
        return []
    files = sorted(materialize(df.repartition(max(1, -(-total // each))), name).inputFiles())
    together = max(1, rows // each)
    return [tuple(files[i : i + together]) for i in range(0, len(files), together)]


def read_block(files: tuple[str, ...]) -> pa.Table:
    """The rows of a block, in a task."""
    store, _ = fs.FileSystem.from_uri(files[0])
    return pa.concat_tables([pq.read_table(fs.FileSystem.from_uri(f)[1], filesystem=store, partitioning=None) for f in files])


class Scratch:
    """The intermediate tables of one computation, in a folder of its own under the shared one.

    Tables are deleted by drop(); those that a returned DataFrame still reads must stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written to the folder and read back; see materialize()."""
        self.count += 1
        path = f"{self.folder}/{name}-{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so when the driver's JVM finds their plans to be garbage, and
        as lineage is cut at the tables kept here, no step reads them again."""
        self.spark.sparkContext._jvm.System.gc()

    def done(self, df: DataFrame) -> DataFrame:
        """df, the result of the computation, kept; all other tables are deleted."""
        out = self.keep(df, "result")
        self._delete(lambda name: name.rsplit("-", 1)[0] != "result")
        return out

    def drop(self, *names: str) -> None:
        """Delete the tables kept under these names."""
        self._delete(lambda name: name.rsplit("-", 1)[0] in names)

    def _delete(self, wanted: Callable[[str], bool]) -> None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(root):
            for status in store.listStatus(root):
                if wanted(status.getPath().getName()):
                    store.delete(status.getPath(), True)
