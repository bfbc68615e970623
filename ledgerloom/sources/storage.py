"""Files through the session's own file systems, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: workers needn't have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on one machine, where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jsc.get() if jsc.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        Store(df.sparkSession, path).remove(path)


class Store:
    """A folder tree of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        at = self._path(root)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(at).toString().rstrip("/")

    def _at(self, path: str):
        return self._path(path)

    def is_folder(self, path: str) -> bool:
        at = self._at(path)
        return self._fs.exists(at) and self._fs.getFileStatus(at).isDirectory()

    def is_file(self, path: str) -> bool:
        at = self._at(path)
        return self._fs.exists(at) and not self._fs.getFileStatus(at).isDirectory()

    def make_folder(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def names(self, path: str) -> Iterator[str]:
        for status in self._fs.listStatus(self._at(path)):
            yield status.getPath().getName()

    def replace(self, source: str, target: str) -> None:
        """Move a file, over another if need be."""
        self._fs.delete(self._at(target), False)
        if not self._fs.rename(self._at(source), self._at(target)):
            raise OSError(f"can't move {source} to {target}")

    def remove(self, path: str) -> None:
        self._fs.delete(self._at(path), True)
