"""Tables of state: staged overwrites, upserts with an expiry, a bounded run log."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.dates import ttl_seconds


_own: dict[str, str] = {}


def state_root(spark: SparkSession, tag: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, in a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="eventloom-")
            atexit.register(shutil.rmtree, _own[app], True)
        root = f"file://{_own[app]}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def with_expiry(records: DataFrame, now_seconds: int, last_day: str = "last_day") -> DataFrame:
    return records.withColumn("expires_at", F.lit(now_seconds) + ttl_seconds(F.col(last_day), F.lit(now_seconds)))


def upserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def live(table: DataFrame, now_seconds: int) -> DataFrame:
    return table.where(F.col("expires_at") > now_seconds)


def without(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def ring(log: DataFrame, order: str = "at", most: int = 20) -> DataFrame:
    """The newest ``most`` rows."""
    return log.orderBy(F.desc(order)).limit(most)


class Versions:
    """A table as numbered folders below ``root`` and a one-row pointer table, so readers never see half a write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("at long, folder string").json(f"{self.root}/pointers")

    def write(self, df: DataFrame, at: int) -> str:
        folder = f"v{at}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{folder}")
        self.spark.createDataFrame([(at, folder)], "at long, folder string").coalesce(1).write.mode("append").json(f"{self.root}/pointers")
        return folder

    def read(self) -> DataFrame:
        latest = self._pointers().orderBy(F.desc("at"), F.desc("folder")).first()
        return self.spark.read.parquet(f"{self.root}/{latest.folder}")


class Lock:
    """Mutual exclusion by a file that only one can create; one older than ``seconds`` was left behind and counts for nothing."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = 180):
        self.seconds = seconds
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def acquire(self, now_seconds: float) -> bool:
        if self.store.exists(self.path) and now_seconds - self.store.getFileStatus(self.path).getModificationTime() / 1000 > self.seconds:
            self.store.delete(self.path, False)
        return bool(self.store.createNewFile(self.path))

    def release(self) -> None:
        self.store.delete(self.path, False)
