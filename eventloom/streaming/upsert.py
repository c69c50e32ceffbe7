"""The batch fold inside a stream: sightings arrive, the index is upserted, old entries expire."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from eventloom.operators.merge import filled, within_run
from eventloom.sinks.store import live, path_exists, with_expiry


class KeyedTable:
    """A table in ``buckets`` by hash of its key, of which a micro-batch rewrites those that it has rows of.

    Each write is a new folder by bucket; a pointer names every bucket's newest folder, so readers never see half a
    write.  A batch that is replayed after a lost driver folds into what it wrote before and changes nothing.
    Where ``last_day`` is given, rows have ``expires_at`` and go, as their bucket is rewritten or read, when it has passed.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, columns: list[str], buckets: int = 64, order: str = "seq", last_day: str | None = None, now: Callable[[], int] | None = None):
        self.spark, self.root, self.key, self.columns = spark, root.rstrip("/"), key, columns
        self.buckets, self.order, self.last_day, self.now = buckets, order, last_day, now

    def _folders(self) -> dict[int, str]:
        """The newest folder of each bucket; ``buckets`` rows at most."""
        if not path_exists(self.spark, f"{self.root}/pointers"):
            return {}
        said = self.spark.read.schema("at long, bucket int, folder string").json(f"{self.root}/pointers")
        return {r.bucket: r.folder for r in said.groupBy("bucket").agg(F.max_by("folder", F.struct("at", "folder")).alias("folder")).collect()}

    def _read(self, folders: dict[int, str]) -> DataFrame | None:
        paths = [f"{self.root}/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        paths = [p for p in paths if path_exists(self.spark, p)]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """All rows that haven't expired; None before the first write."""
        rows = self._read(self._folders())
        return rows if rows is None or self.now is None else live(rows, self.now())

    def fold(self, batch: DataFrame, number: int) -> None:
        """Fold a micro-batch: known rows keep what they have, gaps are filled, the rest is new."""
        rows = within_run(batch, self.key, self.columns, self.order)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = [r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect()]
        if not touched:
            return
        folders = self._folders()
        stored = self._read({b: folders[b] for b in touched if b in folders})
        table = rows if stored is None else filled(stored, rows, self.key, self.columns)
        if self.last_day and self.now:
            table = with_expiry(table, self.now(), self.last_day)
            if stored is not None:  # what the batch doesn't have keeps its time
                kept = stored.join(rows.select(self.key), self.key, "left_anti").select(self.key, F.col("expires_at").alias("_kept"))
                table = table.join(kept, self.key, "left").withColumn("expires_at", F.coalesce("_kept", "expires_at")).drop("_kept")
            table = live(table, self.now())
        folder = f"batch-{number}-{uuid.uuid4().hex}"
        table.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        pointers = [(number, b, folder) for b in touched]
        self.spark.createDataFrame(pointers, "at long, bucket int, folder string").coalesce(1).write.mode("append").json(f"{self.root}/pointers")


def upsert_stream(sightings: DataFrame, table: KeyedTable, checkpoint: str) -> DataStreamWriter:
    """A writer that folds each micro-batch of ``sightings`` into ``table``."""
    return sightings.writeStream.foreachBatch(table.fold).option("checkpointLocation", checkpoint).outputMode("update")


def windowed_counts(events: DataFrame, at: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window, late rows dropped after ``late``; an extra that the batch side lacks."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count("*").alias("n"))
