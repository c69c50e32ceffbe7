"""Shared plumbing: scratch tables in the cluster's shared folder, table loading, Arrow batch size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the ASCII controls 0x09-0x0D.
WORD_SEP = r"[\x20\x09-\x0D]+"

#: Rows and bytes that one Arrow batch of whole texts may hold; the same for all callers, as plans are lazy.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20

#: Bits of the filter of ``without`` for each id, at least, and in all, at most: 8 MB are broadcast, whatever the input.
BITS_PER_ID, MOST_BITS = 32, 1 << 26

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own, in local mode only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        path = tempfile.mkdtemp(prefix="eventloom-")
        atexit.register(shutil.rmtree, path, True)
        _own_root[app] = f"file://{path}"
    return _own_root[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **told: Column) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    ``told``: aggregates of all rows, taken while they are written, so that no query on the result need ask for them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    seen = Observation() if told else None
    (df.observe(seen, *(c.alias(name) for name, c in told.items())) if told else df).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch, back.told = path, seen.get if told else {}
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is none of ``ids(key)``, which has each once: a left anti join that deals out few rows.

    A bit for each hash of an id is broadcast.  Rows without theirs stay where they are; only the others meet the
    ids, which decide.  So what is shuffled grows with the rows that go, and 1/32 of those that stay; with over two
    million ids the bits fill, and the rest takes part as in a plain join.
    """
    bits = min(MOST_BITS, 1 << max(15, (BITS_PER_ID * ids.count() - 1).bit_length()))
    # a record holds 32,768 bits
    place = F.xxhash64(F.col(key).cast(ids.schema[key].dataType)).bitwiseAND(bits - 1)
    slot = place.bitwiseAND(32767)
    blocks = ids.groupBy(F.shiftright(place, 15).alias("_block")).agg(F.bitmap_construct_agg(slot).alias("_bits"))
    marked = df.withColumn("_block", F.shiftright(place, 15)).join(F.broadcast(materialize(blocks, "id-filter")), "_block", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("_bits", F.coalesce(F.getbit(byte, slot.bitwiseAND(7).cast("int")) == 1, F.lit(False)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    stay, met = (marked.where(x).select(*columns) for x in (~F.col("_bits"), F.col("_bits")))
    return stay.unionByName(met.join(ids, key, "left_anti").select(*columns))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts may hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, folds: int):
    """crc32 of the id's text modulo ``folds``: the hold-out split of the labelled tables."""
    return F.crc32(doc_id.cast("string")) % folds


def bounded_sample(df: DataFrame, most: int, *keys) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``keys``; ties in order of the keys.

    The rows are counted first, and those whose hash can't be among the smallest are left out where they
    are, so what meets in one place grows with ``most`` and not with the table or its partitions.
    """
    place = F.shiftrightunsigned(F.xxhash64(*keys), 11)
    n = df.count()
    if n > most:
        df = df.where(place < F.lit(int((1 << 53) * min(1.0, 1.2 * (most + 50) / n))))
    return df.orderBy(place, *keys).limit(most)
