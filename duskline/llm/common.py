"""What the operators share: shared-folder tables, row keys, Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a few numbers that may be broadcast (about 30 MB); callers count first and shuffle beyond it.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch while a table is settled; Spark's own 64 MB, held by JVM and worker at once, is much for a small executor.
BATCH_BYTES = "8m"
#: Rows of a key, at least, before spread_join() splits it.
HOT_ROWS = 256
_own_folder: list[str] = []
_settled: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (tests) a local one of a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="duskline-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/duskline-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """big joined with small, which has one row for each key at most; rows of a hot key of big go to many tasks.

    A key is hot above HOT_ROWS rows and above a quarter of a task's mean share, so hot keys are at most four times the
    shuffle partitions; only their counts are broadcast. The row of small is repeated for each part of a hot key.
    big is read twice (counted first), so it should be settled. Null keys match nothing. counted: big's keys and their rows `__n`, if known.
    """
    rows = big.count()
    least = max(HOT_ROWS, rows // (4 * shuffle_partitions(big.sparkSession)))
    counted = big.groupBy(*keys).agg(F.count("*").alias("__n")) if counted is None else counted
    hot = settle(counted.where(F.col("__n") > least).select(*keys, F.expr(f"int(ceil(__n / {least}))").alias("__parts")))
    if hot.isEmpty():
        return big.join(small, list(keys), how)
    hot = F.broadcast(hot)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = big.join(hot, list(keys), "left").withColumn("__part", F.pmod(F.xxhash64(*big.columns), parts)).drop("__parts")
    copies = small.join(hot, list(keys), "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")


def settled() -> list[str]:
    """The folders of all settled tables that this process has made and not deleted."""
    return list(_settled)


def release(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete settled tables (all, or those in these folders). Call it once no frame that was built on them will be read again."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for folder in settled() if folders is None else folders:
        if folder in _settled:
            _settled.remove(folder)
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()  # Spark deletes the shuffle files of finished steps once the driver's garbage is collected


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A key of a row that also holds where ids are null or repeat with other texts."""
    return F.struct(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("text_hash"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def map_all_columns(df: DataFrame, on_batches, added: T.DataType | None = None, name: str = "") -> DataFrame:
    """df.mapInArrow over all columns, whatever their names; on_batches may add one column of type `added` called `name`."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("made", added)]) if added else plain.schema
    return plain.mapInArrow(on_batches, schema).toDF(*df.columns, *([name] if added else []))


class Bitmap:
    """A set of 64-bit hashes as bits at their top `bits` bits; may also say yes to others."""

    def __init__(self, bits: int, pages: dict[int, bytes]):
        data = np.zeros((1 << bits) // 8, np.uint8)
        for page, content in pages.items():
            data[page * PAGE : page * PAGE + len(content)] = np.frombuffer(content, np.uint8)
        self.bits, self.data, self.any = bits, data, bool(pages)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not self.any:
            return np.zeros(len(hashes), bool)
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.data[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


PAGE = 1 << 12
#: At most 8 MB.
MOST_BITS = 26


def bitmap(keys: DataFrame) -> Bitmap:
    """A bitmap of the one column of keys, 64-bit hashes.

    It grows with the number of keys up to 2**MOST_BITS bits, which bounds what is broadcast; beyond that it says yes to more keys
    that are not in it. Its pages are made on executors, each in one task.
    """
    keys = keys.toDF("key")
    n = keys.count()
    bits = min(MOST_BITS, max(15, int(16 * max(1, n)).bit_length()))

    def on_table(table: pa.Table) -> pa.Table:
        slot = np.asarray(table["slot"])
        page = int(slot[0] // (8 * PAGE))
        own = np.zeros(8 * PAGE, bool)
        own[slot - page * 8 * PAGE] = True
        return pa.table([pa.array([page], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["page", "content"])

    slots = keys.select(F.expr(f"shiftrightunsigned(key, {64 - bits})").alias("slot")).distinct()
    made = slots.groupBy(F.expr(f"slot div {8 * PAGE}").alias("page")).applyInArrow(on_table, "page long, content binary")
    return Bitmap(bits, {r.page: bytes(r.content) for r in made.collect()} if n else {})
