"""Shared plumbing of the training-data operators: shared-folder tables and word arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Byte table: ASCII capitals become small, the six ASCII white-space bytes become blanks.
LOWER_WS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Byte table: ASCII capitals become small, every other ASCII byte that is no digit or letter a blank.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` texts, unless the session asks for fewer: what a Python worker holds at a time.

    This is a setting of the session, which is read when a job runs; queries and stages set it, operators leave sessions alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, dealt over all cores where its files give fewer partitions (small files of one row group)."""
    bound_batches(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session without one gets a temporary folder; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _local_dirs:
            _local_dirs[name] = tempfile.mkdtemp(prefix="marlstone-")
        found = _local_dirs[name]
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marlstone-{spark.sparkContext.applicationId}"


def remove_saved(spark: SparkSession) -> None:
    """Remove all tables that save() wrote in this application. Results that were not written elsewhere can no longer be read then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    Later plans read the table, so it stays until remove_saved().
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows, counted before anything of it is broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within max_rows; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def salted_join(left: DataFrame, right: DataFrame, key: str, size: int = 512) -> DataFrame:
    """left joined to right, which has one row for each value of key, where left may repeat a value very often.

    Values with more than `size` rows in left are counted first; their rows are dealt over parts of about that size, and the row of
    right is repeated for each part. left is read twice, so it should be a written table.
    """
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") > size)
    hot = maybe_broadcast(save(hot.select(key, F.ceil(F.col("parts") / size).cast("int").alias("parts")), "hot-keys"), 1_000_000)
    one = F.coalesce("parts", F.lit(1)).cast("long")
    names = [c for c in left.columns if c != key]
    dealt = left.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(*names), one)).drop("parts")
    copies = right.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over an array of uint64."""
    z = x + np.uint64((salt * _STEP + _STEP) & _MASK)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << 16
    while size < n:
        size *= 2
    if not _powers or len(_powers[0]) < size:
        made = []
        for b in (_BASE, _INVERSE):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            made.append(np.multiply.accumulate(t))
        _powers[:] = made
    return _powers


def spaced(raw: bytes, table: bytes = LOWER_WS) -> bytes:
    """Words of raw under a byte table, joined by one blank."""
    return b" ".join(raw.translate(table).split())


def shingle_hashes(words: bytes, width: int = 5) -> np.ndarray:
    """64-bit hashes of every run of `width` words of a text made by spaced(), in text order.

    A text of fewer words is one run; an empty text has none. Works on prefix sums, so the cost is a few array
    passes whatever the width. Equal runs have equal hashes; different ones collide with probability 2^-64 or so.
    """
    if not words:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(words, np.uint8)
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[buf] * power[: len(buf)], out=sums[1:])
    gaps = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(buf)]))
    if len(starts) > width:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    elif len(starts) <= width:
        starts, ends = starts[:1], ends[-1:]
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
