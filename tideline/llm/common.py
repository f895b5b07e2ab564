"""What the operators of this subpackage share: table access, word splitting, text chunks, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of words as the contracts write them, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became
#: a-z: digits, a-z and everything beyond ASCII. All other bytes become blanks.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; null has none."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def crc32_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; -1 where the key is null."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n, F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see: the one that spark.checkpoint.dir names.

    Only on one machine, and only where neither session nor context names one (as in tests), it is a
    temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tideline-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


class Tables:
    """Intermediate tables of one operator, written below the shared folder and removed together."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._count = spark, 0
        self._folder = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        """df as written; its lineage, statistics and constraints start anew there."""
        self._count += 1
        path = f"{self._folder}/{self._count}"
        with shuffles_removed(self._spark):
            df.select("*").write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the tables; nothing may read them any more."""
        remove(self._spark, self._folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside has its shuffle files removed when it ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(numbers: DataFrame, bits: int = 25) -> np.ndarray:
    """2^bits places as bytes, with those of the low bits of a column of longs set.

    Its size (4 MB) does not depend on the rows; it lets a pass over a table leave out most of what no
    other table asks for, before anything is shuffled. It decides about cost alone: the more of it is
    set, the more rows take part in the shuffle.
    """
    low = numbers[numbers.columns[0]].bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark's buckets count from 1
    parts = numbers.groupBy(F.call_function("bitmap_bucket_number", low).alias("w")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", low)).alias("m")).collect()  # 2^10 blocks at most
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        block = np.frombuffer(bytes(r.m), np.uint8)
        out[(r.w - 1) * len(block) : r.w * len(block)] = block
    return out


def in_bitmap(have: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers & (8 * len(have) - 1)
    return (have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What runs inside sends at most `rows` rows at a time to Python, so that batches of texts stay small there and in the JVM."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def chunks(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive items that together hold at most `most` units, or a single larger item."""
    start, held, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if i >= start:
        yield start, i + 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: uint64 in, well mixed uint64 out (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
