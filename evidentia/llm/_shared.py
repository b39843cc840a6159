"""What the operators of this subpackage share: the shared folder, held-out folds and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine master may go without:
    there a temporary folder is made and set as the checkpoint folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which ends its lineage there."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``settle`` made; nothing may read them afterwards."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Give memory that is free back to the system: Python workers live on after their tasks, and the driver after its fits."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, max_chars: int = 2_000_000, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds at most about ``max_chars`` bytes of the column ``text``, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and (total + size > max_chars or i - begin >= max_rows):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)
    tidy()


def filter_texts(docs: DataFrame, keep: Callable[[list[str | None]], Sequence[bool]]) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, whose text ``keep`` wants."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(text)).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of these, compressed."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


#: A small side under this measured size is broadcast; a greater one is dealt by key and one of so many numbers.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def join_small(big: DataFrame, small: DataFrame, key: str, spread: Column, small_bytes: int, how: str) -> DataFrame:
    """``big`` with the rows of its key in ``small``, whose size was measured; ``spread`` deals a hot key's rows among the salts."""
    if small_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, how)
    salt = "__salt"
    while salt in big.columns:
        salt = "_" + salt
    many = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn(salt, F.pmod(spread, F.lit(SALTS)).cast("int")).join(many, [key, salt], how).drop(salt)


SLOTS = 1 << 25


class Slots:
    """A bit map of fixed size of numbers, broadcast: it tells all that are in a table, and few others."""

    def __init__(self, rows: DataFrame, column: str, hashed: bool = False):
        """hashed: the numbers are hashes already, and their highest bits choose the bit."""
        self.hashed, self.bits = hashed, SLOTS.bit_length() - 1
        slot = self._slot(column) + 1  # bit maps count from 1
        maps = rows.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
        bits = np.zeros(SLOTS // 8, np.uint8)
        for b, m in maps:
            bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
        self.shared = rows.sparkSession.sparkContext.broadcast(bits)

    def _slot(self, column: str) -> Column:
        return F.shiftrightunsigned(column, 64 - self.bits) if self.hashed else F.pmod(F.xxhash64(column), F.lit(SLOTS))

    @staticmethod
    def test(bits: np.ndarray, numbers: np.ndarray, width: int) -> np.ndarray:
        """Which of these hashes may be in the table."""
        at = (numbers >> np.uint64(64 - width)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def may_have(self, column: str) -> Column:
        shared = self.shared

        @F.pandas_udf("boolean")
        def run(slot: pd.Series) -> pd.Series:
            at = slot.to_numpy(np.int64)
            return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

        return run(self._slot(column))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, in reading order, and the name of that column. ``docs`` must be a table."""
    number = "__row"
    while number in docs.columns:
        number = "_" + number
    return docs.withColumn(number, F.monotonically_increasing_id()), number


def without(rows: DataFrame, number: str, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose number is in the table ``gone``, and without the number; rows that surely stay are not moved."""
    maybe = Slots(gone, number).may_have(number)
    kept = rows.filter(~maybe).unionByName(rows.filter(maybe).join(gone, number, "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in rows.columns if c != number])
