"""Shared helpers of the training-data operators: shared-folder tables, Arrow mapping, word rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII letters and digits plus everything outside ASCII count as word characters once A-Z is lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; only in local mode is another one made up."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return (where or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tidemark").rstrip("/")


#: Tables that this process has written and not yet deleted, and which table a DataFrame reads.
_TABLES: dict[str, SparkSession] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which cuts its lineage.

    Unlike an RDD checkpoint this computes the plan a single time, and it survives the loss of executors. The table lives
    until ``release``, or until this process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the tables of materialized frames that nothing will read again; other frames are passed over."""
    for df in frames:
        if (path := _PATHS.pop(df, None)) is not None:
            _delete(path, _TABLES.pop(path))


def tables() -> set[str]:
    """Paths of the tables there are now."""
    return set(_TABLES)


def release_since(before: set[str], keep: DataFrame) -> None:
    """Deletes the tables made since ``tables()`` returned ``before``, but not that of ``keep``."""
    for path in set(_TABLES) - before - {_PATHS.get(keep)}:
        _delete(path, _TABLES.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        for path, spark in list(_TABLES.items()):
            _delete(path, spark)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
        have.add(n.lower())
    return out


def need_integral(df: DataFrame, id_col: str) -> None:
    """Order of ids is that of numbers in some operators; ids of other types are refused before any job runs."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker, which lives on, gives freed memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are passed over."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                yield from [got] if isinstance(got, pa.RecordBatch) else got

    return df.mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    """Documents that no learner may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def utf8_views(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
