"""Shared helpers of the training-data operators: shared storage, batching, and word splitting.

Conventions that hold for every operator here:

* An operator reads only the columns it is told (``id_col``, ``text_col`` ...), so extra columns
  with any name, result names included, cannot clash with what it returns.
* A null text counts as the empty text unless an operator says otherwise.
* Rows are never merged by id unless an operator says so: a repeated row gets a repeated result.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.plans import storage
from setweave.plans.storage import drop, new_name, shared_dir

__all__ = ["cut", "drop", "filter_texts", "fold", "give_back", "likely_first", "map_texts", "new_name", "ranges", "raw_of", "shared_dir", "steps", "table", "texts_of", "words_of"]

#: UTF-8 bytes of text that one numpy step works on at most (a single longer text is one step).
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to Python, as a session's setting may allow far more, for the JVM and for Python at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless it has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """``storage.cut``, by small batches."""
    small_batches(df.sparkSession)
    return storage.cut(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(0))


def likely_first(df: DataFrame, n: int, salt: str, *keys: str) -> tuple[DataFrame, Column]:
    """Some more than ``n`` rows of ``df``, among them those with the ``n`` least hashes of ``keys``, and that hash.

    The filter needs a count only, so that what a sort then gathers from each task is its share of ``n`` rows, and not ``n``.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *keys), 2)
    share = (1.2 * n + 200) / max(1, df.count())
    return (df.where(h < int(share * 2**62)) if share < 1 else df), h


def steps(lengths: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to about ``most`` at most, one row at least."""
    ends = np.cumsum(lengths)
    start, n = 0, len(lengths)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def give_back() -> None:
    """Returns what a finished task has freed to the system: workers stay, and their memory counts beside the JVM's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_texts(
    df: DataFrame,
    kernel: Callable[[], Callable[[list[str]], dict]],
    schema: str,
    keep: list[str],
    text_col: str = "text",
    most: int = STEP_BYTES,
    arrow: bool = False,
) -> DataFrame:
    """``keep`` columns and what a kernel makes of each text; no shuffle.

    ``kernel()`` is called once in each task and returns a function from a list of texts (null:
    empty), or with ``arrow`` from an array of strings, to a dict of equally long columns. ``schema`` is DDL of those
    columns. A step takes texts of ``most`` bytes at most, or one text.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")] if schema else []
    small_batches(df.sparkSession)
    source = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text_col].alias("t"))
    out = ", ".join([f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            texts = batch.column(len(keep))
            lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
            for a, b in steps(lengths, most):
                own = texts.slice(a, b - a)
                made = work(own if arrow else texts_of(own))
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    kept + [pa.array(made[n]) for n in names], [f"k{i}" for i in range(len(keep))] + names
                )
        del work
        give_back()

    made = source.mapInArrow(run, out)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def filter_texts(df: DataFrame, kernel: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` (all columns as they are) whose text a kernel accepts; no shuffle."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            texts = batch.column(at)
            lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
            for a, b in steps(lengths):
                verdict = pa.array(np.asarray(work(texts_of(texts.slice(a, b - a))), dtype=bool))
                yield batch.slice(a, b - a).filter(verdict)
        del work
        give_back()

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def raw_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings (null: empty), without a copy, and where each string begins; the last ends there."""
    column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    if at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(text: str) -> list[bytes]:
    """The runs of bytes other than space and \\t-\\r."""
    return text.encode("utf-8", "surrogatepass").split()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
