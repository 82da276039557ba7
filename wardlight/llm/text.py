"""Shared helpers: Arrow word splitting, bounded slices of Arrow batches, lineage cuts.

A word is a run of characters other than space and U+0009..U+000D.  Arrow's
``ascii_split_whitespace`` splits at exactly those six characters, so whole
batches are tokenised without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, scratch  # noqa: F401

#: Text bytes handled at once inside a task; a single longer document is one slice.
SLICE_BYTES = 8 << 20
#: Rows in one Arrow batch sent to Python: at the default of 10,000 a batch of long documents would not fit.
BATCH_ROWS = 1000
WORD_SQL = r"[^\\x20\\x09-\\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def row_hash() -> Column:
    """A hash of all columns, which puts rows that are equal in a key in an order that is the same in each run.  As JSON, since a map has no hash."""
    return F.xxhash64(F.to_json(F.struct("*")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; others, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cuts(text: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with at most ``limit`` bytes (at least one row each)."""
    return runs(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64), limit)


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows whose sizes sum up to at most ``limit`` (at least one row each)."""
    ends = np.cumsum(sizes)
    start, used = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, used + limit, side="right")))
        yield start, stop - start
        used, start = int(ends[stop - 1]), stop


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, n in cuts(batch.column(column), limit):
            yield batch.slice(start, n)


def together(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """As ``slices``, but across batches: each slice is as large as ``limit`` lets it be."""
    held: list[pa.RecordBatch] = []
    used = 0
    for part in slices(batches, column, limit):
        size = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and used + size > limit:
            yield pa.concat_batches(held)
            held, used = [], 0
        held.append(part)
        used += size
    if held:
        yield pa.concat_batches(held)


def array_slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of a column of texts, nulls as empty texts."""
    for start, n in cuts(text, limit):
        yield pc.fill_null(text.slice(start, n), "")


def lists(values: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than rows, from 0) and the flat values."""
    n = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)]), values.flatten()


def words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets by document and the words of all documents in order; null texts have none."""
    offsets, values = lists(pc.ascii_split_whitespace(pc.fill_null(text, "")))
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return offsets, values
    return np.concatenate([[0], np.cumsum(full)])[offsets], values.filter(pa.array(full))


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct values, and those."""
    if len(values) == 0:
        return np.zeros(0, np.int64), pa.array([], values.type)
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def per_row(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def joined(offsets: np.ndarray, values: pa.Array, by: str | bytes) -> pa.Array:
    """The values of each row in one string."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values), by)
