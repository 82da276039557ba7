"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed for whole texts in Arrow columns, and the trees, flattened into arrays, score batches.
They are fitted on a bounded sample of labelled documents (labelled.SAMPLE) in the learning folds.

Defined cases: a null or empty text has the statistics of an empty one and is scored like any other; without
labels the score is 0.5 throughout; a very long text is measured whole; of several labels of an id 1 holds; a score equal to the threshold
predicts 1; repeated rows each give a row; a row without id is not held out; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import trees
from .labelled import SAMPLE, fold, sample
from .quality_rules import repeated

STATISTICS = (
    "words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_3", "repeated_5", "lines", "words_a_line",
    "dup_lines", "short_lines", "symbols", "bars", "marks", "commas", "stops", "upper", "digits", "breaks", "non_ascii", "next_same",
)
THRESHOLD = 0.3


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def statistics(text: pa.Array) -> np.ndarray:
    """One row a text, in the order of STATISTICS."""
    def count(pattern):
        return pc.count_substring_regex(text, pattern).to_numpy(zero_copy_only=False)

    offsets, values = T.words(text)
    rows = len(text)
    n = np.diff(offsets)
    codes, distinct = T.coded(values)
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = T.per_row(offsets, size)
    doc = np.repeat(np.arange(rows), n)
    pairs, times = np.unique(doc * (len(distinct) + 1) + codes, return_counts=True)
    top = np.zeros(rows)
    np.maximum.at(top, pairs // (len(distinct) + 1), times)
    same = np.concatenate([[False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])]) if len(codes) else np.zeros(0, bool)
    line_at, lines = T.lists(pc.split_pattern(text, "\n"))
    line_doc = np.repeat(np.arange(rows), np.diff(line_at))
    line_size = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
    real = line_size > 0
    line_code, _ = T.coded(lines)
    first = ~pd.Series(line_code * (rows + 1) + line_doc).duplicated().to_numpy()
    n_lines = np.bincount(line_doc[real], minlength=rows)
    length = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    columns = [
        np.log1p(n), _share(chars, n), _share(T.per_row(offsets, size > 12), n), _share(T.per_row(offsets, size < 3), n),
        _share(np.bincount(pairs // (len(distinct) + 1), minlength=rows), n), _share(top, n),
        _share(T.per_row(offsets, repeated(offsets, codes, 3)), n), _share(T.per_row(offsets, repeated(offsets, codes, 5)), n),
        np.log1p(n_lines), _share(n, n_lines), _share(n_lines - np.bincount(line_doc[real & first], minlength=rows), n_lines),
        _share(np.bincount(line_doc[real & (line_size < 20)], minlength=rows), n_lines),
        _share(count(r"[#*$%&<>]"), n), _share(count(r"\|"), n), _share(count(r"[!?]"), n), _share(count(","), n), _share(count(r"\."), n),
        _share(count("[A-Z]"), length), _share(count("[0-9]"), length), _share(length - chars, n),
        _share(pc.binary_length(text).to_numpy(zero_copy_only=False) - length, length), _share(T.per_row(offsets, same), n),
    ]
    return np.stack(columns, axis=1).astype(float)


def _columns(batches):
    for part in T.slices(batches):
        x = statistics(pc.fill_null(part.column("text"), ""))
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, learn, size: int = SAMPLE) -> trees.Model:
    """``learn``: a condition on doc_id; at most ``size`` rows of statistics come to the driver."""
    T.bounded_batches(docs.sparkSession)
    got = sample(docs, labels, "quality", learn, size).select("label", "text").mapInArrow(_columns, "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(STATISTICS))
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # the order in which rows come doesn't matter
    return trees.boost(x[order], got["label"].to_numpy(float)[order])


def score(docs: DataFrame, model: trees.Model):
    """The score as a column of ``text``."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([trees.sigmoid(model.total(statistics(x))) for x in T.array_slices(text)] or [np.zeros(0)]))

    return T.id_and_text(docs).withColumn("score", scored("text"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, fold(F.col("doc_id"), folds) != out)
    held = fold(F.col("doc_id"), folds) == out
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
