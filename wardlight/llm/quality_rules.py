"""Quality rules kept in a bitmask ledger.

One scan measures every document and evaluates every rule once; the ledger holds
the measurements and one failure bit a rule.  Policies are versioned masks over
those bits, so that another policy, or leaving a rule out, needs only the ledger:
a document is kept under a policy if ``fail_bits & mask = 0``.

Defined cases: a null or empty text has no words and fails ``too_few_words``;
a very long text is measured whole; a measure that equals a rule's limit passes it; repeated rows and repeated or null ids are judged row by row; an empty table
gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import text as T

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
WINDOW = 5

#: Rules in bit order: name and the condition, in SQL over the measurements, under which a document fails.
RULES = (
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("shouting", "100 * n_upper > 30 * word_chars"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("too_few_words", "repeated_windows")
#: Policies by version: the rules that reject.
POLICIES = {"v1": BASE, "v2": tuple(BITS)}


def mask(version: str) -> int:
    return sum(BITS[r] for r in POLICIES[version])


def repeated(offsets: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """True for each word in a window of ``size`` words that stands twice or more in its document.

    Windows are compared exactly: pairs of codes are numbered again and again until a number stands for a window.
    """
    n = len(codes)
    if n < size:
        return np.zeros(n, bool)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    gram, width = codes, 1
    while width < size:
        step = min(width, size - width)
        tail = gram if step == width else (codes if step == 1 else None)
        if tail is None:  # shorten the step to what single codes can extend
            step, tail = 1, codes
        m = n - width - step + 1
        gram = pd.factorize(gram[:m] * (int(tail.max()) + 1) + tail[width : width + m])[0].astype(np.int64)
        width += step
    start = np.flatnonzero(doc[: len(gram)] == doc[size - 1 : size - 1 + len(gram)])
    own = pd.factorize(gram[start] * len(offsets) + doc[start])[0]
    start = start[np.bincount(own)[own] > 1] if len(own) else start
    edge = np.zeros(n + 1, np.int64)
    edge[start] += 1
    edge[start + size] -= 1
    return np.cumsum(edge[:n]) > 0


def _measure_slice(text: pa.Array) -> list[np.ndarray]:
    offsets, values = T.words(text)
    codes, _ = T.coded(values)
    line_at, lines = T.lists(pc.split_pattern(text, "\n"))
    real = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_doc = np.repeat(np.arange(len(text)), np.diff(line_at))[real]
    line_code, _ = T.coded(lines.filter(pa.array(real)))
    first = ~pd.Series(line_code * (len(text) + 1) + line_doc).duplicated().to_numpy()
    n_lines = np.bincount(line_doc, minlength=len(text))
    return [
        np.diff(offsets),
        T.per_row(offsets, pc.utf8_length(values).to_numpy(zero_copy_only=False)),
        pc.count_substring_regex(text, r"[#*$%&|<>]").to_numpy(zero_copy_only=False),
        n_lines,
        n_lines - np.bincount(line_doc[first], minlength=len(text)),
        T.per_row(offsets, repeated(offsets, codes, WINDOW)),
        pc.count_substring_regex(text, "[A-Z]").to_numpy(zero_copy_only=False),
    ]


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    parts = [_measure_slice(x) for x in T.array_slices(text)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.asarray(p[i], np.int64) for p in parts] or [[]]), pa.int64()) for i in range(len(MEASURES))], names=list(MEASURES))


def fail_bits() -> Column:
    return sum((F.when(F.expr(rule), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES), F.lit(0).cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``, one row a document."""
    T.bounded_batches(docs.sparkSession)
    return T.id_and_text(docs).select("doc_id", measures("text").alias("m")).select("doc_id", "m.*").withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``kept`` under that policy and ``base_failed``."""
    base = sum(BITS[r] for r in BASE)
    return rows.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(mask(version) | base).cast("long")) == 0,
        }
    )


def ablation(rows: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that only this rule rejects, and kept without it.

    The ledger is first counted by its bits (at most two to the number of rules), so no document is read twice.
    """
    counted = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [(v, name, mask(v), BITS[name]) for v in POLICIES for name in POLICIES[v]]
    case = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, name, m, b in cases]))
    x = counted.select("fail_bits", "n", case.alias("c")).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return x.groupBy("policy", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(hit == F.col("bit")).alias("only_this"),
        total(hit == 0).alias("kept"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


def keep(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    T.bounded_batches(docs.sparkSession)
    judged = docs.select(F.struct("*").alias("row"), measures(F.col("text").cast("string")).alias("m")).select("row", "m.*").withColumn("fail_bits", fail_bits())
    return judged.where(F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("long")) == 0).select("row.*")
