"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  Of two fingerprints that
differ in at most two bits, one segment differs in at most one, so they share either
that segment or a variant of it with one bit left out.  Each distinct fingerprint is
indexed under its two segments and their 64 one-wildcard variants, rows are joined by
equal keys, and each candidate is verified by counting differing bits.

Copies share a fingerprint and count once.  In the order of a key's fingerprints each is
compared with the GROUP before it, so a key of up to GROUP + 1 fingerprints is compared in full.
For a fingerprint in a larger key there is an exact way without pairs: it is tied to its
65 neighbours within one bit, and two fingerprints within two bits share a neighbour.

Defined cases: texts without words (null or empty) have fingerprint zero and are linked like any
others; a row without id takes the component of its fingerprint (null if no row there has an id);
repeated rows each give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators.graph import components
from . import text as T

SHINGLE = 3
SEED = 42
#: Earlier fingerprints of a key that each is compared with; larger keys go by shared neighbours.
GROUP = 16
#: Stands for no id, after all ids.
NO_ID = (1 << 63) - 1
_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)])


def simhash(shingle_hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(shingle_hashes):
        return 0
    lanes = shingle_hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(shingle_hashes)).tolist())


@F.arrow_udf(LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    out = []
    digest = xxhash.xxh64_intdigest
    for part in T.array_slices(text):
        offsets, values = T.words(pc.ascii_lower(part))
        size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        # words of a slice in one buffer, one space apart: a shingle is a stretch of it
        flat = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values), " ")[0].as_buffer() if len(values) else b""
        start = np.concatenate([[0], np.cumsum(size + 1)])
        view = memoryview(flat)
        begins, ends = start[:-1].tolist(), (start[1:] - 1).tolist()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a < SHINGLE:
                hashes = [digest(view[begins[a] : ends[b - 1]], SEED)] if b > a else []
            else:
                hashes = [digest(view[i:j], SEED) for i, j in zip(begins[a : b - SHINGLE + 1], ends[a + SHINGLE - 1 : b], strict=True)]
            out.append(simhash(np.array(hashes, np.uint64)))
    return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())


def _variants(fp):
    """Keys: segment (0, 1) * 33 + left-out bit (32: none), above the 32 bits of the segment."""
    keys = []
    for seg in (0, 1):
        part = F.shiftrightunsigned(fp, 32 * seg).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(33):
            left = part.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit))) if bit < 32 else part
            keys.append(left + F.lit((seg * 33 + bit) << 32))
    return F.array(*keys)


def links(points: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between ``node`` of distinct fingerprints ``fp``, with the components of the graph of all links within two bits."""
    keyed = points.select("node", "fp", F.explode(_variants(F.col("fp"))).alias("key"))
    by_key = Window.partitionBy("key")
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(by_key)).where("n > 1")
    before = F.collect_list(F.struct("node", "fp")).over(by_key.orderBy("fp").rowsBetween(-group, -1))
    small = shared.where(F.col("n") <= group + 1).withColumn("before", before)
    # verified before it becomes a row; a pair whose segments are equal is found by the segment itself, so a variant counts only where its bit differs
    near = F.expr(
        """filter(before, o -> bit_count(fp ^ o.fp) <= 2 and (shiftright(key, 32) % 33 = 32
        or shiftrightunsigned(fp ^ o.fp, cast(32 * floor(shiftright(key, 32) / 33) + shiftright(key, 32) % 33 as int)) & 1 = 1))"""
    )
    pairs = small.select("node", F.explode(near).alias("o")).select(F.col("node").alias("a"), F.col("o.node").alias("b"))
    crowded = shared.where(F.col("n") > group + 1).select("node", "fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    tied = crowded.select("node", F.explode(around).alias("at"))
    hub = tied.groupBy("at").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "hub")
    return pairs.union(tied.join(hub, "at").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _labelled(docs: DataFrame, *more) -> DataFrame:
    """doc_id, id, fp, label by row.  A node is (least id, fp), so that fingerprints are told apart even where ids repeat; its
    order is that of ids."""
    T.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _id(), fingerprint(F.col("text").cast("string")).alias("fp"), *more)
    prints = T.cut(rows)
    points = T.cut(prints.groupBy("fp").agg(F.struct(F.min("id").alias("id"), F.col("fp")).alias("node")))
    found = components(links(points))
    least = points.join(found, "node", "left").select("fp", F.coalesce("label", "node").alias("label"))
    return prints.join(least, "fp")


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id, one row a document."""
    return _labelled(docs).select("doc_id", "fp", F.nullif(F.col("label.id"), F.lit(NO_ID)).alias("component_id"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: one of smallest id, rows of that id by hash of their text, then of the whole row, repeated rows once."""
    tie = F.xxhash64(F.col("text").cast("string")).alias("tie")
    labelled = _labelled(docs, tie).where(F.struct("id", "fp") == F.col("label"))
    kept = labelled.groupBy("label").agg(F.min("tie").alias("tie")).select(F.col("label.id").alias("id"), "tie")
    packed = docs.select(F.struct("*").alias("row"), _id(), tie, T.row_hash().alias("whole"))
    first = F.row_number().over(Window.partitionBy("id", "tie").orderBy("whole")) == 1
    return packed.join(kept, ["id", "tie"], "left_semi").withColumn("first", first).where("first").select("row.*")
