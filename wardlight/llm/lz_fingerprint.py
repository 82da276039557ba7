"""Lempel-Ziv phrase fingerprints: compression-like likeness of documents.

A document's bytes are parsed left to right into the phrases of an LZ78 dictionary (the shortest stretch that is
no phrase yet becomes one), phrases are hashed, and the SIZE least hashes are the fingerprint.  The likeness of
two fingerprints estimates the share of common phrases: of the SIZE least hashes of both together, those in each.

The next document is the one after it in descending order of id.  Documents are dealt to ranges of ids, sorted there,
and the first of each range goes to the range before as well, so every row meets its next in one pass.

Defined cases: null texts are empty; two empty fingerprints have likeness 1, an empty and another 0; rows without
id come last; rows of one id are ordered by text; a very long text is parsed whole; equal hashes count once; a single row is its own next; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

SIZE = 64


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def parse(data: bytes, known: dict[int, int], start: int, stop: int) -> int:
    """Adds the phrases that end by ``stop`` to ``known``; where the first that doesn't begins.

    A phrase is the key of its last byte below the phrase without it, and is named by where it ends, times 256.
    """
    node, put = 0, known.setdefault
    for end, byte in zip(range(256 * (start + 1), 256 * (stop + 1), 256), memoryview(data)[start:stop]):  # noqa: B905
        met = put(node + byte, end)
        node = 0 if met == end else met
    return max(known.values(), default=0) >> 8 if node else stop


def signature(data: bytes, known: dict[int, int]) -> np.ndarray:
    """The least hashes of the phrases of ``data``, which follow each other; a hash is a polynomial of a phrase's bytes."""
    ends = np.fromiter(known.values(), np.int64, len(known)) >> 8  # in order, as they were met
    if not len(ends):
        return np.zeros(0, np.uint32)
    starts = np.append(0, ends[:-1])
    up, down = _powers(max(1 << 16, 1 << len(data).bit_length()))
    total = np.append(np.uint64(0), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
    h = (total[ends] - total[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = np.sort((h >> np.uint64(32)).astype(np.uint32))
    return h[np.append(True, h[1:] != h[:-1])][:SIZE]


def fingerprint(text: str) -> np.ndarray:
    known: dict[int, int] = {}
    data = text.encode()
    parse(data, known, 0, len(data))
    return signature(data, known)


def spell(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = set(a.tolist()), set(b.tolist())
    least, common = sorted(a | b)[:SIZE], a & b
    return sum(x in common for x in least) / len(least)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by as many (or all) first ones of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(doc_id, text: str, after: str):
    """The row of one document; the part that it shares with its edited text is parsed once."""
    changed = edited(text, after)
    data, other = text.encode(), changed.encode()
    shared = len(text[: len(text) - len(text) // 2].encode())
    own: dict[int, int] = {}
    at = parse(data, own, 0, shared)
    theirs = own.copy()
    parse(data, own, at, len(data))
    parse(other, theirs, at, len(other))
    return doc_id, len(text), hashlib.sha256(other).hexdigest(), signature(data, own), signature(other, theirs)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]):
    """Rows of a range in order; the last of a range is a copy of the next range's first and gives no row."""
    held = None  # part, id, text of the row that waits for its next
    waiting: list | None = None  # the row before it, whose next's fingerprint is now known
    out: list = []

    def close(row, sig):
        doc_id, n, sha, own, theirs = row
        out.append((doc_id, n, sha, spell(own), spell(theirs), likeness(own, theirs), likeness(own, sig)))

    for b in batches:
        for part, tail, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
            text = text or ""
            if held is not None:
                row = _compare(held[1], held[2], text)
                if waiting is not None:
                    close(waiting, row[3])
                waiting = row
                if tail:
                    close(waiting, fingerprint(text))
                    held = waiting = None
            if not tail:
                held = (part, doc_id, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=list(COLUMNS))
            out.clear()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a document: see COLUMNS."""
    spark = docs.sparkSession
    T.bounded_batches(spark)
    rows = T.id_and_text(docs)
    parts = T.partitions(spark)
    share = [i / parts for i in range(1, parts)]
    bounds = rows.select(F.percentile_approx("doc_id", share, 10000)).first()[0] if share else None
    edges = np.array(sorted(set(bounds or [])), np.int64)

    def to_part(ids: np.ndarray) -> np.ndarray:
        """0 for the largest ids; rows without id are in the last."""
        return len(edges) - np.searchsorted(edges, ids, side="left")

    low = -(1 << 63)

    @F.arrow_udf("int")
    def part_of(doc_id: pa.Array) -> pa.Array:
        return pa.array(to_part(pc.fill_null(doc_id, low).to_numpy(zero_copy_only=False)), pa.int32())

    # the largest id of each range that has rows: as many as ranges
    heads = {r["part"]: r["head"] for r in rows.groupBy(part_of("doc_id").alias("part")).agg(F.max(F.coalesce("doc_id", F.lit(low))).alias("head")).collect()}
    used = sorted(heads)
    target = {heads[p]: used[i - 1] for i, p in enumerate(used)}  # the first range's head goes to the last

    @F.arrow_udf("array<int>")
    def goes_to(doc_id: pa.Array) -> pa.Array:
        """The row's own range and, for a head, the range before as -1 - range."""
        ids = pc.fill_null(doc_id, low).to_numpy(zero_copy_only=False)
        own = to_part(ids).tolist()
        return pa.array([[p, -1 - target[i]] if i in target else [p] for p, i in zip(own, ids.tolist(), strict=True)], pa.list_(pa.int32()))

    dealt = rows.select("doc_id", "text", F.explode(goes_to("doc_id")).alias("to"))
    dealt = dealt.select("doc_id", "text", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).alias("tail"))
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_pairs, SCHEMA)
