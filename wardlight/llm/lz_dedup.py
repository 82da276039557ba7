"""Substring deduplication by relative Lempel-Ziv factors over anchored blocks.

A window is SPAN consecutive words of a document.  Each window has one anchor: the GRAM-word gram in
it of least hash, the leftmost of equal ones, frequent grams after all others.  Consecutive windows with one anchor make up a
block, so blocks cover every window once and equal windows have equal anchors.  The reference index is dealt out by anchors.
Under an anchor, in the order of documents, each block is factored greedily against every block before it: at the
first window that stands in one, the longest run of windows from there on that stands in one is a factor, with its source
(document and place of the first block that has it), and the parse goes on behind it.  A document's factors from one source
that continue each other are then put together.  A window is at least SPAN words, so every factor is a duplicate span.

Windows are compared by 48 bits of their hashes under 64 bits of their anchors' hashes, both ends of a factor being ends of such windows: two different ones under
one anchor are taken for equal once in 2**48 pairs.

Blocks that stand earlier in the same slice of texts are factors at once, so the frequent passages of a corpus reach the
index once for each slice, not once for each document.  A gram that many texts of the corpus hold in different surroundings (``frequent_grams``)
is no anchor of windows that reach into those surroundings, so no anchor gathers them.  Blocks that still come together are counted over all slices, by slots of anchors
(``crowded_slots``); under an anchor whose slot holds more than CROWD each window is a block of its own, dealt by anchor and window, so equal windows meet and others don't.

Defined cases: null texts have no words; a row without id stands before all others; rows of one id are told
apart, and ordered, by a 64-bit hash of their texts, and those also equal in it count as one document; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

SPAN = 20
GRAM = 8
_PER = SPAN - GRAM + 1  # anchors to choose from in a window, and the most windows of a block
_BASE = 0x9E3779B97F4A7C15
#: Bytes before a block's window hashes: id (8), text hash (8), first window (4), number of windows if it is a factor already.
_HEAD = 21
#: Bytes of the source of a block that is a factor already: id (8), first window (4).
_SOURCE = 12
#: Bytes of a window's hash in the index.
WIDE = 6
#: Frequent grams: those that the corpus holds more often than TOTAL, counted in the slices of texts that hold them more often than LOCAL; the OFTEN most frequent.
LOCAL = 8
TOTAL = 64
OFTEN = 1 << 16
#: Blocks of a slot of anchors (and times the blocks of a usual slot) above which the slot's windows are dealt one by one.
CROWD = 1 << 16
TIMES = 4
#: Slots of anchors, and slots in a row of counts.
SLOTS = 1 << 22
CHUNK = 1 << 12
#: Bytes of text in a slice, and blocks under one anchor that are factored at once.
SLICE = 12 << 20
AT_ONCE = 50000
_NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extend(a: np.ndarray, width: int, b: np.ndarray) -> np.ndarray:
    """Hashes of ``width`` words followed by the ones of ``b`` at their ends; the last ``width`` are not of use."""
    out = a.copy()
    if len(a) > width:
        out[:-width] += np.uint64(pow(_BASE, width, 1 << 64)) * b[width:]
    return out


def text_hash(texts: pa.Array) -> np.ndarray:
    """As Spark's xxhash64 of a string."""
    return np.array([xxhash.xxh64_intdigest(t.as_buffer(), 42) for t in texts.cast(pa.binary())], np.uint64).view(np.int64)


def _sortable(x: np.ndarray) -> np.ndarray:
    """Eight bytes for each number, in its order."""
    return (x.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)


def _number(x: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(x).view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _word_hashes(codes: np.ndarray, distinct: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)


def _hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Of the ``width`` words from each word on: hashes of 1, 2, 4 ... words, put together by the bits of ``width``."""
    out, power = None, 1
    while power <= width:
        if width & power:
            out = h if out is None else _extend(h, power, out)
        h, power = _extend(h, power, h), power * 2
    return out


def frequent_grams(docs: DataFrame, local: int = LOCAL, most: int = OFTEN, total: int = TOTAL) -> np.ndarray:
    """Sorted hashes of grams that are frequent in the corpus; at most ``most`` come to the driver.  Where windows meet depends on them; what is equal does not."""

    def count(batches):
        for part in T.together(batches, limit=SLICE):
            offsets, values = T.words(pc.fill_null(part.column("text"), ""))
            codes, distinct = T.coded(values)
            often = np.bincount(codes, minlength=len(distinct)) > local
            # a frequent gram has frequent words alone
            gram = _hashes(_word_hashes(codes, distinct), GRAM)[_held(~often[codes], GRAM)]
            found, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > local].view(np.int64)), pa.array(n[n > local])], names=["gram", "n"])

    counted = T.id_and_text(docs).select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > total)
    return np.sort(np.array([r["gram"] for r in counted.orderBy(F.desc("n"), "gram").limit(most).collect()], np.int64).view(np.uint64))


def _held(rare: np.ndarray, width: int) -> np.ndarray:
    """Places from which ``width`` words on none is rare."""
    total = np.append(0, np.cumsum(rare))
    return np.flatnonzero(total[width:] == total[:-width]) if len(rare) >= width else np.zeros(0, np.int64)


def blocks(text: pa.Array, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """By block: document in the slice, first window, number of windows, anchor hash; and all blocks' window hashes."""
    offsets, values = T.words(text)
    n = len(values)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    codes, distinct = T.coded(values)
    h = _word_hashes(codes, distinct)
    gram, span = _hashes(h, GRAM), _hashes(h, SPAN)
    key = _mix(gram) >> np.uint64(1)
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)
        key |= (frequent[at] == gram).astype(np.uint64) << np.uint64(63)
    window = np.flatnonzero(np.arange(n) + SPAN <= offsets[doc + 1]) if n else np.zeros(0, np.int64)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least, width = key.copy(), 1
    while width < _PER:
        step = min(width, _PER - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    anchor = np.full(len(window), -1)
    for j in range(_PER - 1, -1, -1):
        anchor = np.where(key[window + j] == least[window], window + j, anchor)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[window[1:]] != doc[window[:-1]])])
    at = np.flatnonzero(new)
    first = window[at]
    return doc[first], first - offsets[doc[first]], np.diff(np.append(at, len(window))), key[anchor[at]], _mix(span[window])


def _records(doc_id, tie, first, known, counts, hashes, source_id, source_first) -> pa.Array:
    """Records that sort as (id, text hash, first window).  After the head: the source of a block that is known, or a block's window hashes."""
    size = _HEAD + np.where(known > 0, _SOURCE, WIDE * counts)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    head = np.empty((len(counts), _HEAD), np.uint8)
    head[:, :8], head[:, 8:16] = _sortable(doc_id), _sortable(tie)
    head[:, 16:20] = first.astype(">u4").view(np.uint8).reshape(-1, 4)
    head[:, 20] = known
    body = np.ones(len(out), bool)
    places = at[:-1, None] + np.arange(_HEAD)
    body[places.reshape(-1)] = False
    out[places] = head
    places = at[:-1][known > 0][:, None] + _HEAD + np.arange(_SOURCE)
    body[places.reshape(-1)] = False
    out[places] = np.concatenate([_sortable(source_id[known > 0]), source_first[known > 0].astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
    out[body] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])


def _nth(counts: np.ndarray) -> np.ndarray:
    """Each window's place in its block."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _first_equal(x: np.ndarray) -> np.ndarray:
    """For each row the first row that is equal to it."""
    group, distinct = pd.factorize(x)
    at = np.zeros(len(distinct), np.int64)
    at[group[::-1]] = np.arange(len(group))[::-1]
    return at[group]


def ids_repeat(docs: DataFrame) -> bool:
    """Whether rows share an id, or have none.  Only then are texts' hashes needed to tell documents apart; they are the same 64 bits for all blocks of a document, and hashes don't compress."""
    n = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return bool(n.where("n > 1 or doc_id is null").limit(1).count())


def _slice_blocks(part: pa.RecordBatch, frequent: np.ndarray, tied: bool) -> tuple[np.ndarray, ...]:
    """By block of a slice, in the order of documents: id, text hash, first window, number of windows, anchor; and all blocks' window hashes."""
    text = pc.fill_null(part.column("text"), "")
    ids = pc.fill_null(part.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
    ties = text_hash(text) if tied else np.zeros(len(ids), np.int64)
    order = np.lexsort((ties, ids))
    text, ids, ties = text.take(pa.array(order)), ids[order], ties[order]
    once = np.append(True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]))
    if not once.all():  # the same document again
        text, ids, ties = text.filter(pa.array(once)), ids[once], ties[once]
    row, first, counts, anchor, hashes = blocks(text, frequent)
    return ids[row], ties[row], first, counts, anchor, hashes


def _sources(counts: np.ndarray, anchor: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each block of a slice the first that is equal to it."""
    # one number a block, of its windows and their order: equal blocks have equal numbers
    whole = np.add.reduceat(_mix(hashes + np.uint64(_BASE) * _nth(counts).astype(np.uint64)), np.cumsum(counts) - counts)
    return _first_equal(_mix(whole ^ (anchor * np.uint64(_BASE)) ^ counts.astype(np.uint64)))


def _slot(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(SLOTS - 1)).astype(np.int64)


def crowded_slots(docs: DataFrame, frequent: np.ndarray, tied: bool, crowd: int = CROWD) -> np.ndarray:
    """A bit for each slot of anchors: whether the slices of the corpus send it more than ``crowd`` blocks, and more than TIMES those of the usual slot.

    Tasks count in arrays of one size, whatever they read; SLOTS / 8 bytes come to the driver.  Anchors that share a slot with a crowded one are dealt like it, which changes
    where their windows meet, not what is equal.
    """

    def count(batches):
        held = np.zeros(SLOTS, np.uint32)
        for part in T.together(batches, limit=SLICE):
            *_, counts, anchor, hashes = _slice_blocks(part, frequent, tied)
            if len(anchor):
                new = _sources(counts, anchor, hashes) == np.arange(len(anchor))
                held += np.bincount(_slot(anchor[new]), minlength=SLOTS).astype(np.uint32)
        z = zstandard.ZstdCompressor(level=1)
        rows = held.reshape(-1, CHUNK)
        full = np.flatnonzero(rows.any(axis=1))
        # the bytes of equal weight together: nearly all counts are small
        packed = [z.compress(np.ascontiguousarray(rows[i].view(np.uint8).reshape(-1, 4).T)) for i in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "held"])

    def judge(batches):
        z, total = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for chunk, held in zip(b.column("chunk").to_pylist(), b.column("held").to_pylist(), strict=True):
                n = np.ascontiguousarray(np.frombuffer(z.decompress(held), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
                total[chunk] = total.get(chunk, 0) + n.astype(np.int64)
        over = {c: np.packbits(n > max(crowd, TIMES * int(np.median(n)))) for c, n in total.items()}
        found = [c for c, bits in over.items() if bits.any()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([over[c].tobytes() for c in found], pa.binary())], names=["chunk", "bits"])

    counted = T.id_and_text(docs).mapInArrow(count, "chunk long, held binary").repartition(T.partitions(docs.sparkSession), "chunk").mapInArrow(judge, "chunk long, bits binary")
    out = np.zeros((SLOTS // CHUNK, CHUNK // 8), np.uint8)
    for r in counted.collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _dealt_singly(crowded: np.ndarray, doc_id, tie, first, counts, anchor, hashes) -> tuple[np.ndarray, ...]:
    """The blocks, each window of those in crowded slots as a block of its own, under an anchor of its own."""
    slot = _slot(anchor)
    hot = crowded[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 > 0
    if not hot.any():
        return doc_id, tie, first, counts, anchor, hashes
    block, nth = np.repeat(np.arange(len(counts)), counts), _nth(counts)
    at = np.flatnonzero((nth == 0) | hot[block])
    of = block[at]
    anchor = np.where(hot[of], _mix(anchor[of] * np.uint64(_BASE) ^ hashes[at]), anchor[of])
    return doc_id[of], tie[of], first[of] + nth[at], np.diff(np.append(at, len(block))), anchor, hashes


def _index(frequent: np.ndarray, tied: bool, crowded: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        for part in T.together(batches, limit=SLICE):
            doc_id, tie, first, counts, anchor, hashes = _dealt_singly(crowded, *_slice_blocks(part, frequent, tied))
            if not len(counts):
                continue
            block = np.repeat(np.arange(len(counts)), counts)
            source = _sources(counts, anchor, hashes)
            seen = source < np.arange(len(counts))
            deal = np.where(seen, _mix(doc_id.view(np.uint64) + first.astype(np.uint64) * np.uint64(_BASE)), anchor)
            records = _records(doc_id, tie, first, np.where(seen, counts, 0), counts, hashes[~seen[block]], doc_id[source], first[source])
            yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), records], names=["anchor", "block"])

    return run


@dataclass
class _Blocks:
    """Blocks in order of (anchor, id, text hash, first window), and their windows' hashes."""

    anchor: np.ndarray
    doc_id: np.ndarray
    tie: np.ndarray
    first: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    def take(self, mine: np.ndarray) -> _Blocks:
        return _Blocks(*(getattr(self, f)[mine] for f in ("anchor", "doc_id", "tie", "first", "counts")), self.hashes[np.repeat(mine, self.counts)])

    def __add__(self, more: _Blocks) -> _Blocks:
        return _Blocks(*(np.concatenate([getattr(self, f), getattr(more, f)]) for f in self.__dataclass_fields__))


def _read(b: pa.RecordBatch) -> tuple[_Blocks, list[np.ndarray]]:
    """Blocks to be factored, and the factors that were known."""
    block = pa.concat_arrays([b.column("block")])
    _, at, data = block.buffers()
    at = np.frombuffer(at, np.int32)[block.offset : block.offset + len(block) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    anchor = b.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
    head = data[at[:-1, None] + np.arange(_HEAD)]
    doc_id, tie = _number(head[:, :8]), _number(head[:, 8:16])
    first = np.ascontiguousarray(head[:, 16:20]).view(">u4").reshape(-1).astype(np.int64)
    known = head[:, 20].astype(np.int64)
    done, new = np.flatnonzero(known), np.flatnonzero(known == 0)
    source = data[at[done][:, None] + _HEAD + np.arange(_SOURCE)]
    factors = [doc_id[done], tie[done], first[done], known[done], _number(source[:, :8]), np.ascontiguousarray(source[:, 8:]).view(">u4").reshape(-1).astype(np.int64)]
    counts = (np.diff(at)[new] - _HEAD) // WIDE
    start = np.repeat(at[new] + _HEAD, counts) + WIDE * _nth(counts)
    hashes = np.zeros(len(start), np.uint64)
    for i in range(WIDE):
        hashes = (hashes << np.uint64(8)) | data[start + i].astype(np.uint64)
    return _Blocks(anchor[new], doc_id[new], tie[new], first[new], counts, hashes), factors


def _runs(block: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window on, how many windows in a row of its block stand in one block before, and where the first such run begins (-1: none)."""
    length, source = np.zeros(len(key), np.int64), np.full(len(key), -1)
    pool, run = np.arange(len(key)), key
    for n in range(1, _PER + 1):
        at = _first_equal(run)
        again = at < np.arange(len(pool))
        length[pool[again]], source[pool[again]] = n, pool[at[again]]
        shared = again.copy()
        shared[at[again]] = True
        pool, run = pool[shared], run[shared]
        on = pool + n < len(key)
        on[on] = block[pool[on] + n] == block[pool[on]]
        pool = pool[on]
        if not len(pool):
            break
        run = _mix(run[on] * np.uint64(_BASE) + key[pool + n])
    return length, source


def _parse(b: _Blocks, indexed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Greedy factors of the blocks from ``indexed`` on; and which blocks have a window that stands in none before them."""
    block = np.repeat(np.arange(len(b.counts)), b.counts)
    nth = _nth(b.counts)
    length, source = _runs(block, _mix(b.anchor[block] ^ (b.hashes * np.uint64(_BASE))))
    ends = np.cumsum(b.counts)
    following = np.minimum.accumulate(np.where(length > 0, np.arange(len(block)), len(block))[::-1])[::-1]
    at, stop, found = (ends - b.counts)[indexed:], ends[indexed:], []
    while len(at):
        at = following[at]
        at, stop = at[at < stop], stop[at < stop]
        found.append(at)
        at = at + length[at]
        at, stop = at[at < stop], stop[at < stop]
    w = np.concatenate(found) if found else np.zeros(0, np.int64)
    mine, theirs = block[w], block[source[w]]
    new = np.bincount(block[length == 0], minlength=len(b.counts)) > 0
    return [b.doc_id[mine], b.tie[mine], b.first[mine] + nth[w], length[w], b.doc_id[theirs], b.first[theirs] + nth[source[w]]], new


def _factor(batches: Iterator[pa.RecordBatch]):
    """Factors of the blocks under each anchor: what is indexed under the last one stays for the next batch, as far as it is new there."""
    index: _Blocks | None = None

    def rows(factors):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in factors], names=["key", "tie", "at", "n", "source", "source_at"])

    def parsed(b: _Blocks):
        nonlocal index
        held = 0
        if index is not None and len(b.anchor) and index.anchor[0] == b.anchor[0]:
            held, b = len(index.anchor), index + b
        other = np.logical_or.reduce([x[1:] != x[:-1] for x in (b.anchor, b.doc_id, b.tie, b.first)])
        if not other.all():  # the same document in several slices
            b = b.take(np.append(True, other))
        factors, new = _parse(b, held)
        index = b.take(new & (b.anchor == b.anchor[-1]))
        return rows(factors)

    waiting: list[_Blocks] = []
    for batch in batches:
        b, known = _read(batch)
        if len(known[0]):
            yield rows(known)
        if len(b.anchor):
            waiting.append(b)
        # as many new blocks as are indexed, so that a hot anchor's index is gone through few times
        if sum(len(x.anchor) for x in waiting) >= max(AT_ONCE, len(index.anchor) if index is not None else 0):
            yield parsed(functools.reduce(_Blocks.__add__, waiting))
            waiting = []
    if waiting:
        yield parsed(functools.reduce(_Blocks.__add__, waiting))


#: Factors as they stand under their anchors: ``key`` (the id, or the least long without one), ``tie`` (the text's hash), first window, windows, and
#: the source's id and first window there.
FACTOR = "key long, tie long, at long, n long, source long, source_at long"


def factors(docs: DataFrame, tied: bool, crowd: int = CROWD) -> DataFrame:
    """Rows of FACTOR; without ``tied`` ids tell all documents apart, and ``tie`` is zero."""
    T.bounded_batches(docs.sparkSession)
    frequent = frequent_grams(docs)
    dealt = T.id_and_text(docs).mapInArrow(_index(frequent, tied, crowded_slots(docs, frequent, tied, crowd)), "anchor long, block binary")
    ordered = dealt.repartition(T.partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "block")
    return ordered.mapInArrow(_factor, FACTOR)


def put_together(at: np.ndarray, n: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """A document's factors in order, those that continue one another from one source as one."""
    order = np.lexsort((at, at - source_at, source))
    at, n, source, source_at = at[order], n[order], source[order], source_at[order]
    if not len(at):
        return at, n, source, source_at
    stop = at + n
    new = np.append(True, (source[1:] != source[:-1]) | ((at - source_at)[1:] != (at - source_at)[:-1]) | (at[1:] > stop[:-1]))
    first = np.flatnonzero(new)
    reach = np.maximum.reduceat(stop, first)
    out = np.argsort(at[first], kind="stable")
    first = first[out]
    return at[first], reach[out] - at[first], source[first], source_at[first]


def covered(offsets: np.ndarray, spans: list[list[dict] | None]) -> np.ndarray:
    """True for words that a factor covers; spans: by document, with ``at`` and ``n`` in windows."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    start = np.array([o + x["at"] for o, found in zip(offsets[:-1].tolist(), spans, strict=True) for x in found or ()], np.int64)
    n = np.array([x["n"] for found in spans for x in found or ()], np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + SPAN - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _packed(batches: Iterator[pa.RecordBatch]):
    """Texts compressed one by one, for the way to their spans."""
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = pc.fill_null(b.column("text"), "").cast(pa.binary())
        texts = pa.array([z.compress(x.as_buffer()) for x in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "tie")), texts], names=["doc_id", "key", "tie", "text"])


def _unpacked(batches: Iterator[pa.RecordBatch]):
    z = zstandard.ZstdDecompressor()
    for b in batches:
        size = np.array([zstandard.frame_content_size(x.as_py()) for x in b.column("text")], np.int64)
        for start, n in T.runs(size, T.SLICE_BYTES):
            part = b.slice(start, n)
            text = pa.array([z.decompress(x.as_py()) for x in part.column("text")], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, part.column("spans")], names=["doc_id", "text", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]):
    for part in _unpacked(batches):
        text = part.column("text")
        offsets, values = T.words(text)
        gone = covered(offsets, part.column("spans").to_pylist())
        stays = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        left = T.joined(stays, values.filter(pa.array(~gone)), " ")
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(T.per_row(offsets, gone)), left.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def spans(docs: DataFrame, tied: bool, crowd: int = CROWD) -> DataFrame:
    """``key``, ``tie`` and ``spans``: a document's factors put together, in order, each of ``at`` and ``n`` (windows; n + SPAN - 1 words), ``source`` and ``source_at``."""

    @F.arrow_udf("array<struct<at: long, n: long, source: long, source_at: long>>")
    def whole(found: pa.Array) -> pa.Array:
        offsets, flat = T.lists(found)
        columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "source", "source_at")]
        rows = [put_together(*(c[a:b] for c in columns)) for a, b in itertools.pairwise(offsets.tolist())]
        sizes = np.append(0, np.cumsum([len(r[0]) for r in rows]))
        got = pa.StructArray.from_arrays([pa.array(np.concatenate(c) if rows else np.zeros(0, np.int64)) for c in (zip(*rows, strict=True) if rows else [()] * 4)], names=["at", "n", "source", "source_at"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), got)

    found = factors(docs, tied, crowd).groupBy("key", "tie").agg(F.collect_list(F.struct("at", "n", "source", "source_at")).alias("found"))
    return found.select("key", "tie", whole("found").alias("spans"))


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words left, joined by one space.  ``crowd`` decides how windows are dealt to tasks, not what is found."""
    tied = ids_repeat(docs)
    tie = F.xxhash64(F.coalesce("text", F.lit(""))) if tied else F.lit(0).cast("long")
    rows = T.id_and_text(docs).withColumns({"key": F.coalesce("doc_id", F.lit(_NO_ID)), "tie": tie}).mapInArrow(_packed, "doc_id long, key long, tie long, text binary")
    both = rows.join(spans(docs, tied, crowd), ["key", "tie"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def kept_sha256(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()
