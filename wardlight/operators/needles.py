"""Thousands of needles in texts by tries over slices of texts, and values in large lists by a join: no condition with thousands of branches.

Texts are dealt to slices of a few megabytes.  A slice tells which pieces of its texts may be needles, or their first KEY characters, by a map of bits of all
beginnings of needles (8 MB at most); a join by equality gives each slice the needles that start with one of its pieces.  From these the slice makes a trie and
all its places walk down at once.  Pieces and nodes are told apart by their characters, not by hashes, so results are exact; a text's work grows with its
own length and not with the number of needles.  Starts have one place a text; ends are starts of reversed texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Needles are dealt to slices by so many of their first characters.
KEY = 64
#: Texts of a slice, in bytes, and least.
SLICE_BYTES, LEAST_BYTES = 4 << 20, 64 << 10
#: At most 2 to this power bits tell beginnings of needles.
BITS = 26
#: A side of at most this many bytes of text is broadcast.
BROADCAST_BYTES = 8 << 20
#: Behind each text; no character.
_END = 0x110000
_WHOLE = np.uint64(0x9E3779B97F4A7C15)


def within_bound(small: DataFrame, column: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` with a hint to broadcast it, if its texts (and 16 bytes a row) are at most so many bytes."""
    size = small.agg(F.coalesce(F.sum(F.octet_length(column) + 16), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= most else small


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each followed by an end, and where each text starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    codes = np.full(int(sizes.sum()), _END, np.int64)
    inside = np.ones(len(codes), bool)
    inside[starts + sizes - 1] = False
    codes[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return codes, starts


def _bit(h: np.ndarray, power: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - power)).astype(np.int64)


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h ^ code.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)


def _marker(power: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers of the bits of each needle's beginnings, and of the whole key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = _codes(batch.column(0).to_pylist())
            h = np.zeros(len(at), np.uint64)
            for size in range(KEY + 1):
                more = codes[at + size] != _END if size < KEY else np.zeros(len(at), bool)
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_bit(h, power), _bit(h[~more] ^ _WHOLE, power)])))], ["bit"])
                at, h = at[more], h[more]
                if not len(at):
                    break
                h = _longer(h, codes[at + size])

    return run


def _bits(parts: DataFrame, power: int) -> np.ndarray:
    marked = parts.mapInArrow(_marker(power), "bit long").groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((max(1 << power >> 15, 1), 4096), np.uint8)
    for r in marked.toLocalIterator():  # at most 2,048 blocks of 4 KB
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _pieces(bits, power: int, edge: bool) -> Callable[[pa.Table], pa.Table]:
    """Of a slice's texts all pieces that may be keys of needles, each once."""

    def run(table: pa.Table) -> pa.Table:
        known = bits.value
        has = lambda h: (known[(b := _bit(h, power)) >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
        codes, at = _codes(table.column("text").to_pylist())
        at = at if edge else np.arange(len(codes))
        h, name, out = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), []
        for size in range(1, KEY + 1):
            code = codes[at + size - 1]
            h = _longer(h, code)
            alive = np.flatnonzero((code != _END) & has(h))
            at, h = at[alive], h[alive]
            if not len(at):
                break
            # equal pieces have one name: that of the piece without its last character, and that character
            name, known_names = pd.factorize(name[alive] << 21 | code[alive])
            first = np.zeros(len(known_names), np.int64)
            first[name[::-1]] = np.arange(len(at))[::-1]
            whole = at[first[has(h[first] ^ _WHOLE)]]
            text = codes[whole[:, None] + np.arange(size)].astype("<u4").tobytes().decode("utf-32-le")
            out.append(pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string()))
        part = pa.chunked_array(out, pa.string())
        return pa.table({"slice": pa.repeat(table.column("slice")[0], len(part)), "part": part})

    return run


def _trie(needles: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level the nodes, as sorted numbers of the node above and the character, and each node's needle or -1."""
    codes, at = _codes(needles)
    number, above, levels = np.arange(len(at)), np.zeros(len(at), np.int64), []
    while len(at):
        edges, node = np.unique(above << 21 | codes[at], return_inverse=True)
        ends = np.full(len(edges), -1)
        more = codes[at + 1] != _END
        ends[node[~more]] = number[~more]
        levels.append((edges, ends))
        at, number, above = at[more] + 1, number[more], node[more]
    return levels


def _walk(edge: bool, pairs: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Which of a slice's needles are in each of its texts, or how many."""

    def run(texts: pa.Table, needles: pa.Table) -> pa.Table:
        codes, starts = _codes(texts.column("text").to_pylist())
        at = starts if edge else np.arange(len(codes))
        row = np.arange(len(starts)) if edge else np.repeat(np.arange(len(starts)), np.diff(starts, append=len(codes)))
        node, found_rows, found_needles = np.zeros(len(at), np.int64), [], []
        for edges, ends in _trie(needles.column("needle").to_pylist()):
            node = pd.Index(edges).get_indexer(node << 21 | codes[at])
            alive = np.flatnonzero(node >= 0)
            at, row, node = at[alive] + 1, row[alive], node[alive]
            hit = ends[node] >= 0
            both = pd.unique(row[hit] * len(needles) + ends[node[hit]])  # a text has a needle once
            found_rows.append(both // len(needles))
            found_needles.append(both % len(needles))
        rows = np.concatenate([np.zeros(0, np.int64), *found_rows])
        if pairs:
            return pa.table({"key": texts.column("key").take(pa.array(rows)), "needle": needles.column("needle").take(pa.array(np.concatenate([np.zeros(0, np.int64), *found_needles])))})
        n = np.bincount(rows, minlength=len(starts))
        return pa.table({"key": texts.column("key").take(pa.array(np.flatnonzero(n))), "n": pa.array(n[n > 0])})

    return run


def _searched(rows: DataFrame, key: str, field: str, needles: DataFrame, where: str, most: int, pairs: bool) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    turned = F.reverse if where == "endswith" else lambda c: c
    edge = where != "contains"
    texts = rows.select(F.col(key).alias("key"), F.lower(F.col(field).cast("string")).alias("text")).where("text is not null")
    wanted = cut(needles.select(F.lower(F.col("needle").cast("string")).alias("needle")).where("needle is not null").distinct())
    empty, beginnings = wanted.agg(F.count_if(F.col("needle") == ""), F.coalesce(F.sum(F.least(F.length("needle"), F.lit(KEY))), F.lit(0))).first()
    wanted = wanted.where("needle <> ''").select(turned(F.col("needle")).alias("needle")).withColumn("part", F.substring("needle", 1, KEY))
    power = min(max(int(beginnings).bit_length() + 4, 15), BITS)
    bits = sc.broadcast(_bits(wanted.select("part"), power))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    slices = 1 + size // max(min(SLICE_BYTES, size // (4 * sc.defaultParallelism)), LEAST_BYTES)
    sliced = texts.select("key", turned(F.col("text")).alias("text"), F.pmod(F.xxhash64("key", "text"), F.lit(slices)).alias("slice")).repartition(slices, "slice")
    parts = sliced.groupBy("slice").applyInArrow(_pieces(bits, power, edge), "slice long, part string")
    near = parts.join(within_bound(wanted, "needle", most), "part").select("slice", "needle")
    result = texts.select("key").schema.add("needle", "string") if pairs else texts.select("key").schema.add("n", "long")
    out = sliced.groupBy("slice").cogroup(near.groupBy("slice")).applyInArrow(_walk(edge, pairs), result)
    return out.union(texts.select("key", F.lit("") if pairs else F.lit(1).cast("long"))) if empty else out


def found(rows: DataFrame, key: str, field: str, needles: DataFrame, where: str = "contains", most: int = BROADCAST_BYTES) -> DataFrame:
    """(``key``, needle) of all needles that the row's ``field`` contains, starts or ends with, whatever the case; each pair once where ``key`` is unique.

    ``needles`` has one column, needle.  Null texts and null needles meet nothing; an empty needle is in every text that is not null.
    """
    out = _searched(rows, key, field, needles, where, most, True)
    return out.select(F.col("key").alias(key), (F.reverse("needle") if where == "endswith" else F.col("needle")).alias("needle"))


def counted(rows: DataFrame, key: str, field: str, needles: DataFrame, where: str = "contains", most: int = BROADCAST_BYTES) -> DataFrame:
    """(``key``, n): of how many needles ``found`` has a row with the key, without making these rows; keys with none are left out."""
    return _searched(rows, key, field, needles, where, most, False).groupBy("key").agg(F.sum("n").alias("n")).withColumnRenamed("key", key)


def existence(rows: DataFrame, value: Column, values: DataFrame, mark: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``mark``: whether the row's value, in lower case and null as the empty text, is one of ``values`` (one column, value)."""
    known = values.select(F.lower(F.col("value").cast("string")).alias("_v")).where("_v is not null").distinct().withColumn(mark, F.lit(True))
    joined = rows.withColumn("_v", F.lower(F.coalesce(value.cast("string"), F.lit("")))).join(within_bound(known, "_v", most), "_v", "left").drop("_v")
    return joined.withColumn(mark, F.coalesce(mark, F.lit(False)))
