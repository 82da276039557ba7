"""Token ids in bit-plane files with a chunk index.

Documents in ascending order of id are cut into parts by ranges of ids.  The ids of a part
form one stream, cut into chunks of CHUNK ids.  A chunk's ids are transposed into planes (the first
bits, or bytes, of all ids, then the second, and so on), planes are compressed each with zstandard, and
planes without a set bit are left out.  A file row holds one chunk: its part, number, first id's place in the
part, number of ids, plane kind and planes, and the index of the documents in it (order in the part, id, first place,
length there, number of the piece and of all pieces of the document).  Spark writes and reads the files, in any store.

Defined cases: null texts are empty and give the end id alone; rows without id come first; rows equal in id are
ordered by their ids; a text longer than a chunk goes over as many as it needs; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import text as T

CHUNK = 1 << 16
END = 0
LEVEL = 3
FILE = "part int, chunk int, first long, n_ids int, kind string, planes array<binary>, docs array<struct<ord: int, doc_id: long, at: int, n: int, piece: int, pieces: int>>"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Compressed planes from the lowest on, up to the highest with a set bit."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        table = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        table = np.ascontiguousarray(raw.T)
    used = np.flatnonzero(table.any(axis=1))
    z = zstandard.ZstdCompressor(level=LEVEL)
    return [z.compress(p.tobytes()) for p in table[: used[-1] + 1 if len(used) else 0]]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    wide = 32 if kind == "bit" else 4
    table = np.zeros((wide, -(-n // 8) if kind == "bit" else n), np.uint8)
    for i, p in enumerate(planes):
        table[i] = np.frombuffer(z.decompress(p), np.uint8)
    if kind == "bit":
        table = np.packbits(np.unpackbits(table, axis=1)[:, :n].T, axis=1, bitorder="little")
        return table.reshape(-1).view("<u4")
    return np.ascontiguousarray(table.T).reshape(-1).view("<u4")


def encoded_parts(docs: DataFrame, path: str, parts: int) -> DataFrame:
    """part, doc_id, and ids with the end id (16 or 32 bits each, little-endian), each part one Spark partition in order."""
    share = [i / parts for i in range(1, parts)]
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), share, 10000)).first()[0] if share else None
    edges = np.array(bounds or [], np.int64)
    narrow = len(bpe.pieces(path)) <= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]):
        for part in T.together(batches, limit=bpe.SLICE):
            offsets, ids = bpe.ids_by_text(pc.fill_null(part.column("text"), ""), path)
            ids = np.insert(ids, offsets[1:], END).astype("<u2" if narrow else "<u4")
            at = (offsets + np.arange(len(offsets))) * ids.itemsize
            doc = part.column("doc_id")
            to = np.searchsorted(edges, pc.fill_null(doc, -(1 << 63)).to_numpy(zero_copy_only=False), side="left")
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), doc, raw], names=["part", "doc_id", "ids"])

    rows = T.id_and_text(docs).mapInArrow(run, "part int, doc_id long, ids binary")
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")


def _chunks(wide: int, size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]):
        part, chunk, held, n, docs, order = None, 0, [], 0, [], 0
        out: list[tuple] = []

        def close():
            nonlocal chunk, held, n, docs
            if n:
                ids = np.concatenate(held)
                out.append((part, chunk, chunk * size, n, kind, to_planes(ids, kind), docs))
            chunk, held, n, docs = chunk + 1, [], 0, []

        def batch():
            rows = [dict(zip(names, x, strict=True)) for x in out]
            out.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        doc_type = pa.list_(pa.struct([("ord", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("piece", pa.int32()), ("pieces", pa.int32())]))
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", doc_type)])
        names = schema.names
        for b in batches:
            for p, doc_id, raw in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if p != part:
                    close()
                    part, chunk, order = p, 0, 0
                ids = np.frombuffer(raw.as_buffer(), f"<u{wide}")
                pieces, piece, at = 1 + max(0, -(-(len(ids) - (size - n)) // size)), 0, 0
                while at < len(ids):
                    take = min(size - n, len(ids) - at)
                    held.append(ids[at : at + take].copy())
                    docs.append({"ord": order, "doc_id": doc_id, "at": n, "n": take, "piece": piece, "pieces": pieces})
                    n, at, piece = n + take, at + take, piece + 1
                    if n == size:
                        close()
                order += 1
            if len(out) >= 16:
                yield batch()
        close()
        if out:
            yield batch()

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, kind: str = "byte", size: int = CHUNK, parts: int | None = None) -> None:
    T.bounded_batches(docs.sparkSession)
    path = path or bpe.default_path()
    wide = 2 if len(bpe.pieces(path)) <= 1 << 16 else 4
    rows = encoded_parts(docs, path, parts or T.partitions(docs.sparkSession)).mapInArrow(_chunks(wide, size, kind), FILE)
    rows.write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of documents: part, ord, doc_id, place of the piece's first id in the part, n, piece, pieces, ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                ids = from_planes(r["planes"], r["n_ids"], r["kind"])
                d = r["docs"]
                cols = [pa.array([x[k] for x in d], t) for k, t in (("ord", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()))]
                start = pa.array([r["first"] + x["at"] for x in d], pa.int64())
                raw = pa.array([ids[x["at"] : x["at"] + x["n"]].tobytes() for x in d], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(d), pa.int32()), *cols[:2], start, *cols[2:], raw], names=["part", "ord", "doc_id", "start", "n", "piece", "pieces", "ids"])

    T.bounded_batches(spark)
    files = spark.read.schema(FILE).parquet(folder)
    return files.mapInArrow(run, "part int, ord int, doc_id long, start long, n long, piece int, pieces int, ids binary")


def part_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each part, from the chunk index: one row a part comes to the driver."""
    rows = spark.read.schema(FILE).parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(rows):
        out[r["part"]], total = total, total + r["n"]
    return out


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    Whole documents are hashed where they are read; pieces of those that cross chunks are put together first.
    """
    starts = part_starts(spark, folder)
    base = F.broadcast(spark.createDataFrame(list(starts.items()), "part int, base long"))  # as many rows as parts
    p = read(spark, folder)
    whole = F.when(F.col("pieces") == 1, F.crc32("ids"))
    piece = F.when(F.col("pieces") > 1, F.struct("piece", "ids"))
    got = p.groupBy("part", "ord").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.max(whole).alias("crc"), F.sort_array(F.collect_list(piece)).alias("p")
    )
    together = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return got.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).cast("long").alias("start"), "n_tokens", F.coalesce("crc", F.crc32(together)).alias("ids_crc32"))
