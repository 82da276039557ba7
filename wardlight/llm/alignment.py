"""Alignment of two tokenizers over the same bytes, and how often their ids meet across the corpus.

Inside a task all is Arrow columns over a slice of documents (SLICE bytes of text):

* both encodings as flat lists with parent indices; a token's end is the cumulative sum of token bytes, segmented by document;
* a hash join on (document, end) finds where both tokenizers end, and these places cut the tokens into groups;
* the links of all groups, a chunk at a time, are grouped by document and id pair, and by pair: partial counts of documents.

Spark sums up the partial counts by pair, takes the highest count by A id, and sends the counts back to the slices that have
the pair.  Pairs are dealt to buckets by a hash of the A id.  A slice has each of its pairs once, so a frequent pair
is one entry a slice and no bucket grows with its count; an A id has at most as many pairs as B has ids.  What a slice found is written
to the shared folder and read by the later steps, so documents are encoded once.

A's words are encoded once a slice (``bpe.ids_by_text``), and so are B's: no piece of B has a space behind another character, so its merges
never cross the place where a run of spaces begins.

Defined cases: null and empty texts, and those whose bytes either tokenizer doesn't give back (U+2581 becomes a space in B), have no
tokens: zeros and an empty string; the strings of special tokens are plain text; a very long text is a slice of its own and its links
are made in chunks; ties of counts are all best; repeated rows count as documents of their own and each give a row; a row
without id is one, too; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import text as T
from .bpe import _pack, _unpack

#: Bytes of text aligned at once.
SLICE = 3 << 20
#: Links that are made at once.
LINKS = 1 << 20
ROW = "slice long, bucket int, docs binary, data binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_NAMES = ["slice", "bucket", "docs", "data"]


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def _literal(path: str):
    """The tokenizer of A, to which special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def _pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def _b_bytes(path: str) -> list[bytes]:
    sp = _pieces_model(path)
    named = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]


@lru_cache(maxsize=4)
def _by_words(path: str) -> bool:
    """Whether B's encoding of a text is that of its words: no piece has a space behind another character, and texts are not changed before."""
    sp = _pieces_model(path)
    inner = any(b" " in p.lstrip(b" ") for p in _b_bytes(path))
    probe = " a  b éﬁ"
    return not inner and b"".join(_b_bytes(path)[i] for i in sp.encode(probe)) == (" " + probe).encode()


@lru_cache(maxsize=4)
def _table(path: str, which: str) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each id, and how many they are."""
    p = bpe.pieces(path) if which == "a" else _b_bytes(path)
    return pa.array(p, pa.binary()), np.array([len(x) for x in p], np.int64)


def a_ids(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of space + text by A."""
    spaced = pc.binary_join_element_wise(" ", text, "")
    odd = np.zeros(len(text), bool)
    for s in bpe.tokenizer(path).get_added_tokens_decoder().values():
        odd |= pc.match_substring(spaced, s.content).to_numpy(zero_copy_only=False)
    if not odd.any():
        return bpe.ids_by_text(spaced, path)
    plain = pa.array(~odd)
    offsets, ids = bpe.ids_by_text(spaced.filter(plain), path)
    own = [e.ids for e in _literal(path).encode_batch(spaced.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
    both = pa.concat_arrays([pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32())), pa.array(own, pa.large_list(pa.int32()))])
    at = np.where(odd, len(offsets) - 2 + np.cumsum(odd), np.cumsum(~odd) - 1)
    offsets, flat = T.lists(both.take(pa.array(at)))
    return offsets, flat.to_numpy(zero_copy_only=False)


_RUNS = re.compile(" *[^ ]+| +")


def _space_words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets by text and the words of space + text, each without its first space; a word begins where spaces begin."""
    odd = pc.or_(pc.match_substring(text, "  "), pc.or_(pc.starts_with(text, " "), pc.ends_with(text, " ")))
    plain = pc.if_else(odd, "x", text)
    offsets, keys = T.lists(pc.split_pattern(plain, " "))
    if not pc.any(odd).as_py():
        return offsets, keys
    where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    counts, chunks, at = np.diff(offsets), [], 0
    for i in where.tolist():
        found = [w[1:] for w in _RUNS.findall(" " + text[i].as_py())]
        chunks += [keys.slice(at, offsets[i] - at), pa.array(found, pa.string())]
        at, counts[i] = offsets[i] + 1, len(found)  # its stand-in was one word
    chunks.append(keys.slice(at))
    return np.concatenate([[0], np.cumsum(counts)]), pa.concat_arrays(chunks)


def b_ids(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of texts by B, which puts a space before each."""
    sp = _pieces_model(path)
    if not _by_words(path):
        offsets, flat = T.lists(pa.array(sp.encode(text.to_pylist(), num_threads=1), pa.list_(pa.int32())))
        return offsets, flat.to_numpy(zero_copy_only=False)
    offsets, keys = _space_words(text)
    codes, distinct = T.coded(keys)
    found = sp.encode(distinct.to_pylist(), num_threads=1)
    lone = [sp.piece_to_id("▁")]
    ids = pa.array([f or lone for f in found], pa.list_(pa.int32()))  # a word of one space is nothing to the model
    by_word, flat = T.lists(ids.take(pa.array(codes)))
    return by_word[offsets], flat.to_numpy(zero_copy_only=False)


def _of(rows: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the chosen rows."""
    counts = np.diff(offsets)
    return np.concatenate([[0], np.cumsum(counts[rows])]), values[np.repeat(rows, counts)]


def groups(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens (offsets by document, ids) over the same bytes: document of each group, and how many tokens of A and of B it has."""

    def ends(offsets: np.ndarray, ids: np.ndarray, size: np.ndarray, name: str) -> pa.Table:
        doc = pc.list_parent_indices(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids)))
        reach = np.concatenate([[0], np.cumsum(size[ids])])
        end = reach[1:] - reach[offsets[:-1]][doc.to_numpy()]
        return pa.table({"doc": doc, "end": pa.array(end), name: pa.array(np.arange(len(ids)))})

    both = ends(*a, a_size, "a").join(ends(*b, b_size, "b"), ["doc", "end"], join_type="inner", use_threads=False)
    last_a, last_b = (np.sort(both.column(c).to_numpy()) for c in ("a", "b"))
    doc = np.searchsorted(a[0], last_a, side="right") - 1
    return doc, np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)


def _shown(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray, docs: int, names: pa.Array) -> list[str]:
    """Hashes of the documents' groups as text: ids by commas, a bar between A and B, a semicolon between groups."""
    many = len(names) // 4
    kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    kind_a[np.cumsum(n_a) - 1] = 1
    kind_b[np.cumsum(n_b) - 1] = np.where(last, 3, 2)
    begin = np.cumsum(n_a + n_b) - n_a - n_b
    order = np.empty(len(a) + len(b), np.int64)
    order[np.repeat(begin - (np.cumsum(n_a) - n_a), n_a) + np.arange(len(a))] = a + many * kind_a
    order[np.repeat(begin + n_a - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(b))] = b + many * kind_b
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, n_a + n_b, docs).astype(np.int64))])
    return [hashlib.sha256(x.as_buffer()).hexdigest() for x in T.joined(offsets, names.take(pa.array(order)), "")]


@lru_cache(maxsize=4)
def _names(many: int) -> pa.Array:
    return pa.array([f"{i}{s}" for s in (",", "|", ";", "") for i in range(many)], pa.string())


def _counted(key: np.ndarray) -> pa.Table:
    return pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray, a_many: int, b_many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, id pair (a * b_many + b) and occurrences of all links, by document and pair in ascending order."""
    per_token = np.repeat(n_b, n_a)
    first_b = np.repeat(np.cumsum(n_b) - n_b, n_a)
    base = np.repeat(doc, n_a) * (a_many * b_many) + a.astype(np.int64) * b_many
    parts = []
    for start, n in T.runs(per_token, LINKS):
        some = slice(start, start + n)
        many = per_token[some]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        parts.append(_counted(np.repeat(base[some], many) + b[np.repeat(first_b[some], many) + within]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    whole = pa.concat_tables(parts) if len(parts) == 1 else pa.concat_tables(parts).group_by("key", use_threads=False).aggregate([("count_all", "sum")]).rename_columns(["key", "count_all"])
    key, n = (whole.column(c).to_numpy() for c in ("key", "count_all"))
    order = np.argsort(key)
    return *np.divmod(key[order], a_many * b_many), n[order]


def _bucket(pair: np.ndarray, b_many: int, buckets: int) -> np.ndarray:
    return (pair // b_many * 2654435761 >> 8) % buckets


def _slice(doc_id: pa.Array, text: pa.Array, a_path: str, b_path: str, buckets: int) -> list[tuple[int, bytes | None, bytes]]:
    """The documents of a slice with their pairs as numbers, under bucket -1, and the pairs with partial counts by bucket."""
    (a_piece, a_size), (b_piece, b_size) = _table(a_path, "a"), _table(b_path, "b")
    full = np.flatnonzero(pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    some = text.take(pa.array(full))
    a, b = a_ids(some, a_path), b_ids(some, b_path)
    want = pc.binary_join_element_wise(" ", some, "").cast(pa.large_binary())
    same = [pc.equal(T.joined(o, piece.take(pa.array(ids)), b"").cast(pa.large_binary()), want).to_numpy(zero_copy_only=False) for (o, ids), piece in ((a, a_piece), (b, b_piece))]
    good = same[0] & same[1]
    a, b, full = _of(good, *a), _of(good, *b), full[good]
    doc, n_a, n_b = groups(a, b, a_size, b_size)
    k, many, b_many = len(full), len(a_size), len(b_size)
    at, pair, occurs = links(a[1], b[1], n_a, n_b, doc, many, b_many)
    partial = _counted(pair)
    pairs, n = partial.column("key").to_numpy(), partial.column("count_all").to_numpy()
    bucket = _bucket(pairs, b_many, buckets)
    order = np.lexsort((pairs, bucket))
    place = np.empty(len(pairs), np.int64)
    place[order] = np.arange(len(pairs))
    by_pair = np.argsort(pairs)
    number = place[by_pair][np.searchsorted(pairs[by_pair], pair)]

    def column(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(text), np.int64)
        out[full] = values
        return pa.array(out)

    hashes = np.full(len(text), "", object)
    hashes[full] = _shown(a[1], b[1], n_a, n_b, doc, k, _names(max(many, b_many)))
    docs = _pack(
        doc_id=doc_id, n_a=column(np.diff(a[0])), n_b=column(np.diff(b[0])), n_groups=column(np.bincount(doc, minlength=k)), n_links=column(T.per_row(np.searchsorted(at, np.arange(k + 1)), occurs)),
        pairs=column(np.bincount(at, minlength=k)), groups_sha256=pa.array(hashes, pa.string()),
    )
    rows = [(-1, docs, _pack(number=pa.array(number, pa.int32()), n=pa.array(occurs, pa.int32())))]
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[i] : bounds[i + 1]]
        rows.append((i, None, _pack(pair=pa.array(pairs[own]), n=pa.array(n[own]))))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _align(a_path: str, b_path: str, buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId() << 32 if task else 0
        for part in T.together(batches, limit=limit):
            rows = _slice(part.column("doc_id"), pc.fill_null(part.column("text"), ""), a_path, b_path, buckets)
            for i in range(0, len(rows), 64):
                yield _batch([(number, *r) for r in rows[i : i + 64]])
            number += 1

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of bucket, pair and n from the packed ones."""
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("data"), strict=True):
            x = _unpack(blob)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.num_rows, bucket), pa.int32()), x.column("pair"), x.column("n")], names=["bucket", "pair", "n"])


def _runs_of(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches within which ``by`` is one value."""
    for b in batches:
        x = b.column(by).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else []
        for start, stop in zip(edges, edges[1:], strict=False):
            yield int(x[start]), b.slice(start, stop - start)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket: its pairs in order with counts."""
    now, held = None, []

    def row() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return _batch([(-1, now, None, _pack(**{c: t.column(c).chunk(0) for c in ("pair", "n", "best")}))])

    for bucket, part in _runs_of(batches, "bucket"):
        if bucket != now and held:
            yield row()
            held = []
        now = bucket
        held.append(part)
    if held:
        yield row()


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's counts come first, then its pairs of each slice, which get their counts."""
    known = None
    for b in batches:
        out = []
        for number, bucket, blob in zip(b.column("slice").to_pylist(), b.column("bucket").to_pylist(), b.column("data"), strict=True):
            x = _unpack(blob)
            if number < 0:
                known = [x.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")]
                continue
            at = np.searchsorted(known[0], x.column("pair").to_numpy())
            out.append((number, bucket, None, _pack(n=pa.array(known[1][at]), best=pa.array(known[2][at]))))
        if out:
            yield _batch(out)


def _score(docs: pa.RecordBatch, pairs: pa.RecordBatch, counts: list[pa.RecordBatch]) -> pa.RecordBatch:
    number, occurs = (pairs.column(c).to_numpy() for c in ("number", "n"))
    n, best = (np.concatenate([np.zeros(0, np.int64), *(c.column(x).to_numpy(zero_copy_only=False) for c in counts)])[number] for x in ("n", "best"))
    offsets = np.concatenate([[0], np.cumsum(docs.column("pairs").to_numpy())])
    n_best, count_sum = T.per_row(offsets, occurs * best.astype(np.int64)), T.per_row(offsets, occurs * n.astype(np.int64))
    first = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.RecordBatch.from_arrays([*first, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names=[f.split()[0] for f in OUT.split(", ")])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's documents come first, then the counts of its pairs by bucket."""
    now, head, counts = None, None, []
    for b in batches:
        for number, docs, data in zip(b.column("slice").to_pylist(), b.column("docs"), b.column("data"), strict=True):
            if number != now:
                if head:
                    yield _score(*head, counts)
                now, head, counts = number, (_unpack(docs), _unpack(data)), []
            else:
                counts.append(_unpack(data))
    if head:
        yield _score(*head, counts)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, limit: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """What slices found (rows of ROW), and the corpus-wide counts: bucket, pair (A id * size of B + B id), n documents, best."""
    spark = docs.sparkSession
    a_path, b_path = a_path or bpe.default_path(), b_path or default_b()
    T.bounded_batches(spark)
    parts = T.partitions(spark)
    folder = T.scratch(spark, "alignment")
    T.id_and_text(docs).mapInArrow(_align(a_path, b_path, parts, limit), ROW).write.parquet(folder)
    found = spark.read.schema(ROW).parquet(folder)
    partial = found.where("bucket >= 0").mapInArrow(_partial, "bucket int, pair long, n long")
    # summed up where they are and then by pair; an A id's pairs lie in one bucket, no more than B has ids
    summed = partial.groupBy("bucket", "pair").agg(F.sum("n").alias("n")).repartition(parts, "bucket")
    by_a = Window.partitionBy("bucket", F.floor(F.col("pair") / len(_b_bytes(b_path))))
    return found, summed.withColumn("best", F.col("n") == F.max("n").over(by_a))


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b, n documents that hold the two ids linked, and whether no other B id is linked with a in more."""
    many = len(_b_bytes(b_path or default_b()))
    counts = align(docs, a_path, b_path)[1]
    return counts.select(F.floor(F.col("pair") / many).cast("int").alias("a"), (F.col("pair") % many).cast("int").alias("b"), "n", "best")


def agreement(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, limit: int = SLICE) -> DataFrame:
    """One row a document: tokens of either kind, groups, links, links with a best partner, sum of the links' counts, hash of the groups."""
    found, counts = align(docs, a_path, b_path, limit)
    parts = T.partitions(docs.sparkSession)
    tables = counts.sortWithinPartitions("bucket", "pair").mapInArrow(_packed, ROW)
    told = tables.union(found.where("bucket >= 0")).repartition(parts, "bucket").sortWithinPartitions("bucket", "slice").mapInArrow(_look_up, ROW)
    # slices are few and large: dealt in turn, by partition and then by place
    turn = F.pmod(F.shiftright("slice", 32) + 31 * F.col("slice").bitwiseAND(0xFFFFFFFF), F.lit(parts)).cast("int")
    return found.where("bucket < 0").union(told).repartitionById(parts, turn).sortWithinPartitions("slice", "bucket").mapInArrow(_finish, OUT)
