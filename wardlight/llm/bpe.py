"""BPE encoding and decoding by a distinct-word table.

Texts are cut where a run of white space begins; no token of the byte-level BPE crosses
such a place, so a text's ids are those of its words in order.

* ``_deal`` cuts slices of texts into words.  The distinct words of a slice are dealt to buckets by their hash, as one
  compressed row for each slice and bucket; in a second reading, the slice itself becomes the numbers of its words, in order.
* ``_encode`` meets all rows of a bucket: each distinct word of the corpus is encoded there, once, and goes back
  as ids to every slice that has it.
* ``_assemble`` meets a slice with its buckets' ids and joins the ids back by position.

A frequent word is one entry for each slice that has it, so no bucket grows with its count; a bucket's task keeps the
distinct words of one bucket, and there are BUCKETS buckets a partition.  Decoding joins ids with the vocabulary's pieces
(a table of the vocabulary's size): ``decode_ids`` for rows of ids, and in whole Arrow columns in ``round_trip``.

Slices are told by partition and place; reading twice moves less than sending the slices along with their words.  ``docs`` must give the
same rows in the same partitions when computed again (their order is no matter): if not, a slice that meets ids of other words fails
instead of giving wrong ids, and such documents are to be checkpointed before.

Defined cases: a null text counts as empty, which has no ids; the special token's string in a text is
encoded as that token, as the library does by default; a text longer than SLICE is a slice of its own, encoded whole;
an id's place tells equal ids apart, so ties don't arise; repeated rows each give a row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Bytes of text cut into words at once; distinct words are counted once for each such slice.
SLICE = 24 << 20
BUCKETS = 2
#: Unicode white space, the class of the pre-tokenizer's \\s, without and with the space and the line end.
_RARE_SPACE = r"\x{0009}\x{000b}-\x{000d}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = r"\x{0020}\x{000a}" + _RARE_SPACE
#: Texts with other than single spaces and line ends between words are cut by a regular expression.
_IRREGULAR = rf"^[{_SPACE}]|[{_SPACE}]$|[{_SPACE}][{_SPACE}]|[\x00{_RARE_SPACE}]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _spelling() -> dict[str, int]:
    """Byte-level pieces spell bytes as letters: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    t, spell = tokenizer(path), _spelling()
    special = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
    out = []
    for i in range(t.get_vocab_size(with_added_tokens=True)):
        p = special.get(i, t.id_to_token(i))
        out.append(p.encode() if i in special else bytes(spell[c] for c in p))
    return out


@lru_cache(maxsize=1)
def _word_pattern():
    import re

    space = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    return re.compile(f"[{space}]*[^{space}]+|[{space}]+")


def cut_words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets by text, and keys of words.

    A key is the word behind a space; a word that begins with a line end is its own key, and any other
    word has U+0000 before it.
    """
    odd = pc.match_substring_regex(text, _IRREGULAR)
    plain = pc.if_else(odd, "", text)
    offsets, keys = T.lists(pc.split_pattern(pc.binary_join_element_wise("\x00", pc.replace_substring(plain, "\n", " \n"), ""), " "))
    if not pc.any(odd).as_py():
        return offsets, keys
    counts = np.diff(offsets)
    where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    found = [["\x00" + w for w in _word_pattern().findall(text[i].as_py())] for i in where.tolist()]
    chunks, at = [], 0
    for i, words in zip(where.tolist(), found, strict=True):
        chunks += [keys.slice(at, offsets[i] - at), pa.array(words, pa.string())]
        at = offsets[i] + counts[i]
        counts[i] = len(words)
    chunks.append(keys.slice(at))
    return np.concatenate([[0], np.cumsum(counts)]), pa.concat_arrays([c.cast(pa.string()) for c in chunks])


def spelled(keys: pa.Array) -> pa.Array:
    """The words of keys, as they stand in texts."""
    inner = pc.if_else(pc.starts_with(keys, "\n"), keys, pc.binary_join_element_wise(" ", keys, ""))
    return pc.if_else(pc.starts_with(keys, "\x00"), pc.utf8_slice_codeunits(keys, 1), inner)


#: Words of these characters are merged by ``_merger``; others (rarer scripts, odd spaces) take the library's own way.
_COMMON = r"^ ?\n?[!-~\x{00a1}-\x{00ac}\x{00ae}-\x{017f}]+$"
#: Fixed value: the split of the byte-level pre-tokenizer.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS_AT_ONCE = 20000
#: Words of each call that the library encodes, too.
_COMPARED = 200
#: Files for which the two were found to differ in this process: the library encodes all their words.
_DIFFER: set[str] = set()


@lru_cache(maxsize=4)
def _merger(path: str):
    """tiktoken over the same vocabulary, which merges many words in one call, and the length of each piece; None where the two would
    not agree: the file must be a plain byte-level BPE, and its merges must stand in the order of the ids that they make.  None, too, where there is no tiktoken."""
    try:
        import tiktoken
    except ImportError:  # the library alone does it all
        return None

    t = tokenizer(path)
    file = json.loads(t.to_str())
    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and not file["normalizer"]
    level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]] if plain and level else []
    if not made or made != sorted(set(made)) or len(made) + 256 != len(model["vocab"]) - sum(x.content in model["vocab"] for x in t.get_added_tokens_decoder().values()):
        return None
    special = t.get_added_tokens_decoder()
    ranks = {p: i for i, p in enumerate(pieces(path)) if i not in special}
    return tiktoken.Encoding("words", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}), np.array([len(p) for p in pieces(path)])


def _by_library(words: list[str], path: str) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def encode_words(keys: pa.Array, path: str) -> pa.ListArray:
    """The ids of each key of ``cut_words``.

    Words merged by tiktoken are compared with the library at even distances, _COMPARED in each call; if one differs, the library encodes all words of this call and of later ones.
    """
    words = spelled(keys)
    merger = None if path in _DIFFER else _merger(path)
    common = pc.and_(pc.match_substring_regex(words, _COMMON), pc.invert(pc.starts_with(keys, "\x00"))) if merger else pa.array(np.zeros(len(keys), bool))
    for s in tokenizer(path).get_added_tokens_decoder().values():
        common = pc.and_(common, pc.invert(pc.match_substring(words, s.content)))
    own, rest = words.filter(common), words.filter(pc.invert(common))
    found = [pa.array([], pa.list_(pa.int32()))]
    for i in range(0, len(own), _WORDS_AT_ONCE):
        some = own.slice(i, _WORDS_AT_ONCE)
        ids = merger[0].encode_to_numpy("".join(some.to_pylist()), disallowed_special=()).astype(np.int32)
        # tokens never cross words: a word's tokens end where its bytes do
        ends = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.searchsorted(np.cumsum(merger[1][ids]), ends) + 1
        found.append(pa.ListArray.from_arrays(pa.array(np.append(0, at), pa.int32()), pa.array(ids)))
    merged = pa.concat_arrays(found)
    if len(own):
        some = pa.array(np.unique(np.linspace(0, len(own) - 1, _COMPARED).astype(np.int64)))
        if merged.take(some).to_pylist() != _by_library(own.take(some).to_pylist(), path):
            _DIFFER.add(path)
            return encode_words(keys, path)
    found = [merged, pa.array(_by_library(rest.to_pylist(), path), pa.list_(pa.int32()))]
    mine = common.to_numpy(zero_copy_only=False)
    return pa.concat_arrays(found).take(pa.array(np.where(mine, np.cumsum(mine) - 1, len(own) + np.cumsum(~mine) - 1)))


def ids_by_text(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and ids of whole texts at hand, each distinct word of them encoded once."""
    offsets, keys = cut_words(text)
    codes, distinct = T.coded(keys)
    by_word, ids = T.lists(encode_words(distinct, path).take(pa.array(codes)))
    return by_word[offsets], ids.to_numpy(zero_copy_only=False)


def _pack(**columns) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


#: A slice's words (or ids) in one bucket, or as bucket -1 the slice itself: its texts' ids and numbers of words, and its words as numbers.
#: check: a hash of the words of the bucket, or of all buckets in order.
ROW = "slice long, bucket long, check binary, texts binary, words binary"
_NAMES, _KINDS = ["slice", "bucket", "check", "texts", "words"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
#: Tokens that become rows at once.
TOKENS = 1 << 22


def _slice(text: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Offsets of texts, numbers of their words, the distinct words ordered by bucket and by themselves, and where buckets begin."""
    offsets, keys = cut_words(text)
    codes, distinct = T.coded(keys)
    bucket = np.array([xxhash.xxh32_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.int64) % buckets
    order = pc.sort_indices(distinct).to_numpy()
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    return offsets, place[codes], distinct.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1))


def _deal(buckets: int, texts: bool, limit: int):
    """Rows of ROW: for each slice its distinct words by bucket, or (``texts``) the slice itself."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId() << 32 if task else 0
        for part in T.together(batches, limit=limit):
            offsets, codes, words, starts = _slice(pc.fill_null(part.column("text"), ""), buckets)
            full = np.flatnonzero(np.diff(starts))
            checks = [xxhash.xxh64_digest(x.as_buffer()) for x in T.joined(starts, words, "").take(pa.array(full))]
            if texts:
                docs = _pack(doc_id=part.column("doc_id"), n=pa.array(np.diff(offsets), pa.int32()))
                planes = _pack(**{f"plane{i}": pa.array((codes >> 8 * i).astype(np.uint8)) for i in range(4) if i == 0 or len(words) >> 8 * i})
                rows = [(number, -1, b"".join(checks), docs, planes)]
            else:
                rows = [(number, b, check, None, _pack(words=words.slice(starts[b], starts[b + 1] - starts[b]))) for b, check in zip(full.tolist(), checks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
            number += 1

    return run


def _encode(path: str):
    """The rows of a bucket come together: their words' ids in place of the words.  A word is encoded where it is first met."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, known, ids = None, {}, None
        kind = pa.list_(pa.uint16() if len(pieces(path)) <= 1 << 16 else pa.int32())
        for batch in batches:
            out = []
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            for start, stop in itertools.pairwise([*np.flatnonzero(np.diff(bucket, prepend=np.nan)).tolist(), len(bucket)]):
                if bucket[start] != now:
                    now, known, ids = bucket[start], {}, pa.array([], kind)
                blobs = [_unpack(x).column("words").to_pylist() for x in batch.column("words").slice(start, stop - start)]
                fresh = [w for w in dict.fromkeys(itertools.chain.from_iterable(blobs)) if w not in known]
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                ids = pa.concat_arrays([ids, encode_words(pa.array(fresh, pa.string()), path).cast(kind)])
                out += [_pack(ids=ids.take(pa.array([known[w] for w in blob], pa.int32()))) for blob in blobs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES[:-1]), pa.array(out, pa.binary())], names=_NAMES)

    return run


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id and piece (binary): as many rows as the vocabulary, which bounds its broadcast."""
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces(path))), pa.int32()), "piece": pa.array(pieces(path), pa.binary())}))


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``key`` and ``bytes`` for rows of ``key`` (not repeated) and ``ids`` (array<int>): ids are joined with their pieces and put in order again."""
    table = F.broadcast(piece_table(rows.sparkSession, path or default_path()))
    one = rows.select("key", F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    got = one.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    return got.select("key", F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("bytes"))


def _assemble(path: str, finish: Callable, schema: str):
    """The rows of a slice come together: its numbers, then its words' ids by bucket; ``finish`` makes rows of doc_id, offsets and ids."""
    names = [f.split()[0] for f in schema.split(", ")]

    def whole(rows: list[tuple]):
        check, texts, numbers = rows[0]
        if check.as_py() != b"".join(c.as_py() for c, _, _ in rows[1:]):
            raise RuntimeError("the documents were other ones when they were computed again; checkpoint them before")
        docs, planes = _unpack(texts), _unpack(numbers)
        codes = sum(planes.column(i).to_numpy().astype(np.uint32) << 8 * i for i in range(planes.num_columns))
        by_word, ids = T.lists(pa.concat_arrays([_unpack(w).column("ids") for _, _, w in rows[1:]]).take(pa.array(codes)))
        offsets = by_word[np.concatenate([[0], np.cumsum(docs.column("n").to_numpy())])]
        for start, n in T.runs(np.diff(offsets), TOKENS):
            at = offsets[start : start + n + 1]
            some = ids.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([docs.column("doc_id").slice(start, n), *finish(at - at[0], some)], names=names)

    def run(batches: Iterator[pa.RecordBatch]):
        now, rows = None, []
        for batch in batches:
            for number, *row in zip(batch.column("slice").to_pylist(), *(batch.column(c) for c in ("check", "texts", "words")), strict=True):
                if number != now and rows:
                    yield from whole(rows)
                    rows = []
                now = number
                rows.append(row)
        if rows:
            yield from whole(rows)

    return run


def _by_table(docs: DataFrame, path: str, finish: Callable, schema: str, limit: int) -> DataFrame:
    T.bounded_batches(docs.sparkSession)
    parts = T.partitions(docs.sparkSession)
    # both readings cut the same slices: rows of a partition are put in order first
    rows = T.id_and_text(docs).sortWithinPartitions("doc_id", F.xxhash64("text"))
    words = rows.mapInArrow(_deal(BUCKETS * parts, False, limit), ROW).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode(path), ROW)
    both = rows.mapInArrow(_deal(BUCKETS * parts, True, limit), ROW).unionAll(words)
    # slices, few and large, are dealt in turn: by their partition, and the second slices of all partitions behind the first
    turn = F.pmod(F.shiftright("slice", 32) + 31 * F.col("slice").bitwiseAND(0xFFFFFFFF), F.lit(parts)).cast("int")
    return both.repartitionById(parts, turn).sortWithinPartitions("slice", "bucket").mapInArrow(_assemble(path, finish, schema), schema)


def encode(docs: DataFrame, path: str | None = None, limit: int = SLICE) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of each text."""

    def finish(offsets, ids):
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    return _by_table(docs, path or default_path(), finish, "doc_id long, ids array<int>", limit)


def round_trip(docs: DataFrame, path: str | None = None, limit: int = SLICE) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids (decimal, by commas) and of the text decoded from them.

    The ids are joined with their pieces by position in the vocabulary, as ``decode_ids`` does by key.
    """
    path = path or default_path()

    def finish(offsets, ids):
        table, decimal = _vocabulary(path)
        at = pa.array(ids)
        shown, decoded = T.joined(offsets, decimal.take(at), ","), T.joined(offsets, table.take(at), b"")
        return [pa.array(np.diff(offsets), pa.int64()), pa.array(sha256s(shown), pa.string()), pa.array([_text_sha256(x) for x in decoded], pa.string())]

    return _by_table(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", limit)


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[pa.Array, pa.Array]:
    """Pieces and decimal numbers, by id."""
    return pa.array(pieces(path), pa.binary()), pa.array([str(i) for i in range(len(pieces(path)))], pa.string())


def sha256s(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in texts]


def _text_sha256(raw: pa.Scalar) -> str:
    """Of the bytes as text: what is no UTF-8 (no whole text gives such ids) becomes U+FFFD, as in the library's decoder."""
    data = raw.as_py()
    try:
        data.decode()
    except UnicodeDecodeError:
        data = data.decode(errors="replace").encode()
    return hashlib.sha256(data).hexdigest()
