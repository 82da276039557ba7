"""Alignment of two tokenizers against whole-text encodings and loops over all tokens."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from wardlight.llm import alignment, bpe

KIND = "doc_id long, text string"
ODD = [None, "", " ", "   ", " a", "a ", "a  b   c ", "a▁b", "<|endoftext|> x <s> y", "\x00 a\tb\n\nc", "中文字符测试" * 50, "é ﬁ ① 𝔘", "x" * 5000, " 　 a", "\n", "9" * 300, "it's  don't\r\n"]


def brute(rows):
    a_path, b_path = bpe.default_path(), alignment.default_b()
    a_of, a_bytes, b_of, b_bytes = alignment._literal(a_path), bpe.pieces(a_path), alignment._pieces_model(b_path), alignment._b_bytes(b_path)
    found = []
    for _, text in rows:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []
        groups, i, j, at, bt, end_a, end_b = [], 0, 0, [], [], 0, 0
        while i < len(a) or j < len(b):  # the one that lies behind goes on
            if end_a <= end_b:
                at.append(a[i])
                end_a, i = end_a + len(a_bytes[a[i]]), i + 1
            else:
                bt.append(b[j])
                end_b, j = end_b + len(b_bytes[b[j]]), j + 1
            if end_a == end_b:
                groups.append((at, bt))
                at, bt = [], []
        found.append((a, b, groups, Counter((x, y) for p, q in groups for x in p for y in q)))
    n = Counter(pair for *_, pairs in found for pair in pairs)
    most = {}
    for (x, _), k in n.items():
        most[x] = max(most.get(x, 0), k)
    out = []
    for (key, _), (a, b, groups, pairs) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(k for pair, k in pairs.items() if n[pair] == most[pair[0]])
        out.append((key, len(a), len(b), len(groups), sum(pairs.values()), best, sum(k * n[pair] for pair, k in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr), {(x, y, k, k == most[x]) for (x, y), k in n.items()}


def rows_of(seed, n):
    r = random.Random(seed)
    made = ["".join("<|endoftext|>" if r.random() < 0.01 else r.choice("ab  \n\té中x1.▁' ") for _ in range(r.randrange(60))) for _ in range(n)]
    words = ["the", "cat", " sat", "Überfluss", "naïve", "x=1;", "1234", "\n", "  "]
    made += [" ".join(r.choice(words) for _ in range(r.randrange(1, 200))) for _ in range(n)]
    return [*enumerate(ODD + made), (None, "hello world"), (5, "hello world"), (5, "hello world")]


def test_agreement(spark, monkeypatch):
    rows = rows_of(3, 120)
    want, counts = brute(rows)
    df = spark.createDataFrame(rows, KIND).withColumn("slice", F.lit("x")).repartition(3)
    assert sorted(map(tuple, alignment.agreement(df).collect()), key=repr) == want
    assert set(map(tuple, alignment.pair_counts(df).collect())) == counts
    small = alignment.agreement(df.coalesce(1), limit=3000)  # many slices
    assert sorted(map(tuple, small.collect()), key=repr) == want


def test_long_text_in_chunks(monkeypatch):
    """The links of a slice made a few at a time."""
    rows = [(1, "lorem ipsum dolor 12345 中文 " * 2000), (2, None)]
    import pyarrow as pa

    def run():
        return alignment._slice(pa.array([1, 2], pa.int64()), pa.array([rows[0][1], ""]), bpe.default_path(), alignment.default_b(), 3)

    whole = run()
    monkeypatch.setattr(alignment, "LINKS", 100)
    assert [(b, d and bpe._unpack(pa.scalar(d)).to_pydict(), bpe._unpack(pa.scalar(x)).to_pydict()) for b, d, x in whole] == [(b, d and bpe._unpack(pa.scalar(d)).to_pydict(), bpe._unpack(pa.scalar(x)).to_pydict()) for b, d, x in run()]


def test_whole_texts_by_the_model(monkeypatch):
    """Word by word or whole, B gives the same."""
    import pyarrow as pa

    texts = pa.array([t for _, t in rows_of(8, 60) if t and "▁" not in t])  # texts with it have no tokens either way
    by_word = alignment.b_ids(texts, alignment.default_b())
    monkeypatch.setattr(alignment, "_by_words", lambda path: False)
    whole = alignment.b_ids(texts, alignment.default_b())
    assert all((x == y).all() for x, y in zip(by_word, whole, strict=True))


def test_nothing_to_align(spark):
    assert alignment.agreement(spark.createDataFrame([], KIND)).collect() == []
    assert list(map(tuple, alignment.agreement(spark.createDataFrame([(1, None), (2, "▁")], KIND)).orderBy("doc_id").collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
