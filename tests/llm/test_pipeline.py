"""The pipeline, stage by stage, against a brute-force version."""

import hashlib

import pytest

import corpus_pipeline
from wardlight.llm import bpe, mixing, quality_rules, queries
from test_operators import SCHEMA, brute_fingerprint, rows, words  # noqa: I001


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        assert docs.columns == columns
        if name == "quality_rules":
            bits = {(r["doc_id"], r["n_words"]): r["fail_bits"] for r in quality_rules.ledger(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
            assert sorted(map(str, after)) == sorted(str(r) for r in before if bits[r["doc_id"], len(words(r["text"]))] == 0)
        elif name == "simhash_dedup":
            prints = [brute_fingerprint(r["text"]) for r in before]
            label = list(range(len(prints)))
            for _ in prints:
                label = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(prints))]
            assert len(after) == len(set(label)) and {str(r) for r in after} <= {str(r) for r in before}
            assert {r["doc_id"] for r in after if r["doc_id"] is not None} >= {min((before[i]["doc_id"] for i in range(len(label)) if label[i] == k and before[i]["doc_id"] is not None), default=None) for k in set(label)} - {None}
        elif name == "secret_scan":
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before)
        else:
            copies = {}
            for r in mixing.plan(spark.read.parquet(f"{folder}/secret_scan")).collect():
                copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
            got = {}
            for r in after:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {k: v for k, v in copies.items() if v}
        before = after
    t = bpe.tokenizer(bpe.default_path())
    want = sorted((str(r["doc_id"]), hashlib.sha256(",".join(map(str, t.encode(r["text"] or "").ids)).encode()).hexdigest()) for r in before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in last.collect()) == want
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.queries()) <= set(__spark_entry__.queries()) and set(queries.oracle_sql()) <= set(queries.queries())
