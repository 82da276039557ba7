"""Toxicity by weak supervision.

Voters: lexicons (fixed lists of insults by language; lists of terms, words and word beginnings, that go with the
label in the learning folds, split into many by kind and hash) and patterns.  Each votes toxic (1), clean (-1) or not
at all (0).  A generative label model with two classes and a shared covariance of votes is fitted by
expectation-maximisation: class means are the voters' accuracies, the covariance their correlations, so voters that
repeat each other count less.  Its posterior labels, not the labels themselves, train a linear classifier
over the terms, which scores whole texts.

Terms are counted in Spark over a bounded sample of labelled documents (labelled.SAMPLE); what comes to the driver is
at most TERMS terms, and the term counts of the sample's documents.

Defined cases: a null or empty text has no terms and gets the score of the intercept; without labels, or
with one class alone, the fixed lists alone vote; a very long text is searched whole; of terms that tell as much the
smaller is chosen first; a score equal to the threshold predicts 1; repeated rows each give a row; a row without id is not held out; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labelled import SAMPLE, fold, sample
from .trees import sigmoid

THRESHOLD = 0.3
TERMS = 4096
#: Term kinds: a whole word, or its first so many characters.
KINDS = (0, 2, 3, 4, 5, 6)
GROUPS = 4
#: Share of documents with label 1 among those that hold a term of a toxic lexicon.
PURITY = 0.8
#: Insults by language, and patterns, all matched in lower-cased text.
INSULTS = {
    "en": ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "filth", "vermin", "garbage", "hate"],
    "fr": ["idiot", "imbécile", "crétin", "ordure", "salaud", "connard", "débile", "stupide", "minable", "pourriture"],
    "de": ["idiot", "dummkopf", "trottel", "abschaum", "arschloch", "blöd", "versager", "widerlich", "wertlos", "schwachkopf"],
    "es": ["idiota", "imbécil", "estúpido", "basura", "escoria", "inútil", "patético", "asqueroso", "tonto", "payaso"],
}
PATTERNS = {"shouting": r"!{2,}", "address": r"\byou(?:'re| are) (?:an? )?(?:idiot|moron|loser|clown|pathetic|stupid|worthless|disgusting)", "censored": r"\b[a-z]+\*{2,}[a-z]*"}
_FIXED = {**{k: r"\b(?:" + "|".join(v) + r")\b" for k, v in INSULTS.items()}, **PATTERNS}


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, word codes and distinct words (runs of letters, lower-cased)."""
    offsets, values = T.lists(pc.split_pattern_regex(pc.utf8_lower(text), r"[^\pL]+"))
    codes, distinct = T.coded(values)
    return offsets, codes, distinct


def of_kind(distinct: pa.Array, kind: int) -> pa.Array:
    """The term of each word, null if it has none of that kind."""
    n = pc.utf8_length(distinct)
    if kind == 0:
        return pc.if_else(pc.greater(n, 0), distinct, None)
    return pc.if_else(pc.greater(n, kind), pc.utf8_slice_codeunits(distinct, 0, kind), None)


def _tally(batches):
    """Documents, and those with label 1, that hold each term, by slice."""
    for part in T.slices(batches):
        offsets, codes, distinct = terms(pc.fill_null(part.column("text"), ""))
        label = part.column("label").to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(label)), np.diff(offsets))
        seen = np.unique(codes * len(label) + doc)
        code, doc = seen // len(label), seen % len(label)
        for kind in KINDS:
            term, names = T.coded(of_kind(distinct, kind).fill_null(""))
            pair = np.unique(term[code] * len(label) + doc) if kind else term[code] * len(label) + doc
            t, d = pair // len(label), pair % len(label)
            n, ones = np.bincount(t, minlength=len(names)), np.bincount(t, label[d], len(names))
            full = pc.greater(pc.utf8_length(names), 0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(full.sum(), kind), pa.int32()), names.filter(pa.array(full)), pa.array(n[full], pa.int64()), pa.array(ones[full].astype(np.int64))], names=["kind", "term", "n", "ones"])


def choose_terms(rows: DataFrame, most: int = TERMS) -> pd.DataFrame:
    """kind, term, n, ones, lift of the terms that go most with the label, or with its absence."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    base = (total["ones"] + 0.5) / (total["n"] + 1)
    counted = rows.mapInArrow(_tally, "kind int, term string, n long, ones long").groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    lift = (F.col("ones") - F.col("n") * base) / F.sqrt((F.col("n") + 1) * base * (1 - base))
    strong = counted.where("n >= 4").withColumn("lift", lift).where(F.abs("lift") > 4)
    return strong.orderBy(F.abs("lift").desc(), "kind", "term").limit(most).toPandas().astype({"ones": float, "n": float, "lift": float})


@dataclass
class Lexicon:
    """Terms by kind, with their places in the table of terms."""

    by_kind: dict[int, tuple[pa.Array, np.ndarray]]
    size: int

    @classmethod
    def of(cls, table: pd.DataFrame) -> Lexicon:
        kinds = table["kind"].to_numpy()
        return cls({k: (pa.array(table["term"][kinds == k].tolist(), pa.string()), np.flatnonzero(kinds == k)) for k in KINDS}, len(table))

    def counts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and count of the terms in each text."""
        offsets, codes, distinct = terms(text)
        doc = np.repeat(np.arange(len(text)), np.diff(offsets))
        found = []
        for kind, (names, places) in self.by_kind.items():
            if not len(names):
                continue
            at = pc.fill_null(pc.index_in(of_kind(distinct, kind), value_set=names), -1).to_numpy(zero_copy_only=False)[codes]
            found.append(doc[at >= 0] * self.size + places[at[at >= 0]])
        key, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return key // max(self.size, 1), key % max(self.size, 1), n


def fixed_hits(text: pa.Array) -> np.ndarray:
    low = pc.utf8_lower(text)
    return np.stack([pc.count_substring_regex(low, p).to_numpy(zero_copy_only=False) for p in _FIXED.values()], axis=1)


def votes(table: pd.DataFrame, doc: np.ndarray, term: np.ndarray, n: np.ndarray, fixed: np.ndarray, rows: int) -> np.ndarray:
    """One column a voter.  A lexicon of toxic terms, a fixed list or a pattern votes for toxic where it is met; that two of the terms
    are met votes for, that none is against; clean terms vote against."""
    columns = []
    group = np.array([zlib.crc32(t.encode()) % GROUPS for t in table["term"]], int) if len(table) else np.zeros(0, int)
    good = table["ones"].to_numpy() >= PURITY * table["n"].to_numpy()
    kind = table["kind"].to_numpy()
    met = lambda mine: np.bincount(doc[mine[term]], minlength=rows)
    for k in KINDS:
        for g in range(GROUPS):
            mine = good & (kind == k) & (group == g)
            if mine.any():
                columns.append(np.where(met(mine) > 0, 1.0, 0.0))
    if good.any():
        hits = np.bincount(doc[good[term]], n[good[term]], rows)
        columns += [np.where(hits > 0, 0.0, -1.0), np.where(hits > 1, 1.0, 0.0)]
    clean = table["lift"].to_numpy() < 0
    if clean.any():
        columns.append(np.where(met(clean) > 0, -1.0, 0.0))
    columns += [np.where(f > 0, 1.0, 0.0) for f in fixed.T]
    return np.stack(columns, axis=1)


def label_model(v: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of class 1 by row: two classes of votes with means (accuracies) and a shared covariance (correlations)."""
    if not len(v):
        return np.zeros(0)
    p = sigmoid(2.0 * ((v > 0).sum(axis=1) - 1.5))
    for _ in range(rounds):
        w1, w0 = p.sum() + 1e-3, (1 - p).sum() + 1e-3
        m1, m0 = p @ v / w1, (1 - p) @ v / w0
        a, b = v - m1, v - m0
        cov = ((a * p[:, None]).T @ a + (b * (1 - p)[:, None]).T @ b) / len(v) + 0.05 * np.eye(v.shape[1])
        weight = np.linalg.solve(cov, m1 - m0)
        after = sigmoid(v @ weight - weight @ (m1 + m0) / 2 + np.log(w1 / w0))
        if np.abs(after - p).max() < 1e-4:
            return after
        p = after
    return p


def linear(doc: np.ndarray, term: np.ndarray, n: np.ndarray, size: int, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the terms and, last, the intercept, by accelerated gradient steps on the log loss of soft labels."""
    x = values(doc, n, len(y))
    w, before = np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = before[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for i in range(rounds):
        at = w + (i / (i + 3)) * (w - before)
        gap = sigmoid(np.bincount(doc, x * at[term], len(y)) + at[-1]) - y
        grad = np.append(np.bincount(term, x * gap[doc], size), gap.sum()) / max(len(y), 1)
        grad[:-1] += ridge * at[:-1]
        before, w = w, at - 2.0 * grad
    return w


def values(doc: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Term weights of a document, of length 1 together."""
    x = np.log1p(n)
    return x / np.sqrt(np.bincount(doc, x * x, rows) + 1e-9)[doc]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: pa.Array) -> np.ndarray:
        doc, term, n = self.lexicon.counts(text)
        return sigmoid(np.bincount(doc, values(doc, n, len(text)) * self.weights[term], len(text)) + self.weights[-1])


def train(docs: DataFrame, labels: DataFrame, learn, size: int = SAMPLE) -> Model:
    T.bounded_batches(docs.sparkSession)
    rows = sample(docs, labels, "toxic", learn, size).select("doc_id", "label", "text")
    table = choose_terms(rows)
    lexicon = Lexicon.of(table)

    def found(batches):
        for part in T.slices(batches):
            text = pc.fill_null(part.column("text"), "")
            doc, term, n = lexicon.counts(text)
            at = np.searchsorted(doc, np.arange(len(text) + 1)).astype(np.int32)
            fixed = fixed_hits(text)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, pa.int32())) for x in (term, n)]
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * fixed.shape[1], pa.int32()), pa.array(fixed.reshape(-1), pa.int32())))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "term", "n", "fixed"])

    got = rows.mapInArrow(found, "doc_id long, term array<int>, n array<int>, fixed array<int>").toPandas().sort_values("doc_id", kind="stable")
    sizes = [len(t) for t in got["term"]]
    doc = np.repeat(np.arange(len(got)), sizes)
    term, n = (np.array([i for x in got[c] for i in x], np.int64) for c in ("term", "n"))
    fixed = np.array(got["fixed"].tolist(), np.int64).reshape(len(got), len(_FIXED))
    posterior = label_model(votes(table, doc, term, n, fixed, len(got)))
    return Model(lexicon, linear(doc, term, n, lexicon.size, posterior))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, fold(F.col("doc_id"), folds) != out)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(x) for x in T.array_slices(text)] or [np.zeros(0)]))

    rows = T.id_and_text(docs).select("doc_id", scored("text").alias("score"))
    held = fold(F.col("doc_id"), folds) == out
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
