"""Vector operators against plain numpy over all pairs."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from wardlight.llm import centroids, itq

KIND = "vec_id long, embedding array<double>"
ODD = [(100001, None), (100002, [0.0] * 64), (100003, [float("nan")] + [1.0] * 63), (100004, [None] + [1.0] * 63), (100005, []), (100006, [1.0, 2.0]), (100009, [float("inf")] * 64)]


def kmeans(rows, k, rounds, seed):
    """Exact integers, one by one."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) < 1 << 26 for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in start]
    x = np.array([v for _, v in kept], np.int64)

    def near():
        d = ((x[:, None, :] - np.array(cs)[None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        c, _ = near()
        cs = [[int(s) // int((c == j).sum()) for s in x[c == j].sum(axis=0)] if (c == j).any() else old for j, old in enumerate(cs)]
    c, d = near()
    show = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in cs]
    return [(i, int(j), int(e), int(d[c == j].sum()), int(d.sum()), show[j]) for (i, _), j, e in zip(kept, c, d, strict=True)]


def test_planes():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-3000, 5000, (40, 64)), rng.integers(-10, 3, (7, 64))
    px, py = centroids.to_planes(x), centroids.to_planes(y)
    assert px.shape[1] == 14 and py.shape[1] == 5
    assert (centroids.from_planes(px) == x).all() and (centroids.dots(px, py) == x @ y.T).all() and (centroids.lengths(px) == (x * x).sum(axis=1)).all()
    far = np.array([[(1 << 26) - 1] * 64, [-(1 << 26) + 1] * 64])
    assert centroids.nearest(centroids.to_planes(far[:1]), centroids.to_planes(far))[1][0] == 0
    d = centroids.nearest(centroids.to_planes(far[:1]), centroids.to_planes(far[1:]))[1][0]
    assert int(d) == 64 * (2 * ((1 << 26) - 1)) ** 2


def test_clusters_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * (0.1 + i % 3) + i % 5).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (300, [1e9] * 64), (301, [50.0] * 64), *ODD]  # a repeated row, one without id, one too long for exact distances
    df = spark.createDataFrame(rows, KIND).withColumn("cluster", F.lit("other")).repartition(5)
    got = centroids.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(kmeans(rows, 8, 10, 3), key=repr)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in (3, 1, 2)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, KIND)).collect())) == sorted(kmeans(rows, 8, 10, 3))
    same = [(i, [0.5] * 64) for i in range(20)]  # all are as near to each centroid: the first has them
    assert {r["cluster"] for r in centroids.cluster(spark.createDataFrame(same, KIND)).collect()} == {0}
    assert centroids.cluster(spark.createDataFrame([r for r in ODD if r[0] != 100002], KIND)).collect() == [] and centroids.cluster(spark.createDataFrame([], KIND)).collect() == []


def linked(rows, cosine):
    """By all pairs: links and least id reached, by row."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, over = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while over[i] != i:
            i = over[i]
        return i

    for d in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, row in zip(own, x, strict=True):
            for j in (own[k] for k in np.flatnonzero(x @ row >= cosine) if own[k] != i):
                n[i] += 1
                over[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(top(i), []).extend([key] if key is not None else [])
    return [(key, n[i], min(least[top(i)], default=None)) for i, (key, _) in enumerate(rows)]


def _apart(rng, v, cosine):
    w = rng.normal(size=len(v))
    w -= w @ v * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


def _some(rng, d=64):
    v = rng.normal(size=d)
    return v / np.linalg.norm(v)


def test_near_vectors(spark):
    """Pairs at all cosines, groups whose vectors are all linked, groups of which some are, many copies, and rows that link with nothing."""
    rng, rows = np.random.default_rng(3), []
    add = lambda v: rows.append((len(rows), list(map(float, v))))
    for _ in range(300):
        add(_some(rng))
    for i in range(150):
        v = _some(rng)
        add(v)
        add(3 * _apart(rng, v, 0.86 + i * 0.0009))
    for near in (0.99, 0.975, 0.955, 0.945):
        v = _some(rng)
        for _ in range(60):
            add(_apart(rng, v, near))
    v = _some(rng)
    for _ in range(100):
        add(v)
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, _some(rng).tolist()), (100007, [2.0, 4.0]), *ODD]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, KIND).withColumn("digest", F.lit(1)).repartition(4)
    got = sorted(map(tuple, itq.near_duplicates(df).collect()), key=repr)
    want = sorted(linked(rows, 0.9), key=repr)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.99 * there <= found <= there and len(got) == len(want)
    by = {r[0]: r for r in got if r[0] not in (None, 5)}
    assert all(by[w[0]][1] <= w[1] for w in want if w[0] in by)  # no link below the threshold
    assert sum(by[w[0]][1:3] != w[1:] for w in want if w[0] in by) <= 0.02 * len(by)
    assert all(r[3] == (r[0] == r[2]) for r in got if r[0] is not None)
    assert [by[i][1:] for i in (100001, 100002, 100003, 100005)] == [(0, i, True) for i in (100001, 100002, 100003, 100005)]
    assert by[100007][1:] == (1, 100006, False)


def test_recall_at_the_threshold(spark):
    rng, rows = np.random.default_rng(4), []
    for _ in range(700):
        v = _some(rng)
        rows += [(len(rows), v.tolist()), (len(rows) + 1, _apart(rng, v, rng.uniform(0.9001, 0.905)).tolist())]
    got = itq.near_duplicates(spark.createDataFrame(rows, KIND)).where("n_links > 0").count()
    assert got >= 0.94 * len(rows)


def test_tables():
    """Wider tables for more vectors, and more of them; at the threshold they miss what is stated."""
    p = math.acos(0.9) / math.pi
    for n, wide in ((10, 16), (60_000, 16), (1_000_000, 20), (1 << 40, 32)):
        bits = itq.tables(n)
        assert bits.shape[1] == wide and all(len(set(t)) == wide for t in bits.tolist())
        meets = sum(math.comb(wide, k) * p**k * (1 - p) ** (wide - k) for k in range(3))
        assert (1 - meets) ** len(bits) <= itq.MISS
    empty = itq.itq(np.zeros((0, 64)))
    assert empty.shape == (64, 64) and itq.itq(np.zeros((0, 3))).shape == (3, 64) and itq.itq(np.eye(100)).shape == (100, 64)


def test_no_vectors(spark):
    assert itq.near_duplicates(spark.createDataFrame([], KIND)).collect() == []
    alone = itq.near_duplicates(spark.createDataFrame([(1, None), (1, None), (None, None)], KIND)).collect()
    assert sorted(map(tuple, alone), key=repr) == [(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, True)]
