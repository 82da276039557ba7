"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables, verified on the vectors themselves.

* Equal vectors count once, with their number.  A rotation learned on a bounded sample (``itq``) gives each vector 64 bits; two vectors
  at an angle t differ in about 64 t / pi of them.
* Tables are substrings of the code, as many bits wide as there are powers of two in the number of vectors (16 at least, 32 at most), so that the vectors
  that meet by chance are few at every size.  A vector is entered under its substring and those one bit away, so two meet if they differ in two
  bits or fewer.  There are as many tables as it takes to miss at most MISS of the pairs right at the threshold.
* Many near copies of one vector must not become all their pairs.  So first each vector looks, among the vectors of least hash under its keys, for a
  leader within half the angle; those of one leader are a ball, and all of a ball are linked with each other, whatever their number.  Then
  it is balls that meet under keys.  The angle of two leaders and the balls' radii tell whether all or none of two balls' vectors are
  linked; only if neither is sure are their vectors compared, in blocks of about BLOCK by BLOCK.
* Links are counted by weight and never written out; components are those of balls.

No link below the threshold is made: every one is by a cosine in double precision, or by angles that leave no doubt.  Candidates are all that two vectors
sharing a key give, without a cap.  What may be missed are pairs that share no key of any table (at the threshold about MISS, far fewer above it).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths never
link; those of other lengths than the commonest get their bits by random planes; a row without id takes part, its component is that of the
smallest id there (null if there is none, then it is kept); repeated rows are linked with each other and each give a row; a cosine equal to the threshold links; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.graph import components
from . import text as T

COSINE = 0.9
BITS = 64
#: Vectors that the rotation is learned on: those of least hash.
SAMPLE = 4096
#: Share of pairs at the threshold that may share no key.
MISS = 0.03
NARROW, WIDE = 16, 32
#: Vectors of a ball compared at once.
BLOCK = 256
#: Leaders of least hash that a vector tries.
LEADERS = 4
#: Angles nearer to a bound than this are settled by the vectors themselves.
DOUBT = 1e-6
SEED = 7


def itq(sample: np.ndarray, rounds: int = 30, seed: int = SEED) -> np.ndarray:
    """A map from vectors to BITS numbers whose signs are the code: principal directions, then the rotation that brings them nearest to signs.

    Vectors of fewer dimensions than bits are first laid into as many dimensions by a random frame that keeps angles."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    if d < BITS:
        base = np.linalg.qr(rng.normal(size=(BITS, d)))[0].T
    elif len(sample) < 2:
        base = np.linalg.qr(rng.normal(size=(d, BITS)))[0]
    else:
        base = np.linalg.eigh(sample.T @ sample)[1][:, : d - BITS - 1 : -1] if d > BITS else np.linalg.eigh(sample.T @ sample)[1]
    laid = sample @ base
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds if len(sample) else 0):
        signs = np.where(laid @ turn > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(signs.T @ laid)
        turn = (u @ w).T
    return base @ turn


@lru_cache(maxsize=64)
def _planes(d: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).normal(size=(d, BITS))


def tables(n: int, cosine: float = COSINE, miss: float = MISS) -> np.ndarray:
    """The bits of each table, by row, for n vectors."""
    wide = min(max(NARROW, math.ceil(math.log2(max(n, 2)))), WIDE)
    p = math.acos(cosine) / math.pi
    meets = sum(math.comb(wide, k) * p**k * (1 - p) ** (wide - k) for k in range(3))
    many, rng, out = max(1, math.ceil(math.log(miss) / math.log(1 - meets))), np.random.default_rng(SEED), []
    while len(out) < many:  # tables of one permutation have no bit in common
        order = rng.permutation(BITS)
        out += [order[i : i + wide] for i in range(0, BITS - wide + 1, wide)]
    return np.array(out[:many])


def reach(cosine: float) -> int:
    """Differing bits beyond which three standard deviations say that two vectors are no link."""
    p = math.acos(cosine) / math.pi
    return math.ceil(BITS * p + 3 * math.sqrt(BITS * p * (1 - p)))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a column of packed vectors, by length; nulls are left out."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for wide in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == wide)
        yield at, np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), wide // 8)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, a hash of the vector, and the vector at length one; both null if it can't link."""
    for b in batches:
        some = pc.fill_null(pc.list_value_length(b.column("v")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, flat = np.concatenate([[0], np.cumsum(some)]), b.column("v").flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        digest, unit = [None] * b.num_rows, [None] * b.num_rows
        for i, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            v = x[start:stop]
            if stop > start and np.isfinite(v).all() and v.any():
                v = v + 0.0  # one zero
                digest[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
                v = v / np.abs(v).max()
                unit[i] = (v / np.sqrt(v @ v)).astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(digest, pa.binary()), pa.array(unit, pa.binary())], names=["vec_id", "digest", "unit"])


def codes(unit: pa.Array, rotation: np.ndarray) -> np.ndarray:
    out = np.zeros(len(unit), np.uint64)
    for at, x in _matrices(unit):
        bits = x @ (rotation if x.shape[1] == len(rotation) else _planes(x.shape[1])) > 0
        out[at] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


def keys(code: np.ndarray, bits: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each code (row) its keys: by table the substring and those one bit away; vectors of different lengths have no key in common."""
    wide = bits.shape[1]
    flips = np.array([0, *(1 << i for i in range(wide))], np.int64)
    out = []
    for t, places in enumerate(bits.tolist()):
        sub = np.zeros(len(code), np.int64)
        for i, place in enumerate(places):
            sub |= (code >> place & 1) << i
        out.append((sub[:, None] ^ flips[None, :]) + (t << WIDE))
    # up to 2**38 by table and substring, the length above
    return np.concatenate(out, axis=1) + (length.astype(np.int64)[:, None] << 40)


def _keyed(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows once for each key of their ``code``."""

    @F.arrow_udf("array<long>")
    def of(code: pa.Array, length: pa.Array) -> pa.Array:
        found = keys(code.to_numpy(), bits, length.to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

    return rows.withColumn("key", F.explode(of("code", "length")))


@F.arrow_udf(DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    for (at, x), (_, y) in zip(_matrices(a), _matrices(b), strict=True):
        out[at] = np.einsum("nd,nd->n", x, y)
    return pa.array(out)


def _blocks(cosine: float):
    """Pairs of blocks: the weight that each vector is linked with in the other block, and a row for the two balls if there is a link."""

    def side(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = block.values
        pid, weight = (x.field(c).to_numpy() for c in ("pid", "weight"))
        return pid, weight, np.frombuffer(b"".join(x.field("unit").to_pylist()), "<f8").reshape(len(pid), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, one, other in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("one"), b.column("other"), strict=True):
                (p, w, x), (q, v, y) = side(one), side(other)
                near = x @ y.T >= cosine
                if not near.any():
                    continue
                n = np.concatenate([near @ v, w @ near])
                pid = np.concatenate([p, q])
                got = n > 0
                k = int(got.sum())
                yield pa.RecordBatch.from_arrays([pa.array([None, *pid[got].tolist()], pa.int64()), pa.array([0, *n[got].tolist()], pa.int64()), pa.array([a] + [None] * k, pa.int64()), pa.array([c] + [None] * k, pa.int64())], names=["pid", "n", "a", "b"])

    return run


def _differ(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _balls(points: DataFrame, bits: np.ndarray, cosine: float) -> DataFrame:
    """pid, ball (its leader's pid) and the angle to the leader: one row a point."""
    half = math.sqrt((1 + cosine) / 2)
    keyed = _keyed(points.select("pid", "code", "length", "rank"), bits)
    least = keyed.groupBy("key").agg(F.min(F.struct("rank", "pid", "code")).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = keyed.join(least.select("key", "l"), "key").where((F.col("pid") != F.col("l.pid")) & (_differ(F.col("code"), F.col("l.code")) <= reach(half)))
    tried = near.groupBy("pid").agg(F.slice(F.array_sort(F.collect_set(F.struct("l.rank", "l.pid"))), 1, LEADERS).alias("l"))
    pairs = tried.select("pid", F.explode("l").alias("l")).select("pid", "l.rank", F.col("l.pid").alias("ball"))
    own, led = points.select("pid", "unit"), points.select(F.col("pid").alias("ball"), F.col("unit").alias("lead"))
    met = pairs.join(own, "pid").join(led, "ball").withColumn("cos", _cosine("unit", "lead")).where(F.col("cos") >= half + 1e-9)
    best = met.groupBy("pid").agg(F.min(F.struct("rank", "ball", "cos")).alias("m"))
    angle = F.acos(F.least(F.col("m.cos"), F.lit(1.0)))
    return points.select("pid").join(best, "pid", "left").select("pid", F.coalesce("m.ball", "pid").alias("ball"), F.coalesce(angle, F.lit(0.0)).alias("off"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row a vector of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    T.bounded_batches(spark)
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = T.cut(raw.mapInArrow(_unit, "vec_id long, digest binary, unit binary"))
    whole = rows.where("digest is not null")
    common = whole.groupBy(F.length("unit").alias("length")).count().orderBy(F.desc("count"), "length").first()
    wide = common["length"] if common else 8 * BITS
    sample = whole.where(F.length("unit") == wide).select("digest", "unit").distinct().orderBy("digest").limit(SAMPLE).collect()
    rotation = itq(np.frombuffer(b"".join(r["unit"] for r in sample), "<f8").reshape(len(sample), wide // 8))

    @F.arrow_udf("long")
    def code(unit: pa.Array) -> pa.Array:
        return pa.array(codes(unit, rotation))

    distinct = whole.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"))
    numbered = distinct.select(F.monotonically_increasing_id().alias("pid"), "*", code("unit").alias("code"), F.length("unit").alias("length"), F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("rank"))
    points = T.cut(numbered)
    bits = tables(points.count(), cosine, miss)
    member = T.cut(points.join(_balls(points, bits, cosine), "pid"))
    leader = points.select(F.col("pid").alias("ball"), F.col("code").alias("at"), F.col("unit").alias("lead"))
    sizes = member.join(leader.select("ball", "at"), "ball").groupBy("ball", "at").agg(
        F.max("off").alias("radius"), F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"), F.min("id").alias("id"), F.max(_differ(F.col("code"), F.col("at"))).alias("slack")
    )
    balls = T.cut(sizes.join(leader.select("ball", "lead"), "ball"))
    # balls that meet: each is under a key once, however many of its vectors are
    entered = _keyed(member.select("ball", "code", "length"), bits).select("key", "ball").distinct().join(balls.select("ball", "at", "slack"), "ball")
    one, other = (entered.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("ball", "at", "slack")]) for i in (1, 2))
    meet = one.join(other, "key").where((F.col("ball1") < F.col("ball2")) & (_differ(F.col("at1"), F.col("at2")) <= F.col("slack1") + F.col("slack2") + reach(cosine)))
    pairs = meet.select(F.col("ball1").alias("a"), F.col("ball2").alias("b")).distinct()
    side = lambda i, c: balls.select(F.col("ball").alias(c), *[F.col(x).alias(f"{x}{i}") for x in ("lead", "radius", "size", "weight")])
    angle, limit = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))), math.acos(cosine)
    loose = F.col("radius1") + F.col("radius2")
    state = F.when(loose == 0, F.when(F.col("cos") >= cosine, "all").otherwise("none")).when(angle + loose <= limit - DOUBT, "all").when(angle - loose > limit + DOUBT, "none").otherwise("some")
    told = pairs.join(side(1, "a"), "a").join(side(2, "b"), "b").withColumn("cos", _cosine("lead1", "lead2")).withColumn("state", state)
    told = T.cut(told.where("state <> 'none'").select("a", "b", "state", "size1", "size2", "weight1", "weight2"))
    # the rest: blocks of vectors of one ball against blocks of the other
    many = lambda size: F.ceil(F.col(size) / BLOCK).cast("int")
    blocks = member.join(balls.select("ball", "size"), "ball").withColumn("block", F.pmod(F.xxhash64("pid"), many("size")).cast("int")).groupBy("ball", "block").agg(F.collect_list(F.struct("pid", "weight", "unit")).alias("rows"))
    some = told.where("state = 'some'").select("a", "b", "size2", F.explode(F.sequence(F.lit(0), many("size1") - 1)).alias("i")).select("a", "b", "i", F.explode(F.sequence(F.lit(0), many("size2") - 1)).alias("j"))
    laid = some.join(blocks.select(F.col("ball").alias("a"), F.col("block").alias("i"), F.col("rows").alias("one")), ["a", "i"]).join(blocks.select(F.col("ball").alias("b"), F.col("block").alias("j"), F.col("rows").alias("other")), ["b", "j"])
    compared = T.cut(laid.select("a", "b", "one", "other").mapInArrow(_blocks(cosine), "pid long, n long, a long, b long"))
    edges = told.where("state = 'all'").select("a", "b").union(compared.where("pid is null").select("a", "b").distinct())
    label = components(edges).withColumnRenamed("node", "ball")
    least = balls.join(label, "ball", "left").withColumn("label", F.coalesce("label", "ball"))
    component = least.join(least.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("ball", "component_id")
    both = told.where("state = 'all'").select(F.col("a").alias("ball"), F.col("weight2").alias("n")).union(told.where("state = 'all'").select(F.col("b").alias("ball"), F.col("weight1").alias("n")))
    by_ball = both.groupBy("ball").agg(F.sum("n").alias("across"))
    by_point = compared.where("pid is not null").groupBy("pid").agg(F.sum("n").alias("single"))
    found = member.select("digest", "pid", "ball").join(balls.select("ball", "weight"), "ball").join(component, "ball").join(by_ball, "ball", "left").join(by_point, "pid", "left")
    count = F.col("weight") - 1 + F.coalesce("across", F.lit(0)) + F.coalesce("single", F.lit(0))
    out = rows.select("vec_id", "digest").join(found.select("digest", count.alias("n_links"), "component_id"), "digest", "left")
    mine = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), (mine.isNull() | F.coalesce(F.col("vec_id") == mine, F.lit(False))).alias("kept"))
