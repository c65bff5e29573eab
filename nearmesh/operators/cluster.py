"""Sampling, seeding, Lloyd refinement, balancing, statistics and quantisation of buckets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmesh.functions.vector import dequantize, l2_squared, quantize
from nearmesh.operators.knn import assign_nearest
from nearmesh.session import materialise


def hash_order(seed: int, id_col: str = "id"):
    """Arithmetic hash of an id; every SQL engine evaluates it alike."""
    return (F.col(id_col) * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(4294967296)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement: those with the smallest hashes."""
    return df.orderBy(hash_order(seed), "id").limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A repeatable Bernoulli-like subset: hash below a share of its range; no sort, no shuffle."""
    return df.where(hash_order(seed) < F.lit(int(fraction * 4294967296)))


def sample_centroids(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(bucket_id, vec): n sampled rows, numbered in hash order. n is the bucket count, bounded by the caller."""
    w = Window.orderBy("h", "id")
    chosen = vectors.select("id", "vec", hash_order(seed).alias("h")).orderBy("h", "id").limit(n)
    return chosen.select((F.row_number().over(w) - 1).cast("long").alias("bucket_id"), "vec")


def uniform(i: int, seed: int = 0) -> float:
    """The i-th draw from [0, 1): an arithmetic hash, alike in every engine."""
    return ((i + 1) * 2654435761 + seed * 40503 + 12345) * 69621 % 4294967296 / 4294967296


#: Most rows of a pool on the driver; 128 dimensions take 64 MB.
POOL = 65_536


def kmeans_pp(vectors: DataFrame, n: int, seed: int = 0, pool: int | None = None) -> DataFrame:
    """KMeans++ seeding on a hash-ordered pool of min(N, 20 n) rows, in order of id.

    The next centre is the first row whose cumulated squared distance passes a uniform
    draw of the total (a total of 0 draws evenly). The pool is held in one place, so it
    may not exceed POOL rows: beyond that use ``kmeans_parallel``.
    """
    pool = pool or 20 * n
    if pool > POOL:
        raise ValueError("the pool is too large for one place; use kmeans_parallel")
    rows = sample_rows(vectors, pool, seed).toPandas().sort_values("id")
    x = np.array(rows["vec"].tolist(), dtype=float)
    picked: list[int] = []
    near = np.zeros(len(x))
    while len(picked) < min(n, len(x)):
        total, u = near.sum(), uniform(len(picked), seed)
        i = int(np.searchsorted(np.cumsum(near), u * total, side="right")) if total > 0 else int(u * len(x))
        picked.append(min(i, len(x) - 1))
        d = ((x - x[picked[-1]]) ** 2).sum(axis=1)
        near = d if len(picked) == 1 else np.minimum(near, d)
    data = [(b, [float(v) for v in x[i]]) for b, i in enumerate(picked)]
    return vectors.sparkSession.createDataFrame(data, "bucket_id long, vec array<double>")


def kmeans_parallel(vectors: DataFrame, n: int, seed: int = 0, rounds: int = 4) -> DataFrame:
    """(bucket_id, vec): KMeans-parallel seeding; centres are rows of the table, an id is taken once.

    Every round keeps each row with probability 2 n / rounds * d2 / sum(d2), d2 being its
    squared distance to the centres so far. The candidates are weighted by the rows
    nearest to them, and n of them drawn without replacement by those weights. All in
    DataFrames: only sums reach the driver.
    """
    draw = lambda i, salt: ((F.pmod(F.xxhash64(F.col(i), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1)))
    base = vectors.select("id", "vec")
    chosen = materialise(sample_rows(base, 1, seed), "centres")
    for r in range(rounds):
        near = materialise(assign_nearest(base, chosen.select(F.col("id").alias("bucket_id"), "vec")).select("id", "dist"), "near")
        total = near.agg(F.sum("dist")).first()[0] or 0.0
        if total <= 0:
            break
        more = near.where(draw("id", r) < F.col("dist") * F.lit(2.0 * n / rounds / total)).select("id").join(chosen.select("id"), "id", "left_anti")
        chosen = materialise(chosen.unionByName(base.join(more, "id", "left_semi")), "centres")
    weights = assign_nearest(base, chosen.select(F.col("id").alias("bucket_id"), "vec")).groupBy(F.col("bucket_id").alias("id")).agg(F.count("*").alias("w"))
    ranked = chosen.join(weights, "id", "left").withColumn("key", -F.log(draw("id", -1)) / F.coalesce("w", F.lit(1)))
    top = materialise(ranked.orderBy("key", "id").limit(n).select("id", "vec", "key"), "centres")
    missing = n - top.count()
    if missing > 0:  # too few candidates: fill up with rows by hash
        rest = sample_rows(base.join(top.select("id"), "id", "left_anti"), missing, seed).select("id", "vec", F.lit(float("inf")).alias("key"))
        top = materialise(top.unionByName(rest), "centres")
    return numbered(top, "key", "id").select(F.col("number").alias("bucket_id"), "vec")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``, 0 .. N-1 in ``order``: range-sorted parts, whose counts give each its first number."""
    sorted_ = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    counts = sorted(sorted_.groupBy(part.alias("p")).count().collect())  # one row per part
    before, first = 0, []
    for p, c in counts:
        first.append((p, before))
        before += c
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "p long, first long"))
    out = sorted_.join(starts, part == F.col("p"))
    return out.withColumn("number", F.col("first") + (F.col("at") - F.shiftleft(F.col("p"), 33))).drop("p", "first", "at")


def lloyd_step(vectors: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignment, new centroids): mean per cluster and dimension; an empty cluster keeps its centre."""
    placed = assign_nearest(vectors, centroids).select("id", "bucket_id")
    parts = placed.join(vectors, "id").select("bucket_id", F.posexplode("vec").alias("dim", "x"))
    means = parts.groupBy("bucket_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    new = means.groupBy("bucket_id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("s"))
    new = new.select("bucket_id", F.transform("s", lambda e: e["x"]).alias("new"))
    moved = centroids.join(new, "bucket_id", "left").select("bucket_id", F.coalesce("new", F.col("vec").cast("array<double>")).alias("vec"))
    return placed, moved


def lloyd(vectors: DataFrame, centroids: DataFrame, iterations: int = 5, reassign: bool = False) -> tuple[DataFrame, DataFrame]:
    """Refined (assignment, centroids). The assignment precedes the last update unless ``reassign``."""
    placed = None
    for _ in range(iterations):
        placed, moved = lloyd_step(vectors, centroids)
        centroids = materialise(moved, "centroids")
    if placed is None or reassign:
        placed = assign_nearest(vectors, centroids).select("id", "bucket_id")
    return materialise(placed, "assignment"), centroids


def top2(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, b1, d1, b2, d2): nearest and second nearest bucket."""
    near = assign_nearest(vectors, centroids, k=2)
    one = near.where("rank = 0").select("id", F.col("bucket_id").alias("b1"), F.col("dist").alias("d1"))
    two = near.where("rank = 1").select("id", F.col("bucket_id").alias("b2"), F.col("dist").alias("d2"))
    return one.join(two, "id")


def rebalance_step(assignment: DataFrame, choices: DataFrame, target: int, slack: int = 4) -> DataFrame:
    """One round: of each bucket above target + slack, its excess over target goes to second buckets.

    Counts are those before the round. Movable are the rows whose second bucket is not
    above target + slack, or all rows of the bucket if there is none; those of least
    added distance go, then by id. Returns (id, bucket_id).
    """
    return _moved(assignment.join(choices, "id"), target, slack).select("id", "bucket_id")


def _moved(state: DataFrame, target: int, slack: int) -> DataFrame:
    """``state`` (id, bucket_id, b1, d1, b2, d2) after one round, with the column moved."""
    sizes = state.groupBy("bucket_id").agg(F.count("*").alias("have"))
    second = sizes.select(F.col("bucket_id").alias("b2"), F.col("have").alias("there"))
    rows = state.join(sizes, "bucket_id").join(second, "b2", "left").withColumn("free", F.coalesce("there", F.lit(0)) <= target + slack)
    bucket = Window.partitionBy("bucket_id")
    rows = rows.withColumn("go", F.col("free") | ~F.max("free").over(bucket))
    rows = rows.withColumn("rn", F.row_number().over(bucket.orderBy(~F.col("go"), F.col("d2") - F.col("d1"), "id")))
    move = (F.col("have") > target + slack) & F.col("go") & (F.col("rn") <= F.col("have") - target)
    new = F.when(move, F.col("b2")).otherwise(F.col("bucket_id"))
    return rows.select("id", new.alias("bucket_id"), "b1", "d1", "b2", "d2", (move & (F.col("b2") != F.col("bucket_id"))).alias("moved"))


def rebalance(assignment: DataFrame, choices: DataFrame, target: int, slack: int = 4, iterations: int = 30) -> DataFrame:
    """Rounds of ``rebalance_step`` until no bucket is above target + slack or nothing moves."""
    state = assignment.join(choices.select("id", "b1", "d1", "b2", "d2"), "id")
    for _ in range(iterations):
        state = materialise(_moved(state, target, slack), "assignment")
        sizes = state.groupBy("bucket_id").agg(F.count("*").alias("n"), F.count_if("moved").alias("m"))
        most, moved = sizes.agg(F.max("n"), F.sum("m")).first()
        if not moved or most <= target + slack:
            break
        state = state.drop("moved")
    return state.select("id", "bucket_id")


def rebalance_live(assignment: DataFrame, choices: DataFrame, target: int, slack: int = 4, iterations: int = 30) -> DataFrame:
    """As ``rebalance``, but buckets are taken in order of id, their moves count at once, and no row goes to an overloaded bucket.

    Sequential over the overloaded buckets only: each is one distributed step on the
    rows of that bucket; the sizes (one row per bucket) are kept on the driver.
    """
    choices = materialise(choices, "choices")
    for _ in range(iterations):
        sizes = {r[0]: r[1] for r in assignment.groupBy("bucket_id").count().collect()}
        over = sorted(b for b, n in sizes.items() if n > target + slack)
        moved = 0
        for b in over:
            # Which second buckets are open is settled when the bucket's turn comes.
            shut = [x for x, n in sizes.items() if n > target + slack]
            rows = assignment.where(F.col("bucket_id") == b).join(choices, "id").where(~F.col("b2").isin(shut))
            go = [(r.id, r.b2) for r in rows.orderBy(F.col("d2") - F.col("d1"), "id").limit(sizes[b] - target).select("id", "b2").collect()]
            for _, to in go:
                sizes[to] = sizes.get(to, 0) + 1
            sizes[b] -= len(go)
            moved += sum(to != b for _, to in go)
            if go:
                moves = assignment.sparkSession.createDataFrame(go, "id long, to long")
                assignment = materialise(assignment.join(moves, "id", "left").select("id", F.coalesce("to", "bucket_id").alias("bucket_id")), "assignment")
        if not moved:
            break
    return assignment


def cap_buckets(vectors: DataFrame, centroids: DataFrame, factor: float = 8.0, choices: int = 4) -> DataFrame:
    """(id, bucket_id): no bucket keeps more than factor times the average; the rest go to the next of ``choices`` nearest with room.

    One pass per choice: of the rows that ask for a bucket the nearest stay up to its
    cap (by distance, id); what finds no room keeps its nearest bucket.
    """
    near = materialise(assign_nearest(vectors, centroids, k=choices), "near")
    n, buckets = vectors.count(), max(1, centroids.count())
    cap = max(1, int(factor * n / buckets))
    left, held, done = near.where("rank = 0").select("id"), None, []
    for rank in range(choices):
        asks = near.where(F.col("rank") == rank).join(left, "id").select("id", "bucket_id", "dist")
        if held is not None:
            asks = asks.join(held, "bucket_id", "left")
        w = Window.partitionBy("bucket_id").orderBy("dist", "id")
        room = F.lit(cap) - (F.coalesce("held", F.lit(0)) if held is not None else F.lit(0))
        fit = materialise(asks.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= room).select("id", "bucket_id"), "fit")
        done.append(fit)
        placed = reduce(DataFrame.unionByName, done)
        held = placed.groupBy("bucket_id").agg(F.count("*").alias("held"))
        left = left.join(fit, "id", "left_anti")
    rest = near.where("rank = 0").join(left, "id").select("id", "bucket_id")
    return reduce(DataFrame.unionByName, [*done, rest])


def two_choice_assign(choices: DataFrame, rule: str = "size", batches: int = 16) -> DataFrame:
    """(id, bucket_id): the nearer or second bucket by current sizes.

    Rules: ``size`` takes the second if its size is below 0.8 of the first's;
    ``slack`` if it is smaller and d2 < 1.2 d1. Sizes are frozen within a batch of
    ids (by hash), so each batch is one distributed step.
    """
    choices = materialise(choices.withColumn("batch", hash_order(1) % batches), "choices")
    done: list[DataFrame] = []
    for b in range(batches):
        sizes = reduce(DataFrame.unionByName, done).groupBy("bucket_id").count() if done else None
        rows = choices.where(F.col("batch") == b)
        if sizes is None:
            out = rows.select("id", F.col("b1").alias("bucket_id"))
        else:
            s1 = sizes.select(F.col("bucket_id").alias("b1"), F.col("count").alias("n1"))
            s2 = sizes.select(F.col("bucket_id").alias("b2"), F.col("count").alias("n2"))
            rows = rows.join(s1, "b1", "left").join(s2, "b2", "left")
            n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
            second = n2 < 0.8 * n1 if rule == "size" else (n2 < n1) & (F.col("d2") < 1.2 * F.col("d1"))
            out = rows.select("id", F.when(second, F.col("b2")).otherwise(F.col("b1")).alias("bucket_id"))
        done.append(materialise(out, "assigned"))
    return reduce(DataFrame.unionByName, done)


def build_buckets(vectors: DataFrame, n: int, seed: int = 0, iterations: int = 5, balance: bool = True, slack: int = 4):
    """(assignment, centroids): seeding, refinement, balancing."""
    seeds = kmeans_pp(vectors, n, seed) if 20 * n <= POOL else kmeans_parallel(vectors, n, seed)
    placed, cents = lloyd(vectors, seeds, iterations)
    if balance:
        target = -(-vectors.count() // n)
        placed = rebalance(placed, materialise(top2(vectors, cents), "choices"), target, slack)
    return placed, cents


def bucket_sizes(assignment: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket_id, n) of every bucket, empty ones with 0."""
    counts = assignment.groupBy("bucket_id").agg(F.count("*").alias("n"))
    return buckets.select("bucket_id").join(counts, "bucket_id", "left").select("bucket_id", F.coalesce("n", F.lit(0)).alias("n"))


def bucket_stats(sizes: DataFrame, target: int) -> DataFrame:
    """One row: buckets, min, max, mean, stddev, empty, within 4, 8 and 16 of the target."""
    close = [F.count_if(F.abs(F.col("n") - target) <= d).alias(f"within_{d}") for d in (4, 8, 16)]
    return sizes.agg(
        F.count("*").alias("buckets"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"),
        F.stddev_pop("n").alias("std_size"), F.count_if(F.col("n") == 0).alias("empty"), *close,
    )


def bucket_quantiles(sizes: DataFrame, quantiles=(0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """(q, n): the size at place floor(B q) of the ascending sizes."""
    total = Window.partitionBy(F.lit(1))
    ranked = sizes.select("n", (F.row_number().over(total.orderBy("n", "bucket_id")) - 1).alias("at"), F.count("*").over(total).alias("b"))
    qs = F.array(*map(F.lit, quantiles))
    return ranked.select("n", "at", "b", F.explode(qs).alias("q")).where(F.col("at") == F.floor(F.col("b") * F.col("q"))).select("q", "n")


def bucket_histogram(sizes: DataFrame, width: int, bins: int = 8) -> DataFrame:
    """(bin, buckets): bins of ``width``; the last holds the rest."""
    return sizes.select(F.least(F.floor(F.col("n") / width), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("buckets"))


def train_quantizer(vectors: DataFrame) -> tuple[list[float], list[float]]:
    """(minimum, range) per dimension; as many rows as dimensions reach the driver."""
    x = F.col("x").cast("double")
    dims = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy("dim").collect()
    return [r.lo for r in dims], [r.hi - r.lo for r in dims]


def quantize_vectors(vectors: DataFrame, quantizer, bits: int = 8) -> DataFrame:
    """(id, codes, decoded, error): codes, their decoding, and its squared distance."""
    low, scale = (F.array(*map(F.lit, q)) for q in quantizer)
    out = vectors.select("id", "vec", quantize("vec", low, scale, bits).alias("codes"))
    out = out.withColumn("decoded", dequantize(F.col("codes"), low, scale, bits))
    return out.select("id", "codes", "decoded", l2_squared("vec", "decoded").alias("error"))


def plan_load(n: int, dim: int, element_size: int, memory_bytes: int, sample_rate: float = 0.1, min_bits: int = 4) -> dict:
    """full, sampled or quantised loading for a memory limit; bits searched from 8 down."""
    if n <= 0 or dim <= 0 or not 0 < sample_rate <= 1 or not 1 <= min_bits <= 8:
        raise ValueError("bad load configuration")
    if n * dim * max(4, element_size) <= memory_bytes:
        return {"mode": "full", "rows": n, "bits": 32}
    rows = max(1, int(n * sample_rate))
    if rows * dim * 4 <= memory_bytes:
        return {"mode": "sampled", "rows": rows, "bits": 32}
    for bits in range(8, min_bits - 1, -1):
        if rows * dim * bits / 8 <= memory_bytes:
            return {"mode": "quantised", "rows": rows, "bits": bits}
    raise ValueError("the limit is too small for any mode")


def size_report(sizes: DataFrame) -> pd.DataFrame:
    """The five largest and five smallest non-empty buckets."""
    some = sizes.where("n > 0")
    return pd.concat([some.orderBy(F.desc("n"), "bucket_id").limit(5).toPandas(), some.orderBy("n", "bucket_id").limit(5).toPandas()])
