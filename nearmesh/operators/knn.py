"""Nearest-neighbour joins over vector tables (id BIGINT, vec ARRAY).

Strategies that give the same rows:

* ``hof``: a join with an array-function distance and a ranking window; the
  reference form, for small tables.
* ``block``: up to BLOCK queries (counted) go to all tasks in one broadcast; the base
  is scanned once and never shuffled, only k rows per query and task are. More
  queries meet the base in cells: both sides are cut into blocks, each pair of blocks
  is one key of an equi-join, and only k rows per query and cell leave it. Tasks
  pre-select with a matrix product and score the selection again in the direct form.
* ``bucketed_knn`` (approximate, a separate function): cells of bucket members and
  the rows that see the bucket.

Every order is total: (distance, id).
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmesh.functions.vector import l2_squared

#: Vectors of one broadcast block; at 128 dimensions about 16 MB.
BLOCK = 16_384
_SLACK = 8
_NEAR = "src long, dst long, dist double"


def rank_edges(edges: DataFrame, k: int | None = None, order=("dist", "dst")) -> DataFrame:
    """Give ranks 0.. per src, ordered by ``order``; keep the first k."""
    w = Window.partitionBy("src").orderBy(*order)
    out = edges.withColumn("rank", F.row_number().over(w) - 1)
    return out.where(F.col("rank") < k) if k is not None else out


def topk_join(queries: DataFrame, base: DataFrame, k: int, strategy: str = "block", exclude_self: bool = False) -> DataFrame:
    """k nearest rows of ``base`` per query: src, rank, dst, dist (fewer if base is smaller)."""
    if strategy == "hof":
        q = queries.select(F.col("id").alias("src"), F.col("vec").alias("a"))
        b = base.select(F.col("id").alias("dst"), F.col("vec").alias("b"))
        on = F.col("src") != F.col("dst") if exclude_self else F.lit(True)
        pairs = q.join(b, on).select("src", "dst", l2_squared("a", "b").alias("dist"))
        return rank_edges(pairs, k).select("src", "rank", "dst", "dist")
    if strategy != "block":
        raise ValueError(f"unknown strategy {strategy!r}")
    return rank_edges(_candidates(queries, base, k, exclude_self), k).select("src", "rank", "dst", "dist")


def exact_knn(vectors: DataFrame, k: int, strategy: str = "block") -> DataFrame:
    """k nearest other rows of every row."""
    return topk_join(vectors, vectors, k, strategy, exclude_self=True)


def _matrix(ids, vecs):
    ids = np.asarray(ids, dtype=np.int64)
    flat = np.asarray(vecs.combine_chunks().flatten() if isinstance(vecs, pa.ChunkedArray) else vecs.flatten(), dtype=np.float64)
    return ids, flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 1)


def _candidates(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """At least the k nearest of ``base`` per row of ``queries`` (id, vec): src, dst, dist."""
    rows = queries.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null")
    side = base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null")
    n = rows.count()
    if n <= BLOCK:
        table = rows.toArrow()  # of checked size
        sent = queries.sparkSession.sparkContext.broadcast(_matrix(table["id"], table["vec"]))
        return side.mapInArrow(_searcher(sent, k, exclude_self), _NEAR)
    a, b = -(-n // BLOCK), max(1, -(-side.count() // BLOCK))
    block = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    asks = rows.withColumn("c1", block(a)).select("c1", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("c2"), "id", "vec")
    has = side.withColumn("c2", block(b)).select(F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("c1"), "c2", "id", "vec")
    return cells(asks, has, k, exclude_self)


def cells(asks: DataFrame, has: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k nearest rows of ``has`` per row of ``asks`` within each cell; both (c1, c2, id, vec).

    One cell's ``has`` rows are held at a time, so the caller bounds them.
    """
    one = lambda df, side: df.select(F.col("c1").cast("long"), F.col("c2").cast("long"), F.lit(side).cast("long").alias("side"), F.col("id").cast("long"), F.col("vec").cast("array<double>"))
    dealt = one(has, 0).unionByName(one(asks, 1)).repartition("c1", "c2").sortWithinPartitions("c1", "c2", "side")
    return dealt.mapInArrow(_cells(k, exclude_self), _NEAR)


def _cells(k: int, exclude_self: bool):
    def run(batches):
        cell, held, base = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(3)], axis=1)
            ids, vecs = _matrix(batch.column(3), batch.column(4))
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1, [len(key)]))
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if cell != (key[a, 0], key[a, 1]):
                    cell, held, base = (key[a, 0], key[a, 1]), [], None
                if key[a, 2] == 0:
                    held.append((ids[a:b], vecs[a:b]))
                elif held:
                    base = base or tuple(map(np.concatenate, zip(*held)))
                    at, dst, dist = _nearest(ids[a:b], vecs[a:b], *base, k, exclude_self)
                    found.append((ids[a:b][at], dst, dist))
            if found:
                yield _near_batch(tuple(map(np.concatenate, zip(*found))))

    return run


def _near_batch(cols):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["src", "dst", "dist"])


def _nearest(qid, q, bid, base, k: int, exclude_self: bool):
    """(place in q, dst, dist): the k nearest rows of ``base`` per row of ``q``, ranked by (dist, id)."""
    qn, bn, out = (q * q).sum(axis=1), (base * base).sum(axis=1), []
    for i in range(0, len(qid), 1024):
        d = qn[i : i + 1024, None] + bn[None, :] - 2 * (q[i : i + 1024] @ base.T)
        if exclude_self:
            d[qid[i : i + 1024, None] == bid[None, :]] = np.inf
        take = min(len(bid), k + _SLACK)
        # Ties at the edge of the selection: widen to everything as near as its farthest.
        edge = np.partition(d, take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero((d <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None]) & np.isfinite(d))
        diff = q[i + row] - base[col]
        src, dst, dist = _cut((row, bid[col], (diff * diff).sum(axis=1)), k)
        out.append((i + src, dst, dist))
    return tuple(map(np.concatenate, zip(*out)))


def _searcher(sent, k: int, exclude_self: bool):
    def run(batches):
        qid, q = sent.value
        if not len(qid):
            return
        best = None
        for batch in batches:
            bid, base = _matrix(batch.column(0), batch.column(1))
            if len(bid):
                new = _nearest(qid, q, bid, base, k, exclude_self)  # by place: query rows may share ids
                best = _cut(new if best is None else tuple(map(np.concatenate, zip(best, new))), k)
        if best is not None:
            yield _near_batch((qid[best[0]], best[1], best[2]))

    return run


def _cut(best, k):
    src, dst, dist = best
    order = np.lexsort((dst, dist, src))
    src, dst, dist = src[order], dst[order], dist[order]
    keep = np.arange(len(src)) - np.searchsorted(src, src) < k
    return src[keep], dst[keep], dist[keep]


def pair_distances(pairs: DataFrame, left: DataFrame, right: DataFrame, missing: float | None = 0.0) -> DataFrame:
    """Distance of each pair (i, j); a pair with an unknown id gets ``missing``, or is dropped if that is None."""
    how = "inner" if missing is None else "left"
    a = left.select(F.col("id").alias("i"), F.col("vec").alias("a"))
    b = right.select(F.col("id").alias("j"), F.col("vec").alias("b"))
    d = l2_squared("a", "b")
    joined = pairs.join(a, "i", how).join(b, "j", how)
    return joined.select("i", "j", (d if missing is None else F.coalesce(d, F.lit(missing))).alias("dist"))


def vec_mat_distances(queries: DataFrame, base: DataFrame, block: int = 1024) -> DataFrame:
    """All distances of a stated query set to a base: src, dst, dist; the queries go out in blocks, the base is not shuffled."""
    rows, out = iter(queries.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").toLocalIterator()), None
    side = base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null")
    while part := list(islice(rows, block)):
        sent = base.sparkSession.sparkContext.broadcast((np.array([r.id for r in part], np.int64), np.array([r.vec for r in part], np.float64)))
        found = side.mapInArrow(_all_pairs(sent), _NEAR)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else base.sparkSession.createDataFrame([], _NEAR)


def _all_pairs(sent):
    def run(batches):
        qid, q = sent.value
        for batch in batches:
            bid, base = _matrix(batch.column(0), batch.column(1))
            for i in range(0, len(bid), 64):
                diff = q[:, None, :] - base[None, i : i + 64, :]
                n = len(bid[i : i + 64])
                yield _near_batch((np.repeat(qid, n), np.tile(bid[i : i + 64], len(qid)), (diff * diff).sum(axis=2).reshape(-1)))

    return run


def _pair_l2(a: pa.Array, b: pa.Array) -> pa.Array:
    """Squared distances of two list columns without nulls."""
    x, y = (np.asarray(c.flatten(), dtype=np.float64).reshape(len(c), -1) if len(c) else np.zeros((0, 1)) for c in (a, b))
    return pa.array(((x - y) ** 2).sum(axis=1))


def pair_l2(a: str, b: str):
    """The same as a column expression over Arrow batches."""
    return F.arrow_udf(_pair_l2, "double")(a, b)




def single_vec_distances(vector: list[float], base: DataFrame) -> DataFrame:
    """Distances of one literal vector to a base: dst, dist; a projection without a join."""
    lit = F.array(*map(F.lit, vector))
    return base.select(F.col("id").alias("dst"), l2_squared(lit, F.col("vec")).alias("dist"))


def assign_nearest(points: DataFrame, centroids: DataFrame, strategy: str = "block", k: int = 1) -> DataFrame:
    """Nearest centroid(s) of each point: id, bucket_id, dist (ties to the lower bucket).

    The centroids are the searched side and the points the scanned one, so points
    are never shuffled; centroids go out in blocks of bounded size.
    """
    c = centroids.select(F.col("bucket_id").cast("long").alias("id"), "vec")
    if strategy == "hof":
        near = topk_join(points, c, k, "hof")
    else:
        near = rank_edges(_scan_assign(points, c, k), k)
    out = near.select(F.col("src").alias("id"), F.col("dst").alias("bucket_id"), "dist", "rank")
    return out.drop("rank") if k == 1 else out


def _scan_assign(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    if centroids.limit(BLOCK + 1).count() > BLOCK:
        return _candidates(points, centroids, k, False)  # in cells
    rows = points.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null")
    table = centroids.toArrow()  # of checked size
    sent = points.sparkSession.sparkContext.broadcast(_matrix(table["id"], table["vec"]))

    def run(batches):
        cid, c = sent.value
        for batch in batches if len(cid) else ():
            pid, p = _matrix(batch.column(0), batch.column(1))
            if len(pid):
                at, dst, dist = _nearest(pid, p, cid, c, k, False)
                yield _near_batch((pid[at], dst, dist))

    return rows.mapInArrow(run, _NEAR)


def centroid_knn(centroids: DataFrame, k: int, strategy: str = "block") -> DataFrame:
    """bucket_id, rank, nb_bucket: the k nearest other centroids."""
    near = exact_knn(centroids.select(F.col("bucket_id").cast("long").alias("id"), "vec"), k, strategy)
    return near.select(F.col("src").alias("bucket_id"), "rank", F.col("dst").alias("nb_bucket"))


def visible_buckets(bucket_graph: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket_id, visible_bucket): each bucket sees itself and its neighbours."""
    own = buckets.select("bucket_id", F.col("bucket_id").alias("visible_bucket"))
    return bucket_graph.select("bucket_id", F.col("nb_bucket").alias("visible_bucket")).unionByName(own).distinct()


def bucketed_knn(vectors: DataFrame, assignment: DataFrame, visible: DataFrame, m: int, cell: int = 4096) -> DataFrame:
    """m nearest among the members of the visible buckets, self excluded: src, rank, dst, dist.

    A cell is a visible bucket and the rows that see it. Members of large buckets are
    cut into blocks of about ``cell`` rows, and the rows that see them as well, so a hot
    bucket is many cells. Only m rows per row and cell are shuffled again.
    """
    placed = vectors.select("id", "vec").join(assignment.select("id", "bucket_id"), "id")
    sizes = assignment.groupBy("bucket_id").agg(F.count("*").alias("n"))
    asked = visible.join(sizes, "bucket_id").groupBy(F.col("visible_bucket").alias("vb")).agg(F.ceil(F.sum("n") / (4 * cell)).cast("int").alias("na"))
    parts = sizes.select(F.col("bucket_id").alias("vb"), F.ceil(F.col("n") / cell).cast("int").alias("nh")).join(asked, "vb")
    at = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    has = placed.join(parts, F.col("bucket_id") == F.col("vb")).withColumn("h", at("nh", 1)).select("vb", "h", "nh", F.explode(upto("na")).alias("a"), "id", "vec")
    asks = placed.join(visible, "bucket_id").join(parts, F.col("visible_bucket") == F.col("vb")).withColumn("a", at("na", 2)).select("vb", F.explode(upto("nh")).alias("h"), "nh", "a", "id", "vec")
    keyed = lambda df: df.select(F.col("vb").alias("c1"), (F.col("a").cast("long") * F.col("nh") + F.col("h")).alias("c2"), "id", "vec")
    near = cells(keyed(asks), keyed(has), m, True)
    return rank_edges(near, m).select("src", "rank", "dst", "dist")


def candidate_union(assignment: DataFrame, visible: DataFrame) -> DataFrame:
    """(bucket_id, cand): deduplicated members of each bucket's visible buckets."""
    has = assignment.select(F.col("bucket_id").alias("visible_bucket"), F.col("id").alias("cand"))
    return visible.join(has, "visible_bucket").select("bucket_id", "cand").distinct()
