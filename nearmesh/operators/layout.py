"""Bucket order, future accesses, cache simulation, permutations and translation."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacency(bucket_graph: DataFrame, n: int | None = None) -> DataFrame:
    """(bucket_id, nb_bucket) without self and, if n is given, ids out of range."""
    out = bucket_graph.where("nb_bucket <> bucket_id and nb_bucket >= 0")
    return (out if n is None else out.where(F.col("nb_bucket") < n)).select("bucket_id", "nb_bucket").distinct()


def greedy_order(adj: dict[int, list[int]], buckets: list[int], window: int) -> list[int]:
    """Greedy order: next is the unplaced bucket that shares most neighbours with the last ``window`` (at least 1) placed.

    Start: largest out-degree, ties to the smallest id. Candidates are all buckets that
    have ever shared a neighbour with a placed one, also at a score fallen to 0; ties
    go to the largest id. Without a candidate the smallest remaining id follows.
    """
    window = max(1, window)
    users = defaultdict(set)
    for b, nbs in adj.items():
        for x in nbs:
            users[x].add(b)
    left = set(buckets)
    smallest = sorted(left, reverse=True)
    score: dict[int, int] = defaultdict(int)
    heap: list[tuple[int, int]] = []

    def weigh(b: int, by: int) -> None:
        for x in set(adj.get(b, ())):
            for u in users[x]:
                if u in left:
                    score[u] += by
                    heapq.heappush(heap, (-score[u], -u))

    order: list[int] = []
    while left:
        pick = None
        if not order:
            pick = min(left, key=lambda b: (-len(adj.get(b, ())), b))
        elif len(order) > window:
            weigh(order[-window - 1], -1)
        while pick is None and heap:
            s, u = heapq.heappop(heap)
            if -u in left and score[-u] == -s:  # else placed or outdated
                pick = -u
        while pick is None:
            pick = smallest.pop()
            pick = pick if pick in left else None
        left.discard(pick)
        order.append(pick)
        weigh(pick, 1)
    return order


def processing_order(bucket_graph: DataFrame, buckets: DataFrame, window: int) -> DataFrame:
    """(pos, bucket_id). Sequential by nature: runs on the driver over the bucket graph (up to about a million buckets)."""
    adj: dict[int, list[int]] = defaultdict(list)
    for b, x in adjacency(bucket_graph).orderBy("bucket_id", "nb_bucket").toLocalIterator():
        adj[b].append(x)
    ids = sorted(r[0] for r in buckets.select("bucket_id").collect())
    rows = list(enumerate(greedy_order(adj, ids, window)))
    return buckets.sparkSession.createDataFrame(rows, "pos int, bucket_id long")


def future_access(order: DataFrame, bucket_graph: DataFrame) -> DataFrame:
    """(bucket_id, positions): sorted places where a bucket is used, by itself or by a neighbour."""
    uses = order.join(adjacency(bucket_graph), "bucket_id").select(F.col("nb_bucket").alias("bucket_id"), "pos")
    both = uses.unionByName(order.select("bucket_id", "pos"))
    return both.groupBy("bucket_id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def belady(order: list[int], adj: dict[int, list[int]], sizes: dict[int, int], capacity: int, pin: bool = False) -> dict[str, int]:
    """Hits, misses and evictions of an optimal offline cache; ties evict the higher id.

    A bucket larger than the capacity is loaded into an emptied cache. With ``pin``
    the buckets already used at the current place stay, if need be above the capacity.
    """
    future: dict[int, list[int]] = defaultdict(list)
    for pos, b in enumerate(order):
        for x in sorted({b, *adj.get(b, ())}):
            future[x].append(pos)
    held: dict[int, int] = {}  # the next use of each bucket in the cache
    heap: list[tuple[float, int]] = []
    used = hits = misses = evictions = 0
    at: dict[int, int] = defaultdict(int)
    for pos, b in enumerate(order):
        now: set[int] = set()
        for x in sorted({b, *adj.get(b, ())}):
            at[x] += 1
            if x in held:
                hits += 1
            else:
                misses += 1
                aside = []
                while heap and used + sizes[x] > capacity:
                    use, worst = heapq.heappop(heap)
                    if held.get(-worst) != -use:
                        continue  # outdated
                    if pin and -worst in now:
                        aside.append((use, worst))
                        continue
                    used -= sizes[-worst]
                    del held[-worst]
                    evictions += 1
                for entry in aside:
                    heapq.heappush(heap, entry)
                used += sizes[x]
            now.add(x)
            held[x] = future[x][at[x]] if at[x] < len(future[x]) else float("inf")
            heapq.heappush(heap, (-held[x], -x))
    return {"hits": hits, "misses": misses, "evictions": evictions}


def bucket_layout(assignment: DataFrame, order: DataFrame) -> DataFrame:
    """(pos, bucket_id, lo, hi): contiguous new ids per bucket in processing order. One row per bucket."""
    counts = assignment.groupBy("bucket_id").agg(F.count("*").alias("c"))
    rows = order.join(counts, "bucket_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    hi = F.sum("c").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))  # one row per bucket
    return rows.select("pos", "bucket_id", (hi - F.col("c")).alias("lo"), hi.alias("hi"))


def permutation(assignment: DataFrame, layout: DataFrame) -> DataFrame:
    """(old_id, new_id): a bucket's rows in id order from its lo on."""
    w = Window.partitionBy("bucket_id").orderBy("id")
    rows = assignment.withColumn("rn", F.row_number().over(w) - 1).join(layout.select("bucket_id", "lo"), "bucket_id")
    return rows.select(F.col("id").alias("old_id"), (F.col("lo") + F.col("rn")).alias("new_id"))


def check_permutation(perm: DataFrame) -> None:
    """Raise unless perm is a bijection of 0 .. N-1."""
    r = perm.agg(F.count("*").alias("n"), F.count_distinct("old_id").alias("a"), F.count_distinct("new_id").alias("b"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi")).first()
    if r.n and (r.a != r.n or r.b != r.n or r.lo != 0 or r.hi != r.n - 1):
        raise ValueError("not a permutation")


def reorder_vectors(vectors: DataFrame, perm: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, vec) under new ids, range-partitioned and sorted by them."""
    out = vectors.join(perm, vectors["id"] == perm["old_id"]).select(F.col("new_id").alias("id"), "vec")
    return (out.repartitionByRange(partitions, "id") if partitions else out.repartitionByRange("id")).sortWithinPartitions("id")


def remap_graph(edges: DataFrame, perm: DataFrame) -> DataFrame:
    """Edges under new ids; a neighbour without a new id becomes -1 (``unassigned`` counts them)."""
    a = perm.select(F.col("old_id").alias("src"), F.col("new_id").alias("ns"))
    b = perm.select(F.col("old_id").alias("dst"), F.col("new_id").alias("nd"))
    out = edges.join(a, "src").join(b, "dst", "left")
    return out.select(F.col("ns").alias("src"), "rank", F.coalesce("nd", F.lit(-1)).alias("dst"), *[c for c in edges.columns if c not in ("src", "rank", "dst")])


def unassigned(edges: DataFrame, perm: DataFrame) -> DataFrame:
    """One row: edges, those of sources without a new id, those of neighbours (0 and above) without one."""
    ids = perm.select(F.col("old_id").alias("id"), F.lit(True).alias("ok"))
    out = edges.join(ids.withColumnsRenamed({"id": "src", "ok": "s_ok"}), "src", "left").join(ids.withColumnsRenamed({"id": "dst", "ok": "d_ok"}), "dst", "left")
    return out.agg(F.count("*").alias("edges"), F.count_if(F.col("s_ok").isNull()).alias("sources"), F.count_if(F.col("d_ok").isNull() & (F.col("dst") >= 0)).alias("neighbours"))


def translate_graph(edges: DataFrame, perm: DataFrame) -> DataFrame:
    """Edges under the old ids; -1 stays, any other id outside the permutation is an error when the result is computed."""
    back = perm.select(F.col("new_id").alias("n"), F.col("old_id").alias("o"))
    a, b = back.withColumnsRenamed({"n": "src", "o": "os"}), back.withColumnsRenamed({"n": "dst", "o": "od"})
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    known = F.col("os").isNotNull() & (F.col("od").isNotNull() | (F.col("dst") == -1))
    out = out.where(F.assert_true(known, "an id is outside the permutation").isNull())
    return out.select(F.col("os").alias("src"), "rank", F.coalesce("od", F.lit(-1)).alias("dst"), *[c for c in edges.columns if c not in ("src", "rank", "dst")])
