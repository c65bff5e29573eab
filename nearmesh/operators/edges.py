"""Operators on edge tables (src, rank, dst, dist): union, dedup, reverse, merge, defects.

All are order-independent: a group-by on the edge and a ranking window per node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmesh.operators.knn import rank_edges

_COLS = ("src", "rank", "dst", "dist")


def merge_rounds(rounds: list[DataFrame], m: int) -> DataFrame:
    """Nearest m distinct neighbours over several rounds; missing ids and self are dropped."""
    all_ = reduce(DataFrame.unionByName, [r.select("src", "dst", "dist") for r in rounds]).where("dst >= 0 and src <> dst")
    return rank_edges(all_.groupBy("src", "dst").agg(F.min("dist").alias("dist")), m).select(*_COLS)


def reverse_augment(edges: DataFrame, m: int) -> DataFrame:
    """Add every edge reversed, keep the m nearest per node."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return merge_rounds([edges, back], m)


def reverse_topk(edges: DataFrame, k: int) -> DataFrame:
    """(node, pos, source, rank): the k strongest reverse edges of each node, by (rank, source)."""
    w = Window.partitionBy("dst").orderBy("rank", "src")
    out = edges.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < k)
    return out.select(F.col("dst").alias("node"), "pos", F.col("src").alias("source"), "rank")


def protected_reverse_merge(edges: DataFrame, k: int) -> DataFrame:
    """(src, rank, dst): the first k/2 forward edges, then reverse edges strongest first, then the old tail; distinct, k kept."""
    half = k // 2
    first = F.col("rank") < half
    forward = edges.where(F.col("rank") < k).select("src", "dst", F.when(first, 0).otherwise(2).alias("prio"), F.col("rank").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"))
    back = reverse_topk(edges.where(F.col("rank") < k), k).select(F.col("node").alias("src"), F.col("source").alias("dst"), F.lit(1).alias("prio"), F.col("rank").cast("long").alias("o1"), F.col("source").cast("long").alias("o2"))
    best = forward.unionByName(back).where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("prio", "o1", "o2")).alias("o"))
    return rank_edges(best, k, order=("o",)).select("src", "rank", "dst")


def sanitize(edges: DataFrame, n: int, fill: bool = False) -> DataFrame:
    """Drop self, missing and out-of-range neighbours; with ``fill`` replace them by the row's first valid one, else (src + 1) % n."""
    valid = (F.col("dst") >= 0) & (F.col("dst") < n) & (F.col("dst") != F.col("src"))
    if not fill:
        return edges.where(valid)
    w = Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(valid, F.col("dst")), ignorenulls=True).over(w)
    return edges.withColumn("dst", F.when(valid, F.col("dst")).otherwise(F.coalesce(first, (F.col("src") + 1) % n)))


def sort_rows(edges: DataFrame) -> DataFrame:
    """Ranks by (distance, old rank): a stable sort of each row."""
    w = Window.partitionBy("src").orderBy("dist", "rank")
    return edges.withColumn("new", F.row_number().over(w) - 1).select("src", F.col("new").alias("rank"), "dst", "dist")


def defects(edges: DataFrame, n: int) -> DataFrame:
    """One row: out_of_range, self_loops, duplicates."""
    per = edges.groupBy("src", "dst").agg(F.count("*").alias("c"))
    bad = (F.col("dst") < 0) | (F.col("dst") >= n)
    return per.agg(
        F.coalesce(F.sum(F.when(bad, F.col("c"))), F.lit(0)).alias("out_of_range"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("c"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"),
    )


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, min and max out-degree of nodes that have edges."""
    per = edges.where("dst >= 0").groupBy("src").agg(F.count("*").alias("c"))
    return per.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("c"), F.lit(0)).alias("edges"), F.min("c").alias("min_degree"), F.max("c").alias("max_degree"))


def chunk_ratio(edges: DataFrame, starts: list[int]) -> DataFrame:
    """One row: edges inside one chunk and across chunks; chunk c holds ids from starts[c] on (bounded list)."""
    chunk = lambda c: F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= c))
    same = chunk(F.col("src")) == chunk(F.col("dst"))
    return edges.agg(F.count_if(same).alias("in_chunk"), F.count_if(~same).alias("cross_chunk"))


def plan_chunks(offsets: list[int], rows_per_chunk: int) -> list[int]:
    """Starts of chunks that hold whole buckets; an error if one bucket exceeds a chunk."""
    starts, begin = [offsets[0]], offsets[0]
    for lo, hi in zip(offsets, offsets[1:]):
        if hi - lo > rows_per_chunk:
            raise ValueError("a bucket exceeds the chunk size")
        if hi - begin > rows_per_chunk:
            starts.append(lo)
            begin = lo
    return starts


def to_wide(edges: DataFrame, ids: DataFrame, k: int, fill: int = -1) -> DataFrame:
    """(id, neighbours): one array of k ids per node, padded; nodes without edges are all padding."""
    lists = edges.where(F.col("rank") < k).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("s"))
    out = ids.select("id").join(lists, F.col("id") == F.col("src"), "left")
    row = F.coalesce(F.transform("s", lambda e: e["dst"]), F.array().cast("array<bigint>"))
    pad = F.array_repeat(F.lit(fill).cast("long"), k)
    return out.select("id", F.slice(F.concat(row, pad), 1, k).alias("neighbours"))


def to_wide_distances(edges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, dists): one array of k distances per node, padded with infinity."""
    lists = edges.where(F.col("rank") < k).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dist"))).alias("s"))
    row = F.coalesce(F.transform("s", lambda e: e["dist"]), F.array().cast("array<double>"))
    pad = F.array_repeat(F.lit(float("inf")), k)
    return ids.select("id").join(lists, F.col("id") == F.col("src"), "left").select("id", F.slice(F.concat(row, pad), 1, k).alias("dists"))


def from_wide(wide: DataFrame) -> DataFrame:
    """(src, rank, dst) of (id, neighbours), padding dropped."""
    return wide.select(F.col("id").alias("src"), F.posexplode("neighbours").alias("rank", "dst")).where("dst >= 0")
