"""End-to-end graph builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmesh.operators import cluster, descent, edges, knn, prune
from nearmesh.session import materialise


def build_round(vectors: DataFrame, n_buckets: int, near: int, m: int, seed: int = 0, iterations: int = 2, balance: bool = True) -> DataFrame:
    """One round: buckets, their neighbours, bucketed m-NN with reverse edges."""
    placed, cents = cluster.build_buckets(vectors, n_buckets, seed, iterations, balance)
    visible = knn.visible_buckets(knn.centroid_knn(cents, near), cents)
    return materialise(edges.reverse_augment(materialise(knn.bucketed_knn(vectors, placed, materialise(visible), m)), m), "round")


def build_multi_round(vectors: DataFrame, n_buckets: int, near: int, m: int, rounds: int = 1, seed: int = 0, iterations: int = 2) -> DataFrame:
    """Rounds with seeds seed, seed + 1, ..., merged."""
    return edges.merge_rounds([build_round(vectors, n_buckets, near, m, seed + i, iterations) for i in range(rounds)], m)


def build_graph(vectors: DataFrame, n_buckets: int, near: int, m: int, degree: int, rounds: int = 1, refine: int = 1, seed: int = 0) -> DataFrame:
    """Final graph (src, rank, dst): candidates of degree m, refined, pruned and merged with reverse edges."""
    graph = materialise(build_multi_round(vectors, n_buckets, near, m, rounds, seed), "graph")
    for _ in range(refine):
        graph = materialise(descent.two_hop_refine(graph, vectors, m, max(2, m // 2)), "graph")
    kept = materialise(prune.detour_prune(graph, degree).select("src", "rank", "dst", "dist"), "pruned")
    return edges.protected_reverse_merge(kept, degree)


def build_descent_graph(vectors: DataFrame, n: int, m: int, degree: int, iterations: int = 8) -> DataFrame:
    """The comparison path: NN-descent, stable sort, prune, reverse merge."""
    graph = edges.sort_rows(descent.nn_descent(vectors, n, m, iterations))
    return edges.protected_reverse_merge(materialise(prune.detour_prune(graph, degree).select("src", "rank", "dst", "dist")), degree)


def build_partitioned(vectors: DataFrame, parts: int, m: int, seed: int = 0) -> DataFrame:
    """(src, rank, dst, dist): every row joins its two nearest of ``parts`` partitions; exact neighbours within each, merged."""
    cents = cluster.kmeans_parallel(vectors, parts, seed)
    placed = materialise(knn.assign_nearest(vectors, cents, k=2).select("id", "bucket_id"), "placed")
    own = cents.select("bucket_id", F.col("bucket_id").alias("visible_bucket"))
    return edges.merge_rounds([materialise(knn.bucketed_knn(vectors, placed, own, 2 * m), "near")], m)
