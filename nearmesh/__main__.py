"""Command-line tools: ``python -m nearmesh TOOL --flag value ...``.

Every tool reads files, calls the functions of this package and writes files; a graph
ending in .npy is a two-dimensional array, any other a graph file. Paths must be
visible to the driver and all executors. The session is the one that spark-submit
configures, or a local one.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmesh.operators import cluster, descent, edges, knn, layout, prune, search
from nearmesh.plans import pipeline
from nearmesh.session import local_session, materialise
from nearmesh.sources import files


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return files.read_npy(spark, path) if path.endswith(".npy") else files.read_graph(spark, path)


def write_graph(graph: DataFrame, path: str, k: int, n: int) -> None:
    """Rows of k neighbours for the nodes 0 .. n-1, padded with -1."""
    wide = edges.to_wide(graph, graph.sparkSession.range(n), k)
    if path.endswith(".npy"):
        files.write_npy(wide, path, k, n)
    else:
        files.write_graph(wide, path, k, n)


def with_distances(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src, rank, dst, dist); edges to ids without a vector are dropped."""
    return graph.join(descent.distances(graph.select("src", "dst").distinct(), vectors), ["src", "dst"]).select("src", "rank", "dst", "dist")


def _bucket_graph(spark: SparkSession, path: str) -> DataFrame:
    return read_graph(spark, path).select(F.col("src").alias("bucket_id"), "rank", F.col("dst").alias("nb_bucket"))


def _folder(path: str) -> str:
    """Made if it is a plain path; object stores need none."""
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    return path


def _numbers(df: DataFrame) -> dict:
    return df.first().asDict()


def build_bucket(spark: SparkSession, a) -> dict:
    """Buckets and the graph of the m nearest rows in the k nearest buckets, over ``t`` rounds."""
    v, n = files.read_vectors(spark, a.data), files.vector_header(a.data)[0]
    buckets = a.buckets or max(1, n // 32)
    rounds = []
    for i in range(a.t):
        placed, cents = cluster.build_buckets(v, buckets, a.seed + i, a.kmeans_iters, not a.no_balance, a.balance_slack)
        near = materialise(knn.centroid_knn(cents, a.k), "near")
        found = materialise(knn.bucketed_knn(v, placed, materialise(knn.visible_buckets(near, cents)), a.m))
        rounds.append(materialise(edges.reverse_augment(found, a.m), "round"))
        if i == 0:
            _folder(a.out_dir)
            files.write_bucket_files(placed, cents, f"{a.out_dir}/bucket_index.bin", f"{a.out_dir}/bucket_data.bin")
            write_graph(near.select(F.col("bucket_id").alias("src"), "rank", F.col("nb_bucket").alias("dst")), f"{a.out_dir}/centroid_knn.bin", a.k, buckets)
            stats = _numbers(cluster.bucket_stats(cluster.bucket_sizes(placed, cents), max(1, n // buckets)))
    write_graph(edges.merge_rounds(rounds, a.m), f"{a.out_dir}/knn.bin", a.m, n)
    return stats


def build_knn(spark: SparkSession, a) -> dict:
    """The exact graph of k neighbours."""
    n = files.vector_header(a.data)[0]
    write_graph(knn.exact_knn(files.read_vectors(spark, a.data), a.k), a.out, a.k, n)
    return {"nodes": n, "degree": a.k}


def build_descent(spark: SparkSession, a) -> dict:
    """NN-descent, then occlusion pruning if a degree is given."""
    n, v = files.vector_header(a.data)[0], files.read_vectors(spark, a.data)
    if a.normalize:
        from nearmesh.functions.vector import normalize

        v = materialise(v.select("id", normalize("vec").alias("vec")), "normalised")
    graph = descent.nn_descent(v, n, a.k, a.iters, a.seed)
    if a.prune_max_degree:
        graph = prune.occlusion_prune(graph, v, a.prune_max_degree)
    k = min(a.k, a.prune_max_degree or a.k)
    write_graph(graph, a.out, k, n)
    return {"nodes": n, "degree": k}


def prune_existing(spark: SparkSession, a) -> dict:
    """Occlusion pruning of a stored graph."""
    n, k = files.graph_shape(a.index_in)
    k = min(k, a.max_degree or k)
    v = files.read_vectors(spark, a.data)
    pruned = materialise(prune.occlusion_prune(with_distances(read_graph(spark, a.index_in), v), v, k), "pruned")
    write_graph(pruned, a.index_out, k, n)
    return _numbers(edges.degree_stats(pruned))


def search_index(spark: SparkSession, a) -> dict:
    """Recall of best-first search against a ground truth, with seconds and queries a second, per ef."""
    v, q, truth = files.read_vectors(spark, a.base), files.read_vectors(spark, a.query), files.read_ground_truth(spark, a.gt)
    if a.normalize:
        from nearmesh.functions.vector import normalize

        v, q = (materialise(x.select("id", normalize("vec").alias("vec")), "normalised") for x in (v, q))
    graph = materialise(read_graph(spark, a.index), "graph")
    rows = search.search_sweep(q, v, graph, truth.where(F.col("rank") < a.topk), a.ef, a.topk, a.repeats, a.num_entry, a.seed)
    return {"results": [r.asDict() for r in rows.orderBy("ef").collect()]}  # one row per ef


def compare(spark: SparkSession, a) -> dict:
    """Overlap of two graphs over their first k neighbours."""
    n, k = files.graph_shape(a.index1)
    if files.graph_shape(a.index2)[0] != n:
        raise ValueError("the graphs differ in their number of nodes")
    k = a.k_cmp if a.k_cmp > 0 else min(k, files.graph_shape(a.index2)[1])
    x, y, ids = read_graph(spark, a.index1), read_graph(spark, a.index2), spark.range(n)
    if a.save_csv:
        search.save_comparison(x, y, ids, k, a.save_csv)
    return _numbers(search.compare_graphs(x, y, ids, k))


def optimize(spark: SparkSession, a) -> dict:
    """Sort rows by distance (unless skipped), prune by detours, merge with reverse edges."""
    n = files.graph_shape(a.g)[0]
    graph = read_graph(spark, a.g)
    if a.skip_sort:
        graph = graph.withColumn("dist", F.col("rank").cast("double"))
    else:
        graph = edges.sort_rows(with_distances(edges.sanitize(graph.withColumn("dist", F.lit(0.0)), n).select("src", "rank", "dst"), files.read_vectors(spark, a.i)))
    kept = materialise(prune.detour_prune(materialise(graph, "sorted"), a.output_degree).select("src", "rank", "dst", "dist"), "pruned")
    merged = materialise(edges.protected_reverse_merge(kept, a.output_degree), "merged")
    write_graph(merged, a.o, a.output_degree, n)
    return _numbers(edges.degree_stats(merged))


def reorder(spark: SparkSession, a) -> dict:
    """Vectors and graph under ids that follow the processing order of the buckets, with the files that describe it."""
    n, k = files.graph_shape(a.k)
    placed = materialise(files.read_bucket_files(spark, a.x, a.d), "placed")
    near = _bucket_graph(spark, a.c)
    buckets = spark.range(files.graph_shape(a.c)[0]).select(F.col("id").alias("bucket_id"))
    order = materialise(layout.processing_order(near, buckets, a.order_window), "order")
    lay = materialise(layout.bucket_layout(placed, order), "layout")
    perm = materialise(layout.permutation(placed, lay), "perm")
    layout.check_permutation(perm)
    _folder(a.o)
    files.write_vectors(layout.reorder_vectors(files.read_vectors(spark, a.i), perm), f"{a.o}/vectors.fbin")
    write_graph(layout.remap_graph(read_graph(spark, a.k), perm), f"{a.o}/knn.bin", k, n)
    files.write_bucket_offsets(lay, f"{a.o}/bucket_offsets.bin")
    files.write_process_order(order, f"{a.o}/process_order.bin")
    files.write_permutation(perm, f"{a.o}/permutation.bin", n)
    return _numbers(layout.unassigned(read_graph(spark, a.k), perm))


def prune_windowed(spark: SparkSession, a) -> dict:
    """Prune a reordered graph by detours, where only neighbours in visible buckets count."""
    n = files.graph_shape(a.k)[0]
    order = files.read_process_order(spark, a.bucket_process_order).select(F.col("pos").cast("long").alias("pos"), "bucket_id")
    lay = files.read_bucket_offsets(spark, a.bucket_offsets).where("hi > lo").join(order, "pos")
    placed = materialise(lay.select("bucket_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("id")), "placed")
    visible = materialise(knn.visible_buckets(_bucket_graph(spark, a.c), order), "visible")
    graph = materialise(with_distances(read_graph(spark, a.k), files.read_vectors(spark, a.i)), "graph")
    pruned = materialise(prune.detour_prune(prune.windowed_rows(graph, placed, visible), a.output_degree), "pruned")
    write_graph(pruned, a.o, a.output_degree, n)
    return _numbers(prune.unverified_edges(pruned))


def translate_ids(spark: SparkSession, a) -> dict:
    """A reordered graph under its old ids."""
    n, k = files.graph_shape(a.g)
    write_graph(layout.translate_graph(read_graph(spark, a.g), files.read_permutation(spark, a.p)), a.o, k, n)
    return {"nodes": n, "degree": k}


def refine(spark: SparkSession, a) -> dict:
    """Two-hop candidates and reverse sources; the m nearest stay."""
    n, v = files.graph_shape(a.g)[0], files.read_vectors(spark, a.i)
    graph = materialise(with_distances(read_graph(spark, a.g), v), "graph")
    write_graph(descent.local_join_reverse(graph, v, a.m, a.sample, a.rev_cap), a.o, a.m, n)
    return {"nodes": n, "degree": a.m}


#: Tool: (function, flags with their defaults). A type is a required value, a list takes several, False a switch.
TOOLS = {
    "build-bucket": (build_bucket, {"data": str, "k": int, "m": int, "out-dir": str, "seed": 0, "buckets": 0, "kmeans-iters": 5, "no-balance": False, "balance-slack": 4, "t": 1}),
    "build-knn": (build_knn, {"data": str, "k": int, "out": str}),
    "build-descent": (build_descent, {"data": str, "k": int, "out": str, "iters": 8, "seed": 42, "normalize": False, "prune-max-degree": 0}),
    "prune-existing": (prune_existing, {"data": str, "index-in": str, "index-out": str, "max-degree": 0}),
    "search": (search_index, {"base": str, "query": str, "index": str, "gt": str, "topk": 10, "ef": [200], "num-entry": 4, "seed": 42, "repeats": 1, "normalize": False}),
    "compare": (compare, {"index1": str, "index2": str, "k-cmp": -1, "save-csv": ""}),
    "optimize": (optimize, {"i": "", "g": str, "o": str, "output-degree": 32, "skip-sort": False}),
    "reorder": (reorder, {"i": str, "x": str, "d": str, "k": str, "c": str, "order-window": 0, "o": str}),
    "prune-windowed": (prune_windowed, {"k": str, "i": str, "bucket-offsets": str, "bucket-process-order": str, "c": str, "o": str, "output-degree": 32}),
    "translate-ids": (translate_ids, {"g": str, "p": str, "o": str}),
    "refine": (refine, {"i": str, "g": str, "o": str, "m": 64, "sample": 16, "rev-cap": 32}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="nearmesh")
    tools = out.add_subparsers(dest="tool", required=True)
    for name, (run, flags) in TOOLS.items():
        tool = tools.add_parser(name, help=run.__doc__)
        for flag, default in flags.items():
            if isinstance(default, type):
                tool.add_argument(f"--{flag}", type=default, required=True)
            elif default is False:
                tool.add_argument(f"--{flag}", action="store_true")
            elif isinstance(default, list):
                tool.add_argument(f"--{flag}", type=type(default[0]), nargs="+", default=default)
            else:
                tool.add_argument(f"--{flag}", type=type(default), default=default)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run one tool; prints and returns its figures."""
    args = parser().parse_args(argv)
    if args.tool == "optimize" and not (args.i or args.skip_sort):
        raise ValueError("optimize sorts by distance: give --i, or --skip-sort")
    if spark is None:
        spark = SparkSession.builder.getOrCreate() if SparkConf().contains("spark.master") else local_session()
    figures = TOOLS[args.tool][0](spark, args)
    print(json.dumps(figures))
    return figures


if __name__ == "__main__":
    main()
