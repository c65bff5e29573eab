"""The command-line tools, chained over files and compared with the functions behind them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmesh.__main__ import main, read_graph
from nearmesh.operators import descent, knn, prune
from nearmesh.session import vectors
from nearmesh.sources import files


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """A folder with vectors, queries (ids divisible by 20) and their exact neighbours."""
    path = str(tmp_path_factory.mktemp("tools"))
    v = vectors(spark, "/root/testdata/sf0.001").where("id < 200").cache()
    files.write_vectors(v, f"{path}/base.fbin")
    q = v.where("id % 20 = 0").select((F.col("id") / 20).cast("long").alias("id"), "vec").cache()
    files.write_vectors(q, f"{path}/query.fbin")
    truth = knn.topk_join(q, v, 10).groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda e: e["dst"]).alias("vec"))
    files.write_vectors(truth, f"{path}/gt.ibin")
    main(["build-knn", "--data", f"{path}/base.fbin", "--k", "16", "--out", f"{path}/knn.bin"], spark)
    return path, v


def rows(graph):
    return sorted((int(r.src), int(r["rank"]), int(r.dst)) for r in graph.select("src", "rank", "dst").collect())


def test_exact_graph_search_and_compare(spark, place):
    path, v = place
    assert rows(read_graph(spark, f"{path}/knn.bin")) == rows(knn.exact_knn(v, 16))
    figures = main(["search", "--base", f"{path}/base.fbin", "--query", f"{path}/query.fbin", "--gt", f"{path}/gt.ibin", "--index", f"{path}/knn.bin", "--ef", "20", "200"], spark)
    assert [r["ef"] for r in figures["results"]] == [20, 200]
    assert figures["results"][1]["recall"] >= 0.9 and figures["results"][1]["qps"] > 0
    same = main(["compare", "--index1", f"{path}/knn.bin", "--index2", f"{path}/knn.bin"], spark)
    assert same["nodes"] == 200 and same["mean_overlap"] == same["set_equal"] == 1.0


def test_descent_and_pruning(spark, place):
    path, v = place
    main(["build-descent", "--data", f"{path}/base.fbin", "--k", "16", "--out", f"{path}/descent.npy"], spark)
    assert np.load(f"{path}/descent.npy").shape == (200, 16)
    near = main(["compare", "--index1", f"{path}/knn.bin", "--index2", f"{path}/descent.npy", "--k-cmp", "8"], spark)
    assert near["mean_overlap"] >= 0.8
    main(["prune-existing", "--data", f"{path}/base.fbin", "--index-in", f"{path}/knn.bin", "--index-out", f"{path}/pruned.npy", "--max-degree", "6"], spark)
    assert rows(read_graph(spark, f"{path}/pruned.npy")) == rows(prune.occlusion_prune(knn.exact_knn(v, 16), v, 6))


def test_refine_and_optimize(spark, place):
    path, v = place
    main(["refine", "--i", f"{path}/base.fbin", "--g", f"{path}/knn.bin", "--o", f"{path}/refined.bin", "--m", "16", "--sample", "4", "--rev-cap", "4"], spark)
    assert rows(read_graph(spark, f"{path}/refined.bin")) == rows(descent.local_join_reverse(knn.exact_knn(v, 16), v, 16, 4, 4))
    by_distance = main(["optimize", "--i", f"{path}/base.fbin", "--g", f"{path}/knn.bin", "--o", f"{path}/a.bin", "--output-degree", "8"], spark)
    main(["optimize", "--g", f"{path}/knn.bin", "--o", f"{path}/b.bin", "--output-degree", "8", "--skip-sort"], spark)
    assert rows(read_graph(spark, f"{path}/a.bin")) == rows(read_graph(spark, f"{path}/b.bin"))
    assert by_distance["nodes"] == 200 and by_distance["max_degree"] <= 8
    with pytest.raises(ValueError):
        main(["optimize", "--g", f"{path}/knn.bin", "--o", f"{path}/c.bin"], spark)


def test_buckets_reorder_prune_translate(spark, place):
    path, _ = place
    stats = main(["build-bucket", "--data", f"{path}/base.fbin", "--k", "3", "--m", "8", "--buckets", "8", "--kmeans-iters", "1", "--out-dir", f"{path}/b"], spark)
    assert stats["buckets"] == 8
    flags = ["--i", f"{path}/base.fbin", "--x", f"{path}/b/bucket_index.bin", "--d", f"{path}/b/bucket_data.bin", "--k", f"{path}/b/knn.bin", "--c", f"{path}/b/centroid_knn.bin"]
    assert main(["reorder", *flags, "--order-window", "4", "--o", f"{path}/r"], spark)["neighbours"] == 0
    main(["translate-ids", "--g", f"{path}/r/knn.bin", "--p", f"{path}/r/permutation.bin", "--o", f"{path}/back.bin"], spark)
    assert rows(read_graph(spark, f"{path}/back.bin")) == rows(read_graph(spark, f"{path}/b/knn.bin"))
    flags = ["--k", f"{path}/r/knn.bin", "--i", f"{path}/r/vectors.fbin", "--bucket-offsets", f"{path}/r/bucket_offsets.bin", "--bucket-process-order", f"{path}/r/process_order.bin"]
    kept = main(["prune-windowed", *flags, "--c", f"{path}/b/centroid_knn.bin", "--output-degree", "4", "--o", f"{path}/w.bin"], spark)
    assert kept["kept"] == len(rows(read_graph(spark, f"{path}/w.bin"))) and 0 <= kept["hit_rate"] <= 1
