"""One query per operator over the embeddings table, and its DuckDB SQL.

Fixed parameters: 16 centroids (smallest arithmetic hashes), degree 8, three
neighbour buckets. The SQL states each operator on its own, from all pairs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmesh.functions.vector import argmin, l2_squared_expanded, norm_squared, normalize, smallest
from nearmesh.operators import cluster, descent, edges, knn, layout, prune, search
from nearmesh.plans import pipeline
from nearmesh.session import materialise, step_dir, vectors
from nearmesh.sources import files

K, BUCKETS, NEAR, TARGET = 8, 16, 3, 32


def out(df: DataFrame) -> DataFrame:
    """Integers as long, doubles rounded to six decimals."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


class Steps:
    """The intermediate tables of a query, each made once."""

    def __init__(self, spark, sf_dir):
        self.v = vectors(spark, sf_dir)
        self.table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")

    def knn(self, k=K):
        return materialise(knn.exact_knn(self.v, k), "knn")

    def cent(self):
        return materialise(cluster.sample_centroids(self.v, BUCKETS), "cent")

    def asg(self, cent):
        return materialise(knn.assign_nearest(self.v, cent).select("id", "bucket_id"), "asg")

    def bucketed(self, m=K):
        cent = self.cent()
        asg = self.asg(cent)
        vis = materialise(knn.visible_buckets(knn.centroid_knn(cent, NEAR), cent), "vis")
        return materialise(knn.bucketed_knn(self.v, asg, vis, m), "bknn"), asg, vis, cent

    def sizes(self):
        cent = self.cent()
        return cluster.bucket_sizes(self.asg(cent), cent)

    def n(self):
        """Ids are below this: the largest one plus 1."""
        return (self.v.agg(F.max("id")).first()[0] or 0) + 1

    def damaged(self, n):
        return self.knn().withColumn("dst", F.when(F.col("rank") == 2, -1).when(F.col("rank") == 3, F.col("src")).when(F.col("rank") == 4, F.lit(n)).otherwise(F.col("dst")))

    def order(self, cent):
        return cent.select(F.col("bucket_id").cast("int").alias("pos"), "bucket_id")

    def perm(self):
        cent = self.cent()
        return materialise(layout.permutation(self.asg(cent), layout.bucket_layout(self.asg(cent), self.order(cent))), "perm")


def _pred(df):
    return df.select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))


def _topk_label(s):
    q, b = (s.table.where(c).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")) for c in ("label = 0", "label <> 0"))
    return knn.topk_join(q, b, 5)


def _pairs(s):
    p = s.v.select(F.col("id").alias("i"), ((F.col("id") * 7 + 3) % 3000).alias("j"))
    return knn.pair_distances(p, s.v, s.v)


def _normalize(s):
    n = s.v.select("id", normalize("vec").alias("n"))
    return n.select("id", F.posexplode("n").alias("dim", "x"))


def _quantize(s):
    q = cluster.quantize_vectors(s.v, cluster.train_quantizer(s.v), 8)
    return q.select("id", F.aggregate("codes", F.lit(0), lambda a, x: a + x).alias("code_sum"), "error")


def _lloyd_step(s):
    cent = s.cent()
    _, moved = cluster.lloyd_step(s.v, cent)
    return moved.select("bucket_id", F.posexplode("vec").alias("dim", "x"))


def _rebalance_step(s):
    cent = s.cent()
    return cluster.rebalance_step(s.asg(cent), materialise(cluster.top2(s.v, cent)), TARGET)


def _remapped(s):
    return layout.remap_graph(s.knn(), s.perm())


def _translated(s):
    perm = s.perm()
    return layout.translate_graph(materialise(layout.remap_graph(s.knn(), perm)), perm)


def _future(s):
    cent = s.cent()
    f = layout.future_access(s.order(cent), knn.centroid_knn(cent, NEAR))
    return f.select("bucket_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def _windowed(s):
    b, asg, vis, _ = s.bucketed(K)
    return prune.detour_prune(prune.windowed_rows(s.knn(), asg, vis), 4)


def _sanitized(s, fill=False):
    n = s.n()
    return edges.sanitize(s.damaged(n), n, fill).select("src", "rank", "dst")


def _defects(s):
    n = s.n()
    return edges.defects(s.damaged(n), n)


def _wide(s):
    n = s.n()
    wide = edges.to_wide(s.damaged(n).where(F.col("dst").between(0, n - 1)), s.v, K)
    return wide.select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


def _belady(s):
    cent = s.cent()
    graph = knn.centroid_knn(cent, NEAR)
    order = [r[0] for r in layout.processing_order(graph, cent, 4).orderBy("pos").select("bucket_id").collect()]
    adj: dict[int, list[int]] = {}
    for b, x in graph.select("bucket_id", "nb_bucket").collect():
        adj.setdefault(b, []).append(x)
    sizes = {r[0]: r[1] for r in cluster.bucket_sizes(s.asg(cent), cent).collect()}
    sim = layout.belady(order, adj, sizes, sum(sizes.values()) // 3)
    return cent.sparkSession.createDataFrame([tuple(sim.values())], "hits long, misses long, evictions long")


def _ef(s):
    q = s.v.where("id % 20 = 0")
    return search.ef_search(q, s.v, s.knn(16), 10, 64)


def _file(s, ext):
    return f"{step_dir(s.v.sparkSession)}/file-{uuid.uuid4().hex}.{ext}"


def _codes(s, kind):
    """Eight-bit vectors: 100 x, rounded down, from 128 on for the unsigned kind."""
    return s.v.select("id", F.transform("vec", lambda x: F.floor(x.cast("double") * 100 + (128 if kind == "u" else 0)).cast("long")).alias("vec"))


def _through_vector_file(s, ext, rows, read):
    path = _file(s, ext)
    files.write_vectors(rows, path)
    return read(s.v.sparkSession, path).select("id", F.posexplode("vec").alias("dim", "x"))


def _through_graph_file(s, start=0, count=None):
    graph, path = s.knn().where("src % 7 <> 0 or rank < 5"), _file(s, "bin")
    files.write_graph(edges.to_wide(graph, s.v, K), path, K, s.n())
    return files.read_graph(s.v.sparkSession, path, 100, start, count)


def _through_npy(s):
    graph, path = s.knn().where("src % 7 <> 0 or rank < 5"), _file(s, "npy")
    files.write_npy(edges.to_wide(graph, s.v, K).where("id % 5 <> 0"), path, K, s.n(), fill=-1)
    return files.read_npy(s.v.sparkSession, path, 100)


def _through_distances(s):
    graph, path = s.knn().where("src % 7 <> 0 or rank < 5"), _file(s, "npy")
    wide = edges.to_wide_distances(graph, s.v, K)
    files.write_npy(wide.where("id % 5 <> 0"), path, K, s.n(), "dists", "<f4", float("inf"))
    return files.read_npy_distances(s.v.sparkSession, path, 100).select("src", "rank", F.round(F.col("dist").cast("double"), 4).alias("dist"))


def _through_offsets(s):
    cent, path = s.cent(), _file(s, "bin")
    files.write_bucket_offsets(layout.bucket_layout(s.asg(cent), s.order(cent)), path)
    return files.read_bucket_offsets(s.v.sparkSession, path)


def _through_order(s):
    cent, path = s.cent(), _file(s, "bin")
    files.write_process_order(layout.processing_order(knn.centroid_knn(cent, NEAR), cent, 4), path)
    return files.read_process_order(s.v.sparkSession, path)


def _through_bucket_files(s):
    cent, a, b = s.cent(), _file(s, "bin"), _file(s, "bin")
    files.write_bucket_files(s.asg(cent), cent, a, b)
    return files.read_bucket_files(s.v.sparkSession, a, b)


def _through_permutation(s, inverse):
    path = _file(s, "bin")
    files.write_permutation(s.perm(), path, s.n(), inverse)
    return files.read_permutation(s.v.sparkSession, path, inverse, 200)


def _through_csv(s):
    path = _file(s, "csv")
    search.save_comparison(s.knn(), s.bucketed()[0], s.v, K, path)
    return s.v.sparkSession.read.option("header", True).schema("node long, intersect_size long, deg_a long, deg_b long, overlap double").csv(path)


def _sampled_rows(s):
    ids = s.v.where("id % 3 = 1").select("id")
    return _through_vector_file(s, "fbin", s.v, lambda spark, path: files.read_sampled(spark, path, ids, 100))


def _window_join(s):
    b, asg, vis, _ = s.bucketed(4)
    return descent.windowed_local_join(b, s.v, asg, vis, K, 3)


_RUN = {
    "file_fbin": lambda s: _through_vector_file(s, "fbin", s.v, lambda spark, path: files.read_vectors(spark, path, rows_per_task=100)),
    "file_u8bin": lambda s: _through_vector_file(s, "u8bin", _codes(s, "u"), lambda spark, path: files.read_strict(spark, path, 100)),
    "file_i8bin": lambda s: _through_vector_file(s, "i8bin", _codes(s, "i"), lambda spark, path: files.read_vectors(spark, path, rows_per_task=100)),
    "file_ibin": lambda s: _through_vector_file(s, "ibin", _codes(s, "i"), lambda spark, path: files.read_vectors(spark, path, rows_per_task=100, widen=False)),
    "file_ranges": lambda s: _through_vector_file(s, "fbin", s.v, lambda spark, path: files.read_region(spark, path, 17, 211, 50)),
    "file_sampled": _sampled_rows,
    "file_graph": _through_graph_file,
    "file_graph_rows": lambda s: _through_graph_file(s, 30, 100),
    "file_npy": _through_npy,
    "file_npy_distances": _through_distances,
    "file_bucket_offsets": _through_offsets,
    "file_process_order": _through_order,
    "file_buckets": _through_bucket_files,
    "file_permutation": lambda s: _through_permutation(s, False),
    "file_inverse_permutation": lambda s: _through_permutation(s, True),
    "file_comparison_csv": _through_csv,
    "reordered_vectors": lambda s: layout.reorder_vectors(s.v, s.perm()).select("id", F.posexplode("vec").alias("dim", "x")),
    "unassigned_edges": lambda s: layout.unassigned(s.knn(), s.perm().where("old_id % 10 <> 3")),
    "candidate_union": lambda s: knn.candidate_union(s.asg(s.cent()), knn.visible_buckets(knn.centroid_knn(s.cent(), NEAR), s.cent())),
    "single_vec_distances": lambda s: knn.single_vec_distances([float(x) for x in s.v.where("id = 7").first()["vec"]], s.v),
    "expanded_l2": lambda s: s.v.join(s.v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w")), "id").select("id", l2_squared_expanded("vec", "w").alias("dist")),
    "smallest_components": lambda s: s.v.select("id", F.posexplode(smallest("vec", 3)).alias("nth", "x"), argmin("vec").alias("place")),
    "windowed_local_join": _window_join,
    "exact_knn_in_cells": lambda s: knn.rank_edges(knn.cells(*(s.v.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias(a), (F.col("id") % 3).alias(b), "id", "vec") for a, b in (("c2", "c1"), ("c1", "c2"))), 10, True), 10).select("src", "rank", "dst", "dist"),
    "exact_knn": lambda s: knn.exact_knn(s.v, 10),
    "topk_label_join": _topk_label,
    "nearest_centroid": lambda s: knn.assign_nearest(s.v, s.cent()),
    "centroid_knn": lambda s: knn.centroid_knn(s.cent(), NEAR),
    "pair_distances": _pairs,
    "vec_mat_distances": lambda s: knn.vec_mat_distances(s.v.where("id % 20 = 0"), s.v),
    "norms": lambda s: s.v.select("id", norm_squared("vec").alias("norm2")),
    "normalize": _normalize,
    "quantize_roundtrip": _quantize,
    "sample_rows": lambda s: cluster.sample_rows(s.v, 50, 7).select("id"),
    "sample_fraction": lambda s: cluster.sample_fraction(s.v, 0.25, 7).select("id"),
    "bucket_sizes": lambda s: s.sizes(),
    "bucket_stats": lambda s: cluster.bucket_stats(s.sizes(), TARGET),
    "bucket_quality": lambda s: cluster.bucket_quantiles(s.sizes()),
    "bucket_histogram": lambda s: cluster.bucket_histogram(s.sizes(), 10),
    "bucketed_knn": lambda s: s.bucketed()[0],
    "bucketed_recall": lambda s: search.recall(_pred(s.bucketed()[0]), _pred(s.knn()), K),
    "reverse_augment": lambda s: edges.reverse_augment(s.knn(), K),
    "merge_rounds": lambda s: edges.merge_rounds([s.bucketed(4)[0], s.knn(4).where("rank >= 2")], 5),
    "reverse_topk": lambda s: edges.reverse_topk(s.knn(), K),
    "reverse_merge": lambda s: edges.protected_reverse_merge(s.knn(), K),
    "sanitize_drop": _sanitized,
    "sanitize_fill": lambda s: _sanitized(s, fill=True),
    "sort_rows": lambda s: edges.sort_rows(s.knn().withColumn("rank", 7 - F.col("rank"))),
    "graph_defects": _defects,
    "degree_stats": lambda s: edges.degree_stats(s.damaged(s.n())),
    "chunk_ratio": lambda s: edges.chunk_ratio(s.knn(), [0, 100, 250]),
    "wide_graph": _wide,
    "detour_counts": lambda s: prune.detour_counts(s.knn()).select("src", "rank", "dst", "detour"),
    "detour_prune": lambda s: prune.detour_prune(s.knn(), 4).select("src", "rank", "dst", "detour"),
    "detour_prune_windowed": lambda s: _windowed(s).select("src", "rank", "dst", "detour", "seen"),
    "unverified_edges": lambda s: prune.unverified_edges(_windowed(s)),
    "graph_compare": lambda s: search.compare_graphs(s.knn(), s.bucketed()[0], s.v, K),
    "graph_compare_nodes": lambda s: search.compare_nodes(s.knn(), s.bucketed()[0], s.v, K),
    "bucket_layout": lambda s: layout.bucket_layout(s.asg(s.cent()), s.order(s.cent())),
    "reorder_perm": lambda s: s.perm(),
    "knn_remap": lambda s: _remapped(s),
    "translate_ids": lambda s: _translated(s),
    "future_access": _future,
    "lloyd_step": _lloyd_step,
    "rebalance_step": _rebalance_step,
    "random_graph": lambda s: descent.random_graph(s.v, s.v.count(), 4, 3),
    "nn_descent_step": lambda s: descent.nn_descent_step(s.bucketed(4)[0], s.v, K, 4),
    "two_hop_refine": lambda s: descent.two_hop_refine(s.bucketed(4)[0], s.v, K, 3),
    "local_join_reverse": lambda s: descent.local_join_reverse(s.bucketed(4)[0], s.v, K, 3, 4),
    # Sequential or iterative: without SQL.
    "occlusion_prune": lambda s: prune.occlusion_prune(s.knn(), s.v),
    "processing_order": lambda s: layout.processing_order(knn.centroid_knn(s.cent(), NEAR), s.cent(), 4),
    "belady_sim": _belady,
    "kmeans_pp": lambda s: cluster.kmeans_pp(s.v, BUCKETS).select("bucket_id", F.posexplode("vec").alias("dim", "x")),
    "two_choice_assign": lambda s: cluster.two_choice_assign(cluster.top2(s.v, s.cent())),
    "lloyd": lambda s: cluster.lloyd(s.v, s.cent(), 3)[0],
    "nn_descent": lambda s: descent.converged_descent(s.v, s.v.count(), K),
    "ef_search": _ef,
    "build_graph": lambda s: pipeline.build_graph(s.v, BUCKETS, 4, 16, K),
}

QUERIES = {name: (lambda spark, sf_dir, f=f: out(f(Steps(spark, sf_dir)))) for name, f in _RUN.items()}

# --- SQL -----------------------------------------------------------------

_L2 = "list_sum(list_transform(list_zip({0}.vec, {1}.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_AB, _VC = _L2.format("a", "b"), _L2.format("v", "c")
_RANK = "row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1"

_CTE = {
    "v": "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "alld": f"SELECT a.id AS src, b.id AS dst, {_AB} AS dist FROM v a JOIN v b ON a.id <> b.id",
    "allr": f"SELECT *, {_RANK} AS rank FROM alld",
    "knn": f"SELECT src, rank, dst, dist FROM allr WHERE rank < {K}",
    "cent": f"SELECT row_number() OVER (ORDER BY h, id) - 1 AS bucket_id, vec FROM (SELECT id, vec, (id * 2654435761) % 4294967296 AS h FROM v ORDER BY h, id LIMIT {BUCKETS})",
    "near": f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, bucket_id) AS rn FROM (SELECT v.id, c.bucket_id, {_VC} AS dist FROM v CROSS JOIN cent c)",
    "asg": "SELECT id, bucket_id FROM near WHERE rn = 1",
    "cknn": f"SELECT bucket_id, rank, nb_bucket FROM (SELECT a.bucket_id, b.bucket_id AS nb_bucket, row_number() OVER (PARTITION BY a.bucket_id ORDER BY {_AB}, b.bucket_id) - 1 AS rank FROM cent a JOIN cent b ON a.bucket_id <> b.bucket_id) WHERE rank < {NEAR}",
    "vis": "SELECT bucket_id, nb_bucket AS visible_bucket FROM cknn UNION SELECT bucket_id, bucket_id FROM cent",
    "ball": f"SELECT d.src, d.dst, d.dist, {_RANK} AS rank FROM alld d JOIN asg x ON d.src = x.id JOIN asg y ON d.dst = y.id JOIN vis ON vis.bucket_id = x.bucket_id AND vis.visible_bucket = y.bucket_id",
    "bknn": f"SELECT src, rank, dst, dist FROM ball WHERE rank < {K}",
    "bknn4": "SELECT src, rank, dst, dist FROM ball WHERE rank < 4",
    "sizes": "SELECT cent.bucket_id, count(asg.id) AS n FROM cent LEFT JOIN asg ON cent.bucket_id = asg.bucket_id GROUP BY cent.bucket_id",
    "bad": "SELECT src, rank, CASE rank WHEN 2 THEN -1 WHEN 3 THEN src WHEN 4 THEN (SELECT max(id) + 1 FROM v) ELSE dst END AS dst, dist FROM knn",
    "det": "SELECT z.src, z.rank, z.dst, (SELECT count(*) FROM knn d JOIN knn e ON e.src = d.dst AND e.dst = z.dst WHERE d.src = z.src AND d.rank < z.rank) AS detour FROM knn z",
    "seen": "SELECT knn.src, knn.rank AS old, knn.dst, knn.dist, vis.bucket_id IS NOT NULL AS seen FROM knn JOIN asg x ON knn.src = x.id JOIN asg y ON knn.dst = y.id LEFT JOIN vis ON vis.bucket_id = x.bucket_id AND vis.visible_bucket = y.bucket_id",
    "win": "SELECT src, dst, seen, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN seen THEN dist ELSE 'inf'::DOUBLE END, old) - 1 AS k FROM seen",
    "wdet": "SELECT z.src, z.k, z.dst, z.seen, (SELECT count(*) FROM win d JOIN win e ON e.src = d.dst AND e.dst = z.dst WHERE d.src = z.src AND d.k < z.k AND d.seen) AS detour FROM win z",
    "wpr": "SELECT src, rank, dst, detour, seen FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY detour, k) - 1 AS rank FROM wdet) WHERE rank < 4",
    "lay": "SELECT bucket_id AS pos, bucket_id, CAST(sum(n) OVER (ORDER BY bucket_id) - n AS BIGINT) AS lo, CAST(sum(n) OVER (ORDER BY bucket_id) AS BIGINT) AS hi FROM sizes",
    "perm": "SELECT asg.id AS old_id, CAST(lo + row_number() OVER (PARTITION BY asg.bucket_id ORDER BY asg.id) - 1 AS BIGINT) AS new_id FROM asg JOIN lay ON asg.bucket_id = lay.bucket_id",
    "cmp": f"SELECT v.id AS node, count(*) FILTER (WHERE a.dst IS NOT NULL AND b.dst IS NOT NULL) AS intersect_size, count(DISTINCT a.dst) AS deg_a, (SELECT count(*) FROM bknn x WHERE x.src = v.id) AS deg_b FROM v LEFT JOIN knn a ON a.src = v.id LEFT JOIN bknn b ON b.src = v.id AND b.dst = a.dst GROUP BY v.id",
    "two": "SELECT a.src, b.dst FROM bknn4 a JOIN bknn4 b ON a.dst = b.src WHERE a.rank < 3 AND b.rank < 3",
    "hop": "SELECT a.src, b.dst FROM bknn4 a JOIN bknn4 b ON a.dst = b.src",
    "rev": "SELECT dst AS src, src AS dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src, rank) AS rn FROM bknn4) WHERE rn <= 4",
}


def _refined(cands: str) -> str:
    return f"SELECT src, rank, dst, round(dist, 6) AS dist FROM (SELECT src, dst, dist, {_RANK} AS rank FROM alld JOIN (SELECT src, dst FROM bknn4 UNION {cands}) USING (src, dst)) WHERE rank < {K}"


#: Of buckets above target + slack, rows by added distance; to open second buckets only, unless there is none.
_MOVES = f"SELECT id, b2 FROM (SELECT id, b2, n, row_number() OVER (PARTITION BY b1 ORDER BY cost, id) AS rn FROM (SELECT a.id, a.bucket_id AS b1, b.bucket_id AS b2, b.dist - a.dist AS cost, s.n, t.n <= {TARGET + 4} AS free, bool_or(t.n <= {TARGET + 4}) OVER (PARTITION BY a.bucket_id) AS any_free FROM near a JOIN near b ON a.id = b.id AND a.rn = 1 AND b.rn = 2 JOIN sizes s ON a.bucket_id = s.bucket_id JOIN sizes t ON b.bucket_id = t.bucket_id WHERE s.n > {TARGET + 4}) WHERE free OR NOT any_free) WHERE rn <= n - {TARGET}"
_DIMS = "SELECT id, d - 1 AS dim, CAST(vec[d] AS FLOAT) AS x FROM v, range(1, 65) t(d)"
_U = "((({0} + 1) * 2654435761 + 12345) * 69621 % 4294967296) / 4294967296.0"
_CTE |= {
    # co: one row, per bucket its count of shared neighbours with each bucket.
    "co": "SELECT list(shared ORDER BY a) AS m, any_value(first) AS first FROM (SELECT a, list(n ORDER BY b) AS shared, any_value(f) AS first FROM (SELECT x.bucket_id AS a, y.bucket_id AS b, (SELECT count(*) FROM cknn p JOIN cknn q ON p.nb_bucket = q.nb_bucket WHERE p.bucket_id = x.bucket_id AND q.bucket_id = y.bucket_id) AS n, (SELECT bucket_id FROM (SELECT bucket_id, count(*) AS c FROM cknn GROUP BY bucket_id) ORDER BY c DESC, bucket_id LIMIT 1) AS f FROM cent x, cent y) GROUP BY a)",
    "ord": f"WITH RECURSIVE o AS (SELECT 1 AS i, [first] AS placed FROM co UNION ALL SELECT i + 1, list_append(placed, CASE WHEN len(scored) > 0 THEN list_reverse_sort(scored)[1].u ELSE list_min(left_) END) FROM (SELECT i, placed, left_, list_transform(list_filter(left_, lambda u: list_max(list_transform(placed, lambda r: m[u + 1][r + 1])) > 0), lambda u: {{'s': list_sum(list_transform(placed[-4:], lambda r: m[u + 1][r + 1])), 'u': u}}) AS scored FROM (SELECT i, placed, m, list_filter(range(0, {BUCKETS}), lambda u: NOT list_contains(placed, u)) AS left_ FROM o, co WHERE i < {BUCKETS}))) SELECT p - 1 AS pos, placed[p] AS bucket_id FROM o, range(1, {BUCKETS + 1}) t(p) WHERE i = {BUCKETS}",
    "acc": "SELECT row_number() OVER (ORDER BY pos, x) AS t, pos, x FROM (SELECT pos, bucket_id AS x FROM ord UNION SELECT pos, nb_bucket FROM ord JOIN cknn USING (bucket_id))",
    # nus: per access the next use of every bucket.
    "nus": "SELECT t, x, (SELECT list(n ORDER BY bucket_id) FROM sizes) AS size, list(coalesce((SELECT min(pos) FROM acc z WHERE z.x = b.bucket_id AND z.t > acc.t), 1000000) ORDER BY b.bucket_id) AS nu FROM acc, cent b GROUP BY t, x",
    "sim": "WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS t, CAST([] AS BIGINT[]) AS held, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS misses, CAST(0 AS BIGINT) AS evictions UNION ALL SELECT t, CASE WHEN hit THEN held ELSE list_append(list_transform(far[go + 1 :], lambda e: e.y), x) END, hits + CASE WHEN hit THEN 1 ELSE 0 END, misses + CASE WHEN hit THEN 0 ELSE 1 END, evictions + CASE WHEN hit THEN 0 ELSE go END FROM (SELECT *, CAST(coalesce(list_filter(range(0, len(far) + 1), lambda k: coalesce(list_sum(list_transform(far[k + 1 :], lambda e: size[e.y + 1])), 0) + size[x + 1] <= cap)[1], len(far)) AS BIGINT) AS go FROM (SELECT nus.t, nus.x, size, held, hits, misses, evictions, list_contains(held, nus.x) AS hit, list_reverse_sort(list_transform(held, lambda y: {'f': nu[y + 1], 'y': y})) AS far, (SELECT CAST(sum(n) AS BIGINT) // 3 FROM sizes) AS cap FROM r JOIN nus ON nus.t = r.t + 1))) SELECT * FROM r",
    "pp": f"WITH RECURSIVE pool AS MATERIALIZED (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS spot, count(*) OVER () AS n FROM (SELECT id, vec, (id * 2654435761) % 4294967296 AS h FROM v ORDER BY h, id LIMIT {20 * BUCKETS})), r AS (SELECT CAST(1 AS BIGINT) AS i, [vec] AS vecs FROM pool WHERE spot = floor({_U.format('0')} * n) UNION ALL SELECT i + 1, list_append(vecs, vec) FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM (SELECT *, sum(near) OVER (ORDER BY id) AS cum, sum(near) OVER () AS total FROM (SELECT i, vecs, id, vec, list_min(list_transform(vecs, lambda c: list_sum(list_transform(list_zip(c, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS near FROM r, pool WHERE i < {BUCKETS})) WHERE cum > {_U.format('i')} * total) WHERE rn = 1) SELECT * FROM r",
    "top": "SELECT a.id, a.bucket_id AS b1, b.bucket_id AS b2, a.dist AS d1, b.dist AS d2, (a.id * 2654435761 + 40503) % 4294967296 % 16 AS batch FROM near a JOIN near b ON a.id = b.id AND a.rn = 1 AND b.rn = 2",
}


def _two_choice() -> str:
    """One statement per batch of rows; sizes are those of the batches before."""
    parts = ["t0 AS MATERIALIZED (SELECT id, b1 AS bucket_id FROM top WHERE batch = 0)"]
    for b in range(1, 16):
        parts.append(f"z{b} AS MATERIALIZED (SELECT bucket_id, count(*) AS n FROM t{b - 1} GROUP BY bucket_id)")
        parts.append(f"t{b} AS MATERIALIZED (SELECT * FROM t{b - 1} UNION ALL SELECT id, CASE WHEN coalesce(q.n, 0) < 0.8 * coalesce(p.n, 0) THEN b2 ELSE b1 END FROM top LEFT JOIN z{b} p ON p.bucket_id = b1 LEFT JOIN z{b} q ON q.bucket_id = b2 WHERE batch = {b})")
    return "SELECT * FROM (WITH " + ", ".join(parts) + " SELECT id, bucket_id FROM t15)"


def _lloyd(iterations: int) -> str:
    """One statement per assignment and one per update."""
    parts, c = [], "cent"
    for i in range(iterations):
        parts.append(f"l{i} AS MATERIALIZED (SELECT id, bucket_id FROM (SELECT v.id, c.bucket_id, row_number() OVER (PARTITION BY v.id ORDER BY {_VC}, c.bucket_id) AS rn FROM v CROSS JOIN {c} c) WHERE rn = 1)")
        parts.append(f"m{i} AS MATERIALIZED (SELECT bucket_id, list(x ORDER BY d) AS vec FROM (SELECT l.bucket_id, d, avg(vec[d]) AS x FROM v JOIN l{i} l ON v.id = l.id, range(1, 65) t(d) GROUP BY l.bucket_id, d) GROUP BY bucket_id)")
        parts.append(f"c{i} AS MATERIALIZED (SELECT c.bucket_id, coalesce(m.vec, c.vec) AS vec FROM {c} c LEFT JOIN m{i} m ON c.bucket_id = m.bucket_id)")
        c = f"c{i}"
    return "SELECT * FROM (WITH " + ", ".join(parts) + f" SELECT id, bucket_id FROM l{iterations - 1})"


def _descent(rounds: int) -> str:
    """Rounds of NN-descent with all pairs of each neighbourhood; a round that changes nothing repeats itself. The degree is that of the table's size."""
    deg = f"(SELECT least(greatest({2 * K}, 3 * CAST(ceil(log2(count(*))) AS BIGINT)), count(*) - 1) FROM v)"
    parts = [
        f"e0 AS MATERIALIZED (SELECT src, dst, dist, {_RANK} AS rank FROM alld JOIN (SELECT id AS src, (id + ((id * 2654435761 + 42 * 40503) % 4294967296 % (n - 1) + j * greatest(1, (n - 1) // {deg})) % (n - 1) + 1) % n AS dst FROM v, (SELECT count(*) AS n FROM v), range(0, 1000) t(j) WHERE j < {deg}) USING (src, dst))"
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED (SELECT src, dst FROM e{i} UNION SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src, rank) AS rn FROM e{i}) WHERE rn <= {deg})")
        parts.append(f"e{i + 1} AS MATERIALIZED (SELECT * FROM (SELECT src, dst, dist, {_RANK} AS rank FROM alld JOIN (SELECT src, dst FROM a{i} UNION SELECT x.dst, y.dst FROM a{i} x JOIN a{i} y ON x.src = y.src AND x.dst <> y.dst) USING (src, dst)) WHERE rank < {deg})")
    return "SELECT * FROM (WITH " + ", ".join(parts) + f" SELECT src, rank, dst, round(dist, 6) AS dist FROM e{rounds} WHERE rank < {K})"


_REV = "SELECT dst AS node, row_number() OVER (PARTITION BY dst ORDER BY rank, src) - 1 AS pos, src AS source, rank FROM knn"
_SQL = {
    "exact_knn": ("alld allr", "SELECT src, rank, dst, round(dist, 6) AS dist FROM allr WHERE rank < 10"),
    "topk_label_join": ("", f"SELECT src, rank, dst, round(dist, 6) AS dist FROM (SELECT *, {_RANK} AS rank FROM (SELECT a.id AS src, b.id AS dst, {_AB} AS dist FROM v a JOIN v b ON a.label = 0 AND b.label <> 0)) WHERE rank < 5"),
    "nearest_centroid": ("cent near", "SELECT id, bucket_id, round(dist, 6) AS dist FROM near WHERE rn = 1"),
    "centroid_knn": ("cent cknn", "SELECT * FROM cknn"),
    "pair_distances": ("", f"SELECT p.i, p.j, round(coalesce({_AB}, 0), 6) AS dist FROM (SELECT id AS i, (id * 7 + 3) % 3000 AS j FROM v) p LEFT JOIN v a ON a.id = p.i LEFT JOIN v b ON b.id = p.j"),
    "vec_mat_distances": ("", f"SELECT a.id AS src, b.id AS dst, round({_AB}, 6) AS dist FROM v a JOIN v b ON a.id % 20 = 0"),
    "norms": ("", "SELECT id, round(list_sum(list_transform(vec, lambda x: x * x)), 6) AS norm2 FROM v"),
    "normalize": ("", "SELECT id, d - 1 AS dim, round(n[d], 6) AS x FROM range(1, 65) t(d), (SELECT id, list_transform(vec, lambda x: x / l) AS n FROM (SELECT id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) + 1e-12 AS l FROM v))"),
    "quantize_roundtrip": ("", "SELECT id, CAST(sum(code) AS BIGINT) AS code_sum, round(sum((x - (code / 255.0 * s + lo)) * (x - (code / 255.0 * s + lo))), 6) AS error FROM (SELECT id, x, lo, s, floor(least(greatest(CASE WHEN s > 0 THEN (x - lo) / s ELSE 0 END, 0), 1) * 255 + 0.5) AS code FROM (SELECT id, d, vec[d] AS x, min(vec[d]) OVER (PARTITION BY d) AS lo, max(vec[d]) OVER (PARTITION BY d) - min(vec[d]) OVER (PARTITION BY d) AS s FROM v, range(1, 65) t(d))) GROUP BY id"),
    "sample_rows": ("", "SELECT id FROM v ORDER BY (id * 2654435761 + 7 * 40503) % 4294967296, id LIMIT 50"),
    "sample_fraction": ("", "SELECT id FROM v WHERE (id * 2654435761 + 7 * 40503) % 4294967296 < 1073741824"),
    "bucket_sizes": ("cent near asg sizes", "SELECT bucket_id, n FROM sizes"),
    "bucket_stats": ("cent near asg sizes", f"SELECT count(*) AS buckets, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size, count(*) FILTER (WHERE n = 0) AS empty, " + ", ".join(f"count(*) FILTER (WHERE abs(n - {TARGET}) <= {d}) AS within_{d}" for d in (4, 8, 16)) + " FROM sizes"),
    "bucket_quality": ("cent near asg sizes", "SELECT q, n FROM (SELECT n, row_number() OVER (ORDER BY n, bucket_id) - 1 AS place, count(*) OVER () AS b FROM sizes) JOIN (SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS DOUBLE) AS q) ON place = floor(b * q)"),
    "bucket_histogram": ("cent near asg sizes", "SELECT CAST(least(floor(n / 10.0), 7) AS BIGINT) AS bin, count(*) AS buckets FROM sizes GROUP BY 1"),
    "bucketed_knn": ("alld cent near asg cknn vis ball bknn", "SELECT src, rank, dst, round(dist, 6) AS dist FROM bknn"),
    "bucketed_recall": ("alld allr knn cent near asg cknn vis ball bknn", f"SELECT count(*) AS queries, round(avg(f), 6) AS hit_first, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_any, round(avg(n / {K}.0), 6) AS mean_overlap FROM (SELECT knn.src, max(CASE WHEN knn.rank = 0 AND b.dst IS NOT NULL THEN 1 ELSE 0 END) AS f, count(b.dst) AS n FROM knn LEFT JOIN bknn b ON knn.src = b.src AND knn.dst = b.dst GROUP BY knn.src)"),
    "reverse_augment": ("alld allr knn", f"SELECT src, rank, dst, round(dist, 6) AS dist FROM (SELECT *, {_RANK} AS rank FROM (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM knn UNION ALL SELECT dst, src, dist FROM knn) GROUP BY src, dst)) WHERE rank < {K}"),
    "merge_rounds": ("alld allr knn cent near asg cknn vis ball bknn4", f"SELECT src, rank, dst, round(dist, 6) AS dist FROM (SELECT *, {_RANK} AS rank FROM (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM bknn4 UNION ALL SELECT src, dst, dist FROM knn WHERE rank IN (2, 3)) GROUP BY src, dst)) WHERE rank < 5"),
    "reverse_topk": ("alld allr knn", f"SELECT * FROM ({_REV}) WHERE pos < {K}"),
    "reverse_merge": ("alld allr knn", f"SELECT src, rank, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY p, o1, o2) - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY p, o1, o2) AS rn FROM (SELECT src, dst, CASE WHEN rank < {K // 2} THEN 0 ELSE 2 END AS p, rank AS o1, 0 AS o2 FROM knn UNION ALL SELECT node, source, 1, rank, source FROM ({_REV}) WHERE pos < {K})) WHERE rn = 1) WHERE rank < {K}"),
    "sanitize_drop": ("alld allr knn bad", "SELECT src, rank, dst FROM bad WHERE dst >= 0 AND dst < (SELECT max(id) + 1 FROM v) AND dst <> src"),
    "sanitize_fill": ("alld allr knn bad", "SELECT src, rank, CASE WHEN ok THEN dst ELSE coalesce(first_value(CASE WHEN ok THEN dst END IGNORE NULLS) OVER (PARTITION BY src ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), (src + 1) % (SELECT max(id) + 1 FROM v)) END AS dst FROM (SELECT *, dst >= 0 AND dst < (SELECT max(id) + 1 FROM v) AND dst <> src AS ok FROM bad)"),
    "sort_rows": ("alld allr knn", "SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, 7 - rank) - 1 AS rank, dst, round(dist, 6) AS dist FROM knn"),
    "graph_defects": ("alld allr knn bad", "SELECT CAST(sum(CASE WHEN dst < 0 OR dst >= (SELECT max(id) + 1 FROM v) THEN c ELSE 0 END) AS BIGINT) AS out_of_range, CAST(sum(CASE WHEN src = dst THEN c ELSE 0 END) AS BIGINT) AS self_loops, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT src, dst, count(*) AS c FROM bad GROUP BY src, dst)"),
    "degree_stats": ("alld allr knn bad", "SELECT count(*) AS nodes, CAST(sum(c) AS BIGINT) AS edges, min(c) AS min_degree, max(c) AS max_degree FROM (SELECT src, count(*) AS c FROM bad WHERE dst >= 0 GROUP BY src)"),
    "chunk_ratio": ("alld allr knn", "SELECT count(*) FILTER (WHERE x = y) AS in_chunk, count(*) FILTER (WHERE x <> y) AS cross_chunk FROM (SELECT CASE WHEN src < 100 THEN 0 WHEN src < 250 THEN 1 ELSE 2 END AS x, CASE WHEN dst < 100 THEN 0 WHEN dst < 250 THEN 1 ELSE 2 END AS y FROM knn)"),
    "wide_graph": ("alld allr knn bad", f"SELECT src AS id, array_to_string((list(dst ORDER BY rank) || [-1, -1, -1, -1, -1, -1, -1, -1])[1:{K}], ',') AS neighbours FROM bad WHERE dst BETWEEN 0 AND (SELECT max(id) FROM v) GROUP BY src"),
    "detour_counts": ("alld allr knn det", "SELECT src, rank, dst, detour FROM det"),
    "detour_prune": ("alld allr knn det", "SELECT src, new AS rank, dst, detour FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY detour, rank) - 1 AS new FROM det) WHERE new < 4"),
    "detour_prune_windowed": ("alld allr knn cent near asg cknn vis seen win wdet wpr", "SELECT * FROM wpr"),
    "unverified_edges": ("alld allr knn cent near asg cknn vis seen win wdet wpr", "SELECT count(*) AS kept, count(*) FILTER (WHERE NOT seen) AS unverified, round(avg(CASE WHEN seen THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM wpr"),
    "graph_compare": ("alld allr knn cent near asg cknn vis ball bknn cmp", f"SELECT count(*) AS nodes, round(avg(intersect_size / {K}.0), 6) AS mean_overlap, round(avg(CASE WHEN intersect_size > 0 THEN 1.0 ELSE 0.0 END), 6) AS hits_any, round(avg(CASE WHEN intersect_size = {K} AND deg_a = {K} AND deg_b = {K} THEN 1.0 ELSE 0.0 END), 6) AS set_equal FROM cmp"),
    "graph_compare_nodes": ("alld allr knn cent near asg cknn vis ball bknn cmp", f"SELECT node, intersect_size, deg_a, deg_b, round(intersect_size / {K}.0, 6) AS overlap FROM cmp"),
    "bucket_layout": ("cent near asg sizes lay", "SELECT * FROM lay"),
    "reorder_perm": ("cent near asg sizes lay perm", "SELECT * FROM perm"),
    "knn_remap": ("alld allr knn cent near asg sizes lay perm", "SELECT a.new_id AS src, rank, b.new_id AS dst, round(dist, 6) AS dist FROM knn JOIN perm a ON src = a.old_id JOIN perm b ON dst = b.old_id"),
    "translate_ids": ("alld allr knn", "SELECT src, rank, dst, round(dist, 6) AS dist FROM knn"),
    "future_access": ("cent cknn", "SELECT bucket_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT nb_bucket AS bucket_id, bucket_id AS pos FROM cknn UNION SELECT bucket_id, bucket_id FROM cent) GROUP BY bucket_id"),
    "lloyd_step": ("cent near asg", "SELECT cent.bucket_id, CAST(d AS BIGINT) AS dim, round(coalesce((SELECT avg(v.vec[d + 1]) FROM v JOIN asg ON v.id = asg.id WHERE asg.bucket_id = cent.bucket_id), cent.vec[d + 1]), 6) AS x FROM cent, range(0, 64) t(d)"),
    "rebalance_step": ("cent near asg sizes", f"SELECT asg.id, coalesce(m.b2, asg.bucket_id) AS bucket_id FROM asg LEFT JOIN ({_MOVES}) m ON asg.id = m.id"),
    "random_graph": ("alld", f"SELECT src, {_RANK} AS rank, dst, round(dist, 6) AS dist FROM alld JOIN (SELECT id AS src, (id + ((id * 2654435761 + 3 * 40503) % 4294967296 % (n - 1) + j * greatest(1, (n - 1) // 4)) % (n - 1) + 1) % n AS dst FROM v, (SELECT count(*) AS n FROM v), range(0, 4) t(j)) USING (src, dst)"),
    "nn_descent_step": ("alld cent near asg cknn vis ball bknn4 hop", _refined("SELECT src, dst FROM hop WHERE src <> dst")),
    "two_hop_refine": ("alld cent near asg cknn vis ball bknn4 two", _refined("SELECT src, dst FROM two WHERE src <> dst")),
    "file_fbin": ("", f"{_DIMS}"),
    "file_u8bin": ("", "SELECT id, d - 1 AS dim, CAST(floor(vec[d] * 100 + 128) AS BIGINT) AS x FROM v, range(1, 65) t(d)"),
    "file_i8bin": ("", "SELECT id, d - 1 AS dim, floor(vec[d] * 100) AS x FROM v, range(1, 65) t(d)"),
    "file_ibin": ("", "SELECT id, d - 1 AS dim, CAST(floor(vec[d] * 100) AS BIGINT) AS x FROM v, range(1, 65) t(d)"),
    "file_ranges": ("", f"{_DIMS} WHERE id BETWEEN 17 AND 227"),
    "file_sampled": ("", f"{_DIMS} WHERE id % 3 = 1"),
    "file_graph": ("alld allr knn", "SELECT src, rank, dst FROM knn WHERE src % 7 <> 0 OR rank < 5"),
    "file_graph_rows": ("alld allr knn", "SELECT src, rank, dst FROM knn WHERE (src % 7 <> 0 OR rank < 5) AND src BETWEEN 30 AND 129"),
    "file_npy": ("alld allr knn", "SELECT src, rank, dst FROM knn WHERE (src % 7 <> 0 OR rank < 5) AND src % 5 <> 0"),
    "file_npy_distances": ("alld allr knn", "SELECT src, rank, round(CAST(CAST(dist AS FLOAT) AS DOUBLE), 4) AS dist FROM knn WHERE (src % 7 <> 0 OR rank < 5) AND src % 5 <> 0"),
    "file_bucket_offsets": ("cent near asg sizes lay", "SELECT pos, lo, hi FROM lay"),
    "file_process_order": ("cent cknn co ord", "SELECT pos, bucket_id FROM ord"),
    "file_buckets": ("cent near asg", "SELECT id, bucket_id FROM asg"),
    "file_permutation": ("cent near asg sizes lay perm", "SELECT * FROM perm"),
    "file_inverse_permutation": ("cent near asg sizes lay perm", "SELECT * FROM perm"),
    "file_comparison_csv": ("alld allr knn cent near asg cknn vis ball bknn cmp", f"SELECT node, intersect_size, deg_a, deg_b, round(intersect_size / {K}.0, 6) AS overlap FROM cmp"),
    "reordered_vectors": ("cent near asg sizes lay perm", "SELECT new_id AS id, d - 1 AS dim, CAST(vec[d] AS FLOAT) AS x FROM v JOIN perm ON id = old_id, range(1, 65) t(d)"),
    "unassigned_edges": ("alld allr knn", "SELECT count(*) AS edges, count(*) FILTER (WHERE src % 10 = 3) AS sources, count(*) FILTER (WHERE dst % 10 = 3) AS neighbours FROM knn"),
    "candidate_union": ("cent near asg cknn vis", "SELECT DISTINCT vis.bucket_id, asg.id AS cand FROM vis JOIN asg ON asg.bucket_id = vis.visible_bucket"),
    "single_vec_distances": ("", f"SELECT b.id AS dst, round({_AB}, 6) AS dist FROM v a JOIN v b ON a.id = 7"),
    "expanded_l2": ("", f"SELECT a.id, round({_AB}, 6) AS dist FROM v a JOIN v b ON b.id = a.id + 1"),
    "smallest_components": ("", "SELECT id, nth - 1 AS nth, CAST(list_sort(vec)[nth] AS FLOAT) AS x, list_position(vec, list_min(vec)) - 1 AS place FROM v, range(1, 4) t(nth)"),
    "windowed_local_join": ("alld cent near asg cknn vis ball bknn4 two", _refined("SELECT src, dst FROM two JOIN asg x ON x.id = src JOIN asg y ON y.id = dst JOIN vis ON vis.bucket_id = x.bucket_id AND vis.visible_bucket = y.bucket_id WHERE src <> dst")),
    "exact_knn_in_cells": ("alld allr", "SELECT src, rank, dst, round(dist, 6) AS dist FROM allr WHERE rank < 10"),
    "occlusion_prune": ("alld allr knn", f"SELECT src, place - 1 AS rank, e.dst AS dst, round(e.dist, 6) AS dist FROM (SELECT src, unnest(kept) AS e, generate_subscripts(kept, 1) AS place FROM (SELECT src, list_reduce(list({{'dst': dst, 'dist': dist, 'vec': vec}} ORDER BY dist, dst), lambda keep, z: CASE WHEN len(list_filter(keep, lambda u: {_L2.format('u', 'z')} < z.dist)) > 0 THEN keep ELSE list_append(keep, z) END, CAST([] AS STRUCT(dst BIGINT, dist DOUBLE, vec DOUBLE[])[])) AS kept FROM knn JOIN v ON v.id = dst GROUP BY src))"),
    "processing_order": ("cent cknn co ord", "SELECT pos, bucket_id FROM ord"),
    "belady_sim": ("cent near asg sizes cknn co ord acc nus sim", "SELECT hits, misses, evictions FROM sim ORDER BY t DESC LIMIT 1"),
    "kmeans_pp": ("pp", f"SELECT CAST(b - 1 AS BIGINT) AS bucket_id, d - 1 AS dim, round(vecs[b][d], 6) AS x FROM (SELECT vecs FROM pp WHERE i = {BUCKETS}), range(1, {BUCKETS + 1}) t(b), range(1, 65) u(d)"),
    "two_choice_assign": ("cent near top", _two_choice()),
    "lloyd": ("cent", _lloyd(3)),
    "nn_descent": ("alld", _descent(12)),
    "local_join_reverse": ("alld cent near asg cknn vis ball bknn4 two rev", _refined("SELECT src, dst FROM two WHERE src <> dst UNION SELECT src, dst FROM rev")),
}


def _sql(names: str, final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n]})" for n in ["v", *names.split()]) + "\n" + final


ORACLES = {name: _sql(*parts) for name, parts in _SQL.items()}
