"""Operators on vectors and edges: against SQL, NumPy, properties and hand-checked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmesh.operators import cluster, descent, edges, knn, layout, prune, search
from nearmesh.plans import catalogue
from nearmesh.session import vectors
from nearmesh.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return vectors(spark, SF).where("id < 120").cache()


@pytest.fixture(scope="module")
def x(v):
    return np.array([r.vec for r in v.orderBy("id").collect()], dtype=float)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", ["exact_knn", "bucketed_knn", "reverse_merge", "detour_prune_windowed", "bucket_quality", "rebalance_step"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_block_strategy_equals_reference_form(v):
    a = knn.exact_knn(v, 5, "hof").orderBy("src", "rank").collect()
    b = knn.exact_knn(v, 5, "block").orderBy("src", "rank").collect()
    assert [(r.src, r.rank, r.dst) for r in a] == [(r.src, r.rank, r.dst) for r in b]


def test_query_blocks_do_not_change_results(v, monkeypatch):
    want = sorted(map(tuple, knn.exact_knn(v, 3).collect()))
    nearest = sorted(map(tuple, knn.assign_nearest(v.where("id < 9"), v.select(F.col("id").alias("bucket_id"), "vec")).collect()))
    bucketed = lambda: sorted(map(tuple, knn.bucketed_knn(v, asg, vis, 4, cell).select("src", "rank", "dst").collect()))
    cent, cell = cluster.sample_centroids(v, 4).cache(), 4096
    asg, vis = knn.assign_nearest(v, cent).select("id", "bucket_id").cache(), knn.visible_buckets(knn.centroid_knn(cent, 2), cent).cache()
    whole, cell = bucketed(), 5
    assert bucketed() == whole
    monkeypatch.setattr(knn, "BLOCK", 50)
    assert sorted(map(tuple, knn.exact_knn(v, 3).collect())) == want
    assert sorted(map(tuple, knn.assign_nearest(v.where("id < 9"), v.select(F.col("id").alias("bucket_id"), "vec")).collect())) == nearest


def test_few_rows_never_give_self(spark):
    two = table(spark, [(0, [0.0]), (1, [1.0])], "id long, vec array<float>")
    assert sorted((r.src, r.dst) for r in knn.exact_knn(two, 5).collect()) == [(0, 1), (1, 0)]


def test_occlusion_fold_against_numpy(v, x):
    graph = knn.exact_knn(v, 12).cache()
    want = []
    lists = {}
    for r in graph.orderBy("src", "rank").collect():
        lists.setdefault(r.src, []).append((r.dst, r.dist))
    for s, row in lists.items():
        kept = []
        for z, d in row:
            if all(((x[u] - x[z]) ** 2).sum() >= d for u in kept):
                kept.append(z)
        want += [(s, i, z) for i, z in enumerate(kept)]
    got = [(r.src, r.rank, r.dst) for r in prune.occlusion_prune(graph, v).collect()]
    assert sorted(got) == sorted(want)


def test_windowed_detours_are_at_most_the_full_ones(v):
    graph = knn.exact_knn(v, 8).cache()
    cent = cluster.sample_centroids(v, 6).cache()
    asg = knn.assign_nearest(v, cent).select("id", "bucket_id").cache()
    vis = knn.visible_buckets(knn.centroid_knn(cent, 2), cent)
    rows = prune.windowed_rows(graph, asg, vis)
    # The rank changes with the window, so compare with the full counts under the same ranks.
    full = {(r.src, r.dst): r.detour for r in prune.detour_counts(rows.withColumn("seen", F.lit(True))).collect()}
    part = {(r.src, r.dst): r.detour for r in prune.detour_counts(rows).collect()}
    assert all(part[e] <= full[e] for e in part)


def test_reverse_truncation_keeps_lowest_ranks(spark):
    fwd = [(100, r, d, 0.0) for r, d in enumerate([0, 1, 2, 3, 4, 5])]
    back = [(s, r, 100, 0.0) for s, r in [(10, 4), (11, 1), (12, 3), (13, 0), (14, 2)]]
    out = edges.protected_reverse_merge(table(spark, fwd + back, "src long, rank int, dst long, dist double"), 6)
    assert [r.dst for r in out.where("src = 100").orderBy("rank").collect()] == [0, 1, 2, 13, 11, 14]


def test_exact_against_itself_is_recall_one(v):
    p = knn.exact_knn(v, 5).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    r = search.recall(p, p, 5).first()
    assert (r.hit_first, r.hit_any, r.mean_overlap) == (1.0, 1.0, 1.0)


def test_best_first_finds_nearly_everything(v):
    found = search.ef_search(v.where("id % 10 = 0"), v, knn.exact_knn(v, 16), 5, 100)
    truth = knn.topk_join(v.where("id % 10 = 0"), v, 5).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    assert search.recall(found, truth, 5).first().mean_overlap >= 0.9


def test_nn_descent_reaches_recall(v):
    p = descent.nn_descent(v, 120, 8, 6).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    t = knn.exact_knn(v, 8).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    assert search.recall(p, t, 8).first().mean_overlap >= 0.9


def test_nn_descent_query_reaches_recall_on_the_whole_table(spark):
    p = _as_found(catalogue.QUERIES["nn_descent"](spark, SF))
    t = _as_found(knn.exact_knn(vectors(spark, SF), catalogue.K))
    got = search.recall(p, t, catalogue.K).first()
    assert got.queries == 500 and got.mean_overlap >= 0.9


def _as_found(edges):
    return edges.select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))


def test_converged_descent_on_few_rows_and_ties(spark):
    one = table(spark, [(0, [0.0])], "id long, vec array<float>")
    assert descent.converged_descent(one, 1, 3).count() == 0
    same = table(spark, [(i, [1.0]) for i in range(40)], "id long, vec array<float>")
    rows = descent.converged_descent(same, 40, 3).collect()
    assert len(rows) == 120 and all(r.dist == 0.0 and r.src != r.dst for r in rows)


def test_reorder_then_translate_is_identity(v):
    graph = knn.exact_knn(v, 4).cache()
    asg = v.select("id", (F.col("id") * 7 % 5).alias("bucket_id"))
    order = asg.select("bucket_id").distinct().select(F.col("bucket_id").cast("int").alias("pos"), "bucket_id")
    perm = layout.permutation(asg, layout.bucket_layout(asg, order)).cache()
    layout.check_permutation(perm)
    back = layout.translate_graph(layout.remap_graph(graph, perm), perm)
    assert sorted(map(tuple, back.select("src", "rank", "dst").collect())) == sorted(map(tuple, graph.select("src", "rank", "dst").collect()))


def test_greedy_order_by_scan():
    """The published rule: whatever has shared a neighbour with a placed bucket stays a candidate, also at score 0; the window is at least 1."""
    rng = np.random.default_rng(3)
    for n, deg, window in [(1, 4, 0), (12, 3, 1), (30, 4, 4), (30, 4, 64), (60, 2, 1), (200, 8, 16)]:
        adj = {b: sorted({int(y) for y in rng.integers(0, n, deg)} - {b}) if rng.random() > 0.1 else [] for b in range(n)}
        left, order, seen = set(range(n)), [], set()
        while left:
            recent = order[-max(1, window) :]
            known = left & seen
            if not order:
                pick = min(left, key=lambda b: (-len(adj[b]), b))
            elif known:
                pick = max(known, key=lambda b: (sum(len(set(adj[b]) & set(adj[r])) for r in recent), b))
            else:
                pick = min(left)
            order.append(pick)
            left.discard(pick)
            seen |= {b for b in left if set(adj[b]) & set(adj[pick])}
        assert layout.greedy_order(adj, list(range(n)), window) == order


def test_belady_against_a_scan_and_pinning():
    rng = np.random.default_rng(4)
    for n, cap in ((20, 30), (20, 1), (8, 1000), (40, 60)):
        adj = {b: sorted({int(y) for y in rng.integers(0, n, 3)} - {b}) for b in range(n)}
        order, sizes = rng.permutation(n).tolist(), {b: int(rng.integers(1, 9)) for b in range(n)}
        uses = [(pos, x) for pos, b in enumerate(order) for x in sorted({b, *adj[b]})]
        for pin in (False, True):
            held, hits, evicted = [], 0, 0
            for t, (pos, x) in enumerate(uses):
                if x in held:
                    hits += 1
                    continue
                here = {y for p, y in uses[:t] if p == pos} if pin else set()
                ahead = lambda y: (next((p for p, z in uses[t + 1 :] if z == y), 10**9), y)
                while sum(sizes[y] for y in held) + sizes[x] > cap and set(held) - here:
                    held.remove(max(set(held) - here, key=ahead))
                    evicted += 1
                held.append(x)
            assert layout.belady(order, adj, sizes, cap, pin) == {"hits": hits, "misses": len(uses) - hits, "evictions": evicted}


def test_rebalancing_rules(spark):
    # Bucket 0 has 7 rows, the limit is 4 + 1: its cheapest rows go to buckets below the limit only.
    asg = table(spark, [(i, 0) for i in range(7)] + [(i, 1) for i in range(7, 13)] + [(13, 2)], "id long, bucket_id long")
    two = [(i, 0, 1.0, 1 if i < 3 else 2, 1.0 + i) for i in range(7)] + [(i, 1, 1.0, 0, 2.0) for i in range(7, 13)] + [(13, 2, 1.0, 0, 2.0)]
    top = table(spark, two, "id long, b1 long, d1 double, b2 long, d2 double")
    got = {r.id: r.bucket_id for r in cluster.rebalance_step(asg, top, 4, 1).collect()}
    # Bucket 0 prefers 3, 4, 5 (to bucket 2); all second choices of bucket 1 are overloaded, so its 2 cheapest move all the same.
    assert got == {i: 2 if i in (3, 4, 5) else 0 for i in range(7)} | {i: 0 if i in (7, 8) else 1 for i in range(7, 13)} | {13: 2}
    same = cluster.rebalance_step(asg, top, 6, 1)
    assert {r.id: r.bucket_id for r in same.collect()} == {r.id: r.bucket_id for r in asg.collect()}
    live = {r.id: r.bucket_id for r in cluster.rebalance_live(asg, top, 4, 1, iterations=1).collect()}
    # Bucket 0 is down to 4 when bucket 1 has its turn, so its rows 7 and 8 may go there.
    assert live == got


def test_caps_and_parallel_seeding(spark, v):
    cent = cluster.sample_centroids(v, 6).cache()
    placed = {r.id: r.bucket_id for r in cluster.cap_buckets(v, cent, 1.2).collect()}
    counts = np.bincount(list(placed.values()), minlength=6)
    assert len(placed) == 120 and counts.sum() == 120 and np.sort(counts)[-2] <= 24
    seeds = cluster.kmeans_parallel(v, 9).collect()
    rows = {tuple(r.vec) for r in v.collect()}
    assert sorted(r.bucket_id for r in seeds) == list(range(9)) and len({tuple(r.vec) for r in seeds} & rows) == 9
    few = table(spark, [(i, [1.0]) for i in range(5)], "id long, vec array<float>")
    assert cluster.kmeans_parallel(few, 5).count() == 5
    with pytest.raises(ValueError):
        cluster.kmeans_pp(v, 10_000)
    numbers = cluster.numbered(v.repartition(7), "id").select("id", "number").collect()
    assert len(numbers) == 120 and all(r.id == r.number for r in numbers)


def test_large_ids_and_bad_ids(spark, tmp_path):
    p = str(tmp_path / "g.bin")
    wide = table(spark, [(0, [3_000_000_000, -1]), (1, [5, 4_294_967_294])], "id long, neighbours array<long>")
    files.write_graph(wide, p, 2, 2)
    assert sorted(map(tuple, files.read_graph(spark, p).collect())) == [(0, 0, 3_000_000_000), (1, 0, 5), (1, 1, 4_294_967_294)]
    perm = table(spark, [(0, 1), (1, 0)], "old_id long, new_id long")
    edge = lambda d: table(spark, [(0, 0, d, 1.0)], "src long, rank int, dst long, dist double")
    assert [tuple(r) for r in layout.translate_graph(edge(-1), perm).collect()] == [(1, 0, -1, 1.0)]
    with pytest.raises(Exception, match="outside the permutation"):
        layout.translate_graph(edge(2), perm).collect()
    with pytest.raises(ValueError):
        files.read_strict(spark, "x.i8bin")
    f = str(tmp_path / "x.fbin")
    files.write_vectors(table(spark, [(0, [1.0]), (1, [2.0])], "id long, vec array<float>"), f)
    with pytest.raises(ValueError):
        files.read_region(spark, f, 1, 2)
    with pytest.raises(Exception):
        files.read_sampled(spark, f, table(spark, [(7,)], "id long")).collect()
    with pytest.raises(ValueError):
        files.write_bucket_offsets(table(spark, [(0, 0, 3), (1, 4, 5)], "pos int, lo long, hi long"), str(tmp_path / "o.bin"))


def test_search_is_padded_swept_and_sharded(spark, v):
    graph, asked = knn.exact_knn(v, 12).cache(), v.where("id % 20 = 0")
    rows = search.ef_search(asked, v.where("id < 3"), graph.where("src < 3 and dst < 3"), 5, pad=True).collect()
    assert len(rows) == 30 and all((r.id == -1) == (r.dist == float("inf")) for r in rows)
    truth = knn.topk_join(asked, v, 5).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))
    sweep = search.search_sweep(asked, v, graph, truth, [8, 64], 5, repeats=1).collect()
    assert [r.ef for r in sweep] == [8, 64] and sweep[1].recall >= max(0.9, sweep[0].recall) and all(r.qps > 0 for r in sweep)
    halves = [(v.where(f"id % 2 = {i}"), knn.exact_knn(v.where(f"id % 2 = {i}"), 10)) for i in (0, 1)]
    assert search.recall(search.sharded_search(asked, halves, 5, 64), truth, 5).first().mean_overlap >= 0.9


def test_builds_reach_recall(v):
    from nearmesh.plans import pipeline

    truth = _as_found(knn.exact_knn(v, 6))
    assert search.recall(_as_found(pipeline.build_partitioned(v, 3, 6)), truth, 6).first().mean_overlap >= 0.6
    assert search.recall(_as_found(pipeline.build_multi_round(v, 6, 3, 6, rounds=2)), truth, 6).first().mean_overlap >= 0.8
    assert pipeline.build_descent_graph(v, 120, 10, 5, 3).groupBy("src").count().where("count > 5").isEmpty()


def test_lloyd_keeps_empty_centres(spark):
    v = table(spark, [(0, [0.0]), (1, [2.0])], "id long, vec array<float>")
    c = table(spark, [(0, [1.0]), (1, [100.0])], "bucket_id long, vec array<double>")
    _, moved = cluster.lloyd_step(v, c)
    assert {r.bucket_id: r.vec for r in moved.collect()} == {0: [1.0], 1: [100.0]}


def test_lloyd_step_query_returns_all_dimensions(spark):
    import duckdb

    every = vectors(spark, SF)
    asg = {r.id: r.bucket_id for r in catalogue.QUERIES["nearest_centroid"](spark, SF).collect()}
    cent = {r.bucket_id: np.array(r.vec, float) for r in cluster.sample_centroids(every, catalogue.BUCKETS).collect()}
    rows = {b: [] for b in cent}
    for r in every.collect():
        rows[asg[r.id]].append(r.vec)
    want = {(b, d): x for b in cent for d, x in enumerate(np.mean(np.array(rows[b], float), axis=0) if rows[b] else cent[b])}
    got = {(r.bucket_id, r.dim): r.x for r in catalogue.QUERIES["lloyd_step"](spark, SF).collect()}
    assert len(want) == catalogue.BUCKETS * 64 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    sql = con.execute(f"select bucket_id, dim, x from ({catalogue.ORACLES['lloyd_step']})").fetchall()
    assert len(sql) == len(got) and all(abs(got[b, d] - x) < 2e-6 for b, d, x in sql)


def test_vec_mat_query_answers_every_twentieth_id(spark):
    every = {r.id: np.array(r.vec, float) for r in vectors(spark, SF).collect()}
    got = {(r.src, r.dst): r.dist for r in catalogue.QUERIES["vec_mat_distances"](spark, SF).collect()}
    asked = [i for i in every if i % 20 == 0]
    assert len(got) == len(asked) * len(every) and {a for a, _ in got} == set(asked)
    assert all(abs(got[a, b] - ((every[a] - every[b]) ** 2).sum()) < 2e-6 for a in asked for b in every)


def test_ef_search_query_answers_every_twentieth_id(spark):
    got = {r.qid for r in catalogue.QUERIES["ef_search"](spark, SF).select("qid").distinct().collect()}
    assert got == {r.id for r in vectors(spark, SF).select("id").collect() if r.id % 20 == 0}


def test_ids_beyond_100000_are_in_range(spark, tmp_path):
    rows = [(999_980 + i, [float(i), float(i * i % 7)], 0) for i in range(40)]
    table(spark, rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    true = {(r.src, r.rank, r.dst) for r in knn.exact_knn(vectors(spark, str(tmp_path)), 8).collect() if r.rank not in (2, 3, 4)}
    assert {(r.src, r.rank, r.dst) for r in run("sanitize_drop")} == true
    fill = run("sanitize_fill")
    assert len(fill) == 320 and true <= {(r.src, r.rank, r.dst) for r in fill} and all(r.dst in range(999_980, 1_000_020) and r.dst != r.src for r in fill)
    assert run("graph_defects")[0].out_of_range == 80
    # A row's self edge is in range, so six of its eight neighbours stay.
    assert all(r.neighbours.count("-1") == 2 for r in run("wide_graph"))


@pytest.mark.parametrize("name", ["sanitize_drop", "sanitize_fill", "graph_defects", "degree_stats", "wide_graph"])
def test_damaged_graphs_against_sql(spark, name):
    test_against_sql(spark, name)


def test_rebalance_reaches_the_target(v):
    cent = cluster.sample_centroids(v, 6)
    top = cluster.top2(v, cent).cache()
    asg = top.select("id", F.col("b1").alias("bucket_id"))
    before = asg.groupBy("bucket_id").count().agg(F.max("count")).first()[0]
    after = cluster.rebalance(asg, top, 20, 2).groupBy("bucket_id").count().agg(F.max("count")).first()[0]
    assert after <= before


def test_files_round_trip(spark, v, tmp_path):
    p = str(tmp_path / "x.fbin")
    files.write_vectors(v, p)
    assert files.vector_header(p) == (120, 64)
    assert sorted(map(str, files.read_vectors(spark, p, rows_per_task=50).collect())) == sorted(map(str, v.collect()))
    assert [r.id for r in files.read_vectors(spark, p, 10, 5).orderBy("id").collect()] == [10, 11, 12, 13, 14]
    graph = knn.exact_knn(v, 4).where("src <> 3 or rank < 2").cache()
    wide, want = edges.to_wide(graph, v, 4), sorted(map(tuple, graph.select("src", "rank", "dst").collect()))
    files.write_graph(wide, str(tmp_path / "g.bin"), 4, 120)
    files.write_npy(wide, str(tmp_path / "g.npy"), 4, 120)
    assert sorted(map(tuple, files.read_graph(spark, str(tmp_path / "g.bin"), 50).collect())) == want
    assert sorted(map(tuple, files.read_npy(spark, str(tmp_path / "g.npy"), 50).collect())) == want
    assert np.load(tmp_path / "g.npy").shape == (120, 4)
    with pytest.raises(Exception):
        files.write_graph(wide.where("id <> 5"), str(tmp_path / "h.bin"), 4, 120)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
