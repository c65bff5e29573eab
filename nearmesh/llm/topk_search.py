"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Every vector becomes a sparse integer vector, floor(scale * x) per component; a
component is a term and its integer the weight. The queries are processed in
blocks of at most ``queries_per_block`` rows, one after the other: a block is read,
broadcast, answered into a table and dropped before the next. Each task walks its
candidates in blocks, builds a postings list per term, and for each term adds the products
of query weights and postings to a dense (query x candidate) score array: short lists are
scattered, long ones are added to one tile of the array after the other, so that a tile
stays in a core's cache while all its terms are added.
Partition selection (with all ties of the k-th score, cut by id) leaves k rows per query
and block, and only scores that reach the k-th best of the task so far are partitioned;
the k rows per query and task are merged by a ranking window.

Scale: candidates are never shuffled, only k rows per query and task are. Memory
in a task is a few arrays of STEP * candidates_per_block scores and 3 k rows per query of a block.
The number of passes over the candidates grows with the query set, what the driver
and a task hold does not.

Scores are exact: rows whose products could leave the long range are scored with
Python integers, the others with longs. A selected score outside the long range is
an error (also one that only a task selects, from few candidates).

Defined cases: a vector that is null or holds a null or a non-finite component
takes no part; missing terms of shorter vectors weigh 0; rows that share the query's id
are its own and never returned; repeated query rows are answered each; repeated
candidate rows count each; null ids take no part; ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmesh.llm.common import write_table

#: Queries that are scored at once.
STEP = 2048
#: Scores that stay in a core's cache while all terms are added to them.
TILE = 1 << 16
#: A term with fewer than one in so many products that can differ from 0 is scattered along its postings.
SCATTER = 16
#: Selections of a task that wait to be merged, at most.
WAITING = 64
_OUT = "qn long, query_id long, vec_id long, score long"
#: Below every score of finite doubles.
_LOWEST = -(1 << 4000)


def _weights(ids: pa.Array, vectors: pa.ChunkedArray | pa.Array, scale: int):
    """(ids, dense integer rows) of the usable vectors, rows padded with 0; Python integers where a weight leaves the long range."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = len(vectors)
    values = vectors.flatten()
    lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0), dtype=np.int64)
    x = np.asarray(values.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        w = np.floor(scale * x)
        wide = ~(np.abs(w) < 2.0**62)
    bad = ~np.isfinite(x)
    owner = np.repeat(np.arange(n), lens)
    good = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    good[owner[bad]] = False
    dim = int(lens[good].max()) if good.any() else 0
    wide &= good[owner]
    dense = np.zeros((n, dim), dtype=object if wide.any() else np.int64)
    col = np.arange(len(x)) - np.repeat(np.cumsum(lens) - lens, lens)
    use = good[owner] & ~wide
    dense[owner[use], col[use]] = w[use].astype(np.int64)
    for i in np.flatnonzero(wide):
        dense[owner[i], col[i]] = int(x[i]) * scale  # so large a double is an integer
    return np.asarray(ids.fill_null(0), dtype=np.int64)[good], dense[good]


def _scores(queries: np.ndarray, cands: np.ndarray) -> np.ndarray:
    """Scores (query x candidate): longs, or Python integers if a sum of products could leave the long range."""
    terms = min(queries.shape[1], cands.shape[1])
    limit = int((2.0**62 / max(1, terms)) ** 0.5)
    q, c = ((np.abs(m) > limit).any(axis=1) if m.size else np.zeros(len(m), dtype=bool) for m in (queries, cands))
    if not q.any() and not c.any():
        return _accumulate(queries.astype(np.int64, copy=False), cands.astype(np.int64, copy=False))
    acc = np.zeros((len(queries), len(cands)), dtype=object)
    acc[np.ix_(~q, ~c)] = _accumulate(queries[~q].astype(np.int64), cands[~c].astype(np.int64)).astype(object)
    queries, cands = queries[:, :terms].astype(object), cands[:, :terms].astype(object)
    acc[q] = queries[q] @ cands.T
    acc[:, c] = queries @ cands[c].T
    return acc


def _accumulate(queries: np.ndarray, cands: np.ndarray) -> np.ndarray:
    """Scores (query x candidate) of longs, one term after the other; 32-bit integers where no sum can leave their range."""
    terms = min(queries.shape[1], cands.shape[1])
    most = terms * int(np.abs(queries).max(initial=0)) * int(np.abs(cands).max(initial=0))
    kind = np.int32 if most < 1 << 31 else np.int64
    asks, posts = (np.ascontiguousarray(m[:, :terms].T, dtype=kind) for m in (queries, cands))
    acc = np.zeros((len(queries), len(cands)), dtype=kind)
    long = []
    for term in range(terms):
        posting = np.flatnonzero(posts[term])
        asking = np.flatnonzero(asks[term])
        if SCATTER * len(posting) * len(asking) >= acc.size:
            long.append(term)
        elif len(posting) and len(asking):
            acc[np.ix_(asking, posting)] += asks[term, asking, None] * posts[term, posting]
    rows = max(1, TILE // max(1, len(cands)))
    space = np.empty((min(rows, len(queries)), len(cands)), dtype=kind)
    buffer = np.setbufsize(64)  # else numpy copies operands of rows shorter than its buffer
    try:
        for i in range(0, len(queries), rows):
            tile = acc[i : i + rows]
            products = space[: len(tile)]
            for term in long:  # weights of 0 add nothing
                np.multiply(asks[term, i : i + rows, None], posts[term], out=products)
                tile += products
    finally:
        np.setbufsize(buffer)
    return acc


def _select(qn, qid, acc, cid, k, floor):
    """k best of each row among the scores that reach its floor; of equal ones those of smaller ids. qid and cid are sorted."""
    lowest = _LOWEST if acc.dtype == object else np.iinfo(acc.dtype).min
    begin, end = (np.searchsorted(qid, cid, side) for side in ("left", "right"))
    for j in np.flatnonzero(begin < end):
        acc[begin[j] : end[j], j] = lowest  # the query's own rows
    if acc.dtype == object:
        least = np.full(len(acc), lowest + 1, dtype=object)
    else:
        least = np.clip(floor, lowest + 1, np.iinfo(acc.dtype).max).astype(acc.dtype)
    reach = acc >= least[:, None]
    crowded = np.flatnonzero(np.count_nonzero(reach, axis=1) > k)
    if len(crowded):
        some = acc[crowded]
        least[crowded] = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
        reach[crowded] = some >= least[crowded, None]
    at = np.flatnonzero(reach)
    row, col = np.divmod(at, max(1, acc.shape[1]))
    score = acc[row, col]
    above = score > least[row]
    room = k - np.bincount(row[above], minlength=len(acc))
    ties = np.flatnonzero(~above)
    of = row[ties]
    ties = ties[np.arange(len(of)) - np.searchsorted(of, of) < room[of]]
    keep = np.concatenate((np.flatnonzero(above), ties))
    row, col, score = row[keep], col[keep], score[keep]
    return qn[row], qid[row], cid[col], score if score.dtype == object else score.astype(np.int64)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    queries_per_block: int = 16_384,
    candidates_per_block: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows of ``vectors``."""
    spark = vectors.sparkSession
    cands = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    w = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id")

    def answered(ids: pa.Array, vectors: pa.Array | pa.ChunkedArray):
        qid, dense = _weights(ids, vectors, scale)
        order = np.argsort(qid, kind="stable")
        sent = spark.sparkContext.broadcast((qid[order], dense[order]))
        found = cands.mapInArrow(_searcher(sent, k, scale, candidates_per_block), _OUT)
        return sent, found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if asked.limit(queries_per_block + 1).count() <= queries_per_block:
        table = asked.toArrow()
        return answered(table["id"].combine_chunks(), table["v"])[1]
    rows, parts = write_table(asked, "queries").toLocalIterator(), []
    while block := list(islice(rows, queries_per_block)):
        sent, found = answered(pa.array([r.id for r in block], pa.int64()), pa.array([r.v for r in block], pa.list_(pa.float64())))
        parts.append(write_table(found, "found"))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def _searcher(sent, k, scale, c_step):
    def run(batches):
        qid, dense = sent.value
        qn = np.arange(len(qid))
        steps = [slice(i, i + STEP) for i in range(0, len(qid), STEP)]
        kept: list[list[tuple]] = [[] for _ in steps]
        floors = [np.full(len(qid[step]), np.iinfo(np.int64).min) for step in steps]
        for batch in batches:
            cid, cd = _weights(batch.column(0), batch.column(1), scale)
            order = np.argsort(cid, kind="stable")
            cid, cd = cid[order], cd[order]
            for step, best, floor in zip(steps, kept, floors):
                for j in range(0, len(cid), c_step):
                    acc = _scores(dense[step], cd[j : j + c_step])
                    best.append(_select(qn[step], qid[step], acc, cid[j : j + c_step], k, floor))
                    if len(best) == 1 or len(best) > WAITING or sum(len(part[0]) for part in best[1:]) >= k * len(floor):
                        best[:] = [_best(best, k)]
                        _raise(floor, qn[step], best[0], k)
        for best in kept:
            if best:
                cols = _best(best, k)
                if cols[3].dtype == object and len(cols[3]) and not -(1 << 63) <= min(cols[3]) <= max(cols[3]) < 1 << 63:
                    raise OverflowError("a score leaves the long range")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["qn", "query_id", "vec_id", "score"])

    return run


def _raise(floor, qn, best, k):
    """Set the floor of each query that has k rows to the score of its last one, as far as a long holds it."""
    end = np.searchsorted(best[0], qn, "right")
    full = end - np.searchsorted(best[0], qn) == k
    floor[full] = np.clip(best[3][end[full] - 1], np.iinfo(np.int64).min, np.iinfo(np.int64).max)


def _best(parts, k):
    """Merge selections: k best per query."""
    qn, qid, cid, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((cid, -score, qn))
    qn, qid, cid, score = qn[order], qid[order], cid[order], score[order]
    keep = np.arange(len(qn)) - np.searchsorted(qn, qn) < k
    return qn[keep], qid[keep], cid[keep], score[keep]


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
