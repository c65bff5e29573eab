"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every document becomes a weighted set of five-word shingles (weight 1 + ln count).
Each shingle is a Poisson process whose rate is its weight; every arrival hits one
of the signature's registers, the earliest arrival keeps it, and a shingle stops as
soon as its next arrival is later than every register (early termination). Equal
registers estimate the probability Jaccard similarity. 40 bands of 5 registers make
candidates; the texts of a candidate pair are compared exactly, and a pair with a
Jaccard similarity of five-word shingle sets of 0.8 or more is a link. Classes are
the connected components of the links.

A text that repeats shingles gets 40 further bands, of the registers of its plain
shingle set; for any other text both are the same. So every pair of plain Jaccard
0.8 meets in a band but for a chance of 1e-7, however often either text repeats a
shingle, and the exact check is on plain sets too.

Scale. Texts with equal words are one node first (combined map-side), so a group of
exact copies costs one node whatever its size. Within a band bucket the first node,
its hub, is compared to the others; no pairs of others are made. A hub's text goes
once to every STAR of its members. A bucket too large for one task stays where its
rows are and gets its hub by broadcast. After components are known, the buckets
whose members still have several labels are joined to clusters. The nodes of a
cluster meet once, in cells of two blocks, where every pair of different labels is
compared exactly through the postings of its shingles, and only links that join
labels are given out. So no link that shares a bucket is lost, and rows stay in
proportion to nodes. Blocks are bounded in nodes and in shingles; a cluster of g
nodes is read once per block, at most SPREAD times unless the bounds need more.
Components are found by minimum labels with pointer jumping in DataFrames; hot
nodes go out by a bounded broadcast, hot labels are salted. Nothing per document
reaches the driver. Each step is a table in the shared folder, so lost executors
repeat one step.

Defined cases: a text with no words (null, empty) is a class of its own; one with
fewer than five words has one shingle of all of them; rows whose id is null are
compared like others and carry their texts along; a class is named by its smallest
id, one of null ids only by null; repeated rows share a class; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmesh.llm.batches import cuts, slices
from nearmesh.llm.common import WORD_BYTES, fresh, words_of, write_table
from nearmesh.llm.feistel import mix64

SHINGLE = 5
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
CHUNK_BYTES = 1 << 20
#: Most nodes and most shingles of a block of a cluster, and the nodes from which it has SPREAD blocks.
CELL, CELL_SHINGLES = 2048, 1 << 20
SMALL, SPREAD = 128, 24
#: Members that a copy of a hub's text is compared to.
STAR = 256
#: Bound on the buckets and nodes that are dealt with as hot.
HOT_KEYS = 10_000
#: Links from which a node may be hot.
HOT_NODE = 10_000
#: Parts that the rows of one label are dealt to.
SALTS = 8
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _U(0x100000001B3)), dtype=_U)


def _word_hashes(raw: np.ndarray):
    """Hashes of the words in cleaned bytes, and where each begins."""
    word = raw != 32
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, _U), starts
    lens = ends - starts
    body = raw[word].astype(_U) + _U(1)
    first = np.cumsum(lens) - lens
    at = np.arange(len(body)) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        # Words above 64 bytes: each further 64 bytes are multiplied by another odd constant.
        h = np.add.reduceat(body * _POWERS[at & 63] * (_U(2) * (at >> 6).astype(_U) + _U(1)), first)
        return mix64(h + lens.astype(_U) * _GOLD), starts


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of one document's word hashes."""
    n = max(1, len(words) - SHINGLE + 1)
    h = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(min(SHINGLE, len(words))):
            h = mix64(h * _GOLD + words[j : j + n])
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; none without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES), np.uint8)
    words, _ = _word_hashes(raw)
    return np.unique(_shingle_hashes(words)) if len(words) else np.zeros(0, _U)


def node_of(text: str | None) -> bytes | None:
    """Digest of the words of a text; None without words."""
    words = words_of(text)
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _signatures(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n_docs x m) of weighted elements ``elem`` of documents ``doc``."""
    time = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, _U)
    t = np.zeros(len(elem))
    state = mix64(elem + _GOLD)
    while len(elem):
        with np.errstate(over="ignore"):
            state = state + _GOLD
            x = mix64(state)
        t = t - np.log1p(-(x >> _U(11)).astype(np.float64) * 2.0**-53) / weight
        latest = time.reshape(n_docs, m).max(axis=1)
        open_ = t < latest[doc]  # an arrival later than every register ends its process
        doc, elem, weight, t, state, x = doc[open_], elem[open_], weight[open_], t[open_], state[open_], x[open_]
        slot = doc * m + ((mix64(x ^ _U(0xD1B54A32D192ED03)) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        np.minimum.at(time, slot, t)
        won = time[slot] == t
        held[slot[won]] = elem[won]
    return held.reshape(n_docs, m)


def _bands(held: np.ndarray) -> np.ndarray:
    """Band keys (n_docs x BANDS, int64) of signatures."""
    h = np.zeros((len(held), BANDS), _U)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = mix64(h * _GOLD + held[:, r::ROWS])
        h = mix64(h + np.arange(BANDS, dtype=_U) * _GOLD)
    return h.view(np.int64)


def band_keys(texts: list[str | None]):
    """(band keys, number of shingles) of each text; (None, 0) for texts without words."""
    out: list[tuple] = [(None, 0)] * len(texts)
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_BYTES or i == len(texts) - 1:
            _band_chunk(texts, begin, i + 1, out)
            begin, size = i + 1, 0
    return out


def _band_chunk(texts, begin: int, end: int, out) -> None:
    sets, counts, owner, of = [], [], [], []
    for i in range(begin, end):
        raw = np.frombuffer((texts[i] or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES), np.uint8)
        words, _ = _word_hashes(raw)
        if len(words):
            e, c = np.unique(_shingle_hashes(words), return_counts=True)
            out[i] = ([], len(e))
            for weights in (c, np.ones_like(c)) if c.max() > 1 else (c,):  # repeats: the plain set too
                sets.append(e)
                counts.append(weights)
                owner.append(np.full(len(e), len(of)))
                of.append(i)
    if of:
        weight = 1.0 + np.log(np.concatenate(counts))
        keys = _bands(_signatures(np.concatenate(owner), np.concatenate(sets), weight, len(of)))
        for i, row in zip(of, keys.tolist()):
            out[i][0].extend(row)


def _signed(batches):
    for batch in slices(batches, 1):
        texts = batch.column(1).to_pylist()
        nodes = [node_of(t) for t in texts]
        keys: list = [(None, 0)] * len(texts)
        first = {n: i for i, n in reversed(list(enumerate(nodes))) if n is not None}  # one of equal texts is enough
        where = sorted(first.values())
        for i, k in zip(where, band_keys([texts[i] for i in where])):
            keys[i] = k
        lost = batch.column(0).is_null().to_pylist()
        own = [t if no and n is not None else None for t, n, no in zip(texts, nodes, lost)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(nodes, pa.binary()), pa.array([None if k[0] is None else sorted(set(k[0])) for k in keys], pa.list_(pa.int64())),
                pa.array([k[1] for k in keys], pa.int64()), pa.array(own, pa.string()),
            ],
            names=["doc_id", "node", "bands", "size", "own"],
        )


def _verify(threshold: float):
    """Streams of (hub, part, other, node, text), sorted, the hub before the others: the pairs (hub, node) that are similar enough."""

    def run(batches):
        star, hub, last = None, None, None
        for batch in slices(batches, 4):
            out = []
            for a, part, _, node, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (a, part) != star:
                    star, hub, last = (a, part), None, None
                if node == last or hub is None and node != a or node_of(text) != node:  # seen, or another text under a repeated id
                    continue
                last, mine = node, shingle_set(text)
                if node == a:
                    hub = mine
                elif min(len(hub), len(mine)) >= threshold * max(len(hub), len(mine)) - 1e-9:
                    both = len(np.intersect1d(hub, mine, assume_unique=True))
                    if both >= threshold * (len(hub) + len(mine) - both) - 1e-9:
                        out.append((a, node))
            yield _pairs(out)

    return run


def _pairs(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _with_text(placed: DataFrame, nodes: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``placed`` (which has node) and a text of each node; nodes without an id bring their own."""
    known = placed.join(nodes.select("node", "rep", "own"), "node")
    by_id = known.where("rep is not null").join(docs, F.col("rep") == docs["id"]).select(*columns, "text")
    return by_id.unionByName(known.where("rep is null").select(*columns, F.col("own").alias("text")))


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of hubs and members whose texts are similar enough. ``docs``: columns id, text."""
    large = pairs.groupBy("a").count().where(F.col("count") > STAR).select("a", F.ceil(F.col("count") / STAR).cast("int").alias("n"))
    large = write_table(large, "large")  # its size is known when the join is planned
    parts = pairs.join(large, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("n", F.lit(1))).cast("int").alias("part"), "b")
    hubs = parts.select("a", "part").distinct().select("a", "part", F.lit(False).alias("other"), F.col("a").alias("node"))
    placed = hubs.unionByName(parts.select("a", "part", F.lit(True).alias("other"), F.col("b").alias("node")))
    dealt = _with_text(placed, nodes, docs, "a", "part", "other", "node").repartition("a", "part").sortWithinPartitions("a", "part", "other", "node")
    return write_table(dealt.mapInArrow(_verify(threshold), "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in a link (a, b): label is the smallest node of its component."""
    # One small-star step: every node points to its least neighbour, and so do its other lesser neighbours.
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    stars = write_table(least.select(F.col("u").alias("a"), F.col("m").alias("b")).union(across).distinct(), "stars")
    both = write_table(stars.union(stars.select("b", "a")), "edges")
    counts = both.groupBy(F.col("b").alias("hot")).count()
    hot = write_table(counts.where(F.col("count") > F.lit(max(HOT_NODE, both.count() // HOT_KEYS))).select("hot"), "hot")  # at most HOT_KEYS
    none = hot.isEmpty()
    cold = both if none else write_table(both.join(F.broadcast(hot), F.col("b") == F.col("hot"), "left_anti"), "cold")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        met = cold.join(labels.select(F.col("node").alias("b"), "label"), "b").select("a", "label")
        if not none:
            few = labels.join(F.broadcast(hot), F.col("node") == F.col("hot"), "left_semi").select(F.col("node").alias("b"), "label")
            met = met.union(both.join(F.broadcast(few), "b").select("a", "label"))
        near = met.groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        step = write_table(step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "steps")
        # Many nodes may share a next label: each is looked up once per salt.
        asked = step.select(F.col("next").alias("j")).distinct().join(labels.select(F.col("node").alias("j"), F.col("label").alias("far")), "j")
        asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        step = step.join(asked, (F.col("next") == F.col("j")) & (F.col("salt") == F.col("s")), "left").select("node", F.least("next", "far").alias("label"), "was")
        step = write_table(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def _nodes_and_rows(docs: DataFrame):
    rows = write_table(docs.select("id", "text").mapInArrow(_signed, "doc_id long, node binary, bands array<bigint>, size long, own string"), "signed")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("bands", ignorenulls=True).alias("bands"), F.max("size").alias("size"), F.first("own", ignorenulls=True).alias("own")
    )
    return rows.select("doc_id", "node"), write_table(nodes, "nodes")


def _compared(threshold: float):
    """Streams of (cluster, x, y, block, node, label, text), sorted by cell (cluster, x, y): links (a, b) that join labels.

    A cell holds at most two blocks of a cluster; overlaps are counted through the
    postings of its shingles, for every node outside the cell's largest label.
    """

    def links(x: int, y: int, rows: list[tuple]):
        seen: set[bytes] = set()
        rows = [r for r in rows if r[1] not in seen and not seen.add(r[1])]
        sets = [r[3] for r in rows]
        if len(rows) < 2:
            return []
        sizes = np.array([len(e) for e in sets])
        elems, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(elems, kind="stable")
        elems, owner = elems[order], owner[order]
        names, label = np.unique(np.array([r[2].hex() for r in rows]), return_inverse=True)
        block = np.array([r[0] for r in rows])
        root = list(range(len(names)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        largest, out = np.bincount(label).argmax(), []
        for i in np.flatnonzero(label != largest):
            lo, hi = np.searchsorted(elems, sets[i]), np.searchsorted(elems, sets[i], side="right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = np.bincount(owner[at], minlength=len(rows))
            near = (both >= threshold * (sizes[i] + sizes - both) - 1e-9) & (label != label[i])
            if x != y:
                near &= block != block[i]
            for j in np.flatnonzero(near):
                p, q = find(label[i]), find(label[j])
                if p != q:
                    root[p] = q
                    out.append((rows[i][1], rows[j][1]))
        return out

    def run(batches):
        cell, rows = None, []
        for batch in slices(batches, 6):
            found = []
            for cluster, x, y, block, node, label, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (cluster, x, y) != cell:
                    found += links(*cell[1:], rows) if cell else []
                    cell, rows = (cluster, x, y), []
                if node_of(text) == node:  # else another text under a repeated id
                    rows.append((block, node, label, shingle_set(text)))
            yield _pairs(found)
        yield _pairs(links(*cell[1:], rows) if cell else [])

    return run


def _members(nodes: DataFrame) -> DataFrame:
    """(key, hub, node): every node of a band bucket beside the bucket's least node, its hub.

    A bucket is hot above CELL nodes and 1 / HOT_KEYS of all (key, node) rows, so fewer
    than HOT_KEYS are. Hot hubs are minima combined map-side, sent to the rows of their
    buckets; only the rows of the other buckets meet in a task.
    """
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    total = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
    hot = write_table(sizes.where(F.col("n") > max(CELL, total // HOT_KEYS)).select("key", "hub"), "hot")
    by_key = Window.partitionBy("key").orderBy("node")
    cold = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").withColumn("rn", F.row_number().over(by_key))
    cold = cold.withColumn("hub", F.first("node").over(by_key.rowsBetween(Window.unboundedPreceding, 0))).where("rn > 1")
    return cold.select("key", "hub", "node").union(keyed.join(F.broadcast(hot), "key").where("node <> hub").select("key", "hub", "node"))


def _labels(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of all nodes that a link touches."""
    members = write_table(_members(nodes), "members")  # buckets of two or more, without their hubs
    pairs = write_table(members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = _links(docs, nodes, pairs, threshold)
    labels = components(links)
    # Hubs are settled. A bucket whose other members have several labels is not: its nodes meet in a cluster.
    named = members.join(labels, "node", "left").select("key", "hub", "node", F.coalesce("label", "node").alias("label"))
    open_ = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    open_ = write_table(open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "open")  # a bucket may be large
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    edges = write_table(salted.join(open_, ["key", "salt"], "left_semi").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    clusters = components(edges).select("node", F.col("label").alias("cluster")).join(nodes.select("node", "size"), "node")
    count = F.count("*")
    n = F.greatest(count / CELL, F.least(count / SMALL, F.lit(SPREAD)), F.sum("size") / CELL_SHINGLES)
    blocks = clusters.groupBy("cluster").agg(F.ceil(n).cast("int").alias("n"))
    placed = clusters.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = placed.select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node")
    placed = placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    cells = _with_text(placed, nodes, docs, "cluster", "x", "y", "block", "node", "label")
    cells = cells.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "node")
    more = write_table(cells.mapInArrow(_compared(threshold), "a binary, b binary"), "links")
    return components(links.union(more))


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float):
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows, nodes = _nodes_and_rows(docs)
    labels = _labels(docs, nodes, threshold)
    alone = nodes.select("node", "rep").join(labels, "node", "left_anti").select("node", "rep", F.col("rep").alias("class_id"), F.lit(True).alias("is_first"))
    linked = nodes.select("node", "rep").join(labels, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    names = linked.groupBy("label").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("first"))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a class may be large
    named = linked.join(names, ["label", "salt"]).select("node", "rep", "class_id", (F.col("node") == F.col("first.node")).alias("is_first"))
    return rows, write_table(alone.unionByName(named), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, class_id (the smallest id of its class; its own id if it is alone)."""
    rows, classes = _classes(docs, doc_id, text, threshold)
    out = rows.join(classes, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row of each class left, with the columns of ``docs``.

    The row with the smallest id stays; of several nodes under that id (repeated ids
    with different texts) the one of the smallest digest, of repeated rows any one.
    Rows without words all stay.
    """
    rows, classes = _classes(docs, doc_id, text, threshold)
    worded = rows.where("node is not null")
    first = classes.where("is_first").select("node", "rep")
    losers = worded.join(first, "node", "left_anti").unionByName(worded.join(first, "node").where("not (doc_id <=> rep)").select("doc_id", "node"))
    i, n, fn, fr = fresh(docs, "nm_id", "nm_node", "nm_first", "nm_rep")
    keyed = docs.withColumn(i, F.col(doc_id).cast("long"))
    per_id = rows.groupBy("doc_id").agg(F.count("*").alias("c"), F.count("node").alias("w"))
    if per_id.where("w > 0 and (c > 1 or doc_id is null)").isEmpty():  # ids tell rows apart
        gone = losers.select(F.col("doc_id").alias(n)).distinct()
        return keyed.join(gone, keyed[i] == F.col(n), "left_anti").select(*docs.columns)

    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([node_of(t) for a, k in cuts(texts) for t in texts.slice(a, k).to_pylist()], pa.binary())

    keyed = keyed.withColumn(n, F.arrow_udf(digests, "binary")(F.col(text)))
    kept = keyed.where(F.col(n).isNotNull()).join(first.select(F.col("node").alias(fn), F.col("rep").alias(fr)), (F.col(n) == F.col(fn)) & F.col(i).eqNullSafe(F.col(fr)), "left_semi")
    return kept.dropDuplicates([n]).select(*docs.columns).unionByName(keyed.where(F.col(n).isNull()).select(*docs.columns))


#: Exact pairs of all documents and their components. Feasible on small tables only.
ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS c FROM g GROUP BY rid),
p AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y, count(*) AS c2 FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.rid = x JOIN n v ON v.rid = y WHERE 5 * c2 >= 4 * (u.c + v.c - c2)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, least(d.doc_id, (SELECT min(o.doc_id) FROM r JOIN d o ON o.rid = r.y WHERE r.x = d.rid)) AS class_id FROM d
"""
