"""Benchmark decontamination by suffix arrays over the training documents.

Words are mapped to integers through the benchmark's own vocabulary; a word that
no item holds can lie in no match and becomes a separator. Per shard (a run of
documents of bounded size inside a task) a suffix array is built, to full depth by
prefix doubling, over every position that starts at least as many known words as
the shortest window. Every test suffix is binary-searched in it: the range that
agrees with its window gives the window's occurrences, and searching on within
that range its longest verbatim match and where that is. Per document, the match
of a position is the longer one of its two neighbours among the test suffixes.

Scale: one map-side pass over the documents, no shuffle. The test set is cut into
blocks of at most ``block_words`` words (one item may exceed that); the driver and a
worker hold one block at a time, a worker with several blocks loads them in turn
for every slice of texts. Texts are read whole, however long.

Contract: words are A-Z lower-cased runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A
window is 13 consecutive words of an item, or the whole item if it is shorter. A
document is contaminated if n_hit > 0 and 20 * n_hit >= n_words.

Defined cases: null texts and texts without words have no words, windows or
hits; an item without an id is ignored; items that share an id count once, with
the windows of all; repeated documents are judged each; empty tables give empty
or untouched results. Of equally long matches the one earliest in the document
counts, then the item whose id sorts first as a string, then the earliest place in
it. Columns of the input other than id and text are not read by the report and
pass unchanged through ``decontaminated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmesh.llm.batches import slices
from nearmesh.llm.common import WORD_BYTES, fresh, words_of
from nearmesh.llm.feistel import mix64

WINDOW = 13
SHARD_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, known words from each position on).

    Negative words are separators: a suffix ends before the next one, and an ended
    suffix sorts before its extensions. Only positions with ``least`` known words are
    given. The last word must be a separator.
    """
    n, places = len(words), np.arange(len(words))
    edge = np.flatnonzero(words < 0)
    run = edge[np.searchsorted(edge, places)] - places
    # Prefix doubling: groups that agree on k words are ordered by the ranks k words on.
    left = places - np.concatenate(([-1], edge))[np.searchsorted(edge, places)] - 1
    sa = np.flatnonzero((run > 0) & (left + run >= least))
    sa = sa[np.argsort(words[sa], kind="stable")]
    rank = np.zeros(n + 1, np.int64)
    open_, k = np.arange(len(sa)), 0
    while len(open_):
        at = sa[open_]
        group = rank[at]
        then = words[at].astype(np.int64) + 1 if not k else np.where(run[at] > k, rank[np.minimum(at + k, n)], 0)
        order = np.lexsort((then, group))
        at, group, then = at[order], group[order], then[order]
        sa[open_] = at
        new = np.concatenate(([True], (np.diff(group) != 0) | (np.diff(then) != 0)))
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_ = open_[np.repeat(size > 1, size) & (then > 0)]  # equal suffixes that have ended stay together
        k = 2 * k or 1
    return sa[run[sa] >= max(1, least)], run


class Hashed:
    """Words whose equal stretches have equal sums, up to chance."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(words), _BASE))), dtype=np.uint64)
            sums = np.cumsum(mix64(words.astype(np.int64).astype(np.uint64)) * power[:-1], dtype=np.uint64)
        self.power, self.sums = power, np.concatenate(([np.uint64(0)], sums))

    def common(self, at: np.ndarray, other: "Hashed", there: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of words, up to ``most``, in which the stretches from ``at`` and ``there`` agree."""
        lo, hi = np.zeros(len(at), np.int64), most.copy()
        while (open_ := lo < hi).any():
            i = np.flatnonzero(open_)
            half = (lo[i] + hi[i] + 1) >> 1
            with np.errstate(over="ignore"):
                a = (self.sums[at[i] + half] - self.sums[at[i]]) * other.power[there[i]]
                b = (other.sums[there[i] + half] - other.sums[there[i]]) * self.power[at[i]]
            same = a == b
            lo[i[same]], hi[i[~same]] = half[same], half[~same] - 1
        return lo


class TestSuffixes:
    """A block of test items: vocabulary, words as integers, suffixes and windows."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, least: int | None = None):
        self.window, self.vocab = window, {}
        flat, starts, lens, owner, pos = [], [], [], [], []
        index: dict[str, int] = {}
        for name, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            i = index.setdefault(name, len(index))
            for s in range(max(1, len(ids) - window + 1)):  # the suffixes that hold a window
                starts.append(len(flat) + s)
                lens.append(min(window, len(ids)))
            owner += [i] * (len(ids) + 1)
            pos += range(len(ids) + 1)
            flat += ids + [-1]
        self.names = list(index)
        self.flat = np.array(flat + [-1] * (window + 1), dtype=np.int32)
        self.owner, self.pos = np.array(owner, dtype=np.int64), np.array(pos, dtype=np.int64)
        self.starts, self.lens = np.array(starts, dtype=np.int64), np.array(lens, dtype=np.int64)
        #: Training positions with fewer known words take no part.
        self.least = min(least or window, int(self.lens.min())) if len(starts) else 0
        #: Distinct windows, and the items of each: equal windows are searched once.
        mat = self.flat[self.starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), np.int32)
        mat = np.where(np.arange(window) < self.lens[:, None], mat, -3).astype(np.int32)
        self.windows, which = np.unique(mat, axis=0, return_inverse=True) if len(mat) else (mat, np.zeros(0, np.int64))
        self.which = which.reshape(-1)
        self.wlens = (self.windows != -3).sum(axis=1)
        order = np.argsort(self.which, kind="stable")
        self.of = self.owner[self.starts[order]] if len(starts) else np.zeros(0, np.int64)
        self.cut = np.searchsorted(self.which[order], np.arange(len(self.windows) + 1))
        #: All suffixes in order, the window that each begins with (-1 if it holds none), and the names' order.
        self.sa, self.run = suffix_array(self.flat, 1)
        self.holds = np.full(len(self.flat), -1)
        self.holds[self.starts] = self.which
        self.hashed = Hashed(self.flat)
        by_name = np.argsort(np.argsort(np.array(self.names, dtype=object))) if self.names else np.zeros(0, np.int64)
        #: Orders suffixes by item, then place.
        self.key = (by_name[self.owner[self.sa]].astype(np.int64) << 32) + self.pos[self.sa] if len(self.sa) else np.zeros(0, np.int64)

    def windows_owner(self, w: int) -> set[str]:
        return {self.names[o] for o in self.of[self.cut[w] : self.cut[w + 1]]}

    def first_with(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place in ``sa`` of the first suffix by item and place that shares ``length`` words with the suffix at place ``at``."""
        n, me = len(self.sa), self.sa[at]
        agrees = lambda j: self.hashed.common(self.sa[j], self.hashed, me, np.minimum(length, self.run[self.sa[j]])) >= length
        ends = []
        for step in (-1, 1):  # the suffixes that agree lie around it
            near, far = at.copy(), np.full(len(at), -1 if step < 0 else n)
            while ((far - near) * step > 1).any():
                mid = np.where((far - near) * step > 1, (near + far) // 2, near)
                ok = agrees(mid)
                near, far = np.where(ok, mid, near), np.where(ok, far, mid)
            ends.append(near)
        return np.array([a + int(np.argmin(self.key[a : b + 1])) for a, b in zip(*ends)], dtype=np.int64)


def _compare(train: np.ndarray, at: np.ndarray, windows: np.ndarray, wlens: np.ndarray):
    """Sign of training suffix minus window over the window's words, and their common length."""
    depth = windows.shape[1]
    rows = train[at[:, None] + np.arange(depth)]
    rows = np.where(np.minimum.accumulate(rows, axis=1) < 0, -1, rows)
    inside = np.arange(depth) < wlens[:, None]
    diff = np.where(inside, rows - windows, 0)
    first = (diff != 0).argmax(axis=1)
    any_diff = (diff != 0).any(axis=1)
    sign = np.where(any_diff, np.sign(diff[np.arange(len(diff)), first]), 0)
    return sign, np.where(any_diff, first, wlens)


def _ranges(train: np.ndarray, sa: np.ndarray, windows: np.ndarray, wlens: np.ndarray, low=None, high=None, skip=None):
    """Binary search of all windows at once: [lo, hi) of the suffixes that begin with each, after ``skip`` words, within [low, high)."""
    out = []
    for right in (False, True):
        lo = np.zeros(len(windows), np.int64) if low is None else low.copy()
        hi = np.full(len(windows), len(sa), np.int64) if high is None else high.copy()
        while (open_ := lo < hi).any():
            i = np.flatnonzero(open_)
            mid = (lo[i] + hi[i]) >> 1
            sign, _ = _compare(train, sa[mid] + (0 if skip is None else skip[i]), windows[i], wlens[i])
            below = sign <= 0 if right else sign < 0
            lo[i[below]], hi[i[~below]] = mid[below] + 1, mid[~below]
        out.append(lo)
    return out


class Shard:
    """Suffix array of some documents, searched for a block of test items."""

    def __init__(self, texts: list[str | None], test: TestSuffixes):
        self.test = test
        ids, lens = [], []
        get = test.vocab.get
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []
            lens.append(len(words))
            ids.extend([get(w, -1) for w in words])
            ids.append(-1)
        self.n_words = np.array(lens, dtype=np.int64)
        #: Place of each document's first word; a separator follows its last.
        self.base = np.concatenate(([0], np.cumsum(self.n_words + 1)))
        self.train = np.array(ids + [-1] * (test.window + 1), dtype=np.int32)
        self.sa, self.run = suffix_array(self.train, test.least) if test.least else (np.zeros(0, np.int64), None)
        self.lo, self.hi = _ranges(self.train, self.sa, test.windows, test.wlens)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, side="right") - 1

    def report(self):
        """Per document: the names of the items that occur; and which words are hit."""
        n, t = len(self.n_words), self.test
        cover = np.zeros(len(self.train) + 1, np.int64)
        found = np.flatnonzero(self.hi > self.lo)
        counts = self.hi[found] - self.lo[found]
        seen = np.repeat(found, counts)  # the window of each occurrence
        at = self.sa[np.repeat(self.lo[found], counts) + _ramp(counts)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + t.wlens[seen], -1)
        names: list[set[str]] = [set() for _ in range(n)]
        pairs = np.unique(np.stack([self.doc(at), seen], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        owners = {w: t.windows_owner(w) for w in np.unique(seen).tolist()}
        for d, w in pairs.tolist():
            names[d] |= owners[w]
        return names, np.cumsum(cover[:-1]) > 0

    def _insert(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray):
        """Search the test suffixes ``at`` on, in ranges that agree with ``depth`` words: (insertion point, length of the longest match, its range)."""
        t, lo, hi, depth = self.test, lo.copy(), hi.copy(), depth.copy()
        rest, ins, width = t.run[at], lo.copy(), t.window
        todo = np.flatnonzero(rest > depth)
        while len(todo):
            d, low, high = depth[todo], lo[todo], hi[todo]
            lens = np.minimum(width, rest[todo] - d)
            words = t.flat[(at[todo] + d)[:, None] + np.arange(width)]
            a, b = _ranges(self.train, self.sa, words, lens, low, high, d)
            ins[todo] = a
            common = np.zeros(len(todo), np.int64)
            for side in (a - 1, a):
                i = np.flatnonzero((a == b) & (side >= low) & (side < high))
                common[i] = np.maximum(common[i], _compare(self.train, self.sa[side[i]] + d[i], words[i], lens[i])[1])
            miss = np.flatnonzero(a == b)
            a[miss], b[miss] = _ranges(self.train, self.sa, words[miss], common[miss], low[miss], high[miss], d[miss])
            lo[todo], hi[todo] = a, b
            found = np.ones(len(todo), bool)
            found[miss] = False
            depth[todo] += np.where(found, lens, common)
            todo = todo[found]
            todo = todo[rest[todo] > depth[todo]]
        return ins, depth, lo, hi

    def matches(self):
        """Per document with a hit: (document, length, place in it, item, place in the item) of its longest verbatim match."""
        t = self.test
        matched = np.zeros(len(self.sa) + 1, np.int64)
        np.add.at(matched, self.lo, self.hi > self.lo)
        np.add.at(matched, self.hi, -(self.hi > self.lo).astype(np.int64))
        i = np.flatnonzero(np.cumsum(matched)[:-1] > 0)
        if not len(i):
            return []
        w = t.holds[t.sa]
        place = np.flatnonzero(w >= 0)
        place = place[((self.hi > self.lo) & (t.wlens == t.window))[w[place]]]  # test suffixes whose whole window occurs, in order
        w = t.holds[t.sa[place]]
        ins, _, _, _ = self._insert(t.sa[place], self.lo[w], self.hi[w], t.wlens[w])
        at, mine = self.sa[i], Hashed(self.train)
        best, length = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        after = np.searchsorted(ins, i, side="right")
        for j in (after - 1, after):
            ok = np.flatnonzero((j >= 0) & (j < len(place)))
            there = t.sa[place[j[ok]]]
            got = mine.common(at[ok], t.hashed, there, np.minimum(self.run[at[ok]], t.run[there]))
            more = (got > length[ok]) & (got >= t.window)  # it must hold a window
            best[ok[more]], length[ok[more]] = place[j[ok[more]]], got[more]
        short = np.full(len(i), -1)  # items of fewer words than a window match whole
        for v in np.flatnonzero((self.hi > self.lo) & (t.wlens < t.window)):
            of = slice(*np.searchsorted(i, (self.lo[v], self.hi[v])))
            less = length[of] < t.wlens[v]
            length[of][less], short[of][less] = t.wlens[v], v
        doc, wrong = self.doc(at), True
        while wrong:  # until what counts agrees word by word
            wrong = False
            order = np.lexsort((at, -length, doc))
            first = order[np.concatenate(([True], np.diff(doc[order]) != 0))]
            for x in first[short[first] < 0]:
                p, q, n = at[x], t.sa[best[x]], length[x]
                differ = np.flatnonzero(self.train[p : p + n] != t.flat[q : q + n])
                if len(differ):
                    length[x], wrong = differ[0], True
        long = short[first] < 0
        item = np.zeros(len(first), np.int64)
        item[long] = t.sa[t.first_with(best[first[long]], length[first[long]])]
        names = [t.names[t.owner[q]] if whole < 0 else min(t.windows_owner(whole)) for q, whole in zip(item, short[first])]
        return list(zip(doc[first].tolist(), length[first].tolist(), (at[first] - self.base[doc[first]]).tolist(), names, np.where(long, t.pos[item], 0).tolist()))

    def longest(self, ids: np.ndarray):
        """Columns item, place, length, id, place in the document: per test suffix its longest match here, ties to the smaller id and place; ``ids`` of the documents."""
        t = self.test
        n = len(t.sa)
        zero = np.zeros(n, np.int64)
        _, length, lo, hi = self._insert(t.sa, zero, np.full(n, len(self.sa)), zero)
        i = np.flatnonzero((length >= t.least) & (hi > lo))
        if not len(i):
            return [], [], [], [], []
        doc = self.doc(self.sa)
        order = np.lexsort((self.sa - self.base[doc], ids[doc]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_lo = i[np.argsort(lo[i], kind="stable")]
        cuts = np.stack([lo[by_lo], hi[by_lo]], axis=1).reshape(-1)
        least = np.minimum.reduceat(np.append(place, len(place)), cuts)[::2]
        at = self.sa[order[least]]
        d = self.doc(at)
        item = t.sa[by_lo]
        return [t.names[o] for o in t.owner[item]], t.pos[item].tolist(), length[by_lo].tolist(), ids[d].tolist(), (at - self.base[d]).tolist()


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _shards(texts: list[str | None]):
    """Slices of ``texts`` of about SHARD_BYTES; a longer text is a shard of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SHARD_BYTES:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int, window: int, least: int | None = None):
    """Test items in blocks of bounded size; one block is on the driver at a time."""
    block, words = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null").toLocalIterator()
    for name, body in rows:
        block.append((name, words_of(body)))
        words += len(block[-1][1])
        if words >= block_words:
            yield TestSuffixes(block, window, least)
            block, words = [], 0
    yield TestSuffixes(block, window, least)


class Sent:
    """Blocks of the test set as broadcasts; a worker holds one at a time."""

    def __init__(self, spark, blocks):
        self.blocks = [spark.sparkContext.broadcast(b) for b in blocks]  # the driver keeps files, not blocks

    def __iter__(self):
        if len(self.blocks) == 1:
            yield self.blocks[0].value
        else:
            for b in self.blocks:
                yield b.load_from_path(b._path)


def _digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


_ADDED = (
    ("n_words", T.LongType(), pa.int64()), ("n_hit", T.LongType(), pa.int64()), ("n_items", T.LongType(), pa.int64()),
    ("items_sha256", T.StringType(), pa.string()), ("contaminated", T.BooleanType(), pa.bool_()), ("longest", T.LongType(), pa.int64()),
    ("longest_doc_pos", T.LongType(), pa.int64()), ("longest_item", T.StringType(), pa.string()), ("longest_item_pos", T.LongType(), pa.int64()),
    ("items", T.ArrayType(T.StringType()), pa.list_(pa.string())),
)


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = 2_000_000,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the longest verbatim match that holds a window
    (longest: its words, 0 if none; longest_doc_pos, longest_item, longest_item_pos: where it begins), items (sorted)."""
    out = _scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, item_id, item_text, window, block_words, "text", False)
    return out.drop("text")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = 2_000_000,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    return _scan(docs, benchmark, item_id, item_text, window, block_words, text, True)


def _scan(docs, benchmark, item_id, item_text, window, block_words, text, keep):
    sent = Sent(docs.sparkSession, _blocks(benchmark, item_id, item_text, block_words, window))
    schema = docs.schema if keep else T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t, _ in _ADDED])
    column = docs.columns.index(text)

    def judged(texts):
        """Rows of the added columns."""
        parts = list(_shards(texts))
        covers, items, best, shape = [None] * len(parts), [set() for _ in texts], {}, [None] * len(parts)
        for test in sent:
            for k, part in enumerate(parts):
                shard = Shard(texts[part], test)
                found, hit = shard.report()
                covers[k] = hit if covers[k] is None else covers[k] | hit
                shape[k] = (shard.n_words, shard.base)
                for d, names in enumerate(found, part.start):
                    items[d] |= names
                for d, n, p, item, q in () if keep else shard.matches():
                    best[part.start + d] = min(best.get(part.start + d, (1,)), (-n, p, item, q))
        at = 0
        for (n_words, base), cover in zip(shape, covers):
            total = np.concatenate(([0], np.cumsum(cover)))
            for words, hit in zip(n_words.tolist(), (total[base[1:]] - total[base[:-1]]).tolist()):
                n, p, item, q = best.get(at, (0, None, None, None))
                yield words, hit, len(items[at]), _digest(items[at]), hit > 0 and 20 * hit >= words, -n, p, item, q, sorted(items[at])
                at += 1

    def run(batches):
        for batch in slices(batches, column):
            rows = list(judged(batch.column(column).to_pylist()))
            if keep:
                yield batch.filter(pa.array([not r[4] for r in rows], pa.bool_()))
            else:
                cols = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(_ADDED)]
                yield pa.RecordBatch.from_arrays(batch.columns + cols, names=batch.schema.names + [n for n, _, _ in _ADDED])

    return docs.mapInArrow(run, schema)


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = 2_000_000, least: int | None = None,
) -> DataFrame:
    """Per test suffix: its longest verbatim match over all shards and where it is.

    Rows: item_id, item_pos, length, doc_id, doc_pos. Matches of fewer than ``least``
    words (if not given or longer: the shortest window) are not looked for. Ties go to
    the smaller doc_id, doc_pos; null ids are left out.
    """
    sent = Sent(docs.sparkSession, _blocks(benchmark, item_id, item_text, block_words, window, least))

    def run(batches):
        for batch in slices(batches, 1):
            ids, texts = np.asarray(batch.column(0), dtype=np.int64), batch.column(1).to_pylist()
            for test in sent:
                for part in _shards(texts):
                    cols = Shard(texts[part], test).longest(ids[part])
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "item_pos", "length", "doc_id", "doc_pos"])

    found = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null").mapInArrow(
        run, "item_id string, item_pos long, length long, doc_id long, doc_pos long"
    )
    best = found.groupBy("item_id", "item_pos").agg(F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_pos")).alias("b"))
    return best.select("item_id", "item_pos", (-F.col("b.l")).alias("length"), "b.doc_id", "b.doc_pos")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS brid, item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT brid, item_id, i AS j, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT brid, item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT item_id, n, g FROM wins),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT DISTINCT grams.rid, grams.i, grams.n, win.item_id FROM grams JOIN win USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY rid),
runs AS (SELECT rid, s, min(i) - 1 AS p, min(j) - 1 AS q, n + count(*) - 1 AS len
  FROM (SELECT rid, i, j, n, brid, CAST(item_id AS VARCHAR) AS s, i - row_number() OVER (PARTITION BY rid, brid, n, i - j ORDER BY i) AS run FROM grams JOIN wins USING (n, g))
  GROUP BY rid, s, brid, n, i - j, run),
best AS (SELECT rid, len, p, s, q FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY len DESC, p, s, q) AS rn FROM runs) WHERE rn = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated,
  CAST(coalesce(best.len, 0) AS BIGINT) AS longest, CAST(best.p AS BIGINT) AS longest_doc_pos, best.s AS longest_item, CAST(best.q AS BIGINT) AS longest_item_pos
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid) LEFT JOIN best USING (rid)
"""
