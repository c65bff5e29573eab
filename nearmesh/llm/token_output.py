"""Token-ID output in training order.

Every text is tokenised whole with a public vocabulary (a parameter), ended by the
end-of-text id and cut into sequences of ``seq_len`` ids; the last one is padded.
The documents are put in the order of a hash of id and text, and their sequences
numbered 0 .. N-1 in it. A keyed Feistel permutation of [0, N), with cycle-walking,
gives every sequence its global slot, which so depends on the rows and the key, not
on files, splits or the number of tasks. Slots are dense, so shard s holds the slots
from s * per_shard on, and a record begins at (slot % per_shard) * stride: a reader
can start at any slot and read on. A record is its number of ids (uint32) and
seq_len ids (uint16, or uint32 for vocabularies above 65,536).

Scale: texts are tokenised once; their ids are shuffled once to the partition of
their hash and written in its order, and once more as records, straight to the
partition of their shard (no sampling). Only the number of sequences per partition
reaches the driver. The permutation makes shards equally large however skewed the
documents are; a long document is many records in many shards. per_shard grows with
N, so that there are at most MAX_SHARDS. A lost executor repeats its tasks from the
token table; shard files are written under a temporary name and renamed, and a
repeated task that finds its shard complete leaves it.

Defined cases: null and empty texts make no sequence; a null id is kept as null;
repeated rows are sequences of their own (wholly equal rows meet in one partition,
which streams them); an empty table makes no record; columns other than id and text
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmesh.llm.batches import slices
from nearmesh.llm.common import write_table
from nearmesh.llm.feistel import permute

#: Fixed pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Where a cut before a space could split a run of white space.
_RUNS = re.compile(r"\s \s|  ")
_CACHED = 200_000
#: Least records of a shard, and most shards.
PER_SHARD, MAX_SHARDS = 16_384, 65_536
_loaded: dict[str, "Tokenizer"] = {}


class Tokenizer:
    """Ids of texts as packed bytes; remembers space-separated pieces.

    A cut before a space that does not continue a run of white space is always a
    boundary of PATTERN, so pieces can be encoded apart.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.cache = _Pieces(self)

    def pack(self, text: str) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text with the end-of-text id."""
        last = np.array([self.end], self.dtype).tobytes()
        if _RUNS.search(text):
            return self.pack(text) + last
        first, *rest = text.split(" ")
        cache = self.cache
        if len(cache) > _CACHED:
            cache.turn()
        return cache[first] + b"".join([cache[" " + x] for x in rest]) + last


class _Pieces(dict):
    """Two generations: what is still asked for survives when the younger one is full."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.old = tokenizer, {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece) or self.tokenizer.pack(piece)
        if len(piece) < 64:
            self[piece] = got
        return got


def _tokenizer(path: str, ranks: bytes) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(ranks)
    return _loaded[path]


def _place(doc_id, text: str) -> int:
    """Place of a document in the order of the table, 0 to 2**63 - 1."""
    data = f"{'' if doc_id is None else doc_id}:".encode() + text.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") >> 1


def token_table(docs: DataFrame, vocabulary: str, seq_len: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table: part, first (sequences before it in its part), doc_id, n_seq, ids; parts in order of the documents' hashes."""
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    parts = max(1, min(1 << 20, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        tokenizer = _tokenizer(vocabulary, sent.value)
        width = tokenizer.dtype.itemsize * seq_len
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            places = np.array([_place(i, t) if t else 0 for i, t in zip(batch.column(0).to_pylist(), texts)], dtype=np.int64)
            ids = [tokenizer.encode(t) if t else b"" for t in texts]
            counts = np.array([-(-len(x) // width) for x in ids], dtype=np.int64)
            part = ((places >> 43) * parts >> 20).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(places), batch.column(0), pa.array(counts), pa.array(ids, pa.binary())], names=["part", "place", "doc_id", "n_seq", "ids"]
            )

    def numbered(batches):
        before = 0
        for batch in batches:
            counts = np.asarray(batch.column(3), dtype=np.int64)
            first = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), *batch.columns[2:]], names=["part", "first", "doc_id", "n_seq", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "part int, place long, doc_id long, n_seq long, ids binary").where("n_seq > 0")
    out = out.repartitionById(parts, "part").sortWithinPartitions("place", "doc_id")
    return write_table(out.mapInArrow(numbered, "part int, first long, doc_id long, n_seq long, ids binary"), "tokens")


def training_order(
    docs: DataFrame, key: int, vocabulary: str = VOCABULARY, seq_len: int = 512, per_shard: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per sequence, in slot order within its shard's partition.

    Columns: slot, shard, byte_offset, doc_id, seq_no, n_ids, record. Without
    ``per_shard`` a shard has PER_SHARD records, or as many as MAX_SHARDS shards need.
    """
    table = token_table(docs, vocabulary, seq_len, doc_id, text)
    counts = sorted((r[0], r[1]) for r in table.groupBy("part").agg(F.sum("n_seq")).collect())  # one row per partition
    tasks = np.array([c[0] for c in counts], dtype=np.int64)
    sizes = np.array([c[1] for c in counts], dtype=np.int64)
    total = int(sizes.sum())
    per_shard = per_shard or PER_SHARD * max(1, -(-total // (PER_SHARD * MAX_SHARDS)))
    sent = docs.sparkSession.sparkContext.broadcast((tasks, np.cumsum(sizes) - sizes))
    with open(vocabulary, "rb") as f:
        n_ids = 1 + sum(1 for _ in f)
    dtype = np.dtype("<u2") if n_ids <= 1 << 16 else np.dtype("<u4")
    width = dtype.itemsize * seq_len
    stride = 4 + width

    def run(batches):
        known, offset = sent.value
        for batch in slices(batches, 4):
            task, first, n_seq = (np.asarray(batch.column(i), dtype=np.int64) for i in (0, 1, 3))
            start = offset[np.searchsorted(known, task)] + first
            seq = np.arange(int(n_seq.sum())) - np.repeat(np.cumsum(n_seq) - n_seq, n_seq)
            slot = permute(np.repeat(start, n_seq) + seq, total, key)
            lens, records = [], []
            for ids in batch.column(4).to_pylist():
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    n = len(part) // dtype.itemsize
                    lens.append(n)
                    records.append(n.to_bytes(4, "little") + part.ljust(width, b"\0"))
            owner = pa.array(np.repeat(np.arange(len(n_seq)), n_seq))
            for a in range(0, len(seq), 8192):  # bounded batches, however long a document is
                s = slice(a, a + 8192)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot[s]), batch.column(2).take(owner[s]), pa.array(seq[s]), pa.array(lens[s], pa.int32()), pa.array(records[s], pa.binary())],
                    names=["slot", "doc_id", "seq_no", "n_ids", "record"],
                )

    rows = table.mapInArrow(run, "slot long, doc_id long, seq_no long, n_ids int, record binary")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    rows = rows.repartitionById(max(1, -(-total // per_shard)), shard).sortWithinPartitions("slot")
    return rows.select("slot", shard.alias("shard"), ((F.col("slot") % per_shard) * stride).alias("byte_offset"), "doc_id", "seq_no", "n_ids", "record")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _settle(store, temp: str, name: str, size: int) -> None:
    """Give a finished file its name; one that another attempt has finished stays."""
    from pyarrow import fs

    there = lambda: (at := store.get_file_info(name)).type == fs.FileType.File and at.size == size
    if not there():
        try:
            store.move(temp, name)
            return
        except OSError:  # a store that does not rename over a file
            if not there():
                raise
    store.delete_file(temp)


def _writer(folder: str, at: tuple[int, int], manifest: bool):
    """Writes the records (columns ``at``: shard, record) of the batches as shard files; gives the batches, or one row per shard."""

    def run(batches):
        store, root = _store(folder)
        shard, out, temp, n, size, done = None, None, None, 0, 0, []

        def close():
            out.close()
            _settle(store, temp, f"{root}/{shard_name(shard)}", size)
            done.append((shard, n, size))

        for batch in batches:
            for s, record in zip(*(batch.column(i).to_pylist() for i in at)):
                if s != shard:
                    if out:
                        close()
                    else:
                        store.create_dir(root, recursive=True)
                    shard, temp, n, size = s, f"{root}/.{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(temp)
                out.write(record)
                n, size = n + 1, size + len(record)
            if not manifest:
                yield batch
        if out:
            close()
        if manifest:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], names=["shard", "n", "bytes"])

    return run


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``training_order`` as one file per shard; returns (shard, n, bytes).

    ``folder`` must be one that all executors reach through pyarrow. The files are
    there once the result has been computed; a repeated task writes the same bytes.
    """
    return ordered.select("shard", "record").mapInArrow(_writer(folder, (0, 1), True), "shard long, n long, bytes long")


def with_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """The rows of ``training_order``, whose records are also written as shard files when the result is computed."""
    names = ordered.columns
    return ordered.mapInArrow(_writer(folder, (names.index("shard"), names.index("record")), False), ordered.schema)


def read_records(folder: str, per_shard: int, seq_len: int, start: int = 0, itemsize: int = 2):
    """(slot, ids) of a local folder of shards, from slot ``start`` on."""
    stride, slot = 4 + itemsize * seq_len, start
    while True:
        try:
            with open(f"{folder}/{shard_name(slot // per_shard)}", "rb") as f:
                f.seek(slot % per_shard * stride)
                while record := f.read(stride):
                    n = int.from_bytes(record[:4], "little")
                    yield slot, np.frombuffer(record, f"<u{itemsize}", n, 4).tolist()
                    slot += 1
        except FileNotFoundError:
            return
        if slot % per_shard:
            return
