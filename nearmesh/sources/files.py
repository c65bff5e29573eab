"""Binary vector and graph files as DataFrames.

Vector files (little-endian): int32 N, int32 D, then N*D elements; the extension
names the element type. Graph files: int64 N, int32 K, then int32/uint32 [N*K].
``.npy``: two-dimensional arrays. A file is cut into row ranges; each range is one
task that seeks to its rows, so no task reads the whole file. Paths must be
readable by all executors through a file system that pyarrow knows.
"""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed element types by extension.
TYPES = {"fbin": "<f4", "bin": "<f4", "u8bin": "u1", "i8bin": "i1", "ibin": "<i4", "ubin": "<u4", "hbin": "<f2"}

#: Fixed padding of graph files.
NONE = 0xFFFFFFFF


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def element_type(path: str) -> np.dtype:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in TYPES:
        raise ValueError(f"unknown vector file type .{ext}")
    return np.dtype(TYPES[ext])


def vector_header(path: str) -> tuple[int, int]:
    """(N, D) of a vector file, checked against its length."""
    store, name = _fs(path)
    with store.open_input_file(name) as f:
        n, d = np.frombuffer(f.read(8), "<i4").tolist()
        if n <= 0 or d <= 0 or f.size() != 8 + n * d * element_type(path).itemsize:
            raise ValueError(f"{path}: bad header or length")
    return n, d


def _ranges(spark: SparkSession, begin: int, end: int, step: int) -> DataFrame:
    n = max(1, -(-(end - begin) // step))
    return spark.range(n, numPartitions=n).select((F.col("id") * step + begin).alias("lo"), F.least(F.lit(end), (F.col("id") + 1) * step + begin).alias("hi"))


def _rows(dtype, widen: bool):
    """(NumPy type, Spark type) of the values handed out: as stored, or widened to float or bigint."""
    kinds = {"f4": "float", "f2": "float", "u1": "smallint", "i1": "tinyint", "i4": "int", "u4": "bigint", "i8": "bigint"}
    if widen:
        return (np.dtype("f4"), "float") if dtype.kind == "f" or dtype.itemsize == 1 else (np.dtype("i8"), "bigint")
    kind = kinds[dtype.str[1:]]
    return np.dtype({"smallint": "i2", "tinyint": "i1", "int": "i4", "bigint": "i8", "float": "f4"}[kind]), kind


def _read_rows(file, lo: int, hi: int, offset: int, width: int, dtype, out) -> pa.Array:
    file.seek(offset + lo * width * dtype.itemsize)
    flat = np.frombuffer(file.read((hi - lo) * width * dtype.itemsize), dtype)
    if len(flat) != (hi - lo) * width:
        raise ValueError("the file ends before its rows")
    return pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * width, width, dtype=np.int32), pa.array(flat.astype(out)))


def _scan(spark, path, begin, end, step, offset, width, dtype, name="vec", widen=True):
    out, kind = _rows(dtype, widen)

    def run(batches):
        store, file = _fs(path)
        for batch in batches:
            for lo, hi in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                if lo < hi:
                    with store.open_input_file(file) as f:
                        lists = _read_rows(f, lo, hi, offset, width, dtype, out)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi, dtype=np.int64)), lists], names=["id", name])

    return _ranges(spark, begin, end, step).mapInArrow(run, f"id long, {name} array<{kind}>")


def read_vectors(spark: SparkSession, path: str, start: int = 0, count: int | None = None, rows_per_task: int = 100_000, widen: bool = True) -> DataFrame:
    """(id, vec) of a vector file or of its rows start .. start + count - 1; with ``widen`` 8-bit and half types become float, integers bigint."""
    n, d = vector_header(path)
    end = n if count is None else min(n, start + count)
    return _scan(spark, path, start, max(start, end), rows_per_task, 8, d, element_type(path), widen=widen)


def read_strict(spark: SparkSession, path: str, rows_per_task: int = 100_000) -> DataFrame:
    """(id, vec) in the stored type, of float and unsigned 8-bit files only."""
    if path.rsplit(".", 1)[-1].lower() not in ("fbin", "bin", "u8bin"):
        raise ValueError(f"{path}: neither a float nor an unsigned 8-bit file")
    return read_vectors(spark, path, rows_per_task=rows_per_task, widen=False)


def read_region(spark: SparkSession, path: str, start: int, count: int, rows_per_task: int = 100_000) -> DataFrame:
    """(id, vec) of exactly the rows start .. start + count - 1; a region outside the file is an error."""
    n, _ = vector_header(path)
    if start < 0 or count < 0 or start + count > n:
        raise ValueError(f"{path}: the region {start}, {count} is outside its {n} rows")
    return read_vectors(spark, path, start, count, rows_per_task)


def read_sampled(spark: SparkSession, path: str, ids: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """The rows of the ids of a table: every task seeks to its own ids, no other row is read. Ids outside the file are an error."""
    n, d = vector_header(path)
    dtype = element_type(path)
    out, kind = _rows(dtype, True)

    def run(batches):
        store, file = _fs(path)
        for batch in batches:
            at = np.asarray(batch.column(0), dtype=np.int64)
            if len(at) and (at.min() < 0 or at.max() >= n):
                raise ValueError("an id is outside the file")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]))
            with store.open_input_file(file) as f:
                parts = [_read_rows(f, int(at[a]), int(at[b - 1]) + 1, 8, d, dtype, out) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.concat_arrays(parts)], names=["id", "vec"])

    wanted = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    dealt = wanted.repartition(F.floor(F.col("id") / rows_per_task)).sortWithinPartitions("id")
    return dealt.mapInArrow(run, f"id long, vec array<{kind}>")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id) of an .ibin file, nearest first."""
    wide = read_vectors(spark, path)
    return wide.select(F.col("id").alias("qid"), F.posexplode("vec").alias("rank", "id"))


def graph_shape(path: str) -> tuple[int, int]:
    """(N, K) of a graph or candidate file, checked against its length, or of a two-dimensional .npy."""
    if path.endswith(".npy"):
        return _npy_header(path)[0]
    store, name = _fs(path)
    with store.open_input_file(name) as f:
        head = f.read(12)
        n, k = int(np.frombuffer(head[:8], "<i8")[0]), int(np.frombuffer(head[8:], "<i4")[0])
        if n < 0 or k <= 0 or f.size() != 12 + 4 * n * k:
            raise ValueError(f"{path}: bad header or length")
    return n, k


def read_graph(spark: SparkSession, path: str, rows_per_task: int = 100_000, start: int = 0, count: int | None = None) -> DataFrame:
    """(src, rank, dst) of a graph or candidate file; ids are unsigned, padding (all bits set, which is also -1) is dropped."""
    n, k = graph_shape(path)
    end = n if count is None else min(n, start + count)
    wide = _scan(spark, path, start, end, rows_per_task, 12, k, np.dtype("<u4"), "nb")
    return wide.select(F.col("id").alias("src"), F.posexplode("nb").alias("rank", "dst")).where(F.col("dst") != NONE)


def _npy_header(path: str):
    store, name = _fs(path)
    with store.open_input_file(name) as f:
        head = io.BytesIO(f.read(4096))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 2 or fortran:
        raise ValueError(f"{path}: not a two-dimensional array in row order")
    return shape, dtype, head.tell()


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 100_000) -> DataFrame:
    """(src, rank, dst) of a two-dimensional integer .npy; ids below -1 are an error, -1 is dropped."""
    shape, dtype, offset = _npy_header(path)
    if dtype.kind not in "iu":
        raise ValueError(f"{path}: not an integer array")
    wide = _scan(spark, path, 0, shape[0], rows_per_task, offset, shape[1], dtype, "nb")
    out = wide.select(F.col("id").alias("src"), F.posexplode("nb").alias("rank", "dst"))
    return out.where(F.assert_true(F.col("dst") >= -1, "an id is below -1").isNull()).where("dst >= 0")


def read_npy_distances(spark: SparkSession, path: str, rows_per_task: int = 100_000) -> DataFrame:
    """(src, rank, dist) of a two-dimensional float .npy; padding (+inf) is dropped."""
    shape, dtype, offset = _npy_header(path)
    if dtype.kind != "f":
        raise ValueError(f"{path}: not a float array")
    wide = _scan(spark, path, 0, shape[0], rows_per_task, offset, shape[1], dtype, "d")
    return wide.select(F.col("id").alias("src"), F.posexplode("d").alias("rank", "dist")).where(F.col("dist") != float("inf"))


def write_blocks(rows: DataFrame, path: str, header: bytes, width: int, dtype: str, n: int, fill=None) -> None:
    """Write (id, values) of ids 0 .. n-1 as header and rows in id order.

    Short, repeated and out-of-range rows are errors, missing ones too unless ``fill``
    names what they hold. On a file system that all mount, every task writes its rows
    at their place in the file; in other stores range-sorted tasks write part files,
    which the driver joins one after the other.
    """
    from pyarrow import fs

    store, name = _fs(path)
    size = width * np.dtype(dtype).itemsize
    local, uri = isinstance(store, fs.LocalFileSystem), path
    sorted_ = rows.select("id", "values").repartitionByRange("id").sortWithinPartitions("id")
    if local:
        os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
        with open(name, "wb") as f:  # the blank row where rows may be missing, else a hole
            f.write(header)
            blank = np.full(width, fill, dtype).tobytes() if fill is not None else b""
            for at in range(0, n if blank else 0, 65_536):
                f.write(blank * min(65_536, n - at))
            f.truncate(len(header) + n * size)

        def place(batches):
            last, written = -1, 0
            with open(name, "r+b") as f:
                for batch in batches:
                    for i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        if len(values) != width or not last < i < n:
                            raise ValueError(f"row {i} is repeated, out of range or of the wrong length")
                        if i != last + 1 or not written:
                            f.seek(len(header) + i * size)
                        f.write(np.asarray(values, dtype).tobytes())
                        last, written = i, written + 1
            yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

        total = sorted_.mapInArrow(place, "n long").agg(F.sum("n")).first()[0] or 0
        if total > n or total < n and fill is None:
            raise ValueError("the rows do not cover 0 .. n-1")
        return
    if fill is not None:
        ids = rows.sparkSession.range(n)
        blank = F.array(*[F.lit(fill)] * width).cast(rows.schema["values"].dataType)
        rows = ids.join(rows, "id", "left").select("id", F.coalesce("values", blank).alias("values"))
        sorted_ = rows.repartitionByRange("id").sortWithinPartitions("id")
    folder = f"{name}.parts-{uuid.uuid4().hex}"

    def run(batches):
        store, _ = _fs(uri)
        out, temp, first, at = None, None, None, None
        for batch in batches:
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(values) != width or at is not None and i != at:
                    raise ValueError(f"row {i} is out of order, repeated or of the wrong length")
                if out is None:
                    store.create_dir(folder, recursive=True)
                    first, at, temp = i, i, f"{folder}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                out.write(np.asarray(values, dtype).tobytes())
                at = i + 1
        if out is not None:
            out.close()
            store.move(temp, f"{folder}/{first:016d}")
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([at], pa.int64())], names=["lo", "hi"])

    parts = sorted_.mapInArrow(run, "lo long, hi long").orderBy("lo").collect()
    if [p.lo for p in parts] != [0, *[p.hi for p in parts[:-1]]][: len(parts)] or (parts[-1].hi if parts else 0) != n:
        raise ValueError("the rows do not cover 0 .. n-1")
    with store.open_output_stream(name) as out:
        out.write(header)
        for p in parts:
            with store.open_input_stream(f"{folder}/{p.lo:016d}") as f:
                while block := f.read(1 << 24):
                    out.write(block)
    if parts:
        store.delete_dir(folder)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(id, vec) as a vector file."""
    n, d = vectors.count(), len(vectors.first()["vec"])
    write_blocks(vectors.select("id", F.col("vec").alias("values")), path, np.array([n, d], "<i4").tobytes(), d, element_type(path).str, n)


def write_graph(wide: DataFrame, path: str, k: int, n: int, fill: int | None = None) -> None:
    """(id, neighbours) as a graph file; -1 is padding."""
    header = np.array([n], "<i8").tobytes() + np.array([k], "<i4").tobytes()
    ids = F.transform("neighbours", lambda x: F.when(x < 0, F.lit(NONE)).otherwise(x).cast("long"))
    write_blocks(wide.select("id", ids.alias("values")), path, header, k, "<u4", n, NONE if fill == -1 else fill)


def write_npy(wide: DataFrame, path: str, k: int, n: int, column: str = "neighbours", dtype: str = "<i8", fill=None) -> None:
    """(id, column) as a two-dimensional .npy; rows that are missing hold ``fill`` if it is given."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": dtype, "fortran_order": False, "shape": (n, k)})
    write_blocks(wide.select("id", F.col(column).alias("values")), path, head.getvalue(), k, dtype, n, fill)


def _write_small(path: str, *parts: np.ndarray) -> None:
    store, name = _fs(path)
    if "/" in name:
        store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        for p in parts:
            f.write(p.tobytes())


def _read_small(path: str) -> bytes:
    store, name = _fs(path)
    with store.open_input_file(name) as f:
        return f.read()


def write_bucket_offsets(layout: DataFrame, path: str) -> None:
    """A layout (pos, lo, hi), one row per bucket, as a bucket offsets file; its ranges must follow one another."""
    rows = [(r.lo, r.hi) for r in layout.select("pos", "lo", "hi").orderBy("pos").collect()]
    cuts = [0, *(hi for _, hi in rows)]
    if [lo for lo, _ in rows] != cuts[:-1] or any(a > b for a, b in zip(cuts, cuts[1:])):
        raise ValueError("the ranges of the buckets do not follow one another")
    _write_small(path, np.array([len(rows)], "<i4"), np.array(cuts, "<u4"))


def read_bucket_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(pos, lo, hi) of a bucket offsets file."""
    raw = _read_small(path)
    n = int(np.frombuffer(raw[:4], "<i4")[0])
    cuts = np.frombuffer(raw[4:], "<u4").tolist()
    if n < 0 or len(cuts) != n + 1 or cuts[0] != 0 or any(a > b for a, b in zip(cuts, cuts[1:])):
        raise ValueError(f"{path}: bad bucket offsets")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "pos int, lo long, hi long")


def write_process_order(order: DataFrame, path: str) -> None:
    """(pos, bucket_id) as a processing order file."""
    rows = [r.bucket_id for r in order.orderBy("pos").select("bucket_id").collect()]
    _write_small(path, np.array([len(rows)], "<i4"), np.array(rows, "<i4"))


def read_process_order(spark: SparkSession, path: str) -> DataFrame:
    """(pos, bucket_id) of a processing order file; it must hold every bucket once."""
    raw = _read_small(path)
    rows = np.frombuffer(raw[4:], "<i4").tolist()
    if int(np.frombuffer(raw[:4], "<i4")[0]) != len(rows) or sorted(rows) != list(range(len(rows))):
        raise ValueError(f"{path}: not an order of all buckets")
    return spark.createDataFrame(list(enumerate(rows)), "pos int, bucket_id long")


def write_permutation(perm: DataFrame, path: str, n: int, inverse: bool = False) -> None:
    """new_id by old_id (or the inverse) as uint32 without a header."""
    key, value = ("new_id", "old_id") if inverse else ("old_id", "new_id")
    write_blocks(perm.select(F.col(key).alias("id"), F.array(value).alias("values")), path, b"", 1, "<u4", n)


def read_permutation(spark: SparkSession, path: str, inverse: bool = False, rows_per_task: int = 1_000_000) -> DataFrame:
    """(old_id, new_id) of a permutation file."""
    store, name = _fs(path)
    with store.open_input_file(name) as f:
        n = f.size() // 4
    rows = _scan(spark, path, 0, n, rows_per_task, 0, 1, np.dtype("<u4"), "v").select("id", F.col("v")[0].alias("v"))
    a, b = ("new_id", "old_id") if inverse else ("old_id", "new_id")
    return rows.select(F.col("id").alias(a), F.col("v").alias(b)).select("old_id", "new_id")


def write_bucket_files(assignment: DataFrame, buckets: DataFrame, index_path: str, data_path: str) -> None:
    """bucket_index.bin and bucket_data.bin of an assignment: the ids of each bucket in order, one bucket after the other."""
    sizes = buckets.select("bucket_id").join(assignment.groupBy("bucket_id").agg(F.count("*").alias("n")), "bucket_id", "left").orderBy("bucket_id")
    counts = [r.n or 0 for r in sizes.select("bucket_id", "n").collect()]  # one row per bucket
    first = np.cumsum([0, *counts])
    entries = np.zeros(len(counts), np.dtype([("at", "<i8"), ("n", "<i4")]))
    entries["at"], entries["n"] = 4 * first[:-1], counts
    _write_small(index_path, np.array([len(counts), first[-1]], "<i8"), entries)
    starts = assignment.sparkSession.createDataFrame([(b, int(x)) for b, x in enumerate(first[:-1])], "bucket_id long, lo long")
    w = Window.partitionBy("bucket_id").orderBy("id")
    placed = assignment.withColumn("rn", F.row_number().over(w) - 1).join(starts, "bucket_id")
    write_blocks(placed.select((F.col("lo") + F.col("rn")).alias("id"), F.array("id").alias("values")), data_path, b"", 1, "<i4", int(first[-1]))


def read_bucket_files(spark: SparkSession, index_path: str, data_path: str) -> DataFrame:
    """(id, bucket_id) of bucket_index.bin and bucket_data.bin; counts that do not add up are an error."""
    raw = _read_small(index_path)
    count, total = np.frombuffer(raw[:16], "<i8").tolist()
    entries = np.frombuffer(raw[16:], np.dtype([("at", "<i8"), ("n", "<i4")]))
    store, name = _fs(data_path)
    with store.open_input_file(name) as f:
        if len(entries) != count or int(entries["n"].sum()) != total or f.size() != 4 * total:
            raise ValueError(f"{index_path}: the counts do not add up")
    table = spark.createDataFrame([(i, int(e["at"]), int(e["n"])) for i, e in enumerate(entries)], "bucket_id long, at long, n long")

    def run(batches):
        store, file = _fs(data_path)
        for batch in batches:
            with store.open_input_file(file) as f:
                for b, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    f.seek(at)
                    ids = np.frombuffer(f.read(4 * n), "<i4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, b, np.int64))], names=["id", "bucket_id"])

    return table.mapInArrow(run, "id long, bucket_id long")


def generate_vectors(spark: SparkSession, n: int, dim: int = 128, seed: int = 0) -> DataFrame:
    """n synthetic standard-normal vectors."""
    return spark.range(n).select("id", F.array(*(F.randn(seed + i).cast("float") for i in range(dim))).alias("vec"))
