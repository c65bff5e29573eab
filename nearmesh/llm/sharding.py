"""Byte-bounded sharding by extendible hashing.

A document's key is 60 bits of the MD5 of its id and text. The directory starts
with depth 0; a bucket whose bytes exceed the limit, and only such a bucket,
splits on the next bit of the key, until every bucket fits. Buckets are leaves of
a prefix tree, so each document belongs to exactly one.

The loop over depths works on a histogram of key prefixes (about 256 cells per
expected shard), not on documents. Only if a single cell is still too large are
the documents of that cell read again with more bits. Rows whose 60 bits are all
equal (wholly identical rows, or one row above the limit) cannot be told apart by
any bit; such a bucket is cut into numbered overflow pages that each fit, or hold
one row. Pages are numbered with counts per task, so no group meets in one task.

Scale: the texts are read once and never shuffled; the histogram is combined
map-side; documents meet the directory in an equi-join on (depth, prefix) with
one candidate row per depth in use.

Defined cases: null texts have 0 bytes, null ids are keyed as empty; an empty
table has no shards; repeated rows are placed each; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmesh.llm.common import write_table

BITS = 60
LIMIT = 32 << 20


def key_of(doc_id, text):
    """60-bit key column of a document."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(key, have: int, want: int):
    return F.shiftright(key, have - want)


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(depth, prefix, bytes) of all buckets that fit, and the full keys that no bit can split.

    ``rows`` has the columns key and bytes.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, 8 + max(0, math.ceil(math.log2(max(1.0, total / limit)))))
    open_ = write_table(rows.groupBy(_prefix(F.col("key"), BITS, bits).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
    done, depth = [], 0
    while True:
        if depth > bits:  # cells that are still too large: look at their documents with more bits
            more = min(BITS, bits + 16)
            inside = rows.withColumn("cell", _prefix(F.col("key"), BITS, bits)).join(open_.select("cell").distinct(), "cell", "left_semi")
            open_ = write_table(inside.groupBy(_prefix(F.col("key"), BITS, more).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
            bits = more
        sums = open_.groupBy(_prefix(F.col("cell"), bits, depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        sums = write_table(sums, "buckets")
        done.append(sums.where(F.col("bytes") <= limit).select(F.lit(depth).alias("depth"), "prefix", "bytes"))
        over = sums.where(F.col("bytes") > limit).select(F.col("prefix").alias("big"))
        if over.isEmpty():
            return reduce(DataFrame.unionByName, done), None
        if depth == BITS:
            return reduce(DataFrame.unionByName, done), over.select(F.col("big").alias("key"))
        open_ = open_.join(over, _prefix(open_["cell"], bits, depth) == F.col("big"), "left_semi")
        if depth % 8 == 7:
            open_ = write_table(open_, "cells")
        depth += 1


def assign_shards(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, shard (its prefix bits, with ``.page`` on overflow), depth, shard_bytes."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        key_of(F.col(doc_id), F.col(text)).alias("key"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        F.spark_partition_id().alias("task"),
    )
    rows = write_table(rows, "keys")
    buckets, single = directory(rows.select("key", "bytes"), limit)
    buckets = write_table(buckets.coalesce(8), "directory")
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # at most 61
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    shards = buckets.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), bits.alias("shard"))
    tries = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(F.col("key"), BITS, d).alias("prefix")) for d in depths)).cast("array<struct<depth:int,prefix:bigint>>")
    out = (
        rows.select("doc_id", "bytes", F.explode(tries).alias("t"))
        .select("doc_id", F.col("bytes").alias("n_bytes"), "t.depth", "t.prefix")
        .join(shards, ["depth", "prefix"])
        .select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")
    )
    return out if single is None else out.unionByName(_overflow(rows.join(single, "key", "left_semi"), limit))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Numbered pages for rows that share their whole key."""
    counts = rows.groupBy("key", "task").agg(F.count("*").alias("c"), F.max("bytes").alias("most"))
    before = F.sum("c").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "task", F.coalesce(before, F.lit(0)).alias("before"), F.max("most").over(Window.partitionBy("key")).alias("most"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("key", "task").orderBy("doc_id", "bytes")) - 1).join(counts, ["key", "task"])
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("most")))
    paged = numbered.withColumn("page", F.floor((F.col("before") + F.col("at")) / per_page))
    sizes = paged.groupBy("key", "page").agg(F.sum("bytes").alias("shard_bytes"))
    shard = F.concat(F.expr(f"lpad(bin(key), {BITS}, '0')"), F.lit("."), F.col("page").cast("string"))
    return paged.join(sizes, ["key", "page"]).select("doc_id", F.col("bytes").alias("n_bytes"), shard.alias("shard"), F.lit(BITS).alias("depth"), "shard_bytes")


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL of ``assign_shards``. Rows above the limit are pages of their own; it states no pages of several equal rows."""
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
e AS (SELECT rid, doc_id, n_bytes, key, unnest(range(0, {BITS + 1})) AS depth FROM k),
p AS (SELECT rid, doc_id, n_bytes, depth, key >> ({BITS} - depth) AS prefix FROM e),
s AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM p GROUP BY depth, prefix),
j AS (SELECT p.*, s.shard_bytes, row_number() OVER (PARTITION BY rid ORDER BY p.depth) AS rn
  FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix WHERE s.shard_bytes <= {limit} OR p.depth = {BITS})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END || CASE WHEN shard_bytes > {limit} THEN '.0' ELSE '' END AS shard,
  CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM j WHERE rn = 1
"""
