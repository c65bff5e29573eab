"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmesh.session import materialise

#: Maps A-Z to a-z, keeps 0-9, a-z and all bytes of non-ASCII characters, and
#: turns every other byte into a space, so that split() yields the words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) UTF-8 words of a text; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    return materialise(df, name, compression)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names, made from ``wanted``, that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def same(a, b):
    """Null-safe equality of two columns."""
    return a.eqNullSafe(b)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Parts that the rows of one key are dealt to by ``looked_up``.
SALTS = 16


def looked_up(rows: DataFrame, side: DataFrame, on: list[tuple[str, str]], small: bool) -> DataFrame:
    """Left join, null-safe on pairs of columns, to a table with one row per key.

    A ``small`` (counted) side is broadcast. Otherwise each of its rows is repeated SALTS
    times and the rows are dealt evenly among the copies, so a hot key is many tasks.
    """
    keys = [F.col(a).eqNullSafe(F.col(b)) for a, b in on]
    if small:
        return rows.join(F.broadcast(side), reduce(lambda x, y: x & y, keys), "left")
    salt, copy = fresh(rows, "nm_salt", "nm_copy")
    dealt = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = side.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, reduce(lambda x, y: x & y, [*keys, F.col(salt) == F.col(copy)]), "left").drop(salt, copy)
