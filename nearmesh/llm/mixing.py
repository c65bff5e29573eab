"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Tokens are summed per cell (source, language, topic). The cell weights are raked:
each round scales them so that the source, then the language, then the topic
marginal meets its target. The ratio of a cell's weight to its share of tokens is
its rate; rates are scaled so that the largest is 1, and a document is sampled
if a uniform number made from its id is below its cell's rate. So expected tokens
meet all three marginals, and the same document is always decided alike.

A sparse cell can have a rate far above all others. Where the largest rate of 1
would keep less than the share ``least`` of the tokens that have a target, all
rates are raised alike until that share is kept, and cut at 1: a cell cut at 1
is kept whole and falls short of its target, the others share what it lacks.

The documents table has no topic; without a topic column the length class of the
document (short, medium, long by words) stands in. Targets are tables (value,
share); without one a marginal is tempered: share ** alpha of the corpus.

Scale: cells are summed map-side; a hot source is one cell per language and
topic. Raking runs on the cell table alone: in one task while the counted cells
are at most ``one_task_cells`` (no shuffle per round), else distributed. Lineage is
cut every four rounds. Cells reach the documents by a join, a broadcast only below
the same counted bound, beyond it dealt to several copies of each cell.

Defined cases: null source, language or topic is a value of its own; a value
without a target gets share 0 and is never sampled, a target without documents is
ignored and the others are scaled up; documents without tokens are never sampled;
targets that no weights can meet leave a residual (``residuals``), the last raked
marginal (topic) being met; a null id has a fixed uniform number; repeated rows are decided alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmesh.llm.common import fresh, looked_up, write_table

WORD = "[^ \\n\\t\\r\\f]+"
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 12
#: Least share of the tokens that is kept in expectation, however sparse a cell.
LEAST = 0.25


def n_words(text):
    """Words of a text column, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_class(n):
    return F.when(n < 150, "short").when(n < 600, "medium").otherwise("long")


def uniform(doc_id):
    """A number in [0, 1) made from an id."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cell_table(rows: DataFrame) -> DataFrame:
    """Tokens t per (source, lang, topic), from rows with a column n_tokens."""
    return rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("t")).where("t > 0")


def _targets(cells: DataFrame, dim: str, targets: DataFrame | None) -> DataFrame:
    """(value, share) of the values that occur, summing to 1."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("t").alias("t"))
    if targets is None:
        sums = sums.select("value", F.pow("t", F.lit(ALPHAS[dim])).alias("share"))
    else:
        given = targets.groupBy(F.col("value").alias("v")).agg(F.sum("share").alias("share"))
        sums = sums.join(given, F.col("value").eqNullSafe(F.col("v")), "left").select("value", F.coalesce("share", F.lit(0.0)).alias("share"))
    total = sums.agg(F.sum("share")).first()[0] or 0.0
    share = F.col("share") / F.lit(float(total)) if total else F.lit(0.0)
    return sums.select(F.col("value").alias(f"{dim}_v"), share.alias(f"{dim}_target"))


def _full_rate(cells: DataFrame, least: float) -> float:
    """The w / t that gets the rate 1: the largest, or the lower one at which ``least`` of the tokens of weighted cells are kept.

    Kept tokens are concave in the inverse and linear between cells, so Newton steps from
    the largest end at the exact value; each is one aggregate, most tables need none.
    """
    ratio = F.col("w") / F.col("t")
    cells = cells.where("w > 0")
    full, tokens, rest = cells.agg(F.max(ratio), F.sum("t"), F.sum("w")).first()
    if full is None:
        return 1.0
    capped = 0.0
    while capped + rest / full < least * tokens * (1 - 1e-9):
        full = rest / (least * tokens - capped)
        over = ratio >= F.lit(full)
        capped, rest = cells.agg(F.sum(F.when(over, F.col("t")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
    return full


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, one_task_cells: int = 100_000, least: float = LEAST) -> DataFrame:
    """Cells with the raked weight w (summing to 1 up to convergence) and the rate (0 to 1)."""
    cells = write_table(cells, "cells")
    small = cells.count() <= one_task_cells
    out = cells
    for dim in ALPHAS:
        side = _targets(cells, dim, (targets or {}).get(dim))
        out = out.join(side, F.col(dim).eqNullSafe(F.col(f"{dim}_v")), "left").drop(f"{dim}_v")
    out = write_table(out.withColumn("w", F.col("t")), "raked")
    for begin in range(0, rounds, 4):
        out = out.coalesce(1) if small else out
        for _ in range(min(4, rounds - begin)):
            for dim in ALPHAS:
                total = F.sum("w").over(Window.partitionBy(dim))
                out = out.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"{dim}_target") / total).otherwise(0.0))
        out = write_table(out, "raked")
    full = _full_rate(out, least)
    return out.select("source", "lang", "topic", "t", "w", F.least(F.lit(1.0), F.col("w") / F.col("t") / F.lit(full)).alias("rate"))


def residuals(raked: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dim, value, target, weight, residual) per marginal value after raking: how far targets are from being met (unreachable ones stay so)."""
    out = None
    for dim in ALPHAS:
        side = _targets(raked.select("source", "lang", "topic", "t"), dim, (targets or {}).get(dim))
        sums = raked.groupBy(F.col(dim).alias("value")).agg(F.sum("w").alias("weight"))
        part = sums.join(side, F.col("value").eqNullSafe(F.col(f"{dim}_v"))).select(F.lit(dim).alias("dim"), "value", F.col(f"{dim}_target").alias("target"), "weight")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("residual", F.abs(F.col("weight") - F.col("target")))


def _with_keys(docs: DataFrame, text: str, source: str, lang: str, topic: str | None) -> tuple[DataFrame, list[str]]:
    names = fresh(docs, "nm_tokens", "nm_source", "nm_lang", "nm_topic")
    out = docs.withColumn(names[0], n_words(F.col(text)))
    kind = length_class(F.col(names[0])) if topic is None else F.col(topic).cast("string")
    return out.withColumn(names[1], F.col(source).cast("string")).withColumn(names[2], F.col(lang).cast("string")).withColumn(names[3], kind), names


def _meet(rows: DataFrame, keys: list[str], cells: DataFrame, one_task_cells: int) -> tuple[DataFrame, str]:
    """``rows`` with the rate of their cell, and the name of that column."""
    names = fresh(rows, "nm_c_source", "nm_c_lang", "nm_c_topic", "nm_w", "nm_rate")
    side = write_table(cells.select(*(F.col(a).alias(b) for a, b in zip(("source", "lang", "topic", "w", "rate"), names))), "rates")
    return looked_up(rows, side, list(zip(keys, names[:3])), side.count() <= one_task_cells).drop(*names[:4]), names[4]


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", topic: str | None = None, rounds: int = ROUNDS, one_task_cells: int = 100_000, least: float = LEAST,
) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, rate, sampled."""
    keyed, k = _with_keys(docs, text, source, lang, topic)
    rows = keyed.select(F.col(doc_id).alias("doc_id"), *(F.col(a).alias(b) for a, b in zip(k, ("n_tokens", "source", "lang", "topic"))))
    rows = write_table(rows, "words")
    out, own = _meet(rows, ["source", "lang", "topic"], rake(cell_table(rows), targets, rounds, one_task_cells, least), one_task_cells)
    rate = F.when(F.col("n_tokens") > 0, F.coalesce(own, F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round(rate, 6).alias("rate"), (uniform(F.col("doc_id")) < rate).alias("sampled"))


def mixed(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", topic: str | None = None, rounds: int = ROUNDS, one_task_cells: int = 100_000, least: float = LEAST,
) -> DataFrame:
    """The sampled rows of ``docs``, with the columns of ``docs``; texts are not shuffled while the cells are few."""
    keyed, k = _with_keys(docs, text, source, lang, topic)
    sums = keyed.select(*(F.col(a).alias(b) for a, b in zip(k, ("n_tokens", "source", "lang", "topic"))))
    out, own = _meet(keyed, k[1:], rake(cell_table(sums), targets, rounds, one_task_cells, least), one_task_cells)
    return out.where((F.col(k[0]) > 0) & (uniform(F.col(doc_id)) < F.coalesce(own, F.lit(0.0)))).select(*(F.col(c) for c in docs.columns))


def oracle() -> str:
    """DuckDB SQL of ``mix`` with tempered marginals: one statement per scaling."""
    sql = [
        "d AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\n\\t\\r\\f]+')) AS BIGINT) AS n_tokens FROM documents)",
        "k AS (SELECT *, CASE WHEN n_tokens < 150 THEN 'short' WHEN n_tokens < 600 THEN 'medium' ELSE 'long' END AS topic FROM d)",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM k GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for dim, alpha in ALPHAS.items():
        sql.append(f"g_{dim} AS MATERIALIZED (SELECT {dim} AS v, pow(t, {alpha}) / sum(pow(t, {alpha})) OVER () AS share FROM (SELECT {dim}, sum(t) AS t FROM c GROUP BY {dim}))")
    joins = " ".join(f"JOIN g_{d} ON c.{d} IS NOT DISTINCT FROM g_{d}.v" for d in ALPHAS)
    sql.append(f"r0 AS MATERIALIZED (SELECT c.*, {', '.join(f'g_{d}.share AS {d}_s' for d in ALPHAS)}, t AS w FROM c {joins})")
    n = 0
    for _ in range(ROUNDS):
        for dim in ALPHAS:
            sql.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE (w * {dim}_s / sum(w) OVER (PARTITION BY {dim}) AS w) FROM r{n})")
            n += 1
    # The rate 1 goes to the largest w / t, or to the value at which LEAST of the tokens are kept with all larger ones cut at 1.
    sql.append(f"b AS (SELECT t, w, w / t AS r, sum(t) OVER (ORDER BY w / t DESC) AS above, sum(w) OVER () - sum(w) OVER (ORDER BY w / t DESC) AS below, {LEAST} * sum(t) OVER () AS need FROM r{n} WHERE w > 0)")
    sql.append("e AS (SELECT *, above + below / r < need * (1 - 1e-9) AS cut FROM b)")
    sql.append("f AS MATERIALIZED (SELECT CASE WHEN bool_or(cut) THEN sum(w) FILTER (WHERE NOT cut) / (max(need) - sum(t) FILTER (WHERE cut)) ELSE max(r) END AS full_rate FROM e)")
    sql.append(f"z AS (SELECT source, lang, topic, least(1.0, w / t / full_rate) AS rate FROM r{n}, f)")
    sql.append("j AS (SELECT k.*, coalesce(rate, 0) AS rate FROM k LEFT JOIN z ON k.source IS NOT DISTINCT FROM z.source AND k.lang IS NOT DISTINCT FROM z.lang AND k.topic = z.topic)")
    unit = "CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0"
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, ({unit}) < rate AS sampled FROM j"
