"""Quality classifier: document evidence and hierarchical empirical Bayes over sites.

A logistic regression on whole-text features, fitted on a bounded sample of the
labelled documents (``sample_docs``, the smallest hashes of their ids), gives
every document a logit. The probabilities of all documents are summed per path
and per host. A path's rate is shrunk towards its host's, a host's towards the
corpus rate; the strengths of both priors come from the between-group variance
(method of moments), so sparse sites fall back to their parents. The final logit
is the evidence plus the path posterior's offset from the corpus rate.

The documents table has no URL, so the query takes ``source`` as host and
``lang`` within it as path; both are parameters.

Scale: group sums are combined map-side, so one source with a third of the rows
costs nothing extra. The posteriors of all groups go back to the rows by a join
that is a broadcast only when the counted groups fit ``broadcast_groups``;
beyond that the rows of a hot group are dealt to several copies of its posterior.

Defined cases: texts that are null or without words are rejected; null hosts and
paths are groups of their own; labels without an id or a label are not used; of
several labels of a document the smallest counts; without labels of both classes
the evidence is 0 and everything that has words is kept; repeated documents are
judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmesh.llm.batches import cuts
from nearmesh.llm.common import WORD_BYTES, fresh, looked_up, write_table

NO_WORDS = -30.0
_SYMBOLS = b"#$%&*|!~^<>{}[]=+@_\\/"


def features(text: str | None) -> list[float] | None:
    """Features of a whole text; None if it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_BYTES).split()
    if not words:
        return None
    n, total = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper = counts[97:123].sum(), counts[65:91].sum()
    letters = max(1, lower + upper)
    symbols = sum(int(counts[b]) for b in _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n),
        math.log1p(n) ** 2,
        total / n,
        upper / letters,
        counts[48:58].sum() / total,
        symbols / n,
        counts[124] / n,
        counts[33] / n,
        (counts[44] + counts[46]) / n,
        distinct / n,
        math.log(distinct) / math.log1p(n),
        (pairs + 1) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        counts[10] / n,
        sum(len(w) for w in words) / n,
        (counts[128:].sum()) / total,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40):
    """Newton's method on standardised features; returns (weights, mean, scale), bias last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x) / 100)
    penalty[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = 6000, label_id: str = "doc_id"):
    """The evidence model, or None without labels of both classes.

    ``sample_docs`` bounds the labelled documents that it is fitted on, those with the
    smallest hashes of their ids: at most that many rows of features (not texts) reach
    the driver. Of several texts of an id the one with the least features counts.
    """
    known = labels.select(F.col(label_id).alias("i"), F.col(label).alias("y")).where("i is not null and y is not null")
    known = known.groupBy("i").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(sample_docs)  # a bounded table

    def featured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for a, n in cuts(texts) for t in texts.slice(a, n).to_pylist()], pa.list_(pa.float64()))

    vector = F.arrow_udf(featured, T.ArrayType(T.DoubleType()))
    rows = (
        docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
        .join(F.broadcast(chosen), F.col("d") == F.col("i"))
        .select("d", "y", vector("t").alias("x"))
        .where("x is not null")
        .groupBy("d", "y").agg(F.min("x").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (r.d, r.x))
    y = np.array([r.y > 0 for r in rows], dtype=float)
    if len(rows) == 0 or y.min() == y.max():
        return None
    return fit_logistic(np.array([r.x for r in rows]), y)


def evidence(model):
    """UDF: logit of a text under ``model``."""

    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for i, text in enumerate(t for a, n in cuts(texts) for t in texts.slice(a, n).to_pylist()):
            x = features(text)
            if x is None:
                out[i] = NO_WORDS
            elif model is not None:
                w, mean, scale = model
                out[i] = float(np.clip((np.array(x) - mean) / scale, -8, 8) @ w[:-1] + w[-1])
        return pa.array(np.clip(out, NO_WORDS, -NO_WORDS))

    # Not deterministic to the optimizer: it would copy the scoring below filters on the score.
    return F.arrow_udf(score, T.DoubleType()).asNondeterministic()


def _sigmoid(c):
    return 1 / (1 + F.exp(-c))


def _logit(p):
    return F.log(p / (1 - p))


def posteriors(scores: DataFrame) -> DataFrame:
    """Per (host, path): n, host_posterior, path_posterior, offset; from columns host, path, logit of all documents."""
    paths = scores.where(F.col("logit") > NO_WORDS).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(_sigmoid(F.col("logit"))).alias("s"))
    paths = write_table(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def strength(groups: DataFrame, n: str, s: str, mean, total: float, overall: float) -> float:
        row = groups.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - mean) ** 2).alias("between"), F.count("*").alias("g")).first()
        spread = overall * (1 - overall)
        tau = (row["between"] or 0.0) / total - spread * row["g"] / total
        return min(1e6, max(1.0, spread / tau - 1)) if tau > 0 else 1e6

    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    total = float(whole["n"] or 1)
    overall = min(1 - 1e-6, max(1e-6, float(whole["s"] or 0.5) / total))
    k_host = strength(hosts, "hn", "hs", F.lit(overall), total, overall)
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + k_host * overall) / (F.col("hn") + k_host))
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    k_path = strength(both, "n", "s", F.col("host_posterior"), total, overall)
    post = (F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)
    out = both.withColumn("path_posterior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), post)))
    out = out.withColumn("offset", _logit(F.col("path_posterior")) - math.log(overall / (1 - overall)))
    return write_table(out.select("host", "path", "n", "host_posterior", "path_posterior", "offset"), "posteriors")


def _joined(rows: DataFrame, groups: DataFrame, host: str, path: str, broadcast_groups: int) -> DataFrame:
    h, p = fresh(rows, "nm_host", "nm_path")
    side = groups.withColumnsRenamed({"host": h, "path": p})
    return looked_up(rows, side, [(host, h), (path, p)], groups.count() <= broadcast_groups)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    threshold: float = 0.5, sample_docs: int = 6000, broadcast_groups: int = 100_000, label_id: str = "doc_id",
) -> DataFrame:
    """Per document: doc_id, evidence, host_posterior, path_posterior, score, keep."""
    model = train(docs, labels, doc_id, text, sample_docs=sample_docs, label_id=label_id)
    scores = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), evidence(model)(F.col(text)).alias("logit"))
    return judged(write_table(scores, "scores"), threshold, broadcast_groups)


def judged(scores: DataFrame, threshold: float = 0.5, broadcast_groups: int = 100_000) -> DataFrame:
    """The decisions on rows (doc_id, host, path, logit)."""
    out = _joined(scores, posteriors(scores), "host", "path", broadcast_groups)
    score = _sigmoid(F.col("logit") + F.coalesce("offset", F.lit(0.0)))
    return out.select("doc_id", F.col("logit").alias("evidence"), "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).alias("keep"))


def accepted(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    threshold: float = 0.5, sample_docs: int = 6000, broadcast_groups: int = 100_000, label_id: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs``.

    The texts are scored twice, once for the sums and once for the decision, so
    that they are never shuffled.
    """
    model = train(docs, labels, doc_id, text, sample_docs=sample_docs, label_id=label_id)
    h, p, logit = F.col(host).cast("string"), F.col(path).cast("string"), evidence(model)(F.col(text))
    groups = posteriors(docs.select(h.alias("host"), p.alias("path"), logit.alias("logit")))
    a, b, c, d = fresh(docs, "nm_h", "nm_p", "nm_logit", "nm_offset")
    rows = docs.withColumn(a, h).withColumn(b, p).withColumn(c, logit)
    out = _joined(rows, groups.select("host", "path", F.col("offset").alias(d)), a, b, broadcast_groups)
    score = _sigmoid(F.col(c) + F.coalesce(F.col(d), F.lit(0.0)))
    return out.where(score >= threshold).select(*(F.col(x) for x in docs.columns))
