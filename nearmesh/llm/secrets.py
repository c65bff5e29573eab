"""Secret scan: fixed patterns plus character Markov models (DataFrame functions only).

Base patterns give spans per kind, leftmost and non-overlapping. The method adds
spans of kind ``markov``: long tokens whose characters are likelier under a
first-order Markov model of random strings than under one of ordinary
identifiers, by a log-likelihood ratio of at least ``threshold`` nats. Both
models are counted from labelled samples (token, is_random).

Positions come from splitting a text at the matches: the lengths of pieces and
matches, summed in blocks of 256, give every start in near-linear time.

Scale: one map-side projection over whole texts, no shuffle, no Python. Cheap
substring tests decide whether a text needs a pattern at all. The models are two
tables of 67 x 67 log-probabilities, whatever the size of the corpus; the sample
that they are counted from is bounded by ``sample_docs``.

Defined cases: null text is an empty text with no spans; repeated rows are
scanned each; an empty table gives an empty result; without samples of both
labels the method adds nothing; columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the contract.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX_RUN = r"[0-9a-f]{16,}"  # a maximal run of 16 or more is the same as a run, kept if it has 16

#: Tokens that the models judge, and their alphabet; every other character is class 0.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
WIDTH = len(ALPHABET) + 1
THRESHOLD = 12.0
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
_BLOCK = 256


def _sum(arr):
    return F.aggregate(arr, F.lit(0), lambda s, x: s + x)


def _starts(lens):
    """Exclusive prefix sums of an array of ints."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: _sum(F.slice(blocks, F.lit(1), b)))
    return F.transform(lens, lambda _, i: F.get(before, F.floor(i / _BLOCK).cast("int")) + _sum(F.slice(lens, i - i % _BLOCK + 1, i % _BLOCK)))


def _spans(df: DataFrame, name: str, pattern: str, gate, rank: int, keep=None) -> DataFrame:
    """Adds array ``name`` of the spans of ``pattern`` in column t, where ``gate`` holds."""
    none = F.array().cast("array<string>")
    df = df.withColumn("m_", F.when(gate, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("g_", F.when(F.size("m_") > 0, F.split("t", pattern, -1)).otherwise(none))
    df = df.withColumn("gl_", F.transform("g_", lambda x: F.length(x))).withColumn("ml_", F.transform("m_", lambda x: F.length(x)))
    df = df.withColumn("lens_", F.zip_with(F.slice("gl_", F.lit(1), F.size("ml_")), "ml_", lambda a, b: a + b))
    df = df.withColumn("at_", F.when(F.size("m_") > 0, _starts(F.col("lens_"))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(
        "all_",
        F.transform(
            "at_",
            lambda a, i: F.struct(
                (a + F.get("gl_", i)).alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), (a + F.get("lens_", i)).alias("end")
            ),
        ),
    )
    df = df.withColumn(name, F.when(F.size("m_") > 0, keep(F.col("all_"), F.col("m_"))).otherwise(F.array().cast(_SPANS)) if keep else F.col("all_"))
    return df.drop("m_", "g_", "gl_", "ml_", "lens_", "at_", "all_")


def default_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 400, n_random: int = 4000) -> DataFrame:
    """Labelled samples (token, is_random).

    Random: strings in the usual alphabets (hex, base64, upper-case base 36),
    made from SHA-256, and what the base patterns find in the sampled documents.
    Ordinary: identifiers made of their other words. Sampled are at most
    ``sample_docs`` documents, those with the smallest hashes of their ids.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    kinds = [F.substring(digest, 1, 40), F.substring(b64, 1, 40), F.substring(F.upper(F.translate(b64, "+/=", "")), 1, 24), F.substring(F.translate(b64, "+/", "-_"), 1, 32)]
    random = spark.range(n_random, numPartitions=1).select(F.element_at(F.array(*kinds), (F.col("id") % 4 + 1).cast("int")).alias("token"), F.lit(True).alias("is_random"))
    ids = docs.select(F.col(doc_id).alias("i")).where("i is not null").orderBy(F.xxhash64("i"), "i").limit(sample_docs).distinct()
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(ids), F.col("d") == F.col("i")).select("t")
    texts = texts.dropDuplicates()  # of a bounded table
    values = F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX_RUN), F.lit(0)))
    known = texts.select(F.explode(values).alias("token"), F.lit(True).alias("is_random")).where(F.length("token") >= 16)
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z]{3,18}"), F.lit(0))).alias("w"))
    w, low = F.col("w"), F.lower("w")
    forms = F.array(w, low, F.upper(w), F.concat(low, F.lit("_"), low), F.concat(F.lit("get"), F.initcap(w), F.lit("Id1")), F.concat(low, F.lit("-"), low, F.lit("-2")), F.concat(F.lit("/"), low, F.lit("/"), low))
    plain = words.select(F.explode(forms).alias("token"), F.lit(False).alias("is_random"))
    return random.unionByName(known).unionByName(plain)


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each character pair, row by row; None without samples of both labels.

    At most 2 * WIDTH ** 2 counts reach the driver.
    """
    code = lambda i: F.expr(f"instr('{ALPHABET}', substring(token, {i}, 1))")
    pairs = (
        samples.where("token is not null and is_random is not null and length(token) > 1")
        .select("token", "is_random", F.explode(F.sequence(F.lit(2), F.length("token"))).alias("i"))
        .select("is_random", (code("i - 1") * WIDTH + code("i")).alias("pair"))
        .groupBy("is_random", "pair").count()
    )
    counts = {True: [0.5] * WIDTH**2, False: [0.5] * WIDTH**2}
    seen = set()
    for random, pair, n in pairs.collect():
        counts[random][pair] += n
        seen.add(random)
    if len(seen) < 2:
        return None
    log = {}
    for label, c in counts.items():
        rows = [sum(c[a * WIDTH : (a + 1) * WIDTH]) for a in range(WIDTH)]
        log[label] = [math.log(x / rows[i // WIDTH]) for i, x in enumerate(c)]
    return [round(a - b, 4) for a, b in zip(log[True], log[False])]


def log_ratio(token, model: list[float]):
    """Sum of the pair ratios of a token column."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to a literal
    codes = F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    n = F.length(token)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    fold = F.aggregate(
        F.slice(codes, F.lit(1), n), start,
        lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(table, s["last"] * WIDTH + c))).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(n > 0, fold).otherwise(0.0)


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample_docs: int = 400) -> DataFrame:
    """Per row: doc_id, base and markov arrays of (start, rank, kind, end), ends exclusive, in code points."""
    model = train(samples if samples is not None else default_samples(docs, doc_id, text, sample_docs))
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    low = F.lower("t")
    asks = low.contains("passw") | low.contains("secret") | low.contains("token") | (low.contains("api") & low.contains("key"))
    df = df.withColumn("v_", F.when(asks, F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    values = lambda spans, m: F.filter(spans, lambda s, i: F.get("v_", i) >= 12)
    df = _spans(df, "assign", ASSIGN, F.size("v_") > 0, 1, values).drop("v_")
    df = _spans(df, "access", ACCESS, F.col("t").contains("AKIA"), 2, lambda spans, m: F.filter(spans, lambda s: s["end"] - s["start"] >= 18))
    df = _spans(df, "hex", HEX_RUN, F.col("t").rlike(HEX_RUN), 3)
    if model is None:
        df = df.withColumn("markov", F.array().cast(_SPANS))
    else:
        judged = lambda spans, m: F.filter(spans, lambda s, i: log_ratio(F.get(m, i), model) >= threshold)
        df = _spans(df, "markov", TOKEN, F.col("t").rlike(TOKEN), 4, judged)
    return df.select("doc_id", "assign", "access", "hex", "markov", F.array_sort(F.concat("assign", "access", "hex")).alias("base"))


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """The digest columns of the contract from the spans of ``scan_secrets``."""
    n = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )


def samples_table(spark: SparkSession, rows: list[tuple[str, bool]]) -> DataFrame:
    """Labelled samples from a list."""
    return spark.createDataFrame(rows, "token string, is_random boolean")
