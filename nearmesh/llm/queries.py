"""The query and the SQL of each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmesh.llm import decontaminate, mixing, near_dedup, pii, quality, secrets, sharding, token_output, topk_search, url_filter
from nearmesh.llm.common import read

#: The secret of the pseudonyms; a deployment passes its own.
PII_KEY = b"nearmesh demonstration key"
#: The key of the training order.
ORDER_KEY = 20260
#: Bytes of a shard in the query that shows splits and pages.
SMALL_LIMIT = 40_000


def op1_token_output(spark, sf_dir):
    return token_output.training_order(read(spark, sf_dir, "documents"), ORDER_KEY)


def op2_decontaminate(spark, sf_dir):
    out = decontaminate.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.drop("items")


def op3_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op4_quality_classifier(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_sharding(spark, sf_dir):
    return sharding.assign_shards(read(spark, sf_dir, "documents"))


def sharding_small_limit(spark, sf_dir):
    """As op5, with so low a limit that buckets split many times and large texts overflow."""
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SMALL_LIMIT)


def op8_pii(spark, sf_dir):
    return pii.pseudonymise(read(spark, sf_dir, "documents"), PII_KEY)


def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secrets.secret_digest(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op10_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_topk_search(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sharding": op5_sharding,
    "sharding_small_limit": sharding_small_limit,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_topk_search": op7_topk_search,
    "op8_pii": op8_pii,
    "op9_secret_scan": op9_secret_scan,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op5_sharding": sharding.oracle(),
    "sharding_small_limit": sharding.oracle(SMALL_LIMIT),
    "op6_minhash_near_dedup": near_dedup.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op10_mixing": mixing.oracle(),
}
