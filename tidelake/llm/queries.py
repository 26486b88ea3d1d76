"""The thin queries opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_documents
from .common import documents
from .langid import train_and_identify
from .merkle import fingerprint_documents
from .mixing import mix_sizes
from .quality import score_quality
from .secrets import scan
from .sharding import uniform_shards
from .simhash import near_duplicates
from .toxicity import train_and_score


def op1_bloom_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_identify(documents(spark, sf_dir))


def op2_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(documents(spark, sf_dir))


def op4_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprint_documents(documents(spark, sf_dir))
    return prints.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits")


def op7_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_copied")


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards(documents(spark, sf_dir))


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


# The parts of those results that SQL can express too, each by the operator.


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def mix_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's words come within half of its largest text of its target, and no text is taken in parts or too often."""
    mixed = mix_sizes(documents(spark, sf_dir)).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    whole = F.max(F.when(F.col("size") > 0, F.col("taken") % F.col("size") + F.when(F.col("taken") > 3 * F.col("size"), 1).otherwise(0)).otherwise(F.col("taken")))
    near = F.abs(F.sum("taken") - F.first("target")) <= F.greatest(F.lit(1.0), F.max("size") / 2)
    return mixed.groupBy("source").agg(near.alias("near"), (whole == 0).alias("whole_copies"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_merkle_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_owned_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = op8_hypergeometric_shards(spark, sf_dir)
    return dealt.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


def shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_hypergeometric_shards(spark, sf_dir).select("doc_id", "size")


QUERIES = {
    "op1_bloom_langid": op1_bloom_langid,
    "op2_gru_toxicity": op2_gru_toxicity,
    "op3_pareto_mixing": op3_pareto_mixing,
    "op4_quadratic_quality": op4_quadratic_quality,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_merkle_fingerprints": op6_merkle_fingerprints,
    "op7_owned_secrets": op7_owned_secrets,
    "op8_hypergeometric_shards": op8_hypergeometric_shards,
    "op9_simhash_bktree": op9_simhash_bktree,
    "op10_projection_forest": op10_projection_forest,
    "mix_targets": mix_targets,
    "mix_taken": mix_taken,
    "fingerprint_edits": fingerprint_edits,
    "secret_counts": secret_counts,
    "shard_sizes": shard_sizes,
    "shard_bytes": shard_bytes,
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: DuckDB SQL for those queries that SQL can express. A target is the weight times the level at which those sources are capped that would be over 3 times their size.
ORACLE_SQL: dict[str, str] = {
    "mix_targets": f"""WITH d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size / weight AS full_at, sum(3 * source_size) OVER w AS capped, sum(weight) OVER w AS gone, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_ FROM s
WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, weight, source_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - coalesce(capped, 0))::DOUBLE / (all_ - coalesce(gone, 0)) AS level FROM o),
level AS (SELECT min(level) FILTER (full_at > level) AS level FROM (SELECT *, min(full_at) FILTER (full_at > level) OVER () AS first FROM l) WHERE full_at = first)
SELECT doc_id, size, source_size, round(least(weight * level, 3.0::DOUBLE * source_size), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, level""",
    "mix_taken": "SELECT source, true AS near, true AS whole_copies FROM documents GROUP BY source",
    "fingerprint_edits": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS following FROM documents)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) AS edited_sha256 FROM d""",
    "secret_counts": r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x : length(x) >= 6)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x : length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x : length(x) >= 24)) AS n_hex FROM documents""",
    "shard_sizes": "SELECT shard, n, n AS slots, 0 AS first, n - 1 AS last FROM (SELECT unnest(range(8)) AS shard, (SELECT count(*) FROM documents) AS rows), LATERAL (SELECT rows // 8 + CASE WHEN shard < rows % 8 THEN 1 ELSE 0 END AS n)",
    "shard_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents",
}
