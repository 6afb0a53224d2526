"""The queries of this package and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, manifest, mixing, near_dedup, neighbours, quality, sharding, url_filter, whitening
from .common import read_table
from .packing import pack
from .substring_dedup import remove_phrases
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens


def op1_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_mixing(spark, sf_dir):
    found = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark, sf_dir):
    found = url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark, sf_dir):
    found = remove_phrases(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_suffix_dedup(spark, sf_dir):
    found = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_classifier(spark, sf_dir):
    found = quality.classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_near_dedup(spark, sf_dir):
    # few rounds of leaders: each costs some ten stages, however little is left to compare
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), depth=4)
    return found.select("doc_id", "class_id", "class_size", "kept")


def op10_neighbours(spark, sf_dir):
    vectors = neighbours.usable(read_table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_manifest(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(*manifest.COLUMNS)
    return manifest.proofs(manifest.manifest(docs, {"text": manifest.tampered_text()}))


def op13_sharding(spark, sf_dir):
    found = sharding.assign(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_token_counts, op4_url_filter, op5_packing, op6_substring_dedup, op7_quality_classifier, op8_suffix_dedup, op9_near_dedup, op10_neighbours, op11_whitening, op12_manifest, op13_sharding)}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op2_mixing": mixing.SQL, "op4_url_filter": url_filter.SQL, "op12_manifest": manifest.SQL, "op13_sharding": sharding.SQL}
