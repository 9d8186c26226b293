"""The queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_contamination
from .exact_dedup import exact_duplicates
from .katz import score_corpus
from .packing import pack_documents
from .preferences import format_preferences, swapped_answers
from .quality import fit, remainder, score, training_rows
from .sharding import shuffle_into_shards
from .simhash import near_duplicates
from .substring_dedup import repeated_spans
from .warc import archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(_table(spark, sf_dir, "pages"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_corpus(_table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2, order=3)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start_word", "n_words")


def op5_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_preferences(*swapped_answers(_table(spark, sf_dir, "conversations")))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ")
    return pairs.select(F.col("pair_id").alias("conv_id"), "common_turns", "prompt", "chosen", "rejected", listed("chosen_spans").alias("chosen_spans"), listed("rejected_spans").alias("rejected_spans"))


def op8_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    model = fit(training_rows(docs, labels, ~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_simhash_pivots, op2_warc_index_merge, op3_katz_backoff, op4_simhash_windows, op5_gear_chunks, op6_hypergeometric_shards, op7_preference_pairs, op8_naive_bayes_svm, op9_karmarkar_karp_packing, op10_block_naming)}
