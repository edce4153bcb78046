"""One registered query per operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplist.llm.common import documents
from toplist.llm.conversation_repair import damage, repair, summary
from toplist.llm.exact_dedup import exact_duplicates
from toplist.llm.fingerprints import edited_fingerprints
from toplist.llm.hard_negatives import hard_negatives
from toplist.llm.huffman import token_files
from toplist.llm.language_id import identify, train
from toplist.llm.mixing import mix_sources
from toplist.llm.near_duplicates import near_duplicates
from toplist.llm.oracles import ORACLES
from toplist.llm.packing import pack, token_pieces
from toplist.llm.quality_classifier import classify
from toplist.llm.quality_rules import Limits, quality_rules
from toplist.llm.repeats import without_repeats
from toplist.llm.url_rules import Rule, judge_urls
from toplist.sources.tables import read_table

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
#: Weights of the sources in code-point order, repeating.
SOURCE_WEIGHTS = [5.0, 2.0, 1.0]
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path(BYTE_TOKENIZER)
    pieces = token_pieces(documents(spark, sf_dir), tokenizer, 2, 1024, carry=["doc_id"], with_ids=False)
    return pack(
        pieces.select(F.col("_row.doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32"), 1024
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), SOURCE_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))
    return files.select("_row.doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
    pick = F.xxhash64(F.col("doc_id"))
    model = train(docs.where(fold != 1), F.col("text"), F.col("lang"), pick)
    return identify(docs, model, carry=["doc_id", "held_out"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The query's SQL seeks common words among those of at most 6 bytes.
    return quality_rules(documents(spark, sf_dir), Limits(max_common_bytes=6)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
        # Rounded: the last digits depend on the order of the sums.
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(documents(spark, sf_dir), window=200, carry=["doc_id"])
    return left.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document is good when its quality is marked good and it is not marked toxic.
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int").alias("label")
    )
    return classify(documents(spark, sf_dir), labels)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damage(read_table(spark, sf_dir, "conversations"))
    return summary(repair(damaged, F.col("present")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_minhash_near_dedup, op3_fingerprints, op4_source_mixing, op5_token_files,
        op6_language_id, op7_quality_rules, op8_suffix_array_dedup, op9_url_filters, op10_quality_classifier,
        op11_conversation_repair, op12_exact_dedup, op13_hard_negatives,
    )
}
