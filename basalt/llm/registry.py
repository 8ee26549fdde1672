"""Queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import aho, codes, infill, interpolation, language, oracles, ordermin, packing, quality, simhash, simple8b, suffix, tokens, toxicity
from .common import read_table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through Simple-8b files and back: one row per document; a null text has the end id alone."""
    return simple8b.token_file_digest(read_table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing; `und` with score 0 for texts without a letter; ties go to the first language."""
    return language.predict_language(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 ids; a null text is its end id; ties go by id, piece and crc."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), end_id=1)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start twice; null is empty, copies lose all."""
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness; null is empty, equal texts have equal fingerprints."""
    return ordermin.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero; null ids are no component's least."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the model of the labelled ones; empty texts have the score of the bias."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of the benchmark; null has no words; a null item counts as "null"."""
    return aho.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, whole; null is empty; one row per input row."""
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; null is its end alone; repeated rows count as often as they occur."""
    return interpolation.score_documents(read_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by the lexicon of the labelled ones; texts without an entry share one score."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every finite vector in 16 parts of 64 entries after two rounds; ties go to the lower index, null labels are one."""
    return codes.compress_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document; null is empty and plain; one row per input row."""
    return infill.transform_infill(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_language_id, op3_packing, op4_suffix_dedup, op5_order_minhash, op6_simhash, op7_quality, op8_decontamination, op9_token_counts, op10_lm_scores, op11_toxicity, op12_vector_codes, op13_infill)}

#: The others need a tokenizer, XXH64 or learning, which SQL has not; tests hold them against brute force.
ORACLE_SQL = {"op4_suffix_dedup": oracles.REPEATS, "op8_decontamination": oracles.DECONTAMINATION, "op12_vector_codes": oracles.VECTOR_CODES, "op13_infill": oracles.INFILL}
