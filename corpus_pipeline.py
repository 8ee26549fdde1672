"""A training corpus from raw documents: five stages, each one operator over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of its
documents, whatever they are besides doc_id and text, in their order; the last
one returns the packed pieces.  Stages are written as Parquet and read again.
A null text is empty to every operator, and stays null; null ids, ties and
repeated rows are as the stages say; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import aho, packing, quality, simhash, suffix, tokens
from basalt.llm.common import Scratch, read_table

def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _whole(docs: DataFrame) -> DataFrame:
    """Documents with their other columns as one that operators carry along; its fields are numbered, so that no name clashes."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(_others(docs))), F.col("text").isNull().alias("missing"))
    return docs.select("doc_id", "text", row.alias("row"))


def _columns(done: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    back = {c: F.col(f"carried.c{i}") for i, c in enumerate(_others(docs))} | {"doc_id": F.col("doc_id"), "text": F.col("text")} | changed
    return done.select(*(back[c].alias(c) for c in docs.columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.7 or more; the model is learned from the labelled ones among them.

    A null text is scored as an empty one; rows that are repeated are scored and
    kept alike; a score of 0.7 itself stays.
    """
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return _columns(quality.score_quality(_whole(docs), model, carry="row").where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group whose five-word shingles are 0.8 alike.

    Texts without words, null ones too, are copies of each other; of rows with
    equal id and text one stays; null ids give way to any other.
    """
    return simhash.drop_near_duplicates(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without the strings of 200 bytes that occur more than once.

    A character that was cut apart goes with the cut; n_chars, if there is such
    a column, is that of the text that is left.  A null text stays null, and a
    text that goes as a whole is empty; repeated rows lose all.
    """
    done = suffix.remove_repeats(_whole(docs), keep_text=True, carry="row")
    changed = {"text": F.when(F.col("carried.missing"), F.lit(None)).otherwise(F.col("kept_text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        old = F.col(f"carried.c{_others(docs).index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(kind)).otherwise(old)
    return _columns(done, docs, **changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words in a row, or a whole shorter item, of the benchmark.

    A null or empty text has no words and stays, as do all if the benchmark is empty.
    """
    return _columns(aho.find_contamination(_whole(docs), read_table(spark, sf_dir, "benchmark"), carry="row").where("not contaminated"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence of at most 4096 tokens and its place there.

    A null or empty text is its end id; ties in length go by id, piece and crc;
    every repeated row is packed.
    """
    return packing.pack_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no tokenizer, no XXH64 and no learning; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(f"stage-{number}", stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
