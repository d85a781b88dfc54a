"""A corpus pipeline over documents: STAGES, and run() that applies them in order.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
documents. A stage is judged on what the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, mixing, simhash_dedup, sstable
from millrace.llm.common import BATCH_ROWS, discard, free_name, table, written
from millrace.llm.queries import language_model, tokenizer

#: A document whose language is less probable than this among the learned ones is rejected.
LEAST_SCORE = 0.5


def whole_texts(spark: SparkSession) -> None:
    """Sets the session to pass whole texts to Python in small batches; 10,000 of them, Spark's own default, are tens of MB a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters ("und", null and empty texts too) or without a probable language go.

    Rows with equal identifiers are judged one by one; an empty table stays empty; all columns stay.
    """
    whole_texts(spark)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    judged = language_id.predict(docs, language_model(docs), lang_pred=lang, score=score)
    kept = (F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return judged.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8.

    Texts without a word (null, empty) are alike, so one of them stays; of rows with equal identifiers
    and texts one stays; all columns stay.
    """
    whole_texts(spark)
    return simhash_dedup.keep_first_similar(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item. Null and empty texts have none and stay, as do all columns; rows are told apart by identifier and text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights.

    A null source or language is a value of its own; a document without tokens is not drawn, a rare cell's
    documents may come several times; all columns stay.
    """
    whole_texts(spark)
    return mixing.sample(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the token shards of the documents.

    A null or empty text is the end id alone, a null identifier comes first, repeated rows are all written.
    """
    return sstable.read_shards(sstable.encode_to_shards(docs, tokenizer("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("language ID", keep_known_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_shards),
]

#: SQL has neither the language model nor XXH64, so the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made  # the shards are read back from, so what they were made from may be there still
        before, docs = docs, written(made, f"stage{k}")
        if k:
            discard(before)
