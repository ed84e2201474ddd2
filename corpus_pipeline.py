"""From raw documents to packed token sequences, in four stages.

1. language_id: documents without a letter, or in no learned language, go.
2. ngram_jaccard_join: of each group of near copies, the document of the smallest id stays.
3. personal_data: personal data is masked in the text.
4. packing: texts become token sequences of power-of-two lengths.

Each stage works on all that the one before it kept, learning only from its own input.  Stages
1 to 3 return the columns of documents; the last one returns the pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.lang_id import keep_known_languages
from tidemark.llm.pack_pow2 import pack_power_of_two
from tidemark.llm.pii_crf import mask_personal_data
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.toccur_join import keep_one_of_each_group
from tidemark.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 of 100 five-word shingles."""
    return keep_one_of_each_group(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors have grown in the stages before: the word tables get less room than alone
    return pack_power_of_two(docs, tokenizer_file("word_bpe_49k.json"), seq_len=4096, end_id=2, table_bytes=32 << 20)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages use trained tokenizers and a fitted field, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
