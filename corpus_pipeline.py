"""From raw documents to token files in five stages; each stage's rows are written as Parquet and read by the next.

As its input is written, a stage first empties the tables that the stages before it worked with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterecho.llm import decontaminate, lang_id, mixing, near_dup, token_file
from rasterecho.llm.queries import language_model, table
from rasterecho.llm.scratch import forget, release, track
from rasterecho.llm.tokenizers import word_tokenizer
from rasterecho.plans.workspace import stored as keep

#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Bytes that a worker's memory of pieces may take in the last stage, and of text encoded at once: its workers have had four stages before.
TOKEN_MEMORY, TOKEN_SLAB = 80_000_000, 2_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that a language model accepts. Rows that share an id are judged each by its own text.

    From here on rows go to the workers in batches of ``BATCH_ROWS``, which bounds what a worker holds of whole texts.
    """
    track(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = lang_id.identify(docs, language_model(docs), keep_columns=True)
    return rows.where("accepted").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    release(spark)
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    release(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    release(spark)
    return mixing.take(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file; one row per document of the mix, read back from it."""
    release(spark)
    segments = token_file.write_tokens(docs.select("doc_id", "text"), word_tokenizer(), memory_bytes=TOKEN_MEMORY, slab_bytes=TOKEN_SLAB, tidy=True)
    made = token_file.read_documents(segments)
    forget(spark)
    return made


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: SQL cannot express the language model, MinHash and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
