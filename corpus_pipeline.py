"""Corpus pipeline: quality rules, language ID, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents (doc_id, text, lang, source,
n_chars), whatever other columns come in; an empty table passes through; null texts are rejected by the
quality rules as texts without words. Rows with null doc_id go through the stages like others, but are
nobody's near copy; rows that repeat a doc_id are versions of one document, of which the near-copy stage
keeps one; where no language can be learned, texts with letters pass the language stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, write_shared
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.language_id import UND, language_id, train_languages
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality_rules import quality_rules
from tessera.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if no language holds this share of its letters.
LEAST_SHARE = 0.3
#: Near copies share this percentage of their shingles of so many words.
NEAR_PERCENT, NEAR_WIDTH = 80, 5


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no robust outliers of their language and source."""
    return quality_rules(docs, ["text", "n_chars"]).where("kept").select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a main language, by a model learned from the documents that came in."""
    model = train_languages(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id(docs, model, keep=tuple(COLUMNS[1:]))
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each component of linked documents, and all rows without an id."""
    kept = jaccard_components(docs, NEAR_PERCENT, NEAR_WIDTH).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    version = F.row_number().over(Window.partitionBy("doc_id").orderBy(*COLUMNS[1:]))
    chosen = docs.join(kept, "doc_id", "left_semi").withColumn("version", version).where("version = 1").drop("version")
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 100-byte strings; a character that loses a byte goes; emptied texts stay as empty ones."""
    cut = suffix_dedup(docs, texts=True, keep=("lang", "source")).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 4096 tokens."""
    return best_fit_packing(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("best-fit packing", pack),
]

#: Robust covariance, learned languages and tokenization are not expressible in SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
