"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns a DataFrame; all but the last return the columns of documents.

1. language_id: learns piece probabilities from the lang column and drops texts
   whose language it cannot tell (no letter, or a score under one half).
2. exact_dedup: of texts equal after folding A-Z, the largest id stays.
3. near_dedup: of documents linked by five-word shingles at a similarity of 0.8
   or more, the smallest id of each group stays.
4. decontamination: drops documents that hold ten consecutive words of a
   benchmark item.
5. packing: sequences of 512 to 4096 tokens; a row for each piece, with its ids.

A null or empty text has no language and goes in the first stage; an empty
table passes through as an empty table. Rows may repeat an id: each goes by its
own text, and of rows with one id and near texts whose id is the smallest all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bloom, decontaminate, exact_dedup, language_id, near_dedup, packing
from tessera.llm.common import Stage, free_name, table

#: Under this posterior a text's language counts as not told.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.predict(docs, language_id.train(docs))
    return found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are known by id and text, so that rows of one id don't go for one another
    key = free_name(docs.columns, "_tess_row")
    rows = docs.withColumn(key, F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), "text").cast("binary")))
    dropped = near_dedup.near_duplicates(rows, shingle=5, percent=80, carry=(key,)).where("NOT kept").select(key)
    stage = Stage(spark)
    return bloom.without(rows, stage.keep(dropped), key, stage).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs, stage, before = table(spark, sf_dir, "documents"), Stage(spark), None
    for _, function in STAGES[:-1]:
        docs = stage.keep(function(spark, docs, sf_dir))
        if before is not None:
            stage.drop(before)  # the table of the stage before is no longer read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the language model nor the similarity join.
ORACLE_SQL = None
