"""The corpus pipeline: stages over ``documents``, each on what the one before kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. ``run`` writes every stage's rows as Parquet to the shared
folder and reads them again, so that no stage is computed twice and a lost
executor costs no more than the stage at work.

Defined cases are those of the operators: null and empty texts have no known
language and go in the first stage; rows that share an id are one document's
copies; an empty table passes through; further columns are kept by all stages
but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import decontaminate, language_id, packing, simhash, substring_dedup
from sievelight.llm._common import given_back, read_table, removed, shared_path, stored
from sievelight.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without a letter or unlike every language go."""
    model = language_id.fit(docs)
    found = language_id.predicted(docs, model)
    known = found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("rejected"))
    return given_back(known, docs, language_id.NAMES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays."""
    done = given_back(substring_dedup.dedup_substrings(docs), docs, substring_dedup.NAMES)
    return done.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a training sequence."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the language models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"stage{k}")
            docs = stored(docs, path)
            if last is not None:
                removed(spark, last)
            last = path
    return docs
