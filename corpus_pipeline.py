"""From raw documents to token ids, in five stages that each take and give a DataFrame.

Every stage but the last returns the columns of `documents`; what a stage decides is what the next one
sees. `run` writes each stage's rows as Parquet into the shared folder that the cluster names in
spark.checkpoint.dir and reads them again, so that a lost executor costs one stage at most; what a stage has read
is removed once its own rows are written.

In every stage null and empty texts, texts of any length, repeated rows and ids, empty tables and other columns (also those
named like a stage's own) have the results that the operators' docstrings state; the stages' own say what becomes
of the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import bpe, decontaminate, language_id, near_dedup, pii
from canopy.llm.common import documents, ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (und: null, empty or letterless texts, or nothing to learn from) go; where lang
    is null, the language that was found is filled in. Repeated rows all stay."""
    trees = language_id.fit(docs, language_id.Training(keep=~language_id.held_out(F.col("doc_id"))))
    return language_id.reject_unknown(docs, trees)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id; of repeated rows one. Null and wordless
    texts are classes by themselves and all stay."""
    return near_dedup.representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, every copy of them; null and wordless texts hold none. An empty
    benchmark removes nothing."""
    return decontaminate.remove(docs, documents(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the name of its kind, and n_chars counts anew; all rows stay, null
    texts are null."""
    return pii.redacted(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the decoded text of every row; null and empty texts have no tokens."""
    return bpe.encode(docs, bpe.default_vocabulary()).drop("text", "n_chars")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", redact_personal_data),
    ("bpe", encode_tokens),
]

#: No SQL: the first two stages and the last cannot be said in it; a test holds the run against plain Python that
#: compares all pairs of documents, looks at every window and encodes with the tokenizer's own library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
