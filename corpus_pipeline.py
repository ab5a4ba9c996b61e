"""A training corpus from documents: toxic ones go, one of each group of near duplicates stays, repeated passages go, and
what remains is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns a DataFrame; all but
the last return the columns of documents. Every result is written as Parquet and read again before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ombrix.llm import jaccard, packing, suffix, toxicity
from ombrix.llm.common import apart_from_uid, documents, scratch_path, with_uid
from ombrix.llm.pretoken import library_json
from ombrix.llm.shingles import Rule


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.3 or more go. Null and empty texts, repeated rows and rows without doc_id are scored as any other."""
    return toxicity.clean(spark, docs, sf_dir)


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one of smallest doc_id stays (a null doc_id comes first).

    Null and empty texts, and texts without words, are linked with nothing and stay. Of rows that are equal one stays.
    """
    return apart_from_uid(docs, lambda d: jaccard.one_of_each(with_uid(d, *_others(d)), d.columns, 5, Rule(4, 5)))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of a 100-byte string that also starts earlier in the corpus; a row whose text goes whole stays with an empty one."""
    return apart_from_uid(docs, lambda d: suffix.without_repeats(with_uid(d, *_others(d)), d.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, as :func:`ombrix.llm.packing.pack_documents` gives them; null and empty texts hold the end id alone."""
    return packing.pack_documents(with_uid(docs), library_json(None, "word_bpe_49k.json"), added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
