"""The corpus pipeline: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.common import saved, table
from tilewright.llm.decontaminate import drop_leaks
from tilewright.llm.language_id import alphabet, keep_known, learn, training
from tilewright.llm.mixing import keep_mixed, quality_weights
from tilewright.llm.secrets import learned, mask_secrets
from tilewright.llm.simhash_dedup import cluster_alike, drop_copies



def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: no letters, letters of another script, or a profile like no prototype.

    Null and empty texts go, as they have no letters; texts of any length are read as a whole; repeated rows are judged alike and stay or go together; where
    nothing can be learned (no labels) all go; an empty table stays empty. Columns stay as they are, whatever they are called."""
    return keep_known(docs, learn(docs), alphabet(training(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word Jaccard similarity of 0.8 or more stays.

    It is the one of the smallest id; of several rows with that id, the least as JSON. Null and texts without words are one component; of rows without an id
    one stays only where their component has no id at all; texts that are not alike all stay, whatever their ids."""
    return drop_copies(docs, cluster_alike)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows stay or go together; an empty benchmark removes nothing."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, by the words of these documents; all documents stay.

    Null stays null; ``n_chars`` is counted anew where a text changes; repeated rows change alike."""
    return mask_secrets(docs, learned(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many it takes.

    Null and empty texts have no words and go; a null source is a source; rows that repeat id, source and text share what is taken of them to the word; columns
    that are called as the new ones are replaced."""
    return keep_mixed(docs, quality_weights(table(spark, sf_dir, "labels")))


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("secret_scan", secrets),
    ("mixing", mixture),
]

#: SimHash linking and language profiles are not expressible in DuckDB SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k + 1 == len(STAGES) else saved(out)
    return docs
