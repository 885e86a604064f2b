"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans.store import forget, saved  # noqa: F401

#: ASCII blanks; everything between them is a word.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


#: Rows and bytes of text that a Python worker gets at once. Spark's defaults (10,000 rows, 64 MB) let a few copies of a batch of
#: long texts outgrow a small executor beside a full heap.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in small batches. Sets two session options, which hold as long as the session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
