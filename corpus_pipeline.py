"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage's result is written as Parquet to shared storage and read again as the next one's
documents.  ORACLE_SQL is None: classifier, MinHash, SimHash, alignment and tokenizer have no SQL
form; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm.common import Stored
from trawl.llm.queries import STAGES
from trawl.sources.tables import spread

__all__ = ["ORACLE_SQL", "STAGES", "run"]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    store = Stored(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store.put(stage(spark, spread(docs), sf_dir))
    return STAGES[-1][1](spark, spread(docs), sf_dir)
