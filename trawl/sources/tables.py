"""The driver's tables as an index: chunks with paths, symbols, tags and vectors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out where a scan has fewer parts than there are cores, as before costly work on texts; else nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: id, doc_id, file_path, symbol, sha, lang, text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    folder = F.when(F.col("doc_id") % 5 == 0, "docs/").otherwise("src/")
    ending = F.when(F.col("doc_id") % 7 == 0, ".md").otherwise(".txt")
    path = F.concat(folder, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), ending)
    return d.select(F.col("doc_id").cast("string").alias("id"), "doc_id", path.alias("file_path"), F.regexp_extract("text", r"[A-Za-z_][A-Za-z0-9_]*", 0).alias("symbol"), F.sha1("text").alias("sha"), "lang", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, else (local mode only) a temporary one."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    FOLDERS.append((spark, f"{root or tempfile.gettempdir()}/trawl-index-{uuid.uuid4().hex}"))
    return FOLDERS[-1][1]


FOLDERS: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Deletes the folders that ``shared_folder`` gave to this driver."""
    while FOLDERS:
        with contextlib.suppress(Exception):  # the session may be gone
            spark, folder = FOLDERS.pop()
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
