"""The symbol map: one row for each chunk with what is known of its symbol; normalized, merged, stored, imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .maintain import read_table, replace_table

TEXTS = ("symbol", "chunk_type", "provider", "last_used_at", "symbol_signature", "symbol_return")
LISTS = ("synonyms", "symbol_parameters", "symbol_calls", "symbol_call_targets", "symbol_callers", "symbol_neighbors")
FLAGS = ("has_tags", "has_intent", "has_documentation", "encrypted")
NAMED = ("file", "sha", "lang")
SCHEMA = ", ".join(["chunk_id string", *[f"{c} string" for c in (*NAMED, *TEXTS)], "dimensions int", "variable_count int", "path_weight double", "success_rate double", *[f"{c} boolean" for c in FLAGS], *[f"{c} array<string>" for c in LISTS]])


def columns() -> list[str]:
    return [part.split(" ")[0] for part in SCHEMA.split(", ")]


def normalized(entries: DataFrame) -> DataFrame:
    """Any of the map's columns → all of them, with defaults: unnamed files are ``unknown``, lists without blanks and
    repeats, weights not negative, rates within 0 and 1, counts whole and not negative.  Entries without an id go."""
    there = set(entries.columns)

    def of(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in there else F.lit(None).cast(kind)

    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    out = {"chunk_id": of("chunk_id", "string")}
    out |= {c: F.when(F.trim(of(c, "string")) != "", of(c, "string")).otherwise("unknown") for c in NAMED}
    out |= {c: F.when(F.trim(of(c, "string")) != "", of(c, "string") if c == "symbol" else F.trim(of(c, "string"))) for c in TEXTS}
    out["dimensions"] = of("dimensions", "int")
    out["variable_count"] = F.greatest(F.coalesce(F.floor(finite(of("variable_count", "double")) + 0.5).cast("int"), F.lit(0)), F.lit(0))
    out["path_weight"] = F.greatest(F.coalesce(finite(of("path_weight", "double")), F.lit(1.0)), F.lit(0.0))
    rate = of("success_rate", "double")
    out["success_rate"] = F.least(F.greatest(F.coalesce(F.when(~F.isnan(rate), rate), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out |= {c: F.coalesce(of(c, "boolean"), F.lit(False)) for c in FLAGS}
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    out |= {c: clean(of(c, "array<string>")) for c in LISTS}
    return entries.select(*[out[c].alias(c) for c in columns()]).where("chunk_id <> ''")


def merged(previous: DataFrame, new: DataFrame) -> DataFrame:
    """New entries over the stored ones, field by field: what a new entry does not state (null or no column) stays."""
    stated = new.select("chunk_id", *[F.col(c).alias(f"__{c}") for c in columns() if c in new.columns and c != "chunk_id"])
    rows = previous.select(*columns()).join(stated, "chunk_id", "full_outer")
    return normalized(rows.select("chunk_id", *[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in rows.columns else F.col(c) for c in columns() if c != "chunk_id"]))


def of_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks(id, file_path, symbol, sha, lang, chunk_type, code)`` → map entries with signature, parameters, calls and variables."""
    rows = chunks.withColumn("__s", T.signature(F.col("symbol"), F.col("code"), F.col("chunk_type")))
    return normalized(
        rows.select(
            F.col("id").alias("chunk_id"), F.col("file_path").alias("file"), "symbol", "sha", "lang", "chunk_type", F.size(T.variables(F.col("code"))).alias("variable_count"),
            F.col("__s.signature").alias("symbol_signature"), F.col("__s.parameters").alias("symbol_parameters"), F.col("__s.returns").alias("symbol_return"), T.call_names(F.col("code")).alias("symbol_calls"),
        )
    )


def write(entries: DataFrame, path: str) -> None:
    """Stores the map, entries in the order of their ids."""
    replace_table(entries.select(*columns()).orderBy("chunk_id"), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored map; an empty one where there is none."""
    return read_table(spark, path, SCHEMA)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """A map stored as one JSON object {id: entry}; files that are none give no entries."""
    struct = "struct<" + ", ".join(part.replace(" ", ":", 1) for part in SCHEMA.split(", ")[1:]) + ">"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{struct}>")).alias("chunk_id", "e"))
    return normalized(raw.select("chunk_id", "e.*"))
