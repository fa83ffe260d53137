"""Scoring and ordering of candidates: boosts, reciprocal-rank fusion, cuts, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_word_prefix, symbol_words
from ..functions.vector import clip

RRF_K = 60


def is_doc_file(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("readme") | p.contains("/docs/") | p.contains("changelog") | p.contains("contributing") | p.startswith("docs/") | p.endswith(".md")


def tag_boost(tags: Column, query: Column) -> Column:
    return F.lit(0.1) * F.size(F.filter(tags, lambda t: F.instr(query, F.lower(t)) > 0))


def intent_boost(intent: Column, query: Column) -> Column:
    return F.when(F.coalesce(F.instr(query, F.lower(intent)) > 0, F.lit(False)) & (F.length(intent) > 0), 0.2).otherwise(0.0)


def boosts(path: Column, tags: Column, intent: Column, query: Column) -> Column:
    """What a candidate's path, tags and intent add to its similarity."""
    return intent_boost(intent, query) + tag_boost(tags, query) + F.when(is_doc_file(path), 0.15).otherwise(0.0)


def candidate_score(similarity: Column, path: Column, tags: Column, intent: Column, query: Column) -> tuple[Column, Column]:
    """(score, boost); the boost leaves out the one for documentation files."""
    return clip(similarity + boosts(path, tags, intent, query)), intent_boost(intent, query) + tag_boost(tags, query)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds a rank from 0; for lists already cut to a bounded length."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(vector: DataFrame, keyword: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """``vector(id, vrank)`` and ``keyword(id, brank)``, ranks from 0, → id, rrf, vrank, brank, best first."""
    both = vector.join(keyword, "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c) + 1), F.lit(0.0))
    both = both.withColumn("rrf", part("vrank") + part("brank"))
    return both.orderBy(F.desc("rrf"), F.asc_nulls_last("vrank"), F.asc_nulls_last("brank"), "id").limit(limit)


def signature_strength(symbol: Column, signature: Column, parameters: Column, query: Column) -> Column:
    """How well a query names a symbol, 0 to 1: whole name 4, signature 3.5, words 1 and 0.5 each further, parameters 0.35; over 4."""
    q, s = F.lower(query), F.coalesce(F.lower(symbol), F.lit(""))
    sig = F.coalesce(F.regexp_replace(F.lower(signature), r"\s+", " "), F.lit(""))
    words = F.filter(F.array_distinct(symbol_words(symbol)), lambda w: has_word_prefix(query, w))
    named = F.when((s != "") & (F.instr(q, s) > 0), 4.0).otherwise(0.0)
    named = F.when((sig != "") & (F.instr(q, sig) > 0), F.greatest(named, F.lit(3.5))).otherwise(named)
    by_word = F.when(F.size(words) > 0, 1 + 0.5 * (F.size(words) - 1)).otherwise(0.0)

    def step(state: Column, parameter: Column) -> Column:
        parts = F.filter(F.split(F.lower(parameter), "[^a-z0-9]+"), lambda p: has_word_prefix(query, p) & ~F.array_contains(state["seen"], p))
        new = F.try_element_at(parts, F.lit(1))
        return F.when(new.isNull(), state).otherwise(F.struct((state["n"] + 1).alias("n"), F.concat(state["seen"], F.array(new)).alias("seen")))

    start = F.struct(F.lit(0).alias("n"), words.alias("seen"))
    matched = F.aggregate(F.filter(F.coalesce(parameters, F.array().cast("array<string>")), lambda p: p.isNotNull()), start, step, lambda s: s["n"])
    return clip((named + by_word + 0.35 * matched) / 4)


def symbol_boost(own: Column, neighbour: Column) -> Column:
    return F.least(F.lit(0.45), 0.3 * own + 0.15 * F.coalesce(neighbour, F.lit(0.0)))


def boosted_order(df: DataFrame, limit: int, by_score: bool = False) -> DataFrame:
    """By (score, boost, rrf) if any row has a symbol boost, else by rrf; of the best ``limit`` by rrf, or with
    ``by_score`` (for lists that are cut already) of all rows."""
    fused = [F.desc("rrf"), *[F.asc_nulls_last(c) for c in ("vrank", "brank") if c in df.columns], F.col("id")]
    cut = df if by_score else df.orderBy(*fused).limit(limit)
    any_boost = F.max(F.col("symbol_boost") > 0).over(Window.partitionBy())
    return cut.withColumn("__any", any_boost).orderBy(F.when(F.col("__any"), F.col("score")).desc_nulls_last(), F.when(F.col("__any"), F.col("symbol_boost")).desc_nulls_last(), *fused).drop("__any")


def best_per(df: DataFrame, key: str, score: str, *ties: str) -> DataFrame:
    """One row for each key, the highest score; map-side combined."""
    best = F.min_by(F.struct(*df.columns), F.struct((-F.col(score)).alias("__score"), *ties))
    return df.groupBy(key).agg(best.alias("__row")).select("__row.*")


def ratings(reply: object, count: int) -> list[float]:
    """The scores in a rerank service's reply, by place: a list of entries with index and relevance_score, alone or under
    ``results`` or ``data``; places that it leaves out get 0.  Other replies are an error."""
    rows = reply
    if isinstance(reply, dict):
        rows = reply.get("results") if isinstance(reply.get("results"), list) else reply.get("data")
    if not isinstance(rows, list):
        raise ValueError("a rerank reply has a list of results")
    out = [0.0] * count
    for row in rows:
        if isinstance(row, dict) and isinstance(row.get("index"), int) and isinstance(row.get("relevance_score"), (int, float)) and 0 <= row["index"] < count:
            out[row["index"]] = float(row["relevance_score"])
    return out


def rerank(df: DataFrame, scorer: Callable[[list[str]], object], top: int = 50, text: str = "text") -> DataFrame:
    """The best ``top`` rows by score get a scorer's rating and lead in its order; the others follow.

    A scorer gives ratings or a service's reply (``ratings``).  It is asked once, for two rows or more; if it fails, rows keep their order.
    """
    import pandas as pd

    def rate(frames):  # type: ignore[no-untyped-def]
        rows = pd.concat(list(frames))  # at most ``top``
        scores: list[float | None] = [None] * len(rows)
        if len(rows) > 1:
            try:
                said = scorer(rows[text].fillna("").tolist())
                plain = isinstance(said, (list, tuple)) and all(isinstance(x, (int, float)) for x in said)
                scores = [float(x) for x in said] if plain and len(said) == len(rows) else ratings(said, len(rows))  # type: ignore[arg-type, union-attr, assignment]
            except Exception:  # noqa: BLE001
                scores = [None] * len(rows)
        yield pd.DataFrame({"id": rows["id"], "rerank": pd.Series(scores, index=rows.index, dtype="float64")})

    head = df.orderBy(F.desc("score"), "id").limit(top).coalesce(1)
    rated = head.select("id", text).mapInPandas(rate, f"id {dict(df.dtypes)['id']}, rerank double")
    return df.join(F.broadcast(rated), "id", "left").orderBy(F.desc_nulls_last("rerank"), F.desc("score"), "id")


def multi_query(results: list[DataFrame], limit: int) -> DataFrame:
    """Results of several queries (sha, score, ...): one row each sha, its best score."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [r.withColumn("__q", F.lit(k)) for k, r in enumerate(results)])
    return best_per(rows, "sha", "score", "__q").drop("__q").orderBy(F.desc("score"), "sha").limit(limit)
