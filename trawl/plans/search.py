"""Search: query guard, scope, BM25 prefilter, cosine, fusion, symbol boosts, rerank, results with code.

With an inverted index (``operators.postings``) a search reads the asked terms' blocks and no text.  Without one the
text of a chunk is read where it lies: its row becomes narrow (length, term counts, path boosts)
before anything is joined or ordered.  The keyword hits, at most ``max(limit, 60, 500)``, are computed
once and held as a small local table, like every list after them; vectors are then read for the hits
only.  Where there are no hits (or keyword search is off) all chunks in scope are scored, with a top-k
that keeps ``budget`` rows of each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions.text import normalize_query, query_pattern, tokens
from ..functions.vector import cosine
from ..operators import bm25, graph, postings, rank, scope, storage

BUDGET, PREFILTER, MOST_CHARS = 60, 500, 5000


def vector_top(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    similarity = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(id_col, F.round(similarity, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def held(df: DataFrame) -> DataFrame:
    """A list cut to a known length, computed once: later plans read it as a local table."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def keyword_hits(index: postings.Index, terms: list[str], limit: int, where: scope.Scope) -> DataFrame:
    """doc_id and bm25 of the best ``limit`` chunks in scope, held; statistics are those of the scope."""
    within = scope.apply(index.docs, where) if where.active else None
    return held(postings.search(index, postings.one_query(index.docs.sparkSession, terms), limit, within=within, digits=9).select("doc_id", "bm25"))


def candidates(
    chunks: DataFrame, vectors: DataFrame, terms: list[str], query_text: str, query_vector: list[float], budget: int, where: scope.Scope, index: postings.Index | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, score; at most 500 rows, or ``budget`` without keyword hits; doc_id, bm25 of the keyword hits or None).

    ``index`` holds the chunks that have a vector, with the columns that scopes read.  Where chunks and vectors are
    stored in buckets of their ids, nothing is exchanged by id.
    """
    inside = scope.apply(chunks, where)
    intent = F.col("intent") if "intent" in chunks.columns else F.lit(None).cast("string")
    parts = {"__boost": rank.boosts(F.col("file_path"), F.col("tags"), intent, F.lit(query_text))}
    similarity = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), 9)
    score = rank.clip(similarity + F.col("__boost")).alias("score")
    keyword, terms = None, sorted(set(terms))
    if where.hybrid and where.bm25 and terms and index is not None:
        keyword = keyword_hits(index, terms, max(budget, PREFILTER), where)
        if not keyword.isEmpty():
            hits = inside.join(F.broadcast(keyword.select("doc_id")), "doc_id").withColumns(parts).select("doc_id", "__boost")
            return held(vectors.join(F.broadcast(hits), "doc_id").select("doc_id", score)), keyword
    elif where.hybrid and where.bm25 and terms:
        rows = bm25.counted(inside.withColumns(parts), terms, "doc_id", "__boost").join(vectors.select("doc_id"), "doc_id", "left_semi")
        hits = bm25.scored(rows, held(bm25.statistics(rows, terms)), terms, "doc_id", "__boost")
        hits = held(hits.withColumn("bm25", F.round("bm25", 9)).orderBy(F.desc("bm25"), "doc_id").limit(max(budget, PREFILTER)))
        keyword = hits.select("doc_id", "bm25")
        if not hits.isEmpty():
            return held(vectors.join(F.broadcast(hits), "doc_id").select("doc_id", score)), keyword
    narrow = inside.withColumns(parts).select("doc_id", "__boost")
    return held(narrow.join(vectors, "doc_id").select("doc_id", score).orderBy(F.desc("score"), "doc_id").limit(budget)), keyword


def hybrid(
    chunks: DataFrame, vectors: DataFrame, terms: list[str], query_text: str, query_vector: list[float], limit: int = 10, where: scope.Scope | None = None, symbols: DataFrame | None = None,
    scorer: Callable[[list[str]], list[float]] | None = None, index: postings.Index | None = None,
) -> DataFrame:
    """``chunks(doc_id, file_path, lang, tags, text, ...)``, ``vectors(doc_id, embedding)`` → the best ``limit``:
    doc_id, score, rrf, vrank, brank (ranks from 0); with ``symbols`` (a symbol map whose chunk_id is the
    doc_id as text) also symbol_boost and sources; with a ``scorer`` and the scope's reranker also rerank."""
    where = where or scope.Scope()
    budget = max(limit, BUDGET)
    scored, keyword = candidates(chunks, vectors, terms, query_text, query_vector, budget, where, index)
    scored = scored.withColumnRenamed("doc_id", "id")
    top = scored.orderBy(F.desc("score"), "id").limit(budget)
    vlist = rank.numbered(top, "vrank", F.desc("score"), F.col("id"))
    if keyword is None:
        fused = vlist.select("id", "score", (1.0 / (rank.RRF_K + F.col("vrank") + 1)).alias("rrf"), "vrank", F.lit(None).cast("int").alias("brank"))
    else:
        first = keyword.orderBy(F.desc("bm25"), "doc_id").limit(budget)
        blist = rank.numbered(first, "brank", F.desc("bm25"), F.col("doc_id")).select(F.col("doc_id").alias("id"), "brank")
        fused = rank.fuse(vlist.select("id", "vrank"), blist, budget).join(scored, "id")
    if symbols is not None and where.symbol_boost:
        # boosts are added to all fused candidates, and may lift one over the cut
        fused = rank.boosted_order(held(with_symbol_boost(held(fused), symbols, query_text)), limit, by_score=True).limit(limit)
    else:
        fused = fused.orderBy(F.desc("rrf"), F.asc_nulls_last("vrank"), F.asc_nulls_last("brank"), "id").limit(limit)
    extra = [c for c in ("symbol_boost", "sources") if c in fused.columns]
    out = fused.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.round("rrf", 9).alias("rrf"), F.col("vrank").cast("long").alias("vrank"), F.col("brank").cast("long").alias("brank"), *extra)
    if scorer is not None and where.reranker == "api":
        texts = held(out.join(chunks.select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "id"))
        return rank.rerank(texts, scorer).drop("text").withColumnRenamed("id", "doc_id")
    return out.orderBy(F.desc("score"), "doc_id")


QUERY_BLOCK = 1024


def vector_top_many(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``rows(doc_id, embedding, base, tags, intent)``, ``queries(query, text, vector)`` → query, doc_id, score: each query's best ``k``.

    A score is the cosine (to 9 places) and the boosts: ``base`` of the row, and what its tags and intent (lower case) earn in
    the query's text.  The rows are scanned once for each block of ``QUERY_BLOCK`` queries, which is sent to the tasks; these
    multiply matrices and keep each query's best ``k`` of their rows, so only those are exchanged.  Ties go to the smaller id.
    """
    spark, blocks = queries.sparkSession, max(1, -(-queries.count() // QUERY_BLOCK))
    schema = ty.StructType([ty.StructField("query", queries.schema["query"].dataType), ty.StructField("doc_id", rows.schema["doc_id"].dataType), ty.StructField("score", ty.DoubleType())])
    rows = rows.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "base", "tags", "intent")
    out = None
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text", F.col("vector").cast("array<double>").alias("vector")).toArrow()
        if not asked.num_rows:
            continue
        vectors = [np.array(v if v is not None else [], float) for v in asked.column("vector").to_pylist()]
        shared = spark.sparkContext.broadcast((asked.column("query").combine_chunks(), [t or "" for t in asked.column("text").to_pylist()], vectors))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
            names, texts, wanted = shared.value
            kept: dict[int, pa.Table] = {}
            for batch in batches:
                score = similarities(batch.column("embedding"), wanted)
                score = np.clip(score + boosts_of(batch, texts), 0.0, 1.0)
                ids = batch.column("doc_id")
                for q in range(len(wanted)):
                    found = pa.table({"score": score[q], "doc_id": ids})
                    found = pa.concat_tables([kept[q], found]) if q in kept else found
                    kept[q] = found.take(pc.sort_indices(found, [("score", "descending"), ("doc_id", "ascending")])[:k])
            for q, found in kept.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(names[q], len(found)), found.column("doc_id").combine_chunks(), found.column("score").combine_chunks()], schema.names)

        part = rows.mapInArrow(best, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


def similarities(embeddings: pa.Array, wanted: list[np.ndarray]) -> np.ndarray:
    """Cosines (to 9 places) of each query with each row; 0 where lengths differ or are nothing."""
    out = np.zeros((len(wanted), len(embeddings)))
    sizes = pc.list_value_length(embeddings).fill_null(0).to_numpy(zero_copy_only=False)
    for size in {len(v) for v in wanted} - {0}:
        place, asked = np.flatnonzero(sizes == size), [q for q, v in enumerate(wanted) if len(v) == size]
        x = embeddings.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False).reshape(len(place), size)
        q = np.stack([wanted[k] for k in asked])
        length = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
        out[np.ix_(asked, place)] = np.round(np.where(length > 0, (q @ x.T) / np.where(length > 0, length, 1.0), 0.0), 9)
    return out


def boosts_of(batch: pa.RecordBatch, texts: list[str]) -> np.ndarray:
    """The boosts of each query with each row; every different tag and intent is sought in a text once."""
    tags, intents = batch.column("tags"), batch.column("intent").dictionary_encode()
    coded = tags.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(tags)), pc.list_value_length(tags).fill_null(0).to_numpy(zero_copy_only=False))
    code, names, aims = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), intents.dictionary.to_pylist()
    aim = intents.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    base = batch.column("base").to_numpy(zero_copy_only=False)
    out = np.empty((len(texts), len(tags)))
    for q, text in enumerate(texts):
        hit = np.array([*(n in text for n in names), False])
        aimed = np.array([*(bool(a) and a in text for a in aims), False])
        out[q] = (np.where(aimed[aim], 0.2, 0.0) + 0.1 * np.bincount(row, hit[code], len(tags))) + base
    return out


def hybrid_many(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, index: postings.Index, limit: int = 10, where: scope.Scope | None = None) -> DataFrame:
    """``hybrid`` for a table ``queries(query, terms, text, vector)``: query, doc_id, score, rrf, vrank, brank.

    All queries share one pass over the index; a query brings at most 500 hits to the vectors.  Those without hits are
    scored against all vectors in scope, in blocks of queries.
    """
    where, budget = where or scope.Scope(), max(limit, BUDGET)
    inside = scope.apply(chunks, where)
    meta = inside.select("doc_id", "file_path", "tags", (F.col("intent") if "intent" in chunks.columns else F.lit(None).cast("string")).alias("intent"))
    hits = postings.search(index, queries.select("query", "terms"), max(budget, PREFILTER), within=scope.apply(index.docs, where) if where.active else None, digits=9)
    hits = hits.select("query", "doc_id", (F.col("rank") - 1).alias("brank"))
    boost = rank.boosts(F.col("file_path"), F.col("tags"), F.col("intent"), F.col("text"))
    score = rank.clip(F.round(cosine(F.col("embedding"), F.col("vector")), 9) + boost).alias("score")
    pool = hits.join(vectors, "doc_id").join(meta, "doc_id").join(queries.select("query", "text", "vector"), "query").select("query", "doc_id", "brank", score)
    silent = queries.join(hits.select("query").distinct(), "query", "left_anti").select("query", "text", "vector")
    base = F.when(rank.is_doc_file(F.col("file_path")), 0.15).otherwise(0.0)
    lower = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    rows = vectors.join(meta, "doc_id").select("doc_id", "embedding", base.alias("base"), lower.alias("tags"), F.lower("intent").alias("intent"))
    alone = vector_top_many(rows, silent, budget).select("query", "doc_id", F.lit(None).cast("int").alias("brank"), "score")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = pool.unionByName(alone).withColumn("vrank", F.row_number().over(by_score) - 1)
    ranked = ranked.withColumns({c: F.when(F.col(c) < budget, F.col(c)) for c in ("vrank", "brank")})
    part = lambda c: F.coalesce(1.0 / (rank.RRF_K + F.col(c) + 1), F.lit(0.0))
    ranked = ranked.where("vrank IS NOT NULL OR brank IS NOT NULL").withColumn("rrf", part("vrank") + part("brank"))
    order = Window.partitionBy("query").orderBy(F.desc("rrf"), F.asc_nulls_last("vrank"), F.asc_nulls_last("brank"), "doc_id")
    best = ranked.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= limit)
    return best.select("query", "doc_id", F.round("score", 6).alias("score"), F.round("rrf", 9).alias("rrf"), F.col("vrank").cast("long").alias("vrank"), F.col("brank").cast("long").alias("brank"))


def with_symbol_boost(found: DataFrame, symbols: DataFrame, query_text: str) -> DataFrame:
    """Adds symbol_boost and sources and raises score: 0.3 of the own strength and 0.15 of the best neighbour's.

    ``found`` is a bounded list, so the map is read for its ids, and once more for their neighbours' shas (the
    last entry of a sha counts), and never joined with itself.
    """
    strength = rank.signature_strength(F.col("symbol"), F.col("symbol_signature"), F.col("symbol_parameters"), F.lit(query_text))
    own = symbols.join(F.broadcast(found.select(F.col("id").cast("string").alias("chunk_id"))), "chunk_id", "left_semi")
    own = held(own.select("chunk_id", strength.alias("own"), "symbol_neighbors"))
    wanted = own.select(F.explode("symbol_neighbors").alias("sha")).distinct()
    near = symbols.join(F.broadcast(wanted), "sha", "left_semi").groupBy("sha").agg(F.max_by(F.struct(strength.alias("s")), "chunk_id")["s"].alias("strength"))
    best = graph.best_neighbour(own.select(F.col("chunk_id").alias("id"), F.col("symbol_neighbors").alias("both")), near)
    rows = found.join(F.broadcast(own.select("chunk_id", "own")), F.col("id").cast("string") == F.col("chunk_id"), "left").drop("chunk_id")
    rows = rows.join(F.broadcast(best.withColumnRenamed("id", "__id")), F.col("id").cast("string") == F.col("__id"), "left").drop("__id")
    own_, near_ = F.coalesce("own", F.lit(0.0)), F.coalesce("neighbour", F.lit(0.0))
    sources = F.array_compact(F.array(F.when(own_ > 0, "signature"), F.when(near_ > 0, "neighbor")))
    boost = rank.symbol_boost(own_, near_)
    return rows.withColumns({"symbol_boost": boost, "sources": sources, "score": F.least(F.lit(1.0), rank.clip(F.col("score")) + boost)}).drop("own", "neighbour")


@dataclass
class Index:
    """What a search reads: chunks, vectors, and optionally the symbol map and the blobs with the chunks' code."""

    chunks: DataFrame
    vectors: DataFrame
    symbols: DataFrame | None = None
    blobs: DataFrame | None = None
    keys: tuple[bytes, ...] = ()
    postings: postings.Index | None = None


@dataclass
class Found:
    """An answer to a search: its results, or an error."""

    results: DataFrame | None
    kind: str
    error: str | None = None
    message: str | None = None


def guard(queries: DataFrame, column: str = "query", most: int = MOST_CHARS) -> DataFrame:
    """Adds q (normalized) and status: ``ok``, ``query_too_long`` or ``overview`` (nothing asked)."""
    q = normalize_query(F.coalesce(column, F.lit("")))
    rows = queries.withColumn("q", q)
    return rows.withColumn("status", F.when(F.length("q") > most, "query_too_long").when(F.col("q") == "", "overview").otherwise("ok"))


def overview(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """The first chunks by path and symbol, each with score 1."""
    return chunks.orderBy("file_path", "symbol", "doc_id").limit(limit).select("doc_id", "file_path", "symbol", "lang", "sha", F.lit(1.0).alias("score"))


def mapped(found: DataFrame, chunks: DataFrame, kind: str) -> DataFrame:
    """Results as users see them: type, lang, path, sha and meta (id, symbol, score within 0 and 1, kind, and what ranked them)."""
    rows = found.join(chunks.drop("score"), "doc_id")  # a search's list is a local relation, which Spark broadcasts by its size
    optional = [F.col(c).alias(c) if c in found.columns else F.lit(None).cast(t).alias(c) for c, t in (("rrf", "double"), ("vrank", "long"), ("brank", "long"), ("rerank", "double"))]
    boost = F.when(F.col("symbol_boost") > 0, F.col("symbol_boost")) if "symbol_boost" in found.columns else F.lit(None).cast("double")
    meta = F.struct(F.col("id").alias("id"), F.col("symbol").alias("symbol"), rank.clip(F.coalesce("score", F.lit(0.0))).alias("score"), F.lit(kind).alias("kind"), *optional, boost.alias("symbol_boost"))
    return rows.select(F.lit("code").alias("type"), "lang", F.col("file_path").alias("path"), "sha", meta.alias("meta"))


def search(spark: SparkSession, index: Index, query: str, embed: Callable[[str], list[float]], limit: int = 10, where: scope.Scope | None = None, scorer: Callable[[list[str]], list[float]] | None = None) -> Found:
    """The library's search: guard, overview for an empty query, hybrid search, mapped results."""
    asked = guard(spark.createDataFrame(pa.table({"query": [query]}))).withColumn("terms", tokens(F.col("q"))).first()
    if asked["status"] == "query_too_long":
        return Found(None, "error", "query_too_long", f"a query has at most {MOST_CHARS} characters")
    if asked["status"] == "overview":
        return Found(mapped(overview(index.chunks, limit).select("doc_id", "score"), index.chunks, "overview"), "overview")
    if index.chunks.isEmpty():
        return Found(None, "error", "no_chunks_found", "nothing is indexed")
    where = where or scope.Scope()
    found = held(hybrid(index.chunks, index.vectors, asked["terms"], asked["q"], embed(asked["q"]), limit, where, index.symbols, scorer, index.postings))
    kind = "hybrid" if where.hybrid and where.bm25 else "vector"
    order = [F.desc_nulls_last("meta.rerank"), F.desc("meta.score"), F.col("meta.id")]
    return Found(mapped(found, index.chunks, kind).orderBy(*order), kind)


def search_with_code(spark: SparkSession, index: Index, query: str, embed: Callable[[str], list[float]], limit: int = 10, **options) -> Found:  # type: ignore[no-untyped-def]
    """Like ``search``, each result with its code."""
    found = search(spark, index, query, embed, limit, **options)
    if found.results is not None and index.blobs is not None:
        found.results = storage.with_code(held(found.results), index.blobs, list(index.keys)).orderBy(F.desc("meta.score"), "meta.id")
    return found


def usage(found: Found, query: str, where: scope.Scope | None = None) -> DataFrame | None:
    """What a search adds to the log: (query, pattern, target, confidence); a target only for a score over 0.8 with
    symbol boosts on.  ``maintain.intentions`` and a count by pattern sum the log up."""
    if found.results is None or found.kind == "overview":
        return None
    best = found.results.limit(1).select("sha", F.col("meta.score").alias("score"))
    q = normalize_query(F.lit(query))
    sure = (F.col("score") > 0.8) & F.lit((where or scope.Scope()).symbol_boost)
    return best.select(q.alias("query"), query_pattern(q).alias("pattern"), F.when(sure, F.col("sha")).alias("target"), F.when(sure, F.col("score")).alias("confidence"))


def several(found: list[DataFrame], limit: int) -> DataFrame:
    """The results of several queries as one list: each sha once, with its best score."""
    return rank.multi_query([f.withColumn("score", F.col("meta.score")) for f in found], limit)
