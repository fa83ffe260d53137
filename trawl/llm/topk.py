"""Exact maximum inner product search by norm-bucketed retrieval.

Vectors are grouped by length (norm) into buckets whose norms differ by at most ``width``, and
buckets into blocks of about ``block`` rows.  A query first meets the longest vectors, whose k-th
score is a lower bound of its result.  The bound divided by the query's norm and a bucket's
largest norm is the bucket's *local* cosine threshold: over 1 nothing there can qualify and the
pair is never shuffled; else a block picks per query block length pruning (the prefix of vectors,
longest first, that can reach the bound) or, for thresholds near 1, coordinate pruning (a
candidate's value on the query's strongest coordinate must lie in the feasible range).  What is
left is multiplied in float64, which is exact while the norms' product stays below 2**53; beyond,
all that its rounding error leaves in doubt is multiplied again in whole numbers of any size.  So results
are exact, ties to the smaller vec_id.  Scores that no long holds become the largest or smallest
score, ``MOST`` or ``-MOST``, and are ranked as such.

Scale: queries are a stated set (here every 50th row).  They go, in blocks of ``query_block``
rows, only to candidate blocks that can improve them.  Blocks are bounded by row counts, as hot
lengths (many copies of a vector) are dealt over as many blocks as they need, by id hash.
Nulls, vectors with null or non-finite components, empty vectors and vectors whose norm no double
holds take no part; only vectors of equal dimension are compared.  Components are whole numbers, kept
as doubles without loss.  Of rows with the same vec_id the smallest vector is the query; none of them
is among its candidates, and for other queries each is a candidate of its own.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map

FOUND = "query_id long, vec_id long, score long"
SLACK = 1e-9
MOST = 2**63 - 1


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vectors(vec_id, embedding)`` → vec_id, v array<double>, dim, norm; only usable rows."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where((F.size("embedding") > 0) & ~bad)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumns({"dim": F.size("v"), "norm": norm}).where(F.col("norm") < float("inf"))


def whole(x: Column) -> Column:
    """The floor as a double; from 2**52 on every double is whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long rows as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, query: np.ndarray, vectors: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the k highest scores of other rows, ties to the smaller id; ``most`` bounds the products' size."""
    places = np.flatnonzero(ids != own)
    error = 0.0 if most < 2.0**53 else most * (len(query) + 2) * 2.0**-52
    if len(places) > k:
        kth = np.partition(scores[places], len(places) - k)[len(places) - k]
        least = min(kth - 2 * error, float(MOST) * (1 - 2.0**-50)) if kth - 2 * error > -float(MOST) else -math.inf
        places = places[scores[places] >= least]
    if error:
        whole = [int(x) for x in query]
        exact = np.array([max(-MOST, min(MOST, sum(a * int(b) for a, b in zip(whole, row)))) for row in vectors[places].tolist()], dtype=np.int64)
    else:
        exact = scores[places].astype(np.int64)
    order = np.lexsort((ids[places], -exact))[:k]
    return places[order], exact[order]


def search_block(queries: pa.Table, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int, coordinate_from: float = 0.9) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query (its id repeated, candidates, scores): the block's best k that can reach the query's bound.

    ``vectors`` are sorted by norm, longest first; queries have ``bound`` (-inf: none yet).
    """
    q, q_ids = matrix(queries.column("v")), queries.column("vec_id").to_numpy()
    bounds, q_norms = queries.column("bound").to_numpy(), queries.column("norm").to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norms > 0, bounds / (q_norms * norms[0] if norms[0] > 0 else np.nan), -np.inf)
    local = np.where(np.isnan(local), np.where(bounds > 0, np.inf, -np.inf), local)
    by_length = np.flatnonzero((local <= min(1 + SLACK, coordinate_from)) | ~np.isfinite(q_norms))
    by_coordinate = np.flatnonzero((local > coordinate_from) & (local <= 1 + SLACK))
    if len(by_length):
        reach = bounds[by_length] / np.maximum(q_norms[by_length], 1e-300) * (1 - SLACK)
        prefix = np.searchsorted(-norms, -np.where(bounds[by_length] > 0, reach, -np.inf), side="right")
        longest = int(prefix.max(initial=0))
        scores = q[by_length] @ vectors[:longest].T
        for row, at, n in zip(scores, by_length, prefix):
            if n:
                places, exact = best(row[:n], ids[:n], q_ids[at], k, q[at], vectors, q_norms[at] * norms[0])
                yield np.full(len(places), q_ids[at]), ids[places], exact
    if len(by_coordinate):
        unit = vectors / np.maximum(norms, 1e-300)[:, None]
        for at in by_coordinate:
            focus = int(np.argmax(np.abs(q[at])))
            u, t = q[at, focus] / q_norms[at], min(1.0, local[at])
            spread = math.sqrt(max(0.0, (1 - u * u) * (1 - t * t))) + 1e-6
            places = np.flatnonzero((unit[:, focus] >= (u * t - spread if u * t - spread > -1 and t > -u else -1.0)) & (unit[:, focus] <= (u * t + spread if t > u else 1.0)))
            scores = vectors[places] @ q[at]
            chosen, exact = best(scores, ids[places], q_ids[at], k, q[at], vectors[places], q_norms[at] * norms[0])
            yield np.full(len(chosen), q_ids[at]), ids[places][chosen], exact


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """Rows of both sides, sorted by (cell, side), → the found rows of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def cells() -> Iterator[pa.Table]:
            held: list[pa.Table] = []
            for batch in batches:
                at, keys = 0, batch.column("cell").to_numpy()
                for cut in [*np.flatnonzero(np.diff(keys)) + 1, len(keys)]:
                    if held and held[0].column("cell")[0].as_py() != keys[at]:
                        yield pa.concat_tables(held)
                        held = []
                    held.append(pa.Table.from_batches([batch.slice(at, cut - at)]))
                    at = cut
            if held:
                yield pa.concat_tables(held)

        for cell in cells():
            is_query = cell.column("is_query").to_numpy(zero_copy_only=False)
            split = int(is_query.sum())
            if not 0 < split < len(is_query):
                continue
            queries, rest = cell.slice(0, split), cell.slice(split)
            norms = rest.column("norm").to_numpy()
            order = np.argsort(-norms, kind="stable")
            found = list(search_block(queries, rest.column("vec_id").to_numpy()[order], matrix(rest.column("v"))[order], norms[order], k))
            if found:
                a, b, c = (np.concatenate(x) for x in zip(*found))
                yield {"query_id": a, "vec_id": b, "score": c}

    return arrow_map(pairs, run, FOUND)


def top_k(vectors: DataFrame, is_query, k: int = 5, width: float = 1.15, block: int = 16_384, query_block: int = 2_048, scale: float = 256.0) -> DataFrame:
    """``vectors(vec_id, embedding)`` → query_id, rank, vec_id, score for rows where ``is_query`` (a Column over vec_id) holds."""
    store = Stored(vectors.sparkSession)
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(width))).otherwise(-1_000_000).cast("long")
    rows = store.put(quantized(vectors, scale).withColumn("bucket", bucket))
    # at most some hundred buckets for each dimension, whatever the number of rows
    sizes = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).orderBy("dim", F.desc("bucket")).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # buckets short of a block join the next shorter ones
    blocks, of, left, total = [], {}, 0, 0
    for r in sizes:
        if left > 0 and blocks[-1]["dim"] == r["dim"] and blocks[-1]["n"] + r["n"] <= block:
            blocks[-1]["n"] += r["n"]
        else:
            blocks.append({"group": len(blocks), "dim": r["dim"], "n": r["n"], "longest": r["longest"]})
        left = block - blocks[-1]["n"]
        of[r["dim"], r["bucket"]] = blocks[-1]["group"]
        total += r["n"]
    spark = vectors.sparkSession
    groups = spark.createDataFrame([(d, b, g, max(1, -(-blocks[g]["n"] // block))) for (d, b), g in of.items()], "dim int, bucket long, grp long, parts long")
    limits = spark.createDataFrame([(b["dim"], b["group"], float(b["longest"]), max(1, -(-b["n"] // block))) for b in blocks], "dim int, grp long, longest double, parts long")
    first = {}
    for b in blocks:
        first.setdefault(b["dim"], b["group"])

    data = rows.join(F.broadcast(groups), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    n_blocks = max(1, -(-total // (50 * query_block)))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("q")).select("vec_id", "q.*")
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)))

    def meet(asked: DataFrame, candidates: DataFrame) -> DataFrame:
        """asked: with grp, part, qb and bound; candidates: dealt to the query blocks that ask for their block."""
        wanted = asked.select("grp", "part", "qb").distinct()
        cell = F.xxhash64("grp", "part", "qb")
        a = asked.select(cell.alias("cell"), F.lit(True).alias("is_query"), "vec_id", "v", "norm", "bound")
        b = candidates.join(wanted, ["grp", "part"]).select(cell.alias("cell"), F.lit(False).alias("is_query"), "vec_id", "v", "norm", F.lit(0.0).alias("bound"))
        both = a.unionByName(b).repartition("cell").sortWithinPartitions("cell", F.desc("is_query"))
        return _meet(both, k)

    start = F.broadcast(spark.createDataFrame([(d, g) for d, g in first.items()], "dim int, grp long"))
    opening = queries.join(start, "dim").withColumns({"part": F.lit(0).cast("long"), "bound": F.lit(float("-inf"))})
    seen = store.put(meet(opening, data.join(start, ["dim", "grp"], "left_semi").where("part = 0")))
    kth = seen.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= k)
    bounded = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").withColumn("bound", F.coalesce("kth", F.lit(float("-inf"))))
    asked = bounded.join(F.broadcast(limits), "dim").where((F.col("bound") <= 0) | (F.col("bound") <= F.col("norm") * F.col("longest") * (1 + SLACK)))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    opened = F.lit(False)
    for d, g in first.items():
        opened = opened | ((F.col("dim") == d) & (F.col("grp") == g) & (F.col("part") == 0))
    asked = store.put(asked.where(~opened).select("grp", "part", "qb", "vec_id", "v", "norm", "bound"))
    found = seen.unionByName(meet(asked, data))
    pick = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id")))), 1, k)
    out = found.groupBy("query_id").agg(pick.alias("best")).select("query_id", F.posexplode("best").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
