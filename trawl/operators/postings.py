"""An inverted index for BM25: blocks of postings stored by term, and searches that read only the asked terms.

``blocks``: one row for up to ``BLOCK`` postings of a term in a segment, ids in order: bucket, term, segment, no (of the block, from 0), n, ids,
tfs (occurrences), lens (tokens of the document), most (largest tf) and shortest (smallest length).  The last two bound
what any posting of the block can add to a score, whatever the statistics of the searched scope.  Files are parted by
``bucket`` (a hash of the term) and sorted by term, so a search opens the buckets of its terms and skips row groups.
``docs``: doc_id, segment, len and any columns that scopes filter on; no text.

A segment is a hash part of the documents of bounded size.  A search sends the asked blocks, not postings, to their
segments, where the best ``k`` of the segment are found with bounds (documents that can't reach the k-th best are
dropped, blocks without a live document are passed over); so k rows per query and segment are exchanged, however
common a term is.  Queries meet the blocks in groups of about ``QUERIES``, so neither a table of many queries nor
a term that all of them ask for grows a row without bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions.text import tokens
from .bm25 import K1, LEAST, B

BLOCK, SEGMENT, QUERIES, NAMED, FEW_TERMS, LOT = 128, 1 << 14, 2048, 200, 5000, 1000
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


@dataclass
class Index:
    blocks: DataFrame
    docs: DataFrame
    buckets: int
    sizes: dict[str, float] = field(default_factory=dict)  # n and mean of all documents
    partial: bool = False  # blocks also hold documents that ``docs`` doesn't


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Terms:
    """The postings of one segment's documents, which come in the order of their ids: counted batch by batch, held as numbers."""

    def __init__(self, id_type: pa.DataType):
        self.ids: list[pa.Array] = [pa.array([], id_type)]
        self.words: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs = self.terms = 0

    def add(self, ids: pa.Array, lists: pa.Array) -> None:
        words = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        width = max(1, len(words.dictionary))
        keys, tf = np.unique(row * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row = keys // width
        self.parts.append(((keys % width + self.terms).astype(np.int32), (row + self.docs).astype(np.int32), tf.astype(np.int32), sizes[row].astype(np.int32)))
        self.words.append(words.dictionary)
        self.ids.append(ids)
        self.docs, self.terms = self.docs + len(ids), self.terms + len(words.dictionary)

    def blocks(self, segment: int, block: int, lot: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        """The blocks, of up to ``block`` postings, by term and id, in lots of about ``lot`` postings."""
        words = pa.concat_arrays([*self.words, pa.array([], pa.string())]).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        columns = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts = []
        columns[0] = place[words.indices.to_numpy(zero_copy_only=False)][columns[0]]
        by_term = np.argsort(columns[0], kind="stable").astype(np.int32)  # documents came in order
        for k in range(4):  # one at a time, for memory
            columns[k] = columns[k][by_term]
        code, doc, tf, length = columns
        if not len(code):
            return
        at = np.arange(len(code), dtype=np.int32)
        begin_of = np.maximum.accumulate(np.where(np.append(True, code[1:] != code[:-1]), at, np.int32(0)))
        begins = np.flatnonzero((at - begin_of) % block == 0)
        ends, no = np.append(begins[1:], len(code)), (begins - begin_of[begins]) // block
        ids = pa.concat_arrays(self.ids)
        most, shortest = np.maximum.reduceat(tf, begins), np.minimum.reduceat(length, begins)
        cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(code), lot)), len(begins)))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
            span = slice(int(begins[i]), int(ends[j - 1]))
            offsets = pa.array(np.append(begins[i:j], span.stop) - span.start, pa.int32())
            listed = lambda values: pa.ListArray.from_arrays(offsets, values)  # noqa: B023, E731
            terms = words.dictionary.take(pa.array(order[code[begins[i:j]]]))
            arrays = [terms, pa.array(np.full(j - i, segment, np.int32)), pa.array(no[i:j], pa.int32()), pa.array(ends[i:j] - begins[i:j], pa.int32()), listed(ids.take(pa.array(doc[span]))), listed(pa.array(tf[span])), listed(pa.array(length[span])), pa.array(most[i:j], pa.int32()), pa.array(shortest[i:j], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "segment", "no", "n", "ids", "tfs", "lens", "most", "shortest"])


def blocked(rows: DataFrame) -> DataFrame:
    """Blocks of the postings of ``rows(segment, id, t)``, which come sorted by segment and id; a task holds one segment at a time."""
    block, lot = BLOCK, LOT

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Terms | None = None
        last = None
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
            for i, j in zip(cuts, cuts[1:]):
                if held is not None and i < j and segment[i] != last:
                    yield from held.blocks(last, block)
                    held = None
                for k in range(i, j, lot):
                    held = held or Terms(batch.schema.field("id").type)
                    held.add(batch.column("id").slice(k, min(lot, j - k)), batch.column("t").slice(k, min(lot, j - k)))
                    last = int(segment[i])
        if held is not None:
            yield from held.blocks(last, block)

    schema = ty.StructType([
        ty.StructField("term", ty.StringType()), ty.StructField("segment", ty.IntegerType()), ty.StructField("no", ty.IntegerType()), ty.StructField("n", ty.IntegerType()), ty.StructField("ids", ty.ArrayType(rows.schema["id"].dataType)),
        ty.StructField("tfs", ty.ArrayType(ty.IntegerType())), ty.StructField("lens", ty.ArrayType(ty.IntegerType())), ty.StructField("most", ty.IntegerType()), ty.StructField("shortest", ty.IntegerType()),
    ])
    return rows.mapInArrow(build, schema)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), buckets: int = 16, segment_size: int = SEGMENT) -> Index:
    """Builds the index of ``docs`` (ids differ and are not null) under ``path``; ``keep``: further columns of ``docs`` that scopes filter on."""
    spark = docs.sparkSession
    segments = max(spark.sparkContext.defaultParallelism, -(-docs.count() // segment_size))
    lengths = docs.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(id_col), F.lit(segments)).cast("int").alias("segment"), F.size(tokens(F.col(text_col))).alias("len"), *keep)
    lengths.write.parquet(f"{path}/docs")
    # texts, not postings, are exchanged and sorted; then each segment's postings are counted where they are stored
    texts = docs.select(F.pmod(F.xxhash64(id_col), F.lit(segments)).cast("int").alias("segment"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = texts.repartition(segments, "segment").sortWithinPartitions("segment", "id").select("segment", "id", tokens(F.col("t")).alias("t"))
    rows = blocked(rows).withColumn("bucket", bucket_of("term", buckets))
    rows.sortWithinPartitions("bucket", "term", "segment").write.partitionBy("bucket").parquet(f"{path}/blocks")
    return read(spark, path, buckets)


def read(spark: SparkSession, path: str, buckets: int = 16) -> Index:
    return joined(spark, [path], buckets)


def joined(spark: SparkSession, paths: list[str], buckets: int = 16, live: DataFrame | None = None) -> Index:
    """Several parts, oldest first, as one index: of each document the newest part's postings, and only if it is in ``live(doc_id)``."""
    docs = blocks = None
    for k, path in enumerate(paths):
        # segments of different parts stay apart
        d = spark.read.parquet(f"{path}/docs").withColumn("segment", F.col("segment") + (k << 20))
        b = _blocks(spark, path, d).withColumn("segment", F.col("segment") + (k << 20))
        docs, blocks = (d, b) if docs is None else (docs.unionByName(d), blocks.unionByName(b))
    if len(paths) > 1:
        newest = F.max_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), "segment").alias("__row")
        docs = docs.groupBy("doc_id").agg(newest).select("doc_id", "__row.*")
    if live is not None:
        docs = docs.join(live.select("doc_id"), "doc_id", "left_semi")
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    return Index(blocks, docs, buckets, {"n": float(row["n"]), "mean": row["mean"] or 0.0}, len(paths) > 1 or live is not None)


def _blocks(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"term string, segment int, no int, n int, ids array<{kind}>, tfs array<int>, lens array<int>, most int, shortest int, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def asked_blocks(index: Index, terms: DataFrame) -> DataFrame:
    """The blocks of ``terms(term)``: up to ``NAMED`` are named in the scan, more come by a semi join with their buckets,
    up to ``FEW_TERMS`` of them as a local relation."""
    few = [r["term"] for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) > FEW_TERMS:
        wanted = terms.select("term").distinct().withColumn("bucket", bucket_of("term", index.buckets))
        return index.blocks.join(wanted, ["bucket", "term"], "left_semi").select(*index.blocks.columns)
    local = terms.sparkSession.createDataFrame(pa.table({"term": pa.array(few, pa.string())}))  # evaluated on the driver, without a job
    if len(few) > NAMED:
        return index.blocks.join(local.withColumn("bucket", bucket_of("term", index.buckets)), ["bucket", "term"], "left_semi").select(*index.blocks.columns)
    buckets = {r["b"] for r in local.select(bucket_of("term", index.buckets).alias("b")).collect()}
    return index.blocks.where(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(few))


def restricted(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """The blocks with the postings of ``docs(doc_id, segment)`` only; a segment's ids meet its blocks in one task."""
    kind = blocks.schema
    ids = docs.groupBy("segment").agg(F.collect_list("doc_id").alias("ids"))  # a segment has a bounded number of documents
    head = ids.select(F.lit(None).cast("string").alias("term"), "segment", "ids", F.lit(None).cast("array<int>").alias("tfs"), F.lit(None).cast("array<int>").alias("lens"), F.lit(None).cast("int").alias("bucket"))
    both = head.unionByName(blocks.select("term", "segment", "ids", "tfs", "lens", "bucket")).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("term"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, known, last, no = None, None, None, 0
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                here, values = batch.column("segment")[k].as_py(), batch.column("ids")[k].values
                if not batch.column("term")[k].is_valid:
                    segment, known = here, values
                    continue
                there = pc.is_in(values, value_set=known) if here == segment else pa.array([False] * len(values))
                tfs, lens = batch.column("tfs")[k].values.filter(there), batch.column("lens")[k].values.filter(there)
                if len(tfs):
                    term = batch.column("term")[k].as_py()
                    no = no + 1 if (term, here) == last else 0
                    last = (term, here)
                    out.append((term, here, no, len(tfs), values.filter(there), tfs, lens, pc.max(tfs).as_py(), pc.min(lens).as_py(), batch.column("bucket")[k].as_py()))
            if out:
                columns = list(zip(*out))
                lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])), pa.int32()), pa.concat_arrays(parts))
                arrays = [pa.array(c, pa.string()) if i == 0 else lists(c) if i in (4, 5, 6) else pa.array(c, pa.int32()) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, kind.names)

    return both.mapInArrow(keep, kind)


def one_query(spark: SparkSession, terms: list[str]) -> DataFrame:
    """The table of one query, 0, as a local relation."""
    return spark.createDataFrame(pa.table({"query": pa.array([0], pa.int32()), "terms": pa.array([terms], pa.list_(pa.string()))}))


def weights(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a posting adds to a score, but for the term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Segment:
    """The asked blocks of a segment: per term its documents' places, weights, and a bound for each block."""

    def __init__(self, rows: pa.Table, mean: float):
        ids = pa.chunked_array([x.flatten() for x in rows.column("ids").chunks]) if rows.num_rows else rows.column("ids")
        coded = ids.combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = coded.dictionary.take(pa.array(order))
        docs = place[coded.indices.to_numpy()]
        flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in rows.column(c).chunks]).astype(np.float64)
        w = weights(flat("tfs"), flat("lens"), mean)
        n = rows.column("n").to_numpy()
        bound = weights(rows.column("most").to_numpy().astype(np.float64), rows.column("shortest").to_numpy().astype(np.float64), mean)
        ends = np.cumsum(n)
        self.terms: dict[str, list[tuple[np.ndarray, np.ndarray, float]]] = {}
        for k, term in enumerate(rows.column("term").to_pylist()):
            self.terms.setdefault(term, []).append((docs[ends[k] - n[k] : ends[k]], w[ends[k] - n[k] : ends[k]], float(bound[k])))

    def best(self, asked: list[tuple[str, float]], k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best ``k`` for terms with their idf: scores rounded to ``digits``, ties to smaller ids."""
        score, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        lists = sorted(((idf, self.terms[t]) for t, idf in asked if t in self.terms), key=lambda x: -x[0] * max(b for _, _, b in x[1]))
        ahead = [idf * max(b for _, _, b in blocks) for idf, blocks in lists]
        alive = None  # None: any document may still be among the best
        for i, (idf, blocks) in enumerate(lists):
            if alive is None and seen.any() and k <= len(score):
                least = np.partition(score, len(score) - k)[len(score) - k] - 2 * 10.0**-digits
                if least > sum(ahead[i:]):  # unseen documents are out; of the seen ones those that the blocks' bounds can't lift
                    reach = score.copy()
                    for later_idf, later in lists[i:]:
                        for docs, _, bound in later:
                            reach[docs] += later_idf * bound
                    alive = seen & (reach >= least)
            for docs, w, _ in blocks:
                if alive is None:
                    score[docs] += idf * w
                    seen[docs] = True
                elif (live := alive[docs]).any():
                    score[docs[live]] += idf * w[live]
        found = np.flatnonzero(seen if alive is None else alive)
        order = np.lexsort((found, -np.round(score[found], digits)))[:k]
        return found[order], score[found[order]]


def search(index: Index, queries: DataFrame, k: int, query_col: str = "query", within: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """``queries(query, terms)`` → query, doc_id, bm25, rank (from 1): each query's best ``k`` documents that hold a term of it.

    ``within``: rows of ``index.docs``; the statistics then are those of these documents.  Fewer than three give no hits.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_col).alias("query"), F.explode(F.array_distinct("terms")).alias("term"))
    blocks, n, mean = asked_blocks(index, asked), index.sizes["n"], index.sizes["mean"]
    if within is not None:
        row = within.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
        n, mean = float(row["n"]), row["mean"] or 0.0
    if within is not None or index.partial:
        blocks = restricted(blocks, index.docs if within is None else within)
    id_type, query_type = index.docs.schema["doc_id"].dataType, queries.schema[query_col].dataType
    schema = ty.StructType([ty.StructField("query", query_type), ty.StructField("doc_id", id_type), ty.StructField("bm25", ty.DoubleType())])
    if n < LEAST or mean <= 0:
        return spark.createDataFrame([], schema).withColumns({"rank": F.lit(0)})
    df = blocks.groupBy("term").agg(F.sum("n").cast("double").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    groups = max(1, -(-queries.count() // QUERIES))
    group = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")
    by_term = asked.join(df, "term").groupBy("term", group.alias("group")).agg(F.collect_list(F.struct("query", idf.alias("idf"))).alias("asked"))
    # who asks for a term stands with the first of its blocks in a segment
    rows = blocks.join(by_term, "term").select("segment", "group", "term", "n", "ids", "tfs", "lens", "most", "shortest", F.when(F.col("no") == 0, F.col("asked")).alias("asked"))
    rows = rows.repartition("segment", "group").sortWithinPartitions("segment", "group")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches):
            segment = Segment(table, mean)
            queries_: dict = {}
            first = table.filter(pc.is_valid(table.column("asked")))
            for term, asked in zip(first.column("term").to_pylist(), first.column("asked").to_pylist()):
                for x in asked:
                    queries_.setdefault(x["query"], []).append((term, x["idf"]))
            found = [(q, *segment.best(sorted(a), k, digits)) for q, a in queries_.items()]
            if found:
                q = pa.array([q for q, d, _ in found for _ in d], table.schema.field("asked").type.value_type.field("query").type)
                yield pa.RecordBatch.from_arrays([q, segment.ids.take(pa.array(np.concatenate([d for _, d, _ in found]))), pa.array(np.concatenate([s for _, _, s in found]))], ["query", "doc_id", "bm25"])

    best = rows.mapInArrow(find, schema).withColumn("bm25", F.round("bm25", digits))
    order = Window.partitionBy("query").orderBy(F.desc("bm25"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (segment, group), which come together; bounded by a segment's postings of the asked terms."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column("segment").to_numpy().astype(np.int64) << 32 | batch.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and key[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[a]
    if held:
        yield pa.Table.from_batches(held)
