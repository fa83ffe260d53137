"""Building and updating an index: list, compare, chunk, store; incremental runs equal full ones.

An update lists the files, reads those whose size or time changed, and chunks those whose content did.  What it writes
to each table is a change of that size (``operators.tables``): nothing else is read in full or written again.  All
tables but blobs and fingerprints have the chunk's id as their key, in equally many buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, codemap, graph, maintain, postings, storage
from ..operators.tables import Table, Version
from ..sources import files

CHUNKS = (
    "id string, file_path string, symbol string, sha string, lang string, chunk_type string, code string, start_line int, end_line int, "
    "tags array<string>, intent string, description string, doc_comments string"
)
VECTORS = "id string, sha string, embedding array<float>"
BLOBS = "sha string, payload binary, encrypted boolean"
PRINTS = "path string, file_hash string, length long, modified timestamp, chunk_hashes array<string>"
PARTS = 8  # of the inverted index before it is built anew


class Tables:
    """The tables of an index under a folder."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out
        self.chunks = Table(spark, f"{out}/chunks", CHUNKS)
        self.symbols = Table(spark, f"{out}/symbols", codemap.SCHEMA, "chunk_id")
        self.edges = Table(spark, f"{out}/edges", graph.EDGES, "sha")
        self.vectors = Table(spark, f"{out}/vectors", VECTORS)
        self.blobs = Table(spark, f"{out}/blobs", BLOBS, "sha")
        self.prints = Table(spark, f"{out}/fingerprints", PRINTS, "path")

    def postings(self) -> postings.Index | None:
        """The inverted index of the chunks that have a vector; None where nothing has one."""
        version = self.vectors.version()
        said = json.loads(version.extra)
        if not said.get("postings"):
            return None
        live = self.vectors.reads(version).select(F.col("id").alias("doc_id")) if said["stale"] else None
        return postings.joined(self.spark, [f"{self.out}/postings/{p}" for p in said["postings"]], live=live)


def described(chunks: DataFrame) -> DataFrame:
    """Chunks with what their comment and code say of them: tags, intent, description, doc_comments."""
    doc = T.doc_comment(F.col("before"), F.col("lang"))
    rows = chunks.withColumn("doc_comments", doc)
    doc = F.coalesce("doc_comments", F.lit(""))
    tags = T.merged_tags(T.annotation_tags(doc), T.semantic_tags(F.col("file_path"), F.col("symbol"), F.col("code")))
    return rows.withColumns({"tags": tags, "intent": T.annotation(doc, "intent"), "description": T.annotation(doc, "description")}).drop("before")


def to_embed(chunks: DataFrame) -> DataFrame:
    """Chunks with ``text``: what is embedded, that is comment, code, intent, description, tags and variables."""
    names = F.transform(T.variables(F.col("code")), lambda v: v["name"])
    return chunks.withColumn("text", T.embedding_text(F.col("doc_comments"), F.col("code"), F.col("intent"), F.col("description"), F.col("tags"), names))


def keyword_rows(chunks: DataFrame) -> DataFrame:
    """What the inverted index holds of chunks: symbol, path, description, intent and code as one text, and the columns that scopes read."""
    text = T.keyword_document(*[F.col(c) for c in ("symbol", "file_path", "description", "intent", "code")])
    return chunks.select(F.col("id").alias("doc_id"), text.alias("text"), "file_path", "lang", "tags", "intent")


def index_files(current: DataFrame, limits: chunking.Limits = chunking.Limits()) -> tuple[DataFrame, DataFrame]:
    """``current(path, lang, content, file_hash)`` → (chunks, fingerprints)."""
    chunks = described(chunking.chunk(current, limits))
    prints = chunks.groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_set("sha")).alias("chunk_hashes"))
    return chunks, current.select("path", "file_hash").join(prints, "path", "left")


def update(stored: DataFrame, fingerprints: DataFrame, current: DataFrame, limits: chunking.Limits = chunking.Limits()) -> DataFrame:
    """The chunks after a change of files: unchanged files keep theirs, changed ones are chunked anew, deleted ones lose theirs."""
    new = maintain.changed(current, fingerprints)
    kept = stored.join(current.select(F.col("path").alias("file_path")), "file_path", "left_semi").join(new.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    return kept.select(*stored.columns).unionByName(described(chunking.chunk(new, limits)).select(*stored.columns))


def new_chunks(produced: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose id is not stored yet: only these need vectors."""
    return produced.join(stored.select("id"), "id", "left_anti")


class Scratch:
    """Tables of one run, written once and deleted at its end."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.root, self.count = spark, f"{out}/scratch/{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def store_changes(
    tables: Tables, scratch: Scratch, touched: DataFrame, read: DataFrame, gone: DataFrame, limits: chunking.Limits, embed: Callable[[DataFrame], DataFrame] | None, key: bytes | None
) -> dict[str, Any]:
    """``touched(path)``: files whose chunks may change; ``read``: contents of those that are there; ``gone(path)``: those that are not.

    Fingerprints come last, so what a stopped run left undone is done by the next one.
    """
    seen = Observation()
    produced = scratch.put(described(chunking.chunk_counted(read, seen, limits)))
    paths = touched.select(F.col("path").alias("file_path"))
    change: dict[str, DataFrame] = {}

    def chunks(stored: DataFrame, _: Version) -> tuple[DataFrame, DataFrame]:
        old = stored.join(paths, "file_path", "left_semi").select("id", "sha", "symbol")
        change["added"] = scratch.put(produced.join(old.select("id"), "id", "left_anti").select("id", "sha", "symbol"))
        change["removed"] = scratch.put(old.join(produced.select("id"), "id", "left_anti"))
        return produced, change["removed"]

    tables.chunks.change(chunks)
    added, removed = change["added"], change["removed"]
    counts = {"added": added.count(), "removed": removed.count(), "chunks": tables.chunks.read().count(), "statistics": seen.get}
    if counts["added"] or counts["removed"]:
        symbols(tables, scratch, produced, added, removed)
        blobs(tables, produced, removed, key)
        if embed is not None:
            vectors(tables, scratch, produced, removed, embed)
    hashes = produced.groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_set("sha")).alias("chunk_hashes"))
    tables.prints.change(lambda *_: (read.select("path", "file_hash", "length", "modified").join(hashes, "path", "left"), gone))
    return counts


def symbols(tables: Tables, scratch: Scratch, produced: DataFrame, added: DataFrame, removed: DataFrame) -> None:
    """The symbol map with the call graph: entries of the produced chunks, then edges and neighbours of what they affect."""
    ids = removed.select(F.col("id").alias("chunk_id"))
    tables.symbols.change(lambda stored, _: (codemap.merged(stored.join(produced.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), codemap.of_chunks(produced)), ids))
    whole = tables.symbols.read()
    changed = added.unionByName(removed).select("sha", "symbol")
    shas = scratch.put(graph.affected(whole, changed))
    lists = scratch.put(graph.edge_lists(graph.callers(whole).join(shas, "sha", "left_semi"), whole))
    before = scratch.put(graph.flat(tables.edges.read().join(shas, "sha", "left_semi")).select(F.col("dst").alias("sha")).distinct())
    tables.edges.change(lambda *_: (lists, shas.join(lists.select("sha"), "sha", "left_anti")))
    nodes = scratch.put(shas.unionByName(before).unionByName(graph.flat(lists).select(F.col("dst").alias("sha"))).distinct())
    tables.symbols.change(lambda stored, _: (graph.with_neighbours(stored, tables.edges.read(), nodes), None))


def blobs(tables: Tables, produced: DataFrame, removed: DataFrame, key: bytes | None) -> None:
    """New contents are packed; those that no chunk has any more go."""
    dead = removed.select("sha").distinct().join(tables.chunks.read().select("sha"), "sha", "left_anti")
    tables.blobs.change(lambda stored, _: (storage.write_blobs(produced.select("sha", "code").join(stored.select("sha"), "sha", "left_anti"), key), dead))


def vectors(tables: Tables, scratch: Scratch, produced: DataFrame, removed: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> None:
    """Vectors and a part of the inverted index for chunks that have none yet."""
    spark, part = tables.spark, uuid.uuid4().hex
    before = tables.vectors.version()
    new = scratch.put(new_chunks(produced, tables.vectors.reads(before)))
    # without rows there is nothing to ask a provider for
    fresh = scratch.put(embed(to_embed(new)).select("id", "sha", "embedding").where("embedding IS NOT NULL"))
    keep = ("file_path", "lang", "tags", "intent")
    postings.write(keyword_rows(new.join(fresh.select("id"), "id", "left_semi")), f"{tables.out}/postings/{part}", keep=keep)

    def said(version: Version) -> dict:
        known = json.loads(version.extra)
        return {"postings": [*known.get("postings", []), part], "stale": known.get("stale", False) or not removed.isEmpty()}

    after = tables.vectors.change(lambda *_: (fresh, removed.select("id")), said)
    if len(json.loads(after.extra)["postings"]) > PARTS:
        whole = uuid.uuid4().hex
        rows = tables.chunks.read().join(tables.vectors.reads(after).select("id"), "id", "left_semi")
        postings.write(keyword_rows(rows), f"{tables.out}/postings/{whole}", keep=keep)
        empty = spark.createDataFrame([], "id string")
        # vectors that another writer added meanwhile have a part of their own
        older = set(json.loads(after.extra)["postings"])
        tables.vectors.change(lambda *_: (None, empty), lambda v: {"postings": [whole, *[p for p in json.loads(v.extra)["postings"] if p not in older]], "stale": v.number != after.number})


def index_folder(spark: SparkSession, root: str, out: str, limits: chunking.Limits = chunking.Limits(), embed: Callable[[DataFrame], DataFrame] | None = None, key: bytes | None = None) -> dict[str, Any]:
    """A full index of ``root`` under ``out``: every file is read and chunked; what is stored already keeps its vector."""
    tables = Tables(spark, out)
    with Scratch(spark, out) as scratch:
        read = files.scan(spark, root)
        gone = scratch.put(maintain.missing(tables.prints.read().select("path"), read.select("path"), "path"))
        touched = read.select("path").unionByName(gone)
        return store_changes(tables, scratch, touched, read, gone, limits, embed, key)


def update_folder(spark: SparkSession, root: str, out: str, limits: chunking.Limits = chunking.Limits(), embed: Callable[[DataFrame], DataFrame] | None = None, key: bytes | None = None) -> dict[str, Any]:
    """Brings the index up to date: only files whose size or time differs are opened, only those whose content differs are chunked anew."""
    tables = Tables(spark, out)
    with Scratch(spark, out) as scratch:
        prints = tables.prints.read()
        listed = scratch.put(files.listing(spark, root))
        return changes(tables, scratch, files.contents(spark, root, files.candidates(listed, prints)), maintain.missing(prints.select("path"), listed, "path"), limits, embed, key)


def update_paths(spark: SparkSession, root: str, out: str, events: DataFrame, limits: chunking.Limits = chunking.Limits(), embed: Callable[[DataFrame], DataFrame] | None = None, key: bytes | None = None) -> dict[str, Any]:
    """``events(path, op)`` (upsert or delete, one for each path, as from the watch service): only these files are looked at."""
    tables = Tables(spark, out)
    with Scratch(spark, out) as scratch:
        there, absent = files.scan_changed(spark, root, events.select("path"))
        known = tables.prints.read().select("path").join(absent.unionByName(events.where("op = 'delete'").select("path")).distinct(), "path", "left_semi")
        gone = known.join(there.select("path"), "path", "left_anti")
        return changes(tables, scratch, there, gone, limits, embed, key)


def changes(tables: Tables, scratch: Scratch, read: DataFrame, gone: DataFrame, limits: chunking.Limits, embed: Callable[[DataFrame], DataFrame] | None, key: bytes | None) -> dict[str, Any]:
    """Stores what differs of the files in ``read`` and that those in ``gone`` are no more."""
    prints = tables.prints.read()
    read, gone = scratch.put(read), scratch.put(gone)
    new = scratch.put(maintain.changed(read, prints))
    counts: dict[str, Any] = {"added": 0, "removed": 0, "chunks": tables.chunks.read().count()}
    if not new.isEmpty() or not gone.isEmpty():
        counts = store_changes(tables, scratch, new.select("path").unionByName(gone), new, gone, limits, embed, key)
    # a file that was only touched is not opened again
    same = read.join(new.select("path"), "path", "left_anti").join(prints.select("path", "chunk_hashes"), "path")
    if not same.isEmpty():
        tables.prints.upsert(same)
    return counts
