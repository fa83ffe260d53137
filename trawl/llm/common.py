"""Helpers that the operators share: shared-storage tables, row keys, components, Arrow loops.

Conventions that hold for every operator of this subpackage
* Rows are addressed by ``(ID, KEY)``: the doc_id (null becomes the smallest long) and, if
  doc_ids repeat, the XXH64 of the text.  Rows that agree in both are the same row repeated and get equal results.
* Working columns start with ``__``; callers' own columns may have any other name.
* What must be read more than once is written to the folder of ``spark.checkpoint.dir``
  (a lost executor then loses nothing), never kept with localCheckpoint.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID, KEY = "__id", "__key"
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where there is one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trawl-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Stored:
    """Tables written to shared storage; ``drop`` removes those that no later plan reads.

    A result reads some of them when it is computed, so the rest goes by ``release`` or at the driver's end.
    """

    kept: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/trawl-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        Stored.kept.append((spark, self.root))

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                delete(self.spark, path)

    @staticmethod
    @atexit.register
    def release() -> None:
        """Deletes all tables of this driver; results that were not written or collected can't be computed afterwards."""
        while Stored.kept:
            with contextlib.suppress(Exception):  # the session may be gone
                delete(*Stored.kept.pop())


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the row address ``ID``, ``KEY``; where all ids differ the ids suffice and ``KEY`` is 0."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    repeated = docs.select(ids.alias("id")).groupBy("id").count().where("count > 1")
    return docs.withColumns({ID: ids, KEY: F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64(F.col(text_col))})


def plain(docs: DataFrame) -> DataFrame:
    """ID, KEY, doc_id and text of ``docs``, in the types that the operators take."""
    return keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``df.mapInArrow`` for a generator of column dicts (numpy arrays, lists or Arrow arrays)."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[part.strip().split(" ")[1]] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            arrays = []
            for name, kind in zip(names, types):
                values = columns[name]
                arrays.append(values if isinstance(values, pa.Array) else pa.array(values, type=kind))
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values with their bits kept, as Spark longs."""
    return np.ascontiguousarray(h, dtype=np.uint64).view(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    out = h >> np.uint64(30)
    out ^= h
    h = out
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def key_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 400_000, size: int = 1 << 26) -> Iterator[pa.Table]:
    """Regroups a partition sorted by ``key`` into tables that never cut a group in two.

    Memory: about ``rows`` rows or ``size`` bytes, or one group if that is larger; callers bound their groups.
    """
    for table, whole in group_pieces(batches, key, rows, size):
        assert whole
        yield table


def lots(table: pa.Table, key: str, rows: int) -> Iterator[pa.Table]:
    """A table sorted by ``key`` in parts of about ``rows`` rows that never cut a group in two."""
    if not table.num_rows:
        return
    keys, begin = table.column(key).to_numpy(), 0
    starts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    while begin < len(keys):
        at = int(np.searchsorted(starts, begin + rows, side="right")) - 1
        end = int(starts[at] if starts[at] > begin else starts[at + 1])
        yield table.slice(begin, end - begin)
        begin = end


def group_pieces(batches: Iterator[pa.RecordBatch], key: str, rows: int, size: int = 1 << 26, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Like ``key_groups``, but a group of more than ``most`` rows comes in pieces of its own, marked False."""
    held: list[pa.Table] = []
    count = weight = 0
    limit, cut_key = rows, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        weight += batch.nbytes
        if count < limit and weight < size:
            continue
        table = pa.concat_tables(held)
        keys = table.column(key).to_numpy()
        if cut_key is not None and keys[0] == cut_key:
            end = int(np.searchsorted(keys, cut_key, side="right"))
            yield table.slice(0, end), False
            table, keys = table.slice(end), keys[end:]
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
        for part in lots(table.slice(0, cut), key, rows):
            yield part, True
        table = table.slice(cut)
        if most is not None and table.num_rows > most:
            cut_key = keys[-1]
            yield table, False
            table = table.slice(table.num_rows)
        held, count, weight = [table] if table.num_rows else [], table.num_rows, table.nbytes
        limit, size = max(rows, 2 * count), max(size, 2 * weight)
    if held:
        table = pa.concat_tables(held)
        if cut_key is not None:
            end = int(np.searchsorted(table.column(key).to_numpy(), cut_key, side="right")) if table.column(key)[0].as_py() == cut_key else 0
            if end:
                yield table.slice(0, end), False
            table = table.slice(end)
        for part in lots(table, key, rows):
            yield part, True


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def connected_components(edges: DataFrame, store: Stored) -> DataFrame:
    """``edges(u long, v long)`` → ``(node long, root long)`` for every node that has a link.

    Distributed contraction: each node hooks onto its smallest neighbour, pointers are
    doubled until they reach the roots, and links are renamed to roots, which leaves at most
    half of the nodes; so there are O(log n) rounds.  Only joins and map-side combined minima,
    no list of a node's neighbours is ever built; nothing but row counts reaches the driver.
    """
    links = store.put(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = store.put(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        if parent.isEmpty():
            break
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            doubled = store.put(parent.join(up, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moved = not doubled.where("moved").isEmpty()
            store.drop(parent)
            parent = doubled
            if not moved:
                break
        parent = parent.select("u", "p")
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = store.put(labels.join(parent.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        ends = links.join(parent, "u").select(F.col("p").alias("a"), F.col("v"))
        ends = ends.join(parent.select(F.col("u").alias("v"), "p"), "v").select("a", F.col("p").alias("b"))
        links = store.put(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if links.isEmpty():
            break
    if labels is None:
        labels = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
