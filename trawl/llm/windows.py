"""What the two exact substring operators share: anchors, their repeats, runs, classes.

Both judge windows of a fixed length.  Each window gets one *anchor*, a place chosen by the
window's content alone, so equal windows have equal anchors at equal offsets; neighbouring windows
mostly share theirs, so a run of windows is one row (key, ID, KEY, place): the anchor's content hash,
the row, and ``packed`` the anchor's place and the first and last window start.  Only keys that occur
twice can hold repeats.  Runs of equal content form a class; inside a class every window repeats, and only
the first runs of the classes of one key must be compared with each other.

Scale: a key that a task sees more than once sends one witness row to the task that judges the key;
its runs are known to repeat and are dealt out by row.  So the hottest key costs a row a batch.
Classes are counted map-side combined.  A class is its key, ``r`` (a polynomial hash of the runs' contents and
shape) and ``d`` (a BLAKE2b digest of the contents): where contents collide in ``r``, ``d`` keeps them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, KEY, arrow_map, as_long

RUN = f"key long, {ID} long, {KEY} long, place long"
CLASS = ["key", "r", "d"]
WITNESS = -1  # places below are -2 - place of runs known to repeat


def packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Anchor, first and last window start in one number; windows have less than 1024 starts."""
    at, lo, hi = (x.astype(np.int64) for x in (at, lo, hi))
    return (lo << 20) | ((at - lo) << 10) | (hi - lo)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, lo, hi)."""
    lo = place >> 20
    return lo + ((place >> 10) & 1023), lo, lo + (place & 1023)


def sent(key: np.ndarray, doc: np.ndarray, row_key: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict:
    """The runs of a batch as rows of ``RUN``, marked where their key repeats in the batch, and a witness of each such key."""
    values, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    place = packed(at, lo, hi)
    place = np.where(counts[inverse] > 1, -2 - place, place)
    witness = values[counts > 1]
    blank = np.zeros(len(witness), np.int64)
    return {"key": as_long(np.concatenate([key, witness])), ID: np.concatenate([doc, blank]), KEY: np.concatenate([row_key, blank]), "place": np.concatenate([place, blank + WITNESS])}


def repeated_keys(runs: DataFrame) -> DataFrame:
    """The runs of ``sent`` whose key occurs more than once.

    One exchange; sorted partitions are streamed, so a group of any size takes the memory of a batch.
    """
    names = ("key", ID, KEY, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, first, last = None, 0, False  # the open row, its key, and whether it repeats already
        for batch in batches:
            places = batch.column("place").to_numpy()
            known = batch.filter(pa.array(places < WITNESS))
            yield {n: known.column(n) for n in names[:-1]} | {"place": -2 - known.column("place").to_numpy()}
            batch = batch.filter(pa.array(places >= WITNESS))
            if not batch.num_rows:
                continue
            keys, places = batch.column("key").to_numpy(), batch.column("place").to_numpy()
            same = keys[1:] == keys[:-1]
            many = np.zeros(len(keys), bool)
            many[1:] |= same
            many[:-1] |= same
            if held is not None:
                if keys[0] == first:
                    many[0] = last = True
                if last:
                    yield {n: held.column(n) for n in names}
            many_last = bool(many[-1])
            done = batch.slice(0, batch.num_rows - 1).filter(pa.array(many[:-1] & (places[:-1] >= 0)))
            yield {n: done.column(n) for n in names}
            held, first, last = batch.slice(batch.num_rows - 1), keys[-1], many_last
            if places[-1] == WITNESS:
                held, last = held.slice(0, 0), True
        if held is not None and last:
            yield {n: held.column(n) for n in names}

    to = F.when(F.col("place") < WITNESS, F.xxhash64(ID, "place")).otherwise(F.lit(0))
    return arrow_map(runs.repartition("key", to).sortWithinPartitions("key"), run, RUN)


def per_row(runs: DataFrame) -> DataFrame:
    """ID, KEY, runs: an array of (key, place)."""
    return runs.groupBy(ID, KEY).agg(F.collect_list(F.struct("key", "place")).alias("runs"))


def classes(runs: DataFrame) -> DataFrame:
    """``runs(key, r, d, ID, KEY, lo, ...)`` → key, r, d, first (ID, KEY, lo of the first run), n (runs)."""
    return runs.groupBy(CLASS).agg(F.min(F.struct(ID, KEY, "lo")).alias("first"), F.count(F.lit(1)).alias("n"))


def mixed(found: DataFrame) -> DataFrame:
    """key, kinds: keys with more than one class, and how many."""
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-touching unions of half-open spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def covered(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs(doc_id, ID, KEY, text)`` with starts and ends (arrays, null if none) from ``spans(ID, KEY, start, end)``."""
    lists = spans.groupBy(ID, KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = docs.join(lists, [ID, KEY], "left")
    return rows.select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
