"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at ``threshold`` or fewer differing bits.  The bits are split into
``threshold // 2 + 1`` fields, so two linked fingerprints differ in at most one bit of some
field.  In each field the codewords of a perfect Hamming code are the anchors: its covering
radius is 1, so every value lies within 1 of an anchor and its partner within 1 + 1 of the same
one.  A fingerprint is therefore replicated to every anchor within distance 2 (at most 16 for a
field of 31 bits, of 2**26), and compared inside anchors only.

Scale: texts are fingerprinted where they are read and never shuffled.  Equal fingerprints
collapse (map-side combined) before they are replicated, so copies, however many, are one row.
Inside an anchor only a spanning forest of the links leaves the task.  Anchors with more than ``dense``
distinct fingerprints are dealt out anew: the 64 bits are cut into ``threshold + 1`` pieces, one of which
linked fingerprints share, so each goes to its (anchor, piece) cells, which split the group.  Components:
distributed contraction.  Null and empty texts have fingerprint zero and link like any other; texts of any
length are whole; an empty table gives no rows.  Repeated rows: one result each.  A null doc_id is never a
component's id unless all of its ids are null (then null).

``one_of_similar`` links documents whose sets of word shingles reach a Jaccard similarity of ``similarity``.
Its SimHash search is the one above: the anchors link fingerprints of the sets at ``threshold`` or fewer differing
bits, and a component of these is a group of candidates.  At 0.8 about 10 of 64 bits differ, and anchors for so many
bits would hold a fixed share of all pairs.  So for pairs farther apart MinHash bands of the same shingle hashes
propose further groups (at 0.8, 12 bands of 3 miss 0.02 %), of which those with more than ``reach`` differing bits
are passed over (at 0.8 that misses under one in 10**6).  In all groups documents link only if their exact sets are
as similar as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, KEY, Stored, arrow_map, as_long, connected_components, group_pieces, keyed, local_components, plain
from .groups import Compare, candidate_groups, linked
from .line_dedup import band_keys, common_count, filled_places, minima

BITS = 64
SLACK = 1e-9


def digests(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 values (seed 42) of the text's word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, stops = [0], [len(joined)]
    else:
        stops = ends[shingle - 1 :].tolist()
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], 42) for i, j in zip(starts, stops)], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """Bit by bit, the value that more than half of the hashes have, else 0."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit by bit, the majority of the hashes of the text's word shingles."""
    return majority(digests(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs(doc_id, text, ID, KEY)`` → doc_id, ID, KEY, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], dtype=np.uint64)
            yield {"doc_id": batch.column("doc_id"), ID: batch.column(ID), KEY: batch.column(KEY), "fp": fps.view(np.int64)}

    return arrow_map(docs.select("doc_id", ID, KEY, "text"), run, f"doc_id long, {ID} long, {KEY} long, fp long")


class Covering:
    """Anchors of fingerprints for a threshold."""

    def __init__(self, threshold: int):
        self.fields = threshold // 2 + 1
        self.width = BITS // self.fields
        self.length = (1 << ((self.width + 1).bit_length() - 1)) - 1  # of the Hamming code: 2**r - 1 bits
        positions = np.arange(1, self.length + 1)
        flips, valid = [], []
        for syndrome in range(self.length + 1):
            pairs = [0] if syndrome == 0 else [1 << (syndrome - 1)]
            if syndrome:
                pairs += [(1 << (int(i) - 1)) | (1 << (int(i ^ syndrome) - 1)) for i in positions if i < i ^ syndrome <= self.length]
            flips.append(pairs)
        most = max(map(len, flips))
        self.flips = np.array([x + [0] * (most - len(x)) for x in flips], dtype=np.uint64)
        self.valid = np.array([[True] * len(x) + [False] * (most - len(x)) for x in flips])

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, index of its fingerprint): every codeword within distance 2 in every field."""
        keys, owners = [], []
        for field in range(self.fields):
            value = (fps >> np.uint64(field * self.width)) & np.uint64((1 << self.length) - 1)
            syndrome = np.zeros(len(fps), dtype=np.int64)
            for i in range(self.length):
                syndrome ^= np.where((value >> np.uint64(i)) & np.uint64(1), i + 1, 0)
            near = value[:, None] ^ self.flips[syndrome]
            row, col = np.nonzero(self.valid[syndrome])
            keys.append(near[row, col] | np.uint64(field << 58))
            owners.append(row)
        return np.concatenate(keys), np.concatenate(owners)


def close_pairs(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with equal key (keys are sorted) and close fingerprints."""
    n = len(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, n))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rest = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))  # rows of the group from here on
    at, d = np.flatnonzero(rest > 1), 1
    while len(at):
        near = np.bitwise_count(fps[at] ^ fps[at + d]) <= threshold
        left.append(at[near])
        right.append(at[near] + d)
        d += 1
        at = at[rest[at] > d]
    return np.concatenate(left), np.concatenate(right)


def cells_outside(covering: Covering, threshold: int) -> list[Column]:
    """Names of the cells of ``(anchor, fp)`` in a large anchor group: the bits outside of the anchor's field, which the anchor
    leaves free, are cut into ``threshold + 1`` pieces, of which two linked fingerprints share one."""
    free = BITS - covering.length
    outside = F.lit(0).cast("long")
    for field in range(covering.fields):
        begin = field * covering.width
        low = F.col("fp").bitwiseAND(F.lit((1 << begin) - 1).cast("long"))
        high = F.shiftleft(F.shiftrightunsigned("fp", begin + covering.length), begin)
        outside = F.when(F.shiftrightunsigned("anchor", 58) == field, low.bitwiseOR(high)).otherwise(outside)
    edges = [round(free * k / (threshold + 1)) for k in range(threshold + 2)]
    return [F.xxhash64("anchor", F.lit(k), F.shiftrightunsigned(outside, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def links(distinct: DataFrame, threshold: int, store: Stored, dense: int = 2048) -> DataFrame:
    """``distinct(fp)`` → (u, v): links that connect all fingerprints connected by close pairs."""
    covering = Covering(threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), 50_000):
                keys, owners = covering.anchors(fps[i : i + 50_000])
                yield {"anchor": keys.view(np.int64), "fp": fps[i : i + 50_000][owners].view(np.int64)}

    def compare(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[dict]:
        """Links, and unchanged (as anchor, fp) the rows of groups of more than ``most``."""
        for table, whole in group_pieces(batches, key, 100_000, most=100_000):
            keys, fps = table.column(key).to_numpy(), table.column("fp").to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(starts, len(keys)))
            large = np.repeat(sizes > most, sizes) if whole else np.ones(len(keys), bool)
            yield {"u": keys[large], "v": fps[large], "large": np.ones(int(large.sum()), bool)}
            keys, fps = keys[~large], fps[~large]
            label = local_components(len(fps), *close_pairs(keys, fps.view(np.uint64), threshold))
            moved = np.flatnonzero(label != np.arange(len(fps)))
            yield {"u": fps[label[moved]], "v": fps[moved], "large": np.zeros(len(moved), bool)}

    replicas = arrow_map(distinct.select("fp"), spread, "anchor long, fp long")
    met = replicas.repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = store.put(arrow_map(met, lambda batches: compare(batches, "anchor", dense), "u long, v long, large boolean"))
    small = found.where("NOT large").select("u", "v").distinct()
    large = found.where("large").select(F.col("u").alias("anchor"), F.col("v").alias("fp"))
    if large.isEmpty():
        return small
    pieces = large.select(F.explode(F.array(*cells_outside(covering, threshold))).alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell", "fp")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """A cell's fingerprints meet in tiles of ``dense``, so memory stays bounded for any cell but for its fingerprints."""
        for table, _ in group_pieces(batches, "cell", 100_000):
            keys, fps = table.column("cell").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            left, right = [], []
            for i, j in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist()):
                for a in range(i, j, dense):
                    for b in range(a, j, dense):
                        x, y = np.nonzero(np.bitwise_count(fps[a : min(a + dense, j), None] ^ fps[None, b : min(b + dense, j)]) <= threshold)
                        left.append(a + x[a + x < b + y])
                        right.append((b + y)[a + x < b + y])
            label = local_components(len(fps), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(fps)))
            yield {"u": as_long(fps[label[moved]]), "v": as_long(fps[moved])}

    return small.unionByName(arrow_map(pieces, agree, "u long, v long")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 3, dense: int = 2048) -> DataFrame:
    """``docs(doc_id, text)`` → one row each: doc_id, ID, KEY, fingerprint (hex), component_id, keep.

    ``keep`` marks the one row (or equal repeated rows) of a component with the smallest address.
    """
    store = Stored(docs.sparkSession)
    prints = store.put(fingerprints(plain(docs), shingle))
    distinct = store.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), ID, KEY)).alias("rep")))
    roots = connected_components(links(distinct, threshold, store, dense), store)
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "rep", F.coalesce("root", "fp").alias("root"))
    classes = store.put(classes)
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"), F.min("rep").alias("rep"))
    named = classes.select("fp", "root").join(least, "root").select("fp", "component_id", "rep")
    keep = (F.col("rep")[ID] == F.col(ID)) & (F.col("rep")[KEY] == F.col(KEY))
    return prints.join(named, "fp").select("doc_id", ID, KEY, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", keep.alias("keep"))


def one_of_each(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged; of equal repeated rows one stays."""
    kept = near_duplicates(docs, shingle, threshold).where("keep").groupBy(ID, KEY).agg(F.count(F.lit(1)).alias("__rows"))
    kept = Stored(docs.sparkSession).put(kept)
    return only(docs, kept, not kept.where("__rows > 1").isEmpty())


def only(docs: DataFrame, kept: DataFrame, repeated: bool) -> DataFrame:
    """The rows of ``docs`` whose address is in ``kept``; of equal repeated rows one."""
    out = keyed(docs).join(kept.select(ID, KEY).hint("merge"), [ID, KEY], "left_semi")
    if repeated:
        out = out.dropDuplicates([ID, KEY])
    return out.select(*docs.columns)


def shingle_sets(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``docs(doc_id, text, ID, KEY)`` → doc_id, ID, KEY, name (of the set of shingle hashes), fp (its fingerprint), keys (its bands; null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            names, fps, keys, held, places, size = [], [], [None] * batch.num_rows, [], [], 0
            for k, text in enumerate(batch.column("text")):
                own = np.unique(digests(text.as_py(), shingle))
                names.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                fps.append(majority(own))
                if len(own):
                    held.append(own)
                    places.append(k)
                    size += len(own)
                if held and (size > 500_000 or k == batch.num_rows - 1):
                    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
                    sig = filled_places(minima(np.concatenate(held), owner, len(held)), bands * rows)
                    for at, row in zip(places, as_long(band_keys(sig, bands, rows)).tolist()):
                        keys[at] = row
                    held, places, size = [], [], 0
            yield {"doc_id": batch.column("doc_id"), ID: batch.column(ID), KEY: batch.column(KEY), "name": as_long(np.array(names, np.uint64)), "fp": as_long(np.array(fps, np.uint64)), "keys": keys}

    return arrow_map(docs.select("doc_id", ID, KEY, "text"), run, f"doc_id long, {ID} long, {KEY} long, name long, fp long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``wanted(ID, KEY, name, fp)`` → name, fp, hashes (the sorted set as bytes), one row each name."""
    rows = docs.select(ID, KEY, "text").join(wanted.hint("merge"), [ID, KEY]).select("name", "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield {"name": part.column("name"), "fp": part.column("fp"), "hashes": [np.unique(digests(x.as_py(), shingle)).tobytes() for x in part.column("text")]}

    return arrow_map(rows, run, "name long, fp long, hashes binary").dropDuplicates(["name"])


def comparison(similarity: float, reach: int) -> Compare:
    """Compares fingerprints and sets of shingle hashes."""

    def compare(values: list[pa.Array], known: np.ndarray, k: int | None) -> list[tuple[int, int]]:
        fps, sets = values[0].to_numpy().view(np.uint64), [np.frombuffer(x.as_buffer(), dtype="<u8") for x in values[1]]
        _, label = np.unique(known, return_inverse=True)
        sizes, out = np.array([len(x) for x in sets]), []
        for a in range(k or 1, len(sets)):
            end = a if k is None else k
            fits = np.minimum(sizes[:end], sizes[a]) >= similarity * np.maximum(sizes[:end], sizes[a]) - SLACK
            fits &= np.bitwise_count(fps[:end] ^ fps[a]) <= reach
            others = np.flatnonzero(fits & (label[:end] != label[a]))
            while len(others):
                b, others = int(others[0]), others[1:]
                common = common_count(sets[a], sets[b])
                if common >= similarity * (sizes[a] + sizes[b] - common) - SLACK:
                    label[label == label[a]] = label[b]
                    others = others[label[others] != label[b]]
                    out.append((a, b))
        return out

    return compare


def with_fingerprint_groups(distinct: DataFrame, threshold: int, store: Stored) -> DataFrame:
    """``distinct(name, fp, keys, ...)`` with one more key for each component of two or more names whose fingerprints link."""
    fps = store.put(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("names")))
    roots = connected_components(links(fps, threshold, store), store)
    classes = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "names", F.coalesce("root", "fp").alias("root"))
    classes = store.put(classes)
    many = classes.groupBy("root").agg(F.sum("names").alias("names")).where("names > 1").select("root")
    near = classes.join(many, "root").select("fp", F.xxhash64(F.lit("simhash"), "root").alias("near"))
    keys = F.when(F.col("near").isNull(), F.col("keys")).otherwise(F.concat("keys", F.array("near")))
    return distinct.join(near, "fp", "left").withColumn("keys", keys).select(*distinct.columns)


def one_of_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 12, rows: int = 3, reach: int = 28, dense: int = 512, threshold: int = 3) -> DataFrame:
    """``docs`` with one row (the smallest address) of each component of documents with similar shingle sets, all columns unchanged."""
    store, texts = Stored(docs.sparkSession), plain(docs)
    sets = store.put(shingle_sets(texts, shingle, bands, rows))
    place = F.struct(F.col("doc_id").isNull().alias("n"), ID, KEY)
    distinct = store.put(sets.groupBy("name").agg(F.min(place).alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    groups = candidate_groups(with_fingerprint_groups(distinct, threshold, store), store)
    wanted = groups.select("name").distinct().join(distinct, "name").select(f"rep.{ID}", f"rep.{KEY}", "name", "fp")
    found = linked(groups, store.put(sets_of(texts, wanted, shingle)), ("fp", "hashes"), comparison(similarity, reach), store, dense, 1_000)
    roots = connected_components(found, store)
    classes = distinct.join(roots, distinct["name"] == roots["node"], "left").select("rep", F.coalesce("root", "name").alias("root"))
    kept = store.put(classes.groupBy("root").agg(F.min("rep").alias("rep")).select(f"rep.{ID}", f"rep.{KEY}"))
    return only(docs, kept, not sets.groupBy(ID, KEY).count().where("count > 1").isEmpty())
