"""Candidate groups of similar things and the links inside them, whatever the size of a group.

Things are 64-bit names with band keys; those that share a band are a group.  Links must connect
whatever pairs of a group connect that are similar, without comparing all pairs of a large group.

Scale: a group of at most ``dense`` names is compared in one task.  A larger one is cut into parts of
that size; each part keeps one name of every component found in it, and these go on to the next,
smaller level, until they no longer get fewer.  By then nearly all names of a group of copies are in
one component.  Names outside their group's largest component are then compared with all names of
other components, in cells of bounded size, so no link is lost.  Only names and what is compared
move; a name goes to one cell a level, and to one cell for each ``dense`` names outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map, as_long, key_groups, local_components, mix

OTHERS = 1024
#: (what is compared, labels of what is connected already, k) -> index pairs that connect what similar
#: pairs connect; with k only pairs of one of the first k rows and one of the others
Compare = Callable[[list, np.ndarray, int | None], list[tuple[int, int]]]
#: columns of many cells -> (begin, end of a cell, asked for in order) -> what is compared; without it slices of the columns
Prepare = Callable[[list[pa.Array]], Callable[[int, int], list]]


def candidate_groups(lines: DataFrame, store: Stored, most: int = 200_000, buckets: int = 4096, packed: int = 1 << 20) -> DataFrame:
    """``lines(name, keys)`` → (grp, name, n): the distinct sets of two or more names that share a band.

    Bands move in packs, a row for each ``buckets``-th of the bands among some ``packed`` of a task: most
    bands have one name, and rows of their own would cost more than the grouping.  A task holds a bucket;
    a band of more than ``most`` names is passed on in pieces, as a group of its own, and counted afterwards.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, count = [], 0
        for batch in batches:
            keys, names = batch.column("keys"), batch.column("name").to_numpy()
            held.append((np.repeat(names, keys.value_lengths().to_numpy()), keys.flatten().to_numpy()))
            count += len(held[-1][0])
            if count >= packed:
                yield packs(held)
                held, count = [], 0
        if count:
            yield packs(held)

    def packs(held: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        names, bands = map(np.concatenate, zip(*held))
        bucket = (mix(bands.view(np.uint64)) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        offsets = pa.array(np.append(starts, len(bucket)) * 8, type=pa.int32()).buffers()[1]
        binary = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(x[order].tobytes())])
        return {"bucket": bucket[starts].astype(np.int32), "bands": binary(bands), "names": binary(names)}

    def sets(bands: np.ndarray, names: np.ndarray, hot: np.ndarray) -> Iterator[dict]:
        """The groups of bands and names that are sorted and without repeats; a group of a ``hot`` band is a piece."""
        starts = np.flatnonzero(np.append(True, bands[1:] != bands[:-1])) if len(bands) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(bands)))
        sums = np.add.reduceat(mix(names.view(np.uint64)), starts) if len(bands) else np.empty(0, np.uint64)
        piece = np.repeat(np.isin(bands[starts], hot), sizes)
        size, group = np.repeat(sizes, sizes), np.repeat(mix(sums + sizes.astype(np.uint64)), sizes)
        many = (size > 1) | piece
        yield {"grp": np.where(piece, bands, as_long(group))[many], "name": names[many], "n": np.where(piece, 0, size)[many]}

    def unlike(bands: list[np.ndarray], names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        band, name = np.concatenate(bands), np.concatenate(names)
        order = np.lexsort((name, band))
        band, name = band[order], name[order]
        new = np.append(True, (band[1:] != band[:-1]) | (name[1:] != name[:-1]))[: len(band)]
        return band[new], name[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, bands, names, count, limit, hot = None, [], [], 0, most, np.empty(0, np.int64)
        for batch in batches:
            for bucket, b, n in zip(batch.column("bucket").to_pylist(), batch.column("bands"), batch.column("names")):
                if bucket != at and count:
                    yield from sets(*unlike(bands, names), hot)
                if bucket != at:
                    at, bands, names, count, limit, hot = bucket, [], [], 0, most, np.empty(0, np.int64)
                bands.append(np.frombuffer(b.as_buffer(), dtype=np.int64))
                names.append(np.frombuffer(n.as_buffer(), dtype=np.int64))
                count += len(bands[-1])
                if count > limit:
                    band, name = unlike(bands, names)
                    found, sizes = np.unique(band, return_counts=True)
                    hot = np.union1d(hot, found[sizes > most])
                    cut = np.isin(band, hot)
                    yield from sets(band[cut], name[cut], hot)
                    bands, names, count = [band[~cut]], [name[~cut]], int((~cut).sum())
                    limit = max(most, 2 * count)
        if count:
            yield from sets(*unlike(bands, names), hot)

    packs_of = arrow_map(lines.where("keys IS NOT NULL").select("name", "keys"), pack, "bucket int, bands binary, names binary")
    found = store.put(arrow_map(packs_of.repartition("bucket").sortWithinPartitions("bucket"), run, "grp long, name long, n long").distinct())
    pieces = found.where("n = 0")
    if pieces.isEmpty():
        return found
    return found.where("n > 0").unionByName(pieces.select("grp", "name").join(counted(pieces), "grp").where("n > 1"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def compared(cells: DataFrame, compare: Compare, columns: tuple[str, ...], rows: int, prepare: Prepare | None = None) -> DataFrame:
    """``cells(cell, grp, side, label, name, *columns)`` → (grp, u, v): links; inside a cell of side -1 each v occurs once, and its u is no v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in key_groups(batches, "cell", rows):
            table = table.combine_chunks()
            cell, grp, side, label, name = (table.column(c).to_numpy() for c in ("cell", "grp", "side", "label", "name"))
            values = [table.column(c).chunk(0) for c in columns]
            of_cell = prepare(values) if prepare else lambda i, j: [x.slice(i, j - i) for x in values]
            out: list[tuple[int, int]] = []
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for i, j in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
                if j - i < 2:
                    continue
                k = int(np.searchsorted(side[i:j], 1)) if side[i] >= 0 else None
                pairs = compare(of_cell(i, j), label[i:j], k)
                if k is None and len(pairs) > 1:
                    a, b = np.array(pairs).T
                    root = local_components(j - i, a, b)
                    pairs = [(int(root[m]), int(m)) for m in np.flatnonzero(root != np.arange(j - i))]
                elif k is None:
                    pairs = [(min(p), max(p)) for p in pairs]
                out += [(i + a, i + b) for a, b in pairs]
            u, v = np.array(out, dtype=np.int64).reshape(-1, 2).T
            yield {"grp": grp[u], "u": name[u], "v": name[v]}

    names = ("cell", "grp", "side", "label", "name", *columns)
    return arrow_map(cells.select(*names).repartition("cell").sortWithinPartitions("cell", "side", "name"), run, "grp long, u long, v long")


def linked(groups: DataFrame, values: DataFrame, columns: tuple[str, ...], compare: Compare, store: Stored, dense: int, rows: int, prepare: Prepare | None = None) -> DataFrame:
    """``groups(grp, name, n)``, ``values(name, *columns)`` → (u, v): links of similar names, for ``connected_components``.

    ``rows``: how many rows, about, a task holds of small groups.
    """

    def inside(members: DataFrame, values: DataFrame, level: int) -> DataFrame:
        """Links within the parts of groups, ``members(grp, name, n)``."""
        part = F.pmod(F.xxhash64("name", F.lit(level)), F.ceil(F.col("n") / dense))
        cells = members.withColumns({"cell": F.xxhash64("grp", part), "side": F.lit(-1).cast("long"), "label": F.col("name")})
        return compared(cells.join(values, "name"), compare, columns, rows, prepare)

    links = inside(groups.where(F.col("n") <= dense), values, 0).select("u", "v")
    large = groups.where(F.col("n") > dense)
    if large.isEmpty():
        return links.distinct()
    members, labels, level, size = large.select("grp", "name"), large.withColumn("label", F.col("name")), 0, large.count()
    values = store.put(values.join(large.select("name").distinct(), "name", "left_semi"))
    while True:
        level += 1
        found = store.put(inside(members.join(counted(members), "grp"), values, level))
        links = links.unionByName(found.select("u", "v"))
        members = store.put(members.join(found.select("grp", F.col("v").alias("name")), ["grp", "name"], "left_anti"))
        labels = labels.join(found.select("grp", "u", F.col("v").alias("label")), ["grp", "label"], "left").select("grp", "name", "n", F.coalesce("u", "label").alias("label"))
        left = members.count()
        if left > size // 2:
            break
        size = left
    return links.unionByName(outside(store.put(labels), values, columns, compare, store, dense, rows, prepare)).distinct()


def outside(members: DataFrame, values: DataFrame, columns: tuple[str, ...], compare: Compare, store: Stored, dense: int, rows: int, prepare: Prepare | None = None) -> DataFrame:
    """Links between names outside their group's largest component so far (``members(grp, name, label)``) and all names of other components."""
    sizes = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("m"))
    largest = store.put(largest.where("m < all").select("grp", "main", F.ceil((F.col("all") - F.col("m")) / dense).alias("blocks"), F.ceil(F.col("all") / OTHERS).alias("parts")))
    dealt = members.join(largest, "grp")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = dealt.where("label <> main").withColumn("block", F.pmod(F.xxhash64("name", F.lit(1)), F.col("blocks"))).withColumn("part", every("parts"))
    others = dealt.withColumn("part", F.pmod(F.xxhash64("name", F.lit(2)), F.col("parts"))).withColumn("block", every("blocks"))
    side = lambda df, n: df.select(F.xxhash64("grp", "block", "part").alias("cell"), "grp", F.lit(n).cast("long").alias("side"), "label", "name")
    return compared(side(rest, 0).unionByName(side(others, 1)).join(values, "name"), compare, columns, rows, prepare).select("u", "v")
