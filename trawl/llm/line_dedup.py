"""Fuzzy line deduplication by MinHash.

Lines are lower-cased with white space collapsed; those of at least ``min_chars`` characters
take part.  A line's signature is a one-permutation MinHash of its character shingles (empty
places take the value of another place, by a fixed order); ``bands`` bands of ``rows`` values
propose candidates (at Jaccard 0.8, 8 bands of 3 miss 0.3 %), whose exact shingle sets must then
reach ``similarity``.  Verified links join into components, and of each component only the first
line stays (smallest doc_id, then place).  Lines shorter than a shingle match when equal.

Scale: equal lines collapse to one 64-bit name before anything is compared; a task sends each
name's bands once, so a very common line costs one row a task.  With its name goes another 64 bits
of the same XXH3 hash; names that meet two of these are replaced.  Candidate groups with the same
members are verified once, large ones level by level (see ``groups``), so no task gets an unbounded
group and no link is lost.  Only spanning links are sent on; components are found by distributed
contraction.  Nulls and empty texts have no lines, empty tables no rows; texts and lines of any length
are whole.  Repeated rows (same doc_id and text) are treated alike: lines within one are compared by
place.  Blank lines always stay.  Shorter lines stay too, unless ``short`` is set: then those that
equal an earlier one (normalized) go as well; they have no bands and are never compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, KEY, Stored, arrow_map, as_long, connected_components, keyed, mix, plain
from .groups import Compare, Prepare, candidate_groups, linked

PLACES = 64
BASE = 0x9E3779B97F4A7C15
EMPTY = 1 << 32
#: Characters hashed at a time, so that the arrays stay in a core's cache.
BLOCK = 1 << 16
#: Lines whose signatures are held at a time.
LINES = 1 << 14
#: Bytes of the lines whose shingle sets are built at a time.
AHEAD = 1 << 20
#: Lines that are compared with a new one singly before more are sifted together.
FEW = 4
#: Latin-1 in lower case, with any white space as a space.
FOLDED = bytes(32 if chr(c).isspace() else ord(chr(c).lower()) for c in range(256))


def normalized(line: str) -> str:
    try:
        folded = line.encode("latin-1").translate(FOLDED)
    except UnicodeEncodeError:
        return " ".join(line.lower().split())
    if b"  " in folded or folded[:1] == b" " or folded[-1:] == b" ":
        folded = b" ".join(folded.split())
    return folded.decode("latin-1")


def code_points(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), dtype=np.uint8).astype(np.uint64)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def shingle_hashes(c: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the shingles of ``size`` code points, from hashes of half the size."""
    if len(c) < size:
        return np.empty(0, dtype=np.uint64)
    h, done = c, 1
    for bit in bin(size)[3:]:
        low = h[done:]
        h = h[:-done] * np.uint64(pow(BASE, done, 1 << 64))
        h += low
        done *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(BASE) + c[done:]
            done += 1
    return mix(h)


def shingles(line: str, size: int) -> np.ndarray:
    """The set of a line's shingles as sorted 64-bit hashes; a shorter line is one shingle."""
    if len(line) < size:
        return np.array([name(line)], dtype=np.int64).view(np.uint64)
    h = shingle_hashes(code_points(line), size)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def common_count(one: np.ndarray, two: np.ndarray) -> int:
    both = np.concatenate([one, two])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def shared_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the longest common start and of the longest common end beyond it."""
    most = min(len(a), len(b))
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a.startswith(b[low:middle], low) else (low, middle - 1)
    start, high, low = low, most - low, 0
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    return start, low


class Lines:
    """The lines of a group; shingle sets that are not given are built when a comparison needs them."""

    def __init__(self, texts: list[str], sets: list[np.ndarray], size: int, similarity: float):
        self.texts, self.size, self.similarity = texts, size, similarity
        self.sets: dict[int, np.ndarray] = dict(enumerate(sets))
        self.marked = np.empty(0, dtype=np.uint8)

    def set_of(self, k: int) -> np.ndarray:
        if k not in self.sets:
            self.sets[k] = shingles(self.texts[k], self.size)
        return self.sets[k]

    def similar(self, new: int, old: int) -> bool:
        """Is the Jaccard similarity of the shingle sets as high as asked?

        Only shingles that touch what lies between the common start and end can differ; if even
        their number leaves the similarity high enough, the newer line's set is not needed.
        """
        if new not in self.sets:
            a, b = self.texts[old], self.texts[new]
            start, end = shared_ends(a, b)
            middle_a, middle_b = (max(0, len(x) - start - end) + self.size - 1 for x in (a, b))
            known = len(self.set_of(old))
            if known - middle_a >= self.similarity * (known + middle_b):
                return True
        one, two = self.set_of(old), self.set_of(new)
        if min(len(one), len(two)) < self.similarity * max(len(one), len(two)):
            return False
        common = common_count(one, two)
        return common >= self.similarity * (len(one) + len(two) - common)

    def within_reach(self, new: int, old: list[int]) -> list[int]:
        """Those of ``old`` that may be similar, by their size and by how many of their shingles share 20 bits with one of the new line's, which no common shingle fails to do."""
        size, sizes = len(self.set_of(new)), np.array([len(self.set_of(b)) for b in old])
        fits = np.flatnonzero(np.minimum(sizes, size) >= self.similarity * np.maximum(sizes, size))
        if not len(fits):
            return []
        if not len(self.marked):
            self.marked = np.zeros(1 << 20, dtype=np.uint8)
        own, sizes = self.sets[new] >> np.uint64(44), sizes[fits]
        self.marked[own] = 1
        met = self.marked[np.concatenate([self.sets[old[b]] for b in fits]) >> np.uint64(44)]
        self.marked[own] = 0
        most = np.add.reduceat(met, np.cumsum(sizes) - sizes, dtype=np.int64)
        return [old[b] for b in fits[most >= self.similarity * (size + sizes - most)]]


def name(line: str) -> int:
    """A normalized line's hash, as a signed long."""
    return int.from_bytes(xxhash.xxh64_digest(line.encode("utf-8", "surrogatepass"), 7), "big", signed=True)


def minima(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The least hash in each of the ``PLACES`` places of each of n sets, -1 where a place is empty."""
    out = np.full(n * PLACES, EMPTY, dtype=np.int64)
    slot = (h >> np.uint64(58)).astype(np.int64)  # place (6 bits), then value (32 bits)
    slot += owner * PLACES
    np.minimum.at(out, slot, ((h >> np.uint64(26)) & np.uint64(0xFFFFFFFF)).astype(np.int64))
    out[out == EMPTY] = -1
    return out.reshape(-1, PLACES)


def filled_places(out: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` places; an empty one asks the others in an order fixed for that place."""
    filled = out[:, :wanted].copy()
    row, col = np.nonzero(filled < 0)
    for attempt in range(1, 8 * PLACES):
        if not len(row):
            break
        places = np.arange(wanted, dtype=np.uint64)
        if attempt < 4 * PLACES:
            source = mix(np.uint64(attempt * PLACES) + places) % np.uint64(PLACES)
        else:
            source = (places + np.uint64(attempt)) % np.uint64(PLACES)
        value = out[row, source.astype(np.int64)[col]]
        found = value >= 0
        filled[row[found], col[found]] = value[found] + ((attempt % 64) << 32)
        row, col = row[~found], col[~found]
    return filled.astype(np.uint64)


def signatures(lines: list[str], shingle: int, wanted: int = PLACES) -> np.ndarray:
    """MinHash values, one row of the first ``wanted`` of ``PLACES`` places for each line."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    out = np.empty((len(lines), PLACES), dtype=np.int64)
    for i, j in blocks(lengths):
        out[i:j] = minima(*whole_shingles("".join(lines[i:j]), lengths[i:j], shingle), j - i)
    short = lengths < shingle
    out[short] = np.array([name(x) & 0xFFFFFFFF for x, s in zip(lines, short) if s], dtype=np.int64)[:, None] if short.any() else 0
    return filled_places(out, wanted)


def blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about ``BLOCK`` characters, or of one line."""
    ends, i = np.cumsum(lengths), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - lengths[i] + BLOCK, side="right")))
        yield i, j
        i = j


def whole_shingles(text: str, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the shingles that lie in one of the joined lines of these lengths."""
    h = shingle_hashes(code_points(text), size)
    across = (np.cumsum(lengths)[:-1, None] - np.arange(1, size)).ravel()
    whole = np.ones(len(h), dtype=bool)
    whole[across[(across >= 0) & (across < len(h))]] = False
    return h[whole], np.repeat(np.arange(len(lengths)), np.maximum(lengths - size + 1, 0))


def sets_of_shingles(lines: list[str], size: int) -> list[np.ndarray]:
    """``shingles`` of each line."""
    lengths, out = np.array([len(x) for x in lines], dtype=np.int64), []
    for i, j in blocks(lengths):
        h, owner = whole_shingles("".join(lines[i:j]), lengths[i:j], size)
        ends = np.cumsum(np.maximum(lengths[i:j] - size + 1, 0))
        starts = np.append(0, ends[:-1])
        for a, b in zip(starts.tolist(), ends.tolist()):
            h[a:b].sort()
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        new[starts[starts < len(h)]] = True
        h, ends = h[new], np.cumsum(np.bincount(owner[new], minlength=j - i)).tolist()
        out += [h[a:b] if b > a else shingles(x, size) for x, a, b in zip(lines[i:j], [0, *ends], ends)]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = h
    return out


def occurrences(docs: DataFrame, shingle: int, bands: int, rows: int, min_chars: int, short: bool = False, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> DataFrame:
    """``docs(ID, KEY, text)`` → ID, KEY, line (place), name and check (two halves of ``digest``), keys (the bands; null but at a name's first sight in a batch, and for lines under ``min_chars``)."""
    least = 1 if short else min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, keys, places, names, fresh, seen, starts = [], [], [], [], [], set(), []
            for doc, key, text in zip(batch.column(ID).to_pylist(), batch.column(KEY).to_pylist(), batch.column("text")):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= least and len(line := normalized(line)) >= least:
                        n = digest(line.encode("utf-8", "surrogatepass"))
                        if len(line) >= min_chars and n not in seen:
                            seen.add(n)
                            fresh.append(line)
                            starts.append(len(ids))
                        ids.append(doc)
                        keys.append(key)
                        places.append(k)
                        names.append(n)
            found = [np.empty((0, bands), dtype=np.uint64)]
            for i in range(0, len(fresh), LINES):
                found.append(band_keys(signatures(fresh[i : i + LINES], shingle, bands * rows), bands, rows))
            has = np.zeros(len(ids), dtype=np.int32)
            has[starts] = bands
            offsets = np.append(np.zeros(1, np.int32), np.cumsum(has, dtype=np.int32))
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(np.concatenate(found)).ravel()), mask=pa.array(has == 0))
            halves = np.frombuffer(b"".join(names), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield {ID: ids, KEY: keys, "line": places, "name": halves[:, 1], "check": halves[:, 0], "keys": found}

    return arrow_map(docs.select(ID, KEY, "text"), run, f"{ID} long, {KEY} long, line int, name long, check long, keys array<long>")


def first_places(lines: DataFrame, store: Stored) -> tuple[DataFrame, DataFrame]:
    """(the lines, and name, at (the first place), n (occurrences)), with names under which no two lines stand."""
    while True:
        firsts = store.put(lines.groupBy("name").agg(F.min(F.struct(ID, KEY, "line")).alias("at"), F.count(F.lit(1)).alias("n"), F.min("check").alias("low"), F.max("check").alias("high")))
        clashing = firsts.where("low <> high").select("name", "low")
        if clashing.isEmpty():
            return lines, firsts.drop("low", "high")
        new = F.when(F.col("check") == F.coalesce("low", "check"), F.col("name")).otherwise(F.xxhash64("name", "check"))
        lines = store.put(lines.join(clashing, "name", "left").withColumn("name", new).drop("low"))


def prepared(shingle: int) -> Prepare:
    """Gives cells their texts and shingle sets; the sets are built for many small cells at a time, and not for one of over ``AHEAD`` bytes."""

    def prepare(columns: list[pa.Array]) -> Callable[[int, int], list[list]]:
        ends = np.cumsum(pc.binary_length(columns[0]).to_numpy(zero_copy_only=False), dtype=np.int64)
        held: tuple = (0, 0, [], [])

        def cell(i: int, j: int) -> list[list]:
            nonlocal held
            if ends[j - 1] - ends[i] > AHEAD:
                return [columns[0].slice(i, j - i).to_pylist(), []]
            if j > held[1]:
                end = max(j, int(np.searchsorted(ends, ends[i] + AHEAD)))
                texts = columns[0].slice(i, end - i).to_pylist()
                held = (i, i + len(texts), texts, sets_of_shingles(texts, shingle))
            begin, _, texts, sets = held
            return [texts[i - begin : j - begin], sets[i - begin : j - begin]]

        return cell

    return prepare


def comparison(shingle: int, similarity: float) -> Compare:
    """Compares normalized lines."""

    def compare(values: list[list], label: np.ndarray, k: int | None) -> list[tuple[int, int]]:
        lines, first, out = Lines(*values, shingle, similarity), {}, []
        root = [first.setdefault(x, i) for i, x in enumerate(label.tolist())]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def connect(a: int, others: list[int]) -> None:
            for b in others:
                x, y = find(a), find(b)
                if x != y and lines.similar(a, b):
                    root[max(x, y)] = min(x, y)
                    out.append((a, b))

        for a in range(k or 0, len(root)):
            end = a if k is None else k
            connect(a, range(min(end, FEW)))
            rest = [b for b in range(FEW, end) if find(b) != find(a)]
            connect(a, lines.within_reach(a, rest) if len(rest) > FEW else rest)
            if k is not None:
                lines.sets.pop(a, None)
        return out

    return compare


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(ID, KEY, line, name)`` → (name, text): the normalized lines."""
    lists = wanted.groupBy(ID, KEY).agg(F.collect_list("line").alias("__lines"), F.collect_list("name").alias("__names"))
    rows = docs.select(ID, KEY, "text").join(lists.hint("merge"), [ID, KEY]).select("text", "__lines", "__names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            names, texts = [], []
            for text, at, known in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = text.as_py().split("\n")
                names += known
                texts += [normalized(lines[k]) for k in at]
            yield {"name": names, "text": texts}

    return arrow_map(rows, run, "name long, text string")


def duplicate_lines(docs: DataFrame, shingle: int = 8, similarity: float = 0.8, bands: int = 8, rows: int = 3, min_chars: int = 10, dense: int = 128, short: bool = False, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` → (lines: ID, KEY, line, name, keys; removed: ID, KEY, line)."""
    store, docs = Stored(docs.sparkSession), plain(docs)
    lines, firsts = first_places(store.put(occurrences(docs, shingle, bands, rows, min_chars, short, digest)), store)
    place = F.struct(ID, KEY, "line")
    groups = candidate_groups(lines, store)
    wanted = groups.select("name").distinct().join(firsts.select("name", "at"), "name").select(f"at.{ID}", f"at.{KEY}", "at.line", "name")
    texts = store.put(texts_of(docs, wanted).groupBy("name").agg(F.first("text").alias("text")))
    roots = connected_components(linked(groups, texts, ("text",), comparison(shingle, similarity), store, dense, 20_000, prepared(shingle)), store)
    first = firsts.join(roots, firsts["name"] == roots["node"], "left").select("name", "at", "n", F.coalesce("root", "name").alias("root"))
    first = store.put(first)
    kept = first.groupBy("root").agg(F.min("at").alias("kept"), F.sum("n").alias("m")).where("m > 1")
    losing = store.put(first.select("name", "root").join(kept, "root").select("name", "kept"))
    removed = lines.select(ID, KEY, "line", "name").join(losing, "name").where(place != F.col("kept"))
    return lines, removed.select(ID, KEY, "line").distinct()


def removals(docs: DataFrame, **options) -> DataFrame:
    """ID, KEY, removed (sorted places of the lines that go), for rows that lose any."""
    _, removed = duplicate_lines(docs, **options)
    return removed.groupBy(ID, KEY).agg(F.sort_array(F.collect_list("line")).alias("removed"))


def without_lines(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` with the listed lines cut from ``text``, its other columns unchanged; ``__lost``: the text is left without any line."""
    rows = keyed(docs).join(lists.select(ID, KEY, F.col("removed").alias("__removed")).hint("merge"), [ID, KEY], "left")

    def cut(lines: Column) -> Column:
        """What lies between neighbouring places of ``__removed``: each line is copied once."""
        after = F.concat(F.array(F.lit(-1)), F.col("__removed"))
        until = F.concat(F.col("__removed"), F.array(F.size(lines)))
        between = F.arrays_zip(after.alias("a"), until.alias("b"))
        return F.array_join(F.flatten(F.transform(between, lambda x: F.slice(lines, x["a"] + 2, x["b"] - x["a"] - 1))), "\n")

    # the lines are bound to a variable, so that the text is split once
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n", -1)), cut)[0])
    lost = F.coalesce(F.size("__removed") > 0, F.lit(False)) & ~F.col("text").rlike(r"\S")
    return rows.withColumn("text", text).withColumn("__lost", lost).select(*docs.columns, "__lost")
