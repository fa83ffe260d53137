"""Suffix-array deduplication of repeated byte strings.

Every byte goes that a ``window``-byte string covers which also starts anywhere else.  Candidate
suffixes (the windows whose anchor, a ``GRAM``-byte string chosen by smallest hash, repeats) are
sorted by mergesort; a comparison finds the common extension of two suffixes by binary search
over prefix polynomial hashes, so it takes O(log window) steps.  Neighbours in suffix order that
agree on ``window`` bytes are repeats; the bytes of all such pairs are compared, and on a
collision the lot is judged again on its bytes.

Scale: see ``windows``.  Runs of equal content never meet in the sort; they form classes, which a
digest verifies.  A key with more than ``dense`` different contents (a passage in countless contexts)
is split: its runs are cut into blocks of neighbouring windows, by offset from the anchor, and each
block gets the content that all its windows share as its key, as equal windows at equal offsets do
share it.  Blocks form classes and are sorted in the same way, and cut once more into single windows
where even they have too many contents.  So a task sorts at most ``dense`` runs of one key.
The hashes are taken modulo 2**64, for which strings of equal hash are known from 512 bytes on: in the
sort strings are shorter (``window``) and compared byte by byte; classes have their digest.
Null texts are empty; texts shorter than the window stay; texts of any length are whole.  Rows
repeated with equal id and text are occurrences of each other.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, KEY, Stored, arrow_map, as_long, key_groups, mix, plain
from .windows import CLASS, RUN, classes, covered, merged, mixed, per_row, repeated_keys, sent, unpacked

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
GRAM = 64
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x))
        _powers[base] = (both[0], both[1])
        if size > 1 << 24:
            return _powers.pop(base)
    return _powers[base]


class PrefixHash:
    """Hashes of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n = len(data)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(TABLE[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by minima from the edges of blocks of w."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    padded = np.full(size, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(key, anchor, first window, last window) of each run of windows with the same anchor."""
    grams = mix(PrefixHash(data).of(np.arange(len(data) - GRAM + 1), GRAM))
    ranked = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(ranked, window - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    hi = np.append(lo[1:], len(at)) - 1
    return grams[at[lo]], at[lo], lo, hi


def find_runs(docs: DataFrame, window: int) -> DataFrame:
    """``docs(ID, KEY, text)`` → the anchor runs of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            held, count = [], 0
            for doc, row_key, text in zip(batch.column(ID).to_pylist(), batch.column(KEY).to_pylist(), batch.column("text")):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid else ()
                if len(data) < window:
                    continue
                key, at, lo, hi = anchors(data, window)
                held.append((key, np.full(len(key), doc), np.full(len(key), row_key), at, lo, hi))
                count += len(key)
                if count > 50_000:
                    yield columns(held)
                    held, count = [], 0
            if held:
                yield columns(held)

    def columns(held: list) -> dict:
        key, doc, row_key, at, lo, hi = (np.concatenate(x) for x in zip(*held))
        return sent(key, doc, row_key, at, lo, hi)

    return arrow_map(docs.select(ID, KEY, "text"), run, RUN)


PIECE = f"key long, r long, d int, {ID} long, {KEY} long, at int, lo int, hi int, bytes binary"


def digest(data: bytes, size: int = 4) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=size).digest(), "little", signed=True)


def described(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The runs with ``bytes``, ``r`` (a hash of the bytes and the run's shape) and ``d`` (a digest of the bytes)."""
    rows = docs.select(ID, KEY, "text").join(per_row(runs), [ID, KEY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc, row_key, text, found in zip(batch.column(ID).to_pylist(), batch.column(KEY).to_pylist(), batch.column("text"), batch.column("runs")):
                raw = text.as_buffer()
                data = np.frombuffer(raw, dtype=np.uint8)
                key, place = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
                at, lo, hi = unpacked(place)
                r = mix(PrefixHash(data, BASES[1]).of(lo, hi - lo + window)) ^ shape(at, lo, hi)
                k = len(key)
                for i in range(0, k, 10_000):
                    j = slice(i, i + 10_000)
                    n = len(key[j])
                    pieces = [raw[a:b].to_pybytes() for a, b in zip(lo[j].tolist(), (hi[j] + window).tolist())]
                    yield {"key": key[j], "r": as_long(r[j]), "d": [digest(x) for x in pieces], ID: [doc] * n, KEY: [row_key] * n, "at": at[j], "lo": lo[j], "hi": hi[j], "bytes": pieces}

    return arrow_map(rows, run, PIECE)


def shape(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((at - lo).astype(np.uint64) * np.uint64(65536) + (hi - lo).astype(np.uint64))


def cut(runs: DataFrame, window: int, block: int) -> DataFrame:
    """``runs(key, ID, KEY, at, lo, hi, bytes)`` → ``PIECE``: their windows in blocks of ``block`` neighbouring offsets from the anchor.

    The new key names what all windows of the block share: the old key, the block, and the bytes in each of its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for key, doc, row_key, at, lo, hi, data in zip(*(batch.column(c).to_pylist() for c in ("key", ID, KEY, "at", "lo", "hi", "bytes"))):
                names, pieces, lows, highs = [], [], [], []
                for k in range((at - hi) // block, (at - lo) // block + 1):
                    first, last = max(lo, at - k * block - block + 1), min(hi, at - k * block)
                    shared = at - k * block - lo  # where the block's last window starts
                    names.append(digest(b"%d %d " % (key, k) + data[shared : shared + window - block + 1], 8))
                    pieces.append(data[first - lo : last - lo + window])
                    lows.append(first)
                    highs.append(last)
                n = len(names)
                low, high = np.array(lows), np.array(highs)
                # r names the class by 64 bits of the digest; d verifies it by 32 others
                own = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=12).digest() for x in pieces), np.uint32).reshape(-1, 3)
                name = own[:, 0].astype(np.uint64) << np.uint64(32) | own[:, 1]
                yield {"key": names, "r": as_long(name ^ shape(at - low, 0 * low, high - low)), "d": own[:, 2].view(np.int32), ID: [doc] * n, KEY: [row_key] * n, "at": [at] * n, "lo": low, "hi": high, "bytes": pieces}

    return arrow_map(runs.select("key", ID, KEY, "at", "lo", "hi", "bytes"), run, PIECE)


class Suffixes:
    """Suffixes of a byte arena, compared on their first ``window`` bytes."""

    def __init__(self, arena: np.ndarray, window: int):
        self.arena, self.window, self.hash = arena, window, PrefixHash(arena)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.hash.of(a, self.window) == self.hash.of(b, self.window)

    def less(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a sorts before b, a equals b), by binary search for the common extension."""
        same = self.equal(a, b)
        less = np.zeros(len(a), dtype=bool)
        rest = np.flatnonzero(~same)
        x, y = a[rest], b[rest]
        low, high = np.zeros(len(rest), np.int64), np.full(len(rest), self.window - 1)  # extension: within
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            agree = self.hash.of(x[open_], middle) == self.hash.of(y[open_], middle)
            low[open_] = np.where(agree, middle, low[open_])
            high[open_] = np.where(agree, high[open_], middle - 1)
        less[rest] = self.arena[x + low] < self.arena[y + low]
        return less, same


def suffix_sort(suffixes: Suffixes, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of ``starts`` within each bucket (equal buckets lie together): bottom-up mergesort of all buckets at once.

    A suffix's place in a merged run is its place in its own plus its rank in the sibling,
    found by binary search.
    """
    n = len(starts)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(first, n))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    order = np.arange(n)
    width, most = 1, int(sizes.max(initial=0))
    while width < most:
        place = np.arange(n) - base
        run = place // width
        is_left = run % 2 == 0
        sibling = np.where(is_left, run + 1, run - 1) * width
        low = np.minimum(sibling, size)
        high = np.minimum(sibling + width, size)
        begin = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less, same = suffixes.less(starts[order[base[open_] + middle]], starts[order[open_]])
            goes_after = less | (same & ~is_left[open_])  # the sibling's suffix stands before this one
            low[open_] = np.where(goes_after, middle + 1, low[open_])
            high[open_] = np.where(goes_after, high[open_], middle)
        new = base + (run // 2) * 2 * width + place % width + low - begin
        moved = np.empty_like(order)
        moved[new] = order
        order = moved
        width *= 2
    return order


def repeated_windows(keys: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of every window that another row with the same key has at the same offset."""
    arena = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    counts = (hi - lo + 1).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    group = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
    offset = (at - lo).astype(np.int64)[row] - step
    bucket = group[row] * np.int64(1 << 20) + offset
    by = np.argsort(bucket, kind="stable")
    row, step, bucket = row[by], step[by], bucket[by]
    shared = np.zeros(len(bucket), dtype=bool)
    same = bucket[1:] == bucket[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    row, step, bucket = row[shared], step[shared], bucket[shared]
    starts = base[row] + step
    suffixes = Suffixes(arena, window)
    order = suffix_sort(suffixes, starts, bucket)
    row, step, starts = row[order], step[order], starts[order]
    beside = np.flatnonzero((bucket[1:] == bucket[:-1]) & suffixes.equal(starts[1:], starts[:-1])) if len(starts) else np.empty(0, np.int64)
    many = np.zeros(len(starts), dtype=bool)
    if verified(arena, starts[beside], starts[beside + 1], window):
        many[beside] = many[beside + 1] = True
    else:
        seen: dict = {}
        for k, (b, i) in enumerate(zip(bucket.tolist(), starts.tolist())):
            other = seen.setdefault((b, arena[i : i + window].tobytes()), k)
            if other != k:
                many[k] = many[other] = True
    return row[many], lo[row[many]] + step[many]


def verified(arena: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> bool:
    """Do all pairs agree byte by byte?  Pairs that follow each other at one distance are compared once."""
    if not len(a):
        return True
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (np.diff(a) != 1) | (np.diff(b) != 1)))
    last = np.append(first[1:], len(a)) - 1
    for i, j, k in zip(a[first].tolist(), a[last].tolist(), b[first].tolist()):
        if not np.array_equal(arena[i : j + window], arena[k : k + j - i + window]):
            return False
    return True


def repeated_spans(docs: DataFrame, window: int, store: Stored, dense: int = 1024, blocks: tuple[int, ...] = (16, 1)) -> DataFrame:
    """ID, KEY, start, end: bytes covered by repeated windows."""
    runs = store.put(described(docs, repeated_keys(find_runs(docs, window)), window))
    out = None
    for block in (*blocks, 0):
        found = store.put(classes(runs))
        place = F.struct(ID, KEY, "lo")
        copies = runs.drop("bytes").join(found.where("n > 1").select(CLASS), CLASS)
        spans = copies.select(ID, KEY, F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
        kinds = found.join(mixed(found), "key")
        firsts = runs.join(kinds, CLASS).where(place == F.col("first"))
        firsts = store.put(firsts.select("key", ID, KEY, "at", "lo", "hi", "n", "kinds", "bytes"))
        within = F.col("kinds") <= dense if block else F.lit(True)  # single windows differ in content only where keys collide
        spans = store.put(spans.unionByName(sorted_spans(firsts.where(within), window)))
        out = spans if out is None else out.unionByName(spans)
        crowded = firsts.where(~within)
        done = not block or crowded.isEmpty()
        new = None if done else store.put(cut(crowded, window, block))
        store.drop(runs, found, firsts)
        if done:
            return out
        runs = new


def sorted_spans(firsts: DataFrame, window: int) -> DataFrame:
    """``firsts(key, ID, KEY, at, lo, hi, n, bytes)`` → ID, KEY, start, end of the windows that another run of the same key holds, by suffix sort."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in key_groups(batches, "key", 1_000):
            table = table.combine_chunks()
            key, at, lo, hi, n, ids, row_keys = (table.column(c).to_numpy() for c in ("key", "at", "lo", "hi", "n", ID, KEY))
            row, start = repeated_windows(key, at, lo, hi, table.column("bytes").to_pylist(), window)
            new = n[row] == 1  # those of larger classes are covered anyway
            row, start = row[new], start[new].astype(np.int64)
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            if len(row):
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (np.diff(start) != 1)))
                last = np.append(first[1:], len(row)) - 1
                yield {ID: ids[row[first]], KEY: row_keys[row[first]], "start": start[first].astype(np.int32), "end": (start[last] + window).astype(np.int32)}

    return arrow_map(firsts.repartition("key").sortWithinPartitions("key", ID, KEY, "lo"), sort, f"{ID} long, {KEY} long, start int, end int")


def remove_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256."""
    store, rows = Stored(docs.sparkSession), plain(docs)
    spans = covered(rows, repeated_spans(rows, window, store))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sizes, removed, counts, digests, texts = [], [], [], [], []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(data))
                spans = 0
                if starts.is_valid and len(starts.values):
                    a, b = merged(starts.values.to_numpy(), ends.values.to_numpy())
                    spans = len(a)
                    data = b"".join(data[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)]))
                removed.append(sizes[-1] - len(data))
                counts.append(spans)
                digests.append(hashlib.sha256(data).hexdigest())
                texts.append(data)
            yield {"doc_id": batch.column("doc_id"), "kept": texts, "n_bytes": sizes, "n_removed": removed, "n_spans": counts, "kept_sha256": digests}

    return arrow_map(spans, run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
