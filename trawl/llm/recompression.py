"""Substring deduplication of word windows by recompression.

Rounds of recompression shorten every document's word sequence: maximal runs of a symbol, then
pairs of a low-coin and a high-coin symbol, become one new symbol.  A new symbol's global name is
a hash of what it replaces, so tasks agree on all names without exchanging a dictionary, and
equal substrings get equal interior symbols.  With each symbol goes its *context*, the words
that fix how it was parsed.  A window's anchor is the widest high-level symbol whose context lies
inside it (then the smallest name; windows without one: the smallest 5-word hash), hence a
function of the window's words.  Shared contexts reveal windows that may repeat; they are verified
by hashes of all their words (with key and offset 128 bits).

A word goes if a window of ``window`` words covers it whose sequence starts earlier too: smaller
doc_id, or same document and earlier start.  Scale: see ``windows``; the text is shuffled twice
(to verify, to cut), each time by row address, and copies are settled by one row per run.
Null texts have no words; null doc_ids come first; rows repeated with equal id and text count as
one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, KEY, Stored, arrow_map, as_long, mix, plain
from .windows import CLASS, RUN, classes, covered, merged, mixed, per_row, repeated_keys, sent, unpacked

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)
FAR = 1 << 40
GRAM = 5
MAX_CONTEXT = 12
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_names(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 42) for w in words], dtype=np.uint64)


class Prefix:
    """Polynomial prefix hashes over 64-bit values; ``of(i, j)`` hashes values i to j."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        up = np.cumprod(np.full(n, BASE, dtype=np.uint64))
        np.cumsum(values * up, out=self.sums[1:])
        down = np.full(n + 1, INVERSE, dtype=np.uint64)
        down[0] = 1
        self.down = np.cumprod(down)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.down[i])


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, ...]:
    """(name, start, end, context start, context end) of the symbols after some rounds.

    A context that would reach over a document's edge is set far away.
    """
    n = len(names)
    s = np.arange(n)
    e, cs, ce = s + 1, s.copy(), s + 1
    for r in range(1, rounds + 1):
        same = np.append(False, (doc[1:] == doc[:-1]))
        first = np.flatnonzero(~same | np.append(True, names[1:] != names[:-1]))
        length = np.diff(np.append(first, len(names)))
        last = first + length - 1
        left = np.where(same[first], cs[first - 1], -FAR)
        right = np.where(np.append(same, False)[last + 1], ce[np.minimum(last + 1, len(ce) - 1)], FAR)
        names = np.where(length == 1, names[first], mix(names[first] * np.uint64(BASE) + length.astype(np.uint64) + np.uint64(r << 40)))
        doc, s, e, cs, ce = doc[first], s[first], e[last], left, right
        same = np.append(False, (doc[1:] == doc[:-1]))
        coin = (mix(names + np.uint64(r)) & np.uint64(1)).astype(bool)
        second = np.append(False, coin[1:] & ~coin[:-1]) & same
        pair = np.append(second[1:], False)
        after = np.minimum(np.arange(len(names)) + 1, len(names) - 1)
        follows = np.append(same[1:], False)
        new = np.where(pair, mix(names * np.uint64(BASE) ^ mix(names[after] + np.uint64(r << 32))), names)
        # a high coin without a partner was fixed by its left neighbour, a low one by its right
        before = np.maximum(np.arange(len(names)) - 1, 0)
        start = np.where(coin & ~second, np.where(same, cs[before], -FAR), cs)
        end = np.where(pair, ce[after], np.where(~coin, np.where(follows, ce[after], FAR), ce))
        stop = np.where(pair, e[after], e)
        keep = ~second
        names, doc, s, e, cs, ce = new[keep], doc[keep], s[keep], stop[keep], start[keep], end[keep]
    return names, s, e, cs, ce


def anchors(names: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(key, anchor, first window, last window) of each run of windows; places count through all documents.

    ``begin`` and ``end``: of each document; ``doc``: of each word.
    """
    n = len(names)
    best = np.full(n, NONE, dtype=np.uint64)
    who = np.full(n, -1, dtype=np.int64)
    symbol, s, e, cs, ce = recompress(names, doc)
    usable = (cs >= 0) & (ce <= n) & (ce - cs <= min(MAX_CONTEXT, window)) & (e - s > 1)
    symbol, s, e, cs, ce = symbol[usable], s[usable], e[usable], cs[usable], ce[usable]
    rank = ((7 - np.minimum(e - s, 7)).astype(np.uint64) << np.uint64(61)) | (symbol >> np.uint64(3))
    for d in range(window):
        fit = np.flatnonzero((d >= s - cs) & (d <= window - (ce - s)) & (s >= d))
        at = s[fit] - d
        # earlier windows hold the symbol further right; on equal rank the leftmost symbol stays
        better = rank[fit] < best[at]
        best[at[better]] = rank[fit[better]]
        who[at[better]] = fit[better]
    prefix = Prefix(names)
    context = prefix.of(cs, ce) ^ mix(((s - cs) * 64 + (e - s)).astype(np.uint64))
    # plain n-grams for windows without a symbol
    inside = np.arange(n) + window <= end[doc]
    bare = np.flatnonzero(inside & (who < 0))
    gram_at = np.full(n, -1, dtype=np.int64)
    if len(bare) and n >= GRAM:
        grams = prefix.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        low = np.full(len(bare), NONE, dtype=np.uint64)
        for d in range(window - GRAM + 1):
            value = grams[bare + d]
            better = value < low
            low[better] = value[better]
            gram_at[bare[better]] = bare[better] + d
    if len(s):
        place = np.where(who >= 0, s[who], gram_at)
        key = np.where(who >= 0, context[who], 0)
    else:
        place, key = gram_at, np.zeros(n, np.uint64)
    if len(bare) and n >= GRAM:
        key[bare] = grams[gram_at[bare]] ^ np.uint64(BASE)
    p = np.flatnonzero(inside)
    if not len(p):
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    new = np.append(True, (np.diff(p) != 1) | (place[p[1:]] != place[p[:-1]]) | (key[p[1:]] != key[p[:-1]]) | (doc[p[1:]] != doc[p[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return key[p[first]], place[p[first]], p[first], p[last]


def find_runs(docs: DataFrame, window: int, words_at_once: int = 400_000) -> DataFrame:
    """``docs(ID, KEY, text)`` → the anchor runs of all windows."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        ids, keys, names, count = [], [], [], 0
        for batch in batches:
            for doc, key, text in zip(batch.column(ID).to_pylist(), batch.column(KEY).to_pylist(), batch.column("text")):
                words = split_words(text.as_py())
                if len(words) < window:
                    continue
                ids.append(doc)
                keys.append(key)
                names.append(word_names(words))
                count += len(words)
                if count >= words_at_once:
                    yield ids, keys, names
                    ids, keys, names, count = [], [], [], 0
        if ids:
            yield ids, keys, names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, keys, names in slices(batches):
            lengths = np.array([len(x) for x in names])
            end = np.cumsum(lengths)
            begin = end - lengths
            doc = np.repeat(np.arange(len(lengths)), lengths)
            key, at, lo, hi = anchors(np.concatenate(names), doc, begin, end, window)
            owner = doc[lo]
            yield sent(key, np.array(ids)[owner], np.array(keys)[owner], at - begin[owner], lo - begin[owner], hi - begin[owner])

    return arrow_map(docs.select(ID, KEY, "text"), run, RUN)


def described(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The runs with ``r`` (a hash of all their words and shape), ``d`` (a digest of their words) and ``w`` (a hash of each window)."""
    rows = docs.select(ID, KEY, "text").join(per_row(runs), [ID, KEY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc, row_key, text, found in zip(batch.column(ID).to_pylist(), batch.column(KEY).to_pylist(), batch.column("text"), batch.column("runs")):
                words = split_words(text.as_py())
                names, joined = word_names(words), b" ".join(words)
                begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in words])])
                key, place = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
                at, lo, hi = unpacked(place)
                prefix = Prefix(names)
                r = prefix.of(lo, hi + window) ^ mix(((at - lo).astype(np.int64) * 4096 + (hi - lo)).astype(np.uint64))
                second = Prefix(mix(names ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                starts = np.arange(len(names) - window + 1)
                w = as_long(second.of(starts, starts + window)).tolist()
                k = len(key)
                d = [int.from_bytes(hashlib.blake2b(joined[i:j], digest_size=4).digest(), "little", signed=True) for i, j in zip(begin[lo].tolist(), (begin[hi + window] - 1).tolist())]
                yield {"key": key, "r": as_long(r), "d": d, ID: [doc] * k, KEY: [row_key] * k, "at": at, "lo": lo, "hi": hi, "w": [w[i : j + 1] for i, j in zip(lo.tolist(), hi.tolist())]}

    return arrow_map(rows, run, f"key long, r long, d int, {ID} long, {KEY} long, at int, lo int, hi int, w array<long>")


def later_spans(docs: DataFrame, window: int, store: Stored) -> DataFrame:
    """ID, KEY, start, end: words covered by windows that start earlier elsewhere."""
    runs = store.put(described(docs, repeated_keys(find_runs(docs, window)), window))
    found = store.put(classes(runs.drop("w")))
    place = F.struct(ID, KEY, "lo")
    known = runs.drop("w").join(found.where("n > 1"), CLASS)
    whole = known.where(place != F.col("first")).select(ID, KEY, F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
    firsts = runs.join(found.join(mixed(found).select("key"), "key"), CLASS).where(place == F.col("first"))
    single = firsts.select("key", ID, KEY, "at", "lo", F.posexplode("w").alias("k", "w"))
    single = store.put(single.select("key", (F.col("at") - F.col("lo") - F.col("k")).alias("offset"), "w", ID, KEY, (F.col("lo") + F.col("k")).alias("p")))
    where = F.struct(ID, KEY, "p")
    earliest = single.groupBy("key", "offset", "w").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last")
    later = single.join(earliest, ["key", "offset", "w"]).where(where != F.col("first"))
    spans = store.put(whole.unionByName(later.select(ID, KEY, F.col("p").alias("start"), (F.col("p") + window).alias("end"))))
    store.drop(runs, found, single)
    return spans


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, text (kept words joined by one space), n_words, n_removed, kept_sha256."""
    store, rows = Stored(docs.sparkSession), plain(docs)
    spans = covered(rows, later_spans(rows, window, store))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
                words = split_words(text.as_py())
                counts.append(len(words))
                if starts.is_valid and len(starts.values):
                    a, b = merged(starts.values.to_numpy(), ends.values.to_numpy())
                    kept, at = [], 0
                    for i, j in zip(a.tolist(), b.tolist()):
                        kept += words[at:i]
                        at = j
                    words = kept + words[at:]
                removed.append(counts[-1] - len(words))
                data = b" ".join(words)
                digests.append(hashlib.sha256(data).hexdigest())
                texts.append(data.decode("utf-8", "replace"))
            yield {"doc_id": batch.column("doc_id"), "text": texts, "n_words": counts, "n_removed": removed, "kept_sha256": digests}

    return arrow_map(spans, run, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
