"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items and documents are lower-cased word sequences; in scripts that put no spaces between words
each character is one.  Every ``n``-gram of an item (of a shorter item: its whole sequence) is counted
over all documents; the rarest ``rare`` share of an item's n-grams (ties included) are its seeds.
Where a document holds a seed, the words around it are aligned with the item (match 2, mismatch
and gap -1); the score is divided by that of the whole item, and documents with ``threshold`` or
more hold a verbatim, edited or partly paraphrased copy.

Scale: two scans of the documents without any shuffle of text; per batch only counts of the
items' n-grams (first scan) and matches (second) leave a task.  Items are broadcast in blocks of
at most ``block_bytes`` of text, however many there are.  One block is held at a time: each is two
passes over the documents, and what it finds or leaves is stored before the next.  Nulls, and items without any word, match nothing; equal items each
match; items and texts of any length are whole.  Repeated rows match each for itself; without documents
or items there are no matches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, arrow_map

WORD = re.compile(r"\w+")
# Thai, Lao, Myanmar, Khmer, Tai Le and New Tai Lue, kana, bopomofo, Han, Yi, Javanese
SPACELESS = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48f\ua980-\ua9df\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
ANY_SPACELESS = re.compile(f"[{SPACELESS}]")
WORD_OR_CHARACTER = re.compile(rf"[^\W{SPACELESS}]+|(?=\w)[{SPACELESS}]")
MATCH, MISS, GAP = 2, -1, 1


def words(text: str) -> list[str]:
    text = text.lower()
    return (WORD if text.isascii() or not ANY_SPACELESS.search(text) else WORD_OR_CHARACTER).findall(text)


class Items:
    """A block of test items with their n-grams as codes over the block's own words (0: any other word).

    Items shorter than n have one gram, all of their words; as no digit of a gram is 0, codes of different lengths differ.
    """

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        tokens = [words(text) for _, text in rows]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.base = len(self.vocabulary) + 1
        if self.base**n >= 2**63:
            raise ValueError("a block of items has too many different words")
        self.ids = [x for x, _ in rows]
        self.sequences = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for t in tokens]
        self.lengths = sorted({min(n, len(s)) for s in self.sequences} - {0})
        self.codes = [np.unique(self.grams(s, min(n, len(s)))[1]) for s in self.sequences]
        self.seeds = np.unique(np.concatenate([*self.codes, np.empty(0, np.int64)]))
        self.owners: dict[int, list[int]] = {}

    def encode(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], dtype=np.int64)

    def grams(self, sequence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, codes) of the grams of n words that all belong to items."""
        if not 0 < n <= len(sequence):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        code, known = np.zeros(len(sequence) - n + 1, np.int64), np.ones(len(sequence) - n + 1, bool)
        for k in range(n):
            part = sequence[k : len(sequence) - n + 1 + k]
            code = code * self.base + part
            known &= part > 0
        at = np.flatnonzero(known)
        return at, code[at]

    def hits(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, seed codes) in a document."""
        grams = [self.grams(sequence, n) for n in self.lengths] or [self.grams(sequence, self.n)]
        at, code = (np.concatenate(x) for x in zip(*grams))
        if not len(at) or not len(self.seeds):
            return at[:0], code[:0]
        found = np.searchsorted(self.seeds, code)
        found[found == len(self.seeds)] = 0
        known = self.seeds[found] == code
        return at[known], code[known]

    def keep_rare(self, counts: dict[int, int], rare: float) -> None:
        owners = defaultdict(list)
        for k, codes in enumerate(self.codes):
            if len(codes):
                df = np.array([counts.get(int(c), 0) for c in codes])
                limit = np.sort(df)[min(len(df) - 1, int(np.ceil(rare * len(df))) - 1)]
                for c in codes[df <= limit].tolist():
                    owners[c].append(k)
        self.owners = dict(owners)
        self.seeds = np.array(sorted(owners), dtype=np.int64)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, place after its last word in ``window``)."""
    above = np.zeros(len(window) + 1, dtype=np.int64)
    slope = GAP * np.arange(len(window) + 1)
    best, end = 0, 0
    for word in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(window == word, MATCH, MISS), above[1:] - GAP), 0)
        row = np.maximum.accumulate(row + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def matches(items: Items, text: str, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item_id, score, first word, word after the last) of the items that a text holds, each at its best place."""
    sequence = items.encode(text)
    at, codes = items.hits(sequence)
    places = defaultdict(list)
    for place, code in zip(at.tolist(), codes.tolist()):
        for k in items.owners[code]:
            places[k].append(place)
    out = []
    for k, found in sorted(places.items()):
        item = items.sequences[k]
        reach, best = len(item) + len(item) // 2, (0, 0, 0)
        low = max(0, found[0] - reach)
        for place, after in zip(found, [*found[1:], None]):
            if after is not None and after - place <= reach:
                continue
            high = min(len(sequence), place + reach)
            score, end = align(item, sequence[low:high])
            if score > best[0]:
                best = (score, low, end)
            low = max(0, (after or 0) - reach)
        score = best[0] / (MATCH * len(item))
        if score >= threshold:
            window = sequence[best[1] : best[1] + best[2]]
            _, length = align(item[::-1], window[::-1])
            out.append((items.ids[k], score, best[1] + best[2] - length, best[1] + best[2]))
    return out


def blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of bounded size, by id hash."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        if got:
            yield Items([tuple(r) for r in got], n)


def seeded(docs: DataFrame, benchmark: DataFrame, n: int, rare: float, block_bytes: int) -> Iterator[Broadcast]:
    """Each block of items with its rare seeds, by counts over all documents; it is gone when the next is asked for."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("text").cast("string"))
    last = None
    for items in blocks(benchmark, n, block_bytes):
        if last is not None:
            last.unpersist()
        sent = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[dict]:
            block = sent.value
            totals = np.zeros(len(block.seeds), dtype=np.int64)
            for batch in batches:
                for text in batch.column(0):
                    if text.is_valid:
                        _, codes = block.hits(block.encode(text.as_py()))
                        totals[np.searchsorted(block.seeds, np.unique(codes))] += 1
            some = np.flatnonzero(totals)
            yield {"seed": block.seeds[some], "n": totals[some]}

        counts = arrow_map(texts, count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        items.keep_rare({r[0]: r[1] for r in counts.collect()}, rare)
        sent.unpersist()
        last = spark.sparkContext.broadcast(items)
        yield last


def contaminations(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare: float = 0.75, threshold: float = 0.5, block_bytes: int = 4_000_000) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` → doc_id, item_id, score, first_word, end_word."""
    rows, store = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), Stored(docs.sparkSession)

    def found(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                hits = [(doc.as_py(), *m) for doc, text in zip(batch.column(0), batch.column(1)) if text.is_valid for m in matches(sent.value, text.as_py(), threshold)]
                yield dict(zip(("doc_id", "item_id", "score", "first_word", "end_word"), zip(*hits) if hits else [[]] * 5))

        return arrow_map(rows, run, "doc_id long, item_id long, score double, first_word int, end_word int")

    parts: list[DataFrame] = []
    for sent in seeded(docs, benchmark, n, rare, block_bytes):
        if parts:  # stored before the next block is needed
            parts[-1] = store.put(parts[-1])
        parts.append(found(sent))
    if not parts:
        return rows.limit(0).selectExpr("doc_id", "0L AS item_id", "0D AS score", "0 AS first_word", "0 AS end_word")
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare: float = 0.75, threshold: float = 0.5, block_bytes: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item; nothing is shuffled."""
    store = Stored(docs.sparkSession)

    def free_of(left: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                free = [not (x.is_valid and matches(sent.value, x.as_py(), threshold)) for x in batch.column("text").cast(pa.string())]
                yield batch.filter(pa.array(free, type=pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    left = docs
    for sent in seeded(docs, benchmark, n, rare, block_bytes):
        left = free_of(docs if left is docs else store.put(left), sent)
    return left
