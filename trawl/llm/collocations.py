"""Phrase collocation mining by top-order marginalisation.

Each word occurrence gives one window: itself and the next three words of its piece, as columns w1 to w4, padded
with nulls at the end.  Only these longest windows are counted; a Spark ROLLUP over (w1, w2, w3, w4) sums them to
the counts of all phrases of one to four words, as every occurrence of a phrase begins exactly one window.

A window is also padded from the word on whose pair with the word before it occurs less than ``least`` times: no
candidate, and no part of one, holds such a pair.  The pairs' counts come from an earlier pass over 64-bit hashes;
those that reach ``least`` set bits in a filter of at most ``most_bits`` bits.  A false hit only keeps a window
longer, so results don't depend on it; on more pairs than the filter holds well, more windows are exchanged.

Results for odd input: a null text counts as empty; a null lang is ``und``, as is the lang ``und`` itself; empty
texts and tables give nothing; rows that repeat count each time; texts of any length are read in blocks of
``BLOCK`` bytes that overlap by three words.  Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_map, as_long, mix

ORDER, LEAST, SHARE = 4, 30, 80
BLOCK, MOST_WORDS, MOST_WINDOWS, SLICE = 1 << 20, 1 << 18, 1 << 20, 1000
W = [f"w{k}" for k in range(1, ORDER + 1)]
# pieces end at . , ; : ! ? and 0A to 0D; a tab parts words like a blank
FORM = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
END = b"\n"


class Words:
    """The words of a task in order of their first occurrence; code 0 is the end of a piece."""

    def __init__(self) -> None:
        self.code: dict[bytes, int] = {END: 0}

    def codes(self, words: list[bytes]) -> np.ndarray:
        code = self.code
        for w in words:
            if w not in code:
                code[w] = len(code)
        return np.fromiter(map(code.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.code), np.uint64, len(self.code))

    def strings(self) -> pa.Array:
        return pa.array(list(self.code), pa.binary()).cast(pa.string())


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` with END between pieces, a block at a time; blocks end at the end of a word."""
    text, at = text.lower().translate(FORM), 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(END, at, end))
            if cut < 0:  # one word longer than a block
                cut = min((x for x in (text.find(b" ", end), text.find(END, end)) if x >= 0), default=len(text))
            end = cut + 1
        yield list(filter(None, text[at:end].replace(END, b" \n ").split(b" ")))
        at = end


def windows(codes: np.ndarray, begins: int) -> np.ndarray:
    """Windows (4 columns of codes, 0 for padding) that begin at one of the first ``begins`` places with a word."""
    padded = np.concatenate([codes, np.zeros(ORDER - 1, np.int64)])
    starts = np.flatnonzero(codes[:begins])
    out = np.stack([padded[starts + k] for k in range(ORDER)])
    for k in range(2, ORDER):
        out[k][out[k - 1] == 0] = 0
    return out


def merged(found: list[np.ndarray]) -> np.ndarray:
    """``found`` in one; the parts go."""
    out = np.concatenate(found, axis=1)
    found.clear()
    return out


def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words, np.ndarray]]:
    """(lang, words, windows) for lots of ``MOST_WINDOWS`` or so windows; ``Words`` is that of the lot."""
    held: dict[str, tuple[Words, list[np.ndarray]]] = {}
    size = 0
    for batch in batches:
        texts, langs = batch.column("text").cast(pa.large_binary()), batch.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            rows = pa.array([k for k, x in enumerate(langs) if x == lang])
            words, found = held.setdefault(lang, (Words(), []))
            carry = np.zeros(0, np.int64)
            lots = (texts.take(rows.slice(at, SLICE)) for at in range(0, len(rows), SLICE))  # they are copied several times
            for block in (block for lot in lots for block in blocks(b"\n".join(lot.to_pylist()) + END)):
                codes = np.concatenate([carry, words.codes(block)])
                begins = max(0, len(codes) - (ORDER - 1))
                found.append(windows(codes, begins).astype(np.int32))
                carry = codes[begins:]
                if len(words.code) > MOST_WORDS or sum(x.shape[1] for x in found) > MOST_WINDOWS:
                    yield lang, words, merged(found)
                    kept, old = list(words.code), carry
                    words, found = held[lang] = (Words(), [])
                    carry = words.codes([kept[c] for c in old])
                size += len(block)
            found.append(windows(carry, len(carry)).astype(np.int32))
            size += 1000  # a lang's own arrays
            if size > MOST_WINDOWS:
                for key, (known, parts) in held.items():
                    yield key, known, merged(parts)
                held, size = {}, 0
    for lang, (words, found) in held.items():
        yield lang, words, merged(found)


def pair_keys(lang: str, hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    with np.errstate(over="ignore"):
        return mix(mix(hashes[left] ^ seed) + np.uint64(3) * hashes[right])


def counts_of(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each different row of ``keys``, and how often it occurs."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    begins = np.flatnonzero(new)
    return order[begins], np.diff(np.append(begins, len(order)))


def frequent_pairs(texts: DataFrame, least: int, most_bits: int) -> np.ndarray:
    """A bit for each hash of a pair of words that occurs ``least`` times or more, as a filter of 64-bit words."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for lang, words, found in of_batches(batches):
            left, right = found[0][found[1] > 0], found[1][found[1] > 0]
            keys, n = np.unique(pair_keys(lang, words.hashes(), left, right), return_counts=True)
            for at in range(0, len(keys), 1 << 18):
                yield {"key": as_long(keys[at : at + (1 << 18)]), "c": n[at : at + (1 << 18)]}

    store = Stored(texts.sparkSession)
    known = store.put(arrow_map(texts, pairs, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("key"))
    bits = min(most_bits, max(1 << 16, 1 << (16 * known.count()).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    cells = known.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    store.drop(known)
    return out.view(np.uint64)


def is_frequent(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(64 * len(filter_) - 1)
    return (filter_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def padded_windows(texts: DataFrame, filter_: np.ndarray) -> DataFrame:
    """lang, w1 .. w4 (null: padding), c: the windows of each lot with their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for lang, words, found in of_batches(batches):
            hashes, strings = words.hashes(), words.strings()
            for k in range(1, ORDER):
                there = np.flatnonzero(found[k])
                gone = there[~is_frequent(shared.value, pair_keys(lang, hashes, found[k - 1][there], found[k][there]))]
                found[k:, gone] = 0
            long = found[:, found[1] > 0]
            single = np.bincount(found[0][found[1] == 0], minlength=1)
            alone = np.flatnonzero(single)
            del found
            first, n = counts_of(tuple(long[k].astype(np.int64) << 32 | long[k + 1] for k in (0, 2)))
            rows = np.zeros((ORDER, len(alone) + len(first)), np.int32)
            rows[0, : len(alone)] = alone
            rows[:, len(alone) :] = long[:, first]
            del long
            c = np.concatenate([single[alone], n])
            for at in range(0, len(c), 1 << 17):
                part = rows[:, at : at + (1 << 17)]
                yield {"lang": [lang] * part.shape[1], "c": c[at : at + (1 << 17)]} | {w: strings.take(pa.array(x, mask=x == 0)) for w, x in zip(W, part)}

    return arrow_map(texts, counted, "lang string, " + ", ".join(f"{w} string" for w in W) + ", c long")


def joined(words: list[Column | str]) -> Column:
    return F.concat_ws(" ", *words)


def phrase_counts(docs: DataFrame, least: int = LEAST, most_bits: int = 1 << 30) -> DataFrame:
    """lang, words (of 1 to 4), phrase, f of every phrase with ``least`` occurrences or more, and n in rows without words."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = padded_windows(texts, frequent_pairs(texts, least, most_bits))
    # words: how many stand in the grouping set; a null among them is padding, counted by the shorter prefix
    sums = docs.sparkSession.sql(f"SELECT lang, {', '.join(W)}, {ORDER} - bit_count(grouping_id()) AS words, sum(c) AS f FROM {{rows}} GROUP BY lang, ROLLUP({', '.join(W)})", rows=rows)
    last = F.coalesce(*[F.when((F.col("words") == k) & F.col(f"w{k}").isNull(), F.lit(False)) for k in range(1, ORDER + 1)], F.lit(True))
    return sums.where(last & ((F.col("f") >= least) | (F.col("words") == 0))).select("lang", F.col("words").cast("int").alias("words"), joined(W).alias("phrase"), "f")


def best(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each lang with their rank: of 256, then of 16 parts of a lang, then of what is left."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    for parts in (256, 16, 1):
        place = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= k)
    return rows


def collocations(docs: DataFrame, k: int = 2000, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """``docs(text, lang)`` → each lang's best ``k`` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    Ties in score go to the larger a, then to the smaller phrase in the order of UTF-8 bytes.  Sums are longs;
    products are decimals of 38 digits.
    """
    store = Stored(docs.sparkSession)
    counts = store.put(phrase_counts(docs, least))
    known = counts.where("words > 0").select("lang", "phrase", "f")
    candidates = counts.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "cut"))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(lowest.alias("x")).select("lang", "phrase", "x.*")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda b: F.array_join(F.slice("w", b, m), " ")))))
    outer = candidates.where(F.size("w") > 2).select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    scored = scored.join(outer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100BD * cast(longer as decimal(20,0)) < {share} * cast(a as decimal(20,0))")
    totals = F.broadcast(counts.where("words = 0").select("lang", F.col("f").alias("n"))) if few_langs(counts) else counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best(scored, k).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def few_langs(counts: DataFrame, most: int = 100_000) -> bool:
    return counts.where("words = 0").limit(most + 1).count() <= most
