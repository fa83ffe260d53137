"""Best-fit packing of tokenized documents into fixed-length sequences.

Bounded-space online best-fit: every packing task keeps at most ``open_bins`` open sequences in
a bitset keyed by free space.  A piece goes to the open sequence with the least free space that
still holds it; when a new sequence is needed and all places are taken, the fullest closes.

Scale: texts are tokenized where they are read and never shuffled; only 44-byte piece rows move.
They are dealt by doc_id in lots of ``lot`` pieces, so no task depends on a source or a copy
group, and each task leaves at most ``open_bins`` sequences unfilled.
Nulls and empty texts count as empty: one piece, the separator.  A document longer than a
sequence is cut into full sequences with the remainder as its *first* piece; texts of any length
are whole.  Repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
SPECIAL = re.compile(r"<\|[^|]*\|>")
ODD_SPACE = re.compile(r"[^\S \t\n\r\x0b\x0c]|[\x1c-\x1f]")
CACHE_ENTRIES = 300_000


class Encoder(dict):
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    A byte-level BPE never merges across a space that starts a word, so a text's ids are the
    concatenation of its space-led chunks' ids, and each distinct chunk is encoded once per
    worker (the table is emptied at ``CACHE_ENTRIES``).  Chunks of plain Latin characters go to
    tiktoken, which is faster on the same ranks; all others, texts with unusual white space and
    texts with a special token's string go to ``tokenizers``, which defines the ids.
    """

    def __init__(self, name: str, ranks: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(name))
        self.quick = None
        if ranks:
            import base64

            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if self.quick is not None and max(chunk) < "ɐ":
            ids = self.quick.encode_ordinary(chunk)
        else:
            ids = self.exact.encode(chunk, add_special_tokens=False).ids
        out = self[chunk] = np.array(ids, dtype="<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        if SPECIAL.search(text) or ODD_SPACE.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return b"".join(map(self.__getitem__, CHUNKS.findall(text)))


_encoders: dict = {}


def encoder(name: str, ranks: str | None) -> Encoder:
    if (name, ranks) not in _encoders:
        _encoders[name, ranks] = Encoder(name, ranks)
    return _encoders[name, ranks]


def tokenize(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", size: int = 2048, separator: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` → one row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(tokenizer, ranks)
        end = np.array([separator], dtype="<u4").tobytes()
        for batch in batches:
            ids, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = enc.ids(text.as_py() or "") + end
                n = len(data) // 4
                doc = doc.as_py()
                at, k, step = 0, 0, n if n <= size else n % size or size
                while at < n:
                    ids.append(doc)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(step)
                    crcs.append(zlib.crc32(data[4 * at : 4 * (at + step)]))
                    at, k, step = at + step, k + 1, size
            yield {"doc_id": ids, "piece": pieces, "start": starts, "length": lengths, "ids_crc32": crcs}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


class OpenBins:
    """At most ``limit`` open bins, found by free space through one integer used as a bitset."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id = self.size, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(bin_id)
            self.bits |= 1 << rest
            self.open += 1
        return bin_id, self.size - free


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = 1024, lot: int = 250_000, store: Stored | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``size``.

    The pieces are stored first, as tokenizing is what costs; equal input gives equal sequences,
    as every task sorts what it gets.
    """
    store = store or Stored(pieces.sparkSession)
    pieces = store.put(pieces)
    lots = max(1, -(-pieces.count() // lot))
    dealt = pieces.repartition(lots, F.col("doc_id"), F.col("piece"), F.col("ids_crc32")).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    dealt = dealt.withColumn("__lot", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bins = OpenBins(size, open_bins)
        for batch in batches:
            lot_id = batch.column("__lot")[0].as_py() if batch.num_rows else 0
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            out = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield out | {"sequence_id": [(lot_id << 40) | b for b, _ in placed], "offset": [at for _, at in placed]}

    return arrow_map(dealt, run, PACKED)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenizes and packs ``docs(doc_id, text)``; see the module's docstring."""
    return pack(tokenize(docs, **options))
