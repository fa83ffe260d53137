"""Language identification by rank-order n-gram profiles.

A profile is a language's ``top`` most frequent 1- to 3-grams of lower-cased letters with word
boundaries, counted over *all* training rows; a document's own most frequent n-grams are compared
with every profile by out-of-place distance (an n-gram that a profile lacks costs ``top``).

Scale: training emits one row per (language, n-gram) and batch and combines them map-side; the
models are ``top`` numbers per language.  Scoring is a scan without a shuffle.
Null texts and texts without a letter: ``und``, score 0.  Without training rows all are ``und``.
Texts of any length are whole.  Repeated rows teach as often as they occur and get equal results;
empty tables give no rows.
Ties: the n-gram with the smaller code, the language first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_map

SPACE = 0x20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngrams(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams of a text's words, each word with a space around it; three code points of 21 bits each fit in a long."""
    data = text.lower().encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(data, dtype="<u4").astype(np.int64)
    c = np.where(letters()[c], c, SPACE)
    c = np.concatenate([[SPACE], c, [SPACE]])
    space = c == SPACE
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    one = c[c != SPACE]
    two = (c[:-1] << 21) | c[1:]
    three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.concatenate([one, two, three[c[1:-1] != SPACE]])


def most_frequent(codes: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` codes, most frequent first, ties to the smaller code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:top]]


def train(rows: DataFrame, top: int = 400) -> dict[str, list[int]]:
    """Profiles from ``rows(text, lang)``; rows with a null in either column teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            held = 0
            for text, lang in zip(batch.column(0), batch.column(1)):
                codes = ngrams(text.as_py())
                by.setdefault(lang.as_py(), []).append(codes)
                held += len(codes)
                if held > 1_000_000:  # bounds what a task holds at once
                    yield from counted(by)
                    by, held = {}, 0
            yield from counted(by)

    def counted(by: dict[str, list[np.ndarray]]) -> Iterator[dict]:
        for lang, parts in by.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield {"lang": [lang] * len(values), "gram": values, "n": counts}

    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    store = Stored(rows.sparkSession)
    counts = store.put(arrow_map(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # ``top`` rows for each language, cut before the exchange
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for lang, gram in counts.withColumn("place", place).where(F.col("place") <= top).orderBy("lang", "place").select("lang", "gram").collect():
        out.setdefault(lang, []).append(gram)
    store.drop(counts)
    return out


def distances(text: str, codes: np.ndarray, ranks: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Out-of-place distance to each profile, and the largest one possible.

    ``codes``: sorted codes of all profiles; ``ranks[code, profile]``: the rank there, or ``-1``.
    """
    mine = most_frequent(ngrams(text), top)
    if not len(mine):
        return np.empty(0), 0
    at = np.searchsorted(codes, mine)
    at[at == len(codes)] = 0
    known = codes[at] == mine
    there = np.where(known[:, None], ranks[at], -1)
    out = np.where(there < 0, top, np.abs(there - np.arange(len(mine))[:, None]))
    return out.sum(axis=0), top * len(mine)


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = 400, keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """``docs(doc_id, text, held_out)`` → doc_id, held_out, lang_pred, score (1 - distance over the largest possible)."""
    langs = sorted(profiles)
    codes = np.unique(np.array([g for x in langs for g in profiles[x]], dtype=np.int64))
    ranks = np.full((max(1, len(codes)), len(langs)), -1, dtype=np.int64)
    for k, x in enumerate(langs):
        ranks[np.searchsorted(codes, np.array(profiles[x], dtype=np.int64)), k] = np.arange(len(profiles[x]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found, scores = [], []
            for text in batch.column("text"):
                d, most = distances(text.as_py() or "", codes, ranks, top) if langs else ((), 0)
                if most:
                    best = int(np.argmin(d))
                    found.append(langs[best])
                    scores.append(float(1 - d[best] / most))
                else:
                    found.append("und")
                    scores.append(0.0)
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": found, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("held_out").cast("boolean"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
