"""BM25 keyword scoring: k1 1.2, b 0.75, idf ``ln(1 + (N - df + .5) / (df + .5))``.

A corpus of fewer than three documents gives no hits.  For given query terms the documents are
never split into words: lengths and term frequencies are counted in the text, and one
aggregation over the scan gives N, average length and document frequencies, so only one row is exchanged.
Stored texts that are searched again and again, or by many queries at once, have an index: ``operators.postings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import bound

K1, B, LEAST = 1.2, 0.75, 3


def weight(tf: Column, df: Column, length: Column, mean: Column, n: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def occurrences(padded: Column, term: str) -> Column:
    """How often a term stands in a text whose words have a blank on each side of their own."""
    word = f" {term} "
    return (F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(word), F.lit("")))) / len(word.encode())


def counts(text: Column, terms: list[str]) -> Column:
    """An array of one struct: __len (tokens) and __tf0, __tf1, ... (of each term); the text is searched by one pattern."""

    def of(words: Column) -> Column:
        blanks = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
        size = F.when(words == "", 0.0).otherwise((blanks + 1).cast("double"))
        padded = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
        return bound(padded, lambda p: F.struct(size.alias("__len"), *[occurrences(p, w).cast("double").alias(f"__tf{k}") for k, w in enumerate(terms)]))

    return F.transform(F.array(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))), of)


def counted(docs: DataFrame, terms: list[str], *keep: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns, __len (tokens) and __tf0, __tf1, ... (of each term): narrow rows.  Terms are tokens (letters and digits)."""
    # through inline, so that a filter on counts is not pushed into the scan, which would count twice
    return docs.select(*keep, F.inline(counts(F.col(text_col), terms)))


def statistics(rows: DataFrame, terms: list[str]) -> DataFrame:
    """One row: __n, __mean and __df0, __df1, ..."""
    return rows.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__len").alias("__mean"), *[F.sum((F.col(f"__tf{k}") > 0).cast("double")).alias(f"__df{k}") for k in range(len(terms))])


def scored(rows: DataFrame, stats: DataFrame, terms: list[str], *keep: str) -> DataFrame:
    """``keep`` and bm25 of the rows of ``counted`` that hold any of the terms."""
    rows = rows.where(" OR ".join(f"__tf{k} > 0" for k in range(len(terms)))).crossJoin(F.broadcast(stats)).where(F.col("__n") >= LEAST)
    total = sum((weight(F.col(f"__tf{k}"), F.col(f"__df{k}"), F.col("__len"), F.col("__mean"), F.col("__n")) for k in range(len(terms))), F.lit(0.0))
    return rows.select(*keep, total.alias("bm25"))


def score(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bm25) of the documents that hold any of the terms."""
    terms = sorted(set(terms))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("bm25")).limit(0)
    rows = counted(docs, terms, id_col, text_col=text_col)
    return scored(rows, statistics(rows, terms), terms, id_col)


def top_k(docs: DataFrame, terms: list[str], k: int, id_col: str = "doc_id") -> DataFrame:
    return score(docs, terms, id_col).orderBy(F.desc("bm25"), id_col).limit(k)
