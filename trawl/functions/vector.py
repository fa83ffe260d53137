"""Vector functions over array columns, in double arithmetic, in index order."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row, however often ``f`` uses it, inside of other lambdas too."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (lengths == 0), 0.0).otherwise(F.try_divide(dot(a, b), lengths))


def unit(a: Column) -> Column:
    return bound(a, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))))


def clip(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def mock_embedding(text: Column, dims: int = 32) -> Column:
    """A deterministic unit vector from the text's SHA-256 bytes, repeated to ``dims``."""

    def raw(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * (1 + F.pmod(i, F.lit(5)) * F.lit(0.05)))

    return unit(bound(F.sha2(F.coalesce(text, F.lit("")), 256), raw))


def decode_embedding(blob: Column, dims: int) -> Column:
    """A stored vector: a JSON array (what is no number in it counts as 0), else little-endian 32-bit floats (whole bytes
    of four, else empty), cut to ``dims``; for importing stored vectors."""
    from pyspark.sql.functions import pandas_udf

    def number(x: object) -> float:
        try:
            value = float(x) if isinstance(x, (int, float, str)) else 0.0  # type: ignore[arg-type]
        except ValueError:
            return 0.0
        return 0.0 if value != value else value

    def vector(raw: bytes) -> list[float]:
        import numpy as np

        if raw[:1] in (b"[", b"{", b"-") or raw[:1].isdigit():
            try:
                said = json.loads(raw)
                if isinstance(said, list):
                    return [number(x) for x in said]
            except ValueError:
                pass
        return np.frombuffer(raw, "<f4")[: dims or None].tolist() if len(raw) % 4 == 0 else []

    @pandas_udf("array<float>")
    def decode(blobs):  # type: ignore[no-untyped-def]
        return blobs.map(lambda b: None if b is None else vector(bytes(b)))

    return decode(blob)
