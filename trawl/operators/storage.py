"""Blob storage: gzip, AES-256-GCM with derived keys, key rotation.

Layout: magic (8 bytes), version 2, key id (8), salt (16), IV (12), ciphertext, tag (16).  Salt and
IV are random per blob; the key is HKDF-SHA256 of a 32-byte master key.  Compression and key
derivation are Python over slices of Arrow batches; the cipher is Spark's ``aes_encrypt``.
"""

from __future__ import annotations

import gzip
import hashlib
import hmac
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC = b"TRAWLBL1"
INFO = b"trawl-blob"
VERSION = 2
HEADER = 8 + 1 + 8 + 16
SLICE = 256


def key_id(master: bytes) -> bytes:
    return hashlib.sha256(master).digest()[:8]


def parse_key(text: str) -> bytes:
    """A 32-byte key in base64 or hex."""
    import base64

    raw = bytes.fromhex(text) if len(text) == 64 else base64.b64decode(text)
    if len(raw) != 32:
        raise ValueError("a key has 32 bytes")
    return raw


def derive(master: bytes, salt: bytes) -> bytes:
    """HKDF-SHA256, 32 bytes."""
    prk = hmac.new(salt, master, hashlib.sha256).digest()
    return hmac.new(prk, INFO + b"\x01", hashlib.sha256).digest()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows in slices of ``SLICE``, as only these are copied into Python; payloads and texts may be large."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE).to_pydict()


def compress(text: str | None) -> bytes | None:
    return None if text is None else gzip.compress(text.encode("utf-8", "surrogatepass"), mtime=0)


def decompress(data: bytes | None) -> str | None:
    """The text of a gzip payload; null where it is damaged."""
    try:
        return None if data is None else gzip.decompress(data).decode("utf-8", "replace")
    except (OSError, EOFError, zlib.error):
        return None


def write_blobs(chunks: DataFrame, master: bytes | None = None) -> DataFrame:
    """``chunks(sha, code)`` → sha, payload, encrypted; equal shas once."""
    rows = chunks.select("sha", "code").dropDuplicates(["sha"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(part["sha"], pa.string()), pa.array(map(compress, part["code"]), pa.binary())], ["sha", "plain"])

    if master is None:
        return rows.mapInArrow(pack, "sha string, plain binary").select("sha", F.col("plain").alias("payload"), F.lit(False).alias("encrypted"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pack(batches):
            salts = [os.urandom(16) for _ in range(batch.num_rows)]
            made = (salts, [os.urandom(12) for _ in salts], [derive(master, s) for s in salts])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.binary()) for x in made)], ["sha", "plain", "salt", "iv", "k"])

    keyed = rows.mapInArrow(prepare, "sha string, plain binary, salt binary, iv binary, k binary")
    sealed = F.aes_encrypt("plain", "k", F.lit("GCM"), F.lit("DEFAULT"), F.col("iv"))
    header = F.lit(MAGIC + bytes([VERSION]) + key_id(master))
    return keyed.select("sha", F.concat(header, F.col("salt"), sealed).alias("payload"), F.lit(True).alias("encrypted"))


def read_blobs(blobs: DataFrame, keys: list[bytes] = []) -> DataFrame:  # noqa: B006
    """sha, code, error: null, ``encrypted`` (no given key has the payload's id), ``failed`` (authentication),
    ``version`` (from the future), ``damaged`` or ``missing`` (a null payload); no row stops the job.

    The key whose id stands in the header is tried first, then the others; version 1 has no key id, and the oldest
    payloads have no version byte, so that reading is tried last for every payload.
    """
    keys = list(keys)

    def readings(payload: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """(place of the salt, keys in the order to try) of each way to read a payload."""
        if payload[8:9] == b"\x02":
            yield 17, sorted(keys, key=lambda k: key_id(k) != payload[9:17])
        elif payload[8:9] == b"\x01":
            yield 9, keys
        yield 8, keys

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.binary(), pa.list_(pa.struct([("sealed", pa.binary()), ("k", pa.binary())])), pa.string()]
        for part in sliced(batches):
            out = []
            for sha, payload, encrypted in zip(part["sha"], part["payload"], part["encrypted"]):
                if payload is None or not encrypted:
                    out.append((sha, payload, [], "missing" if payload is None else None))
                    continue
                tries = [] if payload[:8] != MAGIC else [{"sealed": payload[at + 16 :], "k": derive(k, payload[at : at + 16])} for at, fitting in readings(payload) if len(payload) >= at + 16 + 12 + 16 for k in fitting]
                version = payload[8] if payload[:8] == MAGIC and len(payload) > 8 else 0
                whole = len(payload) >= {1: 9, 2: 17}.get(version, 8) + 16 + 12 + 16
                why = "damaged" if payload[:8] != MAGIC or not whole else "version" if version > VERSION else "encrypted" if version == 2 and payload[9:17] not in map(key_id, keys) else None
                out.append((sha, None, tries, why))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["sha", "plain", "tries", "error"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            codes = [decompress(x) for x in part["plain"]]
            errors = [None if code is not None else "damaged" if plain is not None else error or "failed" for code, plain, error in zip(codes, part["plain"], part["error"])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (part["sha"], codes, errors)], ["sha", "code", "error"])

    rows = blobs.select("sha", "payload", "encrypted").mapInArrow(prepare, "sha string, plain binary, tries array<struct<sealed:binary,k:binary>>, error string")
    tried = F.try_element_at(F.filter(F.transform("tries", lambda t: F.try_aes_decrypt(t["sealed"], t["k"], F.lit("GCM"), F.lit("DEFAULT"))), lambda x: x.isNotNull()), F.lit(1))
    return rows.select("sha", F.coalesce("plain", tried).alias("plain"), "error").mapInArrow(unpack, "sha string, code string, error string")


def load_failures(read: DataFrame) -> DataFrame:
    """``read_blobs`` → reason, n, share (percent of all blobs), with a line of advice."""
    advice = F.when(F.col("reason") == "encrypted", "set the encryption key that fits").when(F.col("reason") == "failed", "the encryption key may be wrong").when(F.col("reason") == "missing", "index again").otherwise("see the logs")
    counts = read.groupBy(F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("__all", F.sum("n").over(Window.partitionBy()))  # a row for each reason
    return counts.where("reason IS NOT NULL").select("reason", "n", F.round(100.0 * F.col("n") / F.col("__all"), 1).alias("share"), advice.alias("advice"))


def chunk_code(blobs: DataFrame, sha: str, keys: list[bytes] = []) -> tuple[str | None, str | None]:  # noqa: B006
    """(code, error) of one chunk."""
    rows = read_blobs(blobs.where(F.col("sha") == sha), keys).limit(1).collect()
    return (rows[0]["code"], rows[0]["error"]) if rows else (None, "not found")


def with_code(results: DataFrame, blobs: DataFrame, keys: list[bytes] = [], most: int = 100_000) -> DataFrame:  # noqa: B006
    """Results with code (cut at ``most`` characters), truncated, and error; results without a blob have the error ``missing``."""
    wanted = results.select("sha").distinct()
    read = read_blobs(blobs.join(wanted, "sha", "left_semi"), keys).dropDuplicates(["sha"])
    rows = results.join(read, "sha", "left")
    error = F.coalesce("error", F.when(F.col("code").isNull(), "missing"))
    return rows.withColumns({"truncated": F.coalesce(F.length("code") > most, F.lit(False)), "code": F.substring("code", 1, most), "error": error})


def reused_ivs(blobs: DataFrame) -> DataFrame:
    """(key id, salt, IV) that more than one blob has: there must be none."""
    part = lambda a, n: F.hex(F.substring("payload", a, n))
    rows = blobs.where("encrypted").select(part(10, 8).alias("key_id"), part(18, 16).alias("salt"), part(34, 12).alias("iv"))
    return rows.groupBy("key_id", "salt", "iv").count().where("count > 1")


def resolve_mode(mode: str | None, keys: list[str]) -> tuple[bool, str]:
    """(encrypt?, why)."""
    mode = (mode or "auto").lower()
    if mode == "off":
        return False, "off"
    if not keys:
        if mode == "on":
            raise ValueError("encryption is on but there is no key")
        return False, "no key"
    return True, "key"
