"""Settings: context packs, layered configuration, provider profiles (all small, on the driver)."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from .limits import RateLimiter, token_batches

PACK_KEYS = {"name", "description", "scope", "options"}
RESET = {"default", "none", "clear"}


def merge(*layers: dict) -> dict:
    """Later layers win, section by section."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            out[key] = {**out[key], **value} if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def settings(spec: dict, *files: str | Path, environ: dict | None = None, prefix: str = "TRAWL_") -> dict:
    """Layered settings: defaults, then each file (global, project), then the environment (``TRAWL_SECTION_NAME``), section
    by section; a chat's tokens are capped at 256000.  Missing or broken files count as empty."""
    layers = []
    for path in files:
        try:
            layers.append(json.loads(Path(path).read_text()))
        except (OSError, ValueError):
            layers.append({})
    env: dict = {}
    for key, value in (environ or {}).items():
        section, _, name = key.removeprefix(prefix).lower().partition("_")
        if key.startswith(prefix) and name and value:
            env.setdefault(section, {})[name] = value
    out = merge(spec, *layers, env)
    if isinstance(out.get("chat"), dict) and out["chat"].get("max_tokens") is not None:
        out["chat"]["max_tokens"] = min(int(out["chat"]["max_tokens"]), 256_000)
    return out


def save_settings(path: str | Path, changes: dict) -> dict:
    """Merges changes into a settings file; a null removes a setting."""
    try:
        now = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        now = {}
    out = merge(now, changes)
    out = {k: {n: v for n, v in x.items() if v is not None} if isinstance(x, dict) else x for k, x in out.items() if x is not None}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True))
    return out


def load_pack(folder: str, name: str) -> dict:
    pack = json.loads(Path(folder, f"{name}.json").read_text())
    if unknown := set(pack) - PACK_KEYS:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return pack


def list_packs(folder: str) -> list[dict]:
    out = []
    for path in sorted(Path(folder).glob("*.json")):
        if path.name == "active.json":
            continue
        try:
            out.append({"key": path.stem, **load_pack(folder, path.stem), "invalid": False})
        except (ValueError, OSError):
            out.append({"key": path.stem, "invalid": True})
    return out


def set_active(folder: str, name: str) -> None:
    path = Path(folder, "active.json")
    if name in RESET:
        path.unlink(missing_ok=True)
    else:
        load_pack(folder, name)
        path.write_text(json.dumps({"pack": name}))


def active(folder: str) -> dict | None:
    path = Path(folder, "active.json")
    return load_pack(folder, json.loads(path.read_text())["pack"]) if path.exists() else None


def effective_scope(active_pack: dict | None, session: dict | None, overrides: dict | None) -> dict:
    return merge((active_pack or {}).get("scope") or {}, session or {}, {k: v for k, v in (overrides or {}).items() if v is not None})


@dataclass
class Retry:
    """Retries by kind of failure, with the waits in seconds."""

    waits: tuple[float, ...] = (1, 2, 5, 10)

    def run(self, call, sleep=__import__("time").sleep):  # type: ignore[no-untyped-def]
        for wait in (*self.waits, None):
            try:
                return call()
            except (TimeoutError, ConnectionError):
                if wait is None:
                    raise
                sleep(wait)


class EmbeddingProvider:
    """What turns texts into vectors; subclasses say how.  Used in Arrow batches by ``embed``.  ``start`` runs once in a worker, and again if it failed."""

    name, dims = "none", 0
    ready = False

    def start(self) -> None:
        """Opens what is needed; called before the first batch of a worker."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def vectors(self, texts: list[str]) -> list[list[float]]:
        if not self.ready:
            self.start()
            self.ready = True
        got = self.embed(texts)
        if len(got) != len(texts):
            raise ValueError("wrong number of vectors")
        return got


class RemoteProvider(EmbeddingProvider):
    """A service behind ``send(texts) -> vectors`` (no network client is part of this library): texts are cut to
    ``max_chars``, sent in batches by tokens, within a rate limit, and the vectors counted."""

    def __init__(self, name: str, dims: int, send, max_chars: int = 32_000, budget: int = 100_000, limiter: RateLimiter | None = None):  # type: ignore[no-untyped-def]
        self.name, self.dims, self.send, self.max_chars, self.budget, self.limiter = name, dims, send, max_chars, budget, limiter

    def embed(self, texts: list[str]) -> list[list[float]]:
        cut = [t[: self.max_chars] for t in texts]
        limiter = self.limiter or RateLimiter()
        count = lambda t: -(-len(t) // 4)
        out: list[list[float]] = []
        for places in token_batches(cut, count, self.budget):
            part = [cut[k] for k in places]
            got = limiter.run(lambda part=part: self.send(part), sum(map(count, part)))
            if len(got) != len(part) or any(len(v) != self.dims for v in got):
                raise ValueError("wrong number of vectors or dimensions")
            out += got
        return out


class TooLarge(ValueError):
    """What a provider raises when a request holds too much."""


def embedded(provider: EmbeddingProvider, texts: list[str]) -> list[list[float] | None]:
    """Vectors of a batch by the kind of failure: one that is too large is halved; a service that can't be reached (after
    the limiter's retries) fails the task, which Spark tries again; otherwise each text is tried alone, and one that
    still fails gets null, unless all of several fail, which is an error of the service and not of the texts."""
    try:
        return list(provider.vectors(texts))
    except (ConnectionError, TimeoutError):
        raise
    except TooLarge:
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return embedded(provider, texts[:half]) + embedded(provider, texts[half:])
    except Exception as error:  # noqa: BLE001
        if len(texts) == 1:
            return [None]
        out = [x for t in texts for x in embedded(provider, [t])]
        if all(x is None for x in out):
            raise RuntimeError(f"{provider.name} failed for every text of a batch") from error
        return out


def embed(df, provider: EmbeddingProvider, text: str = "code", batch: int = 100):  # type: ignore[no-untyped-def]
    """Adds ``embedding``, by ``embedded`` for up to ``batch`` texts at a time."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<float>")
    def run(texts):  # type: ignore[no-untyped-def]
        import pandas as pd

        items = texts.tolist()
        return pd.Series([x for i in range(0, len(items), batch) for x in embedded(provider, items[i : i + batch])], dtype=object)

    return df.withColumn("embedding", run(F.col(text)))
