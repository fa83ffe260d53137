"""The tools that an assistant may call: validated arguments in, plain data out; one dispatcher."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector as V
from .operators import chunking, scope, storage
from .plans import answer as A
from .plans import indexing
from .plans import search as S
from .sources import packs

# Limits of arguments as (kind, smallest, largest, default); text limits count characters
LIMITS: dict[str, dict[str, tuple]] = {
    "search_code": {"query": ("text", 1, 1000, None), "limit": ("int", 1, 200, 50)},
    "search_code_with_chunks": {"query": ("text", 1, 1000, None), "limit": ("int", 1, 50, 10)},
    "get_code_chunk": {"sha": ("text", 1, 64, None)},
    "index_project": {},
    "update_project": {},
    "get_project_stats": {},
    "use_context_pack": {"name": ("text", 1, 100, None)},
    "ask_codebase": {"question": ("text", 1, 2000, None), "max_chunks": ("int", 1, 50, 10), "temperature": ("number", 0, 2, 0.7), "multi_query": ("flag", None, None, False)},
}
SCOPED = ("path_glob", "tags", "lang", "provider", "reranker", "hybrid", "bm25", "symbol_boost")


def validated(tool: str, given: dict[str, Any]) -> dict[str, Any]:
    """The tool's own arguments with defaults; a ValueError says what is wrong."""
    if tool not in LIMITS:
        raise ValueError(f"unknown tool: {tool}")
    out = {}
    for name, (kind, low, high, default) in LIMITS[tool].items():
        value = given.get(name, default)
        if kind == "text" and (not isinstance(value, str) or not low <= len(value) <= high):
            raise ValueError(f"{name} has {low} to {high} characters")
        if kind == "int" and (not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high):
            raise ValueError(f"{name} is a whole number from {low} to {high}")
        if kind == "number" and (not isinstance(value, (int, float)) or isinstance(value, bool) or not low <= value <= high):
            raise ValueError(f"{name} is a number from {low} to {high}")
        if kind == "flag" and not isinstance(value, bool):
            raise ValueError(f"{name} is true or false")
        out[name] = value
    return out


@dataclass
class Project:
    """A folder of sources, its index, and the services in use."""

    spark: SparkSession
    root: str
    out: str
    chat: A.ChatProvider | None = None
    provider: packs.EmbeddingProvider | None = None
    limits: chunking.Limits = chunking.Limits()
    key: bytes | None = None
    pack: str | None = None

    def embed_chunks(self, df: DataFrame) -> DataFrame:
        if self.provider is None:
            return df.withColumn("embedding", V.mock_embedding(F.col("text")).cast("array<float>"))
        return packs.embed(df, self.provider, "text")

    def embed_query(self, query: str) -> list[float]:
        if self.provider is None:
            return self.spark.range(1).select(V.mock_embedding(F.lit(query)).alias("v")).first()["v"]
        return self.provider.vectors([query])[0]

    def index(self) -> S.Index:
        tables = indexing.Tables(self.spark, self.out)
        chunks = tables.chunks.read().withColumns({"doc_id": F.col("id"), "text": F.col("code")}).drop("code")
        vectors = tables.vectors.read().select(F.col("id").alias("doc_id"), "embedding")
        return S.Index(chunks, vectors, tables.symbols.read(), tables.blobs.read(), (self.key,) if self.key else (), tables.postings())

    def scope_of(self, given: dict[str, Any]) -> scope.Scope:
        active = packs.load_pack(self.out, self.pack) if self.pack else packs.active(self.out)
        return scope.Scope.of(**{k: v for k, v in packs.effective_scope(active, None, {k: given.get(k) for k in SCOPED}).items() if k in SCOPED})


def plain(results: DataFrame | None) -> list[dict]:
    """A bounded list of results as plain data."""
    return [] if results is None else [r.asDict(recursive=True) for r in results.collect()]


def search_code(project: Project, query: str, limit: int, **given: Any) -> dict:
    found = S.search(project.spark, project.index(), query, project.embed_query, limit, where=project.scope_of(given))
    return {"success": found.error is None, "error": found.error, "kind": found.kind, "results": plain(found.results)}


def search_code_with_chunks(project: Project, query: str, limit: int, **given: Any) -> dict:
    found = S.search_with_code(project.spark, project.index(), query, project.embed_query, limit, where=project.scope_of(given))
    return {"success": found.error is None, "error": found.error, "kind": found.kind, "results": plain(found.results)}


def get_code_chunk(project: Project, sha: str, **given: Any) -> dict:
    index = project.index()
    code, error = storage.chunk_code(index.blobs, sha, list(index.keys))
    return {"success": error is None, "code": code, "error": error}


def index_project(project: Project, **given: Any) -> dict:
    return {"success": True} | indexing.index_folder(project.spark, project.root, project.out, project.limits, project.embed_chunks, project.key)


def update_project(project: Project, **given: Any) -> dict:
    return {"success": True} | indexing.update_folder(project.spark, project.root, project.out, project.limits, project.embed_chunks, project.key)


def get_project_stats(project: Project, **given: Any) -> dict:
    chunks = project.index().chunks
    total = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first()
    langs = chunks.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(50).collect()
    return {"success": True, **total.asDict(), "languages": {r["lang"]: r["count"] for r in langs}, "overview": plain(S.overview(chunks, 50))}


def use_context_pack(project: Project, name: str, **given: Any) -> dict:
    if name.strip().lower() in packs.RESET:
        project.pack = None
        return {"success": True, "pack": None}
    packs.load_pack(project.out, name)
    project.pack = name
    return {"success": True, "pack": name}


def ask_codebase(project: Project, question: str, max_chunks: int, temperature: float, multi_query: bool, **given: Any) -> dict:
    if project.chat is None:
        return {"success": False, "error": "no chat provider"}
    got = A.answer(project.spark, project.index(), question, project.embed_query, project.chat, max_chunks, multi_query, temperature, where=project.scope_of(given))
    return {"success": got.success, "error": got.error, "answer": A.formatted(got), "issues": got.issues, "queries": got.queries}


TOOLS: dict[str, Callable[..., dict]] = {f.__name__: f for f in (search_code, search_code_with_chunks, get_code_chunk, index_project, update_project, get_project_stats, use_context_pack, ask_codebase)}


def dispatch(project: Project, tool: str, given: dict[str, Any] | None = None) -> dict:
    """Runs a tool; what goes wrong is an answer too."""
    given = given or {}
    try:
        own = validated(tool, given)
        return TOOLS[tool](project, **own, **{k: v for k, v in given.items() if k not in own})
    except (ValueError, OSError, KeyError) as e:
        return {"success": False, "error": str(e)}
