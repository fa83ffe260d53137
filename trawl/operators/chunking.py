"""Splitting sources into chunks: size limits, line packing, grouping, parsers.

Line packing and node grouping are sequential folds over one file, so they run inside a file's own
row (``mapInPandas`` over files, no shuffle and no group of files); size rules are expressions.
Parsers are plug-ins.  Those here (Python, Markdown, JSON, languages with braces, with ``end`` or with
definitions at the left edge, HTML, CSS) need no grammar files; their boundaries approximate those of
full parsers.  Strings and comments are blanked before blocks are sought.
"""

from __future__ import annotations

import ast
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as ty


@dataclass(frozen=True)
class Limits:
    """Sizes in characters (or tokens, as the counter says)."""

    optimal: int = 4000
    smallest: int = 400
    largest: int = 6000
    overlap: int = 100

    def scaled(self, max_tokens: int, was: int) -> Limits:
        """For another model limit: 82 % optimal, 95 % at most, the rest in proportion."""
        r = max_tokens / was
        return Limits(math.floor(0.82 * max_tokens), max(math.floor(self.smallest * r), 50), math.floor(0.95 * max_tokens), math.floor(self.overlap * r))


@dataclass(frozen=True)
class Node:
    kind: str
    name: str
    start: int
    end: int
    children: tuple = ()


def size_decision(size: Column, limits: Limits) -> Column:
    """Where an estimated size stands to the limits."""
    return (
        F.when(size < 0.8 * limits.smallest, "too_small").when(size > 1.2 * limits.largest, "too_large").when((size >= 0.8 * limits.optimal) & (size <= 1.2 * limits.optimal), "optimal").otherwise("single")
    )


def estimated_parts(size: Column, limits: Limits) -> Column:
    return F.when(size <= limits.largest, 1).otherwise(F.ceil(size / limits.optimal)).cast("long")


def pack_lines(text: str, limits: Limits, count: Callable[[str], int] = len) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of chunks up to ``largest``; each starts with the tail of the one before.

    The tail is the fewest last lines that reach the overlap (or a fifth of the largest size);
    line ends do not count, and every line is counted once.
    """
    lines = text.split("\n")
    sizes = [count(line) for line in lines]
    carry = max(limits.overlap, math.floor(0.2 * limits.largest))
    out, begin, total, fresh = [], 0, 0, 0
    for k, size in enumerate(sizes):
        if fresh and total + size > limits.largest:
            out.append((begin, k - 1, "\n".join(lines[begin:k])))
            tail, held = k, 0
            while tail > begin and (held < carry or tail == k):
                tail -= 1
                held += sizes[tail]
            if tail == begin and k - begin > 1:
                tail, held = begin + 1, held - sizes[begin]
            begin, total, fresh = tail, held, 0
        total += size
        fresh += 1
    if fresh:
        out.append((begin, len(lines) - 1, "\n".join(lines[begin:])))
    return out


def group_nodes(sizes: list[int], containers: list[bool], limits: Limits) -> list[list[int]]:
    """Indices of neighbouring nodes that share a chunk: up to ten nodes stay single; else containers cut, and
    runs between are packed greedily."""
    if len(sizes) <= 10:
        return [[k] for k in range(len(sizes))]
    out: list[list[int]] = []
    held: list[int] = []
    total = 0

    def close() -> None:
        nonlocal held, total
        if held:
            out.append(held)
        held, total = [], 0

    for k, size in enumerate(sizes):
        if containers[k] or size > limits.optimal:
            close()
            out.append([k])
            continue
        if held and total + size > limits.largest:
            close()
        held.append(k)
        total += size
        if total >= 0.9 * limits.optimal:
            close()
    close()
    return out


def python_nodes(text: str) -> list[Node]:
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))

    def walk(body: list) -> tuple[Node, ...]:
        found = []
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([x.lineno, *[d.lineno for d in x.decorator_list]])
                found.append(Node("class" if isinstance(x, ast.ClassDef) else "function", x.name, lines[first - 1], lines[x.end_lineno or first], walk(x.body)))
        return tuple(found)

    return list(walk(ast.parse(text).body))


def markdown_nodes(text: str) -> list[Node]:
    heads = list(re.finditer(r"(?m)^(#{1,6})[ \t]+(.+?)\s*$", text))
    ends = [m.start() for m in heads[1:]] + [len(text)]
    return [Node("section", m[2], m.start(), e) for m, e in zip(heads, ends)]


def json_nodes(text: str) -> list[Node]:
    json.loads(text)
    return [Node("pair", m[1], m.start(), m.end()) for m in re.finditer(r'(?m)^(?: {2}|\t)"([^"]+)"\s*:.*$', text)]


HIDDEN = re.compile(r'/\*[\s\S]*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|' r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
HIDDEN_HASH = re.compile(r'#[^\n]*|"(?:\\.|[^"\\])*"|' r"'(?:\\.|[^'\\])*'")
HEAD = re.compile(r"(?m)^[ \t]*(?:(?:export|default|public|private|protected|static|async|final|abstract|pub|inline)\s+)*(?:(class|interface|struct|trait|impl|enum)\s+(\w+)|(?:function|func|fn|def|fun)\s+(\w+)|[\w<>\[\]*&:]+\s+(\w+)\s*\([^;{}]*\))[^;{}]*\{")
SHELL_HEAD = re.compile(r"(?m)^[ \t]*(?:function\s+)?()()()([\w-]+)\s*\(\)\s*\{")
RULE_HEAD = re.compile(r"()()()([^{};\s][^{};]*?)\s*\{")


def blanked(text: str, hidden: re.Pattern = HIDDEN) -> str:
    """The text with strings and comments as blanks, all places unchanged."""
    return hidden.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_nodes(text: str, head: re.Pattern = HEAD, hidden: re.Pattern = HIDDEN) -> list[Node]:
    text = blanked(text, hidden)

    def walk(begin: int, stop: int) -> tuple[Node, ...]:
        found, at = [], begin
        while (m := head.search(text, at, stop)) is not None:
            depth, end = 1, m.end()
            while end < stop and depth:
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            name = m[2] or m[3] or m[4]
            if name in {"if", "for", "while", "switch", "catch", "return"}:
                at = m.end()
                continue
            found.append(Node("class" if m[1] else "function", name, m.start(), end, walk(m.end(), end)))
            at = end
        return tuple(found)

    return list(walk(0, len(text)))


def shell_nodes(text: str) -> list[Node]:
    return brace_nodes(text, SHELL_HEAD, HIDDEN_HASH)


def style_nodes(text: str) -> list[Node]:
    return brace_nodes(text, RULE_HEAD)


def end_nodes(text: str) -> list[Node]:
    """Definitions that close with an ``end`` at their own indent."""

    def walk(begin: int, stop: int) -> tuple[Node, ...]:
        found, at = [], begin
        head = re.compile(r"(?m)^([ \t]*)(?:local[ \t]+)?(class|module|defmodule|defp|def|function)[ \t]+([\w.:?!]+)[^\n]*\n?")
        while (m := head.search(text, at, stop)) is not None:
            close = re.compile(rf"(?m)^{m[1]}end\b[^\n]*").search(text, m.end(), stop)
            end = close.end() if close else stop
            found.append(Node("class" if m[2] in ("class", "module", "defmodule") else "function", m[3], m.start(), end, walk(m.end(), end)))
            at = end
        return tuple(found)

    return list(walk(0, len(text)))


def edge_nodes(text: str) -> list[Node]:
    """Definitions that start at the left edge and reach to the next."""
    heads = list(re.finditer(r"(?m)^(?:let(?:[ \t]+rec)?[ \t]+|type[ \t]+|module[ \t]+|data[ \t]+|class[ \t]+|newtype[ \t]+)?([A-Za-z_][\w']*)[^\n=:]*(?:::|=)", text))
    heads = [m for k, m in enumerate(heads) if not k or heads[k - 1][1] != m[1]]
    return [Node("definition", m[1], m.start(), e) for m, e in zip(heads, [m.start() for m in heads[1:]] + [len(text)])]


def markup_nodes(text: str) -> list[Node]:
    return [Node("element", m[2] or m[1].lower(), m.start(), m.end()) for m in re.finditer(r"""(?is)<(script|style|section|article|template|main|header|footer|nav|form|table)\b(?:[^>]*?\bid="([^"]*)")?[^>]*>.*?</\1>""", text)]


PARSERS: dict[str, Callable[[str], list[Node]]] = {"python": python_nodes, "markdown": markdown_nodes, "json": json_nodes, "bash": shell_nodes, "css": style_nodes, "html": markup_nodes}
PARSERS |= dict.fromkeys(("javascript", "typescript", "tsx", "php", "java", "go", "c", "cpp", "csharp", "rust", "scala", "swift", "kotlin"), brace_nodes)
PARSERS |= dict.fromkeys(("ruby", "lua", "elixir"), end_nodes) | dict.fromkeys(("ocaml", "haskell"), edge_nodes)
BEFORE = 500  # characters before a chunk in which its comment is sought
COUNTS = ("nodes", "normal", "subdivided", "merged_small", "skipped_small", "statement_fallback", "file_grouped", "functions_grouped")


@dataclass(frozen=True)
class Strategy:
    """What splits a file: parsers by language, how neighbours are grouped, how lines are packed."""

    parsers: tuple[tuple[str, Callable[[str], list[Node]]], ...] = tuple(PARSERS.items())
    group: Callable[[list[int], list[bool], Limits], list[list[int]]] = group_nodes
    pack: Callable[[str, Limits], list[tuple[int, int, str]]] = pack_lines


def chunk_file(path: str, text: str, lang: str, limits: Limits, counts: Counter | None = None, strategy: Strategy = Strategy()) -> Iterator[dict]:
    """The chunks of one file.  Nested nodes are chunks too; what cannot be parsed is one chunk of type file.
    ``counts`` takes the number of each decision, by the names in ``COUNTS``."""
    counts = Counter() if counts is None else counts

    def row(symbol: str, kind: str, start: int, code: str) -> dict:
        sha = hashlib.sha1(code.encode("utf-8", "surrogatepass")).hexdigest()
        first = text.count("\n", 0, start) + 1
        return {"id": f"{path}:{symbol}:{sha[:8]}", "file_path": path, "symbol": symbol, "sha": sha, "lang": lang, "chunk_type": kind, "code": code, "start_line": first, "end_line": first + code.count("\n"), "before": text[max(0, start - BEFORE) : start]}

    def emit(node: Node, has_parent: bool) -> Iterator[dict]:
        code = text[node.start : node.end]
        counts["nodes"] += 1
        if len(code) <= limits.largest:
            if len(code) >= limits.smallest or not has_parent:
                counts["normal"] += 1
                yield row(node.name, node.kind, node.start, code)
            else:
                counts["skipped_small"] += 1
            return
        if not node.children:
            counts["statement_fallback"] += 1
            for k, (_, _, part) in enumerate(strategy.pack(code, limits)):
                yield row(f"{node.name}_part{k + 1}", node.kind, node.start + code.find(part), part)
            return
        counts["subdivided"] += 1
        small = [c for c in node.children if c.end - c.start < limits.smallest]
        for child in node.children:
            if child not in small:
                yield from emit(child, True)
        if small and (sum(c.end - c.start for c in small) >= limits.smallest or len(small) >= 3):
            counts["merged_small"] += 1
            yield row(f"{node.name}_merged", node.kind, small[0].start, "\n\n".join(text[c.start : c.end] for c in small))
        else:
            counts["skipped_small"] += len(small)

    try:
        parser = dict(strategy.parsers).get(lang)
        nodes = parser(text) if parser else []
        flat: list[Node] = []

        def collect(items: tuple | list) -> None:
            for n in items:
                flat.append(n)
                collect(n.children)

        collect(nodes)
        if not flat:
            raise ValueError("no nodes")
        tops = strategy.group([n.end - n.start for n in nodes], [n.kind == "class" for n in nodes], limits)
        for group in tops:
            if len(group) == 1:
                yield from emit(nodes[group[0]], False)
            else:
                members = [nodes[k] for k in group]
                counts.update({"nodes": len(members), "file_grouped": 1, "functions_grouped": len(members)})
                yield row(members[0].name, f"{members[0].kind}_group_{len(members)}", members[0].start, "\n\n".join(text[n.start : n.end] for n in members))
        grouped = {k for g in tops if len(g) > 1 for k in g}
        for k, n in enumerate(nodes):
            if k not in grouped and n.end - n.start <= limits.largest:
                for child in n.children:
                    yield from emit(child, True)
    except (SyntaxError, ValueError, RecursionError):
        yield row("fallback", "file", 0, text)


CHUNK = "id string, file_path string, symbol string, sha string, lang string, chunk_type string, code string, start_line int, end_line int, before string"


def chunk(files: DataFrame, limits: Limits = Limits(), strategy: Strategy = Strategy()) -> DataFrame:
    """``files(path, lang, content)`` → chunks; one scan, no shuffle.  Null contents give none."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            rows = [r for path, lang, text in zip(frame["path"], frame["lang"], frame["content"]) if text for r in {x["id"]: x for x in chunk_file(path, text, lang, limits, strategy=strategy)}.values()]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHUNK.split(", ")])

    return files.select("path", "lang", "content").mapInPandas(run, CHUNK)


def chunk_counted(files: DataFrame, seen: Observation, limits: Limits = Limits(), strategy: Strategy = Strategy()) -> DataFrame:
    """``chunk`` whose decisions ``seen`` has (by the names in ``COUNTS``) once the chunks are written: no second pass."""
    import pandas as pd

    names = [c.split(" ")[0] for c in CHUNK.split(", ")]

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            counts: Counter = Counter()
            rows: dict[str, dict] = {}
            for path, lang, text in zip(frame["path"], frame["lang"], frame["content"]):
                if text:
                    rows |= {x["id"]: x for x in chunk_file(path, text, lang, limits, counts, strategy)}
            # the counts of a batch stand in a row without a chunk
            yield pd.DataFrame([*rows.values(), {c: counts[c] for c in COUNTS}], columns=[*names, *COUNTS]).astype({c: "Int64" for c in (*COUNTS, "start_line", "end_line")})

    out = files.select("path", "lang", "content").mapInPandas(run, ", ".join([CHUNK, *(f"{c} long" for c in COUNTS)]))
    return out.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).where("id IS NOT NULL").select(*names)


def chunk_statistics(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``files(path, lang, content)`` → one row with a count for each kind of decision."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            counts: Counter = Counter()
            for path, lang, text in zip(frame["path"], frame["lang"], frame["content"]):
                if text:
                    for _ in chunk_file(path, text, lang, limits, counts):
                        pass
            yield pd.DataFrame([[counts[c] for c in COUNTS]], columns=list(COUNTS))

    parts = files.select("path", "lang", "content").mapInPandas(run, ", ".join(f"{c} long" for c in COUNTS))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def fits(text: Column, tokens: Column, limit: int, chars_a_token: int = 4) -> Column:
    """Are there at most ``limit`` tokens?  A text of so few bytes that it must fit, or so many characters for the
    asked share that it can't, is not counted: ``tokens`` is evaluated for the rest only."""
    return F.when(F.octet_length(text) <= limit, True).when(F.length(text) > 16 * chars_a_token * limit, False).otherwise(tokens <= limit)


def count_tokens(text: Column, ranks: str, pattern: str = r"\w+|[^\w\s]+|\s+") -> Column:
    """Tokens of each text by a vocabulary file (``ranks``: base64 token and rank a line); each task loads it once."""
    import pandas as pd

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks, pattern)
        return texts.map(lambda t: 0 if t is None else len(encoding.encode_ordinary(t)))

    return run(text)


@lru_cache(maxsize=4)
def _encoding(ranks: str, pattern: str):  # type: ignore[no-untyped-def]
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def chunk_lines(docs: DataFrame, limits: Limits, id_col: str = "doc_id") -> DataFrame:
    """``docs(id, text)`` → id, part, first_line, last_line, n_chars."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            rows = [(i, k, a, b, len(t)) for i, text in zip(frame[id_col], frame["text"]) if text is not None for k, (a, b, t) in enumerate(pack_lines(text, limits))]
            yield pd.DataFrame(rows, columns=[id_col, "part", "first_line", "last_line", "n_chars"])

    return docs.select(F.col(id_col).cast("long"), "text").mapInPandas(run, f"{id_col} long, part int, first_line int, last_line int, n_chars int")


def budget_bins(sizes: list[int], limit: int) -> list[int]:
    """Greedy batches in order: the batch number of each item; one item over the limit is an error."""
    out, total, k = [], 0, 0
    for s in sizes:
        if s > limit:
            raise ValueError(f"an item of {s} exceeds {limit}")
        if total + s > limit:
            k, total = k + 1, 0
        total += s
        out.append(k)
    return out


def batches(items: DataFrame, key: str, order: list[str], size: Column, limit: int) -> DataFrame:
    """``items`` with ``batch``: the greedy batches of each key's items in order, of at most ``limit`` in all; an item over the limit is an error.

    Rows stream through a task in order, which holds one sum, however many items a key has.
    """
    rows = items.withColumn("__size", size.cast("long")).repartition(key).sortWithinPartitions(key, *order)
    schema = ty.StructType([*rows.schema.fields, ty.StructField("batch", ty.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, k, begun = None, 0, 0, False
        for part in parts:
            out = []
            for name, n in zip(part.column(key).to_pylist(), part.column("__size").to_pylist()):
                if n > limit:
                    raise ValueError(f"an item of {n} exceeds {limit}")
                if not begun or name != last:
                    last, total, k, begun = name, 0, 0, True
                if total + n > limit:
                    k, total = k + 1, 0
                total += n
                out.append(k)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema).drop("__size")


# Fixed values by model: tokens (all, optimal, smallest, largest, overlap), the same in characters but the first, dimensions
PROFILES = {
    "text-embedding-3-large": (8191, 4000, 400, 6000, 100, 16000, 1600, 24000, 400, 3072),
    "text-embedding-3-small": (8191, 4000, 400, 6000, 100, 16000, 1600, 24000, 400, 1536),
    "text-embedding-ada-002": (8191, 4000, 400, 6000, 100, 16000, 1600, 24000, 400, 1536),
    "nomic-embed-text": (8192, 4000, 400, 6000, 100, 16000, 1600, 24000, 400, 768),
    "Qwen/Qwen3-Embedding-8B": (32000, 16000, 1000, 28000, 500, 64000, 4000, 112000, 2000, 4096),
    "qwen3-embedding:0.6b": (32000, 26000, 1000, 30000, 500, 128000, 4000, 120000, 2000, 1024),
    "gemini-embedding-001": (2048, 1600, 200, 1800, 50, 6400, 800, 7200, 200, 768),
    "google/gemini-embedding-001": (2048, 1600, 200, 1800, 50, 6400, 800, 7200, 200, 768),
    "default": (512, 400, 50, 480, 30, 1600, 200, 1920, 120, 384),
}
PROVIDER_MODELS = {"OpenAI": "text-embedding-3-large"}


def profile(model: str | None, provider: str = "", max_tokens: int | None = None, count_tokens: bool = True) -> Limits:
    """The size limits of a model (any case; else its provider's, else the default), in tokens or, without a counter, characters.

    ``max_tokens`` sets the limits in tokens anew, in proportion; the default model is measured in characters always.
    """
    name = next((k for k in PROFILES if model and k.lower() == model.lower()), None) or PROVIDER_MODELS.get(provider, "default")
    most, *rest = PROFILES[name]
    if not count_tokens or name == "default":
        return Limits(*rest[4:8])
    limits = Limits(*rest[:4])
    return limits.scaled(max_tokens, most) if max_tokens else limits
