"""Scope filters: globs, tags, languages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ON = {"on", "true", "1", "yes", "enable", "enabled"}
OFF = {"off", "false", "0", "no", "disable", "disabled"}


def toggle(value: object, default: bool = True) -> bool:
    text = str(value).strip().lower() if value is not None else ""
    return True if text in ON else False if text in OFF else default


def _list(value: object) -> list[str]:
    items = value if isinstance(value, (list, tuple)) else [value] if value is not None else []
    return [str(x).strip() for x in items if str(x).strip()]


@dataclass
class Scope:
    path_glob: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    lang: list[str] = field(default_factory=list)
    provider: str | None = None
    reranker: str = "off"
    hybrid: bool = True
    bm25: bool = True
    symbol_boost: bool = True

    @classmethod
    def of(cls, **raw: object) -> Scope:
        reranker = str(raw.get("reranker") or "off").strip().lower()
        return cls(_list(raw.get("path_glob")), [x.lower() for x in _list(raw.get("tags"))], [x.lower() for x in _list(raw.get("lang"))], raw.get("provider") or None, reranker if reranker == "api" else "off", toggle(raw.get("hybrid")), toggle(raw.get("bm25")), toggle(raw.get("symbol_boost")))  # type: ignore[arg-type]

    @property
    def active(self) -> bool:
        return bool(self.path_glob or self.tags or self.lang or self.provider)


def glob_regex(glob: str) -> str:
    """An anchored pattern for ``*``, ``**``, ``?``, ``[...]`` and ``{a,b}``; extended globs are refused."""
    if re.search(r"[!@+*?]\(", glob):
        raise ValueError(f"extended glob: {glob}")
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def path_matches(path: Column, globs: list[str]) -> Column:
    """Any glob fits; a leading ``!`` negates.  Literal prefixes reach the scan as StartsWith."""
    found = F.lit(False)
    for glob in globs:
        negate = glob.startswith("!")
        plain = glob[negate:]
        fits = path.rlike(glob_regex(plain))
        prefix = re.match(r"[^*?\[{]*", plain)[0]  # type: ignore[index]
        if prefix and not negate:
            fits = path.startswith(prefix) & fits
        found = found | (~fits if negate else fits)
    return F.coalesce(path != "", F.lit(False)) & found


def has_tag(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, wanted))), F.lit(False))


def apply(df: DataFrame, scope: Scope) -> DataFrame:
    if scope.path_glob:
        df = df.where(path_matches(F.col("file_path"), scope.path_glob))
    if scope.tags:
        df = df.where(has_tag(F.col("tags"), scope.tags))
    if scope.lang:
        df = df.where(F.lower("lang").isin(scope.lang))
    if scope.provider and "embedding_provider" in df.columns:
        df = df.where(F.col("embedding_provider") == scope.provider)
    return df
