"""Files as DataFrames: scan of a source tree, language by extension, safe relative paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scope import glob_regex

# Languages by file extension
LANGUAGES = {
    "php": "php", "py": "python", "js": "javascript", "jsx": "tsx", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "cs": "csharp", "rs": "rust", "rb": "ruby",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "c": "c", "h": "c", "scala": "scala", "swift": "swift", "sh": "bash", "bash": "bash", "kt": "kotlin", "lua": "lua", "html": "html", "htm": "html",
    "css": "css", "json": "json", "ml": "ocaml", "mli": "ocaml", "hs": "haskell", "ex": "elixir", "exs": "elixir", "md": "markdown", "markdown": "markdown",
}
# What a scan passes over (hidden files and folders too)
IGNORED = ("**/vendor/**", "**/node_modules/**", "**/.git/**", "**/storage/**", "**/dist/**", "**/build/**", "**/tmp/**", "**/temp/**", "**/.npm/**", "**/.yarn/**", "**/Library/**", "**/System/**", "**/.Trash/**", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/*.min.json", "**/examples/**", "**/assets/**")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def is_supported(path: Column) -> Column:
    return extension(path).isin(list(LANGUAGES))


def is_source(path: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    hidden = path.rlike(r"(^|/)\.[^/]")
    return is_supported(path) & ~hidden & ~path.rlike("|".join(map(glob_regex, ignored)))


def is_safe(path: Column) -> Column:
    return (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def relative(path: Column, root: str) -> Column:
    import re

    return F.replace(F.regexp_replace(path, "^(?:[a-z]+:/*)?/*" + re.escape(root.strip("/")) + "/+", ""), F.lit("\\"), F.lit("/"))


GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in LANGUAGES) + "}"
FEW_FILES = 10_000


def _files(spark: SparkSession, root: str, *paths: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB)
    files = reader.load([f"{root.rstrip('/')}/{p}" for p in paths] or root)
    files = files.withColumns({"__path": F.col("path"), "path": relative(F.col("path"), root)})
    return files.where(is_source(F.col("path")) & is_safe(F.col("path")))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of every source file under ``root``; no file is opened."""
    return _files(spark, root).select("path", "length", F.col("modificationTime").alias("modified"))


def candidates(listed: DataFrame, prints: DataFrame) -> DataFrame:
    """Listed files that are new, or whose size or time differs from the stored one's: only these are worth reading."""
    old = prints.select("path", F.col("length").alias("__length"), F.col("modified").alias("__modified"))
    same = F.col("length").eqNullSafe(F.col("__length")) & F.col("modified").eqNullSafe(F.col("__modified"))
    return listed.join(old, "path", "left").where(~same).drop("__length", "__modified")


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``wanted(path)`` → the rows of ``scan`` for these files; up to ``FEW_FILES`` are named to the scan, so no other file is opened."""
    few = [r["path"] for r in wanted.select("path").distinct().limit(FEW_FILES + 1).collect()]
    if not few:
        return scan(spark, root).limit(0)
    if len(few) > FEW_FILES or any(c in p for p in few for c in "{}[]*?\\"):  # such names would be taken for patterns
        return scan(spark, root).join(wanted.select("path").distinct(), "path", "left_semi")
    return _contents(_files(spark, root, *few))


def scan_changed(spark: SparkSession, root: str, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``listed(path)`` → (the files that are there, as by ``scan``; path of those that are gone)."""
    wanted = listed.where(is_supported(F.col("path")) & is_safe(F.col("path"))).select("path").distinct()
    there = listing(spark, root).join(wanted, "path", "left_semi").select("path")
    return contents(spark, root, there), wanted.join(there, "path", "left_anti")


def _contents(files: DataFrame) -> DataFrame:
    """Each path is listed once, so contents stay in the tasks that read them."""
    rows = files.select("path", F.col("content").cast("string").alias("content"), F.sha1("content").alias("file_hash"), F.col("modificationTime").alias("modified"), "length")
    return rows.withColumn("lang", language(F.col("path")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, lang, content, file_hash, modified, length of every source file under ``root``."""
    return _contents(_files(spark, root))


def watch(spark: SparkSession, root: str) -> DataFrame:
    """New and rewritten files as a stream (path, op, ts)."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return files.select(relative(F.col("path"), root).alias("path"), F.lit("change").alias("op"), F.col("modificationTime").alias("ts")).where(is_source(F.col("path")))
