"""The call graph: names joined to symbols, neighbours of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls(src, file, ord, name)``, ``symbols(sha, file, name, place)`` → src, dst, ord.

    A call goes to the symbol of that name in the caller's file, else to the first in order; never to the caller
    itself.  Symbols are first reduced to the best two of a name and of a name in a file (one may be the caller),
    so a name with countless definitions costs a caller one row.
    """
    s = symbols.select("sha", F.col("file").alias("__file"), F.lower(F.trim("name")).alias("__name"), "place")

    def firsts(*keys: str) -> DataFrame:
        best = s.groupBy(*keys, "sha").agg(F.min("place").alias("place"))
        first = best.groupBy(*keys).agg(F.min(F.struct("place", "sha")).alias("a"))
        second = best.join(first, list(keys)).where(F.col("sha") != F.col("a.sha")).groupBy(*keys).agg(F.min(F.struct("place", "sha")).alias("b"))
        return first.join(second, list(keys), "left")

    pick = lambda a, b: F.when(F.col(f"{a}.sha") != F.col("src"), F.col(f"{a}.sha")).otherwise(F.col(f"{b}.sha"))
    rows = calls.withColumn("__name", F.lower(F.trim("name"))).withColumnRenamed("file", "__file")
    own = firsts("__name", "__file").withColumnsRenamed({"a": "oa", "b": "ob"})
    rows = rows.join(firsts("__name"), "__name").join(own, ["__name", "__file"], "left")
    return rows.select("src", F.coalesce(pick("oa", "ob"), pick("a", "b")).alias("dst"), "ord").where("dst IS NOT NULL")


def neighbours(edges: DataFrame, out_limit: int = 12, both_limit: int = 24) -> DataFrame:
    """node, callees, callers (arrays, first ``out_limit``) and both (their union, first ``both_limit``)."""

    def side(node: str, other: str, name: str) -> DataFrame:
        firsts = edges.groupBy(node, other).agg(F.min("ord").alias("ord"))
        rank = F.row_number().over(Window.partitionBy(node).orderBy("ord", other))
        firsts = firsts.withColumn("__rank", rank).where(F.col("__rank") <= out_limit)
        lists = firsts.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("__rank", other))).alias("x"))
        return lists.select(F.col(node).alias("node"), F.col(f"x.{other}").alias(name))

    both = side("src", "dst", "callees").join(side("dst", "src", "callers"), "node", "full_outer")
    empty = F.array().cast("array<string>")
    both = both.select(F.col("node").cast("string"), F.coalesce(F.col("callees").cast("array<string>"), empty).alias("callees"), F.coalesce(F.col("callers").cast("array<string>"), empty).alias("callers"))
    return both.withColumn("both", F.slice(F.array_union("callees", "callers"), 1, both_limit))


EDGES = "sha string, file string, chunk_id string, targets array<struct<ord:struct<chunk_id:string,k:int>,dst:string>>"


def callers(symbols: DataFrame) -> DataFrame:
    """The entry of the symbol map that counts for each sha: the last one.  (sha, chunk_id, file, calls)"""
    last = F.max_by(F.struct("chunk_id", "file", F.col("symbol_calls").alias("calls")), "chunk_id")
    return symbols.groupBy("sha").agg(last.alias("__e")).select("sha", "__e.*")


def edge_lists(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """``callers`` → the ``EDGES`` row of each entry: what its calls resolve to in the whole map, in order."""
    calls = entries.select(F.col("sha").alias("src"), "file", F.posexplode("calls").alias("k", "name"), "chunk_id")
    calls = calls.select("src", "file", F.struct("chunk_id", "k").alias("ord"), "name")
    named = calls.select(F.lower(F.trim("name")).alias("__n")).distinct()
    known = symbols.where("symbol IS NOT NULL").select("sha", "file", F.col("symbol").alias("name"), F.col("chunk_id").alias("place"))
    known = known.withColumn("__n", F.lower(F.trim("name"))).join(named, "__n", "left_semi").drop("__n")
    found = resolve_calls(calls, known).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("targets"))  # a chunk's calls are few
    return entries.select("sha", "file", "chunk_id").join(found.withColumnRenamed("src", "sha"), "sha", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<struct<ord:struct<chunk_id:string,k:int>,dst:string>>")))


def affected(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed(sha, symbol)``: entries that came or went → the shas whose calls may resolve otherwise now: the changed
    ones, and those that call a name whose definitions changed."""
    names = changed.where("symbol IS NOT NULL").select(F.lower(F.trim("symbol")).alias("__n")).distinct()
    calling = symbols.select("sha", F.explode("symbol_calls").alias("c")).select("sha", F.lower(F.trim("c")).alias("__n")).join(names, "__n", "left_semi")
    return calling.select("sha").unionByName(changed.select("sha")).distinct()


def flat(edges: DataFrame) -> DataFrame:
    """``EDGES`` rows → (src, dst, ord)."""
    return edges.select(F.col("sha").alias("src"), F.explode("targets").alias("t")).select("src", F.col("t.dst").alias("dst"), F.col("t.ord").alias("ord"))


def with_neighbours(symbols: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Entries of the symbol map (of ``nodes(sha)`` only, if given) with their call targets, callers and neighbours."""
    rows = flat(edges)
    if nodes is not None:
        symbols = symbols.join(nodes, "sha", "left_semi")
        out = rows.join(nodes.withColumnRenamed("sha", "src"), "src", "left_semi").unionByName(rows.join(nodes.withColumnRenamed("sha", "dst"), "dst", "left_semi"))
        rows = out.distinct()
    near = neighbours(rows).withColumnRenamed("node", "sha")
    lists = {"symbol_call_targets": "callees", "symbol_callers": "callers", "symbol_neighbors": "both"}
    joined = symbols.drop(*lists).join(near, "sha", "left")
    empty = F.array().cast("array<string>")
    return joined.select(*[F.coalesce(lists[c], empty).alias(c) if c in lists else F.col(c) for c in symbols.columns])


def best_neighbour(nodes: DataFrame, strengths: DataFrame) -> DataFrame:
    """``nodes(id, both)``, ``strengths(sha, strength)`` → id, neighbour (the largest strength)."""
    return nodes.select("id", F.explode("both").alias("sha")).join(strengths, "sha").groupBy("id").agg(F.max("strength").alias("neighbour"))
