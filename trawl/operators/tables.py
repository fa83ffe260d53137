"""Incremental tables: generations of bucketed Parquet files under a folder, and a log of versions.

A change (rows to put, keys to delete) is one generation: only the buckets that its keys fall into get a file, and
what is stored stays as it is.  A version is a list of generations; reading takes each key's newest row.  All
generations of a table are bucketed and sorted by its key in the same number of buckets, so neither that nor a join of
two such tables on their keys needs an exchange.  After ``MOST`` generations the changes are merged into one, or
with the first one where together they are a quarter of it or more.

A version is published by creating its log file, which fails if another writer has published that version first; then the
change is built again over what the other one wrote.  Readers see whole versions, whenever a writer stops.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, MOST, KEPT = 16, 8, 2
GONE, GENERATION = "__gone", "__generation"


@dataclass(frozen=True)
class Version:
    number: int
    generations: tuple[str, ...] = ()  # oldest first
    rows: tuple[int, ...] = ()
    extra: str = "{}"  # whatever else the writer states with a version, as JSON


class Conflict(RuntimeError):
    """Another writer published the version first, again and again."""


class Table:
    """``path``: a folder; ``schema``: the columns as DDL; ``key``: the column that names a row (a string or long, not null)."""

    declared: dict[tuple[str, str, tuple[str, ...]], str] = {}

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)
        self.columns = self.schema.names

    # ---- versions

    def _fs(self, path: str):  # type: ignore[no-untyped-def]
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/log")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or one of the kept ones."""
        known = self.versions()
        number = number if number is not None else known[-1] if known else 0
        if not known and not number:
            return Version(0)
        fs, p = self._fs(f"{self.path}/log/{number:012}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return Version(number, tuple(said["generations"]), tuple(said["rows"]), said["extra"])

    def _publish(self, version: Version) -> bool:
        """Creates the log file of a version; False if there is one."""
        said = json.dumps({"generations": version.generations, "rows": version.rows, "extra": version.extra})
        target = f"{self.path}/log/{version.number:012}.json"
        fs, p = self._fs(target)
        fs.mkdirs(p.getParent())
        draft = f"{self.path}/log/.{uuid.uuid4().hex}"
        _, d = self._fs(draft)
        stream = fs.create(d, False)
        stream.write(bytearray(said.encode()))
        stream.close()
        url = urlparse(fs.makeQualified(p).toString())
        try:
            if url.scheme == "file":  # a link is made by one writer only
                os.link(unquote(urlparse(fs.makeQualified(d).toString()).path), unquote(url.path))
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(d, p, options)  # fails if the target is there
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(d, False)

    # ---- reading

    def _declared(self, generations: tuple[str, ...]) -> str:
        """A name in the session's catalog for some generations: partitions of one bucketed table."""
        at = (self.spark.sparkContext.applicationId, self.path, generations)
        if at not in Table.declared:
            name, data = f"trawl_{uuid.uuid4().hex}", f"{self.path}/data".replace("\\", "\\\\").replace("'", "\\'")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, {GONE} boolean, {GENERATION} int) USING parquet PARTITIONED BY ({GENERATION}) "
                f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{data}'"
            )
            parts = " ".join(f"PARTITION ({GENERATION}={k}) LOCATION '{data}/{g}'" for k, g in enumerate(generations))
            self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
            Table.declared[at] = name
        return Table.declared[at]

    def _merged(self, generations: tuple[str, ...], whole: bool = True) -> DataFrame:
        """The newest row of each key; with ``whole`` without the deleted ones, which else stay as such."""
        if not generations:
            return self.spark.createDataFrame([], StructType(self.schema.fields)).withColumn(GONE, F.lit(False))
        rows = self.spark.table(self._declared(generations))
        if len(generations) > 1:
            rest = [c for c in (*self.columns, GONE) if c != self.key]
            newest = F.max_by(F.struct(*rest), GENERATION).alias("__row")
            rows = rows.groupBy(self.key).agg(newest).select(self.key, *[F.col("__row")[c].alias(c) for c in rest])
        rows = rows.select(*self.columns, GONE)
        return rows.where(~F.col(GONE)) if whole else rows

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; none if nothing was written."""
        return self._merged(self.version(number).generations).select(*self.columns)

    def reads(self, version: Version) -> DataFrame:
        return self._merged(version.generations).select(*self.columns)

    # ---- writing

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        """A generation's files, one for each bucket that has rows; its name and number of rows, counted while they are written."""
        name, seen = uuid.uuid4().hex, Observation()
        counted = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], GONE).observe(seen, F.count(F.lit(1)).alias("n"))
        dealt = counted.repartition(self.buckets, self.key)
        scratch = f"trawl_write_{name}"
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/data/{name}").saveAsTable(scratch)
        self.spark.sql(f"DROP TABLE {scratch}")  # the files stay
        return name, seen.get["n"]

    def _delete(self, generation: str) -> None:
        fs, p = self._fs(f"{self.path}/data/{generation}")
        fs.delete(p, True)

    def change(self, build: Callable[[DataFrame, Version], tuple[DataFrame | None, DataFrame | None]], extra: Callable[[Version], dict] | None = None, tries: int = 20) -> Version:
        """``build(what is stored, its version)`` → (rows to put, keys to delete, either may be None); published as the next version.

        If another writer comes first, ``build`` is called again over what that one stored.  Of rows with the same key
        in one change any may stay; a key that is put and deleted is put.
        """
        for _ in range(tries):
            before = self.version()
            put, gone = build(self.reads(before), before)
            parts = []
            if put is not None:
                parts.append(put.select(*self.columns).withColumn(GONE, F.lit(False)))
            if gone is not None:
                nulls = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in self.schema]
                keys = gone.select(self.key).distinct()
                parts.append((keys if put is None else keys.join(put.select(self.key), self.key, "left_anti")).select(*nulls).withColumn(GONE, F.lit(True)))
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            generation, n = self._write(rows)
            after = self._compacted(Version(before.number + 1, (*before.generations, generation), (*before.rows, n), json.dumps(extra(before)) if extra else before.extra))
            if self._publish(after):
                if generation not in after.generations:  # merged before anyone could see it
                    self._delete(generation)
                self._forget(after)
                return after
            for name in {generation, *after.generations} - set(before.generations):
                self._delete(name)
        raise Conflict(self.path)

    def upsert(self, rows: DataFrame) -> Version:
        return self.change(lambda *_: (rows, None))

    def delete(self, keys: DataFrame) -> Version:
        return self.change(lambda *_: (None, keys))

    def delete_where(self, condition: F.Column) -> Version:
        return self.change(lambda stored, _: (None, stored.where(condition).select(self.key)))

    def _compacted(self, version: Version) -> Version:
        if len(version.generations) <= MOST:
            return version
        first, rest = version.rows[0], sum(version.rows[1:])
        if 4 * rest >= first:
            merged = self._write(self._merged(version.generations))
            return Version(version.number, (merged[0],), (merged[1],), version.extra)
        merged = self._write(self._merged(version.generations[1:], whole=False))
        return Version(version.number, (version.generations[0], merged[0]), (first, merged[1]), version.extra)

    def _forget(self, now: Version) -> None:
        """Deletes versions older than the last ``KEPT``, and the generations that only they have."""
        old = [n for n in self.versions() if n <= now.number - KEPT]
        live = {g for n in self.versions() if n > now.number - KEPT for g in self.version(n).generations}
        for n in old:
            for g in set(self.version(n).generations) - live:
                self._delete(g)
            fs, p = self._fs(f"{self.path}/log/{n:012}.json")
            fs.delete(p, False)
