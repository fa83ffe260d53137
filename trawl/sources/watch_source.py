"""A folder of source files as a stream of events: added, changed and removed files, found by comparing listings.

An offset is the number of a listing, which is stored in a ``state`` folder that driver and executors share; so a batch
that is tried again compares the same two listings.  A new or rewritten file counts once its size and time are
the same in two listings at least ``stable`` milliseconds apart; a removed file counts at once, a renamed one is removed
and added.  Folders and files that a scan passes over are not entered.  With ``initial`` files that are there at the
first start are events, too.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.scope import glob_regex
from .files import IGNORED, LANGUAGES

SCHEMA = "path string, op string, ts timestamp, seq long"
Listing = dict[str, tuple[int, int]]  # path: size, time in microseconds


class Part(InputPartition):
    def __init__(self, start: int, end: int, part: int, parts: int):
        self.start, self.end, self.part, self.parts = start, end, part, parts


class Folder:
    """Files of a folder on any file system that Arrow reaches."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        self.root = self.root.rstrip("/")

    def listing(self) -> Listing:
        from pyarrow import fs

        passed_over = re.compile("|".join(map(glob_regex, IGNORED)))
        out: Listing = {}
        folders = [self.root]
        while folders:
            try:
                entries = self.fs.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True))
            except FileNotFoundError:  # went meanwhile
                continue
            for e in entries:
                path = e.path[len(self.root) + 1 :]
                if e.base_name.startswith(".") or passed_over.match(path + ("/x" if e.type == fs.FileType.Directory else "")):
                    continue
                if e.type == fs.FileType.Directory:
                    folders.append(e.path)
                elif e.type == fs.FileType.File and e.extension.lower() in LANGUAGES:
                    out[path] = (e.size, (e.mtime_ns or 0) // 1000)
        return out

    def numbers(self) -> list[int]:
        from pyarrow import fs

        names = [e.base_name for e in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def load(self, number: int) -> Listing:
        with self.fs.open_input_stream(f"{self.root}/{number}.json") as f:
            return {p: tuple(v) for p, v in json.loads(f.read()).items()}  # type: ignore[misc]

    def store(self, number: int, listing: Listing) -> None:
        """The file gets its name when it is whole."""
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(f"{self.root}/.{number}.part") as f:
            f.write(json.dumps(listing).encode())
        self.fs.move(f"{self.root}/.{number}.part", f"{self.root}/{number}.json")

    def drop(self, number: int) -> None:
        self.fs.delete_file(f"{self.root}/{number}.json")


def settled(before: Listing, now: Listing, known: Listing) -> Listing:
    """``known`` with the files of ``now`` that are the same in ``before``; those that change go on as they were known."""
    return {p: v if before.get(p) == v else known[p] for p, v in now.items() if before.get(p) == v or p in known}


def differences(old: Listing, new: Listing) -> Iterator[tuple[str, str, int | None]]:
    """(path, operation, time in microseconds; none for removed files)."""
    for path, value in new.items():
        if path not in old:
            yield path, "add", value[1]
        elif old[path] != value:
            yield path, "change", value[1]
    for path in old.keys() - new.keys():
        yield path, "unlink", None


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = Folder(options["path"]), Folder(options["state"])
        self.stable = int(options.get("stable", 100)) / 1000
        self.initial = str(options.get("initial", "false")).lower() == "true"
        self.parts = int(options.get("parts", 4))
        self.before: tuple[float, Listing] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": self.numbers()[0]}

    def numbers(self) -> list[int]:
        """The stored listings; the first one is taken when the stream starts for the first time."""
        if not self.state.numbers():
            self.state.store(0, {} if self.initial else self.root.listing())
        return self.state.numbers()

    def latestOffset(self) -> dict:  # noqa: N802
        last = self.numbers()[-1]
        now, at = self.root.listing(), time.monotonic()
        known = self.state.load(last)
        new = settled(self.before[1] if self.before and at - self.before[0] >= self.stable else {}, now, known)
        if self.before is None or at - self.before[0] >= self.stable:
            self.before = (at, now)
        if new == known:
            return {"listing": last}
        self.state.store(last + 1, new)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Part(start["listing"], end["listing"], k, self.parts) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:  # type: ignore[override]
        import datetime

        for path, op, at in differences(self.state.load(partition.start), self.state.load(partition.end)):
            if zlib.crc32(path.encode("utf-8", "surrogatepass")) % partition.parts == partition.part:
                when = time.time() if at is None else at / 1e6
                yield path, op, datetime.datetime.fromtimestamp(when, datetime.timezone.utc), partition.end

    def commit(self, end: dict) -> None:
        for number in self.state.numbers():
            if number < end["listing"]:
                self.state.drop(number)


class FileEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trawl_file_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # type: ignore[no-untyped-def]  # noqa: N802
        return Reader(dict(self.options))


def file_events(spark: SparkSession, root: str, state: str, stable_ms: int = 100, initial: bool = False) -> DataFrame:
    """The events of the source files under ``root``: path (relative), op (add, change or unlink), ts, seq."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("trawl_file_events").options(path=root, state=state, stable=str(max(stable_ms, 100)), initial=str(initial)).load()
