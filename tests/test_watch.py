"""The watch service: file events from listings, debouncing by timers, batches applied once, and an index that follows."""

import os
import time

from pyspark.sql import functions as F

from trawl import tools
from trawl.operators import chunking
from trawl.plans import indexing
from trawl.sources import watch_source
from trawl.streaming import watch


def write(root, path, body):
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w") as f:
        f.write(body)


def wait_for(query, what, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not what():
        if query.exception():
            raise query.exception()
        time.sleep(0.2)
    assert what()


def test_listings_and_what_settles(tmp_path):
    for p in ("a.py", "d/b.ts", "node_modules/x.js", ".git/c.py", "n.txt", "d/.h.py"):
        write(str(tmp_path), p, p)
    folder = watch_source.Folder(str(tmp_path))
    listing = folder.listing()
    assert set(listing) == {"a.py", "d/b.ts"}
    v = {"x": (1, 1), "y": (2, 2), "gone": (3, 3)}
    now = {"x": (1, 1), "y": (9, 9), "new": (4, 4), "fresh": (5, 5)}
    assert watch_source.settled({"new": (4, 4), "y": (8, 8)}, now, v) == {"x": (1, 1), "y": (2, 2), "new": (4, 4)}
    assert sorted(watch_source.differences(v, {"x": (1, 1), "y": (9, 9), "new": (4, 4)})) == [("gone", "unlink", None), ("new", "add", 4), ("y", "change", 9)]
    state = watch_source.Folder(str(tmp_path / "state"))
    state.store(3, v)
    assert state.numbers() == [3] and state.load(3) == v


def test_events_reach_the_index(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, "src/a.py", "def first():\n    return 1\n")
    write(root, "src/b.py", "def second():\n    return 2\n")
    project = tools.Project(spark, root, out, limits=chunking.Limits(200, 1, 2000, 20))
    tools.index_project(project)
    events = watch_source.file_events(spark, root, str(tmp_path / "state")).withColumn("repo", F.lit("r"))
    seen = []

    def update(batch, number):
        ops = {(r["path"], r["op"]) for r in batch.collect()}
        indexing.update_paths(spark, root, out, batch.select("path", "op"), project.limits, project.embed_chunks)
        seen.append((number, ops))

    query = watch.flushes(events, update, str(tmp_path / "ck"), silence_ms=300)
    try:
        wait_for(query, lambda: query.lastProgress is not None)
        time.sleep(1)
        write(root, "src/c.py", "def third():\n    return 3\n")
        os.rename(os.path.join(root, "src/a.py"), os.path.join(root, "src/moved.py"))
        os.unlink(os.path.join(root, "src/b.py"))
        want = {("src/c.py", "upsert"), ("src/moved.py", "upsert"), ("src/a.py", "delete"), ("src/b.py", "delete")}
        wait_for(query, lambda: set().union(*(o for _, o in seen)) >= want)
    finally:
        query.stop()
    assert {r["file_path"] for r in indexing.Tables(spark, out).chunks.read().collect()} == {"src/c.py", "src/moved.py"}
    numbers = [n for n, _ in seen]
    assert len(numbers) == len(set(numbers))
    applied = []
    again = watch.once(spark, str(tmp_path / "ck/applied"), lambda b, n: applied.append(n))
    again(spark.range(1), numbers[0])
    again(spark.range(1), 10_000)
    assert applied == [10_000]  # a finished batch is passed over


def test_silence_restarts_the_wait(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    schema = "repo string, path string, op string, ts timestamp, seq long"

    def send(name, *rows):
        lines = [f'{{"repo": "{repo}", "path": "{p}", "op": "{op}", "ts": "2024-01-01T00:00:{s:02}Z", "seq": {s}}}' for repo, p, op, s in rows]
        (tmp_path / name).write_text("\n".join(lines))
        os.rename(tmp_path / name, source / name)

    got = []
    events = spark.readStream.schema(schema).json(str(source))
    progress = watch.Progress()
    spark.streams.addListener(progress)
    query = watch.flushes(events, lambda b, n: got.append((time.time(), {(r["repo"], r["path"], r["op"]) for r in b.collect()})), str(tmp_path / "ck"), silence_ms=15_000)
    try:
        send("1.json", ("r", "x.py", "add", 1), ("r", "y.py", "change", 2), ("s", "z.py", "add", 1), ("r", "no.txt", "add", 3))
        wait_for(query, lambda: any(p["numInputRows"] for p in query.recentProgress))
        begun = time.time()
        send("2.json", ("r", "x.py", "unlink", 5), ("r", "y.py", "unlink", 1))  # the second one is late
        wait_for(query, lambda: sum(len(o) for _, o in got) >= 3)
    finally:
        query.stop()
    spark.streams.removeListener(progress)
    assert progress.rows == 6 and progress.seconds > 0 and progress.left(12) == 2 * progress.left(6) and not progress.failed
    assert watch.Progress().left(1) is None
    flushed = {e: at for at, events_ in got for e in events_}
    assert set(flushed) == {("r", "x.py", "delete"), ("r", "y.py", "upsert"), ("s", "z.py", "upsert")}
    assert flushed["r", "x.py", "delete"] - begun > 10 and flushed["r", "x.py", "delete"] == flushed["r", "y.py", "upsert"]
