"""The library's entry points end to end: index a folder, search it, ask about it, update it, by tools and command line."""

import argparse
import json

import pytest
from pyspark.sql import functions as F

from trawl import cli, tools
from trawl.functions import text as T
from trawl.operators import chunking, codemap, maintain, storage
from trawl.plans import answer, indexing
from trawl.sources import files, limits, packs

SOURCES = {
    "src/pay.ts": "/** pays */\nexport function processPayment(order: Order, amount = 1): Receipt {\n  return charge(order, amount);\n}\n\nfunction charge(order, amount) {\n  return send('{' + amount);\n}\n",
    "src/user.py": "class User:\n    def login(self, name):\n        return check_password(name)\n\n\ndef check_password(name):\n    return name == 'x'\n",
    "docs/read.md": "# Payments\nHow a payment is charged.\n\n# Users\nHow users log in.\n",
    "lib/run.sh": "#!/bin/sh\nstart() {\n  echo '}' # }\n}\n",
    "node_modules/x.js": "function no() { return 1 }\n",
}


@pytest.fixture
def project(spark, tmp_path):
    for path, body in SOURCES.items():
        target = tmp_path / "in" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)
    return tools.Project(spark, str(tmp_path / "in"), str(tmp_path / "out"), answer.Echo(), limits=chunking.Limits(200, 1, 2000, 20), key=bytes(range(32)))


def test_index_search_ask_update(project, tmp_path):
    got = tools.dispatch(project, "index_project")
    assert got["success"] and got["added"] == got["chunks"] >= 6 and got["removed"] == 0
    found = tools.dispatch(project, "search_code", {"query": "process payment", "limit": 3, "lang": "typescript"})
    assert found["kind"] == "hybrid" and found["results"][0]["meta"]["symbol"] == "processPayment"
    assert found["results"][0]["meta"]["symbol_boost"] > 0 and all(0 <= r["meta"]["score"] <= 1 for r in found["results"])
    coded = tools.dispatch(project, "search_code_with_chunks", {"query": "process payment", "lang": "typescript"})["results"][0]
    assert "charge(order" in coded["code"] and not coded["truncated"] and coded["error"] is None
    assert tools.dispatch(project, "get_code_chunk", {"sha": coded["sha"]})["code"] == coded["code"]
    assert tools.dispatch(project, "get_code_chunk", {"sha": "none"}) == {"success": False, "code": None, "error": "not found"}
    overview = tools.dispatch(project, "search_code", {"query": " ? "})
    assert overview["kind"] == "overview" and {r["meta"]["score"] for r in overview["results"]} == {1.0}
    project.key = None
    assert tools.dispatch(project, "search_code_with_chunks", {"query": "process payment"})["results"][0]["error"] == "encrypted"
    project.key = bytes(range(32))
    project.chat = answer.Echo("It is [charged](src/pay.ts:2).")
    said = tools.dispatch(project, "ask_codebase", {"question": "how is a payment charged?"})
    assert said["success"] and "[charged](src/pay.ts:2)" in said["answer"] and said["issues"] == []
    message = project.chat.asked[0][-1]["content"]
    assert '<chunk path="docs/read.md"' in message and "<user_query>\nhow is a payment charged?" in message
    project.chat = answer.Echo('["payment", "user login"]', "done")
    assert tools.dispatch(project, "ask_codebase", {"question": "payments and users?", "multi_query": True})["queries"] == ["payment", "user login"]
    (tmp_path / "in" / "src" / "user.py").unlink()
    (tmp_path / "in" / "src" / "new.py").write_text("def added():\n    return 1\n")
    after = tools.dispatch(project, "update_project")
    assert after["added"] == 1 and after["removed"] == 3 and after["chunks"] == got["chunks"] - 2
    full = {r["id"] for r in indexing.index_files(files.scan(project.spark, project.root), project.limits)[0].collect()}
    assert {r["doc_id"] for r in project.index().chunks.collect()} == full
    stats = tools.dispatch(project, "get_project_stats")
    assert stats["chunks"] == after["chunks"] and stats["languages"]["python"] == 1 and len(stats["overview"]) == after["chunks"]
    assert project.index().symbols.count() == after["chunks"]


def test_arguments_are_checked(project):
    for tool, given in (("search_code", {"query": ""}), ("search_code", {"query": "x", "limit": 201}), ("get_code_chunk", {"sha": "x" * 65}), ("ask_codebase", {"question": "x", "temperature": 3}), ("use_context_pack", {}), ("nothing", {})):
        got = tools.dispatch(project, tool, given)
        assert not got["success"] and got["error"]
    assert tools.dispatch(project, "search_code", {"query": "x"}) == {"success": False, "error": "no_chunks_found", "kind": "error", "results": []}


def test_conversation(project):
    tools.dispatch(project, "index_project")
    index, talk, chat = project.index(), answer.Conversation(), answer.Echo("one", "two")
    first = answer.converse(project.spark, index, talk, "system: charge a payment", project.embed_query, chat, max_chunks=2)
    assert first.text == "one" and len(talk.turns) == 1 and talk.stats()["turns"] == 1
    second = answer.converse(project.spark, index, talk, "user login", project.embed_query, chat, max_chunks=1)
    assert second.chunks == 1 and [m["role"] for m in chat.asked[1]] == ["system", "user", "assistant", "user"]
    assert "SYSTEM (untrusted): charge" in chat.asked[1][1]["content"] and "# Discussed before" in chat.asked[1][-1]["content"]
    streamed = list(answer.answer_stream(project.spark, index, "charge", project.embed_query, answer.Echo("a\nb\n")))
    assert streamed == ["a\n", "b\n"]
    talk.known = {str(k): "f (s)" for k in range(200)}
    talk.remember("q", "a", [{"sha": "new", "path": "p", "symbol": "s"}])
    assert len(talk.known) == 200 and "0" not in talk.known and "new" in talk.known
    empty = answer.answer(project.spark, index, "x" * 6000, project.embed_query, chat)
    assert not empty.success and empty.error == "query_too_long" and "Unable to answer" in answer.formatted(empty)


def test_command_line(project, tmp_path):
    out = []
    run = lambda *argv, lines=(): cli.run(project, cli.parser().parse_args(argv), lines, out.append)
    assert run("index") == 0 and run("search", "payment", "--limit", "1") == 0
    assert len(json.loads(out[-1])["results"]) == 1
    assert run("search-with-code", "payment", "--max-code-size", "5") == 0 and all(len(r["code"]) <= 5 for r in json.loads(out[-1])["results"])
    assert run("chat", lines=["payment", "/history", "/stats", "/clear", "/help", "/quit", "never"]) == 0
    assert out[-4] == "1. payment" and "turns: 1" in out[-3] and out[-2] == "cleared" and "/exit" in out[-1]
    assert run("config", "set", "chat.model", "m") == 0 and run("config", "get", "chat.model") == 0 and json.loads(out[-1]) == "m"
    assert run("config", "unset", "chat.model") == 0 and json.loads(out[-1]) == {"chat": {}}
    (tmp_path / "out" / "py.json").write_text('{"scope": {"lang": ["python"]}}')
    assert run("context", "use", "py") == 0 and run("search", "payment user") == 0
    assert {r["lang"] for r in json.loads(out[-1])["results"]} == {"python"}
    assert run("tools", lines=['{"tool": "use_context_pack", "arguments": {"name": "clear"}}', '{"tool": "get_project_stats"}']) == 0
    assert json.loads(out[-1])["success"] and run("info") == 0
    assert isinstance(cli.parser().parse_args(["update"]), argparse.Namespace)


def test_changed_files_and_versions(spark, project, tmp_path):
    listed = spark.createDataFrame([("src/pay.ts",), ("src/gone.py",), ("../up.py",), ("a.txt",)], "path string")
    there, gone = files.scan_changed(spark, project.root, listed)
    assert [r["path"] for r in there.collect()] == ["src/pay.ts"] and [r["path"] for r in gone.collect()] == ["src/gone.py"]
    path = str(tmp_path / "t")
    for k in range(4):
        before = maintain.read_table(spark, path, "id long")
        maintain.replace_table(before.unionByName(spark.range(k, k + 1)), path)
    assert sorted(r["id"] for r in maintain.read_table(spark, path).collect()) == [0, 1, 2, 3] and maintain.versions(spark, path) == [2, 3]
    (tmp_path / "t" / "v4").mkdir()  # what a stopped writer leaves
    maintain.replace_table(spark.range(9), path)
    assert maintain.read_table(spark, path).count() == 9


def test_symbol_map_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": {"file": "f.ts", "sha": "s", "symbol": " ", "path_weight": -1, "success_rate": 7, "symbol_calls": ["x", " x ", ""]}, "": {"file": "g"}}))
    (tmp_path / "bad.json").write_text("nothing")
    got = codemap.import_json(spark, str(tmp_path / "m.json")).collect()
    assert [(r["chunk_id"], r["symbol"], r["path_weight"], r["success_rate"], r["symbol_calls"]) for r in got] == [("a", None, 0.0, 1.0, ["x"])]
    assert codemap.import_json(spark, str(tmp_path / "bad.json")).count() == 0
    assert codemap.read(spark, str(tmp_path / "none")).count() == 0
    codemap.write(codemap.import_json(spark, str(tmp_path / "m.json")), str(tmp_path / "map"))
    assert codemap.read(spark, str(tmp_path / "map")).first()["lang"] == "unknown"


def test_storage_survives_bad_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "sha string, code string")
    good = storage.write_blobs(rows, bytes(32)).collect()
    cut = bytearray(good[0]["payload"])
    cut[-1] ^= 1
    blobs = spark.createDataFrame([("a", bytes(cut), True), ("b", None, True), ("c", b"no gzip", False), ("d", b"short", True), ("e", bytes(good[1]["payload"][:20]), True)], "sha string, payload binary, encrypted boolean")
    got = {r["sha"]: r["error"] for r in storage.read_blobs(blobs, [bytes(32)]).collect()}
    assert got == {"a": "failed", "b": "missing", "c": "damaged", "d": "damaged", "e": "damaged"}


def test_parsers_see_no_strings_or_comments():
    limits_ = chunking.Limits(50, 1, 500, 5)
    symbols = lambda text, lang: [c["symbol"] for c in chunking.chunk_file("f", text, lang, limits_)]
    assert symbols(SOURCES["src/pay.ts"], "typescript") == ["processPayment", "charge"]
    assert symbols(SOURCES["lib/run.sh"], "bash") == ["start"]
    assert symbols("module A\n  def b\n    if x\n    end\n  end\nend\n", "ruby") == ["A", "b"]
    assert symbols("a { color: red }\n.b > c { d: e }\n", "css") == ["a", ".b > c"]
    assert symbols("let a = 1\n\nlet b x =\n  x\n", "ocaml") == ["a", "b"]
    assert symbols('<main id="m"><p>x</p></main>', "html") == ["m"]
    counts = chunking.Counter()
    list(chunking.chunk_file("f", SOURCES["src/pay.ts"], "typescript", limits_, counts))
    assert counts["nodes"] == counts["normal"] == 2


def test_model_limits_and_strategies(spark):
    limits_ = chunking.profile("TEXT-embedding-3-small")
    assert (limits_.optimal, limits_.largest) == (4000, 6000) and chunking.profile(None, "OpenAI") == limits_
    assert chunking.profile("text-embedding-3-large", max_tokens=1000) == chunking.Limits(820, 50, 950, 12)
    assert chunking.profile("unknown") == chunking.Limits(1600, 200, 1920, 120) and chunking.profile("gemini-embedding-001", count_tokens=False).largest == 7200
    lines = chunking.Strategy(parsers=(("toml", lambda t: [chunking.Node("line", x, t.index(x), t.index(x) + len(x)) for x in t.split("\n") if x]),), group=lambda sizes, flags, limits: [[k] for k in range(len(sizes))])
    assert [c["symbol"] for c in chunking.chunk_file("f", "a = 1\nb = 2", "toml", chunking.Limits(10, 1, 20, 2), strategy=lines)] == ["a = 1", "b = 2"]


def test_usage_log(project):
    from trawl.plans import search

    tools.dispatch(project, "index_project")
    found = search.search(project.spark, project.index(), "process payment", project.embed_query)
    row = search.usage(found, " The UserService? ").first()
    assert row["pattern"] == "the [SERVICE]" and row["query"] == "the userservice" and (row["target"] is None) == (found.results.first()["meta"]["score"] <= 0.8)
    assert search.usage(search.search(project.spark, project.index(), "", project.embed_query), "") is None


def test_rate_limits_and_batches():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    limiter = limits.RateLimiter(rpm=2, tpm=100, clock=lambda: now[0], sleep=sleep)
    for tokens in (60, 30):
        assert limiter.run(lambda: 1, tokens) == 1
    assert limiter.used() == (2, 90) and slept == []
    now[0] = 10.0
    limiter.run(lambda: 1, 50)
    assert slept == [50.0] and limiter.used() == (1, 50)  # what is exactly a minute old no longer counts
    tries = []

    def refuse():
        tries.append(1)
        raise limits.TooManyRequests

    with pytest.raises(limits.TooManyRequests):
        limits.RateLimiter(clock=lambda: now[0], sleep=sleep).run(refuse)
    assert len(tries) == 5 and slept[-4:] == [1, 2, 5, 10]
    assert limits.RateLimiter(rpm=10, tpm=None).shared(4).rpm == 2
    assert limits.token_batches(["a" * 6, "b" * 5, "c" * 4], len, 10, 8) == [[0], [1, 2]]
    with pytest.raises(ValueError):
        limits.token_batches(["a" * 9], len, 10, 8)
    sent = []
    provider = packs.RemoteProvider("r", 1, lambda texts: sent.append(texts) or [[float(len(t))] for t in texts], max_chars=3, budget=1)
    assert provider.vectors(["abcd", "e"]) == [[3.0], [1.0]] and sent == [["abc"], ["e"]]


def test_cache_cases(spark):
    def state(rows, **options):
        log = spark.createDataFrame([(k, op, f"2024-01-01 00:00:{n:02d}", n) for n, (op, k) in enumerate(rows)], "key string, op string, ts string, seq int").withColumn("ts", F.col("ts").cast("timestamp"))
        return {r["key"] for r in maintain.cached(log, 2, **options).collect()}

    assert state([("set", "a"), ("set", "b"), ("get", "a"), ("set", "c")]) == {"a", "c"}
    assert state([("set", "a"), ("set", "b"), ("peek", "a"), ("set", "c")]) == {"b", "c"}
    assert state([("set", "a")], ttl_ms=20, now="2024-01-01 00:00:01") == set()


def test_settings_in_layers(tmp_path):
    (tmp_path / "g.json").write_text('{"chat": {"model": "g", "max_tokens": 9999999}, "a": {"b": 1}}')
    (tmp_path / "p.json").write_text('{"chat": {"model": "p"}}')
    got = packs.settings({"a": {"c": 2}}, tmp_path / "g.json", tmp_path / "p.json", tmp_path / "none", environ={"TRAWL_CHAT_MODEL": "e", "OTHER": "x"})
    assert got == {"a": {"b": 1, "c": 2}, "chat": {"model": "e", "max_tokens": 256_000}}


def test_metadata_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    got = one(T.signature(F.lit("f"), F.lit("function f(a, *b = g(1), &c) -> int {"), F.lit("function")))
    assert (got["signature"], got["parameters"], got["returns"]) == ("f(a, b, c) : int", ["a", "b", "c"], "int")
    assert one(T.signature(F.lit("f"), F.lit("no list"), F.lit("x")))["signature"] == "f()"
    assert one(T.is_important_variable(F.lit("const ABC"))) and not one(T.is_important_variable(F.lit("const ab = 1"))) and one(T.is_important_variable(F.lit("static FOO")))
    assert one(T.complete_part(F.lit("a { b } c;\nd"))) == "a { b }" and one(T.complete_part(F.lit("a; b"))) == "a;" and one(T.complete_part(F.lit("ab"))) == "ab"
    assert one(T.lines_before(F.lit("a\nb\nc\nd"), F.lit(6), 2)) == "b\nc"
    assert one(T.from_json_list(F.lit('["a"]'))) == ["a"] and one(T.from_json_list(F.lit("x"))) is None
    assert one(T.sanitize_code(F.lit(" x" * 3000))).endswith("\n// ... [truncated]")
    assert one(T.redact(F.lit("npm_token = abc; x"))) == "NPM_TOKEN=[REDACTED]; x"
