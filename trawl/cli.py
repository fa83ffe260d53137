"""The command line: ``python -m trawl.cli index|update|watch|search|search-with-code|ask|chat|info|context|config|tools``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from .plans import answer as A
from .sources import files, packs
from .streaming import watch
from .tools import Project, dispatch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trawl")
    top.add_argument("--root", default=".", help="folder of sources")
    top.add_argument("--index", default=None, help="folder of the index (default: ROOT/.trawl)")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("index", "update", "info", "watch"):
        sub.add_parser(name)
    for name in ("search", "search-with-code", "ask"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--limit", type=int, default=10)
        p.add_argument("--path-glob", action="append")
        p.add_argument("--tags", action="append")
        p.add_argument("--lang", action="append")
        p.add_argument("--max-code-size", type=int, default=100_000)
        p.add_argument("--multi-query", action="store_true")
        p.add_argument("--no-metadata", action="store_true")
    sub.add_parser("chat")
    context = sub.add_parser("context")
    context.add_argument("action", choices=["list", "show", "use"])
    context.add_argument("name", nargs="?")
    config = sub.add_parser("config")
    config.add_argument("action", choices=["init", "set", "get", "list", "unset", "path"])
    config.add_argument("key", nargs="?", help="section.name")
    config.add_argument("value", nargs="?")
    sub.add_parser("tools", help="reads {tool, arguments} a line, writes results a line")
    return top


def chat_command(session: A.Conversation, line: str) -> str | None:
    """What a line that starts with a slash does; None ends the chat."""
    word = line.split()[0]
    if word in ("/exit", "/quit", "/q"):
        return None
    if word == "/clear":
        session.clear()
        return "cleared"
    if word == "/history":
        return "\n".join(f"{k + 1}. {q}" for k, (q, _, _) in enumerate(session.turns)) or "nothing yet"
    if word == "/stats":
        return ", ".join(f"{k}: {v}" for k, v in session.stats().items())
    return "/exit /quit /q /clear /history /stats /help"


def chat(project: Project, lines: Iterable[str], say: Callable[[str], None]) -> None:
    session = A.Conversation()
    for line in map(str.strip, lines):
        if line.startswith("/"):
            reply = chat_command(session, line)
            if reply is None:
                return
            say(reply)
        elif line:
            say("".join(A.converse_stream(project.spark, project.index(), session, line, project.embed_query, project.chat or A.Echo())))


def settings_command(path: str, action: str, key: str | None, value: str | None) -> str:
    section, _, name = (key or "").partition(".")
    if action == "path":
        return path
    if action in ("get", "list"):
        now = packs.settings({}, path, environ=dict(os.environ))
        return json.dumps(now if action == "list" or not key else now.get(section, {}).get(name) if name else now.get(section), indent=2, sort_keys=True)
    changes: dict = {} if action == "init" else {section: {name: value if action == "set" else None}} if name else {section: value if action == "set" else None}
    return json.dumps(packs.save_settings(path, changes), indent=2, sort_keys=True)


def run(project: Project, args: argparse.Namespace, lines: Iterable[str], say: Callable[[str], None]) -> int:
    show = lambda out: say(json.dumps(out, indent=2, default=str))
    given = {k: v for k, v in vars(args).items() if k in ("path_glob", "tags", "lang") and v}
    if args.command in ("index", "update"):
        show(out := dispatch(project, f"{args.command}_project"))
    elif args.command == "info":
        show(out := dispatch(project, "get_project_stats"))
    elif args.command == "search":
        show(out := dispatch(project, "search_code", {"query": args.query, "limit": args.limit, **given}))
    elif args.command == "search-with-code":
        out = dispatch(project, "search_code_with_chunks", {"query": args.query, "limit": args.limit, **given})
        for r in out.get("results", []):
            r["truncated"] = r.get("truncated") or len(r.get("code") or "") > args.max_code_size
            r["code"] = (r.get("code") or "")[: args.max_code_size]
        show(out)
    elif args.command == "ask":
        out = dispatch(project, "ask_codebase", {"question": args.query, "max_chunks": args.limit, "multi_query": args.multi_query, **given})
        say(out["answer"] if out.get("answer") else json.dumps(out))
    elif args.command == "chat":
        chat(project, lines, say)
        out = {"success": True}
    elif args.command == "context":
        out = {"success": True}
        if args.action == "list":
            show(packs.list_packs(project.out))
        elif args.action == "show":
            show(packs.load_pack(project.out, args.name) if args.name else packs.active(project.out))
        else:
            packs.set_active(project.out, args.name or "none")
    elif args.command == "config":
        say(settings_command(os.path.join(project.out, "settings.json"), args.action, args.key, args.value))
        out = {"success": True}
    elif args.command == "tools":
        for line in lines:
            if line.strip():
                call = json.loads(line)
                say(json.dumps(dispatch(project, call.get("tool", ""), call.get("arguments")), default=str))
        out = {"success": True}
    else:
        stream = files.watch(project.spark, project.root).selectExpr("path", "op", "ts", "unix_micros(ts) AS seq")
        watch.run(stream, lambda batch, n: show(dispatch(project, "update_project")), f"{project.out}/watch", available_now=False).awaitTermination()
        out = {"success": True}
    return 0 if out.get("success") else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("trawl").getOrCreate()
    out = args.index or os.path.join(args.root, ".trawl")
    return run(Project(spark, args.root, out), args, sys.stdin, print)


if __name__ == "__main__":
    raise SystemExit(main())
