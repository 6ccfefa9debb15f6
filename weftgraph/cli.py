"""Command line: python -m weftgraph.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from weftgraph.plans.agent import Agent
from weftgraph.plans.engine import Engine

HELP = "explore NAME, connect A to B, stats, quit, or a question"


def chat_line(engine: Engine, line: str) -> str | None:
    """The reply to a line of the chat; None ends it."""
    line = line.strip()
    if line.lower() in ("quit", "exit", "q"):
        return None
    if not line:
        return HELP
    if line.lower().startswith("explore "):
        found = engine.explore(line[8:].strip())
        return found["context_summary"] if found["found"] else found["message"]
    if line.lower().startswith("connect "):
        ends = line[8:].split(" to ")
        return engine.find_connections(*map(str.strip, ends))["description"] if len(ends) == 2 else "connect A to B"
    if line.lower() == "stats":
        return json.dumps(engine.statistics(), default=str)
    found = engine.ask(line)
    return f"{found['answer']}\n(confidence {found['confidence']})"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    p.add_argument("store", help="folder of the graph's tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "ingest": ("folder",), "preview": ("folder",), "ask": ("question",), "agent": ("question",), "explore": ("name",),
        "connect": ("a", "b"), "model": ("name",), "compare": ("a", "b"), "sql": ("statement",), "status": (), "retry": (),
        "reset": (), "stats": (), "chat": (), "clear": (), "prepare": (), "query": ("question",),
    }.items():
        command = sub.add_parser(name)
        for a in arguments:
            command.add_argument(a)
        if name in ("ingest", "status", "retry", "reset"):
            command.add_argument("--job", default="default")
        if name == "ingest":
            command.add_argument("--restart", action="store_true")
        if name == "clear":
            command.add_argument("--yes", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(spark or SparkSession.builder.appName("weftgraph").getOrCreate(), a.store)
    run = {
        "ingest": lambda: engine.ingest(a.folder, a.job, resume=not a.restart, on_progress=lambda line: print(line, file=sys.stderr)),
        "prepare": engine.prepare, "query": lambda: engine.query(a.question), "preview": lambda: engine.preview(a.folder),
        "ask": lambda: engine.ask(a.question), "agent": lambda: Agent(engine).ask(a.question), "explore": lambda: engine.explore(a.name),
        "connect": lambda: engine.find_connections(a.a, a.b), "model": lambda: engine.model_info(a.name),
        "compare": lambda: engine.compare_models(a.a, a.b), "sql": lambda: engine.execute_sql(a.statement),
        "status": lambda: engine.ingest_status(a.job), "retry": lambda: engine.retry_failed(a.job), "reset": lambda: engine.reset_job(a.job),
        "stats": engine.statistics, "clear": lambda: engine.clear(a.yes),
    }
    if a.command == "chat":
        for line in sys.stdin:
            if (said := chat_line(engine, line)) is None:
                break
            print(said, flush=True)
        return 0
    out = run[a.command]()
    print(out if isinstance(out, str) else json.dumps(out, default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
