"""python -m quillspark.cli init|serve|capabilities|export|import|stats|bench"""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from quillspark import session
from quillspark.models import tier_of
from quillspark.sources import exchange
from quillspark.sources.collection import Collection
from quillspark.tools import Tools

LIBRARIES = ("numpy", "pandas", "pyarrow", "tokenizers", "tiktoken", "sentencepiece", "onnxruntime")


def capabilities(spark) -> dict:
    """What this installation can do: versions, cores, memory, libraries, tier."""
    cores = spark.sparkContext.defaultParallelism
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    tier = spark.range(1).select(tier_of(F.lit(memory), F.lit(cores), F.lit(False))).first()[0]
    return {"spark": spark.version, "master": spark.sparkContext.master, "cores": cores, "memory_gb": round(memory, 1), "tier": tier, "libraries": {n: importlib.util.find_spec(n) is not None for n in LIBRARIES}}


def serve(tools: Tools, lines: Iterable[str]) -> Iterator[str]:
    """A line of JSON for each line of {"tool", "params"}: {"result"} or {"error"}; blank lines are passed over."""
    for line in lines:
        if not line.strip():
            continue
        try:
            call = json.loads(line)
            yield json.dumps({"result": tools.execute(call["tool"], call.get("params") or {})}, default=str)
        except Exception as e:
            yield json.dumps({"error": {"code": getattr(e, "code", type(e).__name__), "message": str(e)}})


def http_server(tools: Tools, port: int = 0) -> ThreadingHTTPServer:
    """A server on this machine alone: GET lists the tools, POST takes what a line of serve() is."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: str) -> None:
            raw = body.encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._send(json.dumps([{"name": t.name, "description": t.description, "schema": t.schema} for t in tools.tools.values()]))

        def do_POST(self) -> None:
            line = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            self._send(next(serve(tools, [line]), "{}"))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("capabilities")
    for name in ("init", "serve", "export", "import", "stats"):
        p = commands.add_parser(name)
        p.add_argument("collection")
        p.add_argument("--dimensions", type=int, required=True)
        if name in ("export", "import"):
            p.add_argument("path")
        if name == "serve":
            p.add_argument("--port", type=int, help="over HTTP rather than lines")
        if name == "export":
            p.add_argument("--format", choices=("ndjson", "json"), default="ndjson")
            p.add_argument("--chunk", type=int, default=100)
        if name == "import":
            p.add_argument("--keep", action="store_true", help="add to the rows that are there")
    bench = commands.add_parser("bench")
    bench.add_argument("--scale", default="1k,10k")
    args = parser.parse_args(argv)
    spark = session.create()
    if args.command == "bench":
        from quillspark.operators.vector_bench import run

        for row in run(spark, args.scale):
            print(json.dumps(row))
        return 0
    if args.command == "capabilities":
        print(json.dumps(capabilities(spark)))
        return 0
    held = Collection(spark, args.collection, args.dimensions)
    if args.command == "init":
        if held._versions():
            print(f"{args.collection} is a collection already", file=sys.stderr)
            return 1
        held.clear()
        return 0
    if args.command == "serve":
        if args.port is not None:
            http_server(Tools(held), args.port).serve_forever()
        for line in serve(Tools(held), sys.stdin):
            print(line, flush=True)
        return 0
    if args.command == "export":
        if args.format == "json":
            exchange.export_json(held.rows(), args.path)
        else:
            exchange.export_ndjson(held.rows(), args.path, args.chunk)
    elif args.command == "import":
        print(exchange.import_into(held, args.path, clear=not args.keep))
    else:
        print(held.stats().first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
