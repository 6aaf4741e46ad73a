"""Front ends of the engine: named tools, HTTP on top of them, JSON-RPC over lines, and a command line.

All of them go through `Service.call`, which applies one tool at a time and swaps the engine for the one
behind it. They are for single operations; analytics read the folded tables.
"""

from __future__ import annotations

import argparse
import base64
import hmac
import json
import re
import sys
import threading
from collections import Counter
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import IO
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import SparkSession

from .engine import Engine, EngineError
from .plans.cursor import CursorError
from .plans.search import Filters, SearchQuery
from .sources.config import parse_policy

#: HTTP status by error code.
STATUS = {"invalid": 400, "unauthorized": 401, "forbidden": 403, "namespace_not_found": 404, "not_found": 404, "conflict": 409, "quota": 507}


def _condition(args: dict, default: str = "any") -> str:
    if args.get("if_absent"):
        return "absent"
    return str(args["if_revision"]) if args.get("if_revision") is not None else default


def _filters(args: dict) -> Filters:
    return Filters(args.get("topic"), args.get("tag"), args.get("since_ms"), args.get("until_ms"))


def _shown(row: dict) -> dict:
    """A row as JSON: values as their JSON, or in base 64."""
    if isinstance(row.get("value"), (bytes, bytearray)):
        raw = bytes(row["value"])
        try:
            row = row | {"value": json.loads(raw)}
        except ValueError:
            row = row | {"value": {"encoding": "base64", "data": base64.b64encode(raw).decode()}}
    return row


def _page(found: tuple[list[dict], str | None]) -> dict:
    return {"items": [_shown(r) for r in found[0]], "next_cursor": found[1]}


def _remember(e: Engine, a: dict) -> tuple[Engine, dict]:
    return e.remember(a["namespace"], a.get("key"), a["content"], a["topic"], a.get("tags"), a.get("metadata"), a.get("occurred_at_ms"), a.get("ttl_seconds"), _condition(a, "absent"))


def _put(e: Engine, a: dict) -> tuple[Engine, dict]:
    return e.put(a["namespace"], a["key"], json.dumps(a["value"], ensure_ascii=False).encode(), a.get("ttl_seconds"), _condition(a))


def _search(e: Engine, a: dict) -> dict:
    query = SearchQuery(a["query"], _filters(a), a.get("limit", 20), tuple(a.get("expansion_terms", ())), a.get("expand", False))
    return _page(e.search(a["namespace"], query, a.get("cursor"), a.get("max_bytes")))


def _recall(e: Engine, a: dict) -> dict:
    return _page(e.recall(a["namespace"], _filters(a), a.get("query", ""), a.get("limit", 20), a.get("cursor"), a.get("max_bytes")))


def _checkpoint(e: Engine, a: dict) -> tuple[Engine, dict]:
    c = a["checkpoint"]
    return e.checkpoint(a["namespace"], c["id"], c["agent_id"], c["session_id"], c["capsule"], c.get("references", ()), c.get("expected_revision"))


def _restore(e: Engine, a: dict) -> dict:
    budget = a.get("max_bytes", 32_768)
    if a.get("checkpoint_id"):
        return e.restore(a["namespace"], a["checkpoint_id"], budget)
    return e.restore_latest(a["namespace"], a["agent_id"], a["session_id"], budget)


#: Tools that change the engine give the one behind them and a result.
WRITES: dict[str, Callable[[Engine, dict], tuple[Engine, dict]]] = {
    "remember": _remember,
    "forget": lambda e, a: (e.forget(a["namespace"], a["key"], _condition(a))[0], {"forgotten": True}),
    "memory_put": _put,
    "memory_delete": lambda e, a: (e.delete(a["namespace"], a["key"], _condition(a))[0], {"deleted": True}),
    "memory_checkpoint": _checkpoint,
    "memory_delete_checkpoint": lambda e, a: (e.delete_checkpoint(a["namespace"], a["checkpoint_id"]), {"deleted": True}),
}
READS: dict[str, Callable[[Engine, dict], dict]] = {
    "recall": _recall,
    "browse": _recall,
    "search": _search,
    "memory_get": lambda e, a: _shown(e.get(a["namespace"], a["key"])),
    "memory_read": lambda e, a: e.memory_get(a["namespace"], a["key"]),
    "memory_list": lambda e, a: _page(e.list(a["namespace"], a.get("prefix", ""), a.get("cursor"), a.get("limit", 100))),
    "memory_restore": _restore,
    "stats": lambda e, a: e.usage(a["namespace"]),
}


class Service:
    """One engine for many callers: writes one after another, reads on what is there."""

    def __init__(self, engine: Engine, tokens: dict[str, str] | None = None, clock: Callable[[], int] | None = None):
        self.engine, self.tokens, self.clock = engine, tokens, clock
        self.lock, self.counts = threading.Lock(), Counter()

    def principal(self, token: str | None) -> str | None:
        """Whose token it is; without tokens every caller may do everything."""
        if self.tokens is None:
            return None
        for known, name in self.tokens.items():
            if token is not None and hmac.compare_digest(known.encode(), token.encode()):
                return name
        raise EngineError("unauthorized", "a bearer token is needed")

    def call(self, tool: str, args: dict, principal: str | None = None) -> dict:
        self.counts["requests"] += 1
        try:
            return self._call(tool, args, principal)
        except (EngineError, CursorError, ValueError, KeyError, TypeError) as error:
            self.counts["failures"] += 1
            if isinstance(error, EngineError):
                raise
            raise EngineError("invalid", f"missing {error}" if isinstance(error, KeyError) else str(error)) from error

    def _call(self, tool: str, args: dict, principal: str | None) -> dict:
        changed = {"principal": principal} | ({"now_ms": self.clock()} if self.clock else {})
        if tool in READS:
            return READS[tool](self.engine._with(**changed), args)
        if tool not in WRITES:
            raise EngineError("not_found", f"no tool {tool}")
        with self.lock:
            after, result = WRITES[tool](self.engine._with(**changed), args)
            self.engine = after._with(principal=None)
        return result


# ---------------------------------------------------------------- HTTP

_NS = r"/v1/namespaces/(?P<namespace>[^/]+)"
#: Method, path, tool. The rest of a path is a key, with its slashes.
ROUTES = tuple(
    (method, re.compile(f"{_NS}{path}"), tool)
    for method, path, tool in (
        ("GET", "/records", "memory_list"),
        ("GET", "/records/(?P<key>.+)", "memory_get"),
        ("PUT", "/records/(?P<key>.+)", "memory_put"),
        ("DELETE", "/records/(?P<key>.+)", "memory_delete"),
        ("GET", "/memories", "recall"),
        ("POST", "/memories", "remember"),
        ("GET", "/memories/(?P<key>.+)", "memory_read"),
        ("DELETE", "/memories/(?P<key>.+)", "forget"),
        ("POST", "/search", "search"),
        ("GET", "/stats", "stats"),
        ("POST", "/checkpoints", "memory_checkpoint"),
        ("GET", "/checkpoints/(?P<checkpoint_id>[^/]+)", "memory_restore"),
        ("DELETE", "/checkpoints/(?P<checkpoint_id>[^/]+)", "memory_delete_checkpoint"),
        ("GET", "/sessions/(?P<agent_id>[^/]+)/(?P<session_id>[^/]+)/latest", "memory_restore"),
    )
)
MAX_BODY = 1 << 20
_NUMBERS = ("since_ms", "until_ms", "limit", "max_bytes", "ttl_seconds", "if_revision")


def route(method: str, target: str, body: bytes) -> tuple[str, dict]:
    """The tool of a request and its arguments: from the path, the query and the body."""
    url = urlsplit(target)
    for verb, pattern, tool in ROUTES:
        if verb == method and (m := pattern.fullmatch(url.path)):
            args = {k: unquote(v) for k, v in m.groupdict().items()}
            args |= {k: int(v) if k in _NUMBERS else v == "true" if k == "if_absent" else v for k, v in parse_qsl(url.query)}
            if tool == "memory_put":
                return tool, args | {"value": json.loads(body)}
            if tool == "memory_checkpoint":
                return tool, args | {"checkpoint": json.loads(body)}
            return tool, args | (json.loads(body) if body else {})
    raise EngineError("not_found", "no such route")


def server(service: Service, port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server on the loopback; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_request(self) -> None:
            try:
                if self.path == "/healthz":
                    return self.answer(200, {"status": "ok"})
                given = self.headers.get("Authorization", "")
                who = service.principal(given.removeprefix("Bearer ") if given.startswith("Bearer ") else None)
                if self.path == "/metrics":
                    return self.answer(200, dict(service.counts))
                size = int(self.headers.get("Content-Length") or 0)
                if not 0 <= size <= MAX_BODY:
                    raise EngineError("invalid", "the body is too large")
                tool, args = route(self.command, self.path, self.rfile.read(size))
                self.answer(200, service.call(tool, args, who))
            except EngineError as error:
                self.answer(STATUS.get(error.code, 503), {"error": {"code": error.code, "message": str(error)}})
            except ValueError as error:  # a body that is no JSON, a number that is none
                self.answer(400, {"error": {"code": "invalid", "message": str(error)}})

        do_GET = do_PUT = do_POST = do_DELETE = handle_request

        def log_message(self, *_):
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


# ---------------------------------------------------------------- JSON-RPC over lines


def lines(service: Service, source: Iterable[str], out: IO[str]) -> None:
    """Answers requests, one a line: initialize, tools/list and tools/call."""
    for text in source:
        if not text.strip():
            continue
        try:
            request = json.loads(text)
        except ValueError:
            request = {"method": None}
        if "id" not in request and request.get("method") is not None:
            continue  # a notice wants no answer
        reply: dict = {"jsonrpc": "2.0", "id": request.get("id")}
        params = request.get("params") or {}
        if request.get("method") == "initialize":
            reply["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "memloom", "version": "1"}}
        elif request.get("method") == "tools/list":
            reply["result"] = {"tools": [{"name": n, "inputSchema": {"type": "object"}} for n in [*WRITES, *READS]]}
        elif request.get("method") == "tools/call":
            try:
                value, failed = service.call(params.get("name"), params.get("arguments") or {}), False
            except EngineError as error:
                value, failed = {"code": error.code, "message": str(error)}, True
            reply["result"] = {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False, default=str)}], "isError": failed}
        else:
            reply["error"] = {"code": -32601, "message": "unknown method"}
        out.write(json.dumps(reply, ensure_ascii=False) + "\n")
        out.flush()


# ---------------------------------------------------------------- command line


def opened(spark: SparkSession, policy: str, data: str, now_ms: int) -> Engine:
    """An engine over the log and the checkpoints kept in a folder."""
    tables = {}
    for name, schema in (("log", Engine.LOG), ("saves", Engine.SAVES)):
        folder = Path(data) / name
        tables[name] = spark.read.schema(schema).parquet(str(folder)) if folder.exists() else spark.createDataFrame([], schema)
    gone = Path(data) / "pruned.json"
    pruned = tuple(map(tuple, json.loads(gone.read_text()))) if gone.exists() else ()
    return Engine(spark, parse_policy(Path(policy).read_text()), tables["log"], now_ms, saves=tables["saves"], pruned=pruned)


def keep(before: Engine, after: Engine, data: str) -> None:
    """Appends what an operation added to the folder's tables; dropped checkpoints are named in a file."""
    if len(after.added) > len(before.added):
        after.spark.createDataFrame(list(after.added[len(before.added) :]), Engine.LOG).coalesce(1).write.mode("append").parquet(f"{data}/log")
    new = after.saves.count() - before.saves.count()
    if new > 0:
        after.saves.join(before.saves, ["namespace", "seq"], "left_anti").coalesce(1).write.mode("append").parquet(f"{data}/saves")
    if after.pruned != before.pruned:
        (Path(data) / "pruned.json").write_text(json.dumps(after.pruned))


def main(argv: list[str], spark: SparkSession | None = None, out: IO[str] = sys.stdout, source: Iterable[str] = sys.stdin) -> int:
    """`TOOL '{"namespace": ...}'`, `serve`, `lines` or `check-config` over a policy file and a folder."""
    parser = argparse.ArgumentParser(prog="memloom")
    parser.add_argument("command", choices=[*WRITES, *READS, "serve", "lines", "check-config"])
    parser.add_argument("arguments", nargs="?", default="{}")
    parser.add_argument("--policy", required=True)
    parser.add_argument("--data", default=".")
    parser.add_argument("--now-ms", type=int, default=None)
    parser.add_argument("--port", type=int, default=0)
    args = parser.parse_args(argv)
    if args.command == "check-config":
        parse_policy(Path(args.policy).read_text())
        out.write("ok\n")
        return 0
    import time

    clock = (lambda: args.now_ms) if args.now_ms is not None else lambda: int(time.time() * 1000)
    spark = spark or SparkSession.builder.appName("memloom").getOrCreate()
    before = opened(spark, args.policy, args.data, clock())
    service = Service(before, clock=clock)
    if args.command == "serve":
        listener = server(service, args.port)
        out.write(f"http://127.0.0.1:{listener.server_address[1]}\n")
        try:
            listener.serve_forever()
        except KeyboardInterrupt:
            listener.server_close()
    elif args.command == "lines":
        lines(service, source, out)
    else:
        try:
            out.write(json.dumps(service.call(args.command, json.loads(args.arguments)), ensure_ascii=False, default=str) + "\n")
        except EngineError as error:
            out.write(json.dumps({"error": error.code, "message": str(error)}) + "\n")
            return 1
    keep(before, service.engine, args.data)
    return 0
