"""Tools, HTTP on the loopback, JSON-RPC lines and the command line."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from memloom import frontend
from memloom.engine import Engine, EngineError
from memloom.sources.config import Namespace, Policy

POLICY = Policy(
    (Namespace("knowledge"), Namespace("small", max_entries=1), Namespace("saves", purpose="checkpoints")),
    grants=tuple(("ann", n, op) for n in ("knowledge", "saves") for op in ("get", "put", "list", "delete", "stats")) + (("bob", "knowledge", "list"),),
)
CAPSULE = {"goal": "g", "summary": "s", "next_action": "n"}


def service(spark, tokens=None):
    return frontend.Service(Engine(spark, POLICY, now_ms=1000), tokens)


def code(act):
    with pytest.raises(EngineError) as error:
        act()
    return error.value.code


def test_tools(spark):
    s = service(spark)
    ns = {"namespace": "knowledge"}
    assert s.call("remember", ns | {"key": "m", "content": "Rust tools", "topic": "work", "occurred_at_ms": 5})["revision"] == 1
    s.call("memory_put", ns | {"key": "r", "value": {"a": 1}})
    assert s.call("memory_get", ns | {"key": "r"})["value"] == {"a": 1}
    assert [i["key"] for i in s.call("search", ns | {"query": "rust"})["items"]] == ["m"]
    assert s.call("recall", ns | {"topic": "work"})["items"] == s.call("browse", ns)["items"]
    assert [i["key"] for i in s.call("memory_list", ns)["items"]] == ["m", "r"]
    assert s.call("stats", ns)["entries"] == 2
    assert code(lambda: s.call("memory_put", ns | {"key": "r", "value": 1, "if_absent": True})) == "conflict"
    assert code(lambda: s.call("memory_put", ns | {"key": "r"})) == "invalid"
    assert code(lambda: s.call("search", ns | {"query": "rust", "cursor": "x"})) == "invalid"
    assert code(lambda: s.call("nothing", ns)) == "not_found"
    assert code(lambda: s.call("stats", {"namespace": "other"})) == "namespace_not_found"
    s.call("memory_put", {"namespace": "small", "key": "a", "value": 1})
    assert code(lambda: s.call("memory_put", {"namespace": "small", "key": "b", "value": 1})) == "quota"
    save = {"id": "c1", "agent_id": "a", "session_id": "s", "capsule": CAPSULE, "references": [{"namespace": "knowledge", "key": "m", "revision": 1}]}
    s.call("memory_checkpoint", {"namespace": "saves", "checkpoint": save})
    held = s.call("memory_restore", {"namespace": "saves", "agent_id": "a", "session_id": "s"})
    assert held["checkpoint_id"] == "c1" and held["references"][0]["status"] == "available"
    assert code(lambda: s.call("memory_delete_checkpoint", {"namespace": "saves", "checkpoint_id": "c1"})) == "conflict"
    assert s.call("forget", ns | {"key": "m"}) == {"forgotten": True}
    assert s.call("memory_delete", ns | {"key": "r", "if_revision": 2}) == {"deleted": True}
    assert s.counts["requests"] == 20 and s.counts["failures"] == 7


def test_http(spark):
    s = service(spark, {"t-ann": "ann", "t-bob": "bob"})
    listener = frontend.server(s)
    threading.Thread(target=listener.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{listener.server_address[1]}"

    def ask(method, path, body=None, token="t-ann"):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(root + path, data, {"Authorization": f"Bearer {token}"} if token else {}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    ns = "/v1/namespaces/knowledge"
    assert ask("GET", "/healthz", token=None) == (200, {"status": "ok"})
    assert ask("GET", f"{ns}/records", token=None)[0] == 401 and ask("GET", f"{ns}/records", token="no")[0] == 401
    assert ask("POST", f"{ns}/memories", {"key": "a/b c", "content": "Rust tools", "topic": "work"})[0] == 200
    assert ask("GET", f"{ns}/memories/a/b%20c")[1]["content"] == "Rust tools"
    assert [i["key"] for i in ask("POST", f"{ns}/search", {"query": "tools"})[1]["items"]] == ["a/b c"]
    assert ask("GET", f"{ns}/memories?topic=work&limit=1")[1]["items"][0]["topic"] == "work"
    assert ask("PUT", f"{ns}/records/r?if_absent=true", [1])[0] == 200 and ask("PUT", f"{ns}/records/r?if_absent=true", [1])[0] == 409
    assert ask("GET", f"{ns}/records?prefix=r")[1]["items"][0]["key"] == "r"
    assert ask("GET", f"{ns}/records/r", token="t-bob")[0] == 403 and ask("GET", f"{ns}/records", token="t-bob")[0] == 200
    assert ask("POST", f"{ns}/search", {"query": "tools"}, "t-bob")[0] == 403  # ranked reads want get besides list
    assert ask("DELETE", f"{ns}/records/r")[0] == 200 and ask("GET", f"{ns}/records/r")[0] == 404
    assert ask("GET", "/nowhere")[0] == 404 and ask("GET", f"{ns}/records?limit=x")[0] == 400
    assert ask("GET", f"{ns}/stats")[1]["entries"] == 1 and ask("GET", "/metrics")[1]["failures"] >= 3
    listener.shutdown()
    listener.server_close()


def test_lines(spark):
    requests = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "memory_put", "arguments": {"namespace": "knowledge", "key": "k", "value": "v"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "memory_get", "arguments": {"namespace": "knowledge", "key": "none"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "other"},
    ]
    out = io.StringIO()
    frontend.lines(service(spark), [*map(json.dumps, requests), "", "no json"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None]
    assert {"remember", "memory_restore"} <= {t["name"] for t in got[1]["result"]["tools"]}
    assert not got[2]["result"]["isError"] and got[3]["result"]["isError"] and "not_found" in got[3]["result"]["content"][0]["text"]
    assert got[4]["error"]["code"] == got[5]["error"]["code"] == -32601


def test_command_line_keeps_its_tables(spark, tmp_path):
    policy = tmp_path / "policy.toml"
    policy.write_text('[[namespaces]]\nname = "knowledge"\n[[namespaces]]\nname = "saves"\npurpose = "checkpoints"\n')

    def run(*argv):
        out = io.StringIO()
        status = frontend.main([*argv, "--policy", str(policy), "--data", str(tmp_path), "--now-ms", "1000"], spark, out)
        return status, out.getvalue()

    assert run("check-config") == (0, "ok\n")
    assert run("remember", json.dumps({"namespace": "knowledge", "key": "m", "content": "Rust tools", "topic": "work"}))[0] == 0
    status, text = run("search", json.dumps({"namespace": "knowledge", "query": "tools"}))
    assert status == 0 and json.loads(text)["items"][0]["key"] == "m"
    save = {"id": "c1", "agent_id": "a", "session_id": "s", "capsule": CAPSULE}
    assert run("memory_checkpoint", json.dumps({"namespace": "saves", "checkpoint": save}))[0] == 0
    assert json.loads(run("memory_restore", json.dumps({"namespace": "saves", "checkpoint_id": "c1"}))[1])["capsule"] == CAPSULE
    assert run("memory_checkpoint", json.dumps({"namespace": "saves", "checkpoint": save | {"id": "c2", "expected_revision": 2}}))[0] == 0
    assert run("memory_delete_checkpoint", json.dumps({"namespace": "saves", "checkpoint_id": "c1"}))[0] == 0
    assert run("memory_restore", json.dumps({"namespace": "saves", "checkpoint_id": "c1"}))[0] == 1
    status, text = run("memory_get", json.dumps({"namespace": "knowledge", "key": "none"}))
    assert status == 1 and json.loads(text)["error"] == "not_found"
