"""The service over HTTP and as agent tools, and a client; with the standard library alone."""

from __future__ import annotations

import inspect
import json
import re
import threading
import urllib.error
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from factweave.service import MemoryService, authorised

#: Facts that one request for single facts may name.
MOST_FACTS = 50


class BadRequest(Exception):
    pass


def _sessions(body: dict) -> dict:
    """A session of a request, as the scopes it asks for."""
    session = body.pop("session", None)
    return body | ({"sessions": [session]} if session else {})


def _with_answer(service: MemoryService, name: str, body: dict, found: list) -> dict:
    out = {name: found}
    if body.get("synthesize"):
        out["answer"] = service.answer(body["query"], sessions=body.get("sessions"), use_discover=name == "connections")
    return out


def _facts(service: MemoryService, texts: list[str]) -> dict:
    from pyspark.sql import functions as F

    rows = service.facts().where(F.col("content").isin(texts[:MOST_FACTS])).collect()
    return {r["content"]: {"sessions": sorted(r["scopes"]), "entities": list(r["entities"]), "causes": [c.asDict() for c in r["causes"]]} for r in rows}


def _only(body: dict, *keys: str) -> dict:
    return {k: body[k] for k in keys if body.get(k) is not None}


def routes(service: MemoryService) -> list[tuple[str, str, Callable[[dict, str | None], dict]]]:
    """(method, path pattern, handler of body and session)."""
    walk = ("sessions", "top_k", "hops", "search_mode", "isolate")

    def query(body, _):
        body = _sessions(body)
        return _with_answer(service, "facts", body, service.query(body["query"], **_only(body, *walk, "recency_weight", "as_of", "detailed")))

    def discover(body, _):
        body = _sessions(body)
        return _with_answer(service, "connections", body, service.discover(body["query"], **_only(body, *walk, "max_results", "include_superseded")))

    def asked(verb: Callable, *names: str, also: tuple[str, ...] = ()):
        def run(body, _):
            body = _sessions(body)
            return verb(*(body[n] for n in names), **_only(body, *also, "sessions", "max_depth", "isolate"))

        return run

    return [
        ("POST", "/sessions/([^/]+)/memory", lambda b, s: service.push(s, b["text"])),
        ("POST", "/sessions/([^/]+)/memory/batch", lambda b, s: {"stored": service.push_many(s, b["texts"])}),
        ("DELETE", "/sessions/([^/]+)", lambda b, s: service.forget(s)),
        ("GET", "/sessions", lambda b, s: {"sessions": service.list_sessions()}),
        ("POST", "/query", query),
        ("POST", "/discover", discover),
        ("POST", "/causal_chain", lambda b, s: {"chain": asked(service.causal_chain, "from_content", "to_content")(b, s) or []}),
        ("POST", "/trace", asked(service.trace, "content", also=("direction",))),
        ("POST", "/what_if", asked(service.what_if, "content", also=("origin", "direction"))),
        ("POST", "/supersede", lambda b, s: service.supersede(b["old_text"], b["new_text"], b.get("session"))),
        ("POST", "/delete", lambda b, s: {"deleted": service.delete(b["text"])}),
        ("POST", "/history", lambda b, s: service.history(b["text"])),
        ("POST", "/forget", lambda b, s: {"deleted": service.forget_stale()}),
        ("POST", "/facts", lambda b, s: _facts(service, b["texts"])),
        ("GET", "/stats", lambda b, s: service.stats()),
    ]


def serve(service: MemoryService, port: int = 0, keys: list[str] | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server in a thread of its own; shutdown() ends it.

    With keys, all but /health and /ready ask for one, as Bearer token or X-API-Key.  Writes take turns.  Where the graph
    has forget_every, a timer sweeps it.
    """
    table = [(m, re.compile(p + r"\Z"), f) for m, p, f in routes(service)]
    turn = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, body) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _run(self) -> None:
            if self.path == "/health":
                return self._reply(200, {"status": "ok"})
            if self.path == "/ready":
                return self._reply(*((200, {"ready": True}) if service.ready() else (503, {"ready": False})))
            given = self.headers.get("X-API-Key") or (self.headers.get("Authorization") or "").removeprefix("Bearer ")
            if keys is not None and not authorised(given, keys):
                return self._reply(401, {"error": "no valid key"})
            for method, pattern, handler in table:
                m = pattern.match(self.path)
                if m and method == self.command:
                    try:
                        body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                        with turn:
                            return self._reply(200, handler(body, m[1] if m.re.groups else None))
                    except (KeyError, ValueError, TypeError) as e:
                        return self._reply(422, {"error": str(e)})
                    except RuntimeError as e:
                        return self._reply(400, {"error": str(e)})
            return self._reply(404, {"error": "no such route"})

        do_GET = do_POST = do_DELETE = _run

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    every = service.graph.forget_every
    if every:
        def sweep() -> None:
            while not stop.wait(every.total_seconds()):
                with turn:
                    service.maybe_forget()

        stop = threading.Event()
        threading.Thread(target=sweep, daemon=True).start()
        end = server.shutdown
        server.shutdown = lambda: (stop.set(), end())
    return server


class MemoryClient:
    """The verbs of a served memory. Server errors are tried again, what the client got wrong isn't."""

    def __init__(self, url: str, key: str | None = None, timeout: float = 60.0, tries: int = 3):
        self.url, self.key, self.timeout, self.tries = url.rstrip("/"), key, timeout, tries

    def _call(self, method: str, path: str, **body):
        data = json.dumps({k: v for k, v in body.items() if v is not None}).encode() if body else None
        asked = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}), method=method)
        for i in range(self.tries):
            try:
                with urllib.request.urlopen(asked, timeout=self.timeout) as reply:  # noqa: S310 - the caller's own address
                    return json.loads(reply.read())
            except urllib.error.HTTPError as e:
                if e.code < 500 or i == self.tries - 1:
                    raise BadRequest(f"{e.code}: {e.read().decode(errors='replace')}") from e
            except urllib.error.URLError:
                if i == self.tries - 1:
                    raise

    def remember(self, session: str, text: str) -> dict:
        return self._call("POST", f"/sessions/{session}/memory", text=text)

    def remember_many(self, session: str, texts: list[str]) -> list[dict]:
        return self._call("POST", f"/sessions/{session}/memory/batch", texts=texts)["stored"]

    def correct(self, session: str, old: str, new: str) -> dict:
        return self._call("POST", "/supersede", session=session, old_text=old, new_text=new)

    def forget_session(self, session: str) -> dict:
        return self._call("DELETE", f"/sessions/{session}")

    def recall(self, query: str, session: str | None = None, **how) -> list:
        return self._call("POST", "/query", query=query, session=session, **how)["facts"]

    def discover(self, query: str, session: str | None = None, **how) -> list[dict]:
        return self._call("POST", "/discover", query=query, session=session, **how)["connections"]

    def causal_chain(self, start: str, target: str) -> list[dict]:
        return self._call("POST", "/causal_chain", from_content=start, to_content=target)["chain"]

    def trace(self, content: str, direction: str = "effects") -> dict:
        return self._call("POST", "/trace", content=content, direction=direction)

    def what_if(self, content: str, **how) -> dict:
        return self._call("POST", "/what_if", content=content, **how)

    def history(self, text: str) -> dict:
        return self._call("POST", "/history", text=text)

    def facts(self, texts: list[str]) -> dict:
        return self._call("POST", "/facts", texts=texts)

    def stats(self) -> dict:
        return self._call("GET", "/stats")


def tools(service: MemoryService) -> dict[str, Callable]:
    """The tools that an agent is offered, by name."""
    one = lambda session: [session] if session else None

    def push_memory(session: str, text: str):
        """Stores a memory in a session and says which entities it names."""
        return service.push(session, text)

    def query_memory(query: str, session: str | None = None, top_k: int = 5, hops: int = 4, as_of: str | None = None):
        """Facts for a query, the best first."""
        return service.query(query, sessions=one(session), top_k=top_k, hops=hops, as_of=as_of, detailed=False)

    def query_memory_detailed(query: str, session: str | None = None, top_k: int = 5, hops: int = 4, as_of: str | None = None):
        """Facts for a query with score, time and sessions."""
        return service.query(query, sessions=one(session), top_k=top_k, hops=hops, as_of=as_of)

    def discover_connections(query: str, session: str | None = None, hops: int = 4):
        """Facts connected to a query's, with the paths to them."""
        return service.discover(query, sessions=one(session), hops=hops)

    def causal_chain_memory(from_text: str, to_text: str):
        """The causal hops from one fact to another."""
        return service.causal_chain(from_text, to_text) or []

    def trace_memory(text: str, direction: str = "effects", max_depth: int = 6):
        """What a fact caused, or what caused it."""
        return service.trace(text, direction, max_depth=max_depth)

    def what_if_memory(text: str, origin: str | None = None, direction: str = "effects"):
        """What would lose its support if a fact were false."""
        return service.what_if(text, origin=origin, direction=direction)

    def answer(query: str, session: str | None = None, hops: int = 4):
        """An answer made from facts."""
        return service.answer(query, sessions=one(session), hops=hops)

    def update_memory(old_text: str, new_text: str, session: str | None = None):
        """Replaces a memory by a corrected one."""
        return service.supersede(old_text, new_text, session)

    def delete_memory(text: str):
        """Deletes a memory."""
        return {"deleted": service.delete(text)}

    def memory_history(text: str):
        """What a memory replaced and what replaced it."""
        return service.history(text)

    def forget_stale():
        """Deletes memories that weren't used for long."""
        return {"deleted": service.forget_stale()}

    def list_sessions():
        """The sessions there are."""
        return service.list_sessions()

    return {f.__name__: f for f in (push_memory, query_memory, query_memory_detailed, discover_connections, causal_chain_memory, trace_memory, what_if_memory, answer, update_memory, delete_memory, memory_history, forget_stale, list_sessions)}


def tool_reply(offered: dict[str, Callable], request: dict) -> dict | None:
    """The reply to one JSON-RPC request of an agent: initialize, tools/list or tools/call; None to a notification."""
    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
    head = {"jsonrpc": "2.0", "id": request.get("id")}
    method, given = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        return head | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "factweave", "version": "0.2"}}}
    if method == "tools/list":
        listed = []
        for name, f in offered.items():
            arguments = inspect.signature(f).parameters.values()
            fields = {p.name: {"type": kinds.get(str(p.annotation).split(" ")[0], "string")} for p in arguments}
            listed.append({"name": name, "description": inspect.getdoc(f), "inputSchema": {"type": "object", "properties": fields, "required": [p.name for p in arguments if p.default is p.empty]}})
        return head | {"result": {"tools": listed}}
    if method == "tools/call":
        try:
            found = offered[given["name"]](**(given.get("arguments") or {}))
            return head | {"result": {"content": [{"type": "text", "text": json.dumps(found, default=str)}], "isError": False}}
        except Exception as e:  # noqa: BLE001 - the agent is told
            return head | {"result": {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}}
    return head | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve_tools(service: MemoryService, lines, write: Callable[[str], object]) -> None:
    """Answers requests, one JSON document a line, until lines end."""
    offered = tools(service)
    for line in lines:
        if line.strip():
            reply = tool_reply(offered, json.loads(line))
            if reply is not None:
                write(json.dumps(reply) + "\n")
