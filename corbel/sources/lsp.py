"""A resolver over an external call-hierarchy server: JSON-RPC on the server's standard streams.

Each Spark partition runs one session; symbols are dealt out by module, so a session's questions stay close together.
What the server answers are raw items (file, line, name); they are classified by joins afterwards.
"""

from __future__ import annotations

import json
import subprocess
import threading
import time
from pathlib import Path
from typing import Any
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.functions import text as T
from corbel.layout import Layout
from corbel.operators.links import classify
from corbel.plans.model import Tree
from corbel.plans.resolve import RawLinks
from corbel.workspace import keep

#: Seconds for the first request and for all others.
INITIALISE_S, REQUEST_S = 180, 1800
COLUMNS = ["id", "way", "pos", "rel", "line", "name"]


class Session:
    def __init__(self, root: str | Path, command: tuple[str, ...]):
        self.root = Path(root).resolve()
        self.timeouts = self.requests = 0
        self._ids, self._waiting, self._lock = 0, {}, threading.Lock()
        self._proc = subprocess.Popen(command, cwd=self.root, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        threading.Thread(target=self._listen, daemon=True).start()
        hello = {"processId": None, "rootUri": self.root.as_uri(), "capabilities": {"textDocument": {"callHierarchy": {}}, "workspace": {"configuration": True, "workspaceFolders": True}}, "workspaceFolders": [{"uri": self.root.as_uri(), "name": self.root.name}]}
        self.request("initialize", hello, INITIALISE_S)
        self.notify("initialized", {})

    def _send(self, message: dict) -> None:
        body = json.dumps({"jsonrpc": "2.0", **message}).encode()
        with self._lock:
            self._proc.stdin.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
            self._proc.stdin.flush()

    def _listen(self) -> None:
        out = self._proc.stdout
        while True:
            size = 0
            while (line := out.readline()) not in (b"\r\n", b""):
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":")[1])
            if not size:
                break
            m = json.loads(out.read(size))
            if "method" in m and "id" in m:  # the server asks: an empty object for each setting, or nothing
                asked = (m.get("params") or {}).get("items") or []
                self._send({"id": m["id"], "result": [{} for _ in asked] or None})
            elif "id" in m and (slot := self._waiting.pop(m["id"], None)):  # replies after a timeout find no slot
                slot["reply"] = m.get("result")
                slot["event"].set()
        for slot in list(self._waiting.values()):
            slot["event"].set()

    def request(self, method: str, params: Any, seconds: float = REQUEST_S) -> Any:
        self._ids += 1
        self.requests += 1
        n, slot = self._ids, {"event": threading.Event(), "reply": None}
        self._waiting[n] = slot
        self._send({"id": n, "method": method, "params": params})
        if not slot["event"].wait(seconds):
            self.timeouts += 1
            self._waiting.pop(n, None)
        return slot["reply"]

    def notify(self, method: str, params: Any) -> None:
        self._send({"method": method, "params": params})

    def open(self, rel: str) -> None:
        path = self.root / rel
        self.notify("textDocument/didOpen", {"textDocument": {"uri": path.as_uri(), "languageId": "python", "version": 1, "text": path.read_text(errors="replace")}})

    def rel(self, uri: str) -> str | None:
        path = Path(unquote(urlparse(uri).path)).resolve()  # servers may follow links
        return path.relative_to(self.root).as_posix() if path.is_relative_to(self.root) else None

    def close(self) -> None:
        self._proc.kill()
        self._proc.wait()


class ServerResolver:
    def __init__(self, root: str | Path, layout: Layout, command: tuple[str, ...], sessions: int = 8):
        self.root, self.layout, self.command, self.sessions = str(root), layout, command, sessions

    def ask(self, tree: Tree, symbols: DataFrame) -> DataFrame:
        """(id, way, pos, rel, line, name): each caller (in) and callee (out) that the server names; and a row of way
        `session` for each session: its requests as pos, timeouts as line, and milliseconds of its start as name."""
        root, command = self.root, self.command
        paths = [r[0] for r in tree.modules.select("path").collect()]  # file names: the session must open each

        def run(frames):
            session, began = None, ""
            try:
                for pdf in frames:
                    if session is None and len(pdf):
                        t0 = time.time()
                        session = Session(root, command)
                        began = str(round(1000 * (time.time() - t0)))
                        for p in paths:
                            session.open(p)
                    rows = []
                    for s in pdf.itertuples():
                        at = {"textDocument": {"uri": (Path(root).resolve() / s.file).as_uri()}, "position": {"line": int(s.line) - 1, "character": int(s.col)}}
                        for item in (session.request("textDocument/prepareCallHierarchy", at) or [])[:1]:
                            for way, method, end in (("in", "incomingCalls", "from"), ("out", "outgoingCalls", "to")):
                                for pos, c in enumerate(session.request(f"callHierarchy/{method}", {"item": item}) or []):
                                    i = c[end]
                                    rows.append((s.id, way, pos, session.rel(i["uri"]), i["selectionRange"]["start"]["line"] + 1, i["name"]))
                    yield pd.DataFrame(rows, columns=COLUMNS)
                if session is not None:
                    yield pd.DataFrame([(None, "session", session.requests, None, session.timeouts, began)], columns=COLUMNS)
            finally:
                if session is not None:
                    session.close()

        dealt = symbols.select("id", "file", "line", "col", "module").repartition(self.sessions, "module")
        return dealt.mapInPandas(run, "id string, way string, pos long, rel string, line long, name string")

    def resolve(self, tree: Tree, symbols: DataFrame) -> RawLinks:
        said = keep(self.ask(tree, symbols), "server")  # asked once, whatever is lost later
        total = said.filter("way = 'session'").agg(F.sum("pos").alias("requests"), F.sum("line").alias("timeouts"), F.max(F.col("name").cast("long")).alias("ms")).first()
        info = {"requests": total["requests"] or 0, "timeouts": total["timeouts"] or 0, "init_s": round((total["ms"] or 0) / 1000, 1)}
        said = said.filter("way <> 'session'")
        s = tree.symbols
        items = said.select(F.concat_ws("\x00", "id", "way", F.col("pos").cast("string")).alias("id"), F.col("rel").alias("grp"), F.col("line").alias("at"), "name", F.col("id").alias("sym"), "way", "pos")
        exact = s.select(F.col("file").alias("grp"), F.col("line").alias("at"), F.col("id").alias("target"))
        spans = s.select(F.col("file").alias("grp"), F.col("line").alias("lo"), F.col("end").alias("hi"), F.col("id").alias("span"), "ord")
        is_test = T.is_test_path(F.coalesce("grp", F.lit("")), self.layout.tests)
        got = classify(items, exact, spans, is_test, F.col("grp").isNotNull())
        edges = got.filter("kind = 'sym' AND way = 'in'").select(F.col("target").alias("src"), F.col("sym").alias("dst"))
        edges = edges.unionByName(got.filter("kind = 'sym' AND way = 'out'").select(F.col("sym").alias("src"), F.col("target").alias("dst")))
        tests = got.filter("kind = 'test' AND way = 'in'").select(F.col("sym").alias("id"), F.col("grp").alias("file"), "name")
        callers = got.filter("kind = 'local' AND way = 'in'").select(F.col("sym").alias("id"), "pos", "name", F.concat_ws(":", "grp", F.col("at").cast("string")).alias("at"))
        callees = got.filter("kind IN ('ext', 'local') AND way = 'out'").select(F.col("sym").alias("id"), "name")
        return RawLinks(edges, tests, callers, callees, info)
