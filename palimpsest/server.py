"""A small HTTP interface over one engine: JSON in, JSON out, and a page that lists what is there."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from .cli import load
from .operators import reads
from .plans.config import ConfigError, from_mapping, from_yaml
from .plans.store import Engine, EngineError
from .sources import readers

PAGE = """<!doctype html><meta charset="utf-8"><title>tables</title><body><h1>Tables</h1><ul id="t"></ul><pre id="r"></pre><script>
const show = async t => r.textContent = JSON.stringify(await (await fetch(`/api/tables/${t}/rows?limit=50`)).json(), null, 1)
fetch('/api/tables').then(x => x.json()).then(ts => ts.forEach(t => { const e = document.createElement('li'); e.textContent = t; e.onclick = () => show(t); document.getElementById('t').append(e) }))
const r = document.getElementById('r')</script>"""


class NotFound(Exception):
    pass


class Api:
    """Answers (status, body) by method and path. Writes wait for each other; reads see the commits that are there when they start."""

    def __init__(self, engine: Engine):
        self.engine, self.lock = engine, threading.Lock()

    def answer(self, method: str, target: str, body: str = "", kind: str = "application/json") -> tuple[int, object]:
        url = urlsplit(target)
        path, query = [unquote(p) for p in url.path.split("/") if p], dict(parse_qsl(url.query))
        try:
            if method == "POST":
                with self.lock:
                    return self.post(path, query, body, kind)
            return 200, self.get(path, query)
        except (ConfigError, ValueError) as e:
            return 400, {"error": str(e)}
        except NotFound as e:
            return 404, {"error": str(e)}
        except EngineError as e:
            return (404 if str(e).startswith("no such table") else 409), {"error": str(e)}
        except Exception as e:  # noqa: BLE001  a request must not end the server
            return 500, {"error": str(e)[:500]}

    def get(self, path: list[str], query: dict) -> object:
        e, limit = self.engine, int(query.get("limit", 100))
        match path:
            case ["api", "tables"]:
                return list(e.tables())
            case ["api", "tables", t]:
                return e.config(t).to_dict()
            case ["api", "tables", t, "rows"]:
                rows = e.scan_as_of(t, query["valid"]) if "valid" in query else e.scan_current(t)
                rows = reads.rows_containing(rows, query["q"]) if query.get("q") else rows
                found, more = reads.page(rows, list(e.config(t).business_key), limit, int(query.get("offset", 0)))
                return {"rows": [r.asDict(recursive=True) for r in found], "has_more": more}
            case ["api", "tables", t, "history"]:
                found = e.get_history(t, **{k: v for k, v in query.items() if k != "limit"})
                if not found:
                    raise NotFound("no such entity")
                return found
            case ["api", "manifests"]:
                return e.manifests(query.get("table"), limit)
            case ["api", "quarantine"]:
                return [r.asDict(recursive=True) for r in e.quarantine(query["table"]).orderBy("id").limit(limit).collect()]
            case ["api", "stats"]:
                return e.stats()
            case ["api", "verify"]:
                return e.verify()
        raise NotFound("/".join(path))

    def post(self, path: list[str], query: dict, body: str, kind: str) -> tuple[int, object]:
        e = self.engine
        match path:
            case ["api", "tables"]:
                return 201, e.create_table(from_yaml(body) if "yaml" in kind else from_mapping(json.loads(body)))
            case ["api", "tables", t, "apply"]:
                given = readers.read_string(e.spark, body, query.get("format", "json"))
                if set(given.rows) - {None, t}:
                    raise ConfigError(f"the body names other tables than {t}")
                return 200, load(e, given, t, query.get("load_id"), query.get("full_snapshot") == "true", query.get("effective_at"))
            case ["api", "quarantine", "reapply"]:
                asked = json.loads(body)
                return 200, e.reapply(asked["table"], asked["load_id"], asked.get("ids"))
        raise NotFound("/".join(path))


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready; call serve_forever() on it. By default only this machine reaches it: there is no login."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def handle_any(self) -> None:
            if self.command == "GET" and self.path in ("/", "/index.html"):
                return self.reply(200, PAGE.encode(), "text/html; charset=utf-8")
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, out = api.answer(self.command, self.path, body, self.headers.get("Content-Type") or "")
            return self.reply(status, json.dumps(out, default=str).encode(), "application/json")

        do_GET = do_POST = handle_any

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
