"""A service over HTTP, by the standard library: POST /query and /debug/query-plan, GET /health and /metrics."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..errors import CorvixError
from .service import QueryRequest, Service


def server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that isn't running yet; a request that can't be served gets 400, with the reason as {"error": ...}."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, status: int, value: object) -> None:
            self._send(status, json.dumps(value, default=str).encode())

        def do_GET(self) -> None:
            if self.path == "/health":
                self._json(200, service.health())
            elif self.path == "/metrics":
                self._send(200, service.prometheus().encode(), "text/plain; version=0.0.4")
            else:
                self._json(404, {"error": "not found"})

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path != "/query" and not (self.path == "/debug/query-plan" and service.debug):
                self._json(404, {"error": "not found"})
                return
            try:
                request = QueryRequest(**json.loads(body))
                self._json(200, asdict(service.query(request)) if self.path == "/query" else service.plan_response(request))
            except (CorvixError, TypeError, ValueError) as e:
                self._json(400, {"error": str(e)})
            except Exception as e:
                logging.getLogger(__name__).exception("query failed")
                mismatch = "DimensionMismatch" in str(e)
                self._json(400 if mismatch else 500, {"error": "query vector dimensions do not match the index" if mismatch else "search failed"})

        def log_message(self, form: str, *args: object) -> None:
            logging.getLogger(__name__).info(form, *args)

    return ThreadingHTTPServer((host, port), Handler)
