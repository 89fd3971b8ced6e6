"""A read-only page of all pairs' results on the loopback address: /, /api/data, /metrics, /report/NAME."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from concord.model import RESULT_SCHEMA
from concord.sources import sinks


def page(spark: SparkSession, reports: str, names: list[str], path: str) -> tuple[int, str, str]:
    """Status, content type and body of one request."""
    read = lambda name: spark.read.schema(RESULT_SCHEMA).json(f"{reports}/{name}/summary")
    known = [n for n in names if sinks.exists(spark, f"{reports}/{n}/summary")]
    if path == "/":
        links = "".join(f'<li><a href="/report/{n}">{n}</a></li>' for n in known)
        return 200, "text/html; charset=utf-8", f"<!doctype html><title>concord</title><ul>{links}</ul>"
    if path == "/api/data":
        data = {n: {"matrix": [r.asDict() for r in sinks.status_matrix(read(n)).collect()], **sinks.pass_total(read(n)).first().asDict()} for n in known}
        return 200, "application/json", json.dumps(data)
    if path == "/metrics":
        return 200, "text/plain; charset=utf-8", "".join(r["line"] + "\n" for n in known for r in sinks.metrics(read(n), n).collect())
    if path.startswith("/report/") and path[8:] in known:
        return 200, "text/html; charset=utf-8", sinks.html_report(read(path[8:]), path[8:])
    return 404, "text/plain; charset=utf-8", "not found"


def server(spark: SparkSession, reports: str, names: list[str], port: int = 8484) -> ThreadingHTTPServer:
    """A server that is not started yet."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def do_GET(self) -> None:
            status, kind, body = page(spark, reports, names, self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
