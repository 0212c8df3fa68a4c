"""The database over HTTP: GET /query?q=STATEMENT, GET /overview, POST /ingest (one JSON object, or a list of them).

python -m tallyframe.server DATABASE [PORT]. One request at a time; answers are JSON.
"""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from .database import Database


def answer(db: Database, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON of a request."""
    where = urlsplit(target)
    try:
        if (method, where.path) == ("GET", "/query"):
            r = db.query(parse_qs(where.query).get("q", [""])[0])
            return 200, {"header": r.header, "rows": r.rows}
        if (method, where.path) == ("GET", "/overview"):
            return 200, {"stats": db.stats(), "schema": db.query("SCHEMA").to_dicts()}
        if (method, where.path) == ("POST", "/ingest"):
            try:
                got = json.loads(body)
            except ValueError:
                return 400, {"error": "not JSON"}
            if not isinstance(got, (dict, list)):
                return 400, {"error": "an object or a list of objects is expected"}
            records = [r for r in ([got] if isinstance(got, dict) else got) if isinstance(r, dict)]
            report = db.ingest_records(records) if records else None
            return 200, {"processed": report.processed if report else 0, "skipped": report.skipped if report else 0}
    except (ValueError, LookupError, PermissionError) as e:
        return 400, {"error": str(e)}
    return 404, {"error": "no such page"}


def serve(db: Database, port: int = 3000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = answer(db, method, self.path, body)
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    serve(Database(session, sys.argv[1]), int(sys.argv[2]) if sys.argv[2:] else 3000)
