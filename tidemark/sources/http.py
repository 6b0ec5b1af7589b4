"""The database behind HTTP, with the standard library's server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..functions.text import time_param
from ..operators.selector import SelectorError
from ..plans.database import Database
from .json_import import MOST_BYTES, BadRequest, import_json
from .remote_write import remote_write

#: Prefix of the headers with statistics.
PREFIX = "X-Tidemark-"
STATS = {"Parts-Scanned": "parts_scanned", "Blocks-Scanned": "blocks_scanned", "Points-Scanned": "points_scanned", "Points-Returned": "points_returned"}


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def respond(db: Database, method: str, target: str, body: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body of the answer; does no input or output of its own."""
    url = urlsplit(target)
    routes = {"/healthz": _health, "/api/v1/import": _import, "/api/v1/write": _write, "/api/v1/query_range": _query, "/internal/force_flush": _flush, "/internal/force_merge": _merge}
    if url.path not in routes:
        return 404, {}, b"not found\n"
    try:
        return routes[url.path](db, method, url.query, body)
    except Refused as error:
        return error.status, {}, f"{error}\n".encode()
    except (BadRequest, SelectorError) as error:
        return 400, {}, f"{error}\n".encode()
    except Exception as error:  # the client hears of it, and the server goes on
        return 500, {}, f"{error}\n".encode("utf-8", "replace")


def _posted(method: str, body: bytes) -> None:
    if method != "POST":
        raise Refused(405, "use POST")
    if len(body) > MOST_BYTES:
        raise Refused(400, "body is too long")


def _health(db: Database, method: str, query: str, body: bytes) -> tuple[int, dict[str, str], bytes]:
    return 200, {}, b"OK"


def _import(db: Database, method: str, query: str, body: bytes) -> tuple[int, dict[str, str], bytes]:
    _posted(method, body)
    return 200, {"Content-Type": "application/json"}, json.dumps({"ingested": import_json(db, body)}).encode()


def _write(db: Database, method: str, query: str, body: bytes) -> tuple[int, dict[str, str], bytes]:
    _posted(method, body)
    return 204, {f"{PREFIX}Points-Ingested": str(remote_write(db, body))}, b""


def _query(db: Database, method: str, query: str, body: bytes) -> tuple[int, dict[str, str], bytes]:
    given = parse_qs(query, keep_blank_values=True)
    if method == "POST":
        for k, v in parse_qs(body.decode("utf-8", "replace"), keep_blank_values=True).items():
            given[k] = v + given.get(k, [])
    one = lambda name: given.get(name, [""])[0]
    selector = one("query")
    try:
        start, end = time_param(one("start")), time_param(one("end"))
    except ValueError as error:
        raise Refused(400, str(error)) from None
    if end < start:
        raise Refused(400, "end is before start")
    stats = db.query_stats(selector, start, end).first()
    headers = {f"{PREFIX}{k}": str(stats[v]) for k, v in STATS.items()}
    return 200, {"Content-Type": "application/json", **headers}, db.query_json(selector, start, end).encode()


def _flush(db: Database, method: str, query: str, body: bytes) -> tuple[int, dict[str, str], bytes]:
    _posted(method, body)
    db.flush()
    return 204, {}, b""


def _merge(db: Database, method: str, query: str, body: bytes) -> tuple[int, dict[str, str], bytes]:
    _posted(method, body)
    db.force_merge()
    return 204, {}, b""


def serve(db: Database, address: tuple[str, int]) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, headers, out = respond(db, self.command, self.path, self.rfile.read(min(size, MOST_BYTES + 1)))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            if status != 204:
                self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            if status != 204:
                self.wfile.write(out)

        do_GET = do_POST = do_PUT = do_DELETE = _any  # noqa: N815

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(address, Handler)


def main(args: list[str] | None = None) -> None:
    """``python -m tidemark.sources.http``: opens the database, starts flushing and retention, and listens."""
    import argparse
    import signal
    import threading

    from pyspark.sql import SparkSession

    from ..functions.text import retention_days
    from ..plans.database import Config

    own = argparse.ArgumentParser()
    own.add_argument("--listen", default=Config.listen)
    own.add_argument("--data", default="tidemark-data")
    own.add_argument("--flush-seconds", type=float, default=Config.flush_seconds)
    own.add_argument("--merge-threshold", type=int, default=Config.merge_threshold)
    own.add_argument("--retention", type=retention_days, default=0)
    given = own.parse_args(args)
    db = Database(SparkSession.builder.getOrCreate(), given.data, Config(given.merge_threshold, given.retention, given.flush_seconds, listen=given.listen))
    db.start_flushing()
    db.start_retention()
    host, _, port = given.listen.rpartition(":")
    server = serve(db, (host, int(port)))
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: threading.Thread(target=server.shutdown).start())
    server.serve_forever()
    db.close()


if __name__ == "__main__":
    main()
