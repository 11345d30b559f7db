"""A service on the driver's own machine that answers from files which Spark wrote, for queries of the client."""

from __future__ import annotations

import http.server
import json
import threading
import urllib.parse
from collections.abc import Callable, Iterable


class _Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        at = urllib.parse.urlsplit(self.path)
        asked = dict(urllib.parse.parse_qsl(at.query))
        end = at.path.rsplit("/", 1)[-1]
        if end == "capabilities":
            body = json.dumps({"HAPI": "3.0", "status": {"code": 1200}})
        elif end == "info":
            body = json.dumps(self.server.info | {"status": {"code": 1200}})
        else:
            body = "".join(f"{x}\n" for x in self.server.lines(asked["start"], asked["stop"]))
        data = body.encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


def serve(host: str, info: dict, lines: Callable[[str, str], Iterable[str]]) -> str:
    """URL of a service that runs until the driver ends; lines(start, stop) gives the data of a period, which a request keeps within a year."""
    server = http.server.ThreadingHTTPServer((host, 0), _Handler)
    server.info, server.lines = info, lines
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://{host}:{server.server_port}"
