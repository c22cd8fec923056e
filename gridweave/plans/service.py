"""A small HTTP service: GET /health, GET /fixtures, GET /fixtures/<name>, POST /plan, and OPTIONS for browsers.

python -m gridweave.plans.service --host 127.0.0.1 --port 8000 --base-dir /data/plans

Relative paths in a request are below the folder of the header X-Plan-Base-Dir,
else of --base-dir, else of the environment variable PLAN_BASE_DIR, else the
working folder.  Fixtures are the JSON requests in that folder.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from gridweave.plans.planner import PlanRequestError, run_plan

HEADER, VARIABLE = "X-Plan-Base-Dir", "PLAN_BASE_DIR"
#: Largest request body.
MOST_BYTES = 16 << 20
CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": f"Content-Type, {HEADER}"}


def base_folder(headers: Mapping[str, str], given: str | None = None) -> str:
    return headers.get(HEADER) or given or os.environ.get(VARIABLE) or os.getcwd()


def fixture_names(folder: str) -> list[str]:
    return sorted(n[:-5] for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []


def answer(method: str, path: str, body: bytes, plan: Callable[[str], dict], folder: str = ".") -> tuple[int, dict | list]:
    """(status, document): 422 with codes for faulty requests, 500 for anything else that fails."""
    if method == "OPTIONS":
        return 204, {}
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    if method == "GET" and path.startswith("/fixtures"):
        names, name = fixture_names(folder), path.removeprefix("/fixtures").strip("/")
        if not name:
            return 200, {"fixtures": names}
        if name in names:  # a listed name, so no path can leave the folder
            with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
                return 200, json.load(f)
    if (method, path) != ("POST", "/plan"):
        return 404, {"detail": "not found"}
    if len(body) > MOST_BYTES:
        return 413, {"detail": "request too large"}
    try:
        return 200, plan(body.decode("utf-8", "replace"))
    except PlanRequestError as e:
        return 422, {"errors": [{"code": e.code, "message": str(e)}]}
    except Exception:
        logging.exception("a plan failed")
        return 500, {"detail": "internal error"}


def planned(spark: SparkSession, text: str, folder: str) -> dict:
    """A plan of a request's text, which is never taken for the name of a file."""
    if not text.lstrip().startswith("{"):
        raise PlanRequestError("invalid_request", "the body must be a JSON object")
    return run_plan(spark, text, folder)


def create_server(spark: SparkSession, host: str, port: int, base_dir: str | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(size, MOST_BYTES + 1))
            folder = base_folder(self.headers, base_dir)
            status, document = answer(self.command, self.path, body, lambda text: planned(spark, text, folder), folder)
            data = b"" if status == 204 else json.dumps(document, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in {"Content-Type": "application/json", **CORS, "Content-Length": str(len(data))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_OPTIONS = reply

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8000)
    parser.add_argument("--base-dir")
    args = parser.parse_args()
    create_server(SparkSession.builder.getOrCreate(), args.host, args.port, args.base_dir).serve_forever()


if __name__ == "__main__":
    main()
