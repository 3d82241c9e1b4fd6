"""A small HTTP facade over one session: POST /v1/score, /v1/score/batch, /v1/compare and /v1/report with JSON bodies of up to 1 MiB.

400 for what is no JSON object or length, 404 for other paths, 413 for large
bodies, 422 for bodies that don't hold what is needed, 500 without details
for everything else. PDF reports come as base64.
"""

from __future__ import annotations

import base64
import json
import sys
import traceback
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.operators import population, score
from veilgauge.plans import reports
from veilgauge.schema import Settings
from veilgauge.session import cut
from veilgauge.sources import tables

LIMIT = 1 << 20


def _texts(body: dict, key: str) -> list[str]:
    texts = body.get(key)
    if not isinstance(texts, list) or not texts or not all(isinstance(t, str) for t in texts):
        raise ValueError(f"'{key}' must be an array of texts that is not empty")
    return texts


def _text(body: dict, key: str) -> str:
    if not isinstance(body.get(key), str):
        raise ValueError(f"'{key}' must be a text")
    return body[key]


def answer(spark: SparkSession, path: str, body: dict, settings: Settings = Settings(), cells: DataFrame | None = None) -> dict:
    """The result of a request; LookupError for an unknown path, ValueError for a bad body."""
    path = path.removeprefix("/v1")
    if path in ("/batch", "/score/batch"):
        texts = _texts(body, "texts")
    elif path == "/score":
        texts = [_text(body, "text")]
    elif path == "/compare":
        texts = [_text(body, "original"), _text(body, "anonymized")]
    elif path == "/report":
        items = body.get("results")
        texts = _texts({"results": [x.get("text") for x in items if isinstance(x, dict)]} if isinstance(items, list) else body, "results" if isinstance(items, list) else "texts")
        standard, kind = str(body.get("standard", "gdpr")).lower(), str(body.get("format", "json")).lower()
        if standard not in reports.STANDARDS or kind not in reports.FORMATS:
            raise ValueError(f"'standard' must be one of {', '.join(reports.STANDARDS)}, 'format' one of {', '.join(reports.FORMATS)}")
    else:
        raise LookupError(path)
    own = replace(settings, geography=body.get("geography", settings.geography))
    scored = cut(score.score(tables.texts(spark, texts), cells if cells is not None else population.sample_for(spark, own.geography), "idx", settings=own))
    score.collected(scored, "idx")
    summary = score.summarize(scored).first().asDict()
    if path == "/compare":
        sides = scored.withColumn("side", F.when(F.col("idx") == 0, "before").otherwise("after")).withColumn("pair_id", F.lit(1))
        return json.loads(tables.as_json(score.compare(sides)).first()["json"])
    if path == "/report":
        made = reports.generate(scored, summary, standard, kind)
        if isinstance(made, bytes):
            return {"report_base64": base64.b64encode(made).decode(), "encoding": "base64"}
        return json.loads(made) if kind == "json" else {"report": made}
    rows = [json.loads(r["json"]) for r in tables.as_json(scored.orderBy("idx")).collect()]
    return rows[0] if path == "/score" else {"results": rows, "summary": summary}


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8080, settings: Settings = Settings(), cells: DataFrame | None = None) -> ThreadingHTTPServer:
    """A server that is ready to `serve_forever`."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            try:
                length = int(self.headers.get("Content-Length") or 0)
            except ValueError:
                length = -1
            if length < 0:
                self.close_connection = True
                return self._send(400, {"error": "the length of the body is no number"})
            if length > LIMIT:
                self.close_connection = True
                left = min(length, 16 * LIMIT)
                while left > 0 and (part := self.rfile.read(min(left, 1 << 16))):  # so that the client can read the answer
                    left -= len(part)
                return self._send(413, {"error": "the body is larger than 1 MiB"})
            try:
                body = json.loads(self.rfile.read(length) or b"{}")
            except ValueError:
                return self._send(400, {"error": "the body is no JSON"})
            if not isinstance(body, dict):
                return self._send(400, {"error": "the body must be an object"})
            try:
                self._send(200, answer(spark, self.path, body, settings, cells))
            except LookupError:
                self._send(404, {"error": "no such path"})
            except ValueError as e:
                self._send(422, {"error": str(e)})
            except Exception:  # noqa: BLE001  what went wrong inside is for the log only
                traceback.print_exc(file=sys.stderr)
                self._send(500, {"error": "internal error"})

        def _send(self, code: int, value: dict) -> None:
            data = json.dumps(value).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
