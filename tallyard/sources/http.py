"""A transport over HTTP for call_models: one POST an attempt, with a timeout and a size cap."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from tallyard.sources.connectors import CODE_FAILURES, MAX_ERROR_BYTES, OTHER_FAILURE, SERVER_FAILURE, STATUS_FAILURES

MAX_RESPONSE_BYTES = 10_000_000


def failure_code(status: int, provider_code: str | None) -> str:
    """What connectors.failure_class says, for one attempt in Python."""
    by_status = STATUS_FAILURES.get(status, SERVER_FAILURE if status // 100 == 5 else OTHER_FAILURE)
    return CODE_FAILURES.get((provider_code or "").lower(), by_status)


def _provider_code(body: bytes) -> str | None:
    try:
        error = json.loads(body)["error"] if len(body) <= MAX_ERROR_BYTES else {}
        return str(error.get("code") or error.get("status") or "") or None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


class HttpTransport:
    """POSTs a request's payload, a JSON text, and hands back the response's JSON text as raw_output; no retries.

    A status other than 2xx, a timeout, a lost connection, a body over max_bytes or one that is no JSON object gives
    status failure with its code as error. Nothing of the request's headers comes back.
    """

    def __init__(self, url: str, headers: dict[str, str] | None = None, timeout: float = 120.0, max_bytes: int = MAX_RESPONSE_BYTES):
        if timeout <= 0 or max_bytes <= 0:
            raise ValueError("timeout and max_bytes must be positive")
        self.url, self.headers, self.timeout, self.max_bytes = url, headers or {}, timeout, max_bytes

    def send(self, request: dict) -> dict:
        body = request["payload"].encode()
        post = urllib.request.Request(self.url, data=body, method="POST", headers={"Accept": "application/json", "Content-Type": "application/json"} | self.headers)
        failed = lambda code, status=None: {"status": "failure", "http_status": status, "error": code}
        try:
            with urllib.request.urlopen(post, timeout=self.timeout) as answer:
                status, raw = int(answer.status), answer.read(self.max_bytes + 1)
        except urllib.error.HTTPError as problem:
            with problem:
                return failed(failure_code(problem.code, _provider_code(problem.read(MAX_ERROR_BYTES + 1))), problem.code)
        except TimeoutError:
            return failed("transport/timeout")
        except OSError as problem:
            return failed("transport/timeout" if isinstance(getattr(problem, "reason", None), TimeoutError) else "transport")
        try:
            text = raw.decode()
            if len(raw) > self.max_bytes or not isinstance(json.loads(text), dict):
                return failed("response/schema_failure", status)
        except ValueError:
            return failed("response/schema_failure", status)
        return {"status": "success", "http_status": status, "raw_output": text}
