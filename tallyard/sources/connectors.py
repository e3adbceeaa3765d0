"""Calls to external models from executors, behind an injected transport; no network is used unless one is injected."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers that may be kept, and the form of their values.
SAFE_HEADERS = (
    "retry-after", "ratelimit-limit", "ratelimit-remaining", "ratelimit-reset", "x-ratelimit-limit-requests", "x-ratelimit-limit-tokens",
    "x-ratelimit-remaining-requests", "x-ratelimit-remaining-tokens", "x-ratelimit-reset-requests", "x-ratelimit-reset-tokens",
)
SAFE_VALUE = r"[A-Za-z0-9 .,:+/_-]{1,256}"
# The form of an error field that may be kept, and beginnings of secrets.
SAFE_FIELD = r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}"
SECRET_BEGINNINGS = ("sk-", "gsk_", "nvapi-", "AIza")
MAX_ERROR_BYTES = 131_072
# Failures by a provider's error code, by HTTP status, and by a range of statuses.
CODE_FAILURES = {
    "insufficient_quota": "configuration/quota_exhaustion",
    "quota_exceeded": "configuration/quota_exhaustion",
    "billing_hard_limit_reached": "configuration/quota_exhaustion",
    "model_not_found": "configuration/nonexistent_model",
    "unknown_model": "configuration/nonexistent_model",
}
STATUS_FAILURES = {
    400: "configuration/malformed_request",
    401: "configuration/authentication",
    402: "configuration/quota_exhaustion",
    403: "configuration/authentication",
    404: "configuration/nonexistent_model",
    405: "configuration/malformed_request",
    408: "transport/timeout",
    409: "configuration/malformed_request",
    415: "configuration/malformed_request",
    422: "configuration/malformed_request",
    429: "provider/http_429",
    504: "transport/timeout",
}
SERVER_FAILURE, OTHER_FAILURE = "provider/http_5xx", "provider/http_error"
RESPONSE = "call_id string, attempt_index int, status string, http_status int, raw_output string, finish_reason string, input_tokens bigint, output_tokens bigint, error string"


class Transport(Protocol):
    """One attempt: a request record to a response record with the fields of RESPONSE that apply."""

    def send(self, request: dict) -> dict: ...


def load_factory(name: str) -> Callable[[], Transport]:
    """The callable that 'module:function' names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class EchoTransport:
    """An offline stand-in that answers YES to prompts of even length and NO to others."""

    def send(self, request: dict) -> dict:
        text = "YES" if len(request.get("prompt") or "") % 2 == 0 else "NO"
        return {"status": "success", "http_status": 200, "raw_output": text, "finish_reason": "stop", "input_tokens": len(request.get("prompt") or "") // 4, "output_tokens": 1}


def offline() -> EchoTransport:
    return EchoTransport()


def call_models(requests: DataFrame, factory: str = "tallyard.sources.connectors:offline", attempts: int = 4, waits: tuple[float, ...] = (1.0, 2.0, 4.0), retryable: tuple[str, ...] = ("transport", "transport/timeout", "provider/http_429", "provider/http_5xx"), sleep: Callable[[float], None] = time.sleep, jitter: Callable[[float], float] = float, on_attempt: Callable[[dict], None] | None = None) -> DataFrame:
    """Every attempt of every request (call_id, prompt, ...) as a row of RESPONSE, made where the requests are.

    A response whose error is retryable is tried again after the next wait, up to attempts times; every attempt
    is a row. jitter turns a wait into the one that is slept; on_attempt is told each attempt's row where it is made.
    A transport that raises gives an attempt with status failure and its error's class name. Tasks that
    Spark runs again would repeat calls, so run with spark.task.maxFailures=1 and without speculation.
    """
    fields = [f.strip().split(" ")[0] for f in RESPONSE.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = load_factory(factory)()
        for batch in batches:
            rows = []
            for request in batch.to_dict("records"):
                for i in range(attempts):
                    try:
                        answer = transport.send(request)
                    except Exception as problem:  # noqa: BLE001
                        answer = {"status": "failure", "error": getattr(problem, "code", type(problem).__name__)}
                    rows.append({"call_id": request["call_id"], "attempt_index": i} | {f: answer.get(f) for f in fields[2:]})
                    if on_attempt:
                        on_attempt(rows[-1])
                    if answer.get("status") == "success" or answer.get("error") not in retryable or i + 1 == attempts:
                        break
                    sleep(jitter(waits[min(i, len(waits) - 1)]))
            yield pd.DataFrame(rows, columns=fields)

    return requests.mapInPandas(run, RESPONSE)


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def failure_class(http_status: Column, provider_code: Column) -> Column:
    """The kind of a failed response, looked up by the provider's code (in any case) and else by its status; null without a status."""
    by_code = F.try_element_at(_table(CODE_FAILURES), F.lower(provider_code))
    by_status = F.try_element_at(_table(STATUS_FAILURES), http_status.cast("int"))
    known = F.coalesce(by_code, by_status, F.when(F.floor(http_status / 100) == 5, SERVER_FAILURE), F.lit(OTHER_FAILURE))
    return F.when(http_status.isNotNull() | by_code.isNotNull(), known)


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, given as a number or an HTTP date; never below zero; null if unreadable."""
    plain = F.trim(value)
    number = F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(plain, r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(number, (F.unix_micros(date) - F.unix_micros(now)) / 1e6)
    return F.when(seconds < 0, 0.0).otherwise(seconds)


def safe_headers(headers: Column) -> Column:
    """The headers that are on the list and whose values have the safe form, names lower-cased."""
    kept = F.map_filter(headers, lambda k, v: F.lower(k).isin(*SAFE_HEADERS) & v.rlike(rf"\A{SAFE_VALUE}\z"))
    return F.transform_keys(kept, lambda k, _: F.lower(k))


def error_fields(body: Column) -> Column:
    """struct(code, type, param) of an error body: of its error object, or of the first of its errors.

    A status stands in for a missing code or type. Values that are no short plain word or look like a secret are
    null, as all are for a body that is too long or no such object.
    """
    field = "struct<code: string, type: string, param: string, status: string>"
    short = F.when(F.octet_length(body) <= MAX_ERROR_BYTES, body)
    read = F.from_json(short, f"error {field}, errors array<{field}>")
    error = F.coalesce(read["error"], F.try_element_at(read["errors"], F.lit(1)))
    clean = lambda c: F.when(c.rlike(rf"\A{SAFE_FIELD}\z") & ~c.rlike("^(" + "|".join(SECRET_BEGINNINGS) + ")"), c)
    filled = lambda c: F.coalesce(F.nullif(error[c], F.lit("")), error["status"])
    return F.struct(clean(filled("code")).alias("code"), clean(filled("type")).alias("type"), clean(error["param"]).alias("param"))
