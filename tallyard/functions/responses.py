"""Readers of model responses kept as JSON text: typed values or a schema failure, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a response can fail although it arrived.
SCHEMA_FAILURE, CAP_FAILURE, REFUSAL_FAILURE = "response/schema_failure", "configuration/output_cap_truncation", "response/safety_refusal"
# Finish reasons of an answer cut at the output cap, and of one withheld for safety.
CAP_REASONS, SAFETY_REASONS = ("length", "max_tokens"), ("content_filter", "safety")
#: Where the fields of a response lie.
PATHS = {
    "content": "$.choices[0].message.content",
    "refusal": "$.choices[0].message.refusal",
    "finish_reason": "$.choices[0].finish_reason",
    "model": "$.model",
    "response_id": "$.id",
    "input_tokens": "$.usage.prompt_tokens",
    "output_tokens": "$.usage.completion_tokens",
}


def _kind(value: Column, path: str) -> Column:
    """The type of what lies at path: null where nothing does, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def optional_string(value: Column, path: str) -> Column:
    """The text at path of a variant; null where there is none, an empty one or another type."""
    return F.when(_kind(value, path) == "STRING", F.nullif(F.try_variant_get(value, path, "string"), F.lit("")))


def token_count(value: Column, path: str) -> Column:
    """struct(value, wrong): a count at path that is a whole number of zero or more; nothing or null there is no fault."""
    kind, number = _kind(value, path), F.try_variant_get(value, path, "bigint")
    fine = (kind == "BIGINT") & (number >= 0)
    return F.struct(F.when(fine, number).alias("value"), (kind.isNotNull() & (kind != "VOID") & ~F.coalesce(fine, F.lit(False))).alias("wrong"))


def content_text(value: Column, path: str) -> Column:
    """The text at path, or the texts of a list of parts there, joined by line ends; null if it is neither or a part is no object or none has a text."""
    kind = _kind(value, path)
    parts = F.try_variant_get(value, path, "array<variant>")
    objects = F.forall(parts, lambda p: F.schema_of_variant(p).startswith("OBJECT"))
    texts = F.filter(F.transform(parts, lambda p: F.when(_kind(p, "$.text") == "STRING", F.try_variant_get(p, "$.text", "string"))), lambda t: t.isNotNull())
    joined = F.when(kind.startswith("ARRAY") & objects & (F.size(texts) > 0), F.array_join(texts, "\n"))
    return F.when(kind == "STRING", F.try_variant_get(value, path, "string")).otherwise(joined)


def read_response(body: Column, paths: dict[str, str] | None = None) -> Column:
    """struct(text, finish_reason, model, response_id, input_tokens, output_tokens, failure) of a response body in JSON.

    failure is, in this order: a schema failure for what is no JSON object or has a count that is none; the output cap, even
    if a whole text is there; a refusal, by finish reason or a refusal text; a schema failure without content.
    """
    at = PATHS | (paths or {})
    value = F.try_parse_json(body)
    counts = {c: token_count(value, at[c]) for c in ("input_tokens", "output_tokens")}
    finish, text = optional_string(value, at["finish_reason"]), content_text(value, at["content"])
    wrong = counts["input_tokens"]["wrong"] | counts["output_tokens"]["wrong"]
    failure = (
        F.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT") | wrong, SCHEMA_FAILURE)
        .when(finish.isin(*CAP_REASONS), CAP_FAILURE)
        .when(finish.isin(*SAFETY_REASONS) | optional_string(value, at["refusal"]).isNotNull(), REFUSAL_FAILURE)
        .when(text.isNull(), SCHEMA_FAILURE)
    )
    return F.struct(
        F.when(failure.isNull(), text).alias("text"),
        finish.alias("finish_reason"),
        optional_string(value, at["model"]).alias("model"),
        optional_string(value, at["response_id"]).alias("response_id"),
        *[counts[c]["value"].alias(c) for c in counts],
        failure.alias("failure"),
    )
