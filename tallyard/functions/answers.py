"""Parsers of model replies as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyard.functions.text import LINES, WS

LABELS = ("YES", "NO")
# What a parser did to a reply before it read the label.
TRIMMED, UNFENCED, RECASED = "trim_surrounding_whitespace", "remove_markdown_code_fence", "canonicalize_label_case"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _opened(raw: Column) -> Column:
    """struct(text, trace): raw without outer white space and without one enclosing code fence, and which of the two it had."""

    def lined(text: Column, lines: Column) -> Column:
        fenced = F.startswith(text, F.lit("```")) & (F.size(lines) >= 2) & (_strip(F.element_at(lines, -1)) == "```")
        body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
        done = lambda x: F.array_compact(F.array(F.when(text != raw, TRIMMED), F.when(x, UNFENCED)))
        return _let(fenced, lambda x: F.struct(F.when(x, body).otherwise(text).alias("text"), done(x).alias("trace")))

    return _let(_strip(raw), lambda text: _let(F.split(text, LINES), lambda lines: lined(text, lines)))


def unfenced(raw: Column) -> Column:
    """raw without outer white space and without one enclosing code fence."""
    return _opened(raw)["text"]


def _result(answer: Column, failure: Column, trace: Column) -> Column:
    return F.struct(answer.alias("answer"), failure.alias("failure"), trace.alias("trace"))


def _nothing(trace: Column | None = None) -> Column:
    return _result(F.lit("INVALID"), F.lit("response/empty_content"), F.array().cast("array<string>") if trace is None else trace)


def _labelled(label: Column, failure: Column, trace: Column) -> Column:
    """The result for a label as written; failure is null where it may be read."""

    def judged(plain: Column, wrong: Column) -> Column:
        cased = F.when(wrong.isNull() & (label != plain), F.array_append(trace, F.lit(RECASED))).otherwise(trace)
        return _result(F.when(wrong.isNull(), plain).otherwise("INVALID"), wrong, cased)

    def told(plain: Column) -> Column:
        return _let(F.coalesce(failure, F.when(plain.isNull() | ~plain.isin(*LABELS), "invalid_label")), lambda wrong: judged(plain, wrong))

    return _let(F.upper(_strip(label)), told)


def _empty(raw: Column) -> Column:
    return raw.isNull() | ~raw.rlike(f"(?s)[^{WS[1:-1]}]")


def parse_yes_no(raw: Column) -> Column:
    """struct(answer, failure, trace) of the strict YES or NO on the last non-empty line.

    answer is YES, NO or INVALID; failure is null, invalid_label, or response/empty_content where nothing but white
    space is left, also inside a code fence; trace names what was trimmed, unfenced or recased, in that order.
    """

    def judged(opened: Column) -> Column:
        last = F.try_element_at(F.filter(F.transform(F.split(opened["text"], LINES), _strip), lambda x: x != ""), F.lit(-1))
        return _let(last, lambda x: F.when(x.isNull(), _nothing(opened["trace"])).otherwise(_labelled(x, F.lit(None).cast("string"), opened["trace"])))

    return F.when(_empty(raw), _nothing()).otherwise(_let(_opened(raw), judged))


def parse_structured(raw: Column, field: str = "answer") -> Column:
    """struct(answer, failure, trace) of a JSON object that has the field, with or without a code fence around it.

    Other keys do not matter. failure is parse_failure for what is no JSON, schema_failure for what is no object or
    lacks the field, invalid_label for a field that is no YES or NO in text, response/empty_content for an empty reply.
    """
    path = f"$['{field}']"

    def judged(opened: Column) -> Column:
        return _let(F.regexp_replace(opened["text"], "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""), lambda text: read(text, opened["trace"]))

    def read(text: Column, trace: Column) -> Column:
        # the parser passes over what follows a value; no text that goes on fits into both an array and an object
        whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))).isNotNull()
        failure = _let(whole, lambda w: F.when(~w, "parse_failure").otherwise(_let(F.json_object_keys(F.when(F.startswith(text, F.lit("{")), text)), lambda keys: F.when(keys.isNull() | ~F.array_contains(keys, field), "schema_failure"))))
        return _let(F.get_json_object(text, path), lambda label: _labelled(label, failure, trace))

    return F.when(_empty(raw), _nothing()).otherwise(_let(_opened(raw), judged))
