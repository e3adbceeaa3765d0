import http.server
import io
import json
import os
import threading
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyard import sinks
from tallyard.sources import collections, connectors
from tallyard.streaming import attempts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_zip(spark, tmp_path):
    path = tmp_path / "a.zip"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("d.json", json.dumps([{"a": 1, "b": "x"}, {"a": "no", "c": 1}]))
    path.write_bytes(data.getvalue())
    assert rows(collections.read_zip_json(spark, str(path), "d.json", "a int, b string")) == [(0, 1, "x"), (1, None, None)]
    with pytest.raises(collections.ChecksumError):
        collections.read_zip_json(spark, str(path), "d.json", "a int", "0" * 64)


def test_items_are_closed(spark, tmp_path):
    good = {"item_id": "1", "background": "b", "given_info": "g", "question": "q"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([good]))
    (tmp_path / "c.json").write_text(json.dumps({"items": [good, good]}))
    (tmp_path / "bad.jsonl").write_text(json.dumps(good | {"answer": "yes"}) + "\n")
    assert [collections.read_items(spark, str(tmp_path / n)).count() for n in ("a.jsonl", "b.json", "c.json")] == [1, 1, 2]
    with pytest.raises(Exception, match="unexpected keys"):
        collections.read_items(spark, str(tmp_path / "bad.jsonl")).collect()


def test_view_must_match_sidecar(spark, tmp_path):
    import hashlib

    body = json.dumps({"items": [{"item_id": "1", "background": "b", "given_info": "g", "question": "q"}]}).encode()
    (tmp_path / "v.json").write_bytes(body)
    (tmp_path / "s.json").write_text(json.dumps({"inference_view_sha256": hashlib.sha256(body).hexdigest(), "item_count": 1}))
    assert collections.read_view(spark, str(tmp_path / "v.json"), str(tmp_path / "s.json")).count() == 1
    (tmp_path / "v.json").write_bytes(body + b" ")
    with pytest.raises(collections.ChecksumError):
        collections.read_view(spark, str(tmp_path / "v.json"), str(tmp_path / "s.json"))


def test_hidden_fields_at_any_depth(spark):
    df = spark.createDataFrame([(1, ("yes", 2), [("no", 3)])], "i int, meta struct<answer: string, rung: int>, l array<struct<gold: string, n: int>>")
    assert collections.without_fields(df, ("answer", "gold")).schema.simpleString() == "struct<i:int,meta:struct<rung:int>,l:array<struct<n:int>>>"


def test_run_folder(spark, tmp_path):
    run = tmp_path / "run"
    (run / "calls" / "A").mkdir(parents=True)
    (run / "calls" / "A" / "x.json").write_text(json.dumps({"call_id": "x", "n": 1}))
    (run / "calls" / "A" / "y.json").write_text(json.dumps({"call_id": "z", "n": 2}))
    got = collections.read_run_records(spark, str(run), "calls", "call_id string, n int")
    assert rows(got.select("call_id", "group", "stem_matches")) == [("x", "A", True), ("z", "A", False)]
    assert rows(collections.unexpected_files(spark, str(run), r"calls/A/x\.json")) == [("calls/A/y.json",)]
    import hashlib

    text = "".join(f"calls/A/{n}.json\0{hashlib.sha256((run / 'calls/A' / (n + '.json')).read_bytes()).hexdigest()}\n" for n in "xy")
    assert rows(collections.tree_digest(spark, str(run))) == [(2, hashlib.sha256(text.encode()).hexdigest())]
    sinks.freeze(spark, str(run))
    assert sinks.changed_since_freeze(spark, str(run)).count() == 0
    (run / "calls" / "A" / "y.json").write_text("{}")
    assert [r["change"] for r in sinks.changed_since_freeze(spark, str(run)).collect()] == ["altered"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.freeze(spark, str(run))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.replace_only(df, path)
    sinks.create_only(df, path)
    sinks.replace_only(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.create_only(df, path)
    assert sinks.write_once(spark, b"x", path + ".f") and not sinks.write_once(spark, b"x", path + ".f")
    with pytest.raises(FileExistsError):
        sinks.write_once(spark, b"y", path + ".f")
    sinks.write_once(spark, b"z", f"file://{path}.g")
    with open(path + ".g", "rb") as f:
        assert f.read() == b"z" and not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]
    sinks.project(df.withColumn("gold", F.lit("YES")), ["a"], path + "p")
    assert spark.read.json(path + "p").columns == ["a"]
    sinks.swap_in({"one": df}, path + "s")
    with pytest.raises(FileExistsError):
        sinks.swap_in({"one": df}, path + "s")
    with pytest.raises(Exception):  # noqa: B017
        sinks.swap_in({"one": df.select(F.raise_error(F.lit("no")).alias("a"))}, path + "s", overwrite=True)
    assert spark.read.json(path + "s/one").count() == 1 and len([n for n in os.listdir(tmp_path) if "staging" in n or ".old" in n]) == 0
    names = [os.path.basename(sinks.append_session(spark, path + "j", {"n": i})) for i in range(2)]
    assert names == ["session-0001.json", "session-0002.json"]
    assert sinks.canonical_json({"b": "é", "a": 1}) == '{\n  "a": 1,\n  "b": "é"\n}\n'.encode()
    counts = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "value string, n int")
    assert sinks.markdown_counts(counts, "T").splitlines()[4:] == ["| c | 5 |", "| a | 1 |", "| b | 1 |"]


class Flaky:
    def __init__(self):
        self.n = 0

    def send(self, request):
        self.n += 1
        if request["prompt"] == "down" or self.n % 2:
            return {"status": "failure", "error": "transport", "http_status": 503}
        return {"status": "success", "http_status": 200, "raw_output": "YES"}


def flaky():
    return Flaky()


def test_model_calls(spark):
    df = spark.createDataFrame([("a", "up"), ("b", "down")], "call_id string, prompt string").coalesce(1)
    got = rows(connectors.call_models(df, "tests.test_io:flaky", waits=(0.0,)).select("call_id", "attempt_index", "status"))
    assert got == [("a", 0, "failure"), ("a", 1, "success"), *[("b", i, "failure") for i in range(4)]]
    assert connectors.call_models(df).count() == 2


def test_http_expressions(spark):
    meant = {
        (402, None): "configuration/quota_exhaustion", (403, "x"): "configuration/authentication", (404, None): "configuration/nonexistent_model", (422, None): "configuration/malformed_request",
        (429, "BILLING_hard_limit_reached"): "configuration/quota_exhaustion", (503, "unknown_model"): "configuration/nonexistent_model", (408, None): "transport/timeout", (429, None): "provider/http_429",
        (599, None): "provider/http_5xx", (600, None): "provider/http_error", (418, None): "provider/http_error", (302, None): "provider/http_error",
    }
    df = spark.createDataFrame(list(meant), "s int, c string")
    assert [r[0] for r in df.select(connectors.failure_class(F.col("s"), F.col("c"))).collect()] == list(meant.values())
    assert df.limit(1).select(connectors.failure_class(F.lit(None).cast("int"), F.lit(None).cast("string"))).head()[0] is None
    waits = spark.createDataFrame([("2.5",), ("-3",), ("Thu, 01 Jan 2026 00:00:10 GMT",), ("soon",), (None,)], "v string")
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    assert [r[0] for r in waits.select(connectors.retry_after_seconds(F.col("v"), now)).collect()] == [2.5, 0.0, 10.0, None, None]
    heads = spark.createDataFrame([({"X-RateLimit-Limit-Tokens": "6000", "Authorization": "x", "Retry-After": "<b>", "ratelimit-reset": "4s\n", "Date": "now"},)], "h map<string,string>")
    assert heads.select(connectors.safe_headers(F.col("h"))).head()[0] == {"x-ratelimit-limit-tokens": "6000"}
    body = spark.createDataFrame([('{"error": {"code": 17, "type": "sk-12345", "param": null}}',), ("no",), ('{"errors": [{"status": "DENIED", "param": "a b"}]}',), ('{"error": {"code": "' + "x" * 140000 + '"}}',)], "b string")
    assert [tuple(r[0]) for r in body.select(connectors.error_fields(F.col("b"))).collect()] == [("17", None, None), (None, None, None), ("DENIED", "DENIED", None), (None, None, None)]


def attempt(call, i, status, minute, tokens=1):
    return {"call_id": call, "attempt_index": i, "run_id": "r", "provider": "p", "status": status, "total_tokens": tokens, "timestamp_utc": f"2026-01-01T00:{minute:02d}:10Z"}


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = [attempt("a", 0, "failure", 1), attempt("a", 1, "success", 1), attempt("a", 1, "success", 2), attempt("b", 0, "failure", 2), attempt("c", 0, "success", 59)]
    for i, part in enumerate((data[:3], data[3:], [attempt("z", 0, "success", 59)])):
        pd.DataFrame(part).to_json(folder / f"{i}.json", orient="records", lines=True)
    stream = attempts.read_attempts(spark, str(folder))

    def collect(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        return rows(spark.table(name))

    assert len(collect(attempts.once_each(stream), "once")) == 5
    windows = collect(attempts.rate_windows(stream), "windows")
    assert [(w[0].minute, w[2]) for w in windows] == [(1, 2), (2, 2)]
    done = collect(attempts.call_outcomes(stream, "5 minutes"), "done")
    assert ("a", 3, "success") in done and ("c", 1, "success") in done


class Answers(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if sent.get("wait"):
            time.sleep(1.5)
        body = sent["reply"].encode()
        self.send_response(sent.get("status", 200))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http_transport():
    from tallyard.sources.http import HttpTransport

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    transport = HttpTransport(f"http://127.0.0.1:{server.server_port}/x", timeout=0.5, max_bytes=60)
    send = lambda **x: transport.send({"call_id": "c", "payload": json.dumps(x)})
    assert send(reply='{"id": 1}') == {"status": "success", "http_status": 200, "raw_output": '{"id": 1}'}
    assert [send(reply=r)["error"] for r in ("[1]", "no", '{"id": "' + "x" * 60 + '"}')] == ["response/schema_failure"] * 3
    assert send(reply='{"error": {"code": "model_not_found"}}', status=500) == {"status": "failure", "http_status": 500, "error": "configuration/nonexistent_model"}
    assert [send(reply="", status=s)["error"] for s in (429, 503, 410)] == ["provider/http_429", "provider/http_5xx", "provider/http_error"]
    assert send(reply="{}", wait=True)["error"] == "transport/timeout"
    server.shutdown()
    server.server_close()
    assert send(reply="{}")["error"] == "transport"
    with pytest.raises(ValueError):
        HttpTransport("http://127.0.0.1", timeout=0)


def test_responses_fail_closed(spark):
    from tallyard.functions import responses

    choice = lambda c, f="stop", **m: {"id": "r1", "model": "m", "choices": [{"finish_reason": f, "message": {"content": c} | m}], "usage": {"prompt_tokens": 3}}
    bodies = [
        choice("NO"), choice([{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]), choice([{"type": "image"}]), choice(["a"]), choice(None), choice("YES", "length"), choice("YES", "safety"), choice("YES", refusal="no"),
        choice("[1]", refusal=""), {**choice("NO"), "usage": {"prompt_tokens": -1}}, {**choice("NO"), "usage": {"completion_tokens": True}}, {**choice("NO"), "id": 7, "usage": None}, [1], {},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(98, "x"), (99, None)], "i int, b string")
    got = {r["i"]: r["p"] for r in df.select("i", responses.read_response(F.col("b")).alias("p")).collect()}
    schema, cap, refused = "response/schema_failure", "configuration/output_cap_truncation", "response/safety_refusal"
    assert [(got[i]["text"], got[i]["failure"]) for i in range(14)] == [
        ("NO", None), ("a\nb", None), (None, schema), (None, schema), (None, schema), (None, cap), (None, refused), (None, refused), ("[1]", None), (None, schema), (None, schema), ("NO", None), (None, schema), (None, schema),
    ]
    assert got[98]["failure"] == got[99]["failure"] == schema and got[0]["input_tokens"] == 3 and got[0]["output_tokens"] is None and got[11]["response_id"] is None


def test_gold_file(spark, tmp_path):
    path = str(tmp_path / "gold.json")
    write = lambda rows: (tmp_path / "gold.json").write_text(json.dumps(rows))
    write([{"item_id": "a", "answer": "YES"}, {"item_id": "b", "answer": "NO"}])
    assert rows(collections.read_gold(spark, path)) == [("a", "YES"), ("b", "NO")]
    for bad in ([{"item_id": "a", "answer": "yes"}], [{"item_id": "a", "answer": "YES"}] * 2, [{"item_id": None, "answer": "NO"}]):
        write(bad)
        with pytest.raises(ValueError):
            collections.read_gold(spark, path)
    write([{"item_id": "a", "answer": "YES", "rung": 1}])
    with pytest.raises(Exception, match="unexpected keys"):
        collections.read_gold(spark, path)


def test_evidence(spark, tmp_path):
    from tallyard.sources import evidence

    good = {"provider": "p", "schema_version": 1, "smoke_kind": "synthetic_non_benchmark", "status": "success", "parsed_answer": "YES", "http_status": 200, "requested_model_id": "m", "reported_model_id": "m", "contains_raw_output": False, "input_tokens": 1, "output_tokens": 0, "latency_ms": 2.5, "retry_events": []}
    changes = {"a": {}, "b": {}, "c": {"provider": "q"}, "d": {"http_status": 201}, "e": {"reported_model_id": "n", "latency_ms": -1}, "f": {"output_tokens": True}, "g": {"retry_events": None}, "h": {"contains_raw_output": True}, "i": {"latency_ms": -1}}
    for name, change in changes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(good | change))
    (tmp_path / "z.json").write_text("[]")
    roster = spark.createDataFrame([("p", "m"), ("o", "k")], "provider string, model_id string")
    reports = evidence.read_evidence(spark, str(tmp_path), roster)
    assert {r["path"][-6]: r["reason"] for r in reports.collect()} == {"a": None, "b": None, "c": "unknown_provider", "d": "wrong_http_status", "e": "wrong_reported_model_id", "f": "wrong_output_tokens", "g": "wrong_retry_events", "h": "wrong_contains_raw_output", "i": "wrong_latency_ms", "z": "unreadable"}
    accepted = evidence.last_accepted(reports)
    assert [r["path"][-6:] for r in accepted.collect()] == ["b.json"]
    assert rows(evidence.missing_providers(roster, accepted)) == [("o",)]


def test_prompts(spark, tmp_path):
    from tallyard.sources import prompts

    bundle = {"prompt_version": "prompt_causal_yesno_v1", "renderer_version": "renderer_v1", "system_instruction": " S ", "task_instruction": " ", "role_instructions": {"critic": "C"}, "output_instructions": {"critic_card": "O"}, "final_answer_instruction": "F"}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    assert prompts.read_bundle(spark, str(tmp_path / "b.json")) == bundle
    for bad in (bundle | {"more": 1}, bundle | {"renderer_version": "2"}, bundle | {"role_instructions": {}}):
        (tmp_path / "c.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            prompts.read_bundle(spark, str(tmp_path / "c.json"))
    item = ("B", None, "Is it?")
    data = [("a", "critic", "critic_card", True, ["x", "y"], *item), ("b", "judge", "critic_card", False, None, *item), ("c", "critic", "critic_card", False, ["x", " "], *item), ("d", "critic", "critic_card", False, [], "rung", "Answer: yes", "q"), ("e", "critic", "critic_card", False, None, *item)]
    df = spark.createDataFrame(data, "call_id string, role string, output_schema string, final boolean, cards array<string>, background string, given_info string, question string")
    got = {r["call_id"]: (r["prompt"], r["problem"]) for r in prompts.render_prompts(df, bundle).collect()}
    middle = "CAUSAL QUESTION CONTEXT\nBACKGROUND\nB\n\nGIVEN INFORMATION\n\n\nQUESTION\nIs it?"
    cards = "\n\n".join(f"--- BEGIN UNTRUSTED CARD {i} ---\n{c}\n--- END UNTRUSTED CARD {i} ---" for i, c in ((1, "x"), (2, "y")))
    assert got["a"] == (f"S\n\nC\n\n{middle}\n\n{prompts.CARDS_HEAD}{cards}\n\nO\n\nF\n", None)
    assert got["e"] == (f"S\n\nC\n\n{middle}\n\nO\n", None)
    assert {k: p for k, (_, p) in got.items() if p} == {"b": "unknown_role_or_output", "c": "blank_card", "d": "leak"}
    kinds = spark.createDataFrame([("A3_SINGLE_V1", "analyst"), ("C3_COUNCIL_V1", "analyst"), ("C5_COUNCIL_V1", "formal_numerical_critic"), ("C5_COUNCIL_V1", "adjudicator")], "c string, r string")
    assert [r[0] for r in kinds.select(prompts.output_schema(F.col("c"), F.col("r"))).collect()] == ["single_answer", "analyst_card", "critic_card", "adjudicator_record"]
