import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyard.functions import answers, text
from tallyard.operators import allocation, audit, calls, components, families, ranking, runlog, scoring, views


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SAMPLES = ["", " ", "a b\x1c c", "İx  Y", " lead", "tab\tnew\nline sep", "ß ΣΑΣ"]


def test_whitespace_and_lines_are_pythons(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r["i"]: r["c"] for r in df.select("i", text.collapse(F.col("s")).alias("c")).collect()}
    assert got == {i: " ".join(s.split()) for i, s in enumerate(SAMPLES)}
    split = df.select("i", F.filter(F.split("s", text.LINES), lambda x: x != "").alias("l")).collect()
    assert {r["i"]: r["l"] for r in split} == {i: [x for x in s.splitlines() if x] for i, s in enumerate(SAMPLES)}


def test_normalise_null(spark):
    df = spark.createDataFrame([(None, " A  b ")], "x string, y string")
    assert df.select(text.normalise(F.col("x"), F.col("y"))).head()[0] == "\na b"
    assert df.select(text.normalise(F.col("x"), F.col("y"), lenient=False)).head()[0] is None


def parsed(spark, parser, replies):
    made = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", parser(F.col("r")).alias("p")).orderBy("i").collect()
    return [(r["p"]["answer"], r["p"]["failure"], list(r["p"]["trace"])) for r in made]


def test_last_line_is_the_label(spark):
    cases = {
        "The backdoor path is blocked.\n\n  Yes\t": ("YES", None, ["trim_surrounding_whitespace", "canonicalize_label_case"]),
        "~~~\nNO": ("NO", None, []),
        "```text\nweighing both arms\nno\n  \n```\n": ("NO", None, ["trim_surrounding_whitespace", "remove_markdown_code_fence", "canonicalize_label_case"]),
        "```\nYES": ("YES", None, []),
        "NO.": ("INVALID", "invalid_label", []),
        "YES\nor NO?": ("INVALID", "invalid_label", []),
        "\u2003YES\u2028": ("YES", None, ["trim_surrounding_whitespace"]),
        "```": ("INVALID", "invalid_label", []),
        "```json\n \n```": ("INVALID", "response/empty_content", ["remove_markdown_code_fence"]),
        "```\n```": ("INVALID", "response/empty_content", ["remove_markdown_code_fence"]),
        "\x1f\n": ("INVALID", "response/empty_content", []),
    }
    assert dict(zip(cases, parsed(spark, answers.parse_yes_no, list(cases)), strict=True)) == cases


def test_structured_field(spark):
    cases = {
        '{"steps": [1, {"answer": "no"}], "answer": " Yes "}': ("YES", None, ["canonicalize_label_case"]),
        '```\n{"answer": "NO"}\n```': ("NO", None, ["remove_markdown_code_fence"]),
        '{"steps": {"answer": "YES"}}': ("INVALID", "schema_failure", []),
        '{"answer": true}': ("INVALID", "invalid_label", []),
        '{"answer": null, "label": "YES"}': ("INVALID", "invalid_label", []),
        "[]": ("INVALID", "schema_failure", []),
        '"NO"': ("INVALID", "schema_failure", []),
        "{answer: NO}": ("INVALID", "parse_failure", []),
        '{"answer": "NO"} {"answer": "NO"}': ("INVALID", "parse_failure", []),
        "12 of 30 rows": ("INVALID", "parse_failure", []),
        "\t": ("INVALID", "response/empty_content", []),
    }
    assert dict(zip(cases, parsed(spark, answers.parse_structured, list(cases)), strict=True)) == cases
    assert parsed(spark, lambda c: answers.parse_structured(c, "verdict"), ['{"verdict": "no", "answer": "YES"}', None]) == [("NO", None, ["canonicalize_label_case"]), ("INVALID", "response/empty_content", [])]


def test_parse_structured_judges_every_reply(spark, tmp_path):
    from tallyard.plans.catalogue import QUERIES

    replies = [None, "", "YES", '["yes"]', '\n{"answer": "yes"}', '```\n{"answer": "no"}\n```', "YES"]
    spark.createDataFrame([(r,) for r in replies], "raw_output string").write.parquet(f"{tmp_path}/event_records.parquet")
    got = {r["raw_output"]: r["failure"] or r["answer"] for r in QUERIES["parse_structured"](spark, str(tmp_path)).collect()}
    assert got == {None: "response/empty_content", "": "response/empty_content", "YES": "parse_failure", '["yes"]': "schema_failure", '\n{"answer": "yes"}': "YES", '```\n{"answer": "no"}\n```': "NO"}


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(i + 1, i) for i in range(70)], "star": [(0, i) for i in range(1, 80)], "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)], "empty": []}[shape]
    got = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"))
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert rows(got) == sorted(((a, b) for a, b in brute_components(edges) if a not in loops), key=repr)


def test_components_over_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK_EDGES", 1)
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 150) for i in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = rows(components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(brute_components(edges), key=repr)


def test_components_of_names(spark):
    edges = [("b", "a"), ("c", "b"), ("é", "z"), ("x", None), ("y", "y")]
    assert rows(components.connected_components(spark.createDataFrame(edges, "u string, v string"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("z", "z"), ("é", "z")]


def test_hot_keys_meet_their_row(spark, monkeypatch):
    from tallyard import runtime

    monkeypatch.setattr(runtime, "hot_limit", lambda total: 5)
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(60)] + [(None, -1)], "k int, x int")
    small = spark.createDataFrame([(0, "hot", 40), (3, "cold", 1)], "k int, y string, n bigint")
    for how in ("inner", "left"):
        assert rows(runtime.skew_safe_join(big, small, ["k"], "n", 61, how)) == rows(big.join(small.drop("n"), "k", how))


def test_key_edges_with_a_hot_key(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None, f"g{i // 2}") for i in range(60)], "i bigint, a string, b string")
    got = components.connected_components(components.key_edges(df, "i", {"a": F.col("a"), "b": F.col("b")}))
    edges = [(0, i) for i in range(3, 60, 3)] + [(i, i + 1) for i in range(0, 60, 2)]
    assert rows(got) == sorted(brute_components(edges), key=repr)


def test_hashed_rank_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 7)
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(400)], "i bigint, g int")
    got = ranking.hashed_rank(df, ["g"], ["i"], 3, 400).toPandas()
    for _, part in got.groupby(got["g"].fillna(-1)):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    again = ranking.hashed_rank(df.repartition(3), ["g"], ["i"], 3, 400).toPandas()
    assert got.set_index("i")["rank"].to_dict() == again.set_index("i")["rank"].to_dict()
    assert rows(ranking.hashed_rank(df.limit(0), ["g"], ["i"], 3, 0)) == []


def test_exact_quantiles(spark):
    rng = random.Random(11)
    data = [("a", float(rng.randrange(40))) for _ in range(500)] + [("b", rng.random()) for _ in range(301)] + [(None, 2.0)] * 9 + [("one", -1.5), ("none", None), ("a", None)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r["quantiles"] for r in ranking.exact_quantiles(df, "g", "x", probs, pieces=8).collect()}
    for g in ("a", "b", None, "one"):
        own = [x for k, x in data if k == g and x is not None]
        assert got[g] == pytest.approx(list(pd.Series(own).quantile(list(probs))))
    assert got["none"] is None and ranking.exact_quantiles(df.limit(0), "g", "x", probs).count() == 0


def items(spark, data):
    return audit.flat_items(spark.createDataFrame(data, "source_index bigint, question_id bigint, desc_id string, given_info string, question string, answer string, meta struct<query_type: string, rung: int, story_id: string, graph_id: string, model_id: string, groundtruth: string>"))


def test_backgrounds_and_duplicates(spark):
    meta = lambda m, r=1: ("ate", r, "s", "g", m, "null")
    source = items(spark, [(0, 5, "d", "G ", "q", "yes", meta("m1")), (1, 2, "d", "g", " Q", "yes", meta("m2")), (2, 9, "d", "g", "q", "no", meta("m3")), (3, 1, "d", "x", None, None, meta("gone")), (4, 3, "d", "y", "q", "no", meta(None))])
    models = spark.createDataFrame([("m1", "same"), ("m2", "same"), ("m2", "same"), ("m3", "one"), ("m3", "two")], "model_id string, background string")
    joined = audit.attach_background(source, models)
    assert dict(rows(joined.select("source_index", "background_state"))) == {0: "found", 1: "found", 2: "conflicting", 3: "missing", 4: "missing"}
    keyed = audit.prompt_hashes(joined)
    assert [r["source_index"] for r in audit.canonical_members(keyed, "prompt_hash").filter("n = 2").collect()] == [1]
    torn = keyed.withColumn("answer", F.when(F.col("source_index") == 1, F.lit(None)).otherwise(F.col("answer")))
    assert rows(audit.canonical_members(torn, "prompt_hash").select("source_index")) == [(2,), (3,), (4,)]
    assert rows(audit.group_consistency(keyed, "prompt_hash").select("n", "inconsistent", "several_models")) == [(2, False, True)]
    assert rows(audit.unresolved_models(source, models)) == [("gone", 1)]
    fam = dict(rows(families.protected_families(keyed).select("source_index", "root")))
    assert fam == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_field_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "source_index bigint, question_id bigint, desc_id string, given_info string, question string, answer string, meta struct<query_type: string, rung: int, story_id: string, graph_id: string, model_id: string, groundtruth: string>")
    assert {r["missing"] for r in audit.field_quality(empty).collect()} == {0}


def test_votes_and_plan(spark):
    plan = calls.plan_table(spark)
    assert plan.count() == 17
    assert [r["role"] for r in plan.filter("config_id like 'C5%'").orderBy("position").collect()] == ["analyst", "semantic_query_critic", "graph_identification_critic", "formal_numerical_critic", "adjudicator"]
    both = calls.expand_calls(spark.createDataFrame([("x", "smoke"), ("x", "calibration")], "item_id string, split_name string"), plan)
    assert both.select("planned_id").distinct().count() == both.count() == 34
    data = [("c%d" % i, i, "success", "r", "x", "A3_SINGLE_V1", "analyst", i, "p", a, None, a) for i, a in enumerate(["YES", "NO", "YES"])] + [("d%d" % i, i, "success", "r", "y", "A3_SINGLE_V1", "analyst", i, "p", a, None, a) for i, a in enumerate(["YES", "INVALID", "YES"])]
    df = spark.createDataFrame(data, "call_id string, attempt_index int, status string, run_id string, item_id string, config_id string, role string, topology_position int, provider string, parsed_answer string, failure_type string, raw_output string")
    assert dict(rows(calls.majority_votes(df).select("item_id", "winner"))) == {"x": "YES", "y": None}
    cards = spark.createDataFrame([("c", [(0, "analyst", "one"), (1, "critic", " "), (2, "critic", "three")])], "call_id string, cards array<struct<position: int, role: string, answer: string>>")
    assert calls.render_cards(cards).head()["prompt"] == "<<CARD 1 analyst>>\none\n<<END>>\n\n<<CARD 2 critic>>\nthree\n<<END>>\n"


def test_unknown_is_not_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 10, 0.5), ("a", None, 5, None), ("b", 2.0, None, 0.25), ("c", None, None, None)], "config_id string, normalized_list_cost_usd double, total_tokens bigint, actual_charge_usd double")
    got = {r["config_id"]: r for r in runlog.usage_totals(df).collect()}
    assert got["a"]["total_cost"] is None and got["a"]["subtotal_cost"] == 1.0 and got["a"]["call_coverage"] == 0.5 and got["a"]["actual_charge"] is None
    assert got["b"]["total_cost"] == 2.0 and got["b"]["actual_charge"] == 0.25 and got["b"]["token_coverage"] is None
    assert got["c"]["total_cost"] is None and got["c"]["subtotal_cost"] == 0.0


def test_chains_and_utc(spark):
    df = spark.createDataFrame([("a", 0, "failure"), ("a", 1, "success"), ("b", 1, "success"), ("c", 0, "x"), ("c", 2, "y")], "call_id string, attempt_index int, status string")
    assert {r["call_id"]: r["contiguous"] for r in runlog.attempt_chains(df).collect()} == {"a": True, "b": False, "c": False}
    times = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01T00:00:00+07:00",), ("soon",), (None,)], "t string")
    assert [r[0] for r in times.select(runlog.utc_state(F.col("t"))).collect()] == ["ok", "wrong_offset", "unreadable", None]


def test_start_gaps_across_spans(spark):
    rng = random.Random(7)
    at = sorted(rng.randrange(0, 40_000) for _ in range(300))
    df = spark.createDataFrame([("r", "p" if i % 3 else None, f"2026-01-01T00:00:{x / 1000:06.3f}Z") for i, x in enumerate(at)] + [("r", "p", "soon")], "run_id string, provider string, timestamp_utc string")
    want = []
    for p in (None, "p"):
        own = [x for i, x in enumerate(at) if ("p" if i % 3 else None) == p]
        want.append(("r", p, len(own), sum(b - a < 150 for a, b in zip(own, own[1:]))))
    assert rows(runlog.start_gaps(df, 0.15, span=0.5)) == rows(runlog.start_gaps(df, 0.15)) == sorted(want, key=repr)


def test_scans(spark):
    df = spark.createDataFrame([(1, '{"a": {"API_key": 1}, "rung": 2}'), (2, '{"k": "token: x"}'), (3, "no json"), (4, None), (5, '{"k": [{"Gold_Scores": 1}]}')], "i int, j string")
    assert [r[0] for r in df.select(views.secret_keys(F.col("j"))).collect()] == ["api_key", "", "", "", ""]
    assert [r[0] for r in df.select(views.metric_keys(F.col("j"))).collect()] == ["", "", "", "", "gold_scores"]
    broken = {r["i"]: (r["forbidden"], r["unknown"], r["missing"], r["readable"]) for r in views.schema_violations(df, "i", "j", ("k",), ("k",)).collect()}
    assert broken == {1: ("rung", "a,rung", "k", True), 3: ("", "", "", False), 4: ("", "", "", False)}
    leaky = spark.createDataFrame([("graph_id: x",), ("a graph id",), ("gsk_0123456789abcdef",), (None,), ("Prompt_Hash =1",), ("my_answer: y",), ("gsk_short",)], "t string")
    assert [r[0] for r in leaky.select(views.leaks_label(F.col("t"))).collect()] == [True, False, True, False, True, False, False]
    marked = spark.createDataFrame([("still pending.",), ("TODO",), ("to_be_frozen_later",), (None,)], "t string")
    assert [r[0] for r in marked.select(views.has_placeholder(F.col("t"))).collect()] == [True, False, True, False]


EVENT = {
    "run_id": "r", "item_id": "i", "split_name": "smoke", "config_id": "C5_COUNCIL_V1", "model_id": "m", "provider": "p", "prompt_version": "1", "attempt_index": 0, "role_name": "semantic_query_critic", "raw_output": "NO",
    "parsed_answer": "NO", "final_answer": None, "latency_ms": 1.0, "input_tokens": 3, "output_tokens": 2, "total_tokens": 5, "estimated_cost_usd": 0.0, "status": "success", "failure_type": None,
    "timestamp_utc": "2026-03-01T10:00:00+00:00", "code_version": "c", "call_id": "k", "backoff_seconds": 0.0, "topology_position": 1,
}


def test_event_rules(spark):
    changes = {
        "": {}, "blank_name": {"code_version": " "}, "config": {"config_id": "B2"}, "parsed_answer": {"parsed_answer": "no"}, "final_answer": {"final_answer": "INVALID"}, "attempt_index": {"attempt_index": 4},
        "position": {"topology_position": 5}, "role": {"role_name": "graph_identification_critic"}, "status": {"status": "done"}, "latency": {"latency_ms": -0.5}, "tokens,token_sum": {"input_tokens": -3},
        "token_sum": {"total_tokens": None}, "cost": {"estimated_cost_usd": -1.0}, "backoff": {"backoff_seconds": -1.0}, "timestamp": {"timestamp_utc": "March"}, "offset": {"timestamp_utc": "2026-03-01T10:00:00+02:00"},
        "raw_output": {"raw_output": None}, "failure_type": {"parsed_answer": "INVALID"},
    }
    data = [EVENT | c | {"call_id": f"k{i}"} for i, c in enumerate(changes.values())] + [EVENT | {"input_tokens": None, "total_tokens": None, "call_id": "free"}, EVENT | {"config_id": "C1_BOUNDARY_V1", "topology_position": 0, "role_name": "analyst", "call_id": "c1"}]
    df = spark.createDataFrame(data, ", ".join(f"{k} {'int' if k in ('attempt_index', 'topology_position') else 'bigint' if 'tokens' in k else 'double' if k in ('latency_ms', 'estimated_cost_usd', 'backoff_seconds') else 'string'}" for k in EVENT))
    got = {r["call_id"]: r["violations"] for r in runlog.event_violations(df.withColumn("ingested_at", F.current_timestamp())).collect()}
    assert got == {f"k{i}": name for i, name in enumerate(changes) if name}


def test_usage_rules(spark):
    data = [("ok", 5, 4, 4, 5, "reported"), ("r", 5, 4, 6, None, "reported"), ("c", 5, None, 9, 6, "reported"), ("n", -1, None, None, None, "reported"), ("m", None, None, None, None, " ")]
    df = spark.createDataFrame(data, "call_id string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, cached_input_tokens bigint, token_accounting_method string")
    assert dict(rows(runlog.usage_violations(df))) == {"r": "reasoning_over_output", "c": "cached_over_input", "n": "negative", "m": "method"}


def test_statistics(spark):
    pairs = spark.createDataFrame([("a", "b", 10, 2), ("a", "c", 0, 0), ("b", "c", 300, 180)], "first string, second string, only_first bigint, only_second bigint")
    got = {(r["first"], r["second"]): r for r in scoring.mcnemar(pairs).collect()}
    from math import comb

    exact = lambda b, c: min(1.0, 2 * sum(comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
    assert got["a", "b"]["p_value"] == pytest.approx(exact(10, 2), abs=1e-6)
    assert got["b", "c"]["p_value"] == pytest.approx(exact(300, 180), abs=1e-6)
    assert got["a", "c"]["p_value"] == 1.0 and got["a", "c"]["statistic"] is None
    tests = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03), ("c", "d", 0.5)], "first string, second string, p_value double")
    assert [round(r["adjusted"], 4) for r in scoring.benjamini_hochberg(tests).orderBy("place").collect()] == [0.04, 0.0533, 0.0533, 0.5]


def test_allocation_keeps_families_apart(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([1, 2, 3, None]), rng.choice(["yes", " NO", "No", None]), rng.choice(["ate", "nde"]), f"f{i // 3}", "g", "s") for i in range(600)]
    df = spark.createDataFrame(data, "source_index bigint, rung int, answer string, query_type string, family string, graph_id string, story_id string")
    got = allocation.split_allocation(df, {"a": 10, "b": 16}).toPandas()
    assert got.groupby("family").split_name.nunique().max() == 1
    assert got.groupby(["split_name", "rung", "label"]).size().to_dict() == {(s, r, a): n for s, n in (("a", 5), ("b", 8)) for r in (1, 2, 3) for a in ("yes", "no")}
    with pytest.raises(allocation.Infeasible):
        allocation.split_allocation(df, {"a": 400})
    assert allocation.split_allocation(df, {"a": 400}, fewer=True).count() < 1200


def test_allocation_by_hand(spark):
    # rung 1 holds 4 ate and 2 nde: of 2 rows a split wants 4/3 ate and 2/3 nde, so each label's first row is ate (off by 1/3
    # as nde is, and the hash decides between those), and the second of the split is the other type
    data = [(i, 1, a, q, f"f{i}", f"g{i}", f"s{i}") for i, (a, q) in enumerate([("yes", "ate"), ("yes", "nde"), ("no", "ate"), ("no", "nde"), ("no", "ate"), ("yes", "ate")])]
    df = spark.createDataFrame(data, "source_index bigint, rung int, answer string, query_type string, family string, graph_id string, story_id string")
    got = allocation.split_allocation(df, {"a": 2}).toPandas()
    blocks = sorted(("yes", "no"), key=lambda label: allocation._order("slot", "a", 1, label, []))
    first = min((r for r in data if r[2] == blocks[0]), key=lambda r: (abs(1 - (4 if r[3] == "ate" else 2) * 2 / 6), allocation._order("candidate", r[0])))
    off = lambda r: abs((r[3] == first[3]) + 1 - (4 if r[3] == "ate" else 2) * 2 / 6)
    second = min((r for r in data if r[2] == blocks[1]), key=lambda r: (off(r), allocation._order("candidate", r[0])))
    assert sorted(got["source_index"]) == sorted([first[0], second[0]]) and first[3] != second[3]


@pytest.mark.parametrize("wide", [3, 4000])
def test_allocation_chooses_from_all_rows(spark, wide):
    rng = random.Random(2)
    data = [(i, 1 + i % 2, "yes", rng.choice(["ate", "nde", "ett"]), "hot" if i % 5 == 0 else f"f{rng.randrange(3000)}", f"g{rng.randrange(wide)}", f"s{rng.randrange(wide)}") for i in range(9000)]
    df = spark.createDataFrame(data, "source_index bigint, rung int, answer string, query_type string, family string, graph_id string, story_id string")
    pool = df.withColumnRenamed("answer", "label").toPandas().assign(kind="row", share=0)
    pool["rank_hash"] = [allocation._order("candidate", int(i)) for i in pool.source_index]
    pool["query_rows"] = pool.groupby(["rung", "query_type"])["share"].transform("size")
    pool["rung_rows"] = pool.groupby("rung")["share"].transform("size")
    want = allocation.allocate(pool, {"a": 12, "b": 18})
    assert rows(allocation.split_allocation(df, {"a": 12, "b": 18}, first_rows=4, fewer=True)) == sorted(want.itertuples(index=False, name=None), key=repr)


def test_percentile_is_nearest_rank(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 21)], "n bigint")
    assert audit.size_stats(df).head()["p95"] == 19


def test_subgroups_by_every_dimension(spark):
    source = items(spark, [(0, 1, "d", "a", "q", "yes", ("ate", 1, "S ", "g1", "m", "null")), (1, 2, "d", "b", "q", "no", ("ate", 2, "s", "g2", "m", "null"))])
    nested = source.select("given_info", "question", "answer", F.struct("query_type", "rung", "story_id", "graph_id").alias("meta"))
    asked = spark.createDataFrame([("x", "a", "q"), ("y", "b", "q")], "item_id string, given_info string, question string")
    finals = spark.createDataFrame([("r", "x", "C", "YES"), ("r", "y", "C", "YES")], "run_id string, item_id string, config_id string, final_answer string")
    gold = scoring.gold_labels(asked, nested)
    runs = scoring.planned_runs(finals)
    got = scoring.subgroup_scores(scoring.judged(finals, gold), runs, gold)
    assert rows(got.filter("dimension = 'graph_id'").select("value", "units", "accuracy", "small_cell")) == [("g1", 1, 1.0, True), ("g2", 1, 0.0, True)]
    assert rows(got.filter("dimension = 'story_id'").select("value", "units", "accuracy")) == [("s", 2, 0.5)]
    assert got.count() == 7


def test_gold_is_the_denominator(spark):
    gold = spark.createDataFrame([(i, "YES", 1, "q", "g", "s") for i in "abcd"], "item_id string, gold string, rung int, query_type string, graph_id string, story_id string")
    finals = spark.createDataFrame([("r", "a", "A1_SINGLE_V1", "YES"), ("r", "b", "A1_SINGLE_V1", None), ("r", "a", "A3_SINGLE_V1", "NO"), ("r", "c", "A3_SINGLE_V1", "YES"), ("t", "a", "A1_SINGLE_V1", "YES"), ("t", "zz", "A1_SINGLE_V1", "YES")], "run_id string, item_id string, config_id string, final_answer string")
    runs, judged = scoring.planned_runs(finals), scoring.judged(finals, gold)
    got = {r["config_id"]: tuple(r)[1:] for r in scoring.scores(judged, runs, gold).collect()}
    assert got == {"A1_SINGLE_V1": (8, 2, 2, 0.25, 0.25, 0.75), "A3_SINGLE_V1": (4, 2, 1, 0.25, 0.5, 0.5)}
    silent = spark.createDataFrame([("r", "A1_SINGLE_V1"), ("u", "C3_COUNCIL_V1")], "run_id string, config_id string")
    assert {r["config_id"]: (r["units"], r["correct"]) for r in scoring.scores(judged.limit(0), silent, gold).collect()} == {"A1_SINGLE_V1": (4, 0), "C3_COUNCIL_V1": (4, 0)}
    assert rows(scoring.paired(judged, runs, gold)) == [("A1_SINGLE_V1", "A3_SINGLE_V1", 4, 0, 1, 1, 2, 0.0)]
    assert scoring.scores(judged, runs, gold.limit(0)).head()["accuracy"] is None


def test_bootstrap_is_that_of_drawn_pairs(spark):
    import numpy as np

    pairs = spark.createDataFrame([("a", "b", 200, 90, 20, 50, 40), ("a", "c", 0, 0, 0, 0, 0)], "first string, second string, units bigint, both bigint, only_first bigint, only_second bigint, neither bigint")
    got = {r["second"]: r for r in scoring.bootstrap_differences(pairs).collect()}
    outcome = np.repeat([0, -1, 1], [130, 20, 50])
    rng = np.random.default_rng(1)
    drawn = rng.choice(outcome, (4000, 200)).mean(axis=1)
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert got["b"]["difference"] == 0.15 and abs(got["b"]["low"] - low) < 0.011 and abs(got["b"]["high"] - high) < 0.011
    assert got["c"]["low"] is None and got["c"]["units"] == 0
    assert rows(scoring.bootstrap_differences(pairs)) == rows(scoring.bootstrap_differences(pairs.repartition(5)))


def test_gains_need_a_cost(spark):
    pairs = spark.createDataFrame([("A1_SINGLE_V1", "A3_SINGLE_V1", 0.1), ("A3_SINGLE_V1", "A1_SINGLE_V1", -0.1)], "first string, second string, difference double")
    costs = spark.createDataFrame([("A1_SINGLE_V1", 10, 10, 1000, 5.0, 0.1), ("A3_SINGLE_V1", 30, 10, 6000, 9.0, 0.1)], "config_id string, calls bigint, call_units bigint, tokens bigint, latency double, cost double")
    assert rows(scoring.efficiency_gains(pairs, costs)) == [("A1_SINGLE_V1", "A3_SINGLE_V1", 10.0, 20.0, 5.0, None), ("A3_SINGLE_V1", "A1_SINGLE_V1", -10.0, None, None, None)]


def test_queries_do_not_name_private_columns(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert json.dumps(sorted(names))
    assert isinstance(pd.DataFrame(), pd.DataFrame)
