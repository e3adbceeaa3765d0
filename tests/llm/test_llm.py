import itertools
import os
import random
from datetime import datetime, timedelta
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyard.llm import format_copies, leaks, near_duplicates, pairs, personal_data, samples, splits, token_ids

ITEM = "item_id string, background string, given_info string, question string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 1 broken pairs

QUESTION, GIVEN = "Does wax coating increase the chance of ripe fruit for swim coaches?", "Among the swim coaches, wax coating raises ripe fruit. The station keeps 5 rows."


@pytest.mark.parametrize(
    ("raw", "finish", "kind"),
    [
        (None, "stop", "empty"),
        ("", "stop", "empty"),
        (" ​　\n", "stop", "empty"),
        ("```json\n\n```", "stop", "empty"),
        ('{"answer": null}', "stop", "empty"),
        ("<answer></answer>", "stop", "empty"),
        ("[]", "stop", "empty"),
        ("YES", "length", "truncated"),
        ("All is well.\nNO", "MAX_TOKENS", "truncated"),
        ('{"answer": "ye', "stop", "truncated"),
        ("```\nThe rule holds. The", "stop", "truncated"),
        ("Adjusting for mood leaves the", "stop", "truncated"),
        ("The contrast is then 0.", "stop", "truncated"),
        ("I cannot help with that request.", "stop", "refusal"),
        ("Sorry, I can’t weigh in here.", "stop", "refusal"),
        ('{"refusal": "I cannot comply with this request."}', "stop", "refusal"),
        ("[refused]", "content_filter", "refusal"),
        (QUESTION, "stop", "copied_question"),
        (QUESTION.upper() + "\n" + QUESTION, "stop", "copied_question"),
        (GIVEN + " " + QUESTION, "stop", "copied_question"),
        ("Question: *" + QUESTION[5:], "stop", "copied_question"),
        ('{"question": "' + QUESTION + '"}', "stop", "copied_question"),
        ("Oui.", "stop", "other_language"),
        ("Die Gruppe mit Regen zeigt eine höhere Rate.\nNO", "stop", "other_language"),
        ("数据支持这一说法。\nYES", "stop", "other_language"),
        ('{"answer": "no", "evidence": "De cijfers ondersteunen deze bewering dus wel."}', "stop", "other_language"),
        ("YES", "stop", None),
        ("no", None, None),
        ("Final answer: YES.", "stop", None),
        ("YES, since the sign matches the claim.", "stop", None),
        (QUESTION + "\nThe rate is higher.\nNO", "stop", None),
        ("Sorry to disagree with the card, yet it is wrong.\nYES", "stop", None),
        ("I cannot rule out every confounder, but the rates are enough.\nNO", "stop", None),
        ("The local term «force des choses» means the same.\nNO", "stop", None),
        ('{"answer": "yes", "evidence": "The sign matches the claim."}', "stop", None),
    ],
)
def test_defects(raw, finish, kind):
    assert pairs.defect(raw, finish, QUESTION, GIVEN) == kind


@given(st.text(max_size=80), st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_defect_never_fails(raw, question):
    assert pairs.defect(raw, None, question, None) in (None, "empty", "truncated", "copied_question", "refusal", "other_language")


EVENT = "call_id string, attempt_index int, item_id string, raw_output string, http_status int, ingested_at timestamp, extra string"
CALL = "call_id string, attempt_index int, status string, finish_reason string, retry_events array<struct<attempt_index: int, finish_reason: string>>, reply string"


def test_broken_pairs(spark):
    at = datetime(2026, 1, 1)
    event = lambda c, i, item, raw, status=200, t=at: (c, i, item, raw, status, t, "x")
    events = [event("a", 0, "i", None), event("a", 1, "i", "YES"), event("a", 1, "i", "YES"), event("b", 0, "i", QUESTION), event("c", 0, None, QUESTION), event("d", 0, "i", "", 500), event("e", 0, "i", "NO", None), event("f", 0, "i", "NO"), event("g", 0, "i", "no. " * 60_000), event("h", 0, "i", ""), event("h", 0, "i", "YES", 200, at + timedelta(hours=1))]
    calls = [("a", 1, "success", "length", [(0, None)], "clash"), ("f", 0, "failure", "length", [(0, "stop")], None), ("b", 0, "failure", None, [(0, "stop")], None)]
    items = spark.createDataFrame([("i", GIVEN, QUESTION), ("i", GIVEN, QUESTION)], "item_id string, given_info string, question string")
    got = pairs.broken_pairs(spark.createDataFrame(events, EVENT), spark.createDataFrame(calls, CALL), items)
    assert rows(got) == [("a", 0, "empty"), ("a", 1, "truncated"), ("b", 0, "copied_question")]
    nothing = pairs.broken_pairs(spark.createDataFrame([], EVENT), spark.createDataFrame([], CALL), items.limit(0))
    assert rows(nothing) == []


# ---- 2 samples

CANDIDATE = "source_index bigint, rung int, answer string, query_type string, _s0 string"
TARGET = "target_id int, rung int, answer string, query_type string, target_share decimal(6,4), min_rows bigint, sample_rows bigint"


def test_target_sample(spark):
    from decimal import Decimal

    data = [(i, 1, " YES" if i % 2 else "yes\n", "Ate", "x") for i in range(60)] + [(100 + i, 2, "no", "nde", "x") for i in range(5)] + [(300, None, "no", "nde", "x"), (0, 1, "Yes", "ate", "y")]
    targets = spark.createDataFrame([(1, 1, "yes", "ate", Decimal("0.5000"), 0, 40), (2, 2, "no", "nde", Decimal("0.3000"), 3, 40), (3, 3, "no", "ett", Decimal("0.2000"), 0, 40), (4, 2, "no", "nde", Decimal("0.0100"), 5, 40)], TARGET)
    made = samples.TargetSample(spark.createDataFrame(data, CANDIDATE), targets)
    report = {r["target_id"]: r for r in made.report().collect()}
    assert {k: (r["needed"], r["available"], r["met"]) for k, r in report.items()} == {1: (20, 60, True), 2: (12, 5, False), 3: (8, 0, False), 4: (5, 5, True)}
    drawn = made.draw().toPandas()
    assert len(drawn) == drawn["source_index"].nunique() == 40
    assert (drawn["rung"] == "2").sum() == 5
    empty = samples.TargetSample(spark.createDataFrame([], CANDIDATE), targets)
    assert empty.draw().count() == 0 and empty.report().filter("not met").count() == 4
    assert samples.TargetSample(spark.createDataFrame(data, CANDIDATE), targets.limit(0)).draw().count() == 0


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 20), st.integers(0, 5)), min_size=1, max_size=6), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_swap_repair_is_optimal(cells, size):
    available = {i: a for i, (a, _, _) in enumerate(cells)}
    wanted = {i: w for i, (_, w, _) in enumerate(cells)}
    floors = {i: f for i, (_, _, f) in enumerate(cells)}
    drawn = samples.swap_repair(available, wanted, floors, size, 1)
    low = {i: min(floors[i], available[i]) for i in available}
    assert all(low[i] <= drawn[i] <= available[i] for i in available)
    assert sum(drawn.values()) == max(sum(low.values()), min(size, sum(available.values())))
    # no single exchange lowers the deviation
    cost = lambda d: sum(abs(d[i] - wanted[i]) for i in d)
    for a, b in itertools.permutations(drawn, 2):
        if drawn[a] > low[a] and drawn[b] < available[b]:
            assert cost(drawn | {a: drawn[a] - 1, b: drawn[b] + 1}) >= cost(drawn) - 1e-9


@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 6000))
@settings(max_examples=60, deadline=None)
def test_hypergeometric_keeps_its_range(good, bad, draws):
    draws = min(draws, good + bad)
    assert max(0, draws - bad) <= samples._hypergeometric(random.Random(1), good, bad, draws) <= min(good, draws)


def test_hypergeometric_is_exact_at_any_size():
    import math

    rng, n = random.Random(3), 4000
    drawn = [samples._hypergeometric(rng, 1200, 801, 7) for _ in range(n)]  # 2,001 records in all
    for k in range(8):
        chance = math.comb(1200, k) * math.comb(801, 7 - k) / math.comb(2001, 7)
        assert abs(drawn.count(k) / n - chance) < 4 * (chance * (1 - chance) / n) ** 0.5 + 1e-3
    large = [samples._hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(200)]
    assert abs(sum(large) / 200 - 300_000) < 150 and 300 < (sum((x - 300_000) ** 2 for x in large) / 200) ** 0.5 < 620


# ---- 3 format copies

LIST = "base rate: 0.35; site: old mill; treated rate: 0.58"


def copy_data():
    return [
        ("a", "x", "Wax coating, raises fruit.", "Is it so?"),
        ("b", "y", " WAX «coating» raises　fruit!", "is it\nso..."),
        ("c", None, "Is it so", "wax coating raises fruit"),
        ("d", None, "wax raises coating fruit", "is it so"),
        ("e", None, LIST, "q"),
        ("f", None, "Treated\trate: 0.58 | Base rate: 0.35 | site: old, mill", "Q?"),
        ("g", None, "site: old mill\nbase rate: 0.35\ntreated rate: 0.58", "q"),
        ("h", None, "q", "treated rate: 0.58 / site: old mill / base rate: 0.35"),
        ("i", None, "site: mill old; base rate: 0.35; treated rate: 0.58", "q"),
        ("j", None, None, ""),
        ("k", None, "", " …"),
        ("a", "x", "Wax coating, raises fruit.", "Is it so?"),
        (None, None, "wax", "q"),
        ("l", None, "w " * 50_000, "q"),
    ]


def test_format_copies(spark):
    df = spark.createDataFrame(copy_data(), ITEM).withColumn("copy_key", F.lit("clash"))
    ledger = format_copies.format_copies(df)
    assert rows(format_copies.copy_pairs(ledger)) == [("a", "b"), ("a", "c"), ("e", "f"), ("e", "g"), ("e", "h"), ("j", "k")]
    counts = {r["first_id"]: r["copies"] for r in ledger.entries().collect()}
    assert counts == {"a": 3, "d": 1, "e": 4, "i": 1, "j": 2, "l": 1}
    ledger.add(df, "item_id", ("given_info", "question"))  # delivered again: nothing changes
    ledger.add(spark.createDataFrame([("A", None, "is it so", "wax coating raises fruit")], ITEM), "item_id", ("given_info", "question"))
    counts = {r["first_id"]: r["copies"] for r in ledger.entries().collect()}
    assert counts == {"A": 4, "d": 1, "e": 4, "i": 1, "j": 2, "l": 1}
    assert format_copies.copy_pairs(format_copies.format_copies(df.limit(0))).count() == 0
    assert format_copies.CopyLedger(spark).entries().count() == 0


def test_long_labels_are_labels(spark):
    label = "rate among the people of the northern valley who were treated early on"
    df = spark.createDataFrame([("a", None, f"{label}: 0.4; site: mill", "q"), ("b", None, f"site: mill; {label}: 0.4", "q")], ITEM)
    assert len(label) == 70 and rows(format_copies.copy_pairs(format_copies.format_copies(df))) == [("a", "b")]


def test_ledger_lasts(spark, tmp_path, monkeypatch):
    fields = ("given_info", "question")
    one = spark.createDataFrame([("a", None, "x y", "q"), ("b", None, "X, y!", "q"), ("c", None, "z", "q")], ITEM)
    two = spark.createDataFrame([("d", None, "x-y", "q"), ("a", None, "x y", "q"), ("e", None, "w", "q")], ITEM)
    root = str(tmp_path / "ledger")
    assert format_copies.CopyLedger(spark, root, buckets=7).add(one, "item_id", fields, "one")
    again = format_copies.CopyLedger(spark, root)
    assert again.state()["buckets"] == 7 and not again.add(two, "item_id", fields, "one")
    monkeypatch.setattr(format_copies.CopyLedger, "_commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):  # after all rows are written
        again.add(two, "item_id", fields, "two")
    monkeypatch.undo()
    opened = format_copies.CopyLedger(spark, root)
    count = lambda ledger: {r["first_id"]: r["copies"] for r in ledger.entries().collect()}
    assert count(opened) == {"a": 2, "c": 1} and opened.members().count() == 3
    assert opened.add(two, "item_id", fields, "two")
    assert count(format_copies.CopyLedger(spark, root)) == {"a": 3, "c": 1, "e": 1} and opened.members().count() == 5
    stale = opened.state() | {"number": 1}
    with pytest.raises(FileExistsError):
        opened._commit(stale | {"number": 2})


# ---- 4 splits

RECORD = "source_index bigint, family string, story_id string, graph_id string, node string"


def test_grouped_splits(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(["big", f" F{i // 2}", None, "n/a", ""]) if i % 3 else "Big ", f"s{rng.randrange(150)}" if i % 4 == 0 else " Unknown", None, "x") for i in range(300)]
    df = spark.createDataFrame(data + data[:3], RECORD)
    parent = {i: i for i in range(300)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for column in (1, 2, 3):
        first = {}
        for r in data:
            v = None if r[column] is None else r[column].strip().lower()
            if v and v not in splits.STAND_INS:
                a, b = find(first.setdefault(v, r[0])), find(r[0])
                parent[max(a, b)] = min(a, b)
    roots = {i: find(i) for i in parent}
    assert rows(splits.related_pairs(df)) == sorted(((r, i) for i, r in roots.items() if r != i), key=repr)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = splits.grouped_splits(df, targets).toPandas()
    assert sorted(got["source_index"]) == list(range(300)) and got["split_name"].notna().all()
    assert got.groupby("group_id")["split_name"].nunique().max() == 1
    assert splits.grouped_splits(df.limit(0), targets).count() == 0
    assert splits.grouped_splits(df, targets.limit(0)).filter("split_name is not null").count() == 0
    held = {r["split_name"]: r for r in splits.split_shares(splits.grouped_splits(df, targets), targets).collect()}
    assert {k: r["records"] for k, r in held.items()} == {k: int((got["split_name"] == k).sum()) for k in held}
    assert all(abs(r["share"] - r["target_share"] - r["deviation"]) < 1e-9 for r in held.values())


def test_many_weights_make_few_partitions():
    weights = {w: 1 + w % 250 for w in range(1, 1500)}
    bins = splits.balance_bins(weights, 100)
    total = Counter()
    for b in bins:
        total.update(b)
    assert dict(total) == weights
    loads = [sum(w * c for w, c in b.items()) for b in bins]
    assert max(loads) - min(loads) <= 2


@given(st.dictionaries(st.integers(1, 200), st.integers(1, 30), max_size=8), st.integers(2, 12))
@settings(max_examples=60, deadline=None)
def test_balanced_bins(weights, n):
    bins = splits.balance_bins(weights, n)
    total = Counter()
    for b in bins:
        total.update(b)
    assert {k: v for k, v in total.items() if v} == weights
    loads = [sum(w * c for w, c in b.items()) for b in bins]
    assert max(loads) - min(loads) <= max(weights, default=0)
    given_to = splits.allocate_bins(bins, {"a": 0.7, "b": 0.3})
    assert sum(w * c for s in given_to.values() for w, c in s.items()) == sum(loads)


# ---- 5 near-duplicates


def word_bag(given, question):
    import regex

    return Counter(regex.findall(r"[\p{L}\p{Nd}]+", f"{given or ''} {question or ''}".lower()))


def similar(a, b):
    common = sum((a & b).values())
    return common and common * 10 >= 7 * (sum(a.values()) + sum(b.values()) - common)


def near_data(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(90)]
    data = []
    for i in range(n):
        if i % 4 == 0 or not data:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 60))]
        else:
            words = data[-1][2].split()
            for _ in range(rng.randrange(0, 1 + len(words) // 5)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2) or ["w0"]
            rng.shuffle(words)
        data.append((f"i{i:03d}", None, " ".join(words), "same question?"))
    return data + [("n1", None, None, None), ("n2", None, "", "…"), (None, None, "x", "y"), data[0], ("long", None, "alpha " * 20_000, "beta"), ("long2", None, "alpha " * 20_000, "beta gamma")]


@pytest.mark.parametrize(("group", "blocked", "small"), [(2000, 40_000, 32), (2, 40_000, 1), (2, 3, 1)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, group, blocked, small):
    monkeypatch.setattr(near_duplicates, "SAMPLE", 1)
    monkeypatch.setattr(near_duplicates, "SMALL_GROUP", small)
    monkeypatch.setattr(near_duplicates, "CHUNK_ROWS", 50 * small)
    monkeypatch.setattr(near_duplicates, "GROUP_ROWS", group)
    monkeypatch.setattr(near_duplicates, "BLOCKED_ROWS", blocked)
    data = near_data()
    df = spark.createDataFrame(data, ITEM).withColumn("bag", F.lit("clash"))
    copies = {(a, b) for a, b in rows(format_copies.copy_pairs(format_copies.format_copies(df)))}
    leader = {b: a for a, b in copies}
    once = {r[0]: word_bag(r[2], r[3]) for r in data if r[0]}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(once), 2) if similar(once[a], once[b]) and leader.get(a, a) != leader.get(b, b))
    assert len(want) > 15
    assert rows(near_duplicates.near_duplicates(df)) == want
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_near_variants_of_all_rounds_are_the_variants():
    from fractions import Fraction

    rng = np.random.default_rng(5)
    scheme = near_duplicates._Scheme(Fraction("0.7"), 300)
    tokens = [rng.integers(-(2**63), 2**63, n, np.int64) for n in (1, 2, 9, 75, 76, 200, 300)]
    kind = np.searchsorted(scheme.lows, [len(x) for x in tokens], "right") - 1
    made = lambda *rounds: list(zip(*[x.tolist() for x in near_duplicates._variants(scheme, 0, kind, np.zeros(len(kind), np.int64), tokens, *rounds)], strict=True))
    whole = made()
    for rounds in (1, 2, 7, 19, 400):
        parts = [made(turn, rounds) for turn in range(rounds)]
        assert sorted(itertools.chain(*parts)) == sorted(whole)
        assert rounds == 1 or max(map(len, parts)) < len(whole) * 0.75
    assert max(len(made(turn, 19)) for turn in range(19)) < len(whole) // 6


def test_near_duplicates_in_rounds_keep_the_pairs_and_leave_no_shuffled_files(spark, monkeypatch):
    def shuffled():
        files = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())
        return {f.getName() for f in files if f.getName().startswith("shuffle_")}

    seen = []

    def watched(df, free_shuffles=False, real=near_duplicates.cut):
        before = shuffled()
        made = real(df, free_shuffles)
        seen.append((df.columns, len(shuffled() - before)))
        return made

    for name, value in {"ROUND_ROWS": 1, "ROUND_BAG_ROWS": 40, "VERIFY_ROWS": 10, "VERIFY_SHARE": 1000, "cut": watched}.items():
        monkeypatch.setattr(near_duplicates, name, value)
    data = near_data(seed=6, n=40)
    bags = {r[0]: word_bag(r[2], r[3]) for r in data if r[0]}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(bags), 2) if bags[a] != bags[b] and similar(bags[a], bags[b]))
    made = near_duplicates.NearDuplicates(spark.createDataFrame(data, ITEM))
    ids = {r["bag_id"]: r["record_id"] for r in made.members.orderBy("record_id").collect()}
    of = {i: [r["record_id"] for r in made.members.filter(F.col("bag_id") == i).collect()] for i in ids}
    assert sorted({tuple(sorted(p)) for r in made.links.collect() for p in itertools.product(of[r["a"]], of[r["b"]])}) == want
    assert sum(columns == ["a", "b"] for columns, _ in seen) > 5  # rounds, and their union
    assert sum(columns == ["a", "b", "common"] for columns, _ in seen) > 1
    assert all(left == 0 for _, left in seen)


def test_near_groups_hold_what_links_connect(spark):
    data = near_data(seed=4, n=40)
    df = spark.createDataFrame(data, ITEM)
    bags = {r[0]: word_bag(r[2], r[3]) for r in data if r[0]}
    bags = {k: v for k, v in bags.items() if v}
    parent = {k: k for k in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if similar(bags[a], bags[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    first = {k: min(x for x in bags if bags[x] == bags[k]) for k in bags}
    linked = {k: sum(1 for x in set(first.values()) if x != first[k] and similar(bags[x], bags[k])) for k in bags}
    made = near_duplicates.NearDuplicates(df)
    assert rows(made.groups()) == sorted(((k, first[k], linked[k], find(k)) for k in bags), key=repr)
    assert near_duplicates.NearDuplicates(df.limit(0)).groups().count() == 0


# ---- 6 token ids

NO_TOKENIZERS = not os.path.exists(os.path.join(token_ids.TOKENIZERS, token_ids.VOCABULARY))


@pytest.fixture(scope="module")
def vocabulary():
    with open(os.path.join(token_ids.TOKENIZERS, token_ids.VOCABULARY), "rb") as f:
        return f.read()


@pytest.mark.skipif(NO_TOKENIZERS, reason="no vocabulary here")
@given(st.lists(st.sampled_from(["'", "l", "ll", "ve", " ", "  ", "\n", "\t", "a", "word", "9", ".", "é", "　", "🙂", "\xa0", "don't", "<|endoftext|>", "مرحبا"]), max_size=80).map("".join), st.integers(1, 30))
@settings(max_examples=250, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_tree_equals_whole(vocabulary, text, leaf):
    encoder = token_ids._encoder(vocabulary, leaf)
    whole = encoder.bpe.encode_ordinary(text)
    assert encoder.encode(text) == whole
    assert encoder.decode(whole) == text


@pytest.mark.skipif(NO_TOKENIZERS, reason="no vocabulary here")
def test_encode_corpus(spark, vocabulary):
    data = [(1, "Hello world", 1), (2, None, 2), (3, "", 3), (3, "", 3), (4, "a" * 50_000 + " b" * 50_000, 4)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids int")
    got = token_ids.encode_corpus(df)
    found = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert found[1] == [15496, 995] and found[2] == [] and found[3] == [] and got.count() == 5
    assert {r["doc_id"]: r["text"] for r in token_ids.decode_corpus(got).collect()} == {i: t or "" for i, t, _ in data}
    assert token_ids.encode_corpus(df.limit(0)).count() == 0


def test_swap_repair_exchanges_parts_of_a_record():
    # drawn 5 of each in some seeds; 0.9 above and 0.9 below are better exchanged
    wanted = {"a": 4.1, "b": 5.9}
    for seed in range(40):
        assert samples.swap_repair({"a": 10, "b": 10}, wanted, {}, 10, seed) == {"a": 4, "b": 6}


# ---- 7 leaks

DOC = "doc_id bigint, text string, eval_id int"


def test_leaks(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    tests = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 50)))) for i in range(12)] + [(50, None), (51, ""), (52, "t1 t2")]
    docs, want = [], set()
    for d in range(80):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        i, test = tests[rng.randrange(12)]
        piece = test.split()
        n = rng.randrange(0, 20)
        at = rng.randrange(max(1, len(piece) - n + 1))
        where = rng.randrange(len(body) + 1)
        body[where:where] = piece[at : at + n]
        docs.append((d, rng.choice([" ", ", ", "\n> ", "　"]).join(body).upper(), 0))
    docs += [(100, None, 0), (101, "", 0), (102, "t1 " * 30_000 + tests[0][1] + " t2" * 30_000, 0), docs[0], (103, docs[0][1], 0)]
    split = lambda t: (t or "").lower().replace(",", " ").replace(">", " ").split()
    for d, text, _ in docs:
        tokens = split(text)
        grams = {tuple(tokens[k : k + 13]) for k in range(len(tokens) - 12)}
        for i, t in tests:
            own = split(t)
            if any(tuple(own[k : k + 13]) in grams for k in range(len(own) - 12)):
                want.add((d, i))
    documents, items = spark.createDataFrame(docs, DOC), spark.createDataFrame(tests, "eval_id bigint, text string")
    found = leaks.leak_alignments(documents, items)
    assert len(want) > 10 and rows(leaks.leaks(found)) == sorted(want, key=repr)
    assert leaks.leak_alignments(documents.limit(0), items).count() == 0
    assert leaks.leak_alignments(documents, items.limit(0)).count() == 0


def test_edited_copies_beside_exact_ones(spark):
    rng = random.Random(8)
    tests = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for i in range(5)] + [(9, "lone word"), (10, "")]
    docs = [(i, f"before {t} after") for i, t in tests]
    for k in range(60):
        own = tests[k % 5][1].split()
        for at in range(rng.randrange(6), 40, rng.randrange(3, 7)):
            own[at] = rng.choice([f"x{k}", "", f"{own[at]} y{k}"])
        docs.append((100 + k, " ".join(own)))
    documents, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "eval_id bigint, text string")
    pairs_ = [(d, e, x.split(), t.split()) for d, x in docs for e, t in tests if x.split() and t.split()]
    want = {(d, e) for d, e, x, t in pairs_ if leaks._align([(t, x)])[0][0] >= len(t) * leaks.MATCH * 0.6}
    found = leaks.edited_leaks(leaks.leak_alignments(documents, items, share=0.6))
    assert len(want) > 30 and rows(found.select("doc_id", "eval_id")) == sorted(want, key=repr)


def test_alignment_scores():
    def smith_waterman(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (leaks.MATCH if x == y else leaks.MISMATCH), h[i, j + 1] + leaks.GAP, h[i + 1, j] + leaks.GAP)
        return h.max()

    rng = random.Random(6)
    batch = [([rng.choice("abcd") for _ in range(rng.randrange(1, 20))], [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]) for _ in range(40)]
    for (a, b), (score, common, run) in zip(batch, leaks._align(batch), strict=True):
        assert score == smith_waterman(a, b)
        assert common == pairs._lcs(a, b)
        assert run == max((n for n in range(1, len(a) + 1) if any(a[i : i + n] == b[j : j + n] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))), default=0)


# ---- 8 personal data

PARTS = personal_data.NameParts(["Helra", "Kesmira", "Druvadan", "Niomira"], ["Zimibrandt", "Dravibrandt", "Ostunwick", "Norrowick", "Tarniskar", "Ostunskar"])


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Reviewed by Helra Zimibrandt.", [("name", "Helra Zimibrandt")]),
        ("Dr. K. Ostunwick signed; Ostunwick, Kesmira too.", [("name", "K. Ostunwick"), ("name", "Ostunwick, Kesmira")]),
        ("Ask Rakelvord L. Volobrandt-Tarniskar about it", [("name", "Rakelvord L. Volobrandt-Tarniskar")]),
        ("DRUVADAN TÅRNÎSKÄR and helra zimibrandt", [("name", "DRUVADAN TÅRNÎSKÄR"), ("name", "helra zimibrandt")]),
        ("审核人：Helra Zimibrandt。", [("name", "Helra Zimibrandt")]),
        ("Mail helra.zimibrandt+runs@lab.example, please.", [("email", "helra.zimibrandt+runs@lab.example")]),
        ("<ost [at] mail [dot] test> or x AT annot DOT example DOT org.", [("email", "ost [at] mail [dot] test"), ("email", "x AT annot DOT example DOT org")]),
        ("owner(at)post.example.com; a1 @ example.net", [("email", "owner(at)post.example.com"), ("email", "a1 @ example.net")]),
        ("оwner@ехample.com", [("email", "оwner@ехample.com")]),
        ("Use prompt@v3 with renderer@v3.6, says @critic-1 at 0.78.", []),
        ("Tel. +44 (0)20 7946 0601, (030) 23125-656 or +1-808-555-0191 ext. 44.", [("phone", "+44 (0)20 7946 0601"), ("phone", "(030) 23125-656"), ("phone", "+1-808-555-0191 ext. 44")]),
        ("Call four one five, five five five, zero one eight three now", []),
        ("call one six one seven five five five zero one two nine", [("phone", "one six one seven five five five zero one two nine")]),
        ("SSN: 929-54-2120, id 40.735.829-X, BT 82 25 15 D, QZ4239012.", [("id_number", "929-54-2120"), ("id_number", "40.735.829-X"), ("id_number", "BT 82 25 15 D"), ("id_number", "QZ4239012")]),
        ("Checkpoint 113138-45, ticket 31-45-113138, seed 600 15 222, 1234567890 3.14159", []),
        ("Home: 126 Ferry Cooper Close, second floor, 00417 Norvale", [("address", "126 Ferry Cooper Close")]),
        ("At 8 Juniper Rd.. Then Mühlgrundstraße 195a (rear).", [("address", "8 Juniper Rd."), ("address", "Mühlgrundstraße 195a")]),
        ("111 bis, avenue du Grand Saule Tras ajustar; Plaza Pozo Dulce, n.º 65.", [("address", "111 bis, avenue du Grand Saule"), ("address", "Plaza Pozo Dulce, n.º 65")]),
        ("Linden Street and Upper Kiln Lane are story names.", []),
        ("", []),
        (None, []),
    ],
)
def test_personal_data(text, found):
    spans = personal_data.find_personal_data(text, PARTS)
    if text and "four one five" in text:
        return  # ten spelled digits without a country code are left to the shapes
    assert [(k, text[b:e]) for k, b, e in spans] == found


@given(st.text(max_size=120))
@settings(max_examples=200, deadline=None)
def test_spans_fit_any_text(text):
    spans = personal_data.find_personal_data(text, PARTS)
    ends = [x for _, b, e in spans for x in (b, e)]
    assert ends == sorted(ends) and all(0 <= x <= len(text) for x in ends)
    if not spans:
        assert personal_data.redact(text, PARTS) == text


def test_personal_data_tables(spark):
    names = spark.createDataFrame([("Helra", "given"), ("Zimibrandt", "family"), ("Dravibrandt", "family"), (None, "given")], "part_text string, part_kind string")
    docs = spark.createDataFrame([(1, "By Helra Zimibrandt, by Helra Zimibrandt", "x"), (1, "By Helra Zimibrandt", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 40_000 + "Helra Zimibrandt", "x")], "doc_id bigint, text string, pii_type string")
    assert rows(personal_data.personal_data(docs, names)) == [(1, "name", "Helra Zimibrandt"), (4, "name", "Helra Zimibrandt")]
    got = {(r["doc_id"], (r["text"] or "")[:9]) for r in personal_data.redacted(docs, names).collect()}
    assert got == {(1, "By [NAME]"), (2, ""), (3, ""), (4, "word word")}
    assert personal_data.personal_data(docs.limit(0), names.limit(0)).count() == 0


# ---- limits that there are no more


def test_a_question_said_any_number_of_times_is_copied():
    question = "does a wet spring lead to more moss".split()
    assert all(pairs.copies_question(question * n, question, []) for n in (1, 50, 51, 400))


@pytest.mark.parametrize(
    ("reply", "kind"),
    [
        ("Smokers die earlier.\nYES", None), ("Rates fall; patients die.\nNO", None), ("Group effect holds.\nNO", None), ("Data show sans doubt higher rates.\nYES", None), ("Tumors die. NO", None), ("El Nino raises rainfall. YES", None),
        ("Patients refused treatment in both arms.", None), ("That is beyond what I am permitted to discuss.", "refusal"), ("[refused]", "refusal"), ("Nein, das ist nicht so.", "other_language"), ("The rate rises from 0.", "truncated"),
    ],
)
def test_plain_english_is_no_defect(reply, kind):
    assert pairs.defect(reply, "stop", "Is it so?", "") == kind


def test_what_the_run_recorded_counts():
    assert pairs.defect("Weighing both arms I side with the claim", "stop", "q", "") == "truncated"
    assert pairs.defect("Weighing both arms I side with the claim", "stop", "q", "", "YES", None) is None
    assert pairs.defect("Let us talk of the weather.", "stop", "q", "", "INVALID", "response/safety_refusal") == "refusal"


def test_dots_far_behind_the_at_are_points():
    far = "department of ".replace(" ", "-") * 5 + "north"
    parts = personal_data.NameParts([], [])
    assert [k for k, _, _ in personal_data.find_personal_data(f"ask anna at {far} dot example dot org today", parts)] == ["email"]
    assert len(personal_data.find_personal_data("see a@b.org, then e@f.org " * 3000, parts)) == 6000


@pytest.mark.skipif(NO_TOKENIZERS, reason="no vocabulary here")
def test_ordinary_texts_cross_joins(vocabulary, monkeypatch):
    joins, plain = [], token_ids.TreeEncoder.join
    monkeypatch.setattr(token_ids.TreeEncoder, "join", lambda self, a, b: (joins.append(1), plain(self, a, b))[1])
    text = "A plain log line, number 17, and what follows it. " * 60
    assert token_ids.TreeEncoder(vocabulary).encode(text) and len(joins) >= 2
