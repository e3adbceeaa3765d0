"""Greedy stratified allocation to splits that never share a family."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.text import collapse
from tallyard.runtime import cut

SEED = "20260905"
# Rows of each split per rung, half of them of each label.
QUOTAS = {"smoke": 20, "calibration": 100, "locked_test": 200}
LABELS = ("yes", "no")
#: Rows of each rung, label and query type (and of each family in it) that the choice starts with; doubled until it is certain.
FIRST_ROWS = 400


def _order(*parts: object) -> str:
    return hashlib.sha256(json.dumps([SEED, *parts], separators=(",", ":")).encode()).hexdigest()


def allocate(pool: pd.DataFrame, quotas: dict[str, int]) -> pd.DataFrame | None:
    """Fill each split's slots, one rung and label after another in hashed order, each with the row that is best by: distance
    of its query type's count from the type's share of the rung, not starting a new family, repeats of its graph,
    repeats of its story, tie hash. Counts are of the split and rung, over both labels. A family stays with the split
    that took it first. A rung and label that runs dry gives fewer rows.

    pool has how many rows of all have a row's rung and query type (query_rows) and its rung (rung_rows), and in kind what a row is: row, or the first row left out of a query type
    (rest) or of a family in it (family_rest). None if a row left out could be better than the best of the pool.
    """
    strata: dict[tuple, dict[str, list]] = {}
    rest: dict[tuple, str] = {}
    shares: dict[tuple, tuple[int, int]] = {}
    for row in pool.sort_values("rank_hash").itertuples(index=False):
        key = (row.rung, row.label)
        shares[(*key, row.query_type)] = (int(row.query_rows), int(row.rung_rows))
        strata.setdefault(key, {}).setdefault(row.query_type, [])
        if row.kind == "row":
            strata[key][row.query_type].append(row)
        else:
            rest[(*key, row.query_type, row.family if row.kind == "family_rest" else None)] = row.rank_hash
    hidden: dict[tuple, list] = {}
    for (rung, label, query, family), rank in rest.items():
        hidden.setdefault((rung, label, query), []).append((family, rank))
    owner: dict[str, str] = {}
    taken: set[int] = set()
    rows = []
    blocks = sorted(((s, r, a) for s in quotas for r, a in strata), key=lambda b: _order("slot", b[0], int(b[1]), b[2], []))
    counters: dict[tuple, tuple[Counter, Counter, Counter]] = {}
    for split, rung, label in blocks:
        queries, graphs, stories = counters.setdefault((split, rung), (Counter(), Counter(), Counter()))
        quota = quotas[split]
        members = strata[(rung, label)]
        for _ in range(quota // 2):
            best = None
            away = {q: abs(queries[q] + 1 - shares[(rung, label, q)][0] * quota / shares[(rung, label, q)][1]) for q in members}
            for query in sorted(members, key=away.__getitem__):
                if best is not None and away[query] > best[0][0]:
                    break
                for row in members[query]:
                    if row.source_index in taken or owner.get(row.family, split) != split:
                        continue
                    score = (away[query], row.family not in owner, graphs[row.graph_id], stories[row.story_id], row.rank_hash)
                    if best is None or score < best[0]:
                        best = (score, row)
                for family, rank in hidden.get((rung, label, query), ()):
                    if family is not None and owner.get(family) != split:
                        continue
                    if best is None or (away[query], family is None, 0, 0, rank) < best[0]:
                        return None
            if best is None:
                break
            row = best[1]
            taken.add(row.source_index)
            owner[row.family] = split
            queries[row.query_type] += 1
            graphs[row.graph_id] += 1
            stories[row.story_id] += 1
            rows.append((int(row.source_index), split, int(rung), label, row.query_type, row.family))
    return pd.DataFrame(rows, columns=["source_index", "split_name", "rung", "label", "query_type", "family"])


def _pool(rows: DataFrame, shares: DataFrame, most: int, slots: int, first: int) -> DataFrame:
    """What allocate needs of rows when it looks at the first rows of each query type and of each family in it.

    Of equal rows but for the tie hash (class), no more than most are taken from one family, and a new family is one of
    the first slots in its class. New families come from the first rows of a query type, so of other families no row is needed.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("rank_hash"))
    stratum = ["rung", "label", "query_type"]
    heads = rows.withColumn("n", place(*stratum, "graph_id", "story_id", "family")).filter(F.col("n") <= most)
    new = heads.filter("n = 1").withColumn("n", place(*stratum, "graph_id", "story_id")).filter(F.col("n") <= slots)
    new = new.withColumn("n", place(*stratum)).filter(F.col("n") <= first + 1)
    families = new.filter(F.col("n") <= first).select("family").distinct()
    known = heads.join(families, "family", "left_semi").withColumn("n", place(*stratum, "family")).filter(F.col("n") <= first + 1)
    kind = lambda name: F.when(F.col("n") <= first, "row").otherwise(name)
    both = known.withColumn("kind", kind("family_rest")).unionByName(new.filter(F.col("n") > first).withColumn("kind", F.lit("rest")))
    return both.drop("n").join(shares, stratum)


class Infeasible(ValueError):
    """A split cannot get all its rows."""


def split_allocation(candidates: DataFrame, quotas: dict[str, int] | None = None, first_rows: int = FIRST_ROWS, fewer: bool = False) -> DataFrame:
    """(source_index, split_name, rung, label, query_type, family) of the allocated rows.

    Each choice depends on all before it, so one task makes them, over the rows that can be chosen: see _pool. The
    result is that of a choice from all rows. first_rows is only where the search begins: if a row that the task does
    not have could be better, the choice is made again with twice as many. Rows that miss a rung, a YES or NO label,
    a query type or a family are no candidates; repeated source indexes are one. If a split cannot get its quota of a
    rung and label, Infeasible is raised, or with fewer the rows there are come out.
    """
    plain = lambda c: F.lower(collapse(F.col(c)))
    rows = candidates.select("source_index", "rung", plain("answer").alias("label"), plain("query_type").alias("query_type"), plain("family").alias("family"), plain("graph_id").alias("graph_id"), plain("story_id").alias("story_id"))
    rows = rows.filter("rung is not null and label in ('yes', 'no') and query_type <> '' and family <> ''").na.fill("", ["graph_id", "story_id"])
    rows = rows.groupBy("source_index").agg(F.min(F.struct("rung", "label", "query_type", "family", "graph_id", "story_id")).alias("r")).select("source_index", "r.*")
    rows = cut(rows.withColumn("rank_hash", F.sha2(F.concat(F.lit(f'["{SEED}","candidate",'), F.col("source_index").cast("string"), F.lit("]")), 256)))
    wanted = quotas or QUOTAS
    counts = rows.groupBy("rung", "label", "query_type").agg(F.count("*").alias("n"))
    rung = Window.partitionBy("rung")  # over counts: one row per rung, label and query type
    shares = cut(counts.select("rung", "label", "query_type", F.sum("n").over(Window.partitionBy("rung", "query_type")).alias("query_rows"), F.sum("n").over(rung).alias("rung_rows")))
    strata = [(r["rung"], r["label"]) for r in shares.select("rung", "label").distinct().collect()]
    slots = max(1, sum(wanted.values()) * len(strata))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = allocate(pdf, wanted)
        return pd.DataFrame([(None,) * 6], columns=["source_index", "split_name", "rung", "label", "query_type", "family"]).astype({"source_index": "Int64", "rung": "Int32"}) if made is None else made

    while True:
        pool = _pool(rows, shares, max(wanted.values()), slots, first_rows)
        chosen = cut(pool.groupBy(F.lit(1).alias("all")).applyInPandas(lambda _, pdf: run(pdf.drop(columns="all", errors="ignore")), "source_index bigint, split_name string, rung int, label string, query_type string, family string"))
        if chosen.filter("split_name is null").isEmpty():
            break
        first_rows *= 2
    got = {(r["split_name"], r["rung"], r["label"]): r["n"] for r in chosen.groupBy("split_name", "rung", "label").agg(F.count("*").alias("n")).collect()}
    rungs = {r for r, _ in strata}
    short = {(s, r, a): n for s, q in wanted.items() for r in rungs for a in LABELS if (n := got.get((s, r, a), 0)) < q // 2}
    if short and not fewer:
        raise Infeasible(f"too few rows for {short}")
    return chosen
