"""Multi-step call plans as data: expansion, upstream joins, prompts from cards, votes and final answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The steps of each method, (config, position, role, upstream positions).
PLAN = (
    ("A1_SINGLE_V1", 0, "analyst", ()),
    *[("A3_SINGLE_V1", p, "analyst", ()) for p in range(3)],
    *[("A5_SINGLE_V1", p, "analyst", ()) for p in range(5)],
    ("C3_COUNCIL_V1", 0, "analyst", ()),
    ("C3_COUNCIL_V1", 1, "critic", (0,)),
    ("C3_COUNCIL_V1", 2, "adjudicator", (0, 1)),
    ("C5_COUNCIL_V1", 0, "analyst", ()),
    ("C5_COUNCIL_V1", 1, "semantic_query_critic", (0,)),
    ("C5_COUNCIL_V1", 2, "graph_identification_critic", (0,)),
    ("C5_COUNCIL_V1", 3, "formal_numerical_critic", (0,)),
    ("C5_COUNCIL_V1", 4, "adjudicator", (0, 1, 2, 3)),
)
# Fixed value: the revision that enters every call id.
REVISION = "cross_split_execution_r6"
VOTES = ("A3_SINGLE_V1", "A5_SINGLE_V1")


def plan_table(spark: SparkSession) -> DataFrame:
    """(config_id, position, role, upstream) as a fixed small table."""
    return spark.createDataFrame([(c, p, r, list(u)) for c, p, r, u in PLAN], "config_id string, position int, role string, upstream array<int>")


def call_id(split: Column, config: Column, item: Column, position: Column, revision: str = REVISION) -> Column:
    """32 hex digits that name one step of one item's method in one split and revision."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit("call-v2"), F.lit(revision), split, config, item, position.cast("string")), 256), 1, 32)


def expand_calls(items: DataFrame, plan: DataFrame, split: str = "locked_test", revision: str = REVISION) -> DataFrame:
    """One row per item, split and step of the plan, with a stable call id.

    The split is the items' column split_name if they have one, else split. The plan is a fixed list, so it is an
    explode, not a join of two tables.
    """
    steps = F.broadcast(plan.groupBy().agg(F.collect_list(F.struct("config_id", "position", "role", "upstream")).alias("steps")))
    named = items if "split_name" in items.columns else items.withColumn("split_name", F.lit(split))
    rows = named.select("item_id", "split_name").distinct().join(steps, how="left").select("item_id", "split_name", F.explode("steps").alias("s")).select("item_id", "split_name", "s.*")
    return rows.withColumn("planned_id", call_id(F.col("split_name"), F.col("config_id"), F.col("item_id"), F.col("position"), revision))


CALL = ("attempt_index", "status", "run_id", "item_id", "config_id", "role", "topology_position", "provider", "parsed_answer", "failure_type")


def latest_calls(calls: DataFrame, columns: tuple[str, ...] = CALL) -> DataFrame:
    """One row per call id with the columns: of rows delivered twice the one with the most attempts, ties told apart by the columns' values."""
    rest = [c for c in columns if c != "attempt_index"]
    return calls.groupBy("call_id").agg(F.max(F.struct("attempt_index", *rest)).alias("c")).select("call_id", *[F.col(f"c.{c}").alias(c) for c in columns])


def upstream_answers(calls: DataFrame, plan: DataFrame) -> DataFrame:
    """(call_id, cards): for each call with upstream steps the answers of those steps of its run, item and method, in order of position.

    Calls are grouped once; a group is one item's method in one run, so its size is bounded by the plan.
    """
    keyed = calls.join(F.broadcast(plan.select("config_id", F.col("position").alias("topology_position"), "upstream")), ["config_id", "topology_position"])
    cards = keyed.groupBy("run_id", "item_id", "config_id").agg(F.collect_list(F.struct("topology_position", "role", "parsed_answer", "call_id", "upstream")).alias("all"))
    each = cards.select("all", F.explode("all").alias("me")).filter(F.size("me.upstream") > 0)
    chosen = F.array_sort(F.filter("all", lambda x: F.array_contains(F.col("me.upstream"), x["topology_position"])))
    return each.select("me.call_id", F.transform(chosen, lambda x: F.struct(x["topology_position"].alias("position"), x["role"].alias("role"), x["parsed_answer"].alias("answer"))).alias("cards"))


def render_cards(rows: DataFrame) -> DataFrame:
    """(call_id, prompt): upstream cards numbered and delimited in order, blank ones dropped, with a final newline."""
    kept = F.filter("cards", lambda c: c["answer"].isNotNull() & (F.trim(c["answer"]) != ""))
    text = F.transform(kept, lambda c, i: F.concat(F.lit("<<CARD "), (i + 1).cast("string"), F.lit(" "), c["role"], F.lit(">>\n"), c["answer"], F.lit("\n<<END>>")))
    return rows.select("call_id", F.concat(F.array_join(text, "\n\n"), F.lit("\n")).alias("prompt"))


def majority_votes(calls: DataFrame) -> DataFrame:
    """Per run, item and voting method: votes, yes votes, and the majority, or null where the number is even or a vote is no YES or NO."""
    voted = calls.filter(F.col("config_id").isin(*VOTES)).groupBy("run_id", "item_id", "config_id").agg(
        F.count("*").alias("votes"), F.count_if(F.col("parsed_answer") == "YES").alias("yes"), F.count_if(F.col("parsed_answer").isin("YES", "NO")).alias("valid")
    )
    whole = (F.col("votes") % 2 == 1) & (F.col("valid") == F.col("votes"))
    return voted.withColumn("winner", F.when(whole & (F.col("yes") * 2 > F.col("votes")), "YES").when(whole, "NO"))


def final_answers(calls: DataFrame) -> DataFrame:
    """(run_id, item_id, config_id, final_answer): the majority for voting methods, else the last step's YES or NO; null if there is none."""
    last = calls.filter(~F.col("config_id").isin(*VOTES)).groupBy("run_id", "item_id", "config_id").agg(F.max(F.struct("topology_position", "call_id", "parsed_answer")).alias("l"))
    single = last.select("run_id", "item_id", "config_id", F.when(F.col("l.parsed_answer").isin("YES", "NO"), F.col("l.parsed_answer")).alias("final_answer"))
    return single.unionByName(majority_votes(calls).select("run_id", "item_id", "config_id", F.col("winner").alias("final_answer")))
