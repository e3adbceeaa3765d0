"""Evaluation texts inside a corpus: rare word n-gram seeds, then Smith-Waterman alignment of the candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.text import words
from tallyard.runtime import cut, small_side

SEED_WORDS = 5
#: A run of this many consecutive words is a leak; every such run holds a seed.
RUN_WORDS = 13
#: Part of a test item's best possible score from which an alignment is an edited copy.
SHARE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Documents and test items compared by their words at once in one task.
BLOCK_DOCS, BLOCK_TESTS = 2_000, 1_000
#: Pairs aligned at once in one task, as cells of the alignment matrix's row.
BATCH_CELLS = 2_000_000

_LAYOUT = "doc_id {doc}, eval_id {eval}, score int, matched int, longest_run int, eval_words int"


def ngrams(tokens: Column, size: int) -> Column:
    """64-bit hashes of all runs of size tokens, in order; fewer tokens give an empty array."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i + 1, size), " ")))


def rare_seeds(grams: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Of grams (eval_id, pos, gram) those that are rarest in some window of so many consecutive ones.

    counts has gram and how often the corpus holds it; grams that the corpus lacks cannot lead anywhere and are
    passed over. Ties go to the earlier place. Every window keeps its rarest gram that occurs at all, so a run as
    long as a window is never missed, and copies edited here and there are met at what is left of them.
    """
    known = grams.join(counts, "gram", "left").withColumn("rank", F.when(F.col("c") > 0, F.struct(F.col("c").alias("c"), F.col("pos").alias("p"))))
    spans = Window.partitionBy("eval_id").orderBy("pos").rowsBetween(0, window - 1)
    best = known.withColumn("seed", F.min("rank").over(spans)["p"])
    # the last window of a text is the last full one; shorter texts have one window of all grams
    last = Window.partitionBy("eval_id")
    full = best.withColumn("end", F.max("pos").over(last)).filter(F.col("pos") <= F.greatest(F.col("end") - (window - 1), F.lit(0)))
    chosen = full.select("eval_id", F.col("seed").alias("pos")).filter("pos is not null").distinct()
    return grams.join(chosen, ["eval_id", "pos"])


def _pieces(tokens: list[str]) -> list[tuple]:
    """The words and the pairs of neighbours, each with how often it came before."""
    seen: dict[object, int] = {}
    made = []
    for piece in [*tokens, *zip(tokens, tokens[1:])]:
        seen[piece] = k = seen.get(piece, 0) + 1
        made.append((piece, k))
    return made


def _alike(docs: pd.DataFrame, tests: pd.DataFrame, share: float) -> pd.DataFrame:
    """(doc_id, eval_id) of the pairs that have enough words and pairs of neighbours in common for the share of the score."""
    places: dict[tuple, int] = {}
    held = [[places.setdefault(x, len(places)) for x in _pieces(list(t))] for t in tests["eval_tokens"]]
    has = np.zeros((len(places), len(tests)), np.uint8)
    for k, own in enumerate(held):
        has[own, k] = 1
    least = np.array([len(t) * MATCH * share for t in tests["eval_tokens"]])
    rows = []
    for doc, tokens in zip(docs["doc_id"], docs["doc_tokens"], strict=True):
        own = [places[x] for x in _pieces(list(tokens)) if x in places]
        common = has[own].sum(axis=0, dtype=np.int32)
        rows += [(doc, tests["eval_id"].iat[k]) for k in np.flatnonzero((common > 0) & (common + 1 >= least))]
    return pd.DataFrame(rows, columns=["doc_id", "eval_id"])


def alike_pairs(read: DataFrame, tested: DataFrame, share: float, docs: int, tests: int) -> DataFrame:
    """(doc_id, eval_id) of all pairs whose alignment could have at least this share of the test item's best score.

    An alignment of m equal words and e edits scores 2m - e. It has m words in common and, as e edits leave at most
    e + 1 runs, m - e - 1 pairs of neighbours; so the words and pairs in common, counted with repeats, are at least
    the score less one. docs and tests are about how many rows there are; blocks of the two are compared in a task.
    """
    block = lambda c, rows, size: F.pmod(F.xxhash64(c), F.lit(rows // size + 1)).cast("int")
    parts, blocks = docs // BLOCK_DOCS + 1, tests // BLOCK_TESTS + 1
    left = read.withColumn("part", block("doc_id", docs, BLOCK_DOCS)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = tested.filter(F.size("eval_tokens") > 0).withColumn("block", block("eval_id", tests, BLOCK_TESTS)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = dict(read.dtypes) | dict(tested.dtypes)
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(lambda a, b: _alike(a, b, share), f"doc_id {kinds['doc_id']}, eval_id {kinds['eval_id']}")


def _align(batch: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """(best local alignment's score, longest common subsequence, longest equal run) of each pair of word lists."""
    height = max(len(a) for a, _ in batch)
    width = max(len(b) for _, b in batch)
    ids: dict[str, int] = {}
    left = np.full((len(batch), height), -1, np.int32)
    right = np.full((len(batch), width), -2, np.int32)
    for k, (a, b) in enumerate(batch):
        left[k, : len(a)] = [ids.setdefault(w, len(ids)) for w in a]
        right[k, : len(b)] = [ids.setdefault(w, len(ids)) for w in b]
    score = np.zeros((len(batch), width + 1), np.int32)
    equal = np.zeros((len(batch), width + 1), np.int32)
    run = np.zeros((len(batch), width + 1), np.int32)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    top, most, longest = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
    for i in range(height):
        same = left[:, i : i + 1] == right
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        longest = np.maximum(longest, run.max(axis=1))
        fresh = np.zeros_like(score)
        fresh[:, 1:] = np.maximum(score[:, :-1] + np.where(same, MATCH, MISMATCH), score[:, 1:] + GAP)
        np.maximum(fresh, 0, out=fresh)
        score = np.maximum.accumulate(fresh + ramp, axis=1) - ramp  # a gap in the row: the best of all cells to the left
        # longest common subsequence by the same sweep, as matched words
        step = np.maximum(equal[:, 1:], equal[:, :-1] + same)
        equal[:, 1:] = np.maximum.accumulate(step, axis=1)
        top = np.maximum(top, score.max(axis=1))
        most = equal[:, -1]
    return list(zip(top.tolist(), most.tolist(), longest.tolist(), strict=True))


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        order = sorted(range(len(batch)), key=lambda i: len(batch["doc_tokens"].iat[i]))
        rows, chunk, cells = [], [], 0

        def flush(rows=rows):
            if chunk:
                pairs = [(list(batch["eval_tokens"].iat[i]), list(batch["doc_tokens"].iat[i])) for i in chunk]
                rows += [(batch["doc_id"].iat[i], batch["eval_id"].iat[i], *x, len(p[0])) for i, p, x in zip(chunk, pairs, _align(pairs), strict=True)]
                chunk.clear()

        for i in order:
            width = len(batch["doc_tokens"].iat[i])
            if (len(chunk) + 1) * width > BATCH_CELLS:
                flush()
            chunk.append(i)
        flush()
        yield pd.DataFrame(rows, columns=["doc_id", "eval_id", "score", "matched", "longest_run", "eval_words"])


def leak_alignments(documents: DataFrame, tests: DataFrame, doc_id: str = "doc_id", eval_id: str = "eval_id", text: str = "text", run_words: int = RUN_WORDS, share: float | None = None) -> DataFrame:
    """(doc_id, eval_id, score, matched, longest_run, eval_words) of every document and test item that share a seed or, if
    share is given, could have an alignment of that share of the item's best possible score: none that has is missed.

    Seeds are the test items' SEED_WORDS-grams that are rarest in the corpus, at least one in every run of
    run_words words, so each pair with such a run is a candidate; without share, pairs with edited copies are candidates
    only where one seed survived. Candidates are aligned on their whole texts: score is Smith-Waterman's, matched the longest
    common subsequence of words, longest_run the longest run of equal consecutive words. Null and empty texts
    and texts without words match nothing; documents with equal text are separate; repeated rows of one id are one.
    The test items' n-grams are broadcast only if their counted number allows it.
    """
    tested = cut(tests.select(F.col(eval_id).alias("eval_id"), words(F.col(text)).alias("eval_tokens")).filter("eval_id is not null").distinct())
    grams = cut(tested.select("eval_id", F.posexplode(ngrams(F.col("eval_tokens"), SEED_WORDS)).alias("pos", "gram")))
    known = grams.select("gram").distinct()
    count = grams.count()
    read = documents.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("doc_tokens")).filter(F.col("doc_id").isNotNull() & (F.size("doc_tokens") >= (SEED_WORDS if share is None else 1)))
    long = read.select("doc_id", F.explode(ngrams(F.col("doc_tokens"), SEED_WORDS)).alias("gram"))
    hits = cut(long.join(small_side(known, count), "gram").groupBy("doc_id", "gram").agg(F.count("*").alias("n")))
    counts = hits.groupBy("gram").agg(F.sum("n").alias("c"))
    seeds = cut(rare_seeds(grams, counts, run_words - SEED_WORDS + 1).select("eval_id", "gram").distinct())
    pairs = cut(hits.join(small_side(seeds, count), "gram").select("doc_id", "eval_id").distinct())
    if share is not None:
        pairs = cut(pairs.unionByName(alike_pairs(read, tested, share, documents.count(), tested.count())).distinct())
    # few pairs go to the documents, so that texts are shuffled only where they are candidates, and repeats are told by their hash
    both = read.join(small_side(pairs, pairs.count()), "doc_id").join(small_side(tested, count), "eval_id")
    both = both.withColumn("_text", F.sha2(F.to_json("doc_tokens"), 256)).dropDuplicates(["doc_id", "eval_id", "_text"])
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    layout = _LAYOUT.format(doc=kinds["doc_id"], eval=kinds["eval_id"])
    return both.select("doc_id", "eval_id", "doc_tokens", "eval_tokens").mapInPandas(_score, layout)


def leaks(alignments: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, eval_id) of the alignments with a run of at least so many consecutive words."""
    return alignments.filter(F.col("longest_run") >= run_words).select("doc_id", "eval_id").distinct()


def edited_leaks(alignments: DataFrame, share: float = SHARE) -> DataFrame:
    """The alignments that cover at least this share of the test item's best possible score, edited copies included."""
    return alignments.filter(F.col("score") >= F.col("eval_words") * MATCH * share)
