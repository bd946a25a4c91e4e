"""Quality rules with an isolation forest over their statistics.

Every document gets the statistics of the rules from its whole text. An isolation forest, grown on a bounded sample of
labelled rows, says how quickly random splits of these statistics set a document apart, and which statistic does so.
What counts as too quick is calibrated for each such statistic from all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.store import bounded_sample, map_columns, materialize, per_batch, read_table, slices
from pathloom.llm.words import WORD

SYMBOL = re.compile(r"[#*$%&|<>]")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "letters_per_word")
STATS_SCHEMA = ", ".join(f"{c} long" for c in STATS)


def rule_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; all zero for null and empty texts.

    n_repeat_words counts the words that a three-word window covers which is found twice or more in the text.
    """
    if not text:
        return 0, 0, 0, 0, 0
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if x and WORD.search(x)]
    windows = list(zip(found, found[1:], found[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(found), sum(map(len, found)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def base_fails(n_words, n_repeat_words, min_words: int = 50, max_repeat_percent: int = 50):
    """For numbers, arrays and columns alike."""
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def features(stats: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each row of STATS."""
    n, chars, symbols, lines, repeats = stats.T.astype(np.float64)
    at_least = np.maximum(n, 1)
    return np.column_stack([symbols / at_least, lines / at_least, repeats / at_least, np.maximum(chars - symbols, 0) / at_least])


def usual_path(n: float) -> float:
    """The mean path length of an unsuccessful search among n values: what a leaf of n rows still stands for."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: a node's feature (-1: leaf), border, the node of the lesser rows (the others' is the next one),
    its depth with what its rows still stand for, and the halvings that leading to it was worth."""

    feature: np.ndarray
    border: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    worth: np.ndarray
    levels: int
    usual: float

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anomaly score of each row in (0, 1), and the feature whose splits set it apart the most."""
        rows = np.arange(len(x))
        total, by_feature = np.zeros(len(x)), np.zeros((len(x), x.shape[1]))
        for tree in range(len(self.feature)):
            feature, border, child, worth = self.feature[tree], self.border[tree], self.child[tree], self.worth[tree]
            node = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                split = feature[node]
                inner = split >= 0
                column = np.maximum(split, 0)
                step = child[node] + (x[rows, column] >= border[node])
                by_feature[rows, column] += np.where(inner, worth[step], 0)
                node = np.where(inner, step, node)
            total += self.depth[tree][node]
        return 2.0 ** (-total / len(self.feature) / self.usual), by_feature.argmax(axis=1)


def grow_forest(x: np.ndarray, trees: int = 100, rows_per_tree: int = 256, seed: int = 7) -> Forest:
    """An isolation forest: each tree splits a sample at random borders of random features, to a depth of log2(sample)."""
    random = np.random.default_rng(seed)
    size = min(rows_per_tree, len(x))
    levels = max(1, math.ceil(math.log2(max(size, 2))))
    width = 2 ** (levels + 1)
    feature, child = np.full((trees, width), -1), np.zeros((trees, width), np.int64)
    border, depth, worth = (np.zeros((trees, width)) for _ in range(3))
    for tree in range(trees):
        todo, used = [(0, random.choice(len(x), size, replace=False), 0)], 1
        while todo:
            node, rows, level = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            splits = np.flatnonzero(high > low)
            if level == levels or len(rows) <= 1 or not len(splits):
                depth[tree, node] = level + usual_path(len(rows))
                continue
            f = random.choice(splits)
            at = min(max(low[f] + (high[f] - low[f]) * (1 - random.random()), np.nextafter(low[f], np.inf)), high[f])  # both sides have rows
            less = x[rows, f] < at
            feature[tree, node], border[tree, node], child[tree, node] = f, at, used
            for side, own in enumerate((rows[less], rows[~less])):
                worth[tree, used + side] = math.log2(len(rows) / max(len(own), 1))
                todo.append((used + side, own, level + 1))
            used += 2
    return Forest(feature, border, child, depth, worth, levels, max(usual_path(size), 1e-9))


@dataclass(frozen=True)
class QualityModel:
    """The forest and, for each feature that may set a document apart, the score from which it is rejected."""

    forest: Forest | None
    limits: np.ndarray

    def judge(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """score, group, rejected."""
        if self.forest is None or not len(stats):
            return np.zeros(len(stats)), np.zeros(len(stats), np.int64), np.zeros(len(stats), bool)
        score, group = self.forest.score(features(stats))
        return score, group, score >= self.limits[group]


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS for every row of docs; no shuffle."""

    def run(batch: pa.RecordBatch):
        for part in slices(batch, 1):
            found = list(zip(*map(rule_stats, part.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in found)], ["doc_id", *STATS])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {STATS_SCHEMA}")


BINS = 2000


def fit_quality(stats: DataFrame, labels: DataFrame, max_sample_rows: int = 25_600, cost_of_rejecting: float = 10.0) -> QualityModel:
    """Grows the forest and calibrates its limits.

    stats: doc_id and STATS; labels: doc_id and quality (1 good, 0 bad; other rows are no labels). The forest sees
    max_sample_rows labelled documents at most, picked by hash. The limits come from counts
    over all labelled documents in fixed bins of the score: of all limits, for each group the one of the least cost,
    a rejected good document costing as much as cost_of_rejecting kept bad ones. Without labelled documents of both
    kinds nothing is rejected.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
        .join(stats, "doc_id").filter(~base_fails(F.col("n_words"), F.col("n_repeat_words")))
    )
    known = materialize(known.select("doc_id", "quality", *STATS), "quality-labelled")
    nothing = QualityModel(None, np.full(len(FEATURES), np.inf))
    sample = bounded_sample(known, max_sample_rows, "doc_id", *STATS).select(*STATS).toPandas().to_numpy(np.int64)
    if len(sample) < 2:
        return nothing
    forest = grow_forest(features(sample))
    if not (forest.feature >= 0).any():
        return nothing

    def run(batch: pa.RecordBatch):
        score, group = forest.score(features(np.column_stack([batch.column(i + 1) for i in range(len(STATS))])))
        bins = np.minimum((score * BINS).astype(np.int64), BINS - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group), pa.array(bins)], ["quality", "feature", "bin"])

    scored = per_batch(known.select("quality", *STATS), run, "quality int, feature long, bin long")
    counts = np.zeros((2, len(FEATURES), BINS))
    for row in scored.groupBy("quality", "feature", "bin").count().collect():  # a row for each bin at most
        counts[row["quality"], row["feature"], row["bin"]] = row["count"]
    limits = np.full(len(FEATURES), np.inf)
    for f in range(len(FEATURES)):
        bad, good = counts[0, f], counts[1, f]
        if not bad.sum():
            continue
        from_here = lambda x: np.append(x[::-1].cumsum()[::-1], 0)
        cost = cost_of_rejecting * from_here(good) + bad.sum() - from_here(bad)
        best = np.flatnonzero(cost == cost.min())
        if best[-1] < BINS or cost[BINS] > cost.min():
            low, high = best[0], min(best[-1], BINS - 1)
            limits[f] = (low + high) / 2 / BINS  # the middle of equally cheap limits
    return QualityModel(forest, limits)


def apply_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Adds base_failed, score, set_apart_by and kept to doc_id, STATS."""
    names = np.array(FEATURES)

    def run(batch: pa.RecordBatch):
        table = np.column_stack([batch.column(i + 1) for i in range(len(STATS))]).reshape(-1, len(STATS))
        failed = base_fails(table[:, 0], table[:, 4])
        score, group, rejected = model.judge(table)
        extra = [pa.array(failed), pa.array(score), pa.array(names[group].tolist(), pa.string()), pa.array(~failed & ~rejected)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["doc_id", *STATS, "base_failed", "score", "set_apart_by", "kept"])

    return per_batch(stats.select("doc_id", *STATS), run, f"doc_id long, {STATS_SCHEMA}, base_failed boolean, score double, set_apart_by string, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs, all columns, that the rules and the model keep; no shuffle.

    Null and empty texts go, as they have no words. Rows without doc_id and repeated rows are judged one by one, by their
    texts alone. An empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, at)):
            table = np.array([rule_stats(t) for t in part.column(at).to_pylist()], np.int64).reshape(-1, len(STATS))
            _, _, rejected = model.judge(table)
            yield part.filter(pa.array(~rejected & ~base_fails(table[:, 0], table[:, 4])))

    return map_columns(docs, run)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed, score, set_apart_by, kept for every row of docs.

    Null and empty texts have no words and so fail the base rules. Rows that repeat a doc_id are judged one by one. A
    null doc_id has no label. Empty tables give an empty result. Other columns of docs and labels are ignored.
    """
    stats = materialize(document_stats(docs), "quality-stats")
    return apply_quality(stats, fit_quality(stats, labels))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the method's score over the whole of documents."""
    return judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
