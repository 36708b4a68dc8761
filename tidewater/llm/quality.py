"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Trees on text statistics give paths; each path is a conjunctive rule. A logistic model with
an L1 penalty weighs the rules, most get no weight, and the rest become one expression over
the columns of statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import columns_of, materialize

#: Labelled rows that the trees and weights are fit on, at most; they are taken in the order of a hash.
SAMPLE_ROWS = 12_000
TREES, DEPTH, L1 = 16, 4, 0.002

STATISTICS = (
    "words_log", "word_bytes", "upper", "symbols", "exclaims", "digits", "stops", "commas", "wide", "distinct_words",
    "top_word", "repeats", "one_case", "symbol_words", "lines_log", "line_words", "distinct_lines", "longest_word_log",
)

_CLASS = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 stop, 5 comma, 6 exclamation, 7 other symbol, 8 beyond ASCII
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".?", b",;:'\"-()", b"!"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = 7
_CLASS[128:] = 8


def statistics(data: bytes | None) -> list[float]:
    """The STATISTICS of a whole text in UTF-8; all zero for a null, empty or blank one."""
    words = (data or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    by = np.bincount(_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=9)
    size = by[1:].sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        np.log1p(n), size / n, by[1] / max(1.0, by[1] + by[2]), by[7] / size, by[6] / size, by[3] / size, by[4] / n, by[5] / n, by[8] / size, len(counts) / n,
        max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(w.isupper() for w in words) / n, sum(_CLASS[w[-1]] >= 6 and w[-1] < 128 for w in words) / n,
        np.log1p(len(lines)), n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, words))),
    ]


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def _statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(np.array([statistics(t) for t in text], np.float64).reshape(-1, len(STATISTICS)), columns=list(STATISTICS))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, `__stats`: the struct of STATISTICS of each whole text."""
    once = _statistics.asNondeterministic()  # so that no rewrite computes it twice
    return docs.withColumn("__stats", once(F.col(text_col).cast("binary")))


@dataclass(frozen=True)
class Rule:
    """lo < statistic <= hi for every entry."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        tests = [F.col(f"__stats.{s}") > lo for s, lo, _ in self.bounds if lo > -np.inf] + [F.col(f"__stats.{s}") <= hi for s, _, hi in self.bounds if hi < np.inf]
        return reduce(Column.__and__, tests).cast("double")


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The probability as one expression over the columns of STATISTICS."""
        z = reduce(Column.__add__, (r.column() * F.lit(w) for r, w in self.weights), F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_rules(node, held: dict[str, tuple[float, float]] | None = None) -> Iterator[Rule]:
    """A rule for every node but the root, from a fitted tree's JVM nodes."""
    held = held or {}
    if held:
        yield Rule(tuple((s, *held[s]) for s in sorted(held)))
    if node.getClass().getSimpleName() == "InternalNode":
        name, at = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        lo, hi = held.get(name, (-np.inf, np.inf))
        yield from tree_rules(node.leftChild(), held | {name: (lo, min(hi, at))})
        yield from tree_rules(node.rightChild(), held | {name: (max(lo, at), hi)})


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Is crc32 of the id as text, modulo `parts`, equal to `part`? False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    """Fit on labelled rows for which `may_learn` holds, a column over the labels' doc_id.

    Of repeated labels of a document the largest counts. Without labels of both kinds the
    score is the same for every text: the share of label 1, or one half without labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(may_learn).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    rows = with_statistics(texts).join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.max("__stats").alias("__stats"))
    rows = materialize(rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), "quality-sample")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = 0.5 if not n else min(0.999, max(0.001, ones / n))
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    rows = rows.withColumn("features", array_to_vector(F.array(*(f"__stats.{s}" for s in STATISTICS)))).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, labelCol="label", seed=7, minInstancesPerNode=5).fit(rows)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree._call_java("rootNode"))}, key=repr)
    held = rows.select("label", array_to_vector(F.array(*(r.column() for r in rules))).alias("features")) if rules else None
    rows_by = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=L1, maxIter=100).fit(held) if rules else None
    rows.unpersist()
    if rows_by is None:
        return RuleEnsemble(float(np.log(ones / (n - ones))), ())
    return RuleEnsemble(float(rows_by.intercept), tuple((r, float(w)) for r, w in zip(rules, rows_by.coefficients.toArray(), strict=True) if w))


def classify(docs: DataFrame, model: RuleEnsemble, parts: int = 5, part: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row, from the whole text alone.

    A null or empty text is scored like any other, by zero statistics. Repeated rows stay
    repeated, a null id is never held out, extra columns are ignored, and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_statistics(rows).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least `threshold`."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))  # texts are held once
    return with_statistics(rows, f"row.`{text_col}`").where(model.column() >= threshold).select("row.*")
