"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary text, one on toxic text. A window of words is
compressed with the ordinary dictionary alone and with the toxic one in front of it: how
many bytes the toxic one saves is the window's gain. A document's largest gains, and how
many windows gain how much, go through a calibrated logistic curve.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize
from tidewater.llm.quality import held_out

#: Labelled documents that are learned from, at most, toxic and ordinary; taken in the order of a hash.
TOXIC_DOCS, ORDINARY_DOCS = 2_000, 3_000
#: Windows of ordinary text and words of toxic text that the dictionaries are trained on, at most.
ORDINARY_WINDOWS, TOXIC_WORDS = 60_000, 4_000
#: A word or its first letters, as many as STEMS say, are toxic text with so many contexts in toxic documents, so many times their rate elsewhere.
CONTEXTS, LIFT, STEMS = 6, 20, (5, 6, 7, 8, 9)
#: Longer windows and words are not trained on, and no word more often than MOST_TIMES; scoring has no such bounds.
WINDOW_BYTES, WORD_BYTES, MOST_TIMES = 400, 60, 400
WINDOW, LEVEL, TOP = 5, 11, 3
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 4 << 10
FEATURES = TOP + 6
_BATCH = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def windows(data: bytes | None) -> list[bytes]:
    """All words of a text in windows of WINDOW, each with a space on either side."""
    words = (data or b"").lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes; of too few samples it is just their text."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Distance:
    """Two dictionaries and the curve over FEATURES values of a document."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    @staticmethod
    def features(data: bytes | None, compressors: list) -> np.ndarray:
        """1, largest gains, log of windows, log of gains above one, logs of windows that gain, mean gain."""
        found, top, sums = windows(data), np.zeros(TOP, np.int64), np.zeros(4)
        for i in range(0, len(found), _BATCH):
            part = found[i : i + _BATCH]
            gain = np.subtract(*([len(x) for x in c.multi_compress_to_buffer(part)] for c in compressors))
            top = np.sort(np.concatenate([top, gain]))[-TOP:]
            sums += np.maximum(gain - 1, 0).sum(), (gain >= 3).sum(), (gain >= 2).sum(), gain.sum()
        mean = np.clip(sums[3] / max(1, len(found)), -2, 2)
        return np.array([1.0, *np.clip(top[::-1], -4, 12), np.log1p(len(found)) / 10, *np.log1p(sums[:3]), mean])

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30))))


def _column(docs: DataFrame, model: Distance, raw: bool) -> DataFrame:
    """(doc_id, score), or (doc_id, x: the features) while the curve is fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model._compressors()
        for b in batches:
            x = [model.features(t.as_py(), compressors) for t in b.column(1)]
            out = pa.array([v.tolist() for v in x], pa.list_(pa.float64())) if raw else pa.array([model.score(v) for v in x], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["doc_id", "x" if raw else "score"])

    return docs.mapInArrow(run, "doc_id long, x array<double>" if raw else "doc_id long, score double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, with a small penalty on all but the first."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (y - p) - keep @ w)
    return w


def _toxic_words(sample: DataFrame) -> list[tuple[str, int]]:
    """Words whose contexts, each different pair of neighbours, are far more frequent in toxic documents."""
    words = F.filter(F.split(F.translate("text", _UPPER, _UPPER.lower()), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")  # as windows() does
    at = sample.select("toxic", words.alias("w")).select("toxic", "w", F.posexplode("w").alias("i", "word"))
    near = at.select("toxic", "word", F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1)).alias("around")).distinct()
    near = near.select("toxic", F.explode(F.array_distinct(F.array("word", *(F.left("word", F.lit(n)) for n in STEMS)))).alias("word"))
    is_toxic = F.col("toxic") == 1
    counts = near.groupBy("word").agg(F.count_if(is_toxic).alias("n"), F.count_if(~is_toxic).alias("m"))
    counts = materialize(counts, "contexts")
    n, m = counts.agg(F.sum("n"), F.sum("m")).first()
    often = counts.where((F.col("n") >= CONTEXTS) & (F.col("n") * (m or 0) >= LIFT * (F.col("m") + 1) * (n or 0)))
    return [(r.word, r.n) for r in often.orderBy(F.desc("n"), "word").limit(TOXIC_WORDS).collect()]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Distance:
    """Dictionaries and curve from labelled rows for which `may_learn` holds, a column over the labels' doc_id.

    The sample is bounded by TOXIC_DOCS and ORDINARY_DOCS. Dictionaries come from three
    quarters of it, the curve from the rest. Of repeated labels of a document the largest counts.
    Without labels of both kinds the score is the same for every text: the share of label
    1, or one half without labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda test, n: known.where(test).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = materialize(pick("toxic = 1", TOXIC_DOCS).union(pick("toxic <> 1", ORDINARY_DOCS)).withColumn("half", F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0, 1).otherwise(0)), "toxic-labels")
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if share in (None, 0.0, 1.0):
        share = 0.5 if share is None else min(0.999, max(0.001, share))
        return Distance(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * (FEATURES - 1)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id"), "toxic-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in b.column(0) for w in windows(t.as_py())], pa.binary())], ["w"])

    ordinary = sample.where("toxic <> 1 and half = 0").select(F.col("text").cast("binary")).mapInArrow(cut, "w binary").distinct()
    ordinary = [bytes(r.w) for r in ordinary.where(F.length("w") <= WINDOW_BYTES).orderBy(F.xxhash64("w"), "w").limit(ORDINARY_WINDOWS).collect()]
    bag = [w.encode() for w, n in _toxic_words(sample.where("half = 0")) for _ in range(min(n, MOST_TIMES)) if len(w.encode()) <= WORD_BYTES]
    random.Random(7).shuffle(bag)
    toxic = train([b" " + b" ".join(bag[i : i + 8]) + b" " for i in range(0, len(bag), 8)], TOXIC_BYTES) if bag else b""
    model = Distance(train(ordinary, ORDINARY_BYTES), toxic, ())
    found = _column(sample.where("half = 1").select("doc_id", F.col("text").cast("binary").alias("text")), model, raw=True).join(F.broadcast(chosen), "doc_id").select("x", "toxic").collect()
    if not found:
        return Distance(model.ordinary, model.toxic, (float(np.log(share / (1 - share))), *[0.0] * (FEATURES - 1)))
    weights = logistic(np.array([r.x for r in found]), np.array([float(r.toxic == 1) for r in found]))
    return Distance(model.ordinary, model.toxic, tuple(map(float, weights)))


def classify(docs: DataFrame, model: Distance, parts: int = 4, part: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row, from all windows of the text.

    A null or empty text has no windows and no gain. Repeated rows stay repeated, a null id
    is never held out, extra columns are ignored, and an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scored = _column(rows, model, raw=False)
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
