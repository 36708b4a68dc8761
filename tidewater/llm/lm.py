"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count is stored as its level on a scale that is exact for small counts and logarithmic
for large ones: an n-gram of level l enters the filter l times, paired with 1 to l. A reader
probes for these pairs one after another until one is missing, and takes the middle of the
last level as the count. So an error can only raise a count, by one level with the chance
that all probes of an absent pair hit.

The filter is cut into shards by the n-gram's hash. Each shard is built by one task and is
as long as its own entries need, so the filter grows with the corpus. Up to a size that is
checked it is broadcast; beyond it the n-grams asked for go to the shards instead.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, scratch

#: Longest n-gram, and the weight of the shorter ones: so many occurrences of a context count as much as they do.
ORDER, STRENGTH = 2, 200.0
#: What is added to the count of every single word.
ADDED = 0.1
#: Ratio of neighbouring levels of large counts; bits of the filter for an entry, and its probes.
RATIO, BITS, PROBES = 1.25, 8, 5
#: Bits of a block of the filter, and levels of an n-gram that share one.
BLOCK_BITS, LEVELS_OF_BLOCK = 512, 4
#: N-grams of a shard at most on average, and bytes of a filter that is broadcast.
SHARD_GRAMS, BROADCAST_BYTES = 1 << 19, 128 << 20
#: Words whose exact counts are broadcast, and bytes of each: 12.6 MB and their counts. All other words are joined.
FREQUENT_WORDS, FREQUENT_BYTES = 1 << 18, 48
#: Bytes of texts that ask a filter which is not broadcast, and bytes of the shards that answer as one: few large rows go between them.
PACK_BYTES, GROUP_BYTES = 8 << 20, 8 << 20
#: Bytes of texts that are scored at once, entries that a task holds, and words that a worker keeps.
CHUNK_BYTES, HELD, CACHED_WORDS = 2 << 20, 1 << 20, 200_000
#: The token that ends every text; no word is empty.
END = b""

_MASKS = np.array([1 << i for i in range(8)], np.uint8)
_START = np.uint64(0x9E3779B97F4A7C15)
_FOLD, _STEP = np.uint64(0xD1342543DE82EF95), 0xA24BAED4963EE407


def tokens(text: bytes) -> list[bytes]:
    """Words with A to Z lower-cased, then END."""
    return [*text.lower().split(), END]


def level_starts(ratio: float = RATIO) -> np.ndarray:
    """The smallest count of each level from 1 on, up to 2^62."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out[:-1], np.int64)


_STARTS = level_starts()
#: The count that stands for each level, 0 for none: the middle of the level.
ESTIMATES = np.r_[0.0, (_STARTS + np.r_[_STARTS[1:], _STARTS[-1] * RATIO] - 1) / 2]


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_STARTS, counts, "right")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hashes."""
    return ((grams >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _place(grams: np.ndarray, level: int, bits: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The block of (n-gram, level) in a shard of so many bits, and what its places there are made of.

    All places of an entry lie in one block, and four levels share one: a reader mostly
    fetches one stretch of memory for an n-gram.
    """
    of = _mix(grams + np.uint64((level - 1) // LEVELS_OF_BLOCK * _STEP % (1 << 64))) >> np.uint64(32)
    return (of * (bits // np.uint64(BLOCK_BITS)) >> np.uint64(32)) * np.uint64(BLOCK_BITS), _mix(grams ^ np.uint64((level + 1) * _STEP % (1 << 64)))


def _bit(places: np.ndarray, probe: int) -> np.ndarray:
    return (places >> np.uint64(9 * probe)) & np.uint64(BLOCK_BITS - 1)


def shard(grams: np.ndarray, counts: np.ndarray, bits_each: int = BITS) -> tuple[bytes, int]:
    """A shard's bits for different n-grams with their counts, and its number of entries."""
    levels = level_of(counts)
    entries = int(levels.sum())
    bits = BLOCK_BITS * max(1, -(-bits_each * entries // BLOCK_BITS))
    held = np.zeros(bits, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        block, places = _place(grams[levels >= j], j, np.uint64(bits))
        for i in range(PROBES):
            held[block + _bit(places, i)] = True
    return np.packbits(held, bitorder="little").tobytes(), entries


class CountFilter:
    """All shards side by side."""

    def __init__(self, shards: int, parts: Iterator[tuple[int, bytes]], size: int):
        self.shards = shards
        self.offsets, self.bits = np.zeros(shards, np.uint64), np.full(shards, BLOCK_BITS, np.uint64)
        self.data = np.zeros(size + BLOCK_BITS // 8, np.uint8)  # a shard without n-grams reads the last block, which is zero
        self.offsets[:] = size * 8
        at = 0
        for i, part in parts:
            self.data[at : at + len(part)] = np.frombuffer(part, np.uint8)
            self.offsets[i], self.bits[i] = at * 8, len(part) * 8
            at += len(part)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probes for level 1, 2 and so on until one is missing."""
        out, live = np.zeros(len(grams), np.int64), np.arange(len(grams))
        at = _shard_of(grams, self.shards)
        offsets, bits = self.offsets[at], self.bits[at]
        for j in range(1, len(ESTIMATES)):
            block, places = _place(grams, j, bits)
            block += offsets
            some = np.flatnonzero(self._has(block + _bit(places, 0)))
            for i in range(1, PROBES):
                some = some[self._has(block[some] + _bit(places[some], i))]
            live, grams, offsets, bits = live[some], grams[some], offsets[some], bits[some]
            if not len(live):
                break
            out[live] = j
        return out

    def _has(self, at: np.ndarray) -> np.ndarray:
        at = at.view(np.int64)
        return (self.data.take(at >> 3) & _MASKS.take(at & 7)) != 0


class Words(dict):
    """Words of a worker -> their places in `hashes`, `counts` and `levels`; a level is -1 until it is asked for."""

    def __init__(self, exact: dict[bytes, int] | None = None):
        super().__init__()
        self.exact, self.names, self.hashes, self.counts, self.levels = exact or {}, [], array("Q"), array("q"), array("h")

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, 7))
        self.counts.append(self.exact.get(word, 0))
        self.levels.append(-1)
        return at

    def estimates(self, levels: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The counts that the filter gives for all words; only new ones are asked for."""
        found = np.array(self.levels)
        new = np.flatnonzero(found < 0)
        found[new] = levels(np.array(self.hashes, np.uint64)[new])
        self.levels = array("h", found.tobytes())
        return ESTIMATES[found]

    def trim(self) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()
            self.names, self.hashes, self.counts, self.levels = [], array("Q"), array("q"), array("h")


class Chunk:
    """The tokens of some texts one after another, and the hashes of their n-grams."""

    def __init__(self, texts: list[bytes], words: Words, order: int):
        lines = [tokens(t) for t in texts]
        sizes = np.array([len(x) for x in lines], np.int64)
        self.sizes, self.first = sizes, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        self.at = np.fromiter(map(words.__getitem__, chain.from_iterable(lines)), np.int64, int(sizes.sum()))
        one = np.array(words.hashes, np.uint64)[self.at]
        place = np.arange(len(one)) - np.repeat(self.first, sizes)
        self.grams, self.valid = [one], [np.ones(len(one), bool)]
        for n in range(2, order + 1):
            before = np.r_[_START, self.grams[-1][:-1]]
            if n == 2:
                before[self.first] = _START
            self.grams.append(_mix(before * _FOLD + one))
            self.valid.append(place >= n - 2)

    def all_grams(self) -> np.ndarray:
        return np.concatenate([g[v] for g, v in zip(self.grams, self.valid, strict=True)])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[list]]]:
    """Texts of CHUNK_BYTES, or one longer text, with the rows' other columns."""
    texts: list[bytes] = []
    rest: list[list] = []
    size = 0
    for b in batches:
        for text, *others in zip(*b.columns, strict=True):  # values one by one: a batch's texts are not copied at once
            texts.append(text.as_py())
            rest.append([x.as_py() for x in others])
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield texts, rest
                texts, rest, size = [], [], 0
    if texts:
        yield texts, rest


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column of texts in binary, END included; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for part, _ in chunks(batches):
            for t in part:
                held.update(tokens(t))
            if len(held) >= HELD // 4:
                yield flush()
        yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def filter_shards(texts: DataFrame, shards: int, order: int = ORDER, bits_each: int = BITS) -> DataFrame:
    """(shard, bits, entries) for the n-grams of a column of texts in binary.

    Tasks count their n-grams and send a shard its part as one packed row, so that common
    n-grams are not moved one by one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0

        def flush() -> pa.RecordBatch:
            grams, n = _summed(np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held]))
            at = _shard_of(grams, shards).astype(np.int64)
            ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True]) + 1
            starts = np.r_[0, ends[:-1]]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(at[starts], pa.int32()), pa.array([grams[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()), pa.array([n[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())],
                ["shard", "grams", "counts"],
            )

        for part, _ in chunks(batches):
            words.trim()
            grams, n = np.unique(Chunk(part, words, order).all_grams(), return_counts=True)
            held.append((grams, n.astype(np.int64)))
            size += len(grams)
            if size >= HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
        bits, entries = shard(*_summed(join("grams", np.uint64), join("counts", np.int64)), bits_each)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary()), "entries": pa.array([entries], pa.int64())})

    return texts.mapInArrow(count, "shard int, grams binary, counts binary").groupBy("shard").applyInArrow(build, "shard int, bits binary, entries long")


@dataclass(frozen=True)
class Model:
    """What scoring needs besides n-gram levels: tokens, different tokens and texts of the training texts, and exact counts of the frequent words."""

    tokens: int
    words: int
    texts: int
    order: int
    strength: float
    exact: dict[bytes, int]

    @property
    def below(self) -> float:
        return self.tokens + ADDED * (self.words + 1)

    def scores(self, chunk: Chunk, words: Words, levels: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """log10 of the probability of each text.

        A word's own probability is (count + ADDED) over the sum of these. Each longer
        n-gram is added as (count + strength * shorter) / (context's count + strength); it
        counts no more often than its context or its word, and is not asked for where one of
        them is unknown.
        """

        def asked(grams: np.ndarray, where: np.ndarray) -> np.ndarray:
            out = np.zeros(len(grams))
            different, at = np.unique(grams[where], return_inverse=True)
            out[where] = ESTIMATES[levels(different)][at]
            return out

        one = words.estimates(levels)[chunk.at]
        p, joint = (one + ADDED) / self.below, one
        for n in range(2, self.order + 1):
            context = np.r_[0.0, joint[:-1]]
            if n == 2:
                context[chunk.first] = self.texts
            context[~chunk.valid[n - 1]] = 0
            most = np.minimum(context, joint)
            joint = np.minimum(asked(chunk.grams[n - 1], most > 0), most)
            p = np.where(context > 0, (joint + self.strength * p) / (context + self.strength), p)
        return np.add.reduceat(np.log10(p), chunk.first)

    def rows(self, texts: list[bytes], words: Words, levels: Callable[[np.ndarray], np.ndarray], rest: list[list]) -> pa.RecordBatch:
        """SCORED of some texts; `rest` has doc_id and held_out of each."""
        return self.rows_of(Chunk(texts, words, self.order), words, levels, rest)

    def rows_of(self, chunk: Chunk, words: Words, levels: Callable[[np.ndarray], np.ndarray], rest: list[list]) -> pa.RecordBatch:
        """SCORED of a chunk's texts."""
        score = self.scores(chunk, words, levels)
        count = np.array(words.counts, np.int64)[chunk.at]
        known = count > 0
        base = np.add.reduceat(np.where(known, np.log10((count + ADDED) / self.below), 0), chunk.first)
        rare = np.flatnonzero(~known)
        of = np.searchsorted(chunk.first, rare, "right") - 1
        pairs, n = np.unique((of << 32) | chunk.at[rare], return_counts=True)
        ends = pa.array(np.searchsorted(pairs >> 32, np.arange(len(chunk.sizes) + 1)), pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(ends, values)
        names = pa.array([words.names[i] for i in (pairs & 0xFFFFFFFF).tolist()], pa.binary())
        columns = [pa.array([r[0] for r in rest], pa.int64()), pa.array([r[1] for r in rest], pa.bool_()), pa.array(chunk.sizes), pa.array(np.add.reduceat(known.astype(np.int64), chunk.first)), pa.array(base), pa.array(score), lists(names), lists(pa.array(n, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])


SCORED = "doc_id long, held_out boolean, n_tokens long, frequent long, base double, score double, rare_words array<binary>, rare_counts array<long>"


def frequent_words(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words with exact counts: at most FREQUENT_WORDS of at most FREQUENT_BYTES bytes, all down to some count."""
    short = counts.where(F.length("word") <= FREQUENT_BYTES).withColumn("size", F.floor(F.log2("n") * 16))
    least, total = None, 0
    for r in sorted(short.groupBy("size").count().collect(), key=lambda r: -r["size"]):  # at most 1,008 sizes
        total += r["count"]
        if total > FREQUENT_WORDS:
            break
        least = r["size"]
    return {} if least is None else {bytes(r["word"]): r["n"] for r in short.where(F.col("size") >= least).select("word", "n").toLocalIterator()}


def _broadcast_scores(rows: DataFrame, model: Model, shards: DataFrame, n_shards: int, size: int) -> DataFrame:
    parts = ((r["shard"], r["bits"]) for r in shards.select("shard", "bits").toLocalIterator())
    sent = rows.sparkSession.sparkContext.broadcast((model, CountFilter(n_shards, parts, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = sent.value
        words = Words(held.exact)
        for texts, rest in chunks(batches):
            words.trim()
            yield held.rows(texts, words, counts.levels, rest)

    out = materialize(rows.mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    sent.unpersist()
    return out


def _sharded_scores(rows: DataFrame, model: Model, shards: DataFrame, n_shards: int, size: int, pack_bytes: int = PACK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The same as _broadcast_scores with a filter of any size: packs of texts ask groups of shards for their n-grams.

    A pack's different n-grams are sorted and groups are ranges of the hashes, so levels come
    back alone: those of all groups one after another are the levels of the pack's n-grams.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    placed = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    packs = max(1, math.ceil((placed.agg(F.sum(F.length("text"))).first()[0] or 0) / pack_bytes))
    placed = placed.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(packs)).cast("int")).select("text", "doc_id", "held_out", "pack")
    groups = min(n_shards, max(1, math.ceil(size / group_bytes)))
    grouped = shards.withColumn("group", F.floor(F.col("shard").cast("long") * groups / n_shards).cast("int")).select("group", "shard", "bits")

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        grams = np.unique(Chunk(texts["text"].to_pylist(), Words(), sent.value.order).all_grams())
        at = _shard_of(grams, n_shards).astype(np.int64) * groups // n_shards
        ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True]) + 1
        starts = np.r_[0, ends[:-1]]
        return pa.table({"group": pa.array(at[starts], pa.int32()), "pack": pa.array([key[0].as_py()] * len(ends), pa.int32()), "grams": pa.array([grams[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())})

    def answer(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        counts = CountFilter(n_shards, zip(own["shard"].to_pylist(), (b.as_py() for b in own["bits"]), strict=True), sum(len(b.as_buffer()) for b in own["bits"]))
        levels = [counts.levels(np.frombuffer(g.as_buffer(), np.uint64)).astype(np.uint8).tobytes() for g in asked["grams"]]
        return pa.table({"pack": asked["pack"], "group": pa.array([key[0].as_py()] * len(levels), pa.int32()), "levels": pa.array(levels, pa.binary())})

    def finish(_key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        model = sent.value
        words = Words(model.exact)
        chunk = Chunk(texts["text"].to_pylist(), words, model.order)
        grams = np.unique(chunk.all_grams())
        levels = np.frombuffer(b"".join(answers.sort_by("group")["levels"].to_pylist()), np.uint8).astype(np.int64)
        rest = list(zip(texts["doc_id"].to_pylist(), texts["held_out"].to_pylist(), strict=True))
        return pa.Table.from_batches([model.rows_of(chunk, words, lambda g: levels[np.searchsorted(grams, g)], rest)])

    asked = placed.groupBy("pack").applyInArrow(ask, "group int, pack int, grams binary")
    answers = asked.groupBy("group").cogroup(grouped.groupBy("group")).applyInArrow(answer, "pack int, group int, levels binary")
    found = placed.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(finish, SCORED)
    out = materialize(found.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    sent.unpersist()
    return out


def score(
    docs: DataFrame, held_out: Column, order: int = ORDER, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The model learns from the rows for which `held_out` is false. n_known counts the tokens
    that occur in training texts, train_tokens all tokens of these; base_score is the sum of
    log10 of the words' own probabilities, from exact counts; score is the model's log10
    probability of the text, from the filter. Words of at most FREQUENT_BYTES bytes that are
    among the most frequent have their counts sent along, all others are joined by word.

    A null or empty text has only its end. Repeated rows are learned from and scored
    repeatedly, a null held_out counts as false, a null doc_id stays null, extra columns are
    not read, and without training texts every score is 0. An empty table gives an empty
    result. A filter of over `broadcast_bytes` is not broadcast; results are the same.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.where("not held_out").select("text")
    with scratch(docs.sparkSession) as keep:
        counts = keep(materialize(word_counts(train), "lm-words"))
        total, different, texts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
        model = Model(total, different, texts, order, strength, frequent_words(counts))
        n_shards = max(1, math.ceil(total * order / SHARD_GRAMS))
        shards = materialize(filter_shards(train, n_shards, order, bits), "lm-filter")
        size = shards.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
        scored = keep(_broadcast_scores(rows, model, shards, n_shards, size) if size <= broadcast_bytes else _sharded_scores(rows, model, shards, n_shards, size))
    one = scored.select("row", F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("r")).select("row", F.col("r.rare_words").alias("word"), F.col("r.rare_counts").alias("times"))
    found = one.join(counts, "word", "left")
    part = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + ADDED) / model.below)
    rare = found.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"), F.sum(part.cast("decimal(38,15)")).alias("part"))  # decimals: the order of rows changes nothing
    known = (F.col("frequent") + F.coalesce("known", F.lit(0))).cast("long")
    base = F.col("base") + F.coalesce(F.col("part").cast("double"), F.lit(0.0))
    return scored.join(rare, "row", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
