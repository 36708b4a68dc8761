"""Substring deduplication with a log-structured fingerprint index.

Every window of WINDOW words is filed under its anchor: the phrase of PHRASE words in it
with the smallest hash. Equal windows have equal anchors, and neighbouring windows mostly
share theirs, so one index row stands for a segment of about twenty windows. The index is
a log of sorted immutable runs of such rows. A batch is merge-joined with the runs, segments
that are equal as a whole are matched at once, windows of segments that differ are matched
by their own hashes, matches are verified by the words of both documents, and runs are
compacted when there are many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tidewater.llm.common import columns_of, forget, materialize, scratch, shared_path, sieve

WINDOW, PHRASE = 50, 8
_SPAN = WINDOW - PHRASE + 1  # phrases of a window
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 16
#: Batches that a table goes through an index in; each meets the runs of those before it.
BATCHES = 3
ROW = "h long, seg long, doc_id long, tag long, pos long"
#: The same for a batch, a row for all places of a segment in its text.
PLACES = "h long, seg long, doc_id long, tag long, pos array<long>"


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(12, int(n).bit_length()))[: n + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Hashes of a text's words, phrases, windows and segments."""

    def __init__(self, words: list[bytes]):
        self.n = n = len(words)
        by = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(by * _power(_BASE, n)[:n], out=self.sums[1:])
        self.back = _power(_INVERSE, n)

    def run(self, start: np.ndarray, length) -> np.ndarray:
        """A hash of the words from start on, the same wherever these words stand."""
        return _mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.uint64(1) * np.asarray(length).astype(np.uint64))

    def windows(self) -> int:
        return max(0, self.n - WINDOW + 1)

    def segments(self) -> tuple[np.ndarray, ...]:
        """Starts, numbers of windows, anchor hashes and segment hashes."""
        count = self.windows()
        phrases = self.run(np.arange(self.n - PHRASE + 1), PHRASE)
        view = np.lib.stride_tricks.sliding_window_view(phrases, _SPAN)
        anchor = np.concatenate([np.arange(i, min(i + _STEP, count)) + view[i : i + _STEP].argmin(axis=1) for i in range(0, count, _STEP)])
        start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        n = np.diff(np.concatenate([start, [count]]))
        at = anchor[start]
        whole = self.run(start, n + (WINDOW - 1))
        return start, n, phrases[at], _mix(whole + (at - start).astype(np.uint64) * np.uint64(_BASE))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of PLACES for each segment of a text; pos holds the first window and how many there are of each place.

    A text of repeated lines has few segments at many places; these stay in one row, whatever it is joined with.
    `tag` tells texts of a repeated doc_id apart. Rows with null doc_id have no segments: they neither remove words nor lose any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            places: list[np.ndarray] = []
            for doc_id, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = (text.as_py() or b"").split()
                if len(words) >= WINDOW:
                    start, n, h, seg = Words(words).segments()
                    order = np.lexsort((start, seg, h))
                    h, seg, pos = h[order].view(np.int64), seg[order].view(np.int64), (start.astype(np.int64) << 6 | n)[order]
                    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])])
                    out.append((h[first], seg[first], np.full(len(first), doc_id), np.full(len(first), tag), np.diff(np.r_[first, len(h)])))
                    places.append(pos)
            if out:
                *columns, sizes = (np.concatenate(c) for c in zip(*out, strict=True))
                ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places)))], ["h", "seg", "doc_id", "tag", "pos"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("binary").alias("text"))
    return rows.where("doc_id is not null").mapInArrow(run, PLACES)


def _least(doc_id: str = "doc_id", tag: str = "tag", pos: str | Column = "pos") -> list[Column]:
    """The smallest doc_id of a group and tag and pos of one row that has it.

    All three follow the same comparisons of the same rows in the same order, so they are of
    one row. Unlike a smallest struct they fit into a hash aggregate, which sorts nothing.
    """
    return [F.min(doc_id).alias("f_doc"), F.min_by(tag, doc_id).alias("f_tag"), F.min_by(pos, doc_id).alias("f_pos")]


def _first(pos: str = "pos") -> Column:
    return F.struct(F.col("f_doc").alias("doc_id"), F.col("f_tag").alias("tag"), F.col("f_pos").alias(pos)).alias("first")


@F.pandas_udf(T.BinaryType())
def _packed(text: pd.Series) -> pd.Series:
    z = zstandard.ZstdCompressor(level=3)
    return text.map(lambda t: None if t is None else z.compress(bytes(t)))


def _text(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of segments: (h, w: the window's own hash, doc_id, tag, at).

    A text is unpacked and its windows are sent on before the next one is looked at.
    """
    for b in batches:
        lists = b.column("segments")
        ends, fields = lists.offsets.to_numpy(), lists.values
        places = fields.field("pos")
        cuts, every_pos = places.offsets.to_numpy(), places.values.to_numpy()
        every_h = fields.field("h").to_numpy()
        doc_ids, tags = b.column("doc_id").to_numpy(), b.column("tag").to_numpy()
        for i, packed in enumerate(b.column("packed")):
            words = Words(_text(packed.as_py()).split())
            of = cuts[ends[i] : ends[i + 1] + 1]
            h, pos = np.repeat(every_h[ends[i] : ends[i + 1]], np.diff(of)), every_pos[of[0] : of[-1]]
            n = pos & 63
            at = np.repeat((pos >> 6) - np.cumsum(n) + n, n) + np.arange(n.sum())
            cols = [np.repeat(h, n), words.run(at, WINDOW).view(np.int64), np.full(len(at), doc_ids[i]), np.full(len(at), tags[i]), at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "w", "doc_id", "tag", "at"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and source: its passages (windows at .. at + n - 1 equal the source's from `start` on) and the source's regions that these make up."""
    for b in batches:
        lists = b.column("matches")
        ends, fields = lists.offsets.to_numpy(), lists.values
        at, n, doc, tag, start = (fields.field(k).to_numpy() for k in ("at", "n", "f_doc", "f_tag", "start"))
        for i in range(b.num_rows):
            s = slice(ends[i], ends[i + 1])
            order = np.lexsort((at[s], start[s] - at[s], tag[s], doc[s]))
            a, m, d, t, q = (x[s][order] for x in (at, n, doc, tag, start))
            new = np.ones(len(a), bool)
            reach = np.zeros(len(a), np.int64)
            end = -1
            for j in range(len(a)):  # windows that touch or overlap on one diagonal are one passage
                new[j] = j == 0 or d[j] != d[j - 1] or t[j] != t[j - 1] or q[j] - a[j] != q[j - 1] - a[j - 1] or a[j] > end
                end = a[j] + m[j] if new[j] else max(end, a[j] + m[j])
                reach[j] = end
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(a)) - 1
            a, m, d, t, q = a[first], reach[last] - a[first], d[first], t[first], q[first]
            cuts = [0, *(np.flatnonzero((np.diff(d) != 0) | (np.diff(t) != 0)) + 1), len(a)]
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                asked = [{"at": x, "n": y, "start": z} for x, y, z in zip(a[lo:hi].tolist(), m[lo:hi].tolist(), q[lo:hi].tolist(), strict=True)]
                lows, ups = _regions(q[lo:hi], m[lo:hi])
                rows.append((int(d[lo]), int(t[lo]), asked, [{"start": x, "n": y - x - WINDOW + 1} for x, y in zip(lows.tolist(), ups.tolist(), strict=True)]))
            ids = [pa.array([b.column(c)[i].as_py()] * len(rows), pa.int64()) for c in ("doc_id", "tag")]
            kinds = [pa.int64(), pa.int64(), *(pa.list_(pa.struct([(f, pa.int64()) for f in fs])) for fs in (("at", "n", "start"), ("start", "n")))]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "tag", "f_doc", "f_tag", "asked", "regions"])


PAIR = "doc_id long, tag long, f_doc long, f_tag long, asked array<struct<at: long, n: long, start: long>>, regions array<struct<start: long, n: long>>"


def _regions(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last words, the latter left out, of what n windows from each start make up; what overlaps is one region."""
    order = np.argsort(start, kind="stable")
    low, reach = start[order], np.maximum.accumulate((start + n)[order] + WINDOW - 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    return low[first], reach[np.append(first[1:], len(low)) - 1]


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text in the regions that its asked passages make up, joined by one space; passages that overlap are one region."""
    for b in batches:
        lists = b.column("asked")
        ends, fields = lists.offsets.to_numpy(), lists.values
        start, n = fields.field("start").to_numpy(), fields.field("n").to_numpy()
        for i, packed in enumerate(b.column("packed")):
            words, s = _text(packed.as_py()).split(), slice(ends[i], ends[i + 1])
            lows, ups = _regions(start[s], n[s])
            text = [b" ".join(words[q:e]) for q, e in zip(lows.tolist(), ups.tolist(), strict=True)]
            cols = [pa.array(np.full(len(text), b.column(c)[i].as_py()), pa.int64()) for c in ("doc_id", "tag")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lows), pa.array(text, pa.binary())], ["f_doc", "f_tag", "low", "words"])


def _result(text: str) -> T.StructType:
    return T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add(text, T.StringType())


def cut(text: bytes, passages) -> tuple[int, int, bytes]:
    """Numbers of words and of those removed, and what is kept.

    Passages come by regions of their sources: from which word on a region stands there, its
    words, and what of it is asked. A window goes only where its words are the source's, word by word.
    """
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int64)
    every = ((p["at"], p["n"], p["start"] - r["low"], source) for r in (passages if passages is not None else ()) for source in (r["words"].split(),) for p in r["asked"])
    for at, n, start, source in every:
        at, n, start = int(at), int(n), int(start)
        same = [a == b for a, b in zip(words[at : at + n + WINDOW - 1], source[start : start + n + WINDOW - 1], strict=False)]
        if len(same) == n + WINDOW - 1 and all(same):
            edge[at] += 1
            edge[at + n + WINDOW - 1] -= 1
            continue
        for i in range(len(same) - WINDOW + 1):  # different words of one hash
            if all(same[i : i + WINDOW]):
                edge[at + i] += 1
                edge[at + i + WINDOW] -= 1
    covered = np.cumsum(edge)[:-1] > 0
    return len(words), int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


@F.pandas_udf(_result("kept_sha256"))
def _digests(packed: pd.Series, passages: pd.Series) -> pd.DataFrame:
    rows = [(n, m, sha256(t).hexdigest()) for n, m, t in map(lambda p, s: cut(_text(p), s), packed, passages)]
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])


@F.pandas_udf(_result("kept"))
def _texts(packed: pd.Series, passages: pd.Series) -> pd.DataFrame:
    rows = []
    for p, s in zip(packed, passages, strict=True):
        text = _text(p)
        n, m, kept = cut(text, s)
        rows.append((n, m, None if p is None else (kept if m else text).decode()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


class FingerprintIndex:
    """A log of sorted immutable runs of fingerprints, with the texts that they came from.

    Below a path in the shared folder: one bucketed table per run, one per batch of texts, and
    numbered manifests, of which the last says what counts. A manifest appears by a rename,
    so a reader sees the index before or after an addition, never between. One writer at a
    time. Buckets of a run are by anchor, so a batch is merge-joined with a run without
    moving the run; an anchor of more than HOT_ROWS rows is spread over several buckets.
    """

    #: Runs that add() leaves; with more, it first compacts them into one.
    MOST_RUNS = 8
    HOT_ROWS = 4096
    #: Rows of the first batch to a bucket; there are at most as many buckets as shuffle partitions.
    LEAST_BUCKETS, BUCKET_ROWS = 8, 400_000

    def __init__(self, spark: SparkSession, path: str, most_runs: int | None = None):
        self.spark, self.path, self.most_runs = spark, path, most_runs or self.MOST_RUNS
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = {"version": 0, "next": 0, "buckets": None, "runs": [], "texts": []}
        found = sorted(p.getPath().getName() for p in self._fs.globStatus(self._at("MANIFEST-*")) or [])
        if found:
            self.state = json.loads("".join(r.value for r in spark.read.text(f"{path}/{found[-1]}").collect()))

    @property
    def names(self) -> list[str]:
        return self.state["runs"]

    def _at(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _publish(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        name = f"MANIFEST-{state['version']:08d}"
        out = self._fs.create(self._at(f".{name}"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(self._at(f".{name}"), self._at(name)):
            raise RuntimeError(f"another writer published {name} of {self.path}")
        self.state = state

    def _write(self, rows: DataFrame, kind: str, by: list[str], order: list[str]) -> str:
        name = f"{kind}-{self.state['next']:08d}"
        self.state["next"] += 1
        n = self.state["buckets"]
        bucket = F.pmod(F.hash(*by), F.lit(n))  # Spark's own, so that each bucket is one file of one task
        table = self._table(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # left by an earlier index of this path, or by a job that failed
        rows.repartition(n, bucket).write.mode("overwrite").bucketBy(n, *by).sortBy(*order).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(table)
        return name

    def _table(self, name: str) -> str:
        return f"tidewater_{abs(hash_of(self.path)):x}_{name.replace('-', '_')}"

    def _read(self, name: str, schema: str, by: str, order: str) -> DataFrame:
        """A bucketed table, made known to this session's catalog where a session before has written it."""
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    def _run(self, name: str) -> DataFrame:
        return self._read(name, f"{ROW}, salt int", "h, salt", "h, seg")

    def _text_table(self, name: str) -> DataFrame:
        return self._read(name, "doc_id long, tag long, packed binary", "doc_id, tag", "doc_id, tag").select("doc_id", "tag", "packed")

    def _hot(self, name: str) -> DataFrame:
        return self.spark.read.schema("h long, parts int").parquet(f"{self.path}/hot-{name}")

    def _write_run(self, least: DataFrame) -> str:
        """Write rows, one per segment, sorted by anchor within each bucket."""
        hot = least.groupBy("h").agg(F.ceil(F.count("*") / self.HOT_ROWS).cast("int").alias("parts")).where("parts > 1")
        hot_path = f"{self.path}/hot-run-{self.state['next']:08d}"
        hot.write.mode("overwrite").parquet(hot_path)
        salt = F.coalesce(F.pmod("seg", F.col("parts")), F.lit(0)).cast("int").alias("salt")
        salted = least.join(self.spark.read.schema("h long, parts int").parquet(hot_path), "h", "left").select(*(c.split()[0] for c in ROW.split(", ")), salt)
        return self._write(salted, "run", ["h", "salt"], ["h", "seg"])

    def _hits(self, new: DataFrame) -> DataFrame:
        """Rows of the runs whose anchors the batch has. A run stays where it is; only the batch's anchors move."""
        asked = materialize(new.select("h").distinct(), "anchors")
        out = []
        for name in self.names:
            at = asked.join(self._hot(name), "h", "left").select("h", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
            out.append(self._run(name).join(at.hint("merge"), ["h", "salt"]).select(*(c.split()[0] for c in ROW.split(", "))))
        return materialize(reduce(DataFrame.union, out), "hits")

    def compact(self) -> None:
        """All runs become one; those that it takes the place of are deleted once it counts."""
        old = self.names
        if len(old) > 1:
            rows = reduce(DataFrame.union, (self._run(n) for n in old))
            least = materialize(rows.groupBy("h", "seg").agg(*_least()).select("h", "seg", _first()).select("h", "seg", "first.*"), "least")
            self._publish(runs=[self._write_run(least)])
            forget(self.spark, least)
            for n in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(n)}")
                self._fs.delete(self._at(n), True)
                self._fs.delete(self._at(f"hot-{n}"), True)

    def drop(self) -> None:
        """Delete the index."""
        for n in [*self.names, *self.state["texts"]]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(n)}")
        self._fs.delete(self._at(), True)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
        """Judge a batch against the index and itself, then append it: see deduplicate() for what comes back."""
        if len(self.names) > self.most_runs:
            self.compact()
        doc_id, tag = F.col(id_col).cast("long"), F.xxhash64(text_col)
        packed = _packed(F.col(text_col).cast("binary"))
        rest = F.struct(*columns_of(docs.drop(text_col)))
        new = materialize(anchors(docs, id_col, text_col), "anchors-of-batch")
        if self.state["buckets"] is None:
            most = max(self.LEAST_BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            self.state["buckets"] = min(most, max(self.LEAST_BUCKETS, new.count() // self.BUCKET_ROWS))
        texts = self._write(docs.select(doc_id.alias("doc_id"), tag.alias("tag"), packed.alias("packed"), rest.alias("row")), "texts", ["doc_id", "tag"], ["doc_id", "tag"])
        batch = self.spark.table(self._table(texts))
        with scratch(self.spark) as keep:
            hits = keep(self._hits(new)) if self.names else None
        own = new.groupBy("h", "seg").agg(*_least(pos=F.element_at("pos", 1)), F.max("doc_id").alias("last"))
        own = materialize(own.select("h", "seg", _first(), "last"), "own-segments")
        with scratch(self.spark) as keep:
            passages = keep(self._passages(new, own, hits, [*self.state["texts"], texts]))
        found = passages.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "words", "asked")).alias("passages"))
        joined = batch.join(found, ["doc_id", "tag"], "left").select("row", "packed", "passages")
        out = materialize(joined.select("row", (_digests if digest else _texts)("packed", "passages").alias("cut")), "cut")
        run = self._write_run(own.select("h", "seg", "first.*"))  # of equal segments the one of the smallest doc_id
        self._publish(runs=[*self.names, run], texts=[*self.state["texts"], texts])
        for t in (new, own, hits, passages):
            if t is not None:
                forget(self.spark, t)
        return out

    def _passages(self, new: DataFrame, own: DataFrame, hits: DataFrame | None, texts: list[str]) -> DataFrame:
        """(doc_id, tag, low, words, asked): windows of the batch that also start in a smaller doc_id, by regions of that document.

        Counts of segments and anchors are by partial sums and are tables of their own, so
        that the joins back to the rows are plain ones whose large keys Spark can split.
        """
        every, segments = new.withColumn("fresh", F.lit(True)), own.withColumn("fresh", F.lit(True))
        if hits is not None:
            every = every.union(hits.withColumns({"pos": F.array("pos"), "fresh": F.lit(False)}))
            old = hits.select("h", "seg", F.struct("doc_id", "tag", "pos").alias("first"), F.col("doc_id").alias("last"), F.lit(False).alias("fresh"))
            both = segments.union(old).select("h", "seg", "first.*", "last", "fresh").groupBy("h", "seg").agg(*_least(), F.max("last").alias("last"), F.max("fresh").alias("fresh"))
            both = both.select("h", "seg", _first(), "last", "fresh")
            segments = materialize(both, "segments")
        anchored = segments.groupBy("h").agg(F.min("first.doc_id").alias("lo"), F.max("last").alias("hi"), (F.min("seg") < F.max("seg")).alias("several"), F.max("fresh").alias("fresh"))
        anchored = materialize(anchored.where("fresh and lo < hi").select("h", "several"), "anchored")
        shared = materialize(sieve(segments, anchored, ["h"]).join(anchored, "h").where("first.doc_id < last or several").select("h", "seg", "first", "several"), "shared")
        judged = sieve(every, shared, ["h", "seg"]).join(shared, ["h", "seg"]).where("doc_id > first.doc_id or several")
        judged = materialize(judged.select("h", "doc_id", "tag", "pos", "fresh", "first", (F.col("doc_id") > F.col("first.doc_id")).alias("done")), "judged")
        open_ = materialize(judged.where("not done").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("h", "pos")).alias("segments")), "open")
        windows = self._of_texts(texts, open_).select("doc_id", "tag", "packed", "segments").mapInArrow(_open_windows, "h long, w long, doc_id long, tag long, at long")
        windows = materialize(windows, "windows")
        earliest = windows.groupBy("h", "w").agg(*_least(pos="at"), F.max("doc_id").alias("last")).where("f_doc < last").select("h", "w", _first("at"))
        one = windows.join(materialize(earliest, "earliest"), ["h", "w"]).where("doc_id > first.doc_id")
        one = one.select("doc_id", "tag", F.struct("at", F.lit(1).cast("long").alias("n"), F.col("first.doc_id").alias("f_doc"), F.col("first.tag").alias("f_tag"), F.col("first.at").alias("start")).alias("m"))
        at = lambda c: F.shiftright(c, 6)
        same = lambda p: F.struct(at(p).alias("at"), p.bitwiseAND(F.lit(63)).alias("n"), F.col("first.doc_id").alias("f_doc"), F.col("first.tag").alias("f_tag"), at("first.pos").alias("start"))
        whole = judged.where("done and fresh").select("doc_id", "tag", F.transform("pos", same).alias("ms"))
        matches = whole.union(one.select("doc_id", "tag", F.array("m").alias("ms"))).groupBy("doc_id", "tag").agg(F.flatten(F.collect_set("ms")).alias("matches"))
        pairs = materialize(matches.mapInArrow(_passages, PAIR), "pairs")
        by_source = pairs.select("f_doc", "f_tag", F.explode("regions").alias("r")).groupBy("f_doc", "f_tag").agg(F.collect_set("r").alias("asked")).withColumnsRenamed({"f_doc": "doc_id", "f_tag": "tag"})
        sources = self._of_texts(texts, materialize(by_source, "by-source")).select("doc_id", "tag", "packed", "asked").mapInArrow(_sources, "f_doc long, f_tag long, low long, words binary")
        sources = materialize(sources, "sources")
        lows = materialize(sources.groupBy("f_doc", "f_tag").agg(F.sort_array(F.collect_list("low"), asc=False).alias("lows")), "lows")
        region = lambda lows, start: F.filter(lows, lambda x: x <= start)[0]
        pairs = pairs.drop("regions").join(lows, ["f_doc", "f_tag"]).withColumn("low", F.explode(F.array_distinct(F.transform("asked", lambda p: region(F.col("lows"), p["start"])))))
        pairs = pairs.withColumn("asked", F.filter("asked", lambda p: region(F.col("lows"), p["start"]) == F.col("low"))).drop("lows")
        found = materialize(pairs.join(sources, ["f_doc", "f_tag", "low"]).select("doc_id", "tag", "low", "words", "asked"), "passages")
        return found

    def _of_texts(self, texts: list[str], rows: DataFrame) -> DataFrame:
        """rows with the packed text of their document, once each; texts stay in their buckets."""
        return reduce(DataFrame.union, (self._text_table(t).join(rows, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]) for t in texts))


def hash_of(path: str) -> int:
    return xxh64_intdigest(path.encode())


def deduplicate(docs: DataFrame, index: FingerprintIndex | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, batches: int = BATCHES) -> DataFrame:
    """(row, cut) for every row of docs: a struct of all its columns but the text, and a struct of n_words, n_removed and the kept text.

    With `digest` the second has instead the SHA-256 of the kept words joined by one space,
    which is also the kept text of a document that loses words; other texts stay as they
    are. Words are runs without ASCII white space. A word goes if a window of WINDOW words
    over it also starts in a document with a smaller doc_id, judged on the input as it came.
    With an index, docs are one batch more: they are judged against what it holds too, and
    added to it. Without one, docs go through an index of their own, in `batches` batches by
    ascending doc_id, which is deleted in the end. A null text has no words and
    stays null. Rows of the same doc_id never remove each other's words; rows with null
    doc_id keep all words and remove none. Repeated rows stay repeated, other columns may
    have any names, and an empty table gives an empty result.
    """
    if index is not None:
        return index.add(docs, id_col, text_col, digest)
    spark = docs.sparkSession
    index = FingerprintIndex(spark, shared_path(spark, "fingerprints"), most_runs=1)
    at = F.col(id_col).cast("long")
    edges = docs.select(at.alias("at")).approxQuantile("at", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(e) for e in edges})
    number = reduce(lambda n, e: n + F.when(at > e, 1).otherwise(0), edges, F.lit(0))
    out = [index.add(docs.where(number == i), id_col, text_col, digest) for i in range(len(edges) + 1)]
    index.drop()  # the results are tables of their own
    return reduce(DataFrame.union, out)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; see deduplicate()."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return deduplicate(rows, digest=True).select("row.doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")
