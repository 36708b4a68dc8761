"""Source divergence audit with count-level bitmaps.

For every source of a language and every count, a bitmap tells which of the language's
terms occur so often there. A probability depends on the count alone, so the divergence of
two sources needs only the number of terms in each pair of counts: AND and popcount of two
bitmaps, times the difference of their probabilities. Terms that a source lacks are the
complement of its bitmaps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, scratch

#: Documents of a language that hold a term, at least, for the term to be kept.
LEAST_DOCUMENTS = 30
#: Terms of a source that are reported, and what is added to every count.
TOP_TERMS, ADDED, SCALE = 50, 5, 1_000_000_000
#: Different (group, term) pairs that a counting task holds before it passes them on.
HELD_TERMS = 400_000
#: Sources of a tile on average, and words of 64 terms of a tile.
TILE_SOURCES, TILE_WORDS = 32, 16

#: Bytes of terms in UTF-8, A to Z as a to z; all others become a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters of ASCII and of characters beyond it, A to Z lower-cased."""
    return text.translate(_BYTES).split()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it.

    Every occurring group also has a row with a null term. Tasks count before the shuffle, so
    neither a common term nor a large source is moved row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                names = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(held[t] for t in n)], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        for b in batches:
            for text, lang, source in zip(*b.columns, strict=True):
                n, held = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                one = Counter(terms(text.as_py()))
                held.update(one.keys())
                n.update(one)
            if sum(len(n) for n, _ in groups.values()) >= HELD_TERMS:
                yield from flush()
        yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(text(text_col).cast("binary"), text(lang_col), text(source_col)).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, word, bit): the kept terms of each language with a place in its bitmaps.

    Places follow the order of counts, so that a word of 64 terms has few different counts
    where most terms are. They need not be dense: every range of the sort numbers its own.
    """
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    order = ["lang", F.desc("total"), "term"]
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    return placed.select("lang", "term", "total", F.shiftright("id", 6).alias("word"), (F.col("id") % 64).cast("int").alias("bit"))


def probability(count: str, of: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (of + ADDED * kept)) in whole numbers, from columns of longs; null without terms."""
    whole = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + ({whole(count)} + {ADDED}) * cast({SCALE} as decimal(10,0)) div nullif({whole(of)} + {ADDED} * {whole(kept)}, 0)")


def count_bitmaps(counted: DataFrame) -> DataFrame:
    """(lang, source, n, word, bits): the terms that occur n times in a source, a long for each 64 of the language's terms.

    `counted` has lang, source, n, word and bit of every term that occurs in a source.
    """
    return counted.groupBy("lang", "source", "n", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def _first_rows(names: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, names[1:] != names[:-1]])


def _divergences(source: np.ndarray, p: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources on both sides and the summed differences over one word of terms.

    Rows are the bitmaps of one word, sorted by source; a source's row of count zero holds
    all kept terms of the word and becomes the complement of its other rows.
    """
    starts = _first_rows(source)
    empty = np.flatnonzero(n == 0)
    held = np.where(n == 0, np.uint64(0), bits)
    bits = bits.copy()
    bits[empty] &= ~np.bitwise_or.reduceat(held, starts)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    cells = np.bitwise_count(bits[a, None] & bits[None, b]).astype(np.int64)  # terms of each pair of counts
    values = cells * np.abs(p[a, None] - p[None, b])
    a_starts, b_starts = _first_rows(source[a]), _first_rows(source[b])
    values = np.add.reduceat(np.add.reduceat(values, a_starts, 0), b_starts, 1)
    return source[a][a_starts], source[b][b_starts], values


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums over the words of one part of a language's terms, for the pairs of two groups of sources."""
    lo, hi = key[2].as_py(), key[3].as_py()
    coded = rows["source"].combine_chunks().dictionary_encode()
    names, source = coded.dictionary, coded.indices.to_numpy()
    word, p, n, side = (rows[c].to_numpy() for c in ("word", "p", "n", "side"))
    bits = rows["bits"].to_numpy().view(np.uint64)
    order = np.lexsort((source, word))
    source, word, p, n, side, bits = (x[order] for x in (source, word, p, n, side, bits))
    ends = np.r_[_first_rows(word), len(word)]
    totals: dict[tuple[int, int], int] = {}
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        at = slice(i, j)
        if (side[at] == lo).any() and (side[at] == hi).any():
            xs, ys, values = _divergences(source[at], p[at], n[at], bits[at], side[at] == lo, side[at] == hi)
            for x, line in zip(xs.tolist(), values.tolist(), strict=True):
                for y, value in zip(ys.tolist(), line, strict=True):
                    if x != y:
                        totals[x, y] = totals.get((x, y), 0) + value
    pairs = list(totals.items()) + ([((y, x), v) for (x, y), v in totals.items()] if lo != hi else [])
    take = lambda k: names.take(pa.array([at[k] for at, _ in pairs], pa.int32())).cast(pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(pairs), pa.string()), "source": take(0), "item": take(1), "value": pa.array([v for _, v in pairs], pa.int64())})


def _pairs(levels: DataFrame, figures: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    tiles = figures.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"))
    side = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    figures = figures.join(tiles, "lang").withColumn("side", side)
    some = levels.join(figures, ["lang", "source"]).select("lang", "source", "word", "n", probability("n", "of", "kept").alias("p"), "bits", "side", "tiles")
    none = figures.join(words, "lang").select("lang", "source", "word", F.lit(0).cast("long").alias("n"), F.coalesce(probability("0", "of", "kept"), F.lit(0).cast("long")).alias("p"), "bits", "side", "tiles")
    rows = some.union(none).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    by = ["lang", "part", "lo", "hi"]
    rows = rows.select("lang", F.expr(f"word div {TILE_WORDS}").alias("part"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "source", "word", "n", "p", "bits", "side")
    return rows.groupBy(*by).applyInArrow(_tile, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of a language differ in their terms.

    Part `pair`: to every other source of the language, the sum over kept terms of the
    differences of their probabilities, all ranks. Part `term`: the `top` terms of the source
    that are more probable there than in the language as a whole. Values descend, ties go to
    the smaller item in UTF-8; all arithmetic is in whole numbers. Null texts, languages and
    sources count as empty ones, which are a language and a source like any other. Repeated
    rows count repeatedly, ids and extra columns are not read. A language without kept terms
    has pairs of value 0; an empty table gives an empty result.

    The number of kept terms and of counts is not limited: terms are dealt over words of 64,
    sources over tiles of about TILE_SOURCES, and a task holds one tile of TILE_WORDS words.
    """
    with scratch(docs.sparkSession) as keep:
        counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
        places = materialize(vocabulary(counts, least), "vocabulary")
        counted = keep(materialize(counts.where("term is not null").join(places, ["lang", "term"]).select("lang", "source", "term", "n", "total", "word", "bit"), "kept-counts"))
        kept = places.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_of"))
        of = counted.groupBy("lang", "source").agg(F.sum("n").alias("of"))
        groups = counts.where("term is null").select("lang", "source")
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        figures = keep(materialize(groups.join(kept, "lang", "left").join(of, ["lang", "source"], "left").select("lang", "source", *map(none, ("kept", "lang_of", "of"))), "figures"))
        words = places.groupBy("lang", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        empty = groups.select("lang").distinct().join(kept, "lang", "left_anti").select("lang", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = keep(materialize(words.union(empty), "words"))
    pairs = _pairs(count_bitmaps(counted), figures, words).withColumn("part", F.lit("pair"))
    p, q = probability("n", "of", "kept"), probability("total", "lang_of", "kept")
    more = counted.join(figures, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0").withColumn("part", F.lit("term"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(w).alias("rank"))
    return ranked(pairs).union(ranked(more).where(F.col("rank") <= top))
