"""Source divergence and language-model scores against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import audit, lm
from tidewater.llm.quality import held_out

# Source divergence


def brute_divergence(rows, least, top):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        by, whole = defaultdict(Counter), Counter()
        for _, source, ts in own:
            by[source].update(t for t in ts if held[t] >= least)
            whole.update(t for t in ts if held[t] >= least)

        def p(counts, t, kept=kept):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts.values()) + 5 * len(kept))

        for s in by:
            pairs = sorted((-sum(abs(p(by[s], t) - p(by[x], t)) for t in kept), x.encode()) for x in by if x != s)
            out |= {(lang, s, "pair", x.decode(), -v, i) for i, (v, x) in enumerate(pairs, 1)}
            more = sorted((p(whole, t) - p(by[s], t), t.encode()) for t in kept if by[s][t] and p(by[s], t) > p(whole, t))[:top]
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(more, 1)}
    return out


def audited(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("value", F.lit(1)).withColumn("word", F.lit("x"))
    found = audit.divergence(docs, **kw).collect()
    assert len(set(found)) == len(found)
    return {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in found}


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["Ünter", "ünter", "Zed", "zed"]
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 60))
        picked = rng.zipf(1.3, n) % len(words) if i % 3 else rng.integers(0, len(words), n)
        rows.append((" 1,".join(words[j] for j in picked), ["en", "de", None][i % 3], [f"s{i % 7}", "", None][i % 5 % 3]))
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("w" * 50_000, "xx", "c")] + [("same text same", "en", "s1")] * 40
    assert audited(spark, rows, least=5, top=4) == brute_divergence(rows, 5, 4)


def test_divergence_over_several_tiles_of_sources(spark, monkeypatch):
    monkeypatch.setattr(audit, "TILE_SOURCES", 3)
    monkeypatch.setattr(audit, "TILE_WORDS", 1)
    rows = [(" ".join(f"t{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}" for k in range(i % 50)), "en", f"s{i % 11}") for i in range(300)]
    assert audited(spark, rows, least=2, top=50) == brute_divergence(rows, 2, 50)


def test_divergence_of_nothing(spark):
    assert audited(spark, []) == set()
    assert audited(spark, [(None, None, None)]) == set()
    assert audited(spark, [("a", "l", "s"), ("b", "l", "t")]) == {("l", "s", "pair", "t", 0, 1), ("l", "t", "pair", "s", 0, 1)}


# Language-model scores


def test_levels_are_exact_for_small_counts():
    counts = np.arange(1, 8)
    assert (lm.ESTIMATES[lm.level_of(counts)] == counts).all()
    for c in (10, 1000, 10**9, 10**17):
        assert abs(lm.ESTIMATES[lm.level_of(np.array([c]))[0]] / c - 1) < 0.13


def test_filter_never_gives_less_and_seldom_more():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    counts = rng.zipf(1.5, len(grams)).clip(1, 1 << 40)
    parts = [(i, lm.shard(grams[at], counts[at])[0]) for i in range(5) for at in [lm._shard_of(grams, 5) == i]]
    held = lm.CountFilter(5, iter(parts), sum(len(p) for _, p in parts))
    got, want = held.levels(grams), lm.level_of(counts)
    assert (got >= want).all()
    assert (got > want).mean() < 0.04
    assert (held.levels(grams + np.uint64(1)) > 0).mean() < 0.04


def brute_scores(rows, order, strength):
    """By dictionaries of exact counts, each rounded to the middle of its level."""
    toks = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [""]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [toks(t) for (_, t), h in zip(rows, held, strict=True) if not h]
    one = Counter(w for ts in train for w in ts)
    grams = [Counter(tuple(["<s>", *ts][i : i + n]) for ts in train for i in range(len(ts) + 2 - n)) for n in range(2, order + 1)]
    total = sum(one.values())
    mid = lambda c: float(lm.ESTIMATES[lm.level_of(np.array([c]))[0]]) if c else 0.0
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        ts, score = toks(t), 0.0
        line = ["<s>", *ts]
        for k, w in enumerate(ts):
            p = (mid(one[w]) + 0.1) / (total + 0.1 * (len(one) + 1))
            for n in range(2, min(order, k + 2) + 1):
                joint = [mid(one[w])]
                for m in range(2, n + 1):
                    before = line[k + 1 - m + 1 : k + 1]
                    joint.append(bounded(before, line[k + 1], one, grams, len(train), mid))
                context = joint_of(line[k + 1 - n + 1 : k + 1], one, grams, len(train), mid)
                if context:
                    p = (joint[-1] + strength * p) / (context + strength)
            score += math.log10(p)
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in ts)
        out.append((i, h, len(ts), sum(one[w] > 0 for w in ts), total, base, score))
    return out


def joint_of(gram, one, grams, texts, mid):
    """The count of an n-gram, no larger than those of its context and of what follows the context's first word."""
    if len(gram) == 1:
        return float(texts) if gram[0] == "<s>" else mid(one[gram[0]])
    return bounded(gram[:-1], gram[-1], one, grams, texts, mid)


def bounded(before, word, one, grams, texts, mid):
    if not before:
        return mid(one[word])
    most = min(joint_of(before, one, grams, texts, mid), bounded(before[1:], word, one, grams, texts, mid))
    return min(mid(grams[len(before) - 1][(*before, word)]), most) if most > 0 else 0.0


def scored(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    got = lm.score(docs, held_out(F.col("doc_id"), 10, 0), **kw).collect()
    return sorted([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got], key=repr)


def same(got, want):
    want = sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-9, abs=1e-9)


ROWS = [(i, " ".join(f"{'Wx'[i % 2]}{(i * j) % 17}" for j in range(i % 40))) for i in range(120)]
ROWS += [(500, None), (501, ""), (502, " \t\n"), (503, "Éa éa EA"), (504, "long " * 30_000), (505, "z" * 100_000), (506, "z" * 100_000), (506, "z" * 100_000), (None, "w1 w2")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    want = brute_scores(ROWS, order, 7.0)
    same(scored(spark, ROWS, order=order, strength=7.0, bits=64), want)
    if order > 1:
        same(scored(spark, ROWS, order=order, strength=7.0, bits=64, broadcast_bytes=-1), want)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT_WORDS", 3)
    same(scored(spark, ROWS, strength=7.0, bits=64), brute_scores(ROWS, 2, 7.0))


def test_both_ways_give_the_same_scores_at_the_usual_size_of_the_filter(spark):
    same(scored(spark, ROWS), scored(spark, ROWS, broadcast_bytes=-1))


def test_scores_without_training_texts(spark):
    assert scored(spark, []) == []
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    for r in scored(spark, [(i, "a b") for i in ids]):
        assert r[1:] == (True, 3, 0, 0, 0.0, 0.0)


def test_scores_foretell_held_out_texts_better_than_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(docs, held_out(F.col("doc_id"), 10, 0)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
