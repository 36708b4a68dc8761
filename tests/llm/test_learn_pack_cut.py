"""Quality, toxicity, packing, substring dedup and the pipeline on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import packing, quality, secrets, simhash, substring, toxicity
from tidewater.llm.common import row_key, shared_path

SF = "/root/testdata/sf0.001"


def shingled(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# Quality


def scored(df, labels, name):
    rows = df.join(labels, "doc_id").where("held_out").select("score", name).toPandas()
    good, bad = rows.score[rows[name] == 1].to_numpy(), rows.score[rows[name] == 0].to_numpy()
    return (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()


def test_rules_score_as_expressions_what_they_say(spark):
    rules = [quality.Rule((("upper", 0.5, np.inf),)), quality.Rule((("digits", -np.inf, 0.1), ("upper", -np.inf, 0.9)))]
    model = quality.RuleEnsemble(-1.0, ((rules[0], 2.0), (rules[1], -0.5)))
    texts = ["AAAA bbb", "aaaa 1234", "", None, "AAAA AAA"]
    df = quality.classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model)
    for i, score in df.select("doc_id", "score").collect():
        s = dict(zip(quality.STATISTICS, quality.statistics(None if texts[i] is None else texts[i].encode()), strict=True))
        z = -1 + 2 * (s["upper"] > 0.5) - 0.5 * (s["digits"] <= 0.1 and s["upper"] <= 0.9)
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_quality_learns_and_handles_edges(spark):
    rng = random.Random(2)
    data = [(i, prose(rng, 60) + "." if i % 3 else prose(rng, 40).upper().replace(" ", "!! "), "x") for i in range(240)] + [(900, None, "x"), (901, "", "x"), (None, "a b", "x"), (1, prose(rng, 60), "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(1, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality", ~quality.held_out(F.col("doc_id"), 5, 0))
    out = quality.classify(docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(data)
    assert scored(out.dropDuplicates(["doc_id"]), labels.dropDuplicates(["doc_id"]).dropna(), "quality") > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.where("doc_id is not null").collect())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 100 < kept.count() < 200
    one = quality.fit(docs, labels.where("quality = 1"), "quality", F.lit(True))
    assert one.weights == () and quality.classify(docs.limit(0), one).count() == 0
    assert quality.fit(docs, labels.limit(0), "quality", F.lit(True)).intercept == 0


# Toxicity


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(4)
    bad = ["zorgblat", "quuxish", "frobnicating", "snarfle"]

    def text(i):
        words = prose(rng, 80, 3000).split()
        for _ in range(3 * (i % 4 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    data = [(i, text(i), 1) for i in range(400)] + [(900, None, 1), (901, "", 1), (None, "a b", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~quality.held_out(F.col("doc_id"), 4, 2))
    out = toxicity.classify(docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(data)
    assert scored(out, labels.dropna(), "toxic") > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out.where("doc_id is not null").collect())
    assert toxicity.classify(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5}


def test_toxicity_scores_as_windows_compress(spark):
    """Every window on its own, with one-shot compressors and sums by definition."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["snarfle", "frobnicating", "Ärger"]) if rng.random() < 0.1 else f"w{rng.randrange(900)}" for _ in range(n))
    model = toxicity.Distance(b" ".join(b"w%d" % i for i in range(900)), b" snarfle and frobnicating things ", (-1.0, 0.3, 0.2, 0.1, -0.5, 0.4, 0.2, 0.1, 0.6))
    texts = [text(n) for n in (1, 4, 5, 6, 300, 9000)] + [None, "", "SNARFLE Snarfle", "x" * 5000]
    got = {r.doc_id: r.score for r in toxicity.classify(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).collect()}

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for i, t in enumerate(texts):
        if i == 5:
            continue  # a long text, for memory and batches only
        words = (t or "").encode().lower().split()
        gains = [length(w := b" " + b" ".join(words[k : k + 5]) + b" ", model.ordinary) - length(w, model.toxic + model.ordinary) for k in range(0, len(words), 5)]
        top = sorted([*gains, 0, 0, 0])[::-1][:3]
        x = [1.0, *(min(12, max(-4, g)) for g in top), np.log1p(len(gains)) / 10, np.log1p(sum(max(g - 1, 0) for g in gains)), np.log1p(sum(g >= 3 for g in gains)), np.log1p(sum(g >= 2 for g in gains)), min(2, max(-2, sum(gains) / max(1, len(gains))))]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))), abs=1e-9)


# Packing


def brute_pack(sizes, masks, capacity):
    bins = []
    for size, mask in zip(sizes, masks):
        fits = [(room, b) for b, (room, held) in enumerate(bins) if room >= size and not held & mask and room > 0]
        if not fits:
            bins.append((capacity, 0))
            fits = [(capacity, len(bins) - 1)]
        room, b = min(fits)
        bins[b] = (room - size, bins[b][1] | mask)
        yield b, capacity - room


def test_best_fit_equals_a_full_search():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randrange(0, 101) for _ in range(80)), reverse=True)
        masks = [1 << rng.randrange(6) if rng.random() < 0.7 else 0 for _ in sizes]
        assert packing.best_fit(sizes, masks, 100) == list(brute_pack(sizes, masks, 100))


def test_repeated_rows_are_packed_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    docs = spark.createDataFrame([(7, "a b c", "s", 1)] * 900 + [(i, "x y", f"s{i}", i) for i in range(100, 150)], "doc_id long, text string, source string, cluster long")
    out = packing.pack(packing.sized(docs, F.col("cluster")), 10).toPandas()
    assert len(out) == 950 and (out.doc_id == 7).sum() == 900
    same = out[out.doc_id == 7]
    assert same.groupby(same.bin_id.to_numpy() >> 32).size().max() < 150 and same.bin_id.is_unique


def test_pack_keeps_all_and_respects_conflicts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    rng = random.Random(3)
    data = [(i, "w " * rng.randrange(0, 90), "hot" if i % 3 == 0 else f"s{i % 7}", i % 40) for i in range(200)] + [(7, "a " * 250, None, None), (7, "a " * 250, None, None), (None, None, "s1", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, cluster long")
    out = packing.pack(packing.sized(docs, F.col("cluster")), 100).toPandas()
    assert out.piece_tokens.sum() == sum(len((t or "").split()) for _, t, _, _ in data)
    assert (out.groupby("bin_id").piece_tokens.sum() <= 100).all()
    for by in ("source", "cluster"):
        rows = out[out[by].notna()]
        assert not rows.duplicated(["bin_id", by]).any()
    ordered = out[out.piece_tokens > 0].sort_values(["bin_id", "bin_offset"])
    assert (ordered.groupby("bin_id").bin_offset.shift(-1) >= ordered.bin_offset + ordered.piece_tokens).sum() + ordered.bin_id.nunique() == len(ordered)
    assert packing.pack(packing.sized(docs.limit(0), F.col("cluster"))).count() == 0


def test_count_words(spark):
    texts = ["", " ", "a", " a\tb \n", None, "a\x0b\x0cb c", "x\x1cy"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.orderBy("i").select(packing.count_words(F.col("t")).alias("n")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# Substring dedup


def brute_cut(data, texts=None):
    """data: rows to judge; texts: all rows that count."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i, t in texts or data:
        w = split(t)
        for a in range(len(w) - 49):
            if i is not None:
                first[tuple(w[a : a + 50])] = min(i, first.get(tuple(w[a : a + 50]), i))
    out = []
    for i, t in data:
        w, gone = split(t), set()
        for a in range(len(w) - 49):
            if i is not None and first[tuple(w[a : a + 50])] < i:
                gone |= set(range(a, a + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(rng):
    shared = [prose(rng, n) for n in (50, 51, 75, 49, 130)]
    loop = "a b c " * 60
    data = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 80)), rng.choice(shared), prose(rng, rng.randrange(0, 30)), rng.choice([*shared, loop])]
        data.append((i * 3 % 61, "\n".join(parts)))
    edited = data[0][1].split()
    edited[60] = "changed"
    data += [(100, data[0][1]), (101, " ".join(edited)), (5, prose(rng, 70)), (5, data[2][1]), (None, data[0][1]), (102, None), (103, ""), (100, data[0][1]), (104, prose(rng, 20000)), (105, loop), (-1, shared[4])]
    return data


def test_substring_equals_brute_force(spark):
    data = passages(random.Random(8))
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, n_words int")
    got = sorted((tuple(r) for r in substring.digests(df).collect()), key=repr)
    assert got == brute_cut(data)
    assert substring.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 10])
def test_number_of_batches_changes_nothing(spark, monkeypatch, batches):
    monkeypatch.setattr(substring.FingerprintIndex, "HOT_ROWS", 3)
    data = passages(random.Random(12))
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, row int")
    got = substring.deduplicate(df, digest=True, batches=batches).select("row.doc_id", "cut.*")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_cut(data)


def test_words_of_one_hash_are_told_apart():
    words = [f"w{i}".encode() for i in range(60)]
    other = [*words[:55], b"else", *words[56:]]
    region = lambda ws: [{"low": 7, "words": b" ".join([b"before", *ws]), "asked": [{"at": 0, "n": 11, "start": 8}]}]
    assert substring.cut(b" ".join(words), region(words))[1] == 60
    assert substring.cut(b" ".join(words), region(other))[1] == 55
    assert substring.cut(b" ".join(words), region(words[::-1]))[1:] == (0, b" ".join(words))


def test_index_by_batches_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring.FingerprintIndex, "MOST_RUNS", 2)
    monkeypatch.setattr(substring.FingerprintIndex, "HOT_ROWS", 3)
    data = passages(random.Random(9))
    index = substring.FingerprintIndex(spark, shared_path(spark, "index"))
    past = []
    for k in range(5):
        batch = data[k::5]
        out = substring.deduplicate(spark.createDataFrame(batch, "doc_id long, text string"), index, digest=True)
        past += batch
        assert sorted((tuple(r) for r in out.select("row.doc_id", "cut.*").collect()), key=repr) == brute_cut(batch, past)
        assert len(index.names) <= 3
        if k == 2:  # as a later job would open it
            for name in [*index.names, *index.state["texts"]]:
                spark.sql(f"DROP TABLE {index._table(name)}")
        index = substring.FingerprintIndex(spark, index.path)
    hits = index._hits(spark.createDataFrame([(1,)], "h long"))
    run = index._run(index.names[0]).join(spark.createDataFrame([(1, 0)], "h long, salt int").hint("merge"), ["h", "salt"])
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 0 and plan.count("Exchange hashpartitioning") == 1  # the run itself is not moved
    index.drop()


# Pipeline


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "src0", 0), (10**9, "", "en", "src0", 0)], docs.schema)
    docs = docs.union(extra).withColumn("component_id", F.lit("clash"))
    odd = docs.limit(300).withColumns({n: F.lit(n) for n in ("row", "__k1", "__stats", "k1", "fp", "root", "score", "a.b", "__cut", "__null", "__row", "cut", "tag", "packed", "passages")})
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.secret_scan):
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and {r["__k1"] for r in out.select("__k1").collect()} == {"__k1"}
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, odd.limit(0), SF).count() == 0
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    good = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert good.columns == docs.columns and not Counter(rows(good)) - Counter(rows(docs))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * docs.join(labels.where("quality = 1"), "doc_id").count()

    kept = rows(corpus_pipeline.near_dedup(spark, docs, SF))
    every = rows(docs)
    fp = {r: shingled(r[1]) for r in every}
    root = {r: i for i, r in enumerate(fp)}
    for _ in range(12):
        for a in fp:
            for b in fp:
                if fp[a] == fp[b] or 5 * len(fp[a] & fp[b]) >= 4 * len(fp[a] | fp[b]) > 0:
                    root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for r in fp:
        groups.setdefault(root[r], []).append(r)
    assert len(kept) == len(groups)
    assert {r[0] for r in kept} == {min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values()}

    cut = corpus_pipeline.substring_dedup(spark, docs, SF)
    want = {x for x in brute_cut([(r[0], r[1]) for r in every]) if x[2] < x[1] or not x[1]}
    assert cut.columns == docs.columns and {r[0] for r in rows(cut)} == {x[0] for x in want}
    assert all(n == (None if t is None else len(t)) for _, t, _, _, n, _ in rows(cut))
    by_id = {x[0]: x[1] - x[2] for x in want}
    assert all(len((r[1] or "").split()) == by_id[r[0]] for r in rows(cut))

    clean = rows(corpus_pipeline.secret_scan(spark, docs, SF))
    text = lambda t: None if t is None else secrets.redacted(t, secrets.ordered((b := secrets.base_spans(t)) + secrets.linked(b, secrets.weak_parts(t))))
    assert sorted(((r[0], r[1]) for r in clean), key=repr) == sorted(((r[0], text(r[1])) for r in every), key=repr)

    packed = corpus_pipeline.best_fit_packing(spark, docs, SF).toPandas()
    assert packed.piece_tokens.sum() == sum(len((r[1] or "").split()) for r in every)
    assert (packed.groupby("bin_id").piece_tokens.sum() <= packing.CAPACITY).all()


def test_row_key_tells_null_ids_apart(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (5, None), (None, "5"), (None, None), (None, ""), (5, ""), (5, "5")], "i long, t string")
    assert df.select(*row_key(F.col("i"), F.col("t"))).distinct().count() == 9
    odd = spark.createDataFrame([(5, None, 1), (None, "5", 2)], "doc_id long, text string, n int")
    assert {r.n for r in simhash.one_of_each(odd).collect()} == {r.n for r in corpus_pipeline.near_dedup(spark, odd, "").collect()} == {1, 2}
