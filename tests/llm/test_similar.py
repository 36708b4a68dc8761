"""Near-duplicates by similarity, for the stage of the pipeline and for packing."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tidewater.llm import similar  # noqa: E402


def shingled(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(data):
    sets = [shingled(t) for _, t in data]
    root = list(range(len(data)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(data):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values()), sorted((d, min(g)) for g in groups.values() for d in g)


def copies(rng):
    """Texts with copies of more, about and less than 0.8 similarity, chains of them, and odd rows."""
    texts = [None, "", "  ", "a b", "A  b", "a b c d e"]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 200, 900)))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.022, 0.025, 0.03, 0.04):
            texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words))
        texts.append(" ".join(words).upper())
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_equal_brute_force(spark):
    data = copies(random.Random(5))
    least, placed = brute_components(data)
    assert len(least) < len(data) - 40
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(tuple(r) for r in similar.near_duplicates(df).select("doc_id", "component_id").collect()) == placed
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == least
    assert similar.near_duplicates(df.limit(0)).count() == 0


def test_links_do_not_depend_on_the_leaders(spark):
    """A chain in one bucket: its ends are similar to their neighbours only."""
    words = [f"w{i}" for i in range(104)]
    data = [(k, " ".join(f"x{i}" if i < 2 * k and i % 2 else w for i, w in enumerate(words))) for k in range(20)]
    sets = [similar.shingles(t.encode()) for _, t in data]
    nodes = spark.createDataFrame([(k, len(s), [7], k, k) for k, s in enumerate(sets)], "node long, size long, bands array<long>, k1 long, k2 long")
    texts = spark.createDataFrame([(k, k, t.encode()) for k, t in data], "k1 long, k2 long, text binary")
    found = similar.connected_components(similar._links(nodes, texts)).collect()
    root = {r.node: r.root for r in found}
    assert sorted((k, root.get(k, k)) for k, _ in data) == brute_components(data)[1]


def test_no_sequence_holds_two_similar_documents(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    data = [(k, " ".join("x" if rng.random() < 0.01 else w for w in words), f"s{k}") for k in range(5)]
    data += [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(300)), f"s{k}") for k in range(5, 10)]
    _, placed = brute_components([r[:2] for r in data])
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for packed in (entry.queries()["op6_packing"](spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, df, "")):
        got = packed.toPandas()
        assert sorted(zip(got.doc_id, got.cluster, strict=True)) == placed
        assert (got.groupby(["bin_id", "cluster"]).size() == 1).all()
