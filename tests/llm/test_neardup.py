"""Near-duplicates, components and the pipeline against brute force."""

import random

import corpus_pipeline
from llm_brute import brute_components

from gridspan.llm import graphs, neardup
from gridspan.llm.common import table


def mutated(rng, words, share):
    return [rng.choice("qwertyuiop") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(rng, n=160):
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 12, 60, 200]))]
        rows += [" ".join(mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1, 0.14]))) for _ in range(n // 6)]
    rows += [None, "", " \t\n", "One", "one", "two words", "Two  WORDS", "a b a b", "a b a b a b", "x" * 50000, "ÉÉ é", "éé é"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    for seed, k in ((1, 2), (2, 5)):
        rows = corpus(random.Random(seed))
        expected, sizes = brute_components(rows, k)
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], sizes[r.doc_id], r.doc_id == expected[r.doc_id])


def test_bucket_of_unlinked_neighbours(spark):
    """A star: copies are linked with the base but rarely with each other."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))] + [(i, " ".join(mutated(rng, base, 0.05))) for i in range(1, 80)] + [(100 + i, " ".join(mutated(rng, base, 0.2))) for i in range(40)]
    expected, _ = brute_components(rows, 2)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in out} == expected


def test_boilerplate_corpus(spark):
    """Texts that are mostly one of a few templates: buckets mix components, and many classes begin with the same shingles."""
    rng = random.Random(12)
    templates = [[f"t{k}w{i}" for i in range(rng.choice([40, 60, 120]))] for k in range(4)]
    rows = []
    for i in range(260):
        own = rng.choice(templates)
        tail = [f"v{rng.randrange(60)}" for _ in range(round(len(own) * rng.choice([0.02, 0.08, 0.12, 0.2, 0.3])))]
        rows.append((i, " ".join(own + tail)))
    rows += [(500 + i, " ".join(rng.choice(templates) * 2)) for i in range(8)]
    for k in (2, 5):
        expected, _ = brute_components(rows, k)
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()
        assert {r.doc_id: r.component_id for r in out} == expected


def test_ids_of_other_types(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([("b", words), ("a1", words + " x"), ("c", "other text of its own"), (None, words)], "doc_id string, text string")
    out = neardup.near_duplicates(rows, shingle=2)
    assert out.schema["component_id"].dataType == rows.schema["doc_id"].dataType
    assert {(r.doc_id, r.component_id, r.kept) for r in out.collect()} == {("b", "a1", False), ("a1", "a1", True), ("c", "c", True), (None, None, True)}
    assert {r.doc_id for r in neardup.without_near_duplicates(rows).collect()} == {"a1", "c", None}


def test_odd_rows(spark):
    rows = [(None, "same text here now"), (None, "same text here now"), (3, "same text here now"), (3, "same text here now"), (5, "same text here now"), (6, None)]
    out = neardup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `group` string"), shingle=2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("3", "3", True), ("3", "3", True), ("5", "3", False), ("6", "6", True), ("None", "None", True), ("None", "None", True)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_graph_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == find(n) for n in root)


def test_estimate_follows_similarity():
    a = neardup.shingle_set(" ".join(f"w{i}" for i in range(1000)), 2, neardup._WordHashes())
    b = neardup.shingle_set(" ".join(f"w{i}" for i in range(100, 1100)), 2, neardup._WordHashes())
    one, two = neardup.registers([a, b])
    assert abs(neardup.estimate(one.tobytes(), two.tobytes()) - 900 / 1100) < 0.12
    assert neardup.estimate(one.tobytes(), one.tobytes()) == 1


def test_pipeline_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    words = " ".join(f"palabra{i} de la" for i in range(60))
    item = table(spark, sf, "benchmark").first().text
    extra = [(900001, "123 456 $$$", "en", "src0", 1), (900002, words, "es", "src0", 1), (900003, words.upper(), "es", "src1", 1), (900004, words + " fin", "es", "src2", 1), (900005, f"nuevo {words[:40]} otra cosa. {item} y mas", "es", "src2", 1), (900006, "una cosa muy distinta de las otras con palabras propias " * 3, "es", "src3", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mix_sources":
            assert out.columns == docs.columns
        docs = out.cache()
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    lang, exact, near, clean, _ = seen
    assert 900001 not in lang and 900002 in lang
    assert 900002 not in exact and 900003 in exact
    assert len(near & {900003, 900004}) == 1
    assert 900005 in near and 900005 not in clean
    assert 900006 in clean
    assert docs.columns[-2:] == ["copy", "shuffle_key"]
