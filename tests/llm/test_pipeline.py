"""The whole pipeline against a brute-force version in Python."""

import hashlib
import math

import corpus_pipeline
from llm_brute import brute_components
from pyspark.sql import functions as F

from gridspan.llm import decontaminate
from gridspan.llm.common import table


def poisson(rate, doc_id, seed=17):
    parts = max(1, math.ceil(rate / 16))
    total = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{part}:{doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        k, p = 0, math.exp(-rate / parts)
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / parts / k
            cdf += p
        total += k
    return total


def test_run_equals_brute_force(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    kept = {i for i, r in docs.items() if r.text and any(c.isalpha() for c in r.text)}
    groups = {}
    for i in kept:
        groups.setdefault(docs[i].text.encode().lower(), []).append(i)
    kept = {max(g) for g in groups.values()}
    components, _ = brute_components([(i, docs[i].text) for i in sorted(kept)], 5)
    kept = {i for i in kept if components[i] == i}
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        words = decontaminate.words_of(r.text) if r.text else []
        windows |= {tuple(words[s : s + 10]) for s in range(max(len(words) - 9, 1)) if words}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = decontaminate.words_of(text)
        return not any(tuple(words[s : s + n]) in windows for n in sizes for s in range(len(words) - n + 1))

    kept = {i for i in kept if clean(docs[i].text)}
    by_source = {}
    for i in kept:
        by_source.setdefault(docs[i].source, []).append(i)
    expected = sorted((i, c) for s, ids in by_source.items() for i in ids for c in range(poisson(len(kept) / len(by_source) / len(ids), i)))
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.copy) for r in out) == expected
    assert all(r.text == docs[r.doc_id].text for r in out)


def test_language_stage_rejects_by_decoding(spark, sf):
    docs = table(spark, sf, "documents")
    alien = ["Это совсем другой язык, и никто здесь его не знает, поэтому текст должен уйти из корпуса целиком. " * 3, "Η γλώσσα αυτή δεν είναι γνωστή σε κανέναν εδώ και το κείμενο πρέπει να φύγει. " * 3]
    most = {}
    for r in docs.where("lang IS NOT NULL AND length(text) > 600").collect():
        most.setdefault(r.lang, r.text)
    by_turns = [" ".join(most[a][i : i + 300] for i in (0, 300) for a in pair) for pair in (sorted(most)[:2], sorted(most)[-2:], sorted(most))]
    kept, gone = ["Ещё", "the and", "of", *by_turns, "Ещё немного слов"], [*alien, None, "", "123 %%%"]
    added = spark.createDataFrame([(-1 - i, t, None, None, None) for i, t in enumerate([*kept, *gone])], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(added.select(docs.columns)), sf).collect()}
    assert {i for i in out if i < 0} == {-1 - i for i in range(len(kept))}
    assert out >= {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_language_stage_keeps_texts_where_none_is_labelled(spark, sf):
    rows = [(1, "plain words", None), (2, None, None), (3, "12 34", None), (4, "Ещё " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()} == {1, 4}
    one = docs.withColumn("lang", F.lit("en"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, one, sf).collect()} == {1, 4}
