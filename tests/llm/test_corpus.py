"""Language ID, exact dedup, WARC, mixing, URL filter and decontamination on small fixtures."""

import gc
import hashlib
import random
import zlib

import numpy as np

from gridspan.llm import decontaminate, exactdup, langid, licenses, mixing, neardup, pii, queries, secrets, urls, warc
from gridspan.llm.common import table
from gridspan.llm.fmindex import FMIndex

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_id_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    out = queries.op7_language_id(spark, sf).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95


def test_language_id_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "123 $$$", "en"), (3, "the of and", None), (4, "the and of the", "en"), (4, "the and of the", "en"), (5, "der und die", "de")], "doc_id long, text string, lang string")
    out = langid.identify(rows.withColumnRenamed("lang", "score"), langid.fit(rows)).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3
    assert out[4] == out[5]
    assert langid.identify(rows, langid.fit(rows.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(rows.limit(0), langid.fit(rows)).count() == 0


def test_language_id_of_many_labels(spark):
    """The rows that are learned from are bounded over all labels, and every label is still one."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice(chr(97 + k % 20) + chr(98 + k % 17) + "q") for _ in range(5)) for _ in range(12)), f"l{k}") for i, k in enumerate(list(range(40)) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, most_rows=400)
    assert len(model.languages) == 40 and model.codes.shape[1] == model.trust.size > 40
    out = langid.identify(docs, model).where("lang_pred = lang").count()
    assert out > 0.5 * len(rows)


def test_stored_tables_are_dropped(spark):
    import os

    from pyspark.sql import functions as F

    from gridspan.llm import common

    common.drop_stored(spark)
    kept = common.stored(spark.range(5).toDF("x"), "kept")
    with common.scratch(spark) as tables:
        inner, passed = common.stored(spark.range(3).toDF("x"), "inner"), common.stored(spark.range(4).toDF("x"), "passed")
        tables.keep(passed)
    assert passed.count() == 4 and not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
    assert common.drop_stored(spark, keep=kept.select(F.sum("x"))) == 1 and kept.count() == 5
    assert common.drop_stored(spark) == 1 and common.drop_stored(spark) == 0


def test_codewords_keep_apart():
    for n in (2, 3, 5, 9, 40):
        code = langid.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert apart.min() >= 1 and (n < 9 or apart.min() >= 5)


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abAB é\n") for _ in range(rng.choice([0, 1, 31, 32, 33, 511, 513, 9000]))) for _ in range(30)]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(i, base[7][:-1] + "z") for i in range(300, 303)] + [(400, None), (401, ""), (None, "x"), (None, "x"), (5, "y"), (5, "y")]
    out = exactdup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    lower = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    expected = sorted((str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == expected
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_of_very_long_texts(spark):
    """Texts of a million bytes that differ at their ends are kept apart."""
    rows = [(1, "x" * 1_000_000 + "A"), (2, "x" * 1_000_000 + "b"), (3, "x" * 1_000_000 + "a"), (4, "Y"), (5, "y"), (6, None)]
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}


def test_exact_dedup_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "A b", "en", 1, 2), (2, "a B", None, 1, 2), (3, "c", "de", 1, 2)], "doc_id long, text string, kept string, `_n` long, `group_size` long")
    out = exactdup.exact_dedup(rows)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect())) == [(2, "a B", None, 1, 2), (3, "c", "de", 1, 2)]
    assert exactdup.exact_dedup(rows.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "é<p>" * 40
    rows = [(3, "http://a/\r\nX: y", big), (1, "http://b/", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (None, "n", big), (1, "http://b/", big)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert archive.payloads.count() == 3
    out = warc.record_bytes(warc.records(archive)).collect()
    assert len(out) == len(rows) and all(r.verified for r in out)
    by = {r.page_id: r for r in out if r.page_id is not None}
    assert by[1].record_type == "response" and by[3].record_type == "revisit" and by[3].refers_to == 1
    assert by[2].record_type == by[4].record_type == by[5].record_type == "response"
    assert bytes(by[3].payload).decode() == big and by[3].payload_bytes == len(big.encode())
    assert bytes(by[1].record).endswith(big.encode() + b"\r\n\r\n")
    assert by[3].target_uri == "http://a/\r\nX: y"
    assert warc.records(warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_records_parsed_back(spark):
    """Ids of any type, exact URIs and bodies come back from the written bytes."""
    long = "ü" * 500_000
    rows = [("a>b%\r\n", "http://a/%0A\r\nWARC-Type: x", long), ("é 1", "http://b/%0A", long), ("", "\n", "x\r\n\r\ny"), ("none:", "u\r", ""), ("z", None, None), (None, "n", long)]
    pages = spark.createDataFrame([(*r, 7, "h") for r in rows], "page_id string, url string, html string, digest int, header string")
    read = warc.record_bytes(warc.records(warc.write_archive(pages)))
    by = {r.page_id: r for r in read.collect()}
    assert set(by) == {r[0] for r in rows} and all(r.verified for r in by.values())
    again = {r.page_id: r for r in warc.parsed(read.select("record"), id_type="string").collect()}
    for page, url, html in rows:
        assert by[page].target_uri == again[page].target_uri == (url or "")
        assert bytes(by[page].payload).decode() == (html or "") and again[page].whole
        assert bytes(again[page].body) == (b"" if by[page].record_type == "revisit" else (html or "").encode())
        assert again[page].refers_to == by[page].refers_to and bytes(again[page].header) == bytes(by[page].header)
    assert by["a>b%\r\n"].record_type == "response" and by["é 1"].refers_to == "a>b%\r\n" and by[None].refers_to == "a>b%\r\n"


def test_mixing_reaches_targets(spark):
    rows = [(i, "t", "en", "big" if i % 3 else "small", 1) for i in range(6000)] + [(None, None, None, None, None)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS), {"big": 1, "small": 3}, total=12000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 250 and abs(n["small"] - 9000) < 400 and None not in n
    rates = spark.createDataFrame([(i, 50.0) for i in range(2000)], "k long, r double")
    from pyspark.sql import functions as F

    drawn = [x[0] for x in rates.select(mixing.poisson_count(F.col("r"), F.col("k").cast("string"), 1)).collect()]
    assert abs(np.mean(drawn) - 50) < 1 and abs(np.var(drawn) - 50) < 6
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a", 5, 6, 7, "x"), (1, "a", 5, 6, 7, "x"), (2, None, 5, 6, 7, "x" * 100000)], "doc_id long, source string, _rate long, _copies long, copy long, _source string")
    mixed = mixing.mix_sources(odd, total=300)
    assert mixed.columns == ["doc_id", "source", "_rate", "_copies", "_source", "copy", "shuffle_key"]
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts[1] % 2 == 0 and abs(counts[1] - 150) < 60 and abs(counts[2] - 150) < 60
    assert mixed.where("_rate <> 5 OR _copies <> 6").count() == 0


def test_extra_columns_with_clashing_names(spark):
    """Operators over documents leave columns that have their inner names alone."""
    names = ("n", "group", "class", "key", "text_", "sign", "words", "spans", "items", "n_words", "secrets", "pii", "kept", "_body", "_sha", "label", "t", "l", "size")
    rows = spark.createDataFrame([(1, "a b c", "en", *range(len(names))), (2, None, None, *range(len(names)))], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` long" for n in names))
    bench = spark.createDataFrame([(1, "zz yy")], "item_id long, text string")
    keep = lambda df, gone=(): [c for c in rows.columns if c not in gone] == [c for c in df.columns if c in rows.columns and c not in gone]
    assert keep(exactdup.exact_dedup(rows)) and exactdup.exact_dedup(rows).count() == 2
    assert decontaminate.decontaminated(rows, bench).collect() == rows.collect()
    assert keep(decontaminate.find_contamination(rows, bench), ("n_words", "spans", "items"))
    assert keep(langid.identify(rows, langid.fit(rows))) and keep(secrets.find_secrets(rows), ("secrets",)) and keep(pii.find_pii(rows), ("pii",))
    assert neardup.without_near_duplicates(rows).count() == 2 and licenses.scan_licenses(rows).count() == 0


def test_url_rules(spark):
    rows = [(1, "https://a.EXAMPLE.com/en/7x?q"), (2, "http://example.com/en/8"), (3, "x://b.net/de/1"), (4, "x://a.example.net/de/88#f"), (5, "x://q.org/es/"), (6, None), (7, "no url"), (8, "x://notcom/en/1"), (9, "http://www.spam-farm.example.org/en/1"), (10, "y://h?u://com/en/"), (11, "a\nb://com/en/x")]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert out[2] == ("example.com", "/en/8", "com/en/", "block")
    assert out[3][2:] == ("net/de/", "allow") and out[4][2:] == ("example.net/de/8", "block") and out[5][2:] == ("org/es/", "block")
    assert out[6] == out[7] == ("", "", None, "allow")
    assert out[8][2] is None and out[9][2:] == (None, "block") and out[10][:2] == ("h", "") and out[11][:3] == ("com", "/en/x", "com/en/")


def test_fm_index_against_scan():
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (50, 2), (3000, 9), (2000, 1)):
        seq = rng.integers(1, top + 1, n)
        index = FMIndex(seq, top)
        patterns = rng.integers(1, top + 1, (40, 4))
        lengths = rng.integers(1, 5, 40)
        lo, hi = index.search(patterns, lengths)
        for p, k, a, b in zip(patterns, lengths, lo, hi):
            expected = [i for i in range(n - k + 1) if (seq[i : i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, b))) == expected


def test_contamination_in_blocks_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["Alpha", "beta", "gamma", "é", "delta", "X1", "eps", "zeta"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 12, 20]))) for i in range(12)] + [(50, None), (51, "  ..."), (52, "alpha"), (None, "beta x1")]
    docs = [(i, text(60)) for i in range(20)] + [(30, None), (31, ""), (32, "pre " + items[3][1].upper().replace("É", "é") + " post"), (33, "x" * 50000)]
    split = lambda t: decontaminate.words_of(t) if t else []
    windows = {(tuple(w[s : s + 10]), i) for i, t in items if (w := split(t)) for s in range(max(len(w) - 9, 1))}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = {r.doc_id: r for r in decontaminate.find_contamination(d, b).collect()}
    many = {r.doc_id: r for r in decontaminate.find_contamination(d, b, most=20).collect()}
    assert one == many
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for p, item in windows:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    found |= {str(item)} if item is not None else set()
        assert {x for s in one[i].spans for x in range(s.start, s.end)} == hit and one[i]["items"] == sorted(found) and one[i].n_words == len(w)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminated(d, b.where("item_id = 3"), "cut").collect()}
    assert cut[32].split() == ["pre", "post"] and cut[33] == docs[-1][1]
    kept = {r.doc_id for r in decontaminate.decontaminated(d, b).collect()}
    assert kept == {i for i, _ in docs if not one[i].spans}
    assert decontaminate.decontaminated(d, b.limit(0)).count() == len(docs) and decontaminate.decontaminated(d.limit(0), b).count() == 0


def test_contamination_holds_one_block_at_a_time(spark, monkeypatch):
    alive, plain = [], decontaminate.blocks

    def watched(*args):
        for block in plain(*args):
            gc.collect()
            alive.append(sum(isinstance(x, decontaminate.Block) for x in gc.get_objects()))
            yield block
            del block

    monkeypatch.setattr(decontaminate, "blocks", watched)
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x a{i} b{i} c{i} a{i + 1} b{i + 1} c{i + 1}", i) for i in range(30)] + [(99, None, 0), (5, "x", 0), (5, "x", 0)], "doc_id long, text string, row long")
    found = decontaminate.find_contamination(docs, items, most=5)
    assert len(alive) >= 10 and max(alive) == 1
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
    out = found.collect()
    assert len(out) == 33 and all(r.row == r.doc_id for r in out if r.doc_id < 30 and r.text != "x")
    assert all([tuple(s) for s in r.spans] == [(1, 7)] and set(r["items"]) == {str(r.doc_id), str(r.doc_id + 1)} and r.n_words == 7 for r in out if r.text and len(r.text) > 1)
    assert all(not r.spans and not r["items"] for r in out if not r.text or r.text == "x")


def test_url_scores_equal_the_trained_model(spark):
    import zlib as z

    weights, bias = urls.train()
    rows = [(i, f"https://{h}{p}?x=1") for i, (h, p, _) in enumerate(urls.LABELLED)] + [(900, "http://a/"), (901, "http://é.example.com/ü")]
    for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect():
        grams = urls._grams(f"^{r.host}{r.path}$")
        logit = sum(weights[z.crc32(g.encode()) % urls.BUCKETS] for g in grams) / max(len(grams), 1) ** 0.5 + bias
        assert abs(r.url_score - 1 / (1 + np.exp(-logit))) < 1e-4
        if r.page_id < len(urls.LABELLED) and r.rule is None:
            assert (r.verdict == "block") == bool(urls.LABELLED[r.page_id][2])
