"""Licence scan: templates, variants and clean text."""

import random
import re
import textwrap

import numpy as np

from gridspan.llm import licenses, queries
from gridspan.llm.common import table


def test_every_template_has_telling_words():
    telling = set(licenses.telling_words())
    for templates in licenses.template_pairs().values():
        for pairs in templates:
            bare = sum(not set(p.split()) & telling for p in pairs)
            assert bare / len(pairs) < licenses.LEAST_SHARED


def test_families_and_unknown(spark):
    texts = [text for templates in licenses.TEMPLATES.values() for text in templates]
    families = [f for f, templates in licenses.TEMPLATES.items() for _ in templates]
    rows = [(i, f"Some first line.\r\n{t}\nof the and") for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "x" * 100000)] + [(2000 + i, t) for i, t in enumerate(licenses.OTHERS)]
    rows += [(3000, "this is LICENSED under the apache license, version 2.0 ok"), (3000, "this is LICENSED under the apache license, version 2.0 ok")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert [by.get(i) for i in range(len(texts))] == [[(1, f)] for f in families]
    assert by[3000] == [(0, "Apache")] * 2
    assert set(by) == set(range(len(texts))) | {3000}
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_calibration_keeps_others_unknown():
    families, weights, bias, heat = licenses.train()
    assert 0.3 < heat < 5
    for text in licenses.OTHERS:
        x, _ = licenses._matrix([(0, licenses.tokens(text))])
        assert families[int((x @ weights + bias)[0].argmax())] == licenses.UNKNOWN


def test_wrapped_and_buried_notices(spark):
    """Notices over several lines, and inside long lines, are found as a template on its own line is."""
    long = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts if len(t) > 78]
    rows = [(i, "Head.\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, 70)) + "\n *\n * the end") for i, (_, t) in enumerate(long)]
    pool = sorted({w for t in licenses.OTHERS for w in licenses.tokens(t)} - {"mit"})
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choices(pool, k=n))
    short = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts]
    rows += [(100 + i, f"{filler(n)} {t} {filler(n)}") for n in (20, 3000) for i, (_, t) in enumerate(short, n)]
    rows += [(9000, f"{filler(200)} {short[0][1]} {filler(200)} {licenses.TEMPLATES["Apache"][0]} {filler(9)} {short[0][1]}"), (9001, "Released under\n\nthe MIT License"), (9002, filler(5000))]
    by = {}
    # the filler may have half of a short template's pairs, which is unknown
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where(f"family <> '{licenses.UNKNOWN}'").collect():
        by.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert [by.get(i) for i in range(len(long))] == [[(2, f)] for f, _ in long]
    for n in (20, 3000):
        assert [by.get(100 + i) for i in range(n, n + len(short))] == [[(0, f)] for f, _ in short]
    assert sorted(by[9000]) == [(0, "Apache"), (0, "MIT"), (0, "MIT")] and by[9001] == [(2, "MIT")] and 9002 not in by


def scanned(text):
    """The scan in plain Python: every place where a telling pair lays a template, scored one by one."""
    families, weights, bias, heat = licenses.train()
    telling = set(licenses.telling_words())
    lines = re.split(r"\r\n|\n|\r", text or "")
    words, line_of = [], []
    for i, line in enumerate(lines):
        own = licenses.tokens(line) or [licenses.BREAK]
        words += own
        line_of += [i] * len(own)
    hits = []
    for family, own in licenses.LAID:
        pairs, wide = {f"{a} {b}" for a, b in zip(own, own[1:])}, licenses.slack(own)
        windows = set()
        for k, (a, b) in enumerate(zip(own, own[1:])):
            for i in range(len(words) - 1):
                if words[i] == a and words[i + 1] == b and (a in telling or b in telling):
                    first, last = i, i
                    while first > 0 and words[first - 1] != licenses.BREAK:
                        first -= 1
                    while last < len(words) and words[last] != licenses.BREAK:
                        last += 1
                    windows |= {(max(i - k - more, first), min(i - k + len(own) + more, last)) for more in (0, wide)}
        for lo, hi in windows:
            at = [i for i in range(lo, hi - 1) if f"{words[i]} {words[i + 1]}" in pairs]
            shared = len({f"{words[i]} {words[i + 1]}" for i in at}) / len(pairs)
            if shared >= licenses.LEAST_SHARED:
                x, _ = licenses._matrix([(0, words[lo:hi])])
                z = (x @ weights + bias)[0] / heat
                p = float(1 / np.exp(z - z.max()).sum())
                named = families[int(z.argmax())] == family and p >= licenses.LEAST_P
                hits.append([family if named else licenses.UNKNOWN, min(at), max(at) + 2, p, shared])
    merged = []
    for hit in sorted(hits):
        if merged and merged[-1][0] == hit[0] and hit[1] < merged[-1][2]:
            merged[-1][2:] = [max(a, b) for a, b in zip(merged[-1][2:], hit[2:])]
        else:
            merged.append(list(hit))
    known = [m for m in merged if m[0] != licenses.UNKNOWN]
    keep = known + [m for m in merged if m[0] == licenses.UNKNOWN and not any(k[1] < m[2] and m[1] < k[2] for k in known)]
    return sorted((line_of[a], "\n".join(lines[line_of[a] : line_of[b - 1] + 1]), f, round(p, 3), round(s, 6)) for f, a, b, p, s in keep)


def test_query_equals_plain_python(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    found = {}
    for r in queries.op1_license_scan(spark, sf).collect():
        found.setdefault(r.doc_id, []).append((r.paragraph, r.text, r.family, round(r.probability, 3), round(r.shared, 6)))
    for i, text in texts.items():
        assert sorted(found.get(i, [])) == scanned(text), i


def test_unconfirmed_windows_are_unknown(spark):
    """Half of a template's words in a wrong order share its pairs, but not what the model knows of the family."""
    rng = random.Random(5)
    rows = []
    for i, (_, own) in enumerate(licenses.LAID * 3):
        cut = [w for w in own if rng.random() > 0.25]
        rows.append((i, " ".join(cut[len(cut) // 2 :] + rng.choices(["fish", "river", "story", "road", "bridge"], k=6) + cut[: len(cut) // 2])))
    found = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.paragraph, r.text, r.family, round(r.probability, 3), round(r.shared, 6)))
    assert all(sorted(found.get(i, [])) == scanned(t) for i, t in rows)
    assert any(f[2] == licenses.UNKNOWN for fs in found.values() for f in fs)
