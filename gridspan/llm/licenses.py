"""License scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are runs of lines with a word in them, whatever their length. Every
word pair that tells of a template lays the template over the paragraph: the
words it would cover are a window, and with some more on both sides another.
Each notice that could be confirmed has such a pair, so windows of bounded
length are enough for paragraphs of any length. Windows are scored by multinomial logistic regressions over sparse word 1- to 3-grams, and
hits of a family that overlap are merged. The model is trained on the driver
from the templates and counter-examples below, whose number is fixed by the
code, and applied as Column expressions: n-grams are hashed into tables of
weights that are constants of the plan. Its classes are the licence families
and "unknown"; the temperature that calibrates their probabilities is fitted
on whole templates and counter-examples that were held out. A family is
reported where its calibrated probability is high enough and the window shares
enough word pairs with one of the family's templates; a window that shares them
but whose family the model doesn't confirm is reported as "unknown".
"""

from __future__ import annotations

import functools
import random
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, number_array

#: Licence families and notices by which they are named; fixed texts.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-Clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
#: Paragraphs that name no licence, some of them with its words.
OTHERS = (
    "The driving license was issued in the city.", "He asked for permission to leave the room.", "The software was released in May and is free of charge.",
    "All work and no play is a version of the story.", "The general public was invited under the old bridge.", "Copyright law protects the work of authors.",
    "They were granted a licence to sell fish.", "This program on television is about the source of the river.", "The foundation gave the city a free copy of the book.",
    "A distribution of income without warranty is no basis.", "The conditions of the road were met with care.", "Common forms of art and creative work in the public domain of ideas.",
    "The of and to in is that for it as was with be by on not he this.", "La de los en el que y una para con del las.", "Der die und das von den ist mit dem ein nicht sich auch.", "Le la les et de des un une est en que pour dans.",
    "An apache helicopter flew over the hill in version two of the film.", "Students of the institute use any kind of material.", "The identifier of the file is one.",
)
#: Words of the templates that are too common to tell anything.
COMMON = frozenset("a all an and any are as by can for has have in is it may met not of on or should that the this to under use used was with you 0 1 2 3 4".split())
UNKNOWN = "unknown"
BUCKETS = 4096
#: Least calibrated probability, and least share of a template's word pairs, for a family to be reported.
LEAST_P, LEAST_SHARED = 0.6, 0.5
#: Parts that templates and counter-examples are dealt into; each is held out once for the calibration.
FOLDS = 4
#: Tokens of a paragraph.
TOKEN = r"[a-z0-9\x{80}-\x{10FFFF}]+"


#: What stands for a line without a word; paragraphs end there.
BREAK = "\n"


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def features(words: list[str]) -> list[int]:
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


#: Family and words of every template.
LAID = [(family, tokens(t)) for family, texts in TEMPLATES.items() for t in texts]
#: Above the number of words of any window.
WIDEST = 256


def slack(words: list[str]) -> int:
    """Words by which a wide window extends beyond its template on both sides, for words that were put in or lost."""
    return 3 + len(words) // 4


def _variants(seed: int, each: int, wanted=lambda i: True) -> list[tuple[int, list[str]]]:
    """Labelled paragraphs: the wanted templates of each family with words lost, added and cut, and the others likewise."""
    rng = random.Random(seed)
    pool = sorted({w for t in OTHERS for w in tokens(t)})
    out = []
    families = [*TEMPLATES, UNKNOWN]
    for label, family in enumerate(families):
        for i, text in enumerate(TEMPLATES.get(family, OTHERS)):
            words = tokens(text)
            for k in range(each if wanted(i) else 0):
                own = list(words)
                if k:
                    own = [w for w in own if rng.random() > 0.04] or own
                    front, back = rng.randrange(6), rng.randrange(6)
                    own = rng.choices(pool, k=front) + own + rng.choices(pool, k=back)
                out.append((label, own))
    for _ in range(40 * each):
        out.append((len(families) - 1, rng.choices(pool, k=rng.randrange(1, 30))))
    return out


def _matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, words) in enumerate(rows):
        np.add.at(x[i], features(words), 1)
        x[i] /= np.sqrt(max(1.0, x[i].sum()))
    return x, np.array([label for label, _ in rows])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fitted(rows, rounds: int = 120, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias of the multinomial regression, by Adam over all rows."""
    x, y = _matrix(rows)
    k = len(TEMPLATES) + 1
    goal = np.eye(k, dtype=np.float32)[y]
    w, b = np.zeros((BUCKETS, k), np.float32), np.zeros(k, np.float32)
    m, v = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((BUCKETS + 1, k), np.float32)
    for t in range(1, rounds + 1):
        slope = (_softmax(x @ w + b) - goal) / len(x)
        g = np.vstack([x.T @ slope + ridge * w, slope.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@functools.cache
def train(each: int = 8) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Families, weights (buckets x families), bias and temperature."""
    logits, labels = [], []
    for k in range(FOLDS):
        w, b = _fitted(_variants(1, each, lambda i: i % FOLDS != k))
        x, y = _matrix(_variants(2, 4, lambda i: i % FOLDS == k))
        logits.append(x @ w + b)
        labels.append(y)
    z, y = np.vstack(logits), np.concatenate(labels)
    loss = lambda heat: -np.log(_softmax(z / heat)[np.arange(len(y)), y] + 1e-12).mean()
    return [*TEMPLATES, UNKNOWN], *_fitted(_variants(1, each)), min((0.5 + 0.1 * i for i in range(40)), key=loss)


def template_pairs() -> dict[str, list[list[str]]]:
    """The distinct word pairs of each template."""
    return {f: [sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for t in texts if (w := tokens(t))] for f, texts in TEMPLATES.items()}


def _hashed(words: Column) -> Column:
    """Buckets of a window's 1- to 3-grams."""
    joined = lambda n: F.transform(words, lambda w, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " ")))
    bucket = lambda g: (F.crc32(F.encode(g, "UTF-8")) % BUCKETS).cast("int")
    return F.transform(F.filter(F.concat(words, joined(2), joined(3)), lambda g: g.isNotNull()), bucket)


def telling_words() -> list[str]:
    """Template words that aren't common ones.

    At least half of each template's word pairs have one, and LEAST_SHARED is
    half: a paragraph without any of these words can't be confirmed.
    """
    return sorted({w for templates in TEMPLATES.values() for t in templates for w in tokens(t)} - COMMON)


def _strings(texts) -> Column:
    return F.array(*map(F.lit, texts))


def _windows(words: Column) -> Column:
    """Numbers of the windows (see ``_window``) that a template is laid on by one of its telling pairs."""
    telling = set(telling_words())
    places: dict[str, list[tuple[int, int]]] = {}
    for t, (_, own) in enumerate(LAID):
        for k, (a, b) in enumerate(zip(own, own[1:])):
            if a in telling or b in telling:
                places.setdefault(f"{a} {b}", []).append((t, k))
    reach = max(len(own) + slack(own) for _, own in LAID)
    pair = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    first = sorted({p.split()[0] for p in places})
    anchors = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(first) & F.coalesce(pair(i).isin(sorted(places)), F.lit(False)))
    found = F.create_map(*[x for p, spots in places.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k + more).alias("back"), F.lit(len(LAID[t][1]) - k + more).alias("on")) for t, k in spots for more in (0, slack(LAID[t][1]))]))])

    def laid(i: Column) -> Column:
        """The windows of an anchor, which end where its paragraph does."""
        lowest = F.greatest(i - reach, F.lit(0))
        before = F.array_position(F.reverse(F.slice(words, lowest + 1, i - lowest)), BREAK)
        after = F.array_position(F.slice(words, i + 1, reach), BREAK)
        back = F.when(before > 0, before - 1).otherwise(i.cast("bigint"))
        on = F.when(after > 0, after - 1).otherwise((F.size(words) - i).cast("bigint"))
        code = lambda v: ((i - F.least(v["back"], back)) * WIDEST + F.least(v["back"], back) + F.least(v["on"], on)) * len(LAID) + v["t"]
        return F.transform(F.element_at(found, pair(i)), code)

    return F.array_distinct(F.flatten(F.transform(anchors, laid)))


def _window(code: Column) -> tuple[Column, Column, Column]:
    """Template, first word and number of words of a window."""
    rest = F.floor(code / len(LAID))
    return F.pmod(code, F.lit(len(LAID))).cast("int"), F.floor(rest / WIDEST).cast("int"), F.pmod(rest, F.lit(WIDEST)).cast("int")


def _scored(words: Column) -> Column:
    """Windows that share enough with a template: family or unknown, at and end (of the words from the first to the last shared pair), p and shared."""
    families, weights, bias, heat = train()
    width = len(families)
    table = number_array((weights / heat).ravel())
    pairs = F.array(*[_strings(sorted({f"{a} {b}" for a, b in zip(own, own[1:])})) for _, own in LAID])
    family = _strings([f for f, _ in LAID])

    def compared(code: Column) -> Column:
        t, at, n = _window(code)
        two = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
        own = F.get(pairs, t)
        places = F.filter(F.sequence(at, F.greatest(at + n - 2, at)), lambda i: F.coalesce(F.array_contains(own, two(i)), F.lit(False)))
        return bound(
            places,
            lambda x: F.struct(
                F.get(family, t).alias("family"), F.slice(words, at + 1, n).alias("words"), F.array_min(x).alias("at"), (F.array_max(x) + 2).alias("end"),
                (F.size(F.array_distinct(F.transform(x, two))) / F.size(own).cast("double")).alias("shared"),
            ),
        )

    def logit(grams: Column, k: int) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table, g * width + k))
        return total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")) + float(bias[k] / heat)

    def judged(x: Column) -> Column:
        z = bound(_hashed(x["words"]), lambda grams: F.array(*[logit(grams, k) for k in range(width)]))
        top = lambda z: F.struct(F.get(_strings(families), (F.array_position(z, F.array_max(z)) - 1).cast("int")).alias("label"), (1 / F.aggregate(z, F.lit(0.0), lambda acc, y: acc + F.exp(y - F.array_max(z)))).alias("p"))
        named = lambda y: F.when((y["label"] == x["family"]) & (y["p"] >= LEAST_P), x["family"]).otherwise(UNKNOWN)
        return bound(bound(z, top), lambda y: F.struct(named(y).alias("family"), x["at"].alias("at"), x["end"].alias("end"), y["p"].alias("p"), x["shared"].alias("shared")))

    shared = F.filter(F.transform(_windows(words), compared), lambda x: x["shared"] >= LEAST_SHARED)
    return F.transform(shared, judged)


def _merged(hits: Column) -> Column:
    """Hits of one family that have words in common, as one; unknown ones that have words in common with a family's go."""
    none = F.array().cast("array<struct<family:string,at:int,end:int,p:double,shared:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        both = F.struct(
            last["family"].alias("family"), last["at"].alias("at"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["p"], x["p"]).alias("p"), F.greatest(last["shared"], x["shared"]).alias("shared"),
        )
        joins = (last["family"] == x["family"]) & (x["at"] < last["end"])
        return F.struct(F.when(last.isNull() | joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"), F.when(joins, both).otherwise(x).alias("last"))

    start = F.struct(none.alias("done"), F.get(none, F.lit(0)).alias("last"))
    done = F.aggregate(F.array_sort(hits), start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
    apart = lambda x, all_: ~F.exists(all_, lambda y: (y["family"] != UNKNOWN) & (y["at"] < x["end"]) & (x["at"] < y["end"]))
    return bound(done, lambda all_: F.filter(all_, lambda x: (x["family"] != UNKNOWN) | apart(x, all_)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice: doc_id, paragraph, text, family (or unknown), probability, shared.

    ``paragraph`` is the number (from 0) of the line in which the notice
    begins, ``text`` the lines it stands in. ``probability`` is the calibrated
    one of the most probable class, ``shared`` the share of a template's word
    pairs, both the largest of the windows. Null and empty texts have no
    notices, and neither has an empty table; texts and lines may be of any
    length; repeated rows give repeated findings; extra columns are ignored.
    """
    # arrays that are exploded into one row: filters and later steps can't be pushed below, where they would run again
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\n|\r", -1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(lines)).alias("_lines"))
    split = F.transform("_lines", lambda x: F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0)))
    rows = rows.select("doc_id", "_lines", F.explode(F.array(F.transform(split, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit(BREAK)))))).alias("_split"))
    rows = rows.select("doc_id", "_lines", "_split", F.explode(F.array(F.flatten("_split"))).alias("_words"))
    rows = rows.where(F.arrays_overlap("_words", _strings(telling_words())))
    rows = rows.select("doc_id", "_lines", "_split", F.explode(F.array(_merged(_scored(F.col("_words"))))).alias("_hits")).where(F.size("_hits") > 0)
    line_of = F.flatten(F.transform("_split", lambda w, i: F.array_repeat(i, F.size(w))))
    rows = rows.select("doc_id", "_lines", F.explode(F.array(line_of)).alias("_line"), "_hits")
    rows = rows.select("doc_id", "_lines", "_line", F.explode("_hits").alias("_found"))
    first, last = F.get("_line", F.col("_found.at")), F.get("_line", F.col("_found.end") - 1)
    text = F.array_join(F.slice("_lines", first + 1, last - first + 1), "\n")
    return rows.select("doc_id", first.alias("paragraph"), text.alias("text"), "_found.family", F.col("_found.p").alias("probability"), "_found.shared")
