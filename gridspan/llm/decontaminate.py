"""Benchmark decontamination: an FM-index of each shard of training text, searched backward for benchmark phrases.

Each task cuts its documents into shards of bounded size, indexes a shard's
words, searches all phrases at once, locates the occurrences through sampled
suffix positions and merges them into removal spans. Words that no phrase has
are one symbol, runs of it a single one: no occurrence can hold them.

Phrases are dealt into blocks of bounded size by a hash; a block is what the
driver reads and broadcasts. One block is searched for in one step over the
documents. Of several, each is read, broadcast, searched for and dropped before
the next is read: what it hits is written to the shared folder by row, and the
hits of all blocks are merged at the end.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_batches, lower_ascii, scratch, stored
from .fmindex import FMIndex

#: A word: anything but ASCII other than letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 10
#: Pairs of a phrase and an item in a broadcast block (a pair takes about 0.3 KB).
BLOCK = 100_000
#: Words in a shard (the last document may exceed it).
SHARD = 1 << 18

NAMES = ("n_words", "spans", "items")
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Block(NamedTuple):
    words: dict  #: word to symbol, from 2; 1 is any other word
    patterns: np.ndarray  #: phrases x WINDOW symbols
    lengths: np.ndarray
    items: list  #: item ids of each phrase


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def phrases(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """phrase (words joined by a blank) and item: each run of ``window`` words, or all words of a shorter item."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    split = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, window), " "))
    return split.select("item", F.explode(runs).alias("phrase")).distinct()


def blocks(pairs: DataFrame, n: int):
    """The phrases in ``n`` blocks; with more than one, ``pairs`` has the column ``block``."""
    for i in range(n):
        part = pairs if n == 1 else pairs.where(F.col("block") == i)
        items: dict[str, list] = {}
        for r in part.collect():
            items.setdefault(r.phrase, []).append(r.item)
        found = sorted(items)
        split = [p.encode().split() for p in found]
        words = {w: k for k, w in enumerate(sorted({w for p in split for w in p}), 2)}
        lengths = np.array([len(p) for p in split], np.int64)
        patterns = np.zeros((len(found), int(lengths.max(initial=0))), np.int64)
        for row, p in zip(patterns, split):
            row[: len(p)] = [words[w] for w in p]
        yield Block(words, patterns, lengths, [sorted(i for i in items[p] if i is not None) for p in found])


def search_shard(block: Block, tokens: list[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Merged spans of hit words and items, for each document of a shard given as symbols."""
    spans, items = [[] for _ in tokens], [set() for _ in tokens]
    parts = [np.append(t, 1) for t in tokens]
    seq = np.concatenate(parts)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    word = np.concatenate([np.arange(len(p)) for p in parts])
    keep = np.append(True, (seq[1:] != 1) | (seq[:-1] != 1))
    seq, doc, word = seq[keep], doc[keep], word[keep]
    present = np.zeros(len(block.words) + 2, bool)
    present[seq] = True
    inside = np.arange(block.patterns.shape[1]) < block.lengths[:, None]
    ready = np.flatnonzero((present[block.patterns] | ~inside).all(1))
    if not len(ready):
        return spans, [[] for _ in tokens]
    # symbols of the shard alone, so that the index has few levels
    small = np.cumsum(present)
    index = FMIndex(small[seq], int(small[-1]))
    lo, hi = index.search(small[block.patterns[ready]], block.lengths[ready])
    found = hi > lo
    ready, lo, hi = ready[found], lo[found], hi[found]
    if not len(ready):
        return spans, [[] for _ in tokens]
    sizes = hi - lo
    which = np.repeat(ready, sizes)
    rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
    at = index.locate(rows)
    for d, p in np.unique(np.stack([doc[at], which], 1), axis=0):
        items[d].update(block.items[p])
    edge = np.zeros(len(seq) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    # spans end where hits do; a document's closing mark is never hit
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)):
        spans[doc[a]].append((int(word[a]), int(word[b - 1]) + 1))
    return spans, [sorted(s) for s in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(texts: list, words: dict):
    """Lists of symbol arrays of up to SHARD words, documents in order."""
    shard, n = [], 0
    for text in texts:
        own = words_of(text) if text else []
        shard.append(np.fromiter((words.get(w, 1) for w in own), np.int64, len(own)))
        n += len(own)
        if n >= SHARD:
            yield shard
            shard, n = [], 0
    if shard:
        yield shard


def _scan(batches, block: Block, text_col: str, n_col: str, span_col: str, item_col: str):
    for batch in batches:
        counts, spans, items = [], [], []
        for shard in _shards(batch.column(text_col).to_pylist(), block.words):
            found = search_shard(block, shard) if block.lengths.size else ([[] for _ in shard], [[] for _ in shard])
            counts += [len(t) for t in shard]
            spans += found[0]
            items += found[1]
        names, columns = list(batch.schema.names), list(batch.columns)
        spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
            names=[*names, n_col, span_col, item_col],
        )


def _searched(docs: DataFrame, shared, text_col: str) -> DataFrame:
    """``docs`` with what a broadcast block hits."""
    return in_batches(docs, lambda batches: _scan(batches, shared.value, text_col, *NAMES), T.StructType([*docs.schema.fields, *FOUND]))


def _merged_rows(batches):
    """Spans and items of several blocks, as one's."""
    for batch in batches:
        row, counts, spans, items = batch.columns
        spans = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in s])] for s in spans.to_pylist()]
        items = [sorted(set(i)) for i in items.to_pylist()]
        yield pa.RecordBatch.from_arrays([row, counts, pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["row", *NAMES])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """``docs`` with n_words, spans (start and end in words, merged) and items (ids as strings, sorted).

    Null texts have no words; an item without words has no phrase, one with
    fewer than ``window`` is a phrase of its own; a null item id is hit but not
    listed. Repeated rows get the same result; columns with these names are
    replaced; empty tables give no rows or no spans. A benchmark of more than
    ``most`` pairs is searched for at once, through the shared folder.
    """
    docs = docs.drop(*NAMES)
    pairs = phrases(benchmark, item_col, item_text_col, window)
    n = math.ceil(pairs.count() / most)
    if n <= 1:
        block = next(blocks(pairs, n), Block({}, np.zeros((0, 0), np.int64), np.zeros(0, np.int64), []))
        return _searched(docs, docs.sparkSession.sparkContext.broadcast(block), text_col)
    with scratch(docs.sparkSession) as tables:
        row = fresh(docs, "row")
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-docs")
        dealt = F.pmod(F.xxhash64("phrase", "item"), F.lit(n)).alias("block")
        pairs = stored(pairs.select("phrase", "item", dealt).repartition("block").sortWithinPartitions("block"), "decontaminate-phrases")
        texts = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
        hits = []
        for block in blocks(pairs, n):
            shared = docs.sparkSession.sparkContext.broadcast(block)
            del block
            found = _searched(texts, shared, "text").drop("text")
            # the first block's table has all rows, for their numbers of words
            hits.append(stored(found.where(F.size("spans") > 0) if hits else found, "decontaminate-hits"))
            shared.destroy(blocking=True)
        both = functools.reduce(DataFrame.union, hits).groupBy("row").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
        )
        both = stored(in_batches(both, _merged_rows, T.StructType([T.StructField("row", T.LongType()), *FOUND])), "decontaminate-found")
        tables.keep(docs, both)
    own = [c for c in docs.columns if c != row]
    both = both.toDF(f"{row}_", *NAMES)
    return docs.join(both, docs[row] == both[f"{row}_"]).select(*[docs[f"`{c}`"] for c in own], *NAMES)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, policy: str = "drop", text_col: str = "text") -> DataFrame:
    """``docs`` without benchmark passages, in the columns they had.

    ``drop``: documents with a hit go. ``cut``: hit words and what stands
    between them go from the text, whose case and spacing otherwise stay.
    """
    own = docs.columns
    name = {c: f"c{i}" for i, c in enumerate(own)}
    text = name[text_col]
    found = find_contamination(docs.toDF(*name.values()), benchmark, text)
    if policy == "drop":
        found = found.where(F.size("spans") == 0)
    else:
        # each word in either case with what follows it, so that the pieces of a span can be left out
        pieces = F.regexp_extract_all(F.col(text), F.lit(f"{CASED}+{CASED.replace('[^', '[')}*"), F.lit(0))
        lead = F.regexp_extract(F.col(text), f"^{CASED.replace('[^', '[')}*", 0)
        left = F.filter(F.transform(pieces, lambda p, i: F.when(F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit(None)).otherwise(p)), lambda p: p.isNotNull())
        found = found.withColumn(text, F.when(F.size("spans") > 0, F.concat(lead, F.array_join(left, ""))).otherwise(F.col(text)))
    return found.select(*[F.col(n).alias(c) for c, n in name.items()])
