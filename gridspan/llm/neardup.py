"""MinHash near-duplicates with HyperMinHash registers.

1. Each text gets its set of hashed word shingles and 160 registers: the
   smallest value of the set under each of 160 hash functions, kept as its
   number of leading zeros and the ten bits after the leading one. (A hash
   function for each bucket, rather than one dealt over buckets, leaves no
   register of a short text empty.)
2. Texts with equal sets become one class.
3. 32 bands of five registers each give a class's bucket keys. Two sets of
   similarity 0.8 miss each other in all bands with probability 3e-6.
4. In each bucket all members are compared with the most central one, that
   with the most neighbours over all its buckets: pairs grow with members, not
   with their square. The registers' estimate, corrected for chance agreement
   of the compressed values, comes first; the full sets then decide.
5. Confirmed links make components. Pairs of a bucket that are in different
   components then are the only ones left. Classes outside their bucket's main
   component meet the others in a join on their rarest shingles: exact for the
   threshold, as two similar sets must share one of those.
6. Components again, over all links.

No bucket, partner or candidate is capped.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, scratch, stored
from .graphs import components

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Agreement by chance of two compressed registers, for sets of like size.
CHANCE = 0.169919487159739 / 2**MANTISSA
#: Estimates this far below the threshold (six standard deviations) aren't compared in full.
SLACK = 6 * (0.8 * 0.2 / REGISTERS) ** 0.5
#: Shingles hashed at once, texts of a batch unpacked at once, and words remembered by a task.
CHUNK, TEXTS, WORDS = 1 << 15, 256, 1 << 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, REGISTERS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int, hashes: dict) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of a text, A-Z lower-cased; of all words where they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = min(k, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    total = np.full(len(each) - n + 1, n, np.uint64)
    for i in range(n):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + each[i : len(each) - n + 1 + i])
    return np.unique(total)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    a, b = _functions()
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= CHUNK):
            n += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0] + [len(s) for s in sets[lo : hi - 1]])
        least = np.empty((REGISTERS, hi - lo), np.uint64)
        for j in range(REGISTERS):
            least[j] = np.minimum.reduceat(x * a[j] + b[j], starts)
        value = (least >> np.uint64(11)).astype(np.int64)
        width = np.frexp(value.astype(np.float64))[1].astype(np.int64)
        after = np.where(width > 0, value - (np.int64(1) << np.maximum(width - 1, 0)), 0)
        after = np.where(width > MANTISSA, after >> np.maximum(width - 1 - MANTISSA, 0), after << np.maximum(MANTISSA + 1 - width, 0))
        out[lo:hi] = (((53 - width) << MANTISSA) | (after & ((1 << MANTISSA) - 1))).T
        lo = hi
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers; the band is part of it."""
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(rows), BANDS))
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.astype(np.int64)


def _sliced(batches):
    """Batches of at most TEXTS rows, so that little is unpacked at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            yield batch.slice(lo, TEXTS)


def _describe(batches, id_col: str, text_col: str, k: int):
    hashes = _WordHashes()
    for batch in _sliced(batches):
        sets = [shingle_set(t, k, hashes) for t in batch.column(text_col).to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        rows = registers([sets[i] for i in full])
        sign, group = [None] * len(sets), [None] * len(sets)
        for i, row in zip(full, rows):
            sign[i], group[i] = row.tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array(group, pa.binary()), pa.array(sign, pa.binary())],
            names=["id", "n", "group", "sign"],
        )


def _buckets(batches):
    for batch in batches:
        sign = b"".join(batch.column("sign").to_pylist())
        keys = band_keys(np.frombuffer(sign, np.uint16).reshape(-1, REGISTERS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("class").to_numpy(), BANDS))], names=["key", "class"])


def _sets(batches, k: int):
    hashes = _WordHashes()
    for batch in _sliced(batches):
        out = {"class": [], "sign": [], "members": []}
        for c, group, sign, text in zip(*(batch.column(n).to_pylist() for n in ("class", "group", "sign", "text"))):
            own = shingle_set(text, k, hashes)
            if xxhash.xxh3_128_digest(own.tobytes()) == group:
                out["class"].append(c)
                out["sign"].append(sign)
                out["members"].append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["class"], pa.int64()), pa.array(out["sign"], pa.binary()), pa.array(out["members"], pa.binary())], names=["class", "sign", "members"])


def estimate(a: bytes, b: bytes) -> float:
    """Jaccard similarity from two rows of registers, less what compressed registers agree by chance."""
    same = float(np.mean(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)))
    return (same - CHANCE) / (1 - CHANCE)


def _confirm(batches, percent: int):
    for batch in _sliced(batches):
        u, v = [], []
        columns = [batch.column(n).to_pylist() for n in ("u", "v", "sign_u", "sign_v", "members_u", "members_v")]
        for a, b, sa, sb, ma, mb in zip(*columns):
            if estimate(sa, sb) < percent / 100 - SLACK:
                continue
            x, y = np.frombuffer(ma, np.uint64), np.frombuffer(mb, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                u.append(a)
                v.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; v may be in many pairs."""
    side = lambda x: sets.select(*[F.col(c).alias(n) for c, n in (("class", x), ("sign", f"sign_{x}"), ("members", f"members_{x}"))])
    wide = pairs.join(side("v"), "v").join(side("u"), "u")
    return stored(in_batches(wide.select("u", "v", "sign_u", "sign_v", "members_u", "members_v"), lambda b: _confirm(b, percent), "u long, v long").distinct(), "links")


def left_over_pairs(entries: DataFrame, sizes: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame | None:
    """Pairs that could still be similar enough, of classes that meet in a bucket of several components; None without such buckets.

    One of a pair is outside its bucket's main component. With all shingles of
    these classes in one order, rarest first, a pair that shares at least
    ``need`` shingles has its first common one among the first n - need + 1 of
    both, so classes are joined on those alone. Shingles whose classes are all
    in one component link nothing new and stay out of the join. Its second key
    is a band of sizes, as only sets of like size can be similar: that splits a
    shingle that many classes begin with.
    """
    roots = components(links)
    labelled = entries.join(roots, entries["class"] == roots["node"], "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    labelled = stored(labelled, "labelled")
    parts = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n_part"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n_parts"), F.max(F.struct("n_part", "root"))["root"].alias("main")).where("n_parts > 1")
    inside = labelled.join(stored(mixed.select("key", "main"), "mixed"), "key")
    inside = stored(inside.groupBy("class", "root").agg(F.max(F.col("root") != F.col("main")).alias("outside")).join(sizes, "class"), "mixed-classes")
    if inside.isEmpty():
        return None
    tokens = stored(sets.join(inside.select("class"), "class").select("class", F.explode(_unpacked("members")).alias("token")), "tokens")
    often = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "token-counts")
    # tokens of one class only come first in the order and can't be common ones
    whole = Window.partitionBy("class")
    rank = F.col("n") - F.count(F.lit(1)).over(whole) + F.row_number().over(whole.orderBy("often", "token")) - 1
    ranked = tokens.join(often, "token").join(inside, "class").withColumn("rank", rank)
    first = stored(ranked.where(100 * (F.col("n") - F.col("rank")) >= percent * F.col("n")).select("token", "class", "root", "n", "rank", "outside"), "first-tokens")
    useful = first.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("outside").alias("any")).where("low <> high AND any").select("token")
    # sizes that differ by less than the ratio are in one band or in neighbours
    first = first.join(useful, "token").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("n"))
    first = stored(first, "useful-tokens")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("class", "root", "n", "rank")]
    x = first.where("outside").select("token", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), *side("u"))
    y = first.select("token", "band", *side("v"))
    need = percent * (F.col("n_u") + F.col("n_v"))
    enough = lambda side: (100 + percent) * (F.col(f"n_{side}") - F.col(f"rank_{side}")) >= need
    able = (F.col("root_u") != F.col("root_v")) & (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & enough("u") & enough("v")
    return stored(x.join(y, ["token", "band"]).where(able).select(F.greatest("class_u", "class_v").alias("u"), F.least("class_u", "class_v").alias("v")).distinct(), "left-over-pairs")


def _unpacked(column: str):
    """The 64-bit members of a packed binary as binaries of 8 bytes."""
    at = F.when(F.octet_length(column) > 0, F.sequence(F.lit(1), F.octet_length(column) - 7, F.lit(8))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(F.col(column), i, F.lit(8)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Texts are linked when 100 x shared >= percent x all of their distinct
    word shingles. component_id is the smallest id reachable; the row with that
    id is kept. Ids may be of any type that orders and doc_id has that type;
    texts may be of any length. Null and word-less texts are linked with
    nothing; rows with a null id have a null component and are kept; repeated
    rows of one id are kept or dropped together. Extra columns are ignored. An
    empty table gives an empty one.
    """
    with scratch(docs.sparkSession) as tables:
        plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        id_type = plain.schema["id"].dataType.simpleString()
        described = stored(in_batches(plain, lambda b: _describe(b, "id", "text", shingle), f"id {id_type}, n long, group binary, sign binary"), "described")
        known = described.where("id IS NOT NULL AND n > 0")
        classes = known.groupBy("group").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("sign").alias("sign"))
        classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

        entries = in_batches(classes.select("class", "sign"), _buckets, "key long, class long")
        shared = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
        entries = stored(entries.join(shared, "key"), "entries")
        near = entries.groupBy("class").agg(F.sum("size").alias("near"))
        ranked = entries.join(near, "class").select("key", "class", "near")
        center = ranked.groupBy("key").agg(F.max(F.struct("near", "class"))["class"].alias("v"))
        pairs = stored(entries.join(center, "key").select(F.col("class").alias("u"), "v").where("u <> v").distinct(), "pairs")

        wanted = classes.join(entries.select("class").distinct(), "class").select("class", "first_id", "group", "sign")
        sets = wanted.join(plain, wanted["first_id"] == plain["id"]).select("class", "group", "sign", "text")
        sets = stored(in_batches(sets, lambda b: _sets(b, shingle), "class long, sign binary, members binary"), "sets")

        links = confirmed(pairs, sets, percent)
        more = left_over_pairs(entries.select("key", "class"), classes.select("class", "n"), sets, links, percent)
        if more is not None:
            links = links.unionByName(confirmed(more, sets, percent))
        roots = components(links)
        rooted = stored(classes.join(roots, classes["class"] == roots["node"], "left").select("group", "first_id", F.coalesce("root", "class").alias("root")), "rooted")
        firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
        named = stored(rooted.join(firsts, "root").select("group", "component"), "named")
        tables.keep(described, named)
    out = described.select("id", "n", "group").join(named, "group", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, columns as they were."""
    with scratch(docs.sparkSession) as tables:
        found = near_duplicates(docs, id_col, text_col, shingle, percent)
        gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "near-duplicates")
        tables.keep(gone)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
