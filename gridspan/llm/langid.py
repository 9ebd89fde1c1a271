"""Language ID by error-correcting output codes.

Every language has a codeword; one logistic regression on hashed character
n-grams learns each bit. A text's language is the codeword with the smallest
logistic loss, summed over the bits by the weight each classifier earned.

Fitting reads about ``per_language`` labelled rows of each language, and about
``most_rows`` of all languages, chosen by a hash of the id: their features come
back to the driver, so that bound is what limits the driver's memory. A bit's
weight in decoding is earned on rows its classifier was not fitted on.
Prediction runs in the tasks, over whole
texts, in Arrow batches.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

BUCKETS = 4096
#: Labelled rows of each language to fit on (an expected number, as rows are taken by hash).
PER_LANGUAGE = 400
#: Labelled rows of all languages; a row takes 32 kB of the driver's memory at most, 0.5 GB in all.
MOST_ROWS = 16_384
#: Of so many rows one is kept back to weigh the bits.
KEPT_BACK = 4
#: Characters of the short extract of each labelled row that is learned beside its whole text.
EXTRACT = 48
#: The runner-up's probability from which a prediction is flagged as ambiguous.
RIVAL = 0.4
#: Letters from which a text is long enough to be rejected, and characters of the windows that one in several languages is cut into.
WINDOW = 128
#: The share of the labelled rows' losses below the limit, and by how much more a loss may be than theirs.
LIMIT_SHARE, LIMIT_ROOM = 0.99, 0.3
RESULT = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType()))


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  #: languages x bits, -1 or 1
    weights: np.ndarray  #: buckets x bits
    bias: np.ndarray
    trust: np.ndarray  #: weight of each bit in decoding
    limit: float = np.inf  #: loss a bit beyond which a text is in none of the languages


@functools.cache
def _letters() -> np.ndarray:
    """Code points below 65536: themselves for letters, a space for the rest."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letters()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = points[i] if chr(points[i]).isalpha() else 32
    return out


def gram_counts(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of the hashed 1- to 3-grams of letters and word breaks."""
    shift, odd = np.uint32(32 - 12), np.uint32(2654435761)
    one = points * odd
    hashes = [(one ^ (one >> np.uint32(15))) * odd >> shift]
    if len(points) > 1:
        two = one[:-1] * np.uint32(31) + points[1:]
        hashes.append((two ^ (two >> np.uint32(15))) * odd >> shift)
    if len(points) > 2:
        three = two[:-1] * np.uint32(31) + points[2:]
        hashes.append((three ^ (three >> np.uint32(15))) * odd >> shift)
    return sum(np.bincount(h, minlength=BUCKETS) for h in hashes), sum(map(len, hashes))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All splits of up to five languages; beyond, the seeded random code with the largest least distance."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        bits = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range(1, 2 ** (n - 1))]
        return np.array(bits, np.float64).reshape(len(bits), n).T
    rng, best, found = np.random.default_rng(seed), -1, None
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, length))
        apart = (length - code @ code.T) / 2 + np.eye(n) * length
        if apart.min() > best and (np.abs(code.sum(0)) < n).all():
            best, found = apart.min(), code
    return found


def _features(batches, text: str, lang: str):
    for batch in batches:
        langs, rows = [], []
        for label, t in zip(batch.column(lang).to_pylist(), batch.column(text).to_pylist()):
            points = symbols(t)
            for part in (points, points[len(points) // 3 :][:EXTRACT]):
                if (part != 32).any():
                    counts, n = gram_counts(part)
                    langs.append(label)
                    rows.append((counts / n).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "features"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Learn from rows with text and language that aren't held out.

    Each language gets the same share of rows: ``per_language``, or fewer
    where there are so many languages that ``most_rows`` would be exceeded.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    codes = codewords(len(languages))
    if not codes.size:
        return Model(languages, codes, np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    each = min(per_language, most_rows / len(languages))
    share = F.lit(0.0)
    for language in languages:
        share = F.when(F.col(lang_col) == language, each / sizes[language]).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.where(drawn < share).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = in_batches(sample, lambda b: _features(b, "t", "l"), "lang string, features binary").collect()
    rows = sorted((r.lang, bytes(r.features)) for r in rows)
    x = np.frombuffer(b"".join(f for _, f in rows), np.float32).reshape(len(rows), BUCKETS) * 64
    y = codes[[languages.index(label) for label, _ in rows]].astype(np.float32)
    weights, bias = _logistic(x, y)
    model = Model(languages, codes, weights.astype(np.float64) * 64, bias.astype(np.float64), _trust(x, y))
    # held-out rows have larger losses than those learned from, hence the room
    return model._replace(limit=float(np.quantile(losses(model, x @ weights + bias), LIMIT_SHARE)) + LIMIT_ROOM) if len(rows) else model


def _trust(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weight of each bit: how often a classifier that is fitted without them is right on rows kept back, beyond chance."""
    back = np.arange(len(x)) % KEPT_BACK == 0
    weights, bias = _logistic(x[~back], y[~back])
    right = (np.sign(x[back] @ weights + bias) == y[back]).mean(0) if back.any() and not back.all() else np.ones(y.shape[1])
    return np.maximum(right - 0.5, 0.01) * 2


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-4):
    """One regression a column of y, all at once, by Adam over the whole sample."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32), np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    for t in range(1, rounds + 1):
        slope = -y / (1 + np.exp(y * (x @ w + b))) / len(x)
        g = np.vstack([x.T @ slope + ridge * w, slope.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def decode(model: Model, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best codeword of each row of logits, and the probabilities of all."""
    loss = np.logaddexp(0, -logits[:, None, :] * model.codes[None, :, :]) @ model.trust
    odds = np.exp(loss.min(1, keepdims=True) - loss)
    return loss.argmin(1), odds / odds.sum(1, keepdims=True)


def losses(model: Model, logits: np.ndarray) -> np.ndarray:
    """Loss a bit of the best codeword of each row of logits."""
    loss = np.logaddexp(0, -logits[:, None, :] * model.codes[None, :, :]) @ model.trust
    return loss.min(1) / model.trust.sum()


def belongs(model: Model, text: str | None) -> bool:
    """Whether a text may be in one of the languages, or in several of them by turns.

    It has a letter, and is short, or near enough to a codeword as a whole or
    in half of its windows.
    """
    points = symbols(text) if text else np.zeros(0, np.uint32)
    letters = int((points != 32).sum())
    if letters < WINDOW or not model.trust.size:
        return letters > 0
    near = lambda parts: losses(model, np.array([c / n for c, n in map(gram_counts, parts)]) @ model.weights + model.bias) <= model.limit
    if near([points])[0]:
        return True
    cut = [points[i : i + WINDOW] for i in range(0, len(points), WINDOW)]
    told = [w for w in cut if 2 * (w != 32).sum() >= WINDOW]
    return bool(told) and bool(near(told).mean() >= 0.5)


def in_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text may be in one of the languages.

    Null texts and those without a letter go, and texts of WINDOW letters or
    more whose nearest codeword's loss is beyond the model's limit, as a whole
    and in most of their windows, as texts that change between languages are
    near to none as a whole. With fewer
    than two languages there are no codes to decide by: all texts with a letter
    stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([belongs(shared.value, t) for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return in_batches(docs, run, docs.schema)


def predict(model: Model, texts: list) -> tuple[list, list, list]:
    langs, scores, flags = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not model.languages:
        return langs, scores, flags
    for lo in range(0, len(texts), 256):
        rows, which = [], []
        for i, t in enumerate(texts[lo : lo + 256], lo):
            points = symbols(t) if t else ()
            if len(points) and (points != 32).any():
                counts, n = gram_counts(points)
                rows.append(counts / n)
                which.append(i)
        if rows:
            best, odds = decode(model, np.array(rows) @ model.weights + model.bias)
            for i, k, p in zip(which, best, odds):
                langs[i], scores[i] = model.languages[k], round(float(p[k]), 6)
                flags[i] = bool(len(p) > 1 and np.partition(p, -2)[-2] >= RIVAL)
    return langs, scores, flags


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous.

    A null text and one without any letter are ``und`` with score 0 and
    ambiguous, as is every text where no row was labelled. Repeated rows get
    the same result; columns that have a name of the result are replaced.
    """
    names = [n for n, _ in RESULT]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and 4096 x bits numbers

    def run(batches):
        for batch in batches:
            found = predict(shared.value, batch.column(text_col).to_pylist())
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found, kinds)], names=[*batch.schema.names, *names])

    return in_batches(docs, run, T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in RESULT]]))
