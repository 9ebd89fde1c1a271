"""URL filters: host and path rules over a logistic regression on hashed character n-grams.

Everything after training is a Column expression whose time grows with the
length of the url. Training reads the small labelled table below on the
driver; its size is fixed by the code.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, lower_ascii, number_array

#: (host, path, verdict); the longest rule that fits wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: The labelled URL table: host and path, 1 = unwanted. Nothing tells against a url without a host.
LABELLED = tuple(
    (host, path, 1)
    for host in (
        "spam-farm.example.org", "www.cheap-pills.example.com", "casino-win.example.net", "free-bets.example.com",
        "adult-x.example.org", "ads-track.example.net", "m.spam-farm.example.com", "blog.cheap-pills.example.net",
        "online-casino.example.com", "best-casino-bonus.example.org", "sports-bets.example.net", "bets-free.example.org",
        "pills-discount.example.com", "adult-cams.example.net", "xxx-adult.example.com", "track-ads.example.com",
        "click-track.example.org", "spam-links.example.net", "link-farm.example.com", "viagra-pills.example.org",
    )
    for path in ("/", "/en/105", "/win/bonus", "/de/31.html")
) + tuple(
    (host, path, 0)
    for host in (
        "theren.example.com", "blog.ththon.example.net", "www.thering.example.org", "m.tionsh.example.com",
        "news.example.org", "library.example.net", "www.university.example.com", "docs.example.org",
        "museum.example.com", "thand.example.net", "garden-club.example.org", "www.city-council.example.net",
        "science-daily.example.com", "blog.cooking.example.org", "m.weather.example.net", "history.example.com",
        "tionble.example.org", "ththat.example.com", "open-source.example.net", "www.health.example.org",
    )
    for path in ("/", "/en/105", "/fr/825", "/de/31.html", "/es/978/")
) + tuple(("", path, 0) for path in ("", "/", "/en/105", "/fr/825", "/de/31.html", "/es/978/"))

GRAMS = (3, 4, 5)
BUCKETS = 4096


def _grams(text: str) -> list[str]:
    return [text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1)]


@functools.cache
def train(rows=LABELLED, buckets: int = BUCKETS, rounds: int = 400, rate: float = 8.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression, by full-batch gradient descent over the labelled table."""
    x = np.zeros((len(rows), buckets), np.float64)
    y = np.array([label for _, _, label in rows], np.float64)
    for i, (host, path, _) in enumerate(rows):
        grams = _grams(f"^{host}{path}$")
        for g in grams:
            x[i, zlib.crc32(g.encode()) % buckets] += 1
        x[i] /= np.sqrt(len(grams)) or 1
    w, b = np.zeros(buckets), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + ridge * w)
        b -= rate * error.mean()
    return w, b


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*+", 0)), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = verdict = None
    for h, p, v in ordered:
        fits = F.concat(F.lit("."), host).endswith("." + h) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def unwanted_score(host: Column, path: Column, weights: np.ndarray, bias: float) -> Column:
    """Probability that the regression gives to "unwanted"; an empty host and path have no n-gram and get that of the bias.

    The url is cut into characters once; each n-gram joins neighbours.
    """
    table = number_array(weights)

    def logit(chars: Column) -> Column:
        def weight(i: Column, n: int) -> Column:
            gram = F.concat(*[F.get(chars, i + k) for k in range(n)])
            bucket = (F.crc32(F.encode(gram, "UTF-8")) % len(weights)).cast("int")
            return F.when(i + n <= F.size(chars), F.get(table, bucket)).otherwise(0.0)

        starts = F.sequence(F.lit(0), F.size(chars) - 1)
        total = F.aggregate(starts, F.lit(0.0), lambda acc, i: acc + sum((weight(i, n) for n in GRAMS[1:]), weight(i, GRAMS[0])))
        grams = sum(F.greatest(F.size(chars) - (n - 1), F.lit(0)) for n in GRAMS)
        return total / F.sqrt(F.greatest(grams, F.lit(1)).cast("double")) + bias

    return 1 / (1 + F.exp(-bound(F.split(F.concat(F.lit("^"), host, path, F.lit("$")), ""), logit)))


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and url_score.

    Null urls and urls without ``://`` have an empty host and path: no rule
    fits and the model judges the empty text, which it allows. Urls may be of
    any length. Repeated rows are judged alike; columns of ``pages`` with these
    names are replaced; an empty table gives an empty one.
    """
    weights, bias = train()
    host, path = host_and_path(F.col(url))
    judged = pages.withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "url_score": unwanted_score(F.col("host"), F.col("path"), weights, bias)})
    return judged.withColumn("verdict", F.coalesce(verdict, F.when(F.col("url_score") >= threshold, "block").otherwise("allow")))
