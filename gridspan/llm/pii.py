"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is Column expressions. Spark's patterns give no offsets, so those are
summed from the lengths of the matches and of the pieces between them, which
``split`` cuts at the same matches. Sums run in blocks of about the square root
of their number, and context is read from the text cut into slices, so that no
step walks a text from its start for each match. A cheap test that every match
implies spares most texts the patterns.

The patterns are those of the contract in a form that takes linear time: local
parts and digits are possessive, as what follows can't begin with them, and a
match may begin only where a run begins or the last match ended.

An IBAN is as long as its country's are, so that what follows it isn't taken
for a part of it; for other country codes the longest run is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Lengths of the IBANs of each country, by the registry and by those that use the form without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BF BI BJ BY CF CG CM DJ EG FR GA GQ GR IT KM MC MG ML MR NE SM SN TD TG UA", 28: "AL AZ BR CI CY DO GT HN HU LB MA NI PL PS QA SV YE",
    29: "JO KW MU", 30: "SC", 31: "MT", 32: "LC", 33: "RU",
}
IBAN_LENGTHS = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
_IBANS = "|".join(rf"(?:{'|'.join(c for c, m in IBAN_LENGTHS.items() if m == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values())))
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: kind, pattern, what every match has, whether a match holds, score, context words.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # looked ahead at, so that a candidate that doesn't hold takes no more than its first four characters from the next one
    "iban": rf"(?<![A-Za-z0-9])(?=((?:{_IBANS}|(?!{'|'.join(IBAN_LENGTHS)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write|reply",
    "ip": "address|host|server|login",
    "card": "card|visa|pay|credit|debit",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
}
#: Characters before a span in which context words count, and what they add.
NEAR, BONUS = 40, 0.2
#: Characters of the slices that context is read from.
SLICE = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    worth = lambda i, d: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i, back.substr(i, F.lit(1)).cast("int")))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN leaves 1 when divided by 97."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, i: F.when(value(turned.substr(i, F.lit(1))) > 9, (acc * 100 + value(turned.substr(i, F.lit(1)))) % 97).otherwise((acc * 10 + value(turned.substr(i, F.lit(1)))) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(F.length(_only_digits(match)).between(12, 19), luhn(_only_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_only_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def may_match(kind: str, text: Column) -> Column:
    """A test that every text with a match of the kind passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    return text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]")


def running(sizes: Column) -> Column:
    """Sums of an array of numbers up to each of its elements, without it.

    Blocks of about the square root of their number are summed on their own
    and then moved by the sums of the blocks before, as an array can only be
    appended to by copying it.
    """

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("sums"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"])).alias("sums"))
        return F.aggregate(block, start, step)

    def moved(blocks: Column) -> Column:
        return bound(within(F.transform(blocks, lambda x: x["sum"])), lambda before: F.flatten(F.transform(blocks, lambda x, i: F.transform(x["sums"], lambda y: y + F.get(before["sums"], i)))))

    def cut(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
        return bound(width, lambda w: F.transform(F.sequence(F.lit(1), F.size(values), w), lambda at: within(F.slice(values, at, w))))

    return F.when(F.size(sizes) > 0, bound(bound(sizes, cut), moved)).otherwise(F.array().cast("array<bigint>"))


def before(slices: Column, at: Column) -> Column:
    """The NEAR characters before ``at`` of a text cut into slices of SLICE characters."""
    whole = F.floor(at / SLICE).cast("int")
    both = F.concat(F.when(whole > 0, F.get(slices, whole - 1)).otherwise(""), F.left(F.coalesce(F.get(slices, whole), F.lit("")), F.pmod(at, F.lit(SLICE)).cast("int")))
    return F.right(both, F.lit(NEAR))


def spans_of(kind: str, text: Column) -> Column:
    """An array of (start, order, end, kind, score) of the kind's matches that hold."""
    order = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,score:double>>")
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1 if kind == "iban" else 0))
    slices = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))
    # of an IBAN only the first characters count as taken, see its pattern
    taken = lambda m: F.least(F.length(m), F.lit(4)) if kind == "iban" else F.length(m)

    def listed_spans(found: Column) -> Column:
        own, gaps = found["matches"], found["gaps"]
        steps = F.transform(own, lambda m, i: (F.length(F.get(gaps, i)) + taken(m)).cast("bigint"))

        def span(at: Column, i: Column) -> Column:
            start = at + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), F.get(own, i).alias("m"))

        def scored(x: Column) -> Column:
            near = F.lower(before(found["slices"], x["start"]))
            score = F.least(F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), BONUS).otherwise(0.0), F.lit(1.0))
            return F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        return F.transform(F.filter(F.transform(running(steps), span), lambda x: holds(kind, x["m"])), scored)

    # the pieces between matches and the slices are cut only where there is a match
    cut = lambda own: F.when(F.size(own) > 0, bound(F.struct(own.alias("matches"), F.split(text, PATTERNS[kind], -1).alias("gaps"), slices.alias("slices")), listed_spans)).otherwise(empty)
    return F.when(may_match(kind, text), bound(matches, cut)).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: an array of start, order, end, kind and score, by start, then kind.

    Offsets are code points, the end exclusive. Null counts as empty and has
    no spans; texts may be of any length; repeated rows get the same; an empty
    table gives an empty one; a column named pii is replaced. The
    base kinds email, ip, card and phone all stay whatever their score; iban
    is found beside them, confirmed by its remainder.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.array_sort(F.concat(*[spans_of(kind, text) for kind in KINDS])))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """``find_pii(docs)`` with ``masked``: the text with every span of that score replaced by its kind in brackets."""
    found = find_pii(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = lambda acc, s: F.when((s["start"] < acc["at"]) | (s["score"] < least_score), acc).otherwise(
        F.struct(F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    )
    end = lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text)))
    return found.withColumn("masked", F.aggregate("pii", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step, end))
