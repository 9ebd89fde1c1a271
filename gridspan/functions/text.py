"""Text functions. Positions count characters from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import NA, VALUE, Cell, made, num, raw

#: Characters of codes 128 to 159 in Windows-1252; codes without one are left as they are.
WINDOWS_1252 = {
    128: "€", 130: "‚", 131: "ƒ", 132: "„", 133: "…", 134: "†", 135: "‡", 136: "ˆ", 137: "‰", 138: "Š", 139: "‹", 140: "Œ", 142: "Ž",
    145: "‘", 146: "’", 147: "“", 148: "”", 149: "•", 150: "–", 151: "—", 152: "˜", 153: "™", 154: "š", 155: "›", 156: "œ", 158: "ž", 159: "Ÿ",
}


def text(x) -> Column:
    """As text: TRUE and FALSE for booleans, nothing for an empty cell."""
    c = raw(x)
    return F.coalesce(c.cast("string"), F.lit(""))


def bool_text(c: Column) -> Column:
    return F.when(c, "TRUE").when(~c, "FALSE").otherwise("")


def pattern_of(wildcard: str) -> str:
    """A regular expression for ``*``, ``?`` and ``~`` escapes."""
    out, i = "", 0
    while i < len(wildcard):
        ch = wildcard[i]
        if ch == "~" and i + 1 < len(wildcard) and wildcard[i + 1] in "*?~":
            i += 1
            out += re.escape(wildcard[i])
        else:
            out += {"*": ".*", "?": "."}.get(ch) or re.escape(ch)
        i += 1
    return out


def CONCAT(*parts):
    return made(F.concat(*map(text, parts)), parts)


CONCATENATE = CONCAT


def EXACT(a, b):
    return made(text(a) == text(b), [a, b])


def LEN(t):
    return made(F.length(text(t)), [t])


def LOWER(t):
    return made(F.lower(text(t)), [t])


def UPPER(t):
    return made(F.upper(text(t)), [t])


def PROPER(t):
    """Upper case after anything but a letter."""
    low = F.filter(F.split(F.lower(text(t)), ""), lambda c: c != "")
    step = lambda acc, c: F.struct(F.concat(acc.t, F.when(acc.in_word, c).otherwise(F.upper(c))).alias("t"), c.rlike(r"\p{L}").alias("in_word"))
    return made(F.aggregate(low, F.struct(F.lit("").alias("t"), F.lit(False).alias("in_word")), step, lambda acc: acc.t), [t])


def LEFT(t, n=1):
    return made(F.left(text(t), F.floor(num(n)).cast("int")), [t, n], (num(n) < 0, VALUE))


def RIGHT(t, n=1):
    return made(F.right(text(t), F.floor(num(n)).cast("int")), [t, n], (num(n) < 0, VALUE))


def MID(t, start, n):
    return made(text(t).substr(F.floor(num(start)).cast("int"), F.floor(num(n)).cast("int")), [t, start, n], ((num(start) < 1) | (num(n) < 0), VALUE))


def REPT(t, n):
    return made(F.repeat(text(t), F.floor(num(n)).cast("int")), [t, n], (num(n) < 0, VALUE))


def TRIM(t):
    return made(F.trim(F.regexp_replace(text(t), " +", " ")), [t])


def CLEAN(t):
    return made(F.regexp_replace(text(t), r"[\x00-\x1f]", ""), [t])


def T(t, is_text=True):
    return made(F.when(raw(is_text), text(t)).otherwise(""), [t])


def FIND(needle, hay, start=1):
    at = F.position(text(needle), text(hay), F.floor(num(start)).cast("int"))
    return made(at, [needle, hay, start], ((num(start) < 1) | (at == 0), VALUE))


def SEARCH(needle: str, hay, start: int = 1):
    """Position of a case-insensitive wildcard pattern (a constant)."""
    rest = text(hay).substr(F.lit(start), F.length(text(hay)))
    at = F.regexp_instr(F.lower(rest), F.lit("(?s)" + pattern_of(needle.lower())))
    return made(at + (start - 1), [hay], (at == 0, VALUE))


def SUBSTITUTE(t, old: str, new: str, instance: int | None = None):
    """All occurrences, or the instance-th from the left."""
    if not old:
        return made(text(t), [t])
    if instance is None:
        return made(F.replace(text(t), F.lit(old), F.lit(new)), [t])
    parts = F.split(text(t), re.escape(old), -1)
    joined = F.concat(F.array_join(F.slice(parts, 1, instance), old), F.lit(new), F.array_join(F.slice(parts, F.lit(instance + 1), F.size(parts)), old))
    return made(F.when(F.size(parts) > instance, joined).otherwise(text(t)), [t])


def REPLACE(t, start, n, new):
    s, k = F.floor(num(start)).cast("int"), F.floor(num(n)).cast("int")
    return made(F.concat(F.left(text(t), s - 1), text(new), text(t).substr(s + k, F.length(text(t)))), [t, start, n, new], ((num(start) < 1) | (num(n) < 0), VALUE))


# without double-byte languages the byte variants are the plain ones
FINDB, LEFTB, LENB, MIDB, REPLACEB, RIGHTB, SEARCHB = FIND, LEFT, LEN, MID, REPLACE, RIGHT, SEARCH


#: Full-width forms of ASCII and of the blank, and what they stand for.
FULL_WIDTH = "\u3000" + "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
HALF_WIDTH = " " + "".join(map(chr, range(0x21, 0x7F)))


def ASC(t):
    """Full-width letters, digits and signs as half-width ones."""
    return made(F.translate(text(t), FULL_WIDTH, HALF_WIDTH), [t])


def REGEXTEST(t, pattern: str):
    return made(text(t).rlike(pattern), [t])


def REGEXEXTRACT(t, pattern: str):
    """Group 1 where the pattern has a group, else the whole match; no match is #N/A."""
    group = 1 if re.compile(pattern).groups else 0
    return made(F.regexp_extract(text(t), pattern, group), [t], (~text(t).rlike(pattern), NA))


def REGEXEXTRACT_ALL(t, pattern: str):
    found = F.regexp_extract_all(text(t), F.lit(pattern), F.lit(0))
    return made(found, [t], (F.size(found) == 0, NA))


def REGEXREPLACE(t, pattern: str, replacement: str):
    return made(F.regexp_replace(text(t), pattern, replacement), [t])


def _cut(t, delimiter: str, instance: int, before: bool) -> Cell:
    parts = F.split(text(t), re.escape(delimiter), -1)
    n = F.size(parts) - 1
    k = F.lit(instance) if instance > 0 else n + instance + 1
    out = F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(0))) if before else F.slice(parts, F.greatest(k, F.lit(0)) + 1, F.size(parts)), delimiter)
    return made(out, [t], ((n < abs(instance)), NA))


def TEXTBEFORE(t, delimiter: str, instance: int = 1):
    return _cut(t, delimiter, instance, True)


def TEXTAFTER(t, delimiter: str, instance: int = 1):
    return _cut(t, delimiter, instance, False)


def TEXTSPLIT(t, column_delimiter: str, row_delimiter: str | None = None, ignore_empty: bool = False):
    """An array of the parts; an array of rows where there is a row delimiter."""
    drop = (lambda parts: F.filter(parts, lambda p: p != "")) if ignore_empty else (lambda parts: parts)
    split = lambda c, d: drop(F.split(c, re.escape(d), -1))
    if row_delimiter is None:
        return made(split(text(t), column_delimiter), [t])
    return made(F.transform(split(text(t), row_delimiter), lambda r: split(r, column_delimiter)), [t])


def TEXTJOIN(delimiter: str, ignore_empty: bool, *parts):
    items = F.array(*map(text, parts))
    return made(F.array_join(F.filter(items, lambda p: p != "") if ignore_empty else items, delimiter), parts)


def TEXTJOIN_ALL(c, order, delimiter: str = ""):
    """Aggregate: all texts of a group in an order, joined."""
    rows = F.sort_array(F.collect_list(F.struct(raw(order).alias("o"), text(c).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r.t), delimiter)


def ARRAYTOTEXT(a, strict: bool = False):
    items = F.transform(raw(a), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return made(F.concat(F.lit("{"), F.array_join(items, ";"), F.lit("}")) if strict else F.array_join(items, ", "), [a])


def UNICODE(t):
    return made(F.ascii(text(t)), [t], (text(t) == "", VALUE))


def UNICHAR(n):
    """The character of a code point, decoded from its UTF-32 bytes."""
    k = F.floor(num(n)).cast("int")
    return made(F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32"), [n], ((num(n) < 1) | (num(n) > 0x10FFFF) | num(n).between(0xD800, 0xDFFF), VALUE))


def CHAR(n):
    k = F.floor(num(n)).cast("int")
    special = F.create_map(*[F.lit(x) for pair in WINDOWS_1252.items() for x in pair])
    return made(F.coalesce(F.try_element_at(special, k), UNICHAR(n).raw), [n], ((k < 1) | (k > 255), VALUE))


def CODE(t):
    first = F.left(text(t), F.lit(1))
    special = F.create_map(*[F.lit(x) for k, v in WINDOWS_1252.items() for x in (v, k)])
    return made(F.coalesce(F.try_element_at(special, first), F.ascii(first)), [t], (text(t) == "", VALUE))


def FIXED(n, decimals: int = 2, no_commas: bool = False):
    shown = F.format_number(F.round(num(n), decimals), max(decimals, 0))
    return made(F.replace(shown, F.lit(","), F.lit("")) if no_commas else shown, [n])


def DOLLAR(n, decimals: int = 2):
    shown = FIXED(F.abs(num(n)), decimals).raw
    return made(F.when(num(n) < 0, F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit("$"), shown)), [n])


def NUMBERVALUE(t, decimal: str = ".", group: str = ","):
    """A number written with the given separators; percent signs divide by 100."""
    bare = F.regexp_replace(F.replace(text(t), F.lit(group), F.lit("")), r"\s", "")
    signs = F.length(bare) - F.length(F.rtrim(bare, F.lit("%")))
    value = F.replace(F.rtrim(bare, F.lit("%")), F.lit(decimal), F.lit(".")).try_cast("double")
    out = F.when(bare == "", 0.0).otherwise(value / F.pow(F.lit(100.0), signs))
    return made(out, [t], (out.isNull(), VALUE))


def VALUE_(t):
    """A number from text: plain, with thousands, a percent sign, a currency sign, or a date's serial."""
    bare = F.trim(text(t))
    plain = bare.try_cast("double")
    marked = F.regexp_replace(bare, r"^([-+]?)[$€£]", "$1")
    money = F.when(marked.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]*)?%?$|^[-+]?[0-9]+(\.[0-9]*)?%?$"), F.regexp_replace(marked, "[,%]", "").try_cast("double") / F.when(marked.endswith("%"), 100.0).otherwise(1.0))
    from .dates import parse_date, serial

    out = F.coalesce(plain, money, serial(parse_date(bare)))
    return made(out, [t], (out.isNull(), VALUE))


def VALUETOTEXT(x, strict: bool = False):
    shown = text(x)
    return made(F.concat(F.lit('"'), shown, F.lit('"')) if strict else shown, [x])


def TEXT(value, pattern: str):
    """A number through a number format: up to three sections, 0 # , . % E+00, literals, or a date pattern."""
    sections = pattern.split(";")
    v = num(value)
    if re.search(r"(?i)[ymdhs]", re.sub(r'"[^"]*"', "", pattern)) and not re.search(r"[0#]", pattern):
        return made(_date_text(v, pattern), [value])
    shown = [_number_text(F.abs(v) if len(sections) > 1 else v, s) for s in sections]
    if len(sections) == 1:
        out = shown[0]
    else:
        out = F.when(v < 0, shown[1]).otherwise(shown[0])
        out = F.when(v == 0, shown[2]).otherwise(out) if len(sections) > 2 else out
    return made(out, [value])


def _number_text(v: Column, section: str) -> Column:
    m = re.match(r'^((?:"[^"]*"|\\.|[^0#.,%"\\])*)([0#,]*)(\.[0#]*)?(%?)(E\+0+)?((?:"[^"]*"|\\.|[^0#])*)$', section)
    bare = lambda s: re.sub(r'"([^"]*)"|\\(.)', lambda x: x[1] if x[1] is not None else x[2], s or "")
    if not m or not re.search(r"[0#]", re.sub(r'"[^"]*"|\\.', "", section)):
        return F.lit(bare(section))
    front, whole, part, percent, power, back = m.groups()
    digits = part or ""
    decimals, least = max(len(digits) - 1, 0), digits.count("0")
    x = v * 100 if percent else v
    tail = F.lit("")
    if power:
        exponent = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
        x = x / F.pow(F.lit(10.0), exponent)
        tail = F.concat(F.lit("E"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), len(power) - 2, "0"))
    shown = F.format_number(F.round(F.round(F.abs(x), 9), decimals), decimals)  # half away from zero
    if "," not in whole:
        shown = F.replace(shown, F.lit(","), F.lit(""))
    if decimals > least:
        shown = F.regexp_replace(shown, rf"(\.[0-9]{{{least}}}[0-9]*?)0+$", "$1")
        shown = shown if least else F.rtrim(shown, F.lit("."))
    zeros = whole.replace(",", "").count("0")
    if zeros == 0:
        shown = F.regexp_replace(shown, r"^0(?=\.)", "")
    elif zeros > 1:
        need = zeros + (decimals + 1 if decimals else 0)
        shown = F.when(F.length(shown) < need, F.lpad(shown, need, "0")).otherwise(shown)
    sign = F.when((v < 0) & shown.rlike("[1-9]"), "-").otherwise("")
    return F.concat(sign, F.lit(bare(front)), shown, tail, F.lit(percent), F.lit(bare(back)))


#: Parts of a date format and their Java patterns; m after h or before s is a minute.
DATE_PARTS = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "hh": "HH", "h": "H", "ss": "ss", "s": "s"}


def _date_text(v: Column, pattern: str) -> Column:
    from .dates import timestamp_of

    out, last = "", ""
    for part in re.findall(r'(?i)y+|m+|d+|h+|s+|am/pm|"[^"]*"|.', pattern):
        low = part.lower()
        if low == "am/pm":
            out = out.replace("HH", "hh").replace("H", "h") + "a"
        elif low in DATE_PARTS:
            java = DATE_PARTS[low]
            if low in ("m", "mm") and (last.startswith("h") or re.match(r"(?i).*%s[^a-z]*s" % re.escape(part), pattern[pattern.lower().find(low) :])):
                java = low
            out, last = out + java, low
        else:
            out += "'" + part.strip('"').replace("'", "''") + "'"
    return F.date_format(timestamp_of(v), out)
