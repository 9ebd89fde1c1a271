"""PII and secrets against plain patterns in Python."""

import base64
import hashlib
import json
import random
import re
import time

from gridspan.llm import pii, queries, secrets
from gridspan.llm.common import table

PII_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text, base=PII_BASE, ok=holds):
    found = sorted((m.start(), k, m.end()) for k, (kind, pattern) in enumerate(base) for m in re.finditer(pattern, text or "") if ok(kind, m[0]))
    return ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in found)


ODD = [
    None, "", "a@b.c_d@e.f@g.h", "x@y", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111 11111111",
    "+1 (017) 555-7713 +44 20 7946 0958. +1 +2 (3", "é@é.com ü a.b@c-d.e.f, 😀x@y.zz 😀 10.0.0.1", "1" * 30000, "a" * 20000 + "@", ("9.9.9.9 " * 300), "0" * 12, "x" * 70000 + " q@w.er",
    "GB82 WEST 1234 5698 7654 32 and iban: GB82WEST12345698765432", "a@b.c a@b.c", "12345678901 2", "+" * 5000,
]


def test_pii_matches_plain_patterns(spark, sf):
    texts = ODD + [r.text for r in table(spark, sf, "documents").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(rows).collect():
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.order < pii.BASE)
        assert base == brute(r.text), (r.doc_id, (r.text or "")[:80])


def test_pii_adds_ibans_and_context(spark):
    rows = spark.createDataFrame([(1, "iban: GB82 WEST 1234 5698 7654 32."), (2, "zz GB83 WEST 1234 5698 7654 32."), (3, "mail: a@b.cc"), (4, "so a@b.cc")], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.pii] for r in pii.find_pii(rows).collect()}
    assert found[1] == [("iban", 6, 33, 1.0)]
    assert found[2] == []
    assert found[3][0][3] > found[4][0][3]
    assert {r.doc_id: r.masked for r in pii.masked(rows).collect()}[3] == "mail: [email]"


def test_pii_ibans_with_text_behind(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "GB82 WEST 1234 5698 7654 32", "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606", "BE68 5390 0754 7034"]
    texts = [(before, iban, after) for iban in ibans for before, after in (("", ""), ("IBAN ", " BIC COBADEFF"), ("ü😀 ", " 500 EUR"), ("IT12 ", " " + ibans[0]), ("ZZ12 ", ", A"))]
    rows = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate(texts)] + [(900, ibans[0] + "X"), (901, "X" + ibans[0]), (902, "DE88 3704 0044 0532 0130 00 500 EUR")], "doc_id long, text string")
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.pii if s.kind == "iban"] for r in pii.find_pii(rows).collect()}
    for i, (_, iban, after) in enumerate(texts):
        assert found[i] == [iban] + ([ibans[0]] if after == " " + ibans[0] else []), texts[i]
    assert found[900] == found[901] == found[902] == []


def test_pii_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    out = queries.op8_pii(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        expected = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert all(r[f"n_{kind}"] == expected.count(f"{kind}:") for kind, _ in PII_BASE)
        added = [x for x in r.spans.split(",") if x.startswith("iban:")]
        assert r.spans.split(",") == sorted((expected.split(",") if expected else []) + added or [""], key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) if x else ())
        assert all(iban_holds(texts[r.doc_id][int(a) : int(b)]) for _, a, b in (x.split(":") for x in added))


def iban_holds(text):
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_pii_of_texts_with_very_many_matches(spark):
    texts = ["é " + "a@b.cc " * 100_000, "1.2.3.4 " * 50_000, "+1 234567890 +" * 20_000, "call 4111 1111 1111 1111, " * 10_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts), "doc_id")
    began = time.time()
    found = {r.doc_id: r.pii for r in pii.find_pii(rows).collect()}
    # far under what a walk through the text for each match would take
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found[i] if s.order < pii.BASE) == brute(t)
    assert pii.find_pii(spark.createDataFrame([("x" * 1_000_000 + "@",)], "text string")).where("size(pii) > 0").count() == 0


def test_pii_context_is_the_text_before(spark):
    rng = random.Random(8)
    words = ["mail", "card", "bank", "phone", "é", "😀", "xx", "a@b.cc", "4111 1111 1111 1111", "+1 234567890", "9.9.9.9", ".", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 5, 40, 200, 900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(rows).collect():
        for s in r.pii:
            near = re.search(pii.CONTEXT[s.kind], r.text[max(s.start - pii.NEAR, 0) : s.start].lower())
            assert abs(s.score - min(pii.SCORES[s.kind] + (pii.BONUS if near else 0), 1.0)) < 1e-9


def test_scans_of_empty_tables_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a@b.cc token=abcdef"), (1, "a@b.cc token=abcdef"), (None, None)], "doc_id long, text string")
    for scan in (pii.find_pii, secrets.find_secrets):
        assert scan(rows.limit(0)).count() == 0
        out = scan(rows).collect()
        assert len(out) == 3 and out.count(next(r for r in out if r.doc_id == 1)) == 2


SECRET_BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)


def secret_brute(text):
    found = []
    for k, (_, pattern) in enumerate(SECRET_BASE):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if (len(m[2]) >= 6, len(m[0]) >= 20, len(m[0]) >= 24)[k] if k == 0 else len(m[0]) >= (20, 24)[k - 1]:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{SECRET_BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def der(*parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return b"\x30" + size + body


def test_secrets_match_plain_patterns(spark, sf):
    odd = [None, "", "Token=abc secret: 'abcdef' API_KEY = \"zzzzzzzz\" tokenſ", "AKIA" + "A" * 16, "AKIAA", "deadbeef" * 3, "deadbeef" * 3 + "0" * 50000, "password=passwd=abcdefg", "é😀 token:abcdef"]
    texts = odd + [r.text for r in table(spark, sf, "documents").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(rows).collect():
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind in secrets.KINDS[: secrets.BASE])
        assert base == secret_brute(r.text), (r.doc_id, (r.text or "")[:80])


def test_secrets_confirmed_by_structure():
    key = der(b"\x02\x01\x00", b"\x02\x82\x01\x00" + bytes(range(256)), b"\x02\x03\x01\x00\x01")
    text = base64.b64encode(key).decode()
    header = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.confirmed_spans(t)]
    assert kinds(f"x {text} y") == ["key"]
    assert kinds(f"x {key.hex()} y") == ["key"]
    assert "pem" in kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{text}\n-----END RSA PRIVATE KEY-----")
    assert kinds(f"{header}.e30x.sig") == ["jwt"]
    assert kinds("eyJhbGci.e30.sig") == []
    assert kinds(base64.b64encode(key[:-1]).decode()) == []
    assert kinds("A" * 200) == []


def test_secrets_in_other_dress():
    key = der(b"\x02\x01\x00", b"\x02\x82\x01\x00" + bytes(range(250, 256)) * 42 + b"abcd", b"\x02\x03\x01\x00\x01")
    text = base64.b64encode(key).decode()
    lines = [text[i : i + 64] for i in range(0, len(text), 64)]
    found = lambda t: [(secrets.KINDS[k], t[a:b]) for a, k, b in secrets.confirmed_spans(t) if secrets.KINDS[k] != "key" or "BEGIN" not in t]
    block = lambda label, body: f"-----BEGIN {label}-----{body}-----END {label}-----"
    escaped = block("PRIVATE KEY", "\\n" + "\\n".join(lines) + "\\n")
    assert found(json.dumps({"private_key": escaped.replace("\\n", "\n")})) == [("pem", escaped)]
    sealed = block("RSA PRIVATE KEY", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n" + base64.b64encode(bytes(range(64))).decode() + "\n")
    assert found(f"x {sealed} y") == [("pem", sealed)]
    assert found(sealed.replace("DEK-Info", "Other")) == [] and found(block("PRIVATE KEY", " see below ")) == []
    body = b"\x95\x03" + bytes(range(90))
    armour = lambda crc: block("PGP PRIVATE KEY BLOCK", "\nVersion: 2\n\n" + base64.b64encode(body).decode() + "\n=" + base64.b64encode(crc.to_bytes(3, "big")).decode() + "\n")
    assert secrets.pgp_checksum(b"123456789") == 0x21CF02  # the published check value
    assert found(armour(secrets.pgp_checksum(body))) == [("pem", armour(secrets.pgp_checksum(body)))] and found(armour(1)) == []
    safe = base64.urlsafe_b64encode(key).decode()
    assert "-" in safe or "_" in safe
    assert found(f"k {safe} z") == [("key", safe)]
    wrapped = "\n  ".join(lines)
    assert found(f"key:\n  {wrapped}\nand more words") == [("key", wrapped)]
    assert found("words " * 30 + "\n" + "A" * 64 + "\n" + "B" * 64) == []


def test_secrets_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    out = queries.op9_secrets(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        expected = secret_brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert all(r[f"n_{kind}"] == expected.count(f"{kind}:") for kind, _ in SECRET_BASE)
        spans = r.spans.split(",") if r.spans else []
        assert set(expected.split(",") if expected else []) <= set(spans)
