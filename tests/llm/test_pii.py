"""Personal data against a plain Python reading of the base rules."""

import hashlib
import random
import re

from textmill.llm.pii import find_pii, mask_pii
from textmill.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items()
            for m in re.finditer(p, text or "", re.ASCII) if valid(k, m.group())]


def spans_of(rows):
    return [(s["kind"], s["start"], s["end"]) for s in rows]


ODD = [None, "", "a@b.c", "a@b.c._d@e.f @x.y", "é🙂 a@b.c 🙂 a-b@c-d.e-f.g.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.0255.3.4",
       "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (826) 555-4081 190.137.223.204", "+12345678",
       "+1 206 555 0100, +44.20.7946.0958)", "0" * 30_000, "1 " * 20_000, "a." * 20_000 + "@", "x" * 60_000 + "@b.c",
       "1.1.1.1 " * 3000, "..@..", "+", "+1", "a@b", "4111111111111111 5500005555555559 and more", "٣٤.1.1.1.1"]


def test_base_equals_python(spark):
    r = random.Random(3)
    parts = ["a@b.co", "x.y@z.", "10.0.0.1", "300.1.1.1", "4111111111111111", "5500 0055 5555 5559", "+1 (555) 010-9999",
             "é", "🙂", " ", " ", ".", "-", "(", "+", "7", "12", "@", "%"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = find_pii(df).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = base(row.text)
        assert spans_of(row.base) == want, row.text[:200]
        assert set(want) <= set(spans_of(row.spans))


def added(spark, text):
    row = find_pii(spark.createDataFrame([(text,)], "text string")).first()
    have = spans_of(row.base)
    return [(k, text[a:b]) for k, a, b in spans_of(row.spans) if (k, a, b) not in have]


def test_checksums_and_context_add_spans(spark):
    assert added(spark, "4111111111111111 5500005555555559 twice") == [
        ("card", "4111111111111111"), ("card", "5500005555555559")]
    assert added(spark, "4111111111111112 5500005555555558 twice") == []
    assert added(spark, "+1 (826) 555-4081 190.137.223.204") == [("phone", "+1 (826) 555-4081")]
    assert added(spark, "IBAN GB82 WEST 1234 5698 7654 32.") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert added(spark, "ref GB83 WEST 1234 5698 7654 32.") == []
    assert added(spark, "call 206-555-0100 now") == [("phone", "206-555-0100")]
    assert added(spark, "item 206-555-0100 now") == []
    assert added(spark, "my SSN is 123-45-6789") == [("ssn", "123-45-6789")]
    assert added(spark, "part 123-45-6789") == []


def test_mask(spark):
    rows = [(1, "mail a@b.co or +1 (826) 555-4081 190.137.223.204 ok", 7), (2, None, 7), (3, "", 7), (4, "🙂 clean", 7),
            (5, "a@b.co", 7), (5, "a@b.co", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = mask_pii(df)
    assert got.columns == df.columns
    assert sorted("-" if r.text is None else r.text for r in got.collect()) == sorted(
        ["mail <EMAIL> or <PHONE> <IP> ok", "-", "", "🙂 clean", "<EMAIL>", "<EMAIL>"])
    assert {r.spans for r in got.collect()} == {7}
    assert mask_pii(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_pii"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % w for w in want).encode()).hexdigest()


def test_columns_named_like_ours(spark):
    names = ["__text", "__p0", "__s0", "__row", "base", "spans"]
    df = spark.range(2).selectExpr("id AS doc_id", "'mail a@b.org' AS text", *[f"id + {i} AS `{c}`" for i, c in enumerate(names)])
    got = find_pii(df)
    assert got.columns == ["doc_id", "text", *names]
    for r in got.collect():
        assert [r[c] for c in names[:4]] == [r.doc_id + i for i in range(4)] and [s.kind for s in r.base] == ["email"]
