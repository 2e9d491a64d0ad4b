import hashlib
import re

from ledgerline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    """(kind, start, end) of the base kinds, by the plain patterns."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "nothing here", "a@b", "a@b.c", "x a.b+c@d-e.f.g, y", "a@b.c_d@e.f%g@h.i", "a@b..c @c.d a@@b.c", "é ü a@b.co ñ 1.2.3.4 😀 1.2.3.4.5.6.7.8 9",
    "256.1.1.1 01.002.0003.4 1.2.3 1.2.3.999 00000000000000000001.1.1.255", "4111 1111 1111 1111 and 4111-1111-1111-1111", "4111111111111112 1 2 3", "4111 1111 1111 1111 4",
    "41111111111111110000000", "+1 (017) 555-7713 rest +1 +12 +1234567 +12345678 +1-2-3-4-5-6-7-8-", "+1 234 567 890 123 456 789 +49 30 123456.+49 30 123456",
    "iban DE89 3704 0044 0532 0130 00 ok; GB82WEST12345698765432; DE89370400440532013001", "ssn 123-45-6789, number 123-45-6789" + " " * 200 + "321-45-6789 000-12-3456",
    "9 " * 5000, "a" * 50000, "1." * 20000, "a@" * 5000, "+1" * 5000, "a@b.c " * 2000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, pii string")
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, text in enumerate(TEXTS):
        assert [(s.kind, s.start, s.end) for s in rows[i].pii if s.kind in pii.BASE] == brute(text), text and text[:60]


def test_added_kinds_need_validators_and_context(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = {r.doc_id: [s.kind for s in r.pii if s.kind not in pii.BASE] for r in pii.find_pii(df).collect()}
    assert rows[16] == ["iban", "iban"]
    assert rows[17] == ["ssn", "ssn"][: len(rows[17])] and rows[17]


def test_redaction_hides_every_span_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "to a@b.c or 1.2.3.4!", "en"), (2, None, "fr"), (3, "clean", None), (4, "+4111 1111 1111 1111 x", "en")], "doc_id long, text string, lang string")
    out = pii.redact(pii.find_pii(df))
    assert out.columns == df.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows == {1: "to [EMAIL] or [IP]!", 2: None, 3: "clean", 4: "+[CARD] x"}


def test_query_digests_and_empty_table(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a@b.c"), (3, TEXTS[3])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op3_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "a@b.c"
        spans = brute(text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in pii.BASE]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty).count() == 0


def test_account_numbers_end_where_their_country_says(spark):
    def whole(start):  # a number of a country without a fixed length, with its check digits
        number = int("".join(str(int(c, 36)) for c in start[4:] + start[:2] + "00"))
        return f"{start[:2]}{98 - number % 97:02d}{start[4:]}"

    other = whole("ZZ00ABCD123456789012")
    spaced = " ".join(other[i : i + 4] for i in range(0, len(other), 4))
    accounts = {
        "GB82 WEST 1234 5698 7654 32 EUR 500": ["GB82 WEST 1234 5698 7654 32"],
        "DE89 3704 0044 0532 0130 00 30 days": ["DE89 3704 0044 0532 0130 00"],
        "GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 NO93 8601 1117 947 X": ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"],
        f"to {spaced} EUR 500": [spaced],
        "DE89 3704 0044 0532 0130 01 30 days": [],
    }
    df = spark.createDataFrame([(t,) for t in accounts], "text string")
    for r in pii.find_pii(df).collect():
        assert [r.text[s.start : s.end] for s in r.pii if s.kind == "iban"] == accounts[r.text], r.text


def test_many_spans_in_one_long_text_are_cut_as_brute_force_does(spark):
    text = "é中" * 3000 + " ".join(f"user{k}@mail.example.com ssn 123-45-{1000 + k % 9000} é" for k in range(20_000)) + "x" * 9000
    found = pii.find_pii(spark.createDataFrame([(text,)], "text string"))
    spans = found.first().pii
    want = [("email", m.start(), m.end()) for m in re.finditer(r"user\d+@mail\.example\.com", text)] + [("ssn", m.start(), m.end()) for m in re.finditer(r"123-45-\d{4}", text)]
    assert [(s.kind, s.start, s.end) for s in spans] == want
    parts, at = [], 0
    for kind, start, end in sorted(want, key=lambda s: s[1]):
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    assert pii.redact(found).first().text == "".join(parts) + text[at:]
