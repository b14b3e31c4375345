"""Personal data against plain regular expressions, and what the anchors add."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from mailweave.llm.pii import find, masked, personal_data, without_personal_data, written_spans


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aé@.+-0123456789 ()_%Z\n", max_size=60))
def test_base_equals_plain_patterns(text):
    assert find(text)[0] == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", "x.y@m.n-o.p", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-1234", "+", " ", "-", "7", "é", "iban", "://"]), max_size=12).map("".join))
def test_base_in_dense_text(text):
    assert find(text)[0] == brute(text)


def test_anchors_add_spans():
    def added(text):
        return [(k, text[a:b]) for k, a, b in find(text)[1]]

    assert added("échre.12@mail.example.com now") == [("email", "échre.12@mail.example.com")]
    assert added("IBAN: GB82 WEST 1234 5698 7654 32, ok") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert added("IBAN: GB82 WEST 1234 5698 7654 33, ok") == []
    assert added("SSN 123-45-6789. SSN 000-45-6789.") == [("account", "123-45-6789")]
    assert added("account no: 12345678 and discount 12345678") == [("account", "12345678")]
    assert added("ftp://joe:pw@host.example/x") == [("account", "joe:pw")]
    assert added("http://[2001:db8::1]/ http://[12]/") == [("address", "2001:db8::1")]
    assert added("plain words, an account of 3 days, version 2.0.") == []


def test_account_numbers_end_where_the_next_word_begins():
    def added(text):
        return [text[a:b] for k, a, b in find(text)[1] if k == "account"]

    iban = "DE89370400440532013000"
    for after in (" BIC COBADEFFXXX", " Thank you", " I", " 12345678901234567890", "", ". X"):
        assert added(f"IBAN: {iban}{after}") == [iban]
    assert added("IBAN GB82 WEST 1234 5698 7654 32 Please pay") == ["GB82 WEST 1234 5698 7654 32"]
    assert added(f"IBAN no. {iban} x") == added(f"iBan Nr: {iban}") == added(f"\u0130 Iban {iban}") == [iban]
    assert added("IBAN NO93 8601 1117 947 OK") == ["NO93 8601 1117 947"]
    assert added(f"IBAN {iban}A") == added("IBAN DE89 3704 0044 0532 0130 01 BIC") == []
    assert added("account 12345678 1234567890123") == ["12345678"]
    assert added("aCCt 12345678") == ["12345678"] and added("account 123456789012345678") == []


def test_long_texts_are_linear():
    began = time.process_time()
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "+1" + " " * 200_000, "1." * 150_000, "@" * 200_000, "é" * 200_000 + "@", "x@" + "a-" * 100_000, "://" + "a" * 200_000, "account " * 30_000):
        find(text)
    assert time.process_time() - began < 10


def test_masking():
    text = "échre.12@mail.example.com or 1.2.3.4"
    assert masked(text, sum(find(text), [])) == "[EMAIL] or [IP]"


def test_rows(spark):
    rows = [(1, "x a@b.co y", 10, "e"), (2, None, None, "e"), (3, "", 0, None), (3, "", 0, None), (None, "1.2.3.4", 7, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.base_sha256, r.spans) for r in personal_data(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 1, 0, sha("email:2:8"), "email:2:8"), (2, 0, 0, sha(""), ""), (3, 0, 0, sha(""), ""), (None, 0, 1, sha("ip:0:7"), "ip:0:7")}
    out = {(r.doc_id, r.text, r.n_chars) for r in without_personal_data(docs).collect()}
    assert out == {(1, "x [EMAIL] y", 11), (2, None, None), (3, "", 0), (None, "[IP]", 4)}
    assert without_personal_data(docs).schema == docs.schema
    assert personal_data(docs.limit(0)).count() == 0
    assert written_spans([]) == ""
