import random
import re

import pytest

from venuescope.llm import pii
from venuescope.llm.queries import QUERIES

SAMPLE = "card 4111 1111 1111 1111, bank GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, call (017) 555-7713 or +44 20 7946 0958, from 97.51.17.173, on 2024-02-29 or 31.12.1999 or 31/12/1999, mail Jo.Doe7@mail.example.com."


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_permutations(n):
    p = pii.Permutation(b"k")
    image = [p.of(i, n, "t") for i in range(n)]
    assert sorted(image) == list(range(n)) and [p.of(i, n, "t", True) for i in image] == list(range(n))


def test_formats_stay_and_undo():
    own = pii.Pseudonyms(b"secret")
    text, found = own.replaced(SAMPLE)
    assert [k for k, _, _ in found] == ["card", "iban", "ssn", "phone", "phone", "ip", "date", "date", "date", "mail"]
    assert own.undo(text) == SAMPLE and text != SAMPLE
    assert not any(SAMPLE[s:e] in text for _, s, e in found)
    again, spans = own.replaced(text)
    assert [k for k, _, _ in spans] == [k for k, _, _ in found]
    assert pii.Pseudonyms(b"other").replaced(SAMPLE)[0] != text


def test_equal_values_stay_linked():
    own = pii.Pseudonyms(b"k")
    a, b = own.replaced("x 4111111111111111 y")[0], own.replaced("4111-1111-1111-1111!")[0]
    assert a.split()[1] == b.strip("!").replace("-", "")
    assert pii.luhn_digit(a.split()[1][:-1]) == a.split()[1][-1]


def test_what_is_not_valid_stays():
    own = pii.Pseudonyms(b"k")
    for text in ("9807915762804490", "999.1.1.1", "2023-02-29", "GB00 WEST 1234 5698 7654 32", "000-12-3456", "version 2.0", "1.2.3.4.5", "a@b", ""):
        assert own.replaced(text) == (text, [])


def test_round_trip_of_random_values():
    rng, own = random.Random(4), pii.Pseudonyms(b"k")
    for _ in range(300):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        values = [digits + pii.luhn_digit(digits), ".".join(str(rng.randrange(256)) for _ in range(4)), f"({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}", f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"u.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com"]
        text = " and ".join(values)
        assert own.undo(own.replaced(text)[0]) == text


def test_odd_rows(odd, nothing):
    done = pii.pseudonymise(odd, b"set a key of your own")
    assert done.columns == [*odd.columns, "spans"] and done.count() == 13
    by = {r.doc_id: r for r in done.collect()}
    assert by[1].text is None and by[1].spans == "" and by[-5].spans.startswith("phone:28:42,mail:")
    assert pii.pseudonymise(nothing, b"k").count() == 0


def test_query_against_brute_force(spark, sf, rows_of):
    """Whole texts, one by one; what is replaced is found by patterns and checks of this test's own."""
    sf = sf.replace("0.001", "0.01")
    spark.conf.set(pii.KEY_SETTING, "a key")
    try:
        got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, sf).collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    docs = rows_of(sf, "documents", "doc_id", "text")
    own, linked, found = pii.Pseudonyms(b"a key"), {}, 0
    assert len(got) == len(docs)
    for i, text in docs:
        r, text = got[i], text or ""
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert own.undo(r.text or "") == text
        # All text between the spans stays, and equal values get equal pseudonyms.
        at, back = 0, r.text or ""
        for kind, start, stop in spans:
            new = getattr(own, kind)(text[start:stop], False)
            assert back.startswith(text[at:start] + new) and linked.setdefault((kind, text[start:stop]), new) == new
            at, back, found = stop, back[start - at + len(new) :], found + 1
        assert back == text[at:]
        mails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", text)]
        assert [(s, e) for k, s, e in spans if k == "mail"] == mails and r.n_mail == len(mails)
        cards = [m.span() for m in re.finditer(r"(?<!\d)\d{16}(?!\d)", text) if sum(int(c) if n % 2 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(m[0])) % 10 == 0]
        assert set(cards) <= {(s, e) for k, s, e in spans if k == "card"}
    assert found > 20 and len(set(linked.values())) == len(linked)
