"""Strict and wider spans against the plain patterns on arbitrary text, and on a megabyte."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from alleleflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = st.sampled_from(["a", "b.c", "@", ".", "_", "+", "-", " ", "1", "25", "4111 1111 1111 1111", "10.0.0.1", "+44 20 7946 0958", "555-123-4567", "é", "\n"])


def plain(text):
    digits = lambda t: re.sub(r"[^0-9]", "", t)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_spans_as_by_the_plain_patterns(text):
    strict = pii.strict_spans(text)
    assert strict == plain(text)
    for a, _, b in pii._wide_spans(text, strict):
        assert all(b <= x or y <= a for x, _, y in strict)
    every = pii._wide_spans(text, [])
    assert pii._wide_spans(text, strict) == [s for s in every if not any(x < s[2] and s[0] < y for x, _, y in strict)]


def test_a_megabyte_of_one_kind():
    for text in ("1" * 1_000_000, "1.2." * 250_000, "x" * 1_000_000 + " @"):
        began = time.monotonic()
        pii._wide_spans(text, pii.strict_spans(text))
        assert time.monotonic() - began < 5
    many = "10.0.0.1 555-123-4567 " * 8000
    began = time.monotonic()
    assert len(pii._wide_spans(many, pii.strict_spans(many))) == 8000
    assert time.monotonic() - began < 5
