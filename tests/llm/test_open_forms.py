"""Personal information in ordinary text: forms and names that no directory holds."""

from __future__ import annotations

import random
import time

import pytest

from brindle.llm import pii
from brindle.llm.open_forms import open_candidates
from brindle.llm.train_open import _HELD, made


@pytest.fixture(scope="module")
def detector():
    return pii.Detector([], pii.load_model(), pii.load_model("open_model"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("John Smith called yesterday.", ["John Smith"]), ("I saw Mr. Johnson there.", ["Johnson"]), ("Dr. Nguyen will see you.", ["Nguyen"]), ("Mrs. Kowalski left.", ["Kowalski"]), ("J. P. Morgan was rich.", ["J. P. Morgan"]),
        ("The Lord Mayor met Maria de la Cruz.", ["Maria de la Cruz"]), ("Le courrier de Pierre Dubois est arrivé.", ["Pierre Dubois"]), ("Ask for Angela Merkel at the office.", ["Angela Merkel"]),
        ("SSN: 078-05-1120", ["078-05-1120"]), ("Passport No. C01X00T47 was lost.", ["C01X00T47"]), ("Call 415-555-0132 now.", ["415-555-0132"]), ("Tel. +49 30 1234 5678, or (415) 555-0132.", ["+49 30 1234 5678", "(415) 555-0132"]),
        ("She lives at 1600 Pennsylvania Ave in town.", ["1600 Pennsylvania Ave"]), ("Er wohnt Unter den Linden 77 in Berlin.", ["Unter den Linden 77"]), ("221B Baker Street is famous.", ["221B Baker Street"]), ("Hauptstraße 5a in Bonn", ["Hauptstraße 5a"]),
        ("Mail x@y.io please.", ["x@y.io"]), ("The Bank of England and New York City.", []), ("In 1999 we sold 1200 houses.", []), ("", []), (" \n", []),
    ],
)
def test_ordinary_sentences(detector, text, want):
    assert [text[a:b] for _, a, b in detector.find([text])[0]] == want


def test_held_out_sentences_and_names(detector):
    texts = made(random.Random(77), 300, _HELD, True)
    cases = {(i, *c) for i, (_, cs) in enumerate(texts) for c in cs}
    got = {(i, *f) for i, f in enumerate(detector.find([t for t, _ in texts])) for f in f}
    assert len(cases & got) >= 0.85 * len(cases)
    assert len(cases & got) >= 0.85 * len(got)


def test_what_is_taken_is_not_proposed_again():
    text = "Mr. Johnson met Mr. Wilkens."
    assert {text[a:b] for k, a, b, _ in open_candidates(text, taken=[("name", 4, 11)])} == {"Wilkens"}


def test_resolving_very_many_spans_is_quick():
    spans = [(random.Random(i).random(), "name", i * 3, i * 3 + 5) for i in range(30_000)]
    began = time.perf_counter()
    kept = pii.resolve(spans)
    assert time.perf_counter() - began < 5
    assert all(b <= x for (_, _, b), (_, x, _) in zip(kept, kept[1:])) and len(kept) > 10_000
