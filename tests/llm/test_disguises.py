"""Disguised identifiers of which a plain part is an identifier already."""

import pytest

from panelsift.llm import pii


@pytest.mark.parametrize(
    "kind, whole",
    [
        ("email", "jоhn@x.com"),  # Cyrillic o
        ("email", "john@x.соm.example"),  # in the domain, a plain part of it would not match
        ("email", "john@x.com.ехample"),  # the domain goes on behind a plain match
        ("email", "user@mail.example (dot) com"),
        ("ip", "10.0.0.1\N{ARABIC-INDIC DIGIT TWO}"),
        ("ip", "\N{FULLWIDTH DIGIT ONE}92.168.0.7"),
        ("phone", "+1 499 555-650\N{FULLWIDTH DIGIT THREE}"),
    ],
)
def test_whole_identifier_is_found_and_masked(kind, whole):
    text = f"ask {whole}, now"
    base, every = pii.find(text)
    assert (4, 4 + len(whole)) in every[kind]
    assert set(base[kind]) <= set(every[kind])
    assert pii.mask(text) == f"ask [{kind.upper()}], now"


def test_spans_inside_a_plain_span_are_not_added():
    text = "ä а john@x.com, 10.0.0.1 and +1 499 555-6503"
    base, every = pii.find(text)
    assert every == base and [len(base[k]) for k in ("email", "ip", "phone")] == [1, 1, 1]
