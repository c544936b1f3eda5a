import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.functions import html, pii, spans


def test_personal_data(spark):
    t = "Write to a.b@c.org or see https://c.org/ab, host 10.1.2.3, not x@example.com."
    found = pii.spans_of(t)
    assert [(s["entity_type"], s["value"]) for s in found] == [("EMAIL_ADDRESS", "a.b@c.org"), ("URL", "https://c.org/ab"), ("IP_ADDRESS", "10.1.2.3")]
    assert pii.spans_of(None) == [] and pii.spans_of("") == []
    assert pii.spans_of("any", extra=lambda x: [("NAME", 0, 3, 0.7)]) == [{"entity_type": "NAME", "value": "any", "start": 0, "stop": 3, "confidence": 0.7}]
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string").withColumn("spans", pii.detect("t"))
    assert [len(r["spans"]) for r in df.collect()] == [3, 0, 0]
    r = pii.report(df).first()
    assert r["total"] == 3 and r["sure"] == 3 and r["top_types"] == ["EMAIL_ADDRESS", "IP_ADDRESS", "URL"]


# expected values by kind, written by hand
KINDS = [
    ("call (020) 123-4567", "PHONE_NUMBER"),
    ("card 4111 1111 1111 1111", "CREDIT_CARD"),
    ("id 123-45-6789.", "US_SSN"),
    ("no AB 12 34 56 C", "UK_NINO"),
    ("to DE89 3704 0044 0532 0130 00", "IBAN_CODE"),
    ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "IP_ADDRESS"),
    ("due 2024-03-01", "DATE"),
]


@pytest.mark.parametrize("text,kind", KINDS)
def test_kinds_of_personal_data(text, kind):
    assert kind in [s["entity_type"] for s in pii.spans_of(text, [kind])]


def test_allowed_numbers_are_none():
    assert pii.spans_of("(555) 123-4567") == []


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=200))
def test_spans_do_not_overlap(text):
    found = pii.spans_of(text + " x@y.zz " + text)
    assert all(a["stop"] <= b["start"] for a, b in zip(found, found[1:]))


def test_claims_and_pooling():
    assert spans.claims("First thing [1]. No source. Second [2;3] thing!") == [{"claim": "First thing .", "markers": [1]}, {"claim": "Second thing!", "markers": [2, 3]}]
    assert spans.claims(None) == []
    offsets = [(0, 3), (4, 7), (8, 12)]
    assert spans.token_bounds(offsets, (2, 5)) == (0, 2) and spans.token_bounds(offsets, (50, 60)) == (3, 3)
    v = spans.pooled(np.array([[1.0, 0], [0, 1.0], [0, 0]]), [(0, 2), (2, 2), (2, 3)])
    assert np.allclose(v, [[0.5**0.5, 0.5**0.5], [0, 0], [0, 0]])


def test_linked_data(spark):
    page = '<!-- saved from url=(0022)https://a.org/x --><script type="application/ld+json">{"@graph": [{"@type": "Person"}, {"@type": ["Article"], "articleBody": "' + "b" * 120 + '"}]}</script><script type="application/ld+json">{broken</script>'
    assert html.article(page)["@type"] == ["Article"] and html.article("<p>") is None and html.article(None) is None
    assert html.texts_in(html.linked_data(page)) == ["b" * 120]
    assert html.outline([{"level": 1, "title": "a"}, {"level": 2, "title": "b"}]) == "a\n  b"
    r = spark.createDataFrame([(page,), ("<p>",)], "h string").select(html.is_saved_page("h"), html.saved_from("h")).collect()
    assert [tuple(x) for x in r] == [(True, "https://a.org/x"), (False, "")]
