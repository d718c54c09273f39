"""Personal data: base patterns against the contract's own, every transducer with exact offsets, prose, and odd texts in time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pressroom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_base_patterns_are_those_of_the_contract():
    rng = random.Random(4)
    for _ in range(30_000):
        text = "".join(rng.choices("ab1.2@@.+-% 3é", k=rng.randrange(24)))
        found = pii.detect(text)
        assert [s[1:] for s in found if s[0] == "email"] == [m.span() for m in EMAIL.finditer(text)], text
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IP.finditer(text)], text


def added(text):
    return [(kind, text[a:b]) for kind, a, b, plain in pii.spans_of(text) if not plain]


@pytest.mark.parametrize(
    "kind,said",
    [
        ("email", "jοhn@example.com"),  # a Greek letter
        ("email", "аnna.mаy@exаmple.org"),  # Cyrillic ones
        ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),  # full width
        ("email", "jo​hn@exam­ple.com"),  # invisible characters
        ("email", "john (at) example (dot) com"),
        ("email", "john [ AT ] mail { punkt } example <.> com"),
        ("email", "jane dot doe at example dot com"),
        ("email", "jane arroba ejemplo punto es"),
        ("email", "jane@example dot com"),
        ("ip", "１９２．１６８．０．１"),
        ("ip", "one nine two dot one six eight dot zero dot one"),
        ("card", "４１１１ １１１１ １１１１ １１１１"),
        ("card", "four one one one one one one one one one one one one one one one"),
        ("card", "4111​1111​1111​1111"),
        ("phone", "plus four nine three zero one two three four five six seven"),
        ("phone", "＋４９ ３０ １２３４５６７"),
        ("phone", "plus quatre neuf trois zéro, un deux-trois quatre cinq six"),
    ],
)
@pytest.mark.parametrize("around", ["{}", "x é — {} . y", "\n\t({})\n"])
def test_disguises_with_source_offsets(kind, said, around):
    assert (kind, said) in added(around.format(said))


def test_a_larger_span_is_kept_beside_a_plain_one():
    text = "to jοhn@example.com now"
    assert pii.spans_of(text) == [("email", 3, 19, False), ("email", 5, 19, True)]
    assert pii.redacted(text) == "to [EMAIL] now"
    assert pii.spans_of("a@b.cd one two") == [("email", 0, 6, True)]


PROSE = [
    "It sold at 5.99 and closed at 10.30 on Monday.", "She bid at 1.2.3.4 of the list.", "The meeting at noon.today was short.", "Look at example.com for more.", "We arrived at 9.The door was shut.",
    "He is at point two of the plan, at dot level.", "Set at zero.five of the scale at room temperature.", "one or two of three", "at most 3.5 of 4.0", "good at chess.Then he left", "The price is at 4.50.", "at 10.0.0.0.0",
    "twenty-one, two or three of them", "plus one at the party", "a.b at c", "See at http://x.y/z", "(at) the (dot)", "nine to five at work.",
]


@pytest.mark.parametrize("said", PROSE)
def test_prose_is_left_alone(said):
    assert added(said) == []


@pytest.mark.parametrize("said", ["jane at example.com", "j.doe at mail.example.org", "Contact: sales at acme.shop", "jane at example.com.Next one"])
def test_spoken_addresses(said):
    (kind, found), = added(f"Then {said}, he said.")
    assert kind == "email" and found.startswith(("jane at example.com", "j.doe at mail.example.org", "sales at acme.shop"))


@pytest.mark.parametrize(
    "text",
    [
        "a" * 10**6 + " x@y.zz", "1" * 10**6 + " 1.2.3.4", "+1" * 500_000, " " * 10**6 + "(at)", "1 " * 500_000, "@" * 10**6, "a@" * 500_000, "a." * 500_000 + "@", "1." * 500_000,
        "a dot " * 160_000 + "at x.com", "at dot " * 140_000, "one " * 250_000, "(" * 10**6, "+" + "1 (" * 330_000, "x at a.b " * 110_000, "а" * 10**6 + "@x.yy",
    ],
    ids=range(16),
)
def test_time_goes_with_the_length(text):
    began = time.time()
    pii.redacted(text)
    assert time.time() - began < 10


def test_tables(spark):
    rows = [(1, "to jοhn@example.com"), (1, "to jοhn@example.com"), (2, None), (3, ""), (4, "x" * 3_000_000 + " a@b.cd"), (None, "+49 30 1234567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(7), "kind": F.array(F.lit("k")), "none": F.lit(None).cast("int")})
    found = sorted(((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in pii.find_personal_data(docs).collect()), key=str)
    john = [("email", 3, 19, False), ("email", 5, 19, True)]
    assert found == [(0, [("phone", 0, 14, True)]), (1, john), (1, john), (2, []), (3, []), (4, [("email", 3_000_001, 3_000_007, True)])]
    clean = pii.redact(docs)
    assert clean.schema == docs.schema
    assert sorted(((r.doc_id or 0, r.text and r.text[-12:], r.spans) for r in clean.collect()), key=str) == [(0, "[PHONE]", 7), (1, "to [EMAIL]", 7), (1, "to [EMAIL]", 7), (2, None, 7), (3, "", 7), (4, "xxxx [EMAIL]", 7)]
    assert pii.redact(docs.where("false")).count() == pii.find_personal_data(docs.where("false")).count() == 0
