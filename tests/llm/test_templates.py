"""Template matches against a plain search of all diagonals, and the recall of planted re-parameterised questions."""

import random
import re

import pytest

from pressroom.llm import decontaminate as D
from pressroom.llm.common import read

DATA = "/root/testdata/sf0.01"
NAMES, UNITS = ["Anna", "Bob", "Carla", "Dmitri", "Eve"], ["km", "hours", "dollars"]


def tokens(text):
    """(spelled, canonical form, whether it is a placeholder) of a text's tokens, one after the other."""
    out, before = [], "line"
    for token in [*re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:\n]", text), "\n"]:
        if token in ".!?:\n":
            before = "line" if token == "\n" else "break"
            continue
        number, inside = token[0].isdigit(), before not in ("line", "break")
        mark = D.NUMBER if number else D.UNIT if token.lower() in D.UNITS and before == "number" else D.NAME if token[0].isupper() and token.lower() not in D.UNITS and inside else None
        out.append((token.lower(), mark or token.lower(), mark is not None))
        before = "number" if number else "word"
    return out


def plain_matches(docs, items):
    found = set()
    for item, question in items.items():
        q = tokens(question)
        for doc, text in docs.items():
            d = tokens(text)
            for shift in range(-len(q), len(d)):
                windows, sent, verbatim = [], 0, False
                size, run = min(D.WINDOW, len(q)), min(D.RUN, len(q))
                for at in range(len(q) - size + 1):
                    if sum(not mark for _, _, mark in q[at : at + size]) < min(D.LEAST_PLAIN, size):
                        continue
                    sent += 1
                    if 0 <= at + shift <= len(d) - size and [x[1] for x in q[at : at + size]] == [x[1] for x in d[at + shift : at + shift + size]]:
                        windows.append(tuple([s for s, _, mark in side[a : a + size] if mark] for side, a in ((q, at), (d, at + shift))))
                for at in range(len(q) - run + 1):
                    verbatim |= 0 <= at + shift <= len(d) - run and [x[0] for x in q[at : at + run]] == [x[0] for x in d[at + shift : at + shift + run]]
                if verbatim or windows and D.agreeing(windows, min(D.RUN - size + 1, sent))[0]:
                    found.add((doc, item))
    return found


def question(rng):
    """Some twenty to forty tokens with numbers, names and units, of which some occur more than once."""
    people, amounts = rng.sample(NAMES, 2), [str(rng.randint(2, 999)) for _ in range(3)]
    words = [w for _ in range(rng.randint(14, 26)) for w in [rng.choice(["the", "farmer", "buys", "sells", "walks", "more", "then", "how", "many", "each", "cows", "left", "after"])]]
    for extra in [*people, people[0], *amounts, amounts[0]]:
        at = rng.randrange(1, len(words))
        words[at:at] = [extra, rng.choice(UNITS)] if extra[0].isdigit() and rng.random() < 0.5 else [extra]
    return " ".join(words)


def changed(rng, text, consistent=True):
    """Other numbers and names in place of a question's; without consistency every occurrence has one of its own."""
    held = {}

    def other(m):
        new = str(rng.randint(1000, 9999)) if m[0][0].isdigit() else rng.choice(["Zoe", "Yuri", "Xena", "Walt", "Vera", "Uma"])
        return held.setdefault(m[0], new) if consistent else new

    return re.sub(r"\d+|\b(?:" + "|".join(NAMES) + r")\b", other, text)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    items = {k: question(rng) for k in range(25)}
    fill = lambda: " ".join(rng.choices("lorem ipsum Dolor sit 5 amet Cows the 12 km how many".split(), k=30))
    docs = {}
    for k, text in items.items():
        docs[100 + k] = f"{fill()} {text} {fill()}."
        docs[200 + k] = f"{fill()} {changed(rng, text)} {fill()}"
        docs[300 + k] = f"{fill()}\n{changed(rng, text, consistent=False)}\n{fill()}"
        docs[400 + k] = f"{fill()} {' '.join(text.split()[:9])} {fill()} {' '.join(text.split()[9:])}"
        docs[500 + k] = f"{fill()} {fill()}"
    return items, docs


def test_against_a_plain_search(spark, planted):
    items, docs = planted
    found = D.matches(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert found == plain_matches(docs, items)
    for first in (100, 200):  # every verbatim and every re-parameterised copy
        assert {(first + k, k) for k in items} <= found
    assert not [doc for doc, _ in found if doc >= 500]


def test_recall_of_reparameterised_benchmark_items(spark):
    """Every given item with numbers or names, each of these replaced by another: all are found, and the documents as they are hold no more than before."""
    rng = random.Random(12)
    items = {r.item_id: r.text for r in read(spark, DATA, "benchmark").collect()}
    swap = {}

    def other(m):
        return swap.setdefault(m[0], str(int(m[0]) + rng.randint(1, 50)) if m[0].isdigit() else m[0])

    copies = {}
    for item, text in items.items():
        swap.clear()
        words = text.split()
        for at in range(3, len(words), 9):  # benchmark items hold few values, so some are put in
            words.insert(at, str(rng.randint(2, 99)))
        items[item] = " ".join(words)
        copies[item] = "so it was said that " + re.sub(r"\b\d+\b", other, items[item]) + " and so on"
    found = D.matches(spark.createDataFrame([*copies.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string"))
    hits = {r.doc_id for r in found.where("doc_id = item_id AND reparameterised").collect()}
    assert len(hits) == len(items)
