"""Sharding, collocations and the Merkle manifest against brute force, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.llm import collocations, merkle, shards
from pressroom.ordered import running

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab cd ef gh\n".split(" "), k=rng.randrange(40))), "en", f"s{i % 3 if i % 5 else 0}", i) for i in range(120)]
    rows += [rows[0], rows[0], (3, "another text of number 3", None, None, None), (200, None, None, None, None), (201, "", "de", "", 0), (202, "x" * 3000, "en", "lone", 1), (None, "no number\nat all", "é", "ü", 5), (-7, "\n\n", "en", "s0", 2)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("size", "shard", "slot", "tree", "h", "n", "row", "words", "place", "count")}).cache()


def _key(doc):
    return (doc is not None, doc or 0)


def _expected_shards(rows, n):
    rows = sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows), key=lambda r: (_key(r[0]), r[1:]))
    total, before, slots, out = sum(r[1] for r in rows), 0, Counter(), []
    for doc, size, crc in rows:
        shard = min((2 * before + size) * n // (2 * total), n - 1)
        out.append((doc, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 7, 24])
def test_shards_are_contiguous_and_nearly_equal(spark, odd, n):
    found = shards.assign(odd, n).collect()
    assert Counter(map(tuple, found)) == Counter(_expected_shards(odd.collect(), n))


def test_shards_differ_from_their_share_by_less_than_a_document(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', CAST(id % 97 AS INT))").alias("text"))
    sizes = [r.s for r in shards.assign(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * (96 + 8)


def test_written_shards_are_read_back_in_order(spark, odd, tmp_path):
    docs = odd.drop("shard", "slot")
    shards.write(docs, f"file://{tmp_path}/s", 5)
    back = [shards.read_shard(spark, f"file://{tmp_path}/s", k).collect() for k in range(5)]
    assert [r.slot for rows in back for r in rows] == [k for rows in back for k in range(len(rows))]
    expected = [(d, s) for d, _, _, s, _ in _expected_shards(docs.collect(), 5)]
    assert sorted(((r.doc_id, r.shard) for rows in back for r in rows), key=str) == sorted(expected, key=str)
    assert Counter(r.text for rows in back for r in rows) == Counter(r.text for r in docs.collect())


def test_running_sums_of_one_repeated_row_use_many_partitions(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(5).alias("v")).repartition(4)
    found = running(rows, ["k"], before=F.col("v"), row=F.lit(1)).select("before", "row").orderBy("row").collect()
    assert [tuple(r) for r in found] == [(5 * i, i) for i in range(20_000)]


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(r, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def _tree(leaves):
    """The root, and for each leaf the (left, right) siblings of every level."""
    paths, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        runs = [list(range(i, min(i + 3, len(level)))) for i in range(0, len(level), 3)]
        for run in runs:
            for at in run:
                for leaf in owners[at]:
                    paths[leaf].append(("".join(level[j] for j in run if j < at), "".join(level[j] for j in run if j > at)))
        owners = [[leaf for at in run for leaf in owners[at]] for run in runs]
        level = [_h("".join(level[j] for j in run)) for run in runs]
    return level[0] if level else None, paths


def _expected_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append((_key(r.doc_id), _leaf(r, r.text), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([leaf for _, leaf, _ in sorted(by_source[s], key=lambda x: x[:2])]) for s in order}
    root, tops = _tree([trees[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for (_, leaf, r), path in zip(sorted(by_source[s], key=lambda x: x[:2]), trees[s][1], strict=True):
            path, text = path + top, r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = _leaf(r, text)
            for left, right in path:
                folded = _h(left + folded + right)
            yield (r.doc_id, leaf, trees[s][0], root, _h("".join(a + b for a, b in path)), folded, folded == root)


def test_manifest(spark, odd, monkeypatch):
    monkeypatch.setattr(merkle, "read", lambda *_: odd)
    found = merkle.op13_merkle(spark, "").collect()
    expected = list(_expected_manifest(odd.collect()))
    assert Counter(map(tuple, found)) == Counter(expected)
    assert {v for *_, v in expected} == {True, False}


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 28])
def test_manifest_of_few_rows(spark, odd, monkeypatch, rows):
    docs = odd.where("source = 's1'").orderBy("doc_id").limit(rows).cache()
    monkeypatch.setattr(merkle, "read", lambda *_: docs)
    assert Counter(map(tuple, merkle.op13_merkle(spark, "").collect())) == Counter(_expected_manifest(docs.collect()))


def _grams(rows, longest):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    return counts, totals


def _expected_collocations(rows, least, longest, top):
    counts, totals = _grams(rows, longest)
    cands = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    out = {}
    for g, a in cands.items():
        lang, *w = g
        inside = any(d[0] == lang and len(d) > len(g) and b >= a and any(list(d[1:])[i : i + len(w)] == w for i in range(len(d) - len(w))) for d, b in cands.items())
        if not inside:
            n = totals[lang]
            score, k = min((1000 * a * n // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return {(lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words, rows = ["a", "B", "é", "dd", "|", "F", "new york", "the  quick\tbrown fox", "x.y", "\n", "\x1c", "'"], []
    for i in range(150):
        text = " ".join(rng.choices(words, k=rng.randrange(30)))
        rows.append((rng.choice(["en", "de", None, "und"]), None if i % 40 == 0 else text + rng.choice(["", ".", "\t", "!\v"])))
    return rows + [("en", ""), ("en", "... ,,"), ("xx", "only once"), rows[1], rows[1]]


@pytest.mark.parametrize("size", [60, 700, 1 << 20])
@pytest.mark.parametrize("least,longest,top", [(4, 5, 2000), (2, 3, 7), (6, 2, 50)])
def test_collocations_over_shards_of_any_size(spark, monkeypatch, prose, size, least, longest, top):
    monkeypatch.setattr(collocations, "RANGE_ENTRIES", 50 if size == 700 else 2_000_000)
    docs = spark.createDataFrame(prose, "lang string, text string").withColumns({c: F.lit(c) for c in ("shard", "phrase", "count", "words", "n")}).repartition(3)
    found = collocations.collocations(docs, least, longest, top, size).collect()
    assert {tuple(r) for r in found} == _expected_collocations(prose, least, longest, top) and len(found) == len({tuple(r) for r in found})


def test_extensions_of_a_phrase(spark, prose):
    known, _ = collocations.phrases(spark.createDataFrame(prose, "lang string, text string"), 3, 4)
    counts = {g: a for g, a in _grams(prose, 4)[0].items() if a >= 3}
    left, right = {}, {}
    for (lang, *w), a in counts.items():
        if len(w) > 1:
            left[(lang, *w[1:])] = max(left.get((lang, *w[1:]), 0), a)
            right[(lang, *w[:-1])] = max(right.get((lang, *w[:-1]), 0), a)
    found = {(r.lang, *r.phrase.split(" ")): (r["count"], r.most_left, r.most_right) for r in known.collect()}
    assert found == {g: (a, left.get(g), right.get(g)) for g, a in counts.items()}


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_index_counts_every_phrase_of_a_sequence():
    rng = np.random.default_rng(1)
    sequence = np.append(rng.integers(0, 5, 400), 0).astype(np.int32)
    fm = collocations.FmIndex(sequence, 5)
    for length, (places, counts) in enumerate(fm.intervals(5), 1):
        windows = Counter(tuple(w) for i in range(len(sequence) - length + 1) if 0 not in (w := sequence[i : i + length].tolist()))
        assert {tuple(fm.sequence[p : p + length].tolist()): c for p, c in zip(places, counts, strict=True)} == windows
