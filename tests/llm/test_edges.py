"""Every operator and stage on empty tables, nulls, repeated rows, very long texts and columns with clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from pressroom.llm import bpe, chat, chunks, decontaminate, jaccard, langid, pii, quality, repeats, tokenfile
from pressroom.llm.common import read

DATA = "/root/testdata/sf0.001"
CLASHES = ("row", "key", "rep", "digest", "n_words", "kept", "anchor", "spans", "item_id", "_row", "_words", "words", "n", "at", "value", "hash", "rank", "comp")


@pytest.fixture(scope="module")
def bench(spark):
    return read(spark, DATA, "benchmark")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of all kinds: repeated ones, null and empty texts, one text of a megabyte, null languages and sources."""
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in read(spark, DATA, "documents").limit(30).collect()]
    long_one = " ".join(f"{text[:4000]}" for _, text, *_ in given[:10]) * 25
    rows = [*given, given[0], given[0], (900, None, "en", "s", None), (901, "", None, None, 0), (902, " \n ", "en", "s", 3), (903, long_one, "en", None, len(long_one)), (903, long_one, "en", None, len(long_one))]
    rows += [(904, given[1][1], None, None, None), (905, given[1][1] + " tail", "xx", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in CLASHES}).cache()


OPERATORS = {
    "tokens": lambda spark, docs, bench, folder: (tokenfile.write(docs, folder), tokenfile.read_documents(spark, folder))[1],
    "bpe": lambda spark, docs, bench, folder: bpe.decode(bpe.encode(docs)),
    "chunks": lambda spark, docs, bench, folder: chunks.shortened(docs),
    "pii": lambda spark, docs, bench, folder: pii.find_personal_data(docs),
    "redacted": lambda spark, docs, bench, folder: pii.redact(docs),
    "repeats": lambda spark, docs, bench, folder: repeats.shortened(docs),
    "language": lambda spark, docs, bench, folder: langid.identify(docs, langid.learn(docs)),
    "jaccard": lambda spark, docs, bench, folder: jaccard.classes(docs),
    "quality": lambda spark, docs, bench, folder: quality.judged(docs).select("_row.doc_id", "kept"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each(spark, odd, bench, tmp_path, name):
    found = OPERATORS[name](spark, odd, bench, f"file://{tmp_path}/t")
    assert Counter(r.doc_id for r in found.select("doc_id").collect()) == Counter(r.doc_id for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, odd, bench, tmp_path, name):
    assert OPERATORS[name](spark, odd.where("doc_id < 0"), bench, f"file://{tmp_path}/t").count() == 0


def test_empty_tables_of_conversations_and_benchmark(spark, odd, bench):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.digests(chat.render(chat.messages(chat.events_of_turns(none)))).count() == 0
    assert decontaminate.matches(odd.where("doc_id < 0"), bench).count() == 0
    assert decontaminate.matches(odd, bench.where("false")).count() == 0
    assert decontaminate.clean(odd, bench.where("false")).count() == odd.count()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    kept = stage(spark, odd, DATA)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in odd.select("doc_id").collect()}
    empty = stage(spark, odd.where("doc_id < 0"), DATA)
    assert empty.columns == kept.columns and empty.count() == 0


def test_pipeline_against_the_operators(spark):
    """run() keeps what the stages' own definitions keep, and encodes what they leave."""
    docs = read(spark, DATA, "documents")
    judged = {r.doc_id for r in quality.op9_quality(spark, DATA).where("kept").collect()}
    good = docs.where(F.col("doc_id").isin(sorted(judged)))
    texts = {r.doc_id: r.text for r in good.collect()}
    sets = {}
    for doc, text in texts.items():
        words = text.encode().lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {}
    for doc in sorted(sets):
        root[doc] = doc
        for other in sorted(d for d in root if d < doc):
            if sets[doc] and sets[other] and 100 * len(sets[doc] & sets[other]) >= 80 * len(sets[doc] | sets[other]):
                low, high = sorted((root[doc], root[other]))
                root = {d: low if r == high else r for d, r in root.items()}
    unlike = {d for d, r in root.items() if d == r}
    hit = {r.doc_id for r in decontaminate.op10_decontamination(spark, DATA).collect()}
    ids = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(ids) == unlike - hit
    encoder = bpe.built_encoder(bpe.RANKS)
    assert all(ids[d] == [i for token in encoder.pattern.findall(pii.redacted(texts[d])) for i in (lambda raw: [encoder.rank(raw)] if encoder.rank(raw) >= 0 else encoder.merge(raw))(token.encode())] for d in ids)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def base_spans(text):
    """The contract's words, one after the other."""
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text) if all(int(part) <= 255 for part in m.group().split("."))]
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_pii_base_against_the_contract(spark):
    texts = {r.doc_id: r.text or "" for r in read(spark, DATA, "documents").collect()}
    found = pii.op5_pii(spark, DATA).collect()
    assert len(found) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in found) > 10
    for r in found:
        spans = base_spans(texts[r.doc_id])
        counts = Counter(kind for kind, *_ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))


def test_chat_from_streamed_events(spark):
    """What arrives as deltas, edits and regenerations reads back as the final turns, in long conversations too."""
    rows, wanted = [], []
    for k in range(150):
        role = ("user", "assistant")[k % 2]
        text = f"turn {k} " + "long text " * (k % 40)
        at = k * 100
        rows.append((7, at, str(k), "open", role, "draft " if k % 3 == 0 else text[:5]))
        if k % 3 == 0:
            rows.append((7, at + 1, str(k), "delta", None, "dropped"))
            rows.append((7, at + 2, str(k), "regenerate" if k % 2 else "edit", None, None if k % 2 else text[:5]))
            rows += [(7, at + 3, str(k), "delta", None, text[:5])] if k % 2 else []
        rows += [(7, at + 4 + j // 7, str(k), "delta", None, text[5 + j : 12 + j]) for j in range(0, len(text) - 5, 7)]
        wanted.append((role, text))
    events = spark.createDataFrame(rows, "conv_id long, seq long, message string, kind string, role string, text string").orderBy(F.rand(1))
    read_back = [t for r in chat.render(chat.messages(events)).orderBy("chunk").collect() for t in chat.parse(r.formatted)]
    assert read_back == wanted
    said = "".join(text for role, text in wanted if role == "assistant")
    assert chat.digests(chat.render(chat.messages(events))).first().loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_pieces(spark):
    """Turns of many pieces, equal rows, and the query's own digests."""
    text = "".join(chr(0x4E00 + k) for k in range(300)) + "<|im_end|>"
    turns = spark.createDataFrame([(1, 5, "assistant", text), (1, 5, "assistant", text), (1, 2, None, None), (1, 9, "user", "x" * 64)], "conv_id long, turn int, role string, text string")
    events = chat.events_of_turns(turns)
    assert events.where("kind = 'delta'").count() == 4 and events.where("kind = 'open'").count() == 4
    found = chat.render(chat.messages(events), chat.CHUNK * chat.STRIDE).collect()
    assert [t for r in found for t in chat.parse(r.formatted)] == [("", ""), ("assistant", text), ("assistant", text), ("user", "x" * 64)]


def test_decontamination_short_items_and_other_ids(spark):
    items = spark.createDataFrame([("a", "Compute 3 + 4"), ("b", "!!"), ("c", "Anna sells red shells here")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "Compute 3 + 4"), (2, "x\ncompute 3 +4.\ny"), (3, "Now compute 3 + 4"), (4, "Compute 3 + 5"), (5, "he said anna sells red shells here !!")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(1, "a"), (2, "a"), (5, "c")}


def test_one_of_equal_rows_stays(spark, odd):
    """Repeated rows, also of a null doc_id, other columns or none; different texts of one doc_id are one document and stay together."""
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "a b c d e f g", "x"), (3, None, None), (3, None, None), (4, "", "x"), (5, "one text", "x"), (5, "other text", "x"), (5, "one text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _copy string")
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs.withColumnRenamed("_copy", "lang")).collect())
    assert kept == Counter([(1, "a b c d e f g"), (3, None), (4, ""), (5, "one text"), (5, "other text")])
    again = jaccard.one_of_each(odd)
    assert again.count() == again.select("doc_id", "text").distinct().count()


def test_a_hot_head_is_dealt_over_tasks(spark, monkeypatch):
    """One text with very many partners: no task has them all, neither where values travel to it nor in cells of blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    pairs = spark.range(1, 20_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    pairs = pairs.unionByName(spark.range(1, 50).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")))
    values = spark.range(20_001).select(F.col("id").alias("rep"), F.encode(F.col("id").cast("string"), "utf-8").alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = jaccard.beside(pairs, values).cache()
        sizes = [r["count"] for r in found.where("b = 0").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 0.6 * sum(sizes)
        assert sorted((r.a, r.b) for r in found.collect()) == sorted((r.a, r.b) for r in pairs.collect())
        assert all((int(r.value_a), int(r.value_b)) == (r.a, r.b) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("block", [3, 2048])
def test_bounds_in_cells(spark, monkeypatch, block):
    """The same pairs pass as one by one, whatever the blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (40, jaccard.FINE)).astype("<u4")
    counts[20:] = counts[:20] + (rng.random((20, jaccard.FINE)) < 0.2)
    squeeze = zstandard.ZstdCompressor().compress
    vectors = spark.createDataFrame([(k, bytearray(squeeze(c.tobytes()))) for k, c in enumerate(counts)], "rep long, fine binary")
    every = [(a, b) for a in range(40) for b in range(a)]
    found = {tuple(r) for r in jaccard.bounded(spark.createDataFrame(every, "a long, b long"), vectors, 80).collect()}
    assert found == {(a, b) for a, b in every if 180 * int(np.minimum(counts[a], counts[b]).sum()) >= 80 * int(counts[a].sum() + counts[b].sum())} and 0 < len(found) < len(every)


def test_common_shingles_gather_no_large_groups(spark, monkeypatch):
    """A line that all texts share brings no two of them together; near copies are still found, also those of texts that are common shingles alone."""
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    draw = random.Random(1)
    line = "this very line stands in all of the texts there are"
    rows = [(k, line + "".join(f" w{draw.randrange(10**9)}" for _ in range(30))) for k in range(300)]
    rows += [(1000 + k, f"{rows[k][1]} x") for k in range(0, 300, 10)] + [(2000, line), (2001, f"{line}\n")]
    sizes, compare = [], jaccard.candidates

    def watched(grouped, percent):
        sizes.append(max((r["count"] for r in grouped.groupBy("key").count().collect()), default=0))
        return compare(grouped, percent)

    monkeypatch.setattr(jaccard, "candidates", watched)
    found = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: 2000 if k == 2001 else k % 1000 if k < 2000 else k for k, _ in rows}
    assert len(sizes) == 1 and sizes[0] <= 4


def test_first_keys():
    rng = np.random.default_rng(2)
    for size, many, count in ((0, 5, 0), (40, 0, 7), (40, 5, 7), (40, 200, 12), (9, 300, 9)):
        found, late = (np.unique(rng.integers(0, 300, k).astype(np.uint64)) for k in (size, many))
        wanted = sorted(found.tolist(), key=lambda x: (x in set(late.tolist()), x))[:count]  # noqa: B023
        assert jaccard.first_keys(found, count, late).tolist() == wanted
