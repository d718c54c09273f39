"""Operators against brute force, on a small table with nulls, empty texts, copies, repeated rows and clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressroom.llm import bpe, chat, chunks, decontaminate, jaccard, langid, pii, quality, repeats, tokenfile
from pressroom.llm.common import read

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    given = read(spark, DATA, "documents").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in given]
    long_one = rows[3][1]
    odd = [None, "", " \n\t ", "one", "two words", "a\x1cb  c\x85\n\n d", long_one, long_one + " and more", "aaaa" * 200, "x " * 400, "<|im_end|> \\<| |>", "a<|endoftext|>b c", " a\u00a0b", "a\n\nb\u00a0c", "tab\there it's 12345 \u4e2d\u6587\u3000x"]
    rows += [(10_000 + k, text, "en" if k % 2 else None) for k, text in enumerate(odd)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"key": F.lit(1), "row": F.lit("r"), "n": F.lit(2), "value": F.lit("v")}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_byte_bpe(docs, texts):
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r.ids == exact.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_token_file(spark, docs, texts, tmp_path):
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path(tokenfile.TOKENIZER)), 0
    tokenfile.write(docs, f"file://{tmp_path}/t")
    found = sorted(tokenfile.read_documents(spark, f"file://{tmp_path}/t").collect())
    assert len(found) == len(texts)
    for r in found:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_file_spans_blocks(spark, docs, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 100)
    folder = f"file://{tmp_path}/t"
    tokenfile.write(docs.where("doc_id < 40"), folder)
    assert spark.read.parquet(f"{folder}/blocks").where("size(planes) <> 32 OR count > 100").count() == 0
    encoded = {r.doc_id: bytes(r.ids) for r in tokenfile.encode(docs).collect()}
    found = tokenfile.read_documents(spark, folder).collect()
    assert {r.doc_id: r.ids_crc32 for r in found} == {k: zlib.crc32(v) for k, v in encoded.items() if k < 40}
    assert tokenfile.joined_crc(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_planes():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1001, np.uint32)
    for some in (ids, ids % 50_000, ids[:1] * 0, ids * 0 + 65_535, ids * 0 + 65_536):
        assert (tokenfile.from_planes(tokenfile.to_planes(some), len(some)) == some).all()


def test_chat_folds_events(spark):
    rows = [
        (1, 1, "a", "open", "user", "Hi"), (1, 2, "b", "open", "assistant", "He"), (1, 3, "b", "delta", None, "llo"), (1, 70, "b", "regenerate", None, None),
        (1, 71, "b", "delta", None, "Bye <|im_end|>\\"), (1, 72, "a", "edit", None, "Ho"), (2, 1, "a", "open", None, None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, message string, kind string, role string, text string")
    found = {r.conv_id: chat.parse(r.formatted) for r in chat.render(chat.messages(events)).collect()}
    assert found == {1: [("user", "Ho"), ("assistant", "Bye <|im_end|>\\")], 2: [("", "")]}


def test_chat_digests(spark):
    turns = read(spark, DATA, "conversations")
    turns = turns.unionByName(turns.limit(3))
    said = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text or "")):
        said.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    for r in chat.digests(chat.render(chat.messages(chat.events_of_turns(turns)))).collect():
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said[r.conv_id]).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(b for a, b in said[r.conv_id] if a == "assistant").encode()).hexdigest()


def test_chat_equal_texts_of_different_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 2, "user", "ok"), (1, 3, "assistant", "ok"), (1, 6, "user", "ok"), (1, 7, "assistant", "ok"), (1, 90, "assistant", "ok")]
    rows += [(2, 1, "user", None), (2, 2, "user", "x"), (2, 3, "user", None), (2, 70, "user", None), (2, 70, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    chats = chat.render(chat.messages(chat.events_of_turns(turns)), chat.CHUNK * chat.STRIDE).orderBy("conv_id", "chunk").collect()
    for conv in (1, 2):
        assert [t for r in chats if r.conv_id == conv for t in chat.parse(r.formatted)] == [(role, text or "") for c, _, role, text in rows if c == conv]
    assert [len(r.loss) for r in chats if r.conv_id == 1] == [2, 1]


def test_quality_counts(docs, texts):
    for r in quality.counted(docs.select("doc_id", "text")).collect():
        words = [w for w in texts[r.doc_id].translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(inside))


def test_quality_passes_columns_on(docs):
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, texts, n, percent):
    sets = {}
    for doc, text in texts.items():
        words = text.encode().lower().split()
        sets[doc] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    root = {doc: doc for doc in sets}
    order = sorted(sets)
    for _ in order:
        before = dict(root)
        for i, a in enumerate(order):
            for b in order[:i]:
                if root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    for r in jaccard.classes(docs, n, percent).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])


def test_long_repeats(docs, texts):
    starts = Counter(t[s : s + 200] for t in (x.encode() for x in texts.values()) for s in range(len(t) - 199))
    for r in repeats.shortened(docs).collect():
        data = texts[r.doc_id].encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 199):
            if starts[data[s : s + 200]] > 1:
                gone[s : s + 200] = True
        assert bytes(r.kept) == bytes(np.frombuffer(data, np.uint8)[~gone])


def test_chunks(docs, texts):
    found = {r.doc_id: r.spans for r in chunks.repeats(docs).collect()}
    assert [(s["at"], s["end"]) for s in found[10_006]] == [(0, len(texts[10_006].encode()))]
    assert chunks.cuts(b"x" * 1200)[-1] == 1200


def test_chunks_passages(spark):
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 10, 5000)]
    say = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    passages = [say(50) for _ in range(60)]
    rows = [(2 * k + n, f"{say(rng.integers(5, 80))}{'.,'[n]}\u00e4{p}{'?!'[n]}{say(rng.integers(5, 80))}") for k, p in enumerate(passages) for n in (0, 1)]
    docs = spark.createDataFrame([*rows, (500, say(300)), rows[0]], "doc_id long, text string")
    found = {r.doc_id: [(s["at"], s["end"]) for s in r.spans] for r in chunks.repeats(docs).collect()}
    wanted = {}
    for doc, text in rows:
        if doc % 2:
            data, passage = text.encode(), f"\u00e4{passages[doc // 2]}".encode()
            wanted[doc] = [(data.index(passage), data.index(passage) + len(passage))]
    assert found == wanted


def test_pii_spans():
    text = "Mail bob (at) example (dot) org or a.b@c.de, ring +49 30 1234567"
    found = [(kind, text[a:b], plain) for kind, a, b, plain in pii.spans_of(text)]
    assert ("email", "a.b@c.de", True) in found and ("phone", "+49 30 1234567", True) in found
    assert any(kind == "email" and "bob" in said and not plain for kind, said, plain in found)
    assert pii.redacted("") == ""


@pytest.mark.parametrize("more", ["", " That is the point of it."])
@pytest.mark.parametrize("address", ["jane at example.com", "jane.doe ARROBA mail.example.org", "jane at example [dot] com", "jane at example dot com", "jane@example dot com"])
def test_pii_spoken_at(address, more):
    text = f"Write to {address} now.{more}"
    assert [(kind, text[a:b], plain) for kind, a, b, plain in pii.spans_of(text)] == [("email", address, False)]
    assert pii.spans_of(f"We met at noon and left at 5.{more}") == []


@pytest.mark.parametrize("most", [100_000, 3])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    question = "A farmer has 12 cows and buys 30 more cows from Anna each month so how many cows are there after 5 years in total"
    changed = question.replace("12", "99").replace("Anna", "Maria")
    mixed = "if 7 and 8 then 9 or 10 but 11 and 12"
    rows = [(1, f"Intro words here. {question} And so on."), (2, changed), (3, mixed), (4, None), (5, ""), (6, "An innocent text about a farmer and cows")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([(7, question), (7, question), (8, None), (9, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.matches(docs, bench).collect()}
    assert found == {(1, 7, False), (2, 7, True)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5, 6]


def test_decontamination_verbatim(spark):
    items = {
        1: "Add 12 and 15 and 20 then 3",  # a window with two plain tokens
        2: "12 13 14 15 16 17 18 19 20 21 22 23 24 25 26",  # none at all
        3: "Anna sells red shells",  # too short by definition
        4: "Anna sells red shells here",  # a name or not, by what stands before
        5: "Old Tom told Maria that\nJohn and Paul saw Ringo near George on Sunday",
    }
    texts = {k: f"It is said that {text} was asked" for k, text in items.items()}
    texts |= {10 + k: f"It is said that {text.lower()} was asked" for k, text in items.items()} | {25: f"so {items[5]} it".replace("\n", " ")}
    docs = spark.createDataFrame([*texts.items(), (30, "Add 12 and 15"), (31, "12 13 14 15 16 17 18 99 20 21 22 23 24 25 26")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, spark.createDataFrame([*items.items()], "item_id long, text string")).collect()}
    assert found == {(k + add, k) for k in (1, 2, 4, 5) for add in (0, 10)} | {(25, 5)}


def test_decontamination_one_repeat_edited(spark):
    words = "while the old teacher in town gave Anna some apples and then told her class how many sweet pears".split()
    question = " ".join([*words, "Anna got when", *words[6:], "got"])
    second = question.rindex("Anna")
    edited = question[:second] + "Maria" + question[second + 4 :]
    changed = edited.replace("Anna", "Berta")
    docs = spark.createDataFrame([(1, question), (2, edited), (3, changed), (4, "told Anna and Maria")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, spark.createDataFrame([(7, question)], "item_id long, text string")).collect()}
    assert found == {(1, 7), (2, 7), (3, 7)}
    window = lambda a, b: (a.split(), b.split())
    assert decontaminate.agreeing([window("a b", "c d"), window("a", "e"), window("b", "d")], 3) == (0, False)
    assert decontaminate.agreeing([window("a b", "c d"), window("a", "e"), window("b", "d")], 2) == (2, True)
    assert decontaminate.agreeing([window("a a", "c d")], 1) == (0, False)
    assert decontaminate.agreeing([window("a a", "c d"), window("b", "f")], 2) == (0, False)
    assert decontaminate.agreeing([], 1) == (0, False)


def test_language(spark):
    found = langid.op7_language_id(spark, DATA).join(read(spark, DATA, "documents"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert found.where("lang = lang_pred").count() >= 0.9 * found.count()


def test_language_scores(spark, docs, texts):
    """Every row against the definition, word by word, n-gram by n-gram."""
    import regex

    model = langid.learn(docs.where("doc_id < 80"))
    assert set(model.langs) <= {"en", "fr", "de", "es"} and len(model.units[0]) > 500
    logs = {(k, unit): model.logs[row] for k, units in enumerate(model.units) for unit, row in units.items()}
    for r in langid.identify(docs, model).collect():
        words = regex.findall(r"\p{L}+", texts[r.doc_id].lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = np.zeros(len(model.langs))
        for word in words:
            marked = f" {word} "
            found = [(0, word)] if (0, word) in logs else [next((k, marked[i : i + k]) for k in (5, 4, 3, 2, 1, 0) if (k, marked[i : i + k]) in logs or not k) for i in range(len(marked))]
            found = [logs[u] for u in found if u in logs]
            total += np.mean(found, 0) if found else 0
        odds = np.exp((total - total.max()) / len(words))
        assert abs(r.score - odds.max() / odds.sum()) < 1e-5
        assert abs(odds[model.langs.index(r.lang_pred)] - 1) < 1e-5


def test_language_sample_is_bounded(spark, docs):
    rows = docs.where("doc_id < 80").union(docs.where("doc_id < 80"))
    assert langid.sample(rows, 6).select("lang").distinct().count() == 4
    assert langid.sample(rows, 6).count() <= 12
    nothing = langid.identify(docs, langid.learn(docs.where("lang = 'xx'")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


@pytest.mark.parametrize(("sizes", "fan"), [((40, 40), 2), ((1, 90), 3), ((90, 7), 16), ((300, 300), 4)])
def test_tree_join(monkeypatch, sizes, fan):
    monkeypatch.setattr(jaccard, "FAN", fan)
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    rng = np.random.default_rng(sum(sizes))
    base = rng.integers(0, 9, (6, jaccard.GROUPS))
    make = lambda k: np.maximum(base[rng.integers(0, 6, k)] + rng.integers(-1, 2, (k, jaccard.GROUPS)) * (rng.random((k, 1)) < 0.5), 0)
    points = [make(k) for k in sizes]
    ns = [p.sum(1) for p in points]

    def allowed(p, n, q, m):
        return 185 * np.minimum(p, q).sum() >= 85 * (n + m) and 100 * min(n, m) >= 85 * max(n, m)

    one, two = (jaccard.Tree(p, n) for p, n in zip(points, ns, strict=True))
    found = [(i, j) for a, b in jaccard.tree_join(one, two, 85, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    wanted = {(i, j) for i in range(sizes[0]) for j in range(sizes[1]) if allowed(points[0][i], ns[0][i], points[1][j], ns[1][j])}
    assert set(found) == wanted and len(found) == len(wanted)
    found = [tuple(sorted(pair)) for a, b in jaccard.tree_join(one, one, 85, True) for pair in zip(a.tolist(), b.tolist(), strict=True)]
    wanted = {(i, j) for i in range(sizes[0]) for j in range(i + 1, sizes[0]) if allowed(points[0][i], ns[0][i], points[0][j], ns[0][j])}
    assert set(found) == wanted and len(found) == len(wanted)


def components_of(sets, n, percent):
    root, order = {doc: doc for doc in sets}, sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {doc: find(doc) for doc in sets}


def test_jaccard_hot_key_in_blocks(spark, monkeypatch):
    """Texts around one passage, some of them linked in chains, in blocks of five points."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for group in range(12):
        words = passage + [f"g{group}w{k}" for k in range(30)]
        for _ in range(5):
            words = [w if rng.random() > 0.02 else f"x{rng.integers(1000)}" for w in words]
            rows.append((len(rows), " ".join(words)))
    rows += [rows[7], (200, rows[3][1]), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit(1), "key": F.lit(2), "digest": F.lit("d")})
    sets = {}
    for doc, text in rows:
        words = (text or "").split()
        sets[doc] = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
    wanted = components_of(sets, 4, 85)
    assert 12 < len(set(wanted.values())) < 50
    found = jaccard.classes(docs).collect()
    assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == wanted


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_long_near_copies_meet_under_few_heads(spark, monkeypatch, n, percent):
    """Long texts that share very many keys without being linked are compared for a few heads, not for each key, and finer groups tell them apart."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(600)]
    rows = [(k, " ".join(w if rng.random() > 0.04 else f"x{rng.integers(10_000)}" for w in base)) for k in range(24)]
    rows += [(24, rows[5][1] + " and more"), (25, "one more " + rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {doc: {tuple(text.split()[i : i + n]) for i in range(len(text.split()) - n + 1)} for doc, text in rows}
    seen = []
    looked_at = jaccard.candidates

    def candidates(grouped, given):
        seen.extend([grouped.count(), looked_at(grouped, given).count()])
        return looked_at(grouped, given)

    monkeypatch.setattr(jaccard, "candidates", candidates)
    found = {r.doc_id: r.component_id for r in jaccard.classes(docs, n, percent).collect()}
    assert found == components_of(sets, n, percent) and found[24] == found[25] == 5
    assert seen[0] < 10 * len(rows) and seen[1] < 30


def test_hot_join(spark, monkeypatch):
    from pressroom.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"c{k % 8}") for k in range(40)], "id int, key string")
    keyed = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("key <> 'c4'")
    found = {(r.key, r.id, r.least) for r in common.joined(rows, keyed, ["key"], "n").collect()}
    assert found == {(r.key, r.id, r.least) for r in rows.join(keyed, "key").collect()}


@pytest.mark.parametrize(("most", "batches"), [(4096, 4), (2, 3)])
def test_long_repeats_of_all_lengths(spark, monkeypatch, most, batches):
    """Planted passages around LENGTH, edited copies, periods, repeats within one text, through both ways of comparing."""
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "BATCHES", batches)
    rng = np.random.default_rng(11)
    say = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passages = [say(n) for n in (150, 199, 200, 201, 230, 263, 264, 330, 420, 900)]
    rows = []
    for k in range(60):
        parts = [say(int(rng.integers(0, 400)))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(len(passages)))]
            cut = int(rng.integers(0, 30)) if rng.random() < 0.4 else 0
            p = p[cut:]
            if rng.random() < 0.3:
                at = int(rng.integers(len(p)))
                p = p[:at] + "é" + p[at + 1 :]
            parts += [p, say(int(rng.integers(0, 60)))]
        rows.append((k, "".join(parts)))
    for k, period in enumerate((1, 2, 7, 63, 64, 65, 136, 137, 138, 199, 200, 201, 300)):
        rows.append((100 + k, (say(period) * 700)[: 650 + period]))
    rows += [(200, rows[105 - 40][1] if len(rows) > 65 else ""), (201, say(199)), (202, None), rows[5], (5, rows[5][1] + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("row", "anchor", "first", "batch", "n", "key")})
    starts = Counter((t or "").encode()[s : s + 200] for _, t in rows for s in range(len((t or "").encode()) - 199))
    wanted = Counter()
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 199):
            if starts[data[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        wanted[doc, np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data), int(gone.sum()), spans] += 1
    found = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in repeats.shortened(docs).collect())
    assert found == wanted
    assert sum(0 < key[3] < key[2] for key in wanted) > 20
    assert repeats.shortened(docs.where("doc_id < 0")).count() == 0


def test_repeated_strings_with_equal_fingerprints(monkeypatch):
    monkeypatch.setattr(repeats, "_joined", lambda a, b, level: np.zeros(min(len(a), len(b)), np.uint64))
    data = np.frombuffer(b"x" * 200 + b"y" * 200 + b"x" * 200, np.uint8)
    assert repeats.repeated_strings(data, np.array([0, 200, 400])).tolist() == [True, False, True]


def test_words_are_looked_up_not_gone_through():
    """What a batch costs hangs on its own words, not on all that are remembered."""

    class Remembered(dict):
        def __iter__(self):
            raise AssertionError("all remembered words gone through")

    words = bpe.Words(lambda texts: [text.encode() for text in texts], 100)
    words.young, words.old = Remembered({"b": b" b"}), Remembered({"c": b" c"})
    assert words.encode(["a b c d", "a\nb"]) == [b"a b c d", b"a\nb"]
    assert dict.keys(words.young) == {"a", "b", "c", "d", "\nb"}
