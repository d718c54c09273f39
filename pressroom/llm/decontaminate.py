"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of WINDOW template tokens of the
benchmark are hash-joined with those of the documents. Windows of one item on one diagonal (same distance between
both texts) form a match if enough of them have consistent slots: each value in the item's slots
stands for one value in the document, be it in windows of equal slots, in neighbouring ones, or in those with each value's most frequent partner. Re-parameterised questions thus match, and
coincidences of placeholders do not. Besides, RUN lower-cased tokens in a row, or all of a shorter item, match as they are, whatever their kinds.

Documents send only windows whose hash falls on a set bit of a bitmap of BITS bits, of fixed size, made from the
benchmark; the join decides, by the template itself. A benchmark of up to MOST_BROADCAST windows is broadcast; with a larger one rows are
salted by document.

Defined results: null and empty texts match nothing. Items of fewer than LEAST_TOKENS tokens match only where they are a whole line, items
of fewer than WINDOW tokens as one window, items without tokens nothing. item_id may be of any type. Very long texts are read whole. Repeated rows of either table are matched once, but clean() drops or keeps each of them. Ties between values' partners go to the lesser
one. An empty benchmark matches nothing, an empty documents table gives no rows. Extra columns are passed on by clean() and not read otherwise.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import pieces, read, stored

WINDOW = 8
LEAST_TOKENS = 5
#: A match covers as many tokens of an item, or all of a shorter one.
RUN = 13
#: Tokens that are no placeholders in every window.
LEAST_PLAIN = 3
BITS = 1 << 22
#: Benchmarks of so many windows are broadcast, larger ones joined with salted rows.
MOST_BROADCAST = 100_000
SALTS = 64
ORACLE_SQL = None

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:\n]")
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years percent "
    "mile miles foot feet inch inches yard yards pound pounds lb lbs ounce ounces oz dollar dollars euro euros cent cents meter meters metre metres "
    "kilometer kilometers kilogram kilograms gram grams liter liters litre litres mph kmh watt watts volt volts degree degrees".split()
)
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
_BREAK, _LINE, _PLAIN, _CAPITAL, _NUMBER, _UNIT = range(6)
_HASHES = np.array([0, *map(xxhash.xxh3_64_intdigest, (NUMBER, NAME, UNIT))], np.uint64)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Vocabulary(dict):
    """Token: number; by number its hash, kind and spelling. Starts anew when full."""

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds, self.words = array("Q"), array("b"), []

    def __missing__(self, token: str) -> int:
        lower = token.lower()
        kind = _LINE if token == "\n" else _BREAK if token in ".!?:" else _NUMBER if token[0].isdigit() else _UNIT if lower in UNITS else _CAPITAL if token[0].isupper() else _PLAIN
        number = self[token] = len(self.words)
        self.hashes.append(xxhash.xxh3_64_intdigest(lower))
        self.kinds.append(kind)
        self.words.append(lower)
        return number

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Views, not copies; no word can be added while they live."""
        if not self.words:
            return np.empty(0, np.uint64), np.empty(0, np.int8)
        return np.frombuffer(self.hashes, np.uint64), np.frombuffer(self.kinds, np.int8)


class Template:
    """The tokens of some texts, one text after the other, without breaks: hashes of their canonical forms, whether each is a placeholder, numbers
    into the vocabulary, and text and place, the place of a token in its text."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        if len(vocabulary) > 500_000:
            vocabulary.clear()
            vocabulary.hashes, vocabulary.kinds, vocabulary.words = array("Q"), array("b"), []
        # Every text is closed by the end of a line.
        found = [TOKEN.findall(text) + ["\n"] for text in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        hashes, kinds = vocabulary.arrays()
        kind = kinds[numbers] if len(numbers) else np.empty(0, np.int8)
        before = np.concatenate([[_LINE], kind[:-1]])[: len(kind)]
        name = (kind == _CAPITAL) & (before > _LINE)
        number = kind == _NUMBER
        unit = (kind == _UNIT) & (before == _NUMBER)
        places = np.nonzero(kind > _LINE)[0]
        self.numbers = numbers[places]
        self.marks = (number + 2 * name + 3 * unit)[places]
        self.spelled = hashes[self.numbers] if len(places) else np.empty(0, np.uint64)
        self.form = np.where(self.marks > 0, _HASHES[self.marks], self.spelled)
        self.text = np.repeat(np.arange(len(texts)), sizes)[places]
        firsts = np.searchsorted(self.text, np.arange(len(texts)))
        self.place = np.arange(len(places)) - firsts[self.text]
        self.words = vocabulary.words
        # Lines end where a line feed stands among the breaks between two tokens.
        apart = np.diff(np.cumsum(kind == _LINE)[places]) > 0
        self.begins, self.ends = (np.concatenate(ends)[: len(places)] for ends in (([True], apart), (apart, [True])))
        self.ladders: dict[bool, list[np.ndarray]] = {}

    def _ladder(self, exact: bool, level: int) -> list[np.ndarray]:
        """Hashes of all stretches of 1, 2, 4 ... tokens."""
        ladder = self.ladders.setdefault(exact, [self.spelled if exact else self.form])
        while len(ladder) <= level:
            half = 1 << len(ladder) - 1
            ladder.append(_both(ladder[-1][:-half], ladder[-1][half:]))
        return ladder

    def windows(self, size: int, exact: bool) -> np.ndarray:
        """Hash of each window of `size` tokens, as they are spelled if exact; else of their canonical forms, and 0 where too few are plain."""
        count = len(self.form) - size + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        ladder = self._ladder(exact, size.bit_length() - 1)
        out, at = None, 0
        for level in reversed(range(size.bit_length())):
            if size >> level & 1:
                part = ladder[level][at : at + count]
                out, at = part if out is None else _both(out, part), at + (1 << level)
        out = np.maximum(_both(out, np.full(1, size + 256 * exact, np.uint64)), np.uint64(1))
        good = self.text[:count] == self.text[size - 1 :]
        if exact and size < LEAST_TOKENS:
            good &= self.begins[:count] & self.ends[size - 1 :]
        if not exact:
            plain = np.concatenate([[0], np.cumsum(self.marks == 0)])
            good &= plain[size:] - plain[:-size] >= min(LEAST_PLAIN, size)
        return np.where(good, out, np.uint64(0))

    def template(self, at: int, size: int, exact: bool) -> str:
        if exact:
            return " ".join(self.words[n] for n in self.numbers[at : at + size])
        return " ".join(("", NUMBER, NAME, UNIT)[m] or self.words[n] for m, n in zip(self.marks[at : at + size], self.numbers[at : at + size], strict=True))

    def slots(self, at: int, size: int, exact: bool) -> list[str]:
        if exact:
            return []
        return [self.words[n] for m, n in zip(self.marks[at : at + size], self.numbers[at : at + size], strict=True) if m]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_at, needed, size, exact, hash, template, item_slots of every window of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        names = ["item_id", "item_at", "needed", "size", "exact", "hash", "template", "item_slots"]
        for batch in batches:
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.string())]
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = Template([text], vocabulary)
                n = len(made.form)
                if not n:
                    continue
                if n < LEAST_TOKENS:  # as a line of its own
                    made.begins, made.ends = np.ones(n, bool), np.ones(n, bool)
                for exact, size in ((False, min(WINDOW, n)), (True, min(RUN, n)))[n < LEAST_TOKENS :]:
                    sent = [(at, digest) for at, digest in enumerate(made.windows(size, exact).astype(np.int64).tolist()) if digest]
                    needed = min(RUN - size + 1, len(sent))
                    out += [(item, at, needed, size, exact, digest, made.template(at, size, exact), made.slots(at, size, exact)) for at, digest in sent]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    rows = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, item_at long, needed long, size long, exact boolean, hash long, template string, item_slots array<string>")


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[tuple[int, bool]]) -> DataFrame:
    """doc_id, doc_at, exact, hash, template, doc_slots of the windows whose hash falls on a set bit."""

    shared = docs.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        marked = np.unpackbits(shared.value).astype(bool)
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.string())]
        for batch in pieces(batches):
            out = []
            docs = batch.column(0).to_pylist()
            made = Template(batch.column(1).to_pylist(), vocabulary)
            for size, exact in sizes:
                found = made.windows(size, exact)
                for at in np.nonzero(marked[(found & np.uint64(BITS - 1)).astype(np.int64)] & (found != 0))[0].tolist():
                    place = (docs[made.text[at]], int(made.place[at]))
                    out.append((*place, exact, int(found[at].astype(np.int64)), made.template(at, size, exact), made.slots(at, size, exact)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "doc_at", "exact", "hash", "template", "doc_slots"])

    rows = docs.where("text IS NOT NULL").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, doc_at long, exact boolean, hash long, template string, doc_slots array<string>")


def agreeing(windows: list[tuple[list[str], list[str]]], needed: int) -> tuple[int, bool]:
    """Most windows that agree on one mapping, and whether their slots differ; 0 where fewer than needed do."""
    pairs = [set(zip(ours, theirs, strict=True)) for ours, theirs in windows]
    partners = Counter(pair for p in pairs for pair in p)
    usual = {}
    for (ours, theirs), _ in sorted(partners.items(), key=lambda x: (x[1], x[0])):
        usual[ours] = theirs
    sets = [[p for p in pairs if all(a == b for a, b in p)], [p for p in pairs if all(usual[a] == b for a, b in p)]]
    # The longest stretch in which no value has two partners.
    held, first, best = Counter(), 0, (0, 0)
    theirs_of = {}
    for k, p in enumerate(pairs):
        for pair in p:
            held[pair] += 1
            theirs_of.setdefault(pair[0], set()).add(pair[1])
        while any(len(theirs_of[a]) > 1 for a, _ in p) and first < k:
            for pair in pairs[first]:
                held[pair] -= 1
                if not held[pair]:
                    theirs_of[pair[0]].discard(pair[1])
            first += 1
        if len({a for a, _ in p}) < len(p):  # at odds with itself, so in no stretch
            held, theirs_of, first = Counter(), {}, k + 1
        elif k + 1 - first > best[1] - best[0]:
            best = (first, k + 1)
    sets.append(pairs[best[0] : best[1]])
    most = max(sets, key=len)
    if len(most) < needed:
        return 0, False
    return len(most), any(a != b for p in most for a, b in p)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (most on one diagonal), reparameterised (slots differ): one row for each pair that matches."""
    items = stored(item_windows(benchmark))
    buckets = items.select(F.expr(f"hash & {BITS - 1}").alias("b")).distinct().toPandas()["b"].to_numpy()  # at most BITS numbers
    marked = np.zeros(BITS, bool)
    marked[buckets] = True
    sizes = sorted((r["size"], r["exact"]) for r in items.select("size", "exact").distinct().collect())  # at most WINDOW + RUN pairs
    found = document_windows(docs, np.packbits(marked), sizes)
    on = ["hash", "template", "exact"]
    if items.count() <= MOST_BROADCAST:
        pairs = found.join(F.broadcast(items), on)
    else:
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = found.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, [*on, "salt"])
    window = F.struct("item_at", "item_slots", "doc_slots")
    on_diagonal = pairs.groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(
        F.countDistinct(F.when(F.col("exact"), F.col("item_at"))).alias("n_exact"),
        F.max(F.when(~F.col("exact"), F.col("needed"))).alias("needed"),
        F.array_sort(F.collect_set(F.when(~F.col("exact"), window))).alias("windows"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "n", "differs"]
        for batch in batches:
            types = [batch.column(0).type, batch.column(1).type, pa.int64(), pa.bool_()]
            out = []
            for doc, item, n_exact, needed, windows in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                n, differs = agreeing([(w["item_slots"], w["doc_slots"]) for w in windows], needed or 1)
                if n or n_exact:
                    out.append((doc, item, max(n, n_exact), differs))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    item_type = benchmark.schema["item_id"].dataType.simpleString()
    right = on_diagonal.select("doc_id", "item_id", "n_exact", "needed", "windows").mapInArrow(judge, f"doc_id long, item_id {item_type}, n long, differs boolean")
    return right.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.min("differs").alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns."""
    hit = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"] == hit["doc_id"], "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Matches of the whole documents table with the whole benchmark."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
