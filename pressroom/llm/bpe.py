"""Byte-level BPE over a ranked vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is
itself an entry; any other pre-token is merged, lowest rank first and leftmost among
equals, with a heap of candidate pairs over a doubly linked list of its bytes, in
O(n log n) for n bytes. Every worker remembers the words it has met, so that the tiers run once for each.

Defined results: a null or empty text has no ids and decodes to no bytes. Ids outside
the vocabulary raise when decoded. Repeated rows are encoded one by one, an empty table gives no rows, and pairs of one rank are merged from the
left. Very long texts are encoded whole, few at a time; a word of n bytes takes O(n log n). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.llm.common import pieces, read, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct words that a worker remembers in each of two generations.
CACHE_WORDS = 250_000
#: Documents decoded at once.
DECODE_ROWS = 500
#: Average keys in a bucket of the perfect hash.
BUCKET_KEYS = 2


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _slot(high: int, low: int, step: int, size: int) -> int:
    """Mixed before the remainder: a plain progression would only visit a few slots where low and size share factors."""
    return (((high + step * low) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 24) % size


class PerfectHash:
    """Minimal perfect hash by displacement.

    Buckets, largest first, each try steps until their keys fall on free slots; a bucket of one key
    takes any slot left and keeps it, negative, in place of its step.
    """

    def __init__(self, keys: list[bytes]):
        size = max(1, len(keys))
        self.keys, self.size, self.buckets = keys, size, max(1, size // BUCKET_KEYS)
        self.steps, self.slots = [0] * self.buckets, [-1] * size
        grouped: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for place, key in enumerate(keys):
            bucket, high, low = self._hashes(key)
            grouped[bucket].append((high, low, place))
        slots = self.slots
        free: list[int] = []
        for bucket in sorted(range(self.buckets), key=lambda b: -len(grouped[b])):
            members = grouped[bucket]
            if len(members) == 1:
                free = free or [slot for slot in range(size) if slots[slot] < 0]
                slot = free.pop()
                slots[slot], self.steps[bucket] = members[0][2], -1 - slot
                continue
            step = 0
            while members:
                step += 1
                tried = {_slot(high, low, step, size) for high, low, _ in members}
                if len(tried) == len(members) and all(slots[s] < 0 for s in tried):
                    break
            for high, low, place in members:
                slots[_slot(high, low, step, size)] = place
            self.steps[bucket] = step

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        """Bucket, first slot and step width, from separate bits: were they related, keys of a bucket might never part."""
        digest = xxhash.xxh3_128_intdigest(key)
        return (digest >> 64) % self.buckets, digest & 0xFFFFFFFF, digest >> 32 & 0xFFFFFFFF | 1

    def find(self, key: bytes) -> int:
        """The key's place in the list the hash was built from, or -1."""
        bucket, high, low = self._hashes(key)
        step = self.steps[bucket]
        place = self.slots[-1 - step if step < 0 else _slot(high, low, step, self.size)]
        return place if place >= 0 and self.keys[place] == key else -1


class Words:
    """Ids, as packed unsigned 32-bit numbers, of texts by their words, each distinct word encoded once while it is remembered.

    No pre-token crosses a single white space between two other characters, so the words of a text with no other white space are
    encoded apart; other texts are encoded whole. Two generations are kept: a word met again
    moves to the younger one, and when that is full, the elder one, which holds words not met since, is dropped.
    """

    def __init__(self, encode_many, most: int):
        self.encode_many, self.most = encode_many, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        split = [spaced(text) for text in texts]
        young, old = self.young, self.old
        met = set(chain.from_iterable(filter(None, split)))
        # Sets less dictionaries would go through all words remembered, not through those met.
        met = [word for word in met if word not in young]
        again = [word for word in met if word in old]
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        new = [word for word in met if word not in old]
        if new:
            young.update(zip(new, self.encode_many([word if word[:1] == "\n" else " " + word for word in new]), strict=True))
        # First words and whole texts stand for themselves.
        alone = self.encode_many([words[0] if words else text for words, text in zip(split, texts, strict=True)])
        get = young.__getitem__
        return [head + b"".join(map(get, islice(words, 1, None))) if words else head for words, head in zip(split, alone, strict=True)]


def spaced(text: str) -> list[str] | None:
    """The words of a text whose only white space is single blanks and line feeds between others, a feed staying before its word; else None."""
    words = text.split()
    gaps = len(words) - 1
    if gaps < 0 or len(text) - len("".join(words)) != gaps:
        return None
    feeds = text.count("\n")
    if text.count(" ") + feeds != gaps:
        return None
    return text.replace("\n", " \n").split(" ") if feeds else words


class Encoder:
    """Ids of pre-tokens; built on the driver and broadcast: its size is the vocabulary's. Workers keep their words in it from task to task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.tokens = list(ranks)
        self.ids = [ranks[token] for token in self.tokens]
        self.vocabulary = PerfectHash(self.tokens)
        self.bytes = [self.rank(bytes([b])) for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.words = Words(self.many, CACHE_WORDS)
        self.text_of = dict(zip(self.ids, self.tokens, strict=True))
        # Rank of every token by the ids of any two parts that make it up: parts without an entry do not merge.
        self.pairs = {
            ranks[token[:k]] << 32 | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }

    def __getstate__(self):
        return {name: value for name, value in self.__dict__.items() if name != "words"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = Words(self.many, CACHE_WORDS)

    def rank(self, token: bytes) -> int:
        place = self.vocabulary.find(token)
        return self.ids[place] if place >= 0 else -1

    def merge(self, token: bytes) -> list[int]:
        """Merge the bytes of a pre-token, always the pair of the lowest rank, the leftmost first."""
        table = self.bytes
        parts = [table[b] for b in token]  # at a part's first byte its id; -1 once it is merged away
        size = len(parts)
        known = self.pairs.get
        heap = []
        left = parts[0]
        for start in range(1, size):
            right = parts[start]
            pair = left << 32 | right
            rank = known(pair)
            if rank is not None:
                heap.append((rank, start - 1, pair))
            left = right
        if not heap:
            return parts
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heapify(heap)
        while heap:
            rank, start, pair = heappop(heap)
            middle = after[start]
            if middle >= size or parts[start] << 32 | parts[middle] != pair:
                continue  # one of the two parts has changed since
            parts[start], parts[middle] = rank, -1
            stop = after[start] = after[middle]
            if stop < size:
                before[stop] = start
                pair = rank << 32 | parts[stop]
                new = known(pair)
                if new is not None:
                    heappush(heap, (new, start, pair))
            if start:
                left = before[start]
                pair = parts[left] << 32 | rank
                new = known(pair)
                if new is not None:
                    heappush(heap, (new, left, pair))
        return [part for part in parts if part >= 0]

    def text(self, text: str) -> list[int]:
        """Ids of a stretch of text, pre-token by pre-token: first tier, then second."""
        out = []
        for token in self.pattern.findall(text):
            raw = token.encode("utf-8")
            found = self.rank(raw)
            if found >= 0:
                out.append(found)
            else:
                out += self.merge(raw)
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.text(text)).tobytes() for text in texts]


_built: dict[str, Encoder] = {}


def built_encoder(name: str) -> Encoder:
    if name not in _built:
        _built[name] = Encoder(load_ranks(public_tokenizers.path(name)))
    return _built[name]


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and ids array<int> of every document's whole text; no shuffle."""

    shared = docs.sparkSession.sparkContext.broadcast(built_encoder(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in pieces(batches):
            packed = encoder.words.encode(batch.column(1).to_pylist())
            offsets = np.zeros(len(packed) + 1, "<i4")
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return texts(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The rows of encode() with column decoded binary added: the bytes that the ids stand for."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    place = encoded.columns.index("ids")
    shared = encoded.sparkSession.sparkContext.broadcast(built_encoder(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.text_of.__getitem__
        for batch in (batch.slice(at, DECODE_ROWS) for batch in batches for at in range(0, batch.num_rows, DECODE_ROWS)):
            column = batch.column(place)
            flat = column.flatten().to_numpy().tolist()
            lengths = np.diff(column.offsets.to_numpy()).tolist()
            out, at = [], 0
            for length in lengths:
                out.append(b"".join(map(table, flat[at : at + length])))
                at += length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's digests of encode() and decode() over the whole documents table."""
    both = decode(encode(read(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
