"""Exact removal of long repeats: every byte covered by a string of LENGTH bytes that starts anywhere else too.

A family of indexes of geometric sizes, of fingerprints of sampled suffixes: no suffix array is stored, and only strings that anchors leave open are sorted. The anchor of a string of LENGTH bytes is its GRAM of least hash, so equal
strings have equal anchors, and only suffixes at anchors are indexed, about one in seventy. An entry is an anchor and a digest of its context: the
bytes of all strings in a row that have this anchor. A new batch of documents gets its entries sorted by anchor, is merge-scanned against
every level for anchors that recur, and becomes a level; two levels of one size merge into one of twice the size.

Of the anchors that recur, contexts that occur twice settle all their strings. Contexts that occur once are compared with the others of their
anchor string by string: the bytes of the contexts of one anchor meet in a task, all their strings are put in order of their
fingerprints, and neighbours are compared byte by byte. Anchors with more than MOST contexts are
too large for one task; their strings are grouped by 128-bit digests.

Defined results: null and empty texts, and texts shorter than LENGTH, lose nothing. Repeated rows repeat each other
and lose everything of LENGTH bytes or more. An empty table gives no rows. A text of n bytes takes about 80 n bytes of memory
while its anchors are found. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import drop, joined, pieces, read, stored, texts

LENGTH, GRAM = 200, 64
SPREAD = LENGTH - GRAM + 1
#: Batches that a table is taken in.
BATCHES = 3
#: Contexts of one anchor that meet in a task.
MOST = 4096
#: Bytes of contexts that are sorted together.
SORTED = 1 << 20
ORACLE_SQL = None

ENTRY = ["anchor", "high", "low"]
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint64)


def _joined(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93 * level & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` neighbours."""
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _grams(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of all stretches of the given sizes, powers of two in ascending order; no other level is kept."""
    level, size, out = _BYTES[data], 1, []
    while len(out) < len(sizes):
        if size == sizes[len(out)]:
            out.append(level)
        if len(out) < len(sizes):
            level, size = _joined(level[:-size], level[size:], size.bit_length()), 2 * size
    return out


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of LENGTH bytes or more: first and last string of each context, its anchor, and whether its own strings may equal each other."""
    grams = _grams(np.frombuffer(data, np.uint8), GRAM)[0]
    anchors = _sliding(grams, SPREAD, np.minimum)
    count = len(anchors)
    starts = np.concatenate([[0], np.nonzero(anchors[1:] != anchors[:-1])[0] + 1])
    # Long runs, of periodic text, are cut.
    if np.diff(np.append(starts, count)).max() > SPREAD:
        starts = np.concatenate([np.arange(a, b, SPREAD) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), count], strict=True)])
    lasts = np.append(starts[1:], count) - 1
    none = np.zeros(SPREAD - 1, np.uint64)
    places = np.nonzero(_sliding(np.concatenate([none, anchors, none]), SPREAD, np.maximum) == grams)[0]
    twice = np.nonzero((grams[places[1:]] == grams[places[:-1]]) & (np.diff(places) < SPREAD))[0]
    inside = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        # All contexts with a string that holds both places.
        first = np.searchsorted(starts, np.maximum(places[twice + 1] - SPREAD + 1, 0), "right") - 1
        last = np.searchsorted(starts, np.minimum(places[twice], count - 1), "right") - 1
        inside += np.bincount(first, minlength=len(inside))
        inside -= np.bincount(last + 1, minlength=len(inside))
    return starts, lasts, anchors[starts], np.cumsum(inside)[:-1] > 0


def row_of(data: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [row_of(t.encode("utf-8")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], ["doc_id", "text", "row"])

    return texts(docs).mapInArrow(run, "doc_id long, text string, row long")


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, row, first, last, anchor, high, low (digest of the context), own (its strings may equal each other) of every context."""
    names = ["doc_id", "row", "first", "last", "anchor", "high", "low", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out, sizes, ids, rows, digests = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8")
                if len(data) < LENGTH:
                    continue
                made = contexts(data)
                out.append(made)
                sizes.append(len(made[0]))
                ids.append(doc)
                rows.append(row_of(data))
                digest = xxhash.xxh3_128_digest
                digests += [digest(data[a:b]) for a, b in zip(made[0].tolist(), (made[1] + LENGTH).tolist(), strict=True)]
            if out:
                first, last, anchor, own = (np.concatenate(c) for c in zip(*out, strict=True))
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [np.repeat(ids, sizes), np.repeat(rows, sizes), first.astype(np.int32), last.astype(np.int32), anchor.view(np.int64), halves[:, 0].copy(), halves[:, 1].copy(), own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return texts(docs).mapInArrow(run, "doc_id long, row long, first int, last int, anchor long, high long, low long, own boolean")


class Family:
    """Levels of sorted entries: anchor, high, low, n (occurrences), own, at (document and place of the first occurrence)."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.recurring: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Index a batch of occurrences, and note the anchors that recur in it or between it and the levels."""
        at = F.min(F.struct("doc_id", "row", "first", "last"))
        level = stored(batch.groupBy(*ENTRY).agg(F.count("*").alias("n"), F.max("own").alias("own"), at.alias("at")).sortWithinPartitions("anchor"))
        mine = stored(level.groupBy("anchor").agg(F.count("*").alias("k"), F.max((F.col("n") > 1) | F.col("own")).alias("twice")))
        hits = mine.where("k > 1 OR twice").select("anchor")
        for _, other in self.levels:
            hits = hits.unionByName(mine.select("anchor").join(other.select("anchor").distinct(), "anchor"))
        self.recurring.append(stored(hits.distinct()))
        drop(mine)
        self.levels.append((1, level))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            merged = one.unionByName(two).groupBy(*ENTRY).agg(F.sum("n").alias("n"), F.max("own").alias("own"), F.min("at").alias("at"))
            self.levels.append((2 * size, stored(merged.sortWithinPartitions("anchor"))))
            drop(one, two)

    def matches(self) -> DataFrame:
        """The entries, over all levels, of the anchors that recur, with k: 1, or at least the number of contexts of the anchor."""
        everything, hits = self.levels[0][1], self.recurring[0]
        for _, level in self.levels[1:]:
            everything = everything.unionByName(level)
        for more in self.recurring[1:]:
            hits = hits.unionByName(more)
        context = F.struct("high", "low")
        per = everything.groupBy("anchor").agg(F.count("*").alias("rows"), (F.min(context) != F.max(context)).alias("several"))
        per = per.withColumn("k", F.when(F.col("several"), F.col("rows")).otherwise(1)).drop("several")
        per = stored(per.join(hits.distinct(), "anchor"))
        rows = joined(everything, per, ["anchor"], "rows")
        out = stored(rows.groupBy(*ENTRY).agg(F.sum("n").alias("n"), F.max("own").alias("own"), F.min("at").alias("at"), F.max("k").alias("k")))
        drop(per, *self.recurring, *(level for _, level in self.levels))
        return out


def repeated_strings(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of strings of LENGTH bytes at the given starts, which equal another: by a suffix array of their fingerprints, compared byte by byte."""
    eight, half, whole = _grams(data, 8, 64, 128)
    count = len(data) - LENGTH + 1
    prints = _joined(_joined(whole[:count], half[128 : 128 + count], 11), eight[192 : 192 + count], 12)[starts]
    del eight, half, whole
    order = np.argsort(prints, kind="stable")
    near = np.nonzero(prints[order[1:]] == prints[order[:-1]])[0]
    strings = sliding_window_view(data, LENGTH)
    same = np.zeros(len(order), bool)
    for at in range(0, len(near), 10_000):
        k = near[at : at + 10_000]
        equal = (strings[starts[order[k]]] == strings[starts[order[k + 1]]]).all(1)
        same[order[k[equal]]] = same[order[k[equal] + 1]] = True
        for left in k[~equal].tolist():  # one fingerprint of different strings: all of them are looked at
            group = order[prints[order] == prints[order[left]]]
            met: dict[bytes, int] = {}
            for g in group.tolist():
                said = strings[starts[g]].tobytes()
                if said in met:
                    same[g] = same[met[said]] = True
                met.setdefault(said, g)
    return same


def intervals(doc, row, starts: np.ndarray) -> Iterator[tuple]:
    """doc, row, start, end of the bytes that strings at ascending starts cover."""
    if len(starts):
        cuts = np.nonzero(np.diff(starts) > LENGTH)[0]
        for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(starts) - 1], strict=True):
            yield doc, row, int(starts[a]), int(starts[b]) + LENGTH


SPAN = "doc_id long, row long, start int, end int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "row", "start", "end"])


def compared(found: DataFrame) -> DataFrame:
    """SPAN of the bytes that strings of the contexts cover which equal another string of their anchor; found: anchor, doc_id, row, first, data, open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close(rows: list[tuple]) -> list[tuple]:
            ends = np.cumsum([len(r[4]) for r in rows])
            begins = ends - [len(r[4]) for r in rows]
            counts = ends - begins - LENGTH + 1
            starts = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            same = repeated_strings(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), starts)
            out, at = [], 0
            for (_, doc, row, first, _, is_open), n in zip(rows, counts.tolist(), strict=True):
                if is_open:
                    out += intervals(doc, row, np.nonzero(same[at : at + n])[0] + first)
                at += n
            return out

        size = 0
        for batch in pieces(batches, 4):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Anchors are not torn apart; small ones are sorted together.
                if size > SORTED and row[0] != held[-1][0]:
                    yield _spans(close(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield _spans(close(held))

    ordered = found.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.select("anchor", "doc_id", "row", "first", "data", "open").mapInArrow(run, SPAN)


def counted(found: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: their strings are counted by digest."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "start", "open", "high", "low"]
        for batch in pieces(batches, 3, 1 << 18):
            ids, rows, starts, opens, digests = [], [], [], [], []
            for doc, row, first, data, is_open in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - LENGTH + 1
                ids += [doc] * n
                rows += [row] * n
                starts += range(first, first + n)
                opens += [is_open] * n
                digests += [xxhash.xxh3_128_digest(data[k : k + LENGTH]) for k in range(n)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(opens, pa.bool_()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names)

    made = stored(found.select("doc_id", "row", "first", "data", "open").mapInArrow(strings, "doc_id long, row long, start int, open boolean, high long, low long"))
    twice = made.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 AND open").drop("open")
    twice = stored(twice)
    out = stored(joined(made.where("open"), twice, ["high", "low"], "n").select("doc_id", "row", "start", (F.col("start") + LENGTH).alias("end")))
    drop(made, twice)
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """SPAN of all bytes to remove; spans of one text may overlap."""
    found = occurrences(docs).withColumn("batch", F.pmod(F.col("row"), F.lit(BATCHES)).cast("int"))
    found = stored(found)
    family = Family()
    for k in range(BATCHES):
        family.add(found.where(F.col("batch") == k).drop("batch"))
    entries = family.matches()
    settled = stored(entries.where("n > 1").select("high", "low", "n"))
    whole = stored(joined(found, settled, ["high", "low"], "n").select("doc_id", "row", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")))
    drop(found, settled)
    # Contexts that occur once, and what they are compared with.
    undecided = entries.groupBy("anchor").agg(F.count("*").alias("rows"), F.bool_or((F.col("n") == 1) & ((F.col("k") > 1) | F.col("own"))).alias("open")).where("open")
    undecided = stored(undecided.drop("open"))
    wanted = joined(entries, undecided, ["anchor"], "rows").select("anchor", "at.*", (F.col("n") == 1).alias("open"), (F.col("k") > MOST).alias("large"))
    places = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "first", "last", "open", "large")).alias("places"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()]
        for batch in pieces(batches, 2, 1 << 20):
            out = []
            for doc, row, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8")
                out += [(p["anchor"], doc, row, p["first"], data[p["first"] : p["last"] + LENGTH], p["open"], p["large"]) for p in asked]
            names = ["anchor", "doc_id", "row", "first", "data", "open", "large"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    # Rows of one doc_id and text are one here: their contexts occur twice and are not open.
    sources = keyed(docs).join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places").dropDuplicates(["doc_id", "row"])
    bytes_of = stored(sources.mapInArrow(cut_out, "anchor long, doc_id long, row long, first int, data binary, open boolean, large boolean"))
    drop(entries, undecided)
    by_anchor = stored(compared(bytes_of.where("NOT large")))
    by_digest = counted(bytes_of.where("large"))
    drop(bytes_of)
    return whole.unionByName(by_anchor).unionByName(by_digest)


def shortened(docs: DataFrame) -> DataFrame:
    """doc_id, kept binary, n_bytes, n_removed, n_spans of every document."""
    spans = repeats(docs).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
        for batch in pieces(batches):
            out = []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8")
                kept, at, n = [], 0, 0
                for start, end in sorted((s["start"], s["end"]) for s in found or []):
                    if start > at or not n:
                        kept.append(data[at:start])
                        n += 1
                    at = max(at, end)
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc, left, len(data), len(data) - len(left), n))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    both = keyed(docs).join(spans, ["doc_id", "row"], "left")
    return both.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op6_long_repeats(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    out = shortened(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
