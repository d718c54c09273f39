"""Substring deduplication by content-defined chunks.

A gear rolling hash over GRAM bytes cuts each text where it is the least of REACH places, so an insertion moves only the cuts
beside it, and two copies of a passage of LEAST_RUN bytes have a cut in common with SEED bytes behind it. These are seeds: a seed that
occurred before, in order of doc_id and place, is laid on its first occurrence, and runs of seeds on one diagonal are extended
byte by byte to both sides. Spans of LEAST_RUN bytes or more are removed, shorter ones, which common phrases make, stay.

Seeds are compared with their first occurrence only: a passage all of whose seeds occurred still earlier within other, shorter
repeats stays.

A chunk is taken to be SEED bytes long at most, so its digest is that of a seed; what lies between it and the next cut has no digest of its own and is found by extension.

Defined results: null and empty texts have no chunks and stay as they are. Rows of equal doc_id and text are one document, its first occurrence and not a repeat of itself; of
equal seeds the one of the least (doc_id, hash of the text, place) is the first. Very long texts are chunked whole. An empty table gives no rows. Removed spans
are byte offsets. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import drop, pieces, read, stored, texts

GRAM, SEED, LEAST_RUN = 32, 64, 160
#: In so many places lies a cut, so that LEAST_RUN bytes hold a whole seed.
REACH = LEAST_RUN - SEED + 1
#: Copies of a source's surroundings: one for so many occurrences of its seed.
PER_COPY = 1000
ORACLE_SQL = None

#: Random numbers of the byte values, from a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint32)


def _over(values: np.ndarray, best) -> np.ndarray:
    """The best of each REACH values in a row."""
    width = 1
    while 2 * width <= REACH:
        values = best(values[:-width], values[width:])
        width *= 2
    rest = REACH - width
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    size = len(data)
    if size < GRAM + REACH:
        return [size]
    rolled = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = rolled[:-step] << np.uint32(step)
        rolled = rolled.copy()
        rolled[step:] += shifted
    rolled = rolled[GRAM - 1 :]
    least = _over(rolled, np.minimum)
    none = np.zeros(REACH - 1, np.uint32)
    found = np.nonzero(_over(np.concatenate([none, least, none]), np.maximum) == rolled)[0]
    out, last, before = [], -REACH, None
    for at, value in zip(found.tolist(), rolled[found].tolist(), strict=True):
        # Equal values close by are periods of one text.
        if at and (value != before or at - last >= REACH // 2):
            out.append(at)
            last, before = at, value
    return [*out, size]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [_row(t.encode("utf-8")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], ["doc_id", "text", "row"])

    return texts(docs).mapInArrow(run, "doc_id long, text string, row long")


def _row(data: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def seeds(docs: DataFrame) -> DataFrame:
    """doc_id, row, at, high, low (digest) of the SEED bytes behind every cut, and of a text's first and last ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8")
                if len(data) < LEAST_RUN:
                    continue
                last = len(data) - SEED
                places = [0, *(at for at in cuts(data) if at < last), last]
                digests = [xxhash.xxh3_128_intdigest(data[at : at + SEED]) for at in places]
                columns[0] += [doc] * len(places)
                columns[1] += [_row(data)] * len(places)
                columns[2] += places
                columns[3] += [_signed(d >> 64) for d in digests]
                columns[4] += [_signed(d & 0xFFFFFFFFFFFFFFFF) for d in digests]
                if len(columns[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                    columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names, types = ["doc_id", "row", "at", "high", "low"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return texts(docs).mapInArrow(run, "doc_id long, row long, at int, high long, low long")


def surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """f_doc, f_row, f_at, n, before, after: up to LEAST_RUN bytes on the asked sides (left, right) of the seeds at the wanted places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("f_doc", pa.int64()), ("f_row", pa.int64()), ("f_at", pa.int32()), ("n", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
        for batch in pieces(batches, 2):
            out = []
            for doc, row, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode("utf-8")
                for p in places:
                    at = p["f_at"]
                    before, after = data[max(0, at - LEAST_RUN) : at] if p["left"] else None, data[at + SEED : at + SEED + LEAST_RUN] if p["right"] else None
                    out.append((doc, row, at, p["n"], before, after))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    places = wanted.groupBy(F.col("f_doc").alias("doc_id"), F.col("f_row").alias("row")).agg(F.collect_list(F.struct("f_at", "n", "left", "right")).alias("places"))
    both = keyed(docs).join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places").dropDuplicates(["doc_id", "row"])
    return both.mapInArrow(run, "f_doc long, f_row long, f_at int, n long, before binary, after binary")


def extended(data: bytes, edges) -> list[dict]:
    """Spans to remove: runs of seeds from left to right edge, extended as far as their first occurrences agree."""
    spans = []
    start = None
    for edge in sorted(edges, key=lambda e: e["at"]):
        at = edge["at"]
        if edge["left"]:
            start, before = at, edge["before"]
            k = 0
            while k < min(len(before), at) and before[-1 - k] == data[at - 1 - k]:
                k += 1
            start -= k
        if edge["right"]:
            end, after = at + SEED, edge["after"]
            k = 0
            while k < min(len(after), len(data) - end) and after[k] == data[end + k]:
                k += 1
            end += k
            if end - start >= LEAST_RUN:
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["at"] = min(start, spans[-1]["at"])
                    spans[-1]["end"] = max(end, spans[-1]["end"])
                else:
                    spans.append({"at": start, "end": end})
                while len(spans) > 1 and spans[-1]["at"] <= spans[-2]["end"]:
                    last = spans.pop()
                    spans[-1] = {"at": min(spans[-1]["at"], last["at"]), "end": max(spans[-1]["end"], last["end"])}
    return spans


def seed_runs(docs: DataFrame) -> DataFrame:
    """doc_id, row, edges: the ends of the runs of repeated seeds of each document, with the bytes around their first occurrences."""
    placed = seeds(docs)
    place = F.struct("doc_id", "row", "at")
    firsts = placed.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = stored(firsts)
    found = placed.join(firsts, ["high", "low"]).where(place > F.col("first"))
    found = found.select("doc_id", "row", "at", F.col("first.doc_id").alias("f_doc"), F.col("first.row").alias("f_row"), F.col("first.at").alias("f_at"), "n").distinct()
    # Seeds that touch on one diagonal are a run; only its edges need bytes of the first occurrence.
    order = Window.partitionBy("doc_id", "row").orderBy("at")
    near = [F.col("at") - F.col("f_at"), F.col("f_doc"), F.col("f_row")]
    same = lambda step: F.coalesce(
        (F.abs(step("at", order) - F.col("at")) <= SEED) & (step("diagonal", order) == F.col("diagonal")), F.lit(False)
    )
    found = found.withColumn("diagonal", F.struct(*near))
    found = found.withColumn("left", ~same(lambda c, w: F.lag(c).over(w))).withColumn("right", ~same(lambda c, w: F.lead(c).over(w)))
    edges = stored(found.where("left OR right").drop("diagonal"))
    drop(firsts)
    copies = F.ceil(F.col("n") / PER_COPY)
    asked = edges.groupBy("f_doc", "f_row", "f_at", "n").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    sources = stored(surroundings(docs, asked))
    sources = sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n")
    known = edges.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "at"), copies)).join(sources, ["f_doc", "f_row", "f_at", "salt"])
    edge = F.struct("at", "left", "right", F.when(F.col("left"), F.col("before")).alias("before"), F.when(F.col("right"), F.col("after")).alias("after"))
    return known.groupBy("doc_id", "row").agg(F.collect_list(edge).alias("edges"))


def shortened(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_bytes, spans array<struct<at, end>> (the bytes to remove), kept binary of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32())]))
        for batch in pieces(batches, 2):
            sizes, spans, kept = [], [], []
            for text, edges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = text.encode("utf-8")
                sizes.append(len(data))
                spans.append(extended(data, edges) if edges else [])
                kept.append(kept_bytes(data, spans[-1]))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_bytes", "spans", "kept"])

    both = keyed(docs).join(seed_runs(docs), ["doc_id", "row"], "left").select("doc_id", "row", "text", "edges")
    return both.mapInArrow(run, "doc_id long, row long, n_bytes long, spans array<struct<at:int,end:int>>, kept binary")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row, spans of the documents that lose something."""
    return shortened(docs).where(F.size("spans") > 0).select("doc_id", "row", "spans").dropDuplicates(["doc_id", "row"])


def kept_bytes(data: bytes, spans) -> bytes:
    at, out = 0, []
    for span in spans:
        out.append(data[at : span["at"]])
        at = span["end"]
    return b"".join(out) + data[at:]


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document of the whole table: bytes, removed bytes and spans, and the digest of what is left."""
    out = shortened(read(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return out.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
