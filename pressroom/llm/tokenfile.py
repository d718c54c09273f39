"""Token-ID files: fixed-size id blocks, bit-plane shuffled, each plane compressed by zstandard.

A file set is two tables in one folder. `blocks`: shard, block, count and planes, the BLOCK ids of a block
cut into their 32 bit planes (plane k holds bit k of every id, eight to a byte), each
plane compressed alone, and the documents with ids in the block: doc_ids, positions in the shard, lengths. `index`, the
chunk index: shard, block, first document, count and bytes of the planes. Shards are ranges of doc_id in ascending
order; the blocks of a shard follow one another. Texts are shuffled once, ids never.

Defined results: a null or empty text has only the end id. Repeated doc_ids are kept, in the order of a hash of their texts. An empty
table gives empty files. A very long text runs on through as many blocks as it needs. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressroom.llm.bpe import Words
from pressroom.llm.common import pieces, read, shared_dir, texts

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK = 65_536
#: Distinct words that a worker remembers in each of two generations.
CACHE_WORDS = 400_000
#: Words that the tokenizer is given in one string.
TOGETHER = 1000
ORACLE_SQL = None

_loaded: dict[str, Words] = {}


def encoder(name: str) -> Words:
    """The worker's memory of words and their ids, kept from task to task."""
    if name not in _loaded:
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = tokenizer.get_vocab(True)
        # Byte-level tokens are spelled with one character for each byte.
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            sizes[number] = len(token)
        ids_of = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # noqa: E731  no offsets

        def many(texts: list[str]) -> list[bytes]:
            """Words that begin with white space are encoded in one string and told apart by the bytes their ids stand for."""
            out: list[bytes] = []
            for at in range(0, len(texts), TOGETHER):
                some = texts[at : at + TOGETHER]
                if all(text[:1] in (" ", "\n") for text in some):
                    ids = ids_of("".join(some))
                    ends = np.cumsum([len(text.encode("utf-8")) for text in some])
                    reached = np.cumsum(sizes[ids])
                    stops = np.searchsorted(reached, ends)
                    if len(ids) and stops[-1] == len(ids) - 1 and (reached[stops] == ends).all():
                        packed, start = ids.tobytes(), 0
                        for stop in (4 * stops + 4).tolist():
                            out.append(packed[start:stop])
                            start = stop
                        continue
                out += [ids_of(text).tobytes() for text in some]
            return out

        _loaded[name] = Words(many, CACHE_WORDS)
    return _loaded[name]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids binary (little-endian unsigned 32-bit, the end id last)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in pieces(batches):
            ids = [found + end for found in words.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def _transposed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number as 8 rows of 8 bits, rows and columns swapped: three rounds of exchanges of bits, then pairs, then fours."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        swapped = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ swapped ^ (swapped << np.uint64(shift))
    return x


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The 32 planes of a block, compressed; ids below 65536 leave the upper half empty, which is not transposed."""
    width, rows = 2 if len(ids) and int(ids.max()) < 1 << 16 else 4, -(-len(ids) // 8)
    parts = np.zeros((8 * rows, width), np.uint8)
    parts[: len(ids)] = np.ascontiguousarray(ids, f"<u{width}").view(np.uint8).reshape(-1, width)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = [np.ascontiguousarray(_transposed(np.ascontiguousarray(part).view("<u8")).view(np.uint8).reshape(-1, 8).T) for part in parts.T]
    return [squeeze(plane.tobytes()) for eight in planes for plane in eight] + [squeeze(bytes(rows))] * (32 - 8 * width)


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    rows = -(-count // 8)
    width = 2 if len(set(planes[16:])) == 1 and not any(expand(planes[16])) else 4
    out = np.zeros((8 * rows, 4), np.uint8)
    for k in range(width):
        eight = np.frombuffer(b"".join(map(expand, planes[8 * k : 8 * k + 8])), np.uint8).reshape(8, rows)
        out[:, k] = _transposed(np.ascontiguousarray(eight.T).view("<u8").ravel()).view(np.uint8)
    return out.view("<u4").ravel()[:count]


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode the texts of docs and write the two tables of a file set."""
    ranged = texts(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held, size, block, at = [], 0, 0, 0
        names = ["shard", "block", "count", "planes", "doc_ids", "positions", "lengths"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        entries: list[tuple[int, int, int]] = []

        def flush(count: int):
            nonlocal held, size, block, entries
            data = b"".join(held)
            head, rest = data[: 4 * count], data[4 * count :]
            held, size = [rest], len(rest) // 4
            columns = [[shard], [block], [count], [to_planes(np.frombuffer(head, "<u4"))], *([[e[k] for e in entries]] for k in range(3))]
            entries = entries[-1:] if rest else []  # the last document goes on in the next block
            block += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        words, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                entries.append((doc, at, len(ids) // 4))
                held.append(ids)
                size += len(ids) // 4
                at += len(ids) // 4
                while size >= BLOCK:
                    yield flush(BLOCK)
        if size:
            yield flush(size)

    schema = "shard int, block long, count int, planes array<binary>, doc_ids array<long>, positions array<long>, lengths array<long>"
    ranged.mapInArrow(run, schema).write.parquet(f"{folder}/blocks")
    blocks = docs.sparkSession.read.parquet(f"{folder}/blocks")
    sizes = F.transform("planes", lambda p: F.octet_length(p))
    blocks.select("shard", "block", F.get("doc_ids", 0).alias("first_doc"), "count", sizes.alias("plane_bytes")).write.parquet(f"{folder}/index")


def joined_crc(first: int, second: int, size: int) -> int:
    """crc32 of two stretches in a row from their own, the second of `size` bytes: `size` zero bytes are run through the first."""
    square = [0xEDB88320, *(1 << k for k in range(31))]  # what one zero bit does to each bit of a crc

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
            if not vector:
                break
        return out

    bits = 8 * size
    while bits:
        if bits & 1:
            first = times(square, first)
        bits >>= 1
        square = [times(square, row) for row in square] if bits else square
    return first ^ second


def read_documents(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone: blocks are read where they lie, only pieces' checksums travel."""
    blocks, index = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/index")
    totals = index.groupBy("shard").agg(F.sum("count").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row for each shard
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "doc_id", "position", "n_tokens", "size", "crc"]
        types = [pa.int32(), *[pa.int64()] * 6]
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, base = from_planes(row["planes"], row["count"]), row["block"] * BLOCK
                for doc, position, length in zip(row["doc_ids"], row["positions"], row["lengths"], strict=True):
                    part = ids[max(0, position - base) : position + length - base]
                    out.append((row["shard"], row["block"], doc, position, length, part.nbytes, zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(3)
            starts, fields = parts.offsets.to_numpy(), parts.values.flatten()
            sizes, crcs = fields[1].to_numpy(), fields[2].to_numpy()
            found = crcs[starts[:-1]].copy()
            for row in np.nonzero(np.diff(starts) > 1)[0].tolist():
                crc = int(found[row])
                for at in range(starts[row] + 1, starts[row + 1]):
                    crc = joined_crc(crc, int(crcs[at]), int(sizes[at]))
                found[row] = crc
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    made = blocks.select("shard", "block", "count", "planes", "doc_ids", "positions", "lengths")
    made = made.mapInArrow(pieces_of, "shard int, block long, doc_id long, position long, n_tokens long, size long, crc long")
    parts = F.sort_array(F.collect_list(F.struct("block", "size", "crc"))).alias("parts")  # as many as a text has blocks
    docs = made.groupBy("shard", "position", "doc_id", "n_tokens").agg(parts).join(F.broadcast(bases), "shard")
    docs = docs.select("doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "parts")
    return docs.mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_file(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table, read back from the files."""
    folder = shared_dir(spark)
    write(read(spark, sf_dir, "documents"), folder)
    return read_documents(spark, folder)
