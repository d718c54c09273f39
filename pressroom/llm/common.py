"""Reading the given tables, and intermediate tables in the folder the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.lineage import cut, drop, release, shared_dir

__all__ = ["CRC32_SQL", "drop", "joined", "pieces", "read", "shared_dir", "stored", "texts"]

#: Unsigned CRC-32 of a text's UTF-8 bytes in SQL, for the oracles: tables crc_table and checked (key, b: the bytes, crc).
CRC32_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
  raw_bytes AS (SELECT {key}, encode({text}) AS b FROM {source}),
  checked AS (SELECT * EXCLUDE (t), xor(list_reduce(list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc
    FROM raw_bytes, crc_table)"""


def stored(df: DataFrame) -> DataFrame:
    """cut() for the large tables of this package: the shuffle files behind it go at once."""
    out = cut(df)
    release(df.sparkSession)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else the table holds stays unread."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `most` bytes in a text or binary column, one row at least, so that a worker's memory stays small."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: A key is hot if it holds one in so many rows; there are no more hot keys than that.
HOT = 2000


def joined(rows: DataFrame, keyed: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows inner joined with keyed, which has one row for each key and, in `count`, the number of rows that hold it.

    Hot keys, HOT at most, are broadcast, so that rows that share one stay where they are; only the others are shuffled.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = keyed.where(F.col(count) * HOT >= total).drop(count)
    rest = keyed.where(F.col(count) * HOT < total).drop(count)
    known = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    columns = [c for c in rows.columns if c not in on]
    cold = known.where("_hot IS NULL").select(*on, *columns).join(rest, on)
    return known.where("_hot").drop("_hot").unionByName(cold)
