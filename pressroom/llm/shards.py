"""Sharding: contiguous shards of nearly equal bytes, cut from global prefix sums.

Documents stand in the order of doc_id, then size and checksum. What a partition holds in all is summed over the partitions
before it; the sums within the partition give every document the number of bytes before it, and it goes to the shard in whose
equal share of all bytes its middle lies. A shard thus differs from its share by half the documents at its two ends at most.
Law `bytes`: how near to equal sizes come is what counts, so equal texts are kept together by no rule.

Everything is a built-in expression, and only doc_id, size and checksum are shuffled; `write` alone moves the texts.

Defined results: a null text has no bytes, so size 8 and checksum 0, as has an empty one. Repeated rows each have a place, one after the other. A document larger than a
share leaves the shards within its bytes empty, and slots of the others stay gapless. Very long texts are counted whole. An empty table gives no rows. Rows of a
null doc_id come first. Columns beyond doc_id and text are not read, whatever their names; `write` keeps them, but not if they are named shard or slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.common import CRC32_SQL, read, stored
from pressroom.ordered import running

SHARDS = 24
#: Bytes counted for a document besides its text.
FRAME = 8


def _measured(docs: DataFrame) -> list[Column]:
    """doc_id, size, text_crc32."""
    text = F.encode(F.coalesce(docs["text"], F.lit("")), "utf-8")
    return [docs["doc_id"].alias("doc_id"), (F.octet_length(text) + F.lit(FRAME)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... within the shard) of every row of docs."""
    placed = running(docs.select(*_measured(docs)), ["doc_id", "size", "text_crc32"], before=F.col("size"), row=F.lit(1))
    total = placed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    # Twice the place of a document's middle; decimals, as products of large totals pass 64 bits.
    middle = F.expr(f"CAST(2 * before + size AS DECIMAL(20, 0)) * {shards} DIV {2 * total}BD")
    cut_up = stored(placed.withColumn("shard", F.least(middle.cast("int"), F.lit(shards - 1))))
    first = cut_up.groupBy("shard").agg(F.min("row").alias("first_row"))
    slot = (F.col("row") - F.col("first_row")).alias("slot")
    # One row for each shard.
    return cut_up.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", slot)


def write(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """docs as Parquet in folder/shard=0, 1 ..., one file each, in the order of a column slot; repeated rows take their places among each other as they come.

    A shard is one task's work, as it is one file, so choose their number by the size a file should have.
    """
    key = ["doc_id", "size", "text_crc32"]
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))).alias("copy")
    known = assign(docs, shards).select(*key, "shard", "slot", copy)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_measured(docs)).select("*", copy)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*key, "copy")]
    joined = rows.alias("r").join(known.alias("k"), same).select("r.row.*", "k.shard", "k.slot")
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def read_shard(spark: SparkSession, folder: str, shard: int) -> DataFrame:
    """The documents of one shard, in order."""
    return spark.read.parquet(folder).where(F.col("shard") == shard).orderBy("slot")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table in 24 shards under the law `bytes`."""
    out = assign(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same in SQL.
ORACLE_SQL = f"""WITH {CRC32_SQL.format(key="doc_id, row_number() OVER () AS tie", text="coalesce(text, '')", source="documents")},
  sized AS (SELECT doc_id, octet_length(b) + {FRAME} AS size, crc AS text_crc32, tie FROM checked),
  placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM sized),
  sharded AS (SELECT *, CAST(least((2 * before + size) * {SHARDS} // (2 * total), {SHARDS - 1}) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before, tie) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM sharded"""
