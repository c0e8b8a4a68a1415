"""Sharding: a keyed Feistel permutation of global row numbers gives every row its shard and slot."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import kept, shuffle_parts

ROUNDS = 6
_LOW = np.uint64(0xFFFFFFFF)


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (half * np.uint64(0x9E3779B1) + np.uint64(key)) & _LOW
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(0x85EBCA6B)) & _LOW
    x ^= x >> np.uint64(13)
    return x & mask


def _keys(seed: int) -> list[int]:
    return [(seed * 0x27D4EB2F + (r + 1) * 0x165667B1) & 0xFFFFFFFF for r in range(ROUNDS)]


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _round(left, key, mask), left
        else:
            left, right = right, left ^ _round(right, key, mask)
    return (left << shift) | right


def permuted(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Where the permutation of 0..n-1 sends each number, or with ``back`` where it comes from.

    A balanced Feistel network permutes the least even power of two that holds n, at most 4 n;
    numbers that land outside are sent on until they land inside (cycle walking).
    """
    bits = max(1, -(-max(1, int(n) - 1).bit_length() // 2))
    if bits > 31:
        raise ValueError("more than 2^62 rows")
    keys, out = _keys(seed), _once(x.astype(np.uint64), bits, _keys(seed), back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _once(out[outside], bits, keys, back)
    return out.astype(np.int64)


def place(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers, computable without any table."""
    at = permuted(row, n, seed)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The row number at (shard, slot): the inverse of ``place``."""
    return permuted(slot * shards + shard, n, seed, back=True)


def row_numbers(rows: DataFrame, order: Sequence[str], out: str = "row") -> DataFrame:
    """Gapless global numbers from 0 in the given order (nulls first); equal rows in any order.

    Equal rows are counted before they are dealt by range, so no task gets more than distinct
    rows of its range; the offsets come from one total per task.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in order]
    distinct = rows.groupBy(*order, *rest).agg(F.count(F.lit(1)).alias("__c"))
    ranged = distinct.repartitionByRange(shuffle_parts(spark), *order, *rest).sortWithinPartitions(*order, *rest)
    ranged = kept(ranged.withColumn("__p", F.spark_partition_id())
                  .withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "rows")
    totals = ranged.groupBy("__p").agg(F.sum("__c").alias("__t"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__p", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__p").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__o") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    numbered = ranged.join(totals, "__p").withColumn("__f", first)
    return (numbered.withColumn(out, F.explode(F.sequence("__f", F.col("__f") + F.col("__c") - 1)))
            .drop("__c", "__p", "__k", "__o", "__f"))


def text_size(text: str | Column = "text") -> Column:
    """UTF-8 bytes of the text, none for null, plus one."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def assign(rows: DataFrame, order: Sequence[str], shards: int = 16, seed: int = 42) -> DataFrame:
    """Add (row, shard, slot): law ``rows``, a reproducible shuffle into shards of counts at most one apart.

    The permuted number p of a row gives shard p mod ``shards`` and slot p div ``shards``, gapless
    from 0. The result depends on the rows' order, their number, ``shards`` and ``seed`` alone.
    An empty table gives no rows. Columns row, shard and slot of the input are replaced.
    """
    rows = rows.drop("row", "shard", "slot")
    numbered = kept(row_numbers(rows, order), "numbered")
    n = numbered.count()

    @F.pandas_udf("shard int, slot long")
    def placed(row: pd.Series) -> pd.DataFrame:
        shard, slot = place(row.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return numbered.withColumn("__s", placed("row")).select("*", "__s.shard", "__s.slot").drop("__s")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, in doc_id order.

    Null ids come first; rows of one id are ordered by size and checksum. Texts stay where they
    are: only ids, sizes and checksums are shuffled. A null text has the checksum of an empty one.
    """
    narrow = docs.select("doc_id", text_size().alias("size"),
                         F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"))
    return (assign(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row"))
