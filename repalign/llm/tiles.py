"""Groups of any size cut into tiles, so that all pairs of a group can be looked at in bounded tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def spread_in_tiles(rows: DataFrame, keys: Sequence[str], by: str, weight: Column, most: float) -> DataFrame:
    """Add (tile_i, tile_j, part): every two rows of a group meet in the tile of their parts.

    A group whose total ``weight`` exceeds ``most`` is cut into parts by the hash of ``by``; a
    row of part p goes to the tiles (min(p, q), max(p, q)) of all parts q. Two rows of one part
    meet in tile (p, p) only; in a tile of two parts only pairs across them count.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.sum(weight) / F.lit(float(most))).alias("parts"))
    many = sizes.where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(7), by), F.col("parts")), F.lit(0)).cast("int")
    return (rows.join(many, list(keys), "left").withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0), (F.coalesce("parts", F.lit(1)) - 1).cast("int"))))
            .withColumn("tile_i", F.least("part", "other")).withColumn("tile_j", F.greatest("part", "other"))
            .drop("parts", "other"))


def dealt(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Tiles dealt to tasks by hash, the rows of a tile one after the other."""
    tile = [*keys, "tile_i", "tile_j"]
    return rows.repartition(n, *tile).sortWithinPartitions(*tile)


def tiles_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The tiles of a partition made by ``dealt``, one at a time."""
    tile = [*keys, "tile_i", "tile_j"]
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        start = 0
        marks = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in tile]))
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        if start < len(marks):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
