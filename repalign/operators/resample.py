"""Bootstrap of a statistic given as a function (I1, G1), without a row per item and draw.

Rows are numbered by value and cut into blocks. How often a draw hits a block follows from a tree over the blocks
alone: each node hands a binomial share of its draws to its left half. A task thus finds the draws of its own block,
and how many fall on smaller values, from the seed and the block's number: nothing is shuffled for the draws, and a
block computed again draws the same. Multiplicities live in the task, a slice of draws at a time; a block returns a
few sums per draw. The joint distribution is that of n draws with replacement from n rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .order import position_by_value

BLOCK_ROWS = 4096
DRAWS_PER_SLICE = 64


@dataclass(frozen=True)
class Statistic:
    """A statistic of a sample in order of value.

    ``state(values, m, before, n)`` gives (draws, width) sums of a block: ``values`` ascending, ``m`` (draws, rows)
    how often each was drawn, ``before`` (draws,) how many of the sample are on earlier blocks, ``n`` the sample's
    size. The states of all blocks are added, and ``finish(state, n)`` gives the statistic of each draw. Sums of
    any function of value and rank fit: means, trimmed means, quantiles, Gini's index.
    """

    width: int
    state: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
    finish: Callable[[np.ndarray, np.ndarray], np.ndarray]


def mean() -> Statistic:
    return Statistic(1, lambda values, m, before, n: (m @ values)[:, None], lambda s, n: s[:, 0] / n)


def trimmed_mean(share: float) -> Statistic:
    """The mean without the floor(share * n) smallest and largest values."""
    if not 0 <= share < 0.5:
        raise ValueError("share must be in [0, 0.5)")

    def state(values, m, before, n):
        cut = math.floor(share * n)
        end = before[:, None] + np.cumsum(m, axis=1)
        kept = np.clip(np.minimum(end, n - cut) - np.maximum(end - m, cut), 0, None)
        return (kept @ values)[:, None]

    return Statistic(1, state, lambda s, n: s[:, 0] / (n - 2 * np.floor(share * n)))


def quantile(q: float) -> Statistic:
    """The linear quantile."""
    if not 0 <= q <= 1:
        raise ValueError("q must be in [0, 1]")

    def state(values, m, before, n):
        end = before[:, None] + np.cumsum(m, axis=1)
        low = math.floor(q * (n - 1))
        return np.stack([((end - m <= r) & (r < end)) @ values for r in (low, min(low + 1, n - 1))], axis=1)

    def finish(s, n):
        at = q * (n - 1)
        return s[:, 0] + (at - np.floor(at)) * (s[:, 1] - s[:, 0])

    return Statistic(2, state, finish)


NAMED = {"mean": mean(), "median": quantile(0.5), "min": quantile(0.0), "max": quantile(1.0)}


def _rng(seed: int, group: int, node: int, part: int) -> np.random.Generator:
    return np.random.default_rng([seed, group & (2**64 - 1), node, part])


def block_draws(seed: int, group: int, n: int, block: int, reps: int, rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(own, before): per draw, how many of its n hits fall on this block, and on the blocks before it."""
    first, last, node = 0, -(-n // rows), 1
    own, before = np.full(reps, n, dtype=np.int64), np.zeros(reps, dtype=np.int64)
    while last - first > 1:
        middle = (first + last) // 2
        left_rows, all_rows = (middle - first) * rows, min(last * rows, n) - first * rows
        left = _rng(seed, group, node, 0).binomial(own, left_rows / all_rows)
        if block < middle:
            own, last, node = left, middle, 2 * node
        else:
            own, before, first, node = own - left, before + left, middle, 2 * node + 1
    return own, before


def multiplicities(seed: int, group: int, block: int, rows: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first draw, (draws, rows) counts) of a block, a slice of draws at a time."""
    for start in range(0, len(own), DRAWS_PER_SLICE):
        part = own[start:start + DRAWS_PER_SLICE]
        hits = _rng(seed, group, block, start + 1).integers(0, rows, int(part.sum()))
        cells = np.repeat(np.arange(len(part)), part) * rows + hits
        yield start, np.bincount(cells, minlength=len(part) * rows).reshape(len(part), rows)


def resampled(df: DataFrame, keys: Sequence[str], value: str, statistic: str | Statistic, reps: int, seed: int = 42,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, rep, n, stat): the statistic of the group itself as rep -1, and of each draw 0..reps-1.

    Only finite values count: null, NaN and infinite ones are left out, and a group without any is absent. Null keys are
    keys. Equal values and repeated rows are rows like others. An empty table gives an empty one.
    """
    keys, stat = list(keys), NAMED[statistic] if isinstance(statistic, str) else statistic
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("abs(__v) < double('infinity')")
    placed = position_by_value(rows, keys, "__v", (), "__p", "__n")
    blocks = placed.select(*keys, F.xxhash64(F.lit(0), *keys).alias("__g"), F.floor(F.col("__p") / block_rows).alias("__b"), "__n", "__v")
    names = [f"__s{k}" for k in range(stat.width)]
    schema = StructType([*[blocks.schema[k] for k in keys], StructField("rep", IntegerType()), StructField("n", LongType()),
                         *[StructField(c, DoubleType()) for c in names]])

    def run(table: pa.Table) -> pa.Table:
        values = np.sort(table["__v"].to_numpy())
        n, block, group = (table[c][0].as_py() for c in ("__n", "__b", "__g"))
        whole = stat.state(values, np.ones((1, len(values)), dtype=np.int64), np.array([block * block_rows]), n)
        own, before = block_draws(seed, group, n, block, reps, block_rows)
        parts = [stat.state(values, m, before[at:at + len(m)], n) for at, m in multiplicities(seed, group, block, len(values), own)]
        out = np.concatenate([whole, *parts])
        same = pa.array(np.zeros(len(out), dtype=np.int64))
        columns = [table[k].combine_chunks().take(same) for k in keys]
        columns += [pa.array(np.arange(-1, reps, dtype=np.int32)), pa.array(np.full(len(out), n, dtype=np.int64))]
        return pa.table(columns + [pa.array(np.ascontiguousarray(c), pa.float64()) for c in out.T], names=[*keys, "rep", "n", *names])

    sums = blocks.groupBy(*keys, "__b").applyInArrow(run, schema).groupBy(*keys, "rep", "n").agg(*[F.sum(c).alias(c) for c in names])
    done = StructType([*schema.fields[:len(keys) + 2], StructField("stat", DoubleType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in names], axis=1)
            value = stat.finish(state, batch["n"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys) + 2], pa.array(value, pa.float64())], names=done.names)

    return sums.mapInArrow(finish, done)


def statistic_of(df: DataFrame, keys: Sequence[str], value: str, statistic: str | Statistic) -> DataFrame:
    """(keys, n, stat) of each group, without draws."""
    return resampled(df, keys, value, statistic, 0).drop("rep")


def bootstrap_statistic(df: DataFrame, keys: Sequence[str], value: str, statistic: str | Statistic, reps: int = 10000,
                        level: float = 0.95, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, n, observed, ci_low, ci_high, se) of a statistic given by name or as a ``Statistic``."""
    keys, tail = list(keys), (1 - level) / 2
    drawn, own = F.when(F.col("rep") >= 0, F.col("stat")), F.when(F.col("rep") < 0, F.col("stat"))
    return resampled(df, keys, value, statistic, reps, seed, block_rows).groupBy(*keys, "n").agg(
        F.max(own).alias("observed"), F.percentile(drawn, F.lit(tail)).alias("ci_low"),
        F.percentile(drawn, F.lit(1 - tail)).alias("ci_high"), F.stddev_pop(drawn).alias("se"))
