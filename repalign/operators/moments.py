"""Mergeable second moments of row vectors, the one data pass behind CKA, RSA and ridge.

Each task folds its rows into (n, means, centred products) per group and writes only those; two such
parts merge by the pairwise formula, which subtracts no large numbers, so columns whose mean is far
larger than their deviation lose no digits. What is shuffled depends on the number of groups and
dimensions, not on the number of rows: a group of any size is combined before it moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# A task writes its sums early once they pass this size; later merging adds them up again.
FLUSH_DOUBLES = 8_000_000
BLOCK_DOUBLES = 65_536
# From this many shuffle partitions on, sums are merged in two steps.
WIDE_CLUSTER, MERGE_LANES = 400, 32


class Moments:
    """Moments of z = [x, y] over n rows: means, c = sum of (x - mean)(z - mean)^T, and yy = sum of (y - mean)^2.

    Raw sums (``sx``, ``xx`` and so on) are derived; they are for columns that were centred before.
    """

    __slots__ = ("n", "mean", "c", "cyy")

    def __init__(self, n: float, mean: np.ndarray, c: np.ndarray, cyy: np.ndarray):
        self.n, self.mean, self.c, self.cyy = n, mean, c, cyy

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Moments":
        z = np.hstack([x, y])
        n = float(len(z)) if weight is None else float(weight.sum())
        mean = (z.sum(axis=0) if weight is None else weight @ z) / max(n, 1e-300)
        z = z - mean
        rest = (z.sum(axis=0) if weight is None else weight @ z) / max(n, 1e-300)  # what rounding left of the mean
        mean, z = mean + rest, z - rest
        left = z if weight is None else z * weight[:, None]
        d = x.shape[1]
        return cls(n, mean, left[:, :d].T @ z, (left[:, d:] * z[:, d:]).sum(axis=0))

    def _joined(self, o: "Moments", sign: float) -> "Moments":
        n = self.n + sign * o.n
        if n <= 0:
            return Moments(0.0, self.mean * 0, self.c * 0, self.cyy * 0)
        gap = o.mean - self.mean
        f = sign * self.n * o.n / n
        d = self.d
        return Moments(n, self.mean + sign * o.n / n * gap, self.c + sign * o.c + f * np.outer(gap[:d], gap), self.cyy + sign * o.cyy + f * gap[d:] ** 2)

    def __add__(self, o: "Moments") -> "Moments":
        return self._joined(o, 1.0)

    def __sub__(self, o: "Moments") -> "Moments":
        """The moments of the other rows, where ``o`` holds some of these."""
        return self._joined(o, -1.0)

    @property
    def d(self) -> int:
        return self.c.shape[0]

    @property
    def mx(self):
        return self.mean[:self.d]

    @property
    def my(self):
        return self.mean[self.d:]

    @property
    def sx(self):
        return self.n * self.mx

    @property
    def sy(self):
        return self.n * self.my

    @property
    def xx(self):
        return self.c[:, :self.d] + self.n * np.outer(self.mx, self.mx)

    @property
    def xy(self):
        return self.c[:, self.d:] + self.n * np.outer(self.mx, self.my)

    @property
    def yy(self):
        return self.cyy + self.n * self.my ** 2

    def affine(self, mu: np.ndarray, a: np.ndarray) -> "Moments":
        """Moments of z = (x - mu) a."""
        left = a.T @ self.c
        return Moments(self.n, np.concatenate([(self.mx - mu) @ a, self.my]), np.hstack([left[:, :self.d] @ a, left[:, self.d:]]), self.cyy)

    def select_x(self, idx: np.ndarray) -> "Moments":
        """Moments of some of the x columns."""
        cols = np.concatenate([idx, np.arange(self.d, len(self.mean))])
        return Moments(self.n, self.mean[cols], self.c[np.ix_(idx, cols)], self.cyy)

    def select_y(self, idx: np.ndarray) -> "Moments":
        """Moments of some of the y columns."""
        cols = np.concatenate([np.arange(self.d), self.d + idx])
        return Moments(self.n, self.mean[cols], self.c[:, cols], self.cyy[idx])

    def shift_y(self, by: np.ndarray) -> "Moments":
        """Moments with y - by in place of y."""
        return Moments(self.n, np.concatenate([self.mx, self.my - by]), self.c, self.cyy)

    def centred_xx(self) -> np.ndarray:
        return self.c[:, :self.d]

    def centred_xy(self) -> np.ndarray:
        return self.c[:, self.d:]


def _step(width: int) -> int:
    return max(1, BLOCK_DOUBLES // width)


def pieces_of(g: Moments) -> dict[int, np.ndarray]:
    """The moments as flat pieces [n, columns of y, means, body] of bounded size; piece -1 has the squares of y."""
    d, width = g.c.shape
    head = np.concatenate([[g.n, width - d], g.mean])
    out = {p: np.concatenate([head, g.c[lo:lo + _step(width)].ravel()]) for p, lo in enumerate(range(0, d, _step(width)))}
    out[-1] = np.concatenate([head, g.cyy])
    return out


def merged_piece(a: np.ndarray, b: np.ndarray, d: int, part: int) -> np.ndarray:
    """The same piece of two disjoint sets of rows as one."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    width = d + int(a[1])
    n, body = a[0] + b[0], 2 + width
    gap = b[2:body] - a[2:body]
    f = a[0] * b[0] / n
    if part < 0:
        more = f * gap[d:] ** 2
    else:
        lo = part * _step(width)
        more = f * np.outer(gap[lo:lo + (len(a) - body) // width], gap).ravel()
    return np.concatenate([[n, a[1]], a[2:body] + b[0] / n * gap, a[body:] + b[body:] + more])


def _as_matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _codes(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Group number of each row, and the key tuples."""
    frame = pa.Table.from_batches([batch]).select(keys).to_pandas()
    codes, uniques = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy(), frame.drop_duplicates()
    return codes, list(uniques.itertuples(index=False, name=None))


def moment_parts(df: DataFrame, keys: Sequence[str], x: str, y: str | None = None,
                 weight: str | None = None) -> DataFrame:
    """(keys, d, part, vals): flattened pieces of the sums of each group, merged once.

    Pieces of one group may still come in several rows; ``assemble`` adds them up. A row with
    weight w counts as w equal rows.
    """
    keys = list(keys)
    schema = df.schema
    key_ddl = "".join(f"`{k}` {schema[k].dataType.simpleString()}, " for k in keys)
    ddl = key_ddl + "d int, part int, vals array<double>"

    def emit(state: dict, key_types) -> Iterator[pa.RecordBatch]:
        for (key, d), pieces in state.items():
            for part, vals in pieces.items():
                cols = [pa.array([v], type=t) for v, t in zip(key, key_types)]
                cols += [pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([vals], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "d", "part", "vals"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Moments] = {}
        held, key_types = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_types = [batch.schema.field(k).type for k in keys]
            columns = [batch.column(c) for c in (("__x", "__y") if y else ("__x",))]
            even = all(len(set(pc.list_value_length(c).to_pylist())) == 1 for c in columns)  # groups may differ in their lengths
            tables = [_as_matrix(c) for c in columns] if even else None
            w = batch.column("__w").to_numpy(zero_copy_only=False) if weight else None
            codes, tuples = _codes(batch, keys)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(tuples) + 1))
            for g, key in enumerate(tuples):
                rows = order[bounds[g]:bounds[g + 1]]
                x_rows, *y_rows = [t[rows] for t in tables] if even else [_as_matrix(c.take(pa.array(rows))) for c in columns]
                part = Moments.of(x_rows, y_rows[0] if y else np.zeros((len(rows), 0)), None if w is None else w[rows])
                slot = (key, x_rows.shape[1])
                if slot in sums:
                    sums[slot] = sums[slot] + part
                else:
                    sums[slot] = part
                    held += part.c.size
            if held > FLUSH_DOUBLES:
                yield from emit({k: pieces_of(g) for k, g in sums.items()}, key_types)
                sums, held = {}, 0
        if sums:
            yield from emit({k: pieces_of(g) for k, g in sums.items()}, key_types)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        held, key_types = 0, None

        def out():
            for (key, d, part), vals in sums.items():
                yield from emit({(key, d): {part: vals}}, key_types)

        for batch in batches:
            if not batch.num_rows:
                continue
            key_types = [batch.schema.field(k).type for k in keys]
            names = [batch.column(k).to_pylist() for k in keys] + [batch.column("d").to_pylist(), batch.column("part").to_pylist()]
            vals = batch.column("vals")
            for r, label in enumerate(zip(*names)):
                v = vals[r].values.to_numpy(zero_copy_only=False)
                slot = (label[:-2], label[-2], label[-1])
                if slot in sums:
                    sums[slot] = merged_piece(sums[slot], v, label[-2], label[-1])
                else:
                    sums[slot] = v
                    held += v.size
            if held > FLUSH_DOUBLES:
                yield from out()
                sums, held = {}, 0
        yield from out()

    cols = [F.col(k) for k in keys] + [F.col(x).cast("array<double>").alias("__x")]
    if y:
        cols.append(F.col(y).cast("array<double>").alias("__y"))
    if weight:
        cols.append(F.col(weight).cast("double").alias("__w"))
    partial = df.select(*cols).mapInArrow(fold, ddl)
    by = [F.col(k) for k in keys] + [F.col("part")]
    if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > WIDE_CLUSTER:
        # many tasks send sums of the same group: add them up in lanes first
        lane = F.pmod(F.spark_partition_id(), F.lit(MERGE_LANES))
        partial = (partial.withColumn("lane", lane).repartition(*by, "lane").drop("lane").mapInArrow(merge, ddl))
    return partial.repartition(*by).mapInArrow(merge, ddl)


def assemble(d: int, parts, vals) -> Moments:
    """Put the pieces of one group together."""
    whole: dict[int, np.ndarray] = {}
    for p, v in zip(parts, vals):
        p, v = int(p), np.asarray(v, float)
        whole[p] = merged_piece(whole[p], v, d, p) if p in whole else v
    last = whole.pop(-1)
    body = 2 + d + int(last[1])
    c = np.concatenate([whole[p][body:] for p in sorted(whole)]) if whole else np.zeros(0)
    return Moments(last[0], last[2:body], c.reshape(d, body - 2), last[body:])


def per_group(parts: DataFrame, fit_keys: Sequence[str], split_keys: Sequence[str], solve: Callable,
              fields: str) -> DataFrame:
    """Call ``solve({split key tuple: Moments})`` once per fit key; it returns a dict of columns.

    The input of one call is a few matrices whose size does not depend on the number of rows.
    """
    fit_keys, split_keys = list(fit_keys), list(split_keys)
    schema = parts.schema
    ddl = "".join(f"`{k}` {schema[k].dataType.simpleString()}, " for k in fit_keys) + fields

    def run(key, pdf):
        import pandas as pd

        groups = {}
        grouped = pdf.groupby(split_keys, sort=True, dropna=False) if split_keys else [((), pdf)]
        for split, rows in grouped:
            split = split if isinstance(split, tuple) else (split,)
            groups[split] = assemble(int(rows["d"].iloc[0]), rows["part"], rows["vals"])
        out = pd.DataFrame(solve(groups))
        for at, (name, value) in enumerate(zip(fit_keys, key)):
            out.insert(at, name, [value] * len(out))
        return out

    return parts.groupBy(*fit_keys).applyInPandas(run, ddl)
