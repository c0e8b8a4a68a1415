"""Vector arithmetic on ARRAY<DOUBLE> columns (section X of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import EPS_NORM, col


def as_double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def total(v: str | Column) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x)


def mean(v: str | Column) -> Column:
    return total(v) / F.size(col(v))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x * x))


def spread_scalar(v: str | Column, by: Column) -> Column:
    """``by`` once per element of v. A scalar used inside a lambda would be computed per element."""
    return F.array_repeat(by, F.size(col(v)))


def shift(v: str | Column, by: Column) -> Column:
    return F.zip_with(col(v), spread_scalar(v, by), lambda x, b: x - b)


def scale(v: str | Column, by: Column) -> Column:
    return F.zip_with(col(v), spread_scalar(v, by), lambda x, b: x / b)


def cosine(a: str | Column, b: str | Column) -> Column:
    """a.b / (|a||b| + 1e-8)."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPS_NORM))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda s, x: s + x))


def block(v: str | Column, start: int, length: int) -> Column:
    """Elements start..start+length-1, zero-based."""
    return F.slice(col(v), start + 1, length)


def with_unit_rows(df, vec: str, out: str):
    """Centre each row vector and divide by its norm, floored at 1e-8."""
    return (df.withColumn(out, shift(vec, mean(vec)))
              .withColumn(out, scale(out, F.greatest(norm(out), F.lit(EPS_NORM)))))


def with_zscored_rows(df, vec: str, out: str):
    """z-score each row vector with population deviation; a zero deviation counts as 1."""
    tmp = f"__{out}_sd"
    return (df.withColumn(out, shift(vec, mean(vec)))
              .withColumn(tmp, norm(out) / F.sqrt(F.size(out).cast("double")))
              .withColumn(out, scale(out, F.when(F.col(tmp) == 0, F.lit(1.0)).otherwise(F.col(tmp))))
              .drop(tmp))


def softmax_top_k(df, logits: str, k: int, out: str):
    """The k largest softmax entries with their ids, largest first, first id on ties."""
    tmp = f"__{out}_e"
    return (df.withColumn(tmp, F.transform(shift(logits, F.array_max(logits)), F.exp))
              .withColumn(tmp, scale(tmp, total(tmp)))
              .withColumn(tmp, F.transform(tmp, lambda p, i: F.struct(p.alias("prob"), (-i).alias("neg"))))
              .withColumn(tmp, F.slice(F.sort_array(tmp, asc=False), 1, k))
              .withColumn(out, F.transform(tmp, lambda s: F.struct((-s["neg"]).alias("id"), s["prob"].alias("prob"))))
              .drop(tmp))
