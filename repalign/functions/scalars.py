"""Scalar column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thresholds that results depend on.
EPS_NORM = 1e-8
EPS_PEARSON = 1e-10
MIN_CEILING = 0.05
STAR_LEVELS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: Column, digits: int = 6) -> Column:
    """Round for display or comparison and turn -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def md5_key(seed: int, *parts: str | Column) -> Column:
    """md5 of 'seed-part-part': a random order that any engine reproduces."""
    pieces = [F.lit(str(seed))] + [col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("-", *pieces).cast("binary"))


def md5_number(seed: int, *parts: str | Column) -> Column:
    """The first eight hex digits of the md5 key as a number."""
    return F.conv(F.substring(md5_key(seed, *parts), 1, 8), 16, 10).cast("long")


def md5_draw(seed: int, n: Column, *parts: str | Column) -> Column:
    """A draw from 0..n-1: the number of the md5 key modulo n."""
    return F.pmod(md5_number(seed, *parts), n.cast("long"))


def pearson(x: str | Column, y: str | Column, on_degenerate: float | None = None,
            eps: float = 0.0) -> Column:
    """Pearson r as an aggregate that survives zero variance (A1).

    ``on_degenerate`` is the value given where either side is constant: 0.0 for the
    encoders, None where such targets are to be skipped.
    """
    x, y = col(x), col(y)
    den = F.sqrt(F.var_pop(x) * F.var_pop(y))
    fallback = F.lit(on_degenerate).cast("double")
    return F.when(den > F.lit(eps), F.covar_pop(x, y) / den).otherwise(fallback)


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column,
                      on_degenerate: float | None = None) -> Column:
    """Pearson r from raw sums, for statistics merged across partial aggregates."""
    den = F.sqrt(F.greatest(sxx - sx * sx / n, F.lit(0.0)) * F.greatest(syy - sy * sy / n, F.lit(0.0)))
    return F.when(den > 0, (sxy - sx * sy / n) / den).otherwise(F.lit(on_degenerate).cast("double"))


def ceiling_from_snr(snr: str | Column, n_reps: int = 3) -> Column:
    """Largest reachable r of a target with the given signal-to-noise ratio."""
    s2 = col(snr) * col(snr)
    return F.sqrt(s2 / (s2 + F.lit(1.0 / n_reps)))


def ceiling_normalised(r: str | Column, ceiling: str | Column) -> Column:
    """r over its ceiling, clipped to [-1, 1]; 0 where the ceiling is at most 0.05."""
    r, c = col(r), col(ceiling)
    return F.when(c > MIN_CEILING, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / c))).otherwise(F.lit(0.0))


def specialisation(a: str | Column, b: str | Column) -> Column:
    """(a - b) / (a + b + 1e-8)."""
    a, b = col(a), col(b)
    return (a - b) / (a + b + F.lit(EPS_NORM))


def fluency(perplexity: str | Column, cap: float = 1000.0) -> Column:
    """1 - ln(clip(p, 1, cap)) / ln(cap) (X11)."""
    import math

    p = F.greatest(F.lit(1.0), F.least(F.lit(cap), col(perplexity)))
    return F.lit(1.0) - F.log(p) / F.lit(math.log(cap))


def stars(p: str | Column) -> Column:
    """Significance marks."""
    p = col(p)
    out = None
    for level, mark in STAR_LEVELS:
        out = F.when(p < level, mark) if out is None else out.when(p < level, mark)
    return out.otherwise("ns")


def clean_piece(token: str | Column) -> Column:
    """Drop sub-word markers and shorten long pieces to seven letters and a dot."""
    t = F.translate(col(token), "▁Ġ", "")
    return F.when(F.length(t) > 8, F.concat(F.substring(t, 1, 7), F.lit("."))).otherwise(t)


def crop_fractions(box: str | Column) -> Column:
    """'(t, b, l, r)' as an array of four doubles."""
    return F.transform(F.split(F.regexp_replace(col(box), r"[()\s]", ""), ","), lambda x: x.cast("double"))


def crop_rectangle(width: Column, height: Column, box: Column) -> Column:
    """Pixel rectangle of a crop, rounded half to even, and whether it is non-empty."""
    left = F.bround(width * box[2]).cast("int")
    top = F.bround(height * box[0]).cast("int")
    right = F.bround(width * (F.lit(1.0) - box[3])).cast("int")
    bottom = F.bround(height * (F.lit(1.0) - box[1])).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"),
                    ((right > left) & (bottom > top)).alias("valid"))


def zero_padded(number: str | Column, digits: int) -> Column:
    """A non-negative number with leading zeros; longer numbers are kept whole."""
    text = col(number).cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def image_path(split: str | Column, image_id: str | Column, known: tuple[str, ...]) -> Column:
    """'split/000000000123.jpg'; an unknown split is an error (P5)."""
    s = col(split)
    return F.when(s.isin(*known), F.concat(s, F.lit("/"), zero_padded(image_id, 12), F.lit(".jpg"))).otherwise(
        F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(s, F.lit("null")))))
