"""Positions, ranks, quantiles and folds over groups of any size.

Groups of up to GROUP_ROWS rows are ordered by plain windows: one shuffle. A larger group is cut into
ranges of its order at split points taken from a quantile sketch (KLL) that merges over tasks, again and
again until no range has more than RANGE_ROWS rows. A split value is a range of its own, so a value that
very many rows share is not cut by value but by what orders its rows next. Range totals (a small table)
give each range its offset, and only single ranges are sorted by one task. Ranks, quantiles and
FDR order distinct values with their counts: equal values are never gathered. The results are
exact; sizes only choose the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, DateType, LongType, NumericType, ShortType, IntegerType, StringType, TimestampType
from pyspark.sql.window import WindowSpec

from ..functions.scalars import col, md5_key
from ..session import cut_lineage

# Larger groups are cut into ranges.
GROUP_ROWS = 1_000_000
RANGE_ROWS = 500_000
# Split points a range gets at a time, and the size of its sketch (rank error about 1 / 1000).
SPLITS = 256
SKETCH_SIZE = 2048
_LARGEST = 1.7976931348623157e308
_CHARS, _CHUNKS = 6, 6


def crowded(df: DataFrame, keys: Sequence[str], most: int | None = None) -> bool:
    """Whether a group has more than ``most`` (GROUP_ROWS) rows: a count that reads the keys only."""
    return not df.groupBy(*keys).count().where(F.col("count") > (GROUP_ROWS if most is None else most)).isEmpty()


def _group(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _ascending(by: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in by]


# ---- ranges of large groups --------------------------------------------------------------

def _measures(df: DataFrame, by: str) -> list[Column]:
    """Doubles that never decrease along the order of ``by`` (nulls last), the coarse ones first."""
    kind, c = df.schema[by].dataType, F.col(by)
    if isinstance(kind, StringType):
        parts = [F.rpad(F.hex(F.substring(c.cast("binary"), 1 + _CHARS * k, _CHARS)), 2 * _CHARS, "0") for k in range(_CHUNKS)]
        return [F.coalesce(F.conv(p, 16, 10).cast("double"), F.lit(_LARGEST)) for p in parts]
    if isinstance(kind, TimestampType):
        c, kind = F.unix_micros(c), LongType()
    if isinstance(kind, DateType):
        c, kind = F.unix_date(c), IntegerType()
    if isinstance(kind, LongType):
        return [F.coalesce(F.shiftright(c, 32).cast("double"), F.lit(_LARGEST)), F.coalesce(c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), F.lit(0.0))]
    if isinstance(kind, (IntegerType, ShortType, ByteType)):
        return [F.coalesce(c.cast("double"), F.lit(_LARGEST))]
    if not isinstance(kind, NumericType):
        return []
    v = c.cast("double")
    odd = F.when(v.isNull(), 3.0).when(F.isnan(v), 2.0).when(v == float("inf"), 1.0).when(v == float("-inf"), -1.0).otherwise(0.0)
    return [F.when(odd == 0.0, v).when(odd < 0, -_LARGEST).otherwise(_LARGEST), odd]


def in_ranges(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with ``__g`` (the keys as one value, so that null keys join by plain equality) and ``__r``, its range.

    Ranges are arrays of numbers that compare in the order of ``by``. None has more than RANGE_ROWS rows, but for
    rows that are equal in all measures of ``by`` (strings: in their first 36 bytes). Each level
    looks only at the ranges that are still too large, and is a table in the shared folder.
    """
    measures = [m for c in by for m in _measures(df, c)]
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    open_rows = cut_lineage(df.select(F.struct(*df.columns).alias("__row"), group.alias("__g"), F.array().cast("array<int>").alias("__r"),
                                      F.lit(1).alias("__c"), F.array(*measures).alias("__m")))
    fine = None
    while True:
        part = ["__g", "__r", "__c"]
        wanted = F.least(F.lit(SPLITS), F.ceil(2 * F.col("n") / RANGE_ROWS)).cast("int")
        many = (open_rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.element_at("__m", F.col("__c")), SKETCH_SIZE).alias("k"))
                .where((F.col("n") > RANGE_ROWS) & (F.col("__c") <= len(measures))).withColumn("w", wanted)
                .withColumn("q", F.kll_sketch_get_quantile_double("k", F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])))
                .withColumn("at", F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("w") - 1), lambda i: F.element_at("q", F.floor(i * SPLITS / F.col("w")).cast("int")))))
                .select(*part, "at"))
        many = cut_lineage(many)
        if many.isEmpty():
            fine = open_rows if fine is None else fine.unionByName(open_rows)
            return fine.select("__row.*", "__g", "__r")
        value = F.element_at("__m", F.col("__c"))
        met = open_rows.join(many, part, "left")
        done = cut_lineage(met.where(F.col("at").isNull()).drop("at"))
        fine = done if fine is None else fine.unionByName(done)
        split = met.where(F.col("at").isNotNull()).withColumn("__v", value)
        hit = F.array_contains("at", F.col("__v")).cast("int")
        below = F.size(F.filter("at", lambda s: s < F.col("__v")))
        open_rows = cut_lineage(split.select("__row", "__g", F.concat("__r", F.array(2 * below + hit)).alias("__r"), (F.col("__c") + hit).alias("__c"), "__m"))


def _totals(ranged: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add ``<name>`` and ``<name>_all`` to the rows of ``in_ranges``; the two helper columns go."""
    rows = ranged
    for name, e in sums.items():
        rows = rows.withColumn(f"__v_{name}", e)
    table = rows.groupBy("__g", "__r").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    group = Window.partitionBy("__g")
    before = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("__g", "__r", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
                         *[F.sum(f"__t_{n}").over(group).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy("__g", "__r").orderBy(*_ascending(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(table, ["__g", "__r"])
    for n in sums:
        out = out.withColumn(n, F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(inside))
    return out.drop("__g", "__r", *[f"__v_{n}" for n in sums], *[f"__o_{n}" for n in sums])


# ---- positions ---------------------------------------------------------------------------

def running_totals(df: DataFrame, keys: Sequence[str], by: Sequence[str], sums: dict[str, Column], large: bool | None = None) -> DataFrame:
    """Add ``<name>`` (total of the rows up to and with this one) and ``<name>_all`` per group.

    Rows are in ascending order of the columns ``by``, nulls last; equal rows come in any order. ``large`` tells whether
    a group has more than GROUP_ROWS rows, where the caller knows; else the groups are counted.
    """
    keys, by = list(keys), list(by)
    if crowded(df, keys) if large is None else large:
        return _totals(in_ranges(df, keys, by), by, sums)
    group = _group(keys)
    upto = group.orderBy(*_ascending(by)).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.sum(e).over(upto).alias(n) for n, e in sums.items()], *[F.sum(e).over(group).alias(f"{n}_all") for n, e in sums.items()])


def ordered_position(df: DataFrame, keys: Sequence[str], by: Sequence[str], out: str = "pos", size: str = "n",
                     large: bool | None = None) -> DataFrame:
    """Zero-based position of each row in its group, ordered by the columns ``by``, and the size of the group."""
    res = running_totals(df, keys, by, {"__pos": F.lit(1).cast("long")}, large)
    return res.withColumn(out, F.col("__pos") - 1).withColumn(size, F.col("__pos_all")).drop("__pos", "__pos_all")


def position_by_value(df: DataFrame, keys: Sequence[str], by: str, tie: Sequence[str] = (),
                      out: str = "pos", size: str = "n") -> DataFrame:
    return ordered_position(df, keys, [by, *tie], out, size)


def position_by_md5(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int,
                    out: str = "pos", size: str = "n", key_parts: Sequence[str] = ()) -> DataFrame:
    """Position in the random order md5('seed[-part..]-id')."""
    rows = df.withColumn("__h", md5_key(seed, *key_parts, *ids))
    return ordered_position(rows, keys, ["__h", *ids], out, size, crowded(df, keys)).drop("__h")


# ---- ranks and quantiles -----------------------------------------------------------------

def counted_totals(df: DataFrame, keys: Sequence[str], value: str, weight: Column) -> DataFrame:
    """(keys, value, __c, __u, __u_all): weight of each distinct value, of those up to it, and of the group."""
    counted = df.groupBy(*keys, value).agg(F.sum(weight).alias("__c"))
    return running_totals(counted, keys, [value], {"__u": F.col("__c")})


def joined_back(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the further columns of ``table``, which has one row per value of ``on``; null equals null."""
    key = F.struct(*[F.col(c) for c in on])
    return df.withColumn("__on", key).join(table.withColumn("__on", key).drop(*on), "__on", how).drop("__on")


def average_ranks(df: DataFrame, keys: Sequence[str], columns: dict[str, str], weight: str | None = None) -> DataFrame:
    """Ranks of several columns, ties sharing their mean rank (W2), optionally over weighted rows.

    All columns share one shuffle by ``keys``. In groups beyond GROUP_ROWS the distinct values are counted and
    ordered instead, and rows fetch their rank by a join that AQE may split.
    A null has no rank; NaN ranks after infinity, all NaN alike; a null key is a key.
    """
    keys, w = list(keys), F.col(weight) if weight else F.lit(1.0)
    if crowded(df, keys):
        out = cut_lineage(df)
        for value, name in columns.items():
            table = counted_totals(out, keys, value, w).select(*keys, value, (F.col("__u") - (F.col("__c") - 1) / 2).alias(name))
            out = joined_back(out, table, [*keys, value])
    else:
        group = _group(keys)
        upto = {v: group.orderBy(F.asc_nulls_last(v)).rangeBetween(Window.unboundedPreceding, 0) for v in columns}
        same = {v: Window.partitionBy(*keys, v) for v in columns}
        out = df.select("*", *[(F.sum(w).over(upto[v]) - (F.sum(w).over(same[v]) - 1) / 2).alias(name) for v, name in columns.items()])
    return out.withColumns({name: F.when(F.col(value).isNotNull(), F.col(name)) for value, name in columns.items()})


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank",
                 weight: str | None = None) -> DataFrame:
    return average_ranks(df, keys, {value: out}, weight)


def small_group_rank(keys: Sequence[str], value: str | Column) -> Column:
    """Average rank as window columns, for groups bounded by design (layers, regions, subjects)."""
    v = col(value)
    group = Window.partitionBy(*keys)
    return (F.rank().over(group.orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2.0)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probs``; nulls do not count.

    Groups up to GROUP_ROWS use the exact aggregate, which holds a group's distinct values; in larger ones
    the distinct values get their places, and the few at a wanted place are picked.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    if not crowded(rows, keys):
        found = rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(q))).alias(name) for name, q in probs.items()], F.count(F.lit(1)).alias("__n"))
        return found.where(F.col("__n") > 0).drop("__n")
    table = counted_totals(rows, keys, value, F.lit(1).cast("long"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in probs.items()])
    place = (F.col("__u_all") - 1) * F.col("p.q")
    cells = table.withColumn("p", F.explode(wanted)).withColumn("f", F.floor(place)).withColumn("w", place - F.floor(place))
    low, high = F.col("__u") - F.col("__c"), F.col("__u")
    share = (F.when((F.col("f") >= low) & (F.col("f") < high), 1 - F.col("w")).otherwise(0.0)
             + F.when((F.col("f") + 1 >= low) & (F.col("f") + 1 < high), F.col("w")).otherwise(0.0))
    picked = cells.withColumn("s", share).where(F.col("s") > 0)
    return picked.groupBy(*keys).agg(*[F.sum(F.when(F.col("p.name") == name, F.col(value) * F.col("s"))).alias(name) for name in probs])


# ---- folds and subsets -------------------------------------------------------------------

def ntile_of(pos: Column, n: Column, k: int) -> Column:
    """Zero-based tile of a zero-based position; the first n mod k tiles get one row more."""
    base = F.floor(n / k).cast("long")
    extra = F.pmod(n, F.lit(k)).cast("long")
    head = extra * (base + 1)
    return F.when(pos < head, F.floor(pos / (base + 1))).otherwise(
        extra + F.floor((pos - head) / F.greatest(base, F.lit(1)))).cast("int")


def kfold(df: DataFrame, keys: Sequence[str], item: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """k near-equal random folds per group."""
    return (position_by_md5(df, keys, [item], seed, "__p", "__n")
            .withColumn(out, ntile_of(F.col("__p"), F.col("__n"), k)).drop("__p", "__n"))


def ordered_holdout(df: DataFrame, keys: Sequence[str], item: str, share: float = 0.8,
                    out: str = "is_train") -> DataFrame:
    """First ``share`` of the rows in item order are for training."""
    return (position_by_value(df, keys, item, (), "__p", "__n")
            .withColumn(out, F.col("__p") < F.floor(F.col("__n") * share)).drop("__p", "__n"))


def random_holdout(df: DataFrame, keys: Sequence[str], item: str, test_share: float = 0.2, seed: int = 42,
                   out: str = "is_train") -> DataFrame:
    """A random max(1, floor(share * n)) rows are for testing."""
    n_test = F.greatest(F.lit(1), F.floor(F.col("__n") * test_share))
    return (position_by_md5(df, keys, [item], seed, "__p", "__n")
            .withColumn(out, F.col("__p") >= n_test).drop("__p", "__n"))


def random_subset(df: DataFrame, keys: Sequence[str], item: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows per group, or all if there are fewer (T4)."""
    return position_by_md5(df, keys, [item], seed, "__p", "__n").where(F.col("__p") < size).drop("__p", "__n")


def every_nth(df: DataFrame, keys: Sequence[str], item: str, about: int = 200) -> DataFrame:
    """Every max(1, n // about)-th row in item order."""
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / about)).cast("long")
    return (position_by_value(df, keys, item, (), "__p", "__n")
            .where(F.pmod(F.col("__p"), step) == 0).drop("__p", "__n"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order`` (W7). An aggregate, so it combines before the shuffle."""
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{c}") for c in columns])
