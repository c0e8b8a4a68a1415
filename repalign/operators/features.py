"""Feature tables: discovery, merging of sources, pooling and rewriting of vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import EPS_NORM, md5_key
from ..session import cut_lineage
from .order import keep_first, random_subset
from .ridge import pca, single_split_ridge

PATCH_TYPES = ("zero", "mean", "noise")


def layer_subset(features: DataFrame, layers: Sequence[int] | None = None) -> DataFrame:
    """Chosen layers only (S1, F13); on a partitioned table this prunes folders."""
    return features if layers is None else features.where(F.col("layer").isin(*layers))


def first_source(features: DataFrame, keys: Sequence[str], priority: str, vector: str = "vector") -> DataFrame:
    """Per key the vector of the best source (S2, S4, U1, W7): lowest priority number that is not empty."""
    usable = features.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    return keep_first(usable, keys, [F.col(priority)], [vector, priority])


def dropped_items(wanted: DataFrame, features: DataFrame, item: str) -> DataFrame:
    """Wanted items without features."""
    return wanted.select(item).distinct().join(features.select(item), item, "left_anti")


def collect_vector(cells: DataFrame, keys: Sequence[str], position: str, value: str, out: str = "vector") -> DataFrame:
    """(keys, pos, value) to one array per key; its length is the number of positions."""
    return (cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(position, value))).alias("__c"))
            .select(*keys, F.col("__c").getField(value).alias(out)))


def mean_pool(tokens: DataFrame, keys: Sequence[str], vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """Element-wise mean of vectors per key (A6, A8). Sums combine before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    cells = tokens.select(*keys, w.alias("__w"), F.posexplode(vector).alias("__p", "__v"))
    means = cells.groupBy(*keys, "__p").agg((F.sum(F.col("__v") * F.col("__w")) / F.sum("__w")).alias("__m"))
    return collect_vector(means, keys, "__p", "__m", vector)


def pool_streams(tokens: DataFrame, keys: Sequence[str], position: str, n_visual: Column, vector: str = "vector") -> DataFrame:
    """Mean over visual, text and all tokens, as a ``stream`` key."""
    visual = F.col(position) < n_visual
    streams = F.when(visual, F.array(F.lit("vis"), F.lit("all"))).otherwise(F.array(F.lit("txt"), F.lit("all")))
    return mean_pool(tokens.withColumn("stream", F.explode(streams)), [*keys, "stream"], vector)


def semantic_vectors(topk: DataFrame, vocab: DataFrame, keys: Sequence[str], entries: str = "topk",
                     vector: str = "vector") -> DataFrame:
    """Probability-weighted mean of the vocabulary vectors of a top-K list.

    Weights are divided by their sum plus 1e-8 over the whole list.
    """
    flat = (topk.withColumn("__z", F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["prob"]) + EPS_NORM)
            .select(*keys, "__z", F.explode(entries).alias("e"))
            .select(*keys, F.col("e.id").alias("token_id"), (F.col("e.prob") / F.col("__z")).alias("__w")))
    cells = (flat.join(vocab.select("token_id", vector), "token_id")
             .select(*keys, "__w", F.posexplode(vector).alias("__p", "__v"))
             .groupBy(*keys, "__p").agg(F.sum(F.col("__w") * F.col("__v")).alias("__m")))
    return collect_vector(cells, keys, "__p", "__m", vector)


def mean_activation(tokens: DataFrame, samples: DataFrame | None = None, vector: str = "vector") -> DataFrame:
    """Mean vector per layer over all tokens of the chosen samples."""
    rows = tokens if samples is None else tokens.join(samples, "item_id", "left_semi")
    return mean_pool(rows, ["layer"], vector)


def ablate(tokens: DataFrame, how: str, layer_mean: DataFrame | None = None, vector: str = "vector", seed: int = 42) -> DataFrame:
    """Rewrite a token table (A9, G4): zeros, the layer mean, or added noise of the sample's spread.

    Without a layer mean, the mean of the own sample stands in.
    """
    if how not in PATCH_TYPES:
        raise ValueError(f"unknown patch type: {how}")
    if how == "zero":
        return tokens.withColumn(vector, F.transform(vector, lambda x: F.lit(0.0)))
    sample = ["layer", "item_id"]
    if how == "mean":
        own = mean_pool(tokens, sample, vector).withColumnRenamed(vector, "__own")
        out = tokens.drop(vector).join(own, sample)
        if layer_mean is None:
            return out.withColumnRenamed("__own", vector)
        out = out.join(layer_mean.select("layer", F.col(vector).alias("__mean")), "layer", "left")
        return out.withColumn(vector, F.coalesce("__mean", "__own")).drop("__mean", "__own")
    total = lambda f: F.sum(F.aggregate(vector, F.lit(0.0), f))
    n = F.sum(F.size(vector))
    s, q = total(lambda a, x: a + x), total(lambda a, x: a + x * x)
    spread = tokens.groupBy(*sample).agg(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).alias("__sd"))

    def uniform(salt: int, i: Column) -> Column:
        bits = F.conv(F.substring(md5_key(seed + salt, "layer", "item_id", "token", i), 1, 8), 16, 10).cast("double")
        return (bits + 1.0) / F.lit(4294967297.0)

    def normal(i: Column) -> Column:
        return F.sqrt(F.lit(-2.0) * F.log(uniform(0, i))) * F.cos(F.lit(2.0 * np.pi) * uniform(1, i))

    return (tokens.join(spread, sample)
            .withColumn(vector, F.transform(vector, lambda x, i: x + normal(i) * F.col("__sd"))).drop("__sd"))


def random_projection(features: DataFrame, vector: str, d_in: int, d_out: int, seed: int = 42) -> DataFrame:
    """Multiply by a matrix with orthonormal rows or columns from a seeded gaussian.

    The matrix is a function of seed and sizes, so tasks rebuild it instead of receiving it.
    """
    schema = features.schema

    def project(batches):
        wide = max(d_in, d_out)
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, min(d_in, d_out))))
        q = q * np.sign(np.diag(r))
        m = q.T if d_out >= d_in else q
        for batch in batches:
            at = batch.schema.get_field_index(vector)
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = (x @ m).ravel()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d_out)
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.list_(pa.float64())),
                                   pa.ListArray.from_arrays(offsets, pa.array(y)))

    ready = features.withColumn(vector, F.col(vector).cast("array<double>"))
    ddl = ", ".join(f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in schema)
    return ready.mapInArrow(project, ddl)


def standardise_columns(df: DataFrame, keys: Sequence[str], vector: str, unit_zero: bool = True,
                        fit_rows: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation per position, fitted on ``fit_rows``.

    ``unit_zero`` divides by 1 where the deviation is 0; otherwise 1e-8 is added to it.
    """
    cells = (df if fit_rows is None else fit_rows).select(*keys, F.posexplode(vector).alias("__p", "__v"))
    stats = cells.groupBy(*keys, "__p").agg(F.avg("__v").alias("m"), F.stddev_pop("__v").alias("s"))
    s = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")) if unit_zero else F.col("s") + EPS_NORM
    model = (stats.withColumn("s", s).groupBy(*keys)
             .agg(F.sort_array(F.collect_list(F.struct("__p", "m", "s"))).alias("__ms")))
    return (df.join(model, list(keys))
            .withColumn(vector, F.zip_with(vector, "__ms", lambda x, q: (x - q["m"]) / q["s"])).drop("__ms"))


def pack_targets(responses: DataFrame, keys: Sequence[str], item: str, target: str, value: str, block: int = 512) -> DataFrame:
    """Long responses to one vector per (keys, target block, item); blocks bound the vector length."""
    rows = responses.withColumn("target_block", F.floor(F.col(target) / block).cast("int"))
    packed = rows.groupBy(*keys, "target_block", item).agg(F.sort_array(F.collect_list(F.struct(target, value))).alias("__c"))
    return packed.select(*keys, "target_block", item, F.col("__c").getField(value).alias("y"),
                         F.col("__c").getField(target).alias("target_ids"))


def semantic_encoding(semantic: DataFrame, responses: DataFrame, keys: Sequence[str], item: str, k: int,
                      fit_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Semantic vectors to PCA per layer to a single-split encoder per key.

    The basis is fitted per layer on all rows, or on at most ``fit_rows`` randomly ordered ones if given.
    """
    ready = cut_lineage(semantic.withColumn("__row", F.concat_ws("-", item, "token")))
    sample = None if fit_rows is None else random_subset(ready, ["layer"], "__row", fit_rows, seed)
    scores = pca(ready, ["layer"], "__row", "vector", k, "x", sample)
    rows = ready.select("layer", "__row", "token", item).join(scores.select("layer", "__row", "x"), ["layer", "__row"])
    return single_split_ridge(rows.join(responses, item), ["layer", "token", *keys], item, "x", "y", seed=seed)
