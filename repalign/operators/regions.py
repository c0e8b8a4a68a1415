"""Target selection: atlas labels, probability maps, region groups and size gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col

# Stage of each region, and how right-hemisphere labels are numbered.
VISUAL = ("V1", "V2", "V3", "V4", "early_visual", "FFA", "PPA", "EBA", "VWFA", "ventral_stream")
FUSION = ("STS", "AG", "TPOJ", "lateral_stream", "parietal_stream")
LANGUAGE = ("Broca", "IFG_extended", "auditory_assoc", "temporal_pole")
RIGHT_OFFSET = 180
# Smallest groups each analysis accepts.
MIN_TARGETS_ENCODING, MIN_TARGETS_PILOT, MIN_TARGETS_RDM, MIN_ITEMS_RDM = 20, 10, 2, 3


def stage_of(region: str | Column) -> Column:
    """visual, fusion, language or other."""
    c = col(region)
    return (F.when(c.isin(*VISUAL), "visual").when(c.isin(*FUSION), "fusion").when(c.isin(*LANGUAGE), "language")
            .otherwise("other"))


def region_labels(spec: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(roi, atlas, hemi, label) from a region table with ``labels`` or ``names`` arrays.

    ``names(name, label)`` resolves names; an unknown name gives no label. A spec side of
    'both' yields one row per side.
    """
    sides = F.explode(F.when(F.col("hemi") == "both", F.array(F.lit("lh"), F.lit("rh"))).otherwise(F.array("hemi")))
    if names is None:
        flat = spec.select("roi", "atlas", "hemi", F.explode("labels").alias("label"))
    else:
        flat = (spec.select("roi", "atlas", "hemi", F.explode("names").alias("name"))
                .join(names.select("name", "label"), "name").drop("name"))
    return flat.select("roi", "atlas", sides.alias("hemi"), "label").distinct()


def unknown_names(spec: DataFrame, names: DataFrame) -> DataFrame:
    """(roi, name) pairs that resolve to nothing."""
    return spec.select("roi", F.explode("names").alias("name")).join(names, "name", "left_anti").select("roi", "name")


def shift_right_labels(labels: DataFrame) -> DataFrame:
    """Volume numbering: right-side labels follow the left ones."""
    return labels.withColumn("label", F.when(F.col("hemi") == "rh", F.col("label") + RIGHT_OFFSET).otherwise(F.col("label")))


def region_targets(atlas: DataFrame, labels: DataFrame) -> DataFrame:
    """(roi, hemi, target_id) of label regions (F2, F6, U3); a target may lie in several regions."""
    return (atlas.join(labels.select("roi", "atlas", "hemi", "label"), ["atlas", "hemi", "label"])
            .select("roi", "hemi", "target_id").distinct())


def named_targets(atlas: DataFrame, spec: DataFrame, names: DataFrame) -> DataFrame:
    """``region_targets`` of regions with ``names`` arrays (F6): names are looked up target by target.

    A name of very many labels is not multiplied by the regions that list it, nor does it go to one task.
    """
    flat = spec.select("roi", "atlas", "hemi", F.explode("names").alias("name")).select(
        "roi", "atlas", F.explode(F.when(F.col("hemi") == "both", F.array(F.lit("lh"), F.lit("rh"))).otherwise(F.array("hemi"))).alias("hemi"), "name").distinct()
    return (atlas.join(names.select("name", "label"), "label").join(flat, ["atlas", "hemi", "name"])
            .select("roi", "hemi", "target_id").distinct())


def probability_targets(atlas: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(roi, hemi, target_id) of probability maps: strictly above the threshold."""
    return atlas.where(F.col("prob") > threshold).select(F.col("atlas").alias("roi"), "hemi", "target_id")


def with_fallback(targets: DataFrame, wanted: DataFrame, general: DataFrame) -> DataFrame:
    """Regions without any target get the general mask, with whatever sides it has."""
    missing = wanted.select("roi").distinct().join(targets, "roi", "left_anti")
    sides = general.agg(F.collect_set(F.coalesce("hemi", F.lit("")))).scalar()
    spread = missing.select("roi", F.explode(sides).alias("__side"))
    filled = spread.join(general.withColumn("__side", F.coalesce("hemi", F.lit(""))), "__side")
    return targets.unionByName(filled.select(*targets.columns))


def region_closure(tree: DataFrame) -> DataFrame:
    """(roi, part) of everything below each region of a table (parent, child), at any depth, by a recursive query.

    A part that is reached in several ways counts once. A tree with a cycle is an error (Spark's limit of levels).
    """
    return tree.sparkSession.sql("""WITH RECURSIVE below(roi, part) AS (
            SELECT parent, child FROM {tree}
            UNION ALL SELECT below.roi, t.child FROM below JOIN {tree} t ON below.part = t.parent)
        SELECT DISTINCT roi, part FROM below""", tree=tree.select("parent", "child"))


def nested_targets(atlas: DataFrame, leaves: DataFrame, tree: DataFrame) -> DataFrame:
    """(roi, hemi, target_id) of leaves and of all regions above them.

    ``leaves`` has (roi, atlas, hemi, labels, threshold); a side of 'both' stands for either. A leaf with a threshold is a
    probability mask of its atlas (strictly above it), any other one a set of labels.
    """
    masks = leaves.where("threshold is not null").select("roi", "atlas", F.col("hemi").alias("__side"), "threshold")
    above = (atlas.join(masks, "atlas").where((F.col("prob") > F.col("threshold")) & ((F.col("__side") == "both") | (F.col("__side") == F.col("hemi"))))
             .select("roi", "hemi", "target_id"))
    own = region_targets(atlas, region_labels(leaves.where("threshold is null"))).unionByName(above).distinct()
    nested = region_closure(tree).join(own.withColumnRenamed("roi", "part"), "part").select("roi", "hemi", "target_id")
    return own.unionByName(nested).distinct()


def unknown_parts(leaves: DataFrame, tree: DataFrame) -> DataFrame:
    """(roi, part) where a part is neither a leaf nor a region with parts of its own."""
    known = leaves.select(F.col("roi").alias("part")).unionByName(tree.select(F.col("parent").alias("part"))).distinct()
    return region_closure(tree).join(known, "part", "left_anti").select("roi", "part")


def region_responses(responses: DataFrame, targets: DataFrame, sides: DataFrame | None = None,
                     ncsnr: DataFrame | None = None) -> DataFrame:
    """Responses of each region's targets, with their reliability.

    The semi join comes first, so targets outside all regions never reach a shuffle of values.
    """
    rows = responses.join(targets.select("hemi", "target_id").distinct(), ["hemi", "target_id"], "left_semi")
    if sides is not None:
        rows = (rows.join(sides, "subject").where((F.col("hemi_used") == "both") | (F.col("hemi_used") == F.col("hemi")))
                .drop("hemi_used"))
    if ncsnr is not None:
        rows = rows.join(ncsnr, ["subject", "hemi", "target_id"])
    return rows.join(targets, ["hemi", "target_id"])


def at_least(df: DataFrame, keys: Sequence[str], minimum: int, count: str | None = None) -> DataFrame:
    """Keep groups with enough rows, or enough distinct values of ``count``."""
    n = F.count_distinct(count) if count else F.count(F.lit(1))
    big = df.groupBy(*keys).agg(n.alias("__n")).where(F.col("__n") >= minimum).select(*keys)
    return df.join(big, list(keys), "left_semi")


def reliable_targets(scores: DataFrame, keys: Sequence[str], r: str, ceiling: str, threshold: float = 0.15,
                     minimum: int = 10) -> DataFrame:
    """Targets with a ceiling above the threshold and a finite r, in groups of at least ten."""
    ok = scores.where((F.col(ceiling) > threshold) & F.col(r).isNotNull() & ~F.isnan(r))
    return at_least(ok, keys, minimum)
