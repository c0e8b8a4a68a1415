"""Reports over score tables: peaks, stages, dissociation, specialisation, grids and layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import EPS_NORM, ceiling_from_snr, pearson, specialisation
from ..functions.tails import correlation_p, mann_whitney_p
from .order import average_rank, small_group_rank

# Cut-offs of the reports.
WORST = -9.0
NEAR, FAR, RATIO_FLOOR = 3, 15, 1e-10
MIN_OFF_DIAGONAL = 1e-6
MEAN_TOLERANCE, MAX_TOLERANCE = 5.0, 30.0
VISUAL_SCORE = {"V1": 1.0, "V2": 1.0, "V3": 1.0, "V4": 1.0, "FFA": 0.8, "PPA": 0.8, "EBA": 0.8, "STS": 0.0,
                "AG": -0.5, "Broca": -1.0, "IFG_extended": -0.8}


# ---- peaks and stages --------------------------------------------------------------------

def peak(df: DataFrame, keys: Sequence[str], by: str, value: str) -> DataFrame:
    """Best layer per key, the first on ties; missing scores rank last."""
    score = F.when(F.col(value).isNull() | F.isnan(value), F.lit(WORST)).otherwise(F.col(value))
    best = F.max_by(F.struct(F.col(by).alias("at"), F.col(value).alias("v")), F.struct(score, -F.col(by)))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.at").alias(f"peak_{by}"), F.col("b.v").alias(f"peak_{value}"))


def stage_means(scores: DataFrame, ranges: Sequence[tuple[str, int, int]], keys: Sequence[str], value: str) -> DataFrame:
    """Mean over the layers of each inclusive range (J11); a range without layers gives null.

    ``ranges`` are (stage, lo, hi); one aggregate with a sum and a count per stage serves them all.
    """
    inside = [(stage, F.when(F.col("layer").between(lo, hi), F.col(value))) for stage, lo, hi in ranges]
    means = scores.groupBy(*keys).agg(F.array(*[F.struct(F.lit(stage).alias("stage"), F.avg(v).alias(value)) for stage, v in inside]).alias("__m"))
    return means.select(*keys, F.explode("__m").alias("__s")).select(*keys, "__s.stage", f"__s.{value}")


def expected_peaks(peaks: DataFrame, expected: DataFrame, on: str, at: str) -> DataFrame:
    """Whether each observed peak lies in its expected inclusive range."""
    return (peaks.join(expected, on).withColumn("as_expected", (F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi"))))


def agreement(peaks: Sequence[DataFrame], on: Sequence[str], at: str) -> DataFrame:
    """True where all metrics peak at the same place."""
    out = None
    for p, frame in enumerate(peaks):
        part = frame.select(*on, F.col(at).alias(f"peak_{p}"))
        out = part if out is None else out.join(part, list(on))
    same = F.lit(True)
    for p in range(1, len(peaks)):
        same = same & (F.col("peak_0") == F.col(f"peak_{p}"))
    return out.withColumn("convergent", same)


def wide(df: DataFrame, row: str, column: str, value: str, names: Sequence) -> DataFrame:
    """Matrix view (R7, K6); naming the columns saves a pass."""
    return df.groupBy(row).pivot(column, list(names)).agg(F.first(value))


# ---- dissociation ------------------------------------------------------------------------

def selectivity(cells: DataFrame, row: str, col_: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per row of a matrix: diagonal, mean and largest off-diagonal, index and ratio.

    ``row`` and ``col_`` are zero-based positions; rows beyond the shorter side have no diagonal.
    """
    diag = F.max(F.when(F.col(row) == F.col(col_), F.col(value)))
    off = F.when(F.col(row) != F.col(col_), F.col(value))
    g = cells.groupBy(*keys, row).agg(diag.alias("diagonal"), F.avg(off).alias("off_mean"),
                                      F.coalesce(F.max(off), F.lit(0.0)).alias("off_max")).where(F.col("diagonal").isNotNull())
    return (g.withColumn("selectivity", F.col("diagonal") - F.col("off_mean"))
             .withColumn("ratio", F.col("diagonal") / F.greatest(F.col("off_max"), F.lit(MIN_OFF_DIAGONAL))))


def interaction(cells: DataFrame, row: str, col_: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cell minus row mean minus column mean plus grand mean."""
    keys = list(keys)
    out = cells
    for name, by in (("__r", [*keys, row]), ("__c", [*keys, col_]), ("__t", keys)):
        out = _with_mean(out, cells.groupBy(*by).agg(F.avg(value).alias(name)), by, name)
    return out.withColumn("interaction", F.col(value) - F.col("__r") - F.col("__c") + F.col("__t")).drop("__r", "__c", "__t")


def _with_mean(df: DataFrame, totals: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add a group's total: by a join, or as a scalar where there is but one group."""
    return df.join(totals.select(*keys, name), keys) if keys else df.withColumn(name, totals.select(name).scalar())


def dissociation_statistics(cells: DataFrame, row: str, col_: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Diagonal and off-diagonal mean, mean selectivity, and the rank test of diagonal > rest."""
    keys = list(keys)
    size = cells.groupBy(*keys).agg(F.least(F.max(row), F.max(col_)).alias("__k"))
    square = _with_mean(cells, size, keys, "__k").where((F.col(row) <= F.col("__k")) & (F.col(col_) <= F.col("__k"))).drop("__k")
    on = F.col(row) == F.col(col_)
    ranked = average_rank(square, keys, value, "__rank")
    ties = (square.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("c"))
            .groupBy(*keys).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("__ties")))
    g = ranked.groupBy(*keys).agg(
        F.avg(F.when(on, F.col(value))).alias("diagonal_mean"), F.avg(F.when(~on, F.col(value))).alias("off_diagonal_mean"),
        F.sum(on.cast("int")).alias("__m"), F.sum((~on).cast("int")).alias("__n"),
        F.sum(F.when(on, F.col("__rank")).otherwise(0.0)).alias("__w"))
    g = _with_mean(g, ties, keys, "__ties")
    u = F.col("__w") - F.col("__m") * (F.col("__m") + 1) / 2
    enough = (F.col("__m") >= 3) & (F.col("__n") >= 3)
    sel = selectivity(cells, row, col_, value, keys).groupBy(*keys).agg(F.avg("selectivity").alias("mean_selectivity"))
    out = (g.withColumn("u", F.when(enough, u))
            .withColumn("p", F.when(enough, mann_whitney_p(u, F.col("__m"), F.col("__n"), F.col("__ties")))))
    return _with_mean(out, sel, keys, "mean_selectivity").drop("__m", "__n", "__w", "__ties")


def stage_task_report(scores: DataFrame, task: str, value: str, ranges: Sequence[tuple[str, int, int]], tasks: Sequence[str]) -> DataFrame:
    """(stage, task, mean, diagonal, off_max, ratio, peak_layer, peak value): the stage by task matrix of a layer sweep.

    ``scores`` has one row per (task, layer). Stage k is expected to serve task k: ``ratio`` is its mean there over its largest
    mean elsewhere, null for stages beyond the tasks or without layers. Tasks that are not listed and null scores do not count.
    """
    def place(name, names):
        return F.array_position(F.array(*map(F.lit, names)), F.col(name)) - 1

    listed = scores.where(F.col(task).isin(list(tasks)))
    cells = (stage_means(listed, ranges, [task], value).withColumn("__r", place("stage", [r[0] for r in ranges]))
             .withColumn("__c", place(task, tasks)))
    rows = selectivity(cells, "__r", "__c", value).select("__r", "diagonal", "off_max", "ratio")
    out = cells.join(rows, "__r", "left").join(peak(listed, [task], "layer", value), task)
    return out.select("stage", task, value, "diagonal", "off_max", "ratio", "peak_layer", f"peak_{value}")


# ---- specialisation ----------------------------------------------------------------------

def with_known_score(df: DataFrame, region: str, known: DataFrame) -> DataFrame:
    """Published score of each region, 0 if there is none."""
    return df.join(known.select(region, "known"), region, "left").withColumn("known", F.coalesce("known", F.lit(0.0)))


def region_class(known: str) -> Column:
    """visual or language by the sign of the published score; a score of 0 (STS) is neither."""
    return F.when(F.col(known) > 0, "visual").when(F.col(known) < 0, "language")


def stream_contrast(scores: DataFrame, keys: Sequence[str], stream: str, a: str, b: str, value: str) -> DataFrame:
    """Per key the means of two streams, their difference and specialisation index."""
    def mean(s):
        return F.avg(F.when(F.col(stream) == s, F.col(value)))

    g = scores.groupBy(*keys).agg(mean(a).alias("a"), mean(b).alias("b"))
    return g.withColumn("difference", F.col("a") - F.col("b")).withColumn("index", specialisation("a", "b"))


def specialisation_fit(contrast: DataFrame, keys: Sequence[str], value: str, known: str = "known") -> DataFrame:
    """Spearman and Pearson of the contrast with the known scores over regions.

    A group holds one row per region, so plain windows rank it.
    """
    r = (contrast.withColumn("__a", small_group_rank(keys or [F.lit(0)], value))
         .withColumn("__b", small_group_rank(keys or [F.lit(0)], known)))
    g = r.groupBy(*keys).agg(pearson("__a", "__b").alias("spearman"), pearson(value, known).alias("pearson"),
                             F.count(F.lit(1)).alias("n"))
    return (g.withColumn("spearman_p", correlation_p(F.col("spearman"), F.col("n")))
             .withColumn("pearson_p", correlation_p(F.col("pearson"), F.col("n"))))


def crossover(scores: DataFrame, group: str, first_group: str, second_group: str, stream: str, a: str, b: str,
              value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Does stream a win in the first group and b in the second?"""
    def mean(g, s):
        return F.avg(F.when((F.col(group) == g) & (F.col(stream) == s), F.col(value)))

    m = scores.groupBy(*keys).agg(mean(first_group, a).alias("a_first"), mean(second_group, a).alias("a_second"),
                                  mean(first_group, b).alias("b_first"), mean(second_group, b).alias("b_second"))
    first, second = F.col("a_first") > F.col("b_first"), F.col("b_second") > F.col("a_second")
    return m.withColumn("verdict", F.when(first & second, "double").when(first, "single").otherwise("none"))


def win_verdict(contrast: DataFrame, keys: Sequence[str], group: str, first_group: str, second_group: str,
                difference: str = "difference") -> DataFrame:
    """Wins on each side and DOUBLE, partial or - per key (R6): all, or more than half, on both sides."""
    def n(g, cond=None):
        inside = F.col(group) == g
        return F.sum((inside if cond is None else inside & cond).cast("int"))

    d = F.col(difference)
    g = contrast.groupBy(*keys).agg(n(first_group, d > 0).alias("first_wins"), n(first_group).alias("first_n"),
                                    n(second_group, d < 0).alias("second_wins"), n(second_group).alias("second_n"))
    all_won = (F.col("first_wins") == F.col("first_n")) & (F.col("second_wins") == F.col("second_n"))
    most = ((F.col("first_wins") > F.floor(F.col("first_n") / 2)) & (F.col("second_wins") > F.floor(F.col("second_n") / 2)))
    return g.withColumn("verdict", F.when(all_won, "DOUBLE").when(most, "partial").otherwise("-"))


def labour_report(scores: DataFrame, known: DataFrame, a: str, b: str, first_layer: int = 0) -> DataFrame:
    """Which regions prefer stream ``a`` to ``b``, per layer, over all layers and beyond the first layer.

    ``scores`` has (layer, roi, stream, value). A scope (``L<layer>``, ``all``, ``beyond first``) gets the Spearman r of the
    stream difference with the published scores, its p, and the wins of visual regions for ``a`` and of the others for ``b``.
    DOUBLE: all of both groups; partial: more than half of both in a layer, all of one group in the averages. ``peak_layer`` is
    the layer of the largest r, the first on ties. A region without one of the streams has no difference and no win.
    """
    layers = stream_contrast(scores, ["layer", "roi"], "stream", a, b, "value")
    scopes = F.array_compact(F.array(F.concat(F.lit("L"), F.col("layer").cast("string")), F.lit("all"),
                                     F.when(F.col("layer") > first_layer, F.lit("beyond first"))))
    means = layers.withColumn("scope", F.explode(scopes)).groupBy("scope", "roi").agg((F.avg("a") - F.avg("b")).alias("difference"))
    contrast = with_known_score(means.where("difference is not null"), "roi", known).withColumn(
        "grp", F.when(F.col("known") > 0, "visual").otherwise("language"))
    wins = win_verdict(contrast, ["scope"], "grp", "visual", "language")
    one = (F.col("first_wins") == F.col("first_n")) | (F.col("second_wins") == F.col("second_n"))
    of_layer = F.col("scope").startswith("L")
    verdict = F.when(of_layer | (F.col("verdict") == "DOUBLE"), F.col("verdict")).when(one, "partial").otherwise("-")
    fit = specialisation_fit(contrast, ["scope"], "difference").select("scope", "spearman", "spearman_p")
    out = fit.join(wins.withColumn("verdict", verdict), "scope")
    at = F.when(of_layer & F.col("spearman").isNotNull(), F.substring("scope", 2, 12).cast("int"))
    best = F.max_by(at, F.when(at.isNotNull(), F.struct("spearman", (-at).alias("first"))))
    return out.withColumn("peak_layer", best.over(Window.partitionBy(F.lit(0))))  # a row per layer and two more


# ---- grids, distances, layers ------------------------------------------------------------

def grid_coherence(df: DataFrame, keys: Sequence[str], row: str, col_: str, value: str) -> DataFrame:
    """Mean neighbour difference over the spread of the grid (W6): an equi-join with the shifted grid."""
    keys = list(keys)
    cells = df.select(*keys, row, col_, F.col(value).cast("double").alias("v"))
    moved = F.explode(F.array(F.struct(F.lit("h").alias("dir"), F.col(row).alias("r"), (F.col(col_) + 1).alias("c")),
                              F.struct(F.lit("v").alias("dir"), (F.col(row) + 1).alias("r"), F.col(col_).alias("c"))))
    near = cells.select(*keys, F.col("v").alias("__o"), moved.alias("m")).select(
        *keys, "__o", "m.dir", F.col("m.r").alias(row), F.col("m.c").alias(col_))
    d = near.join(cells, [*keys, row, col_]).groupBy(*keys).agg(
        F.avg(F.when(F.col("dir") == "h", F.abs(F.col("v") - F.col("__o")))).alias("dh"),
        F.avg(F.when(F.col("dir") == "v", F.abs(F.col("v") - F.col("__o")))).alias("dv"))
    spread = cells.groupBy(*keys).agg(F.stddev_pop("v").alias("sd"))
    return d.join(spread, keys).select(*keys, ((F.col("dh") + F.col("dv")) / 2 / (F.col("sd") + EPS_NORM)).alias("coherence"))


def grid_distance(a: Column, b: Column, width: int) -> Column:
    """Distance of two cells numbered row by row."""
    w = F.lit(width)
    dr = F.floor(a / w) - F.floor(b / w)
    dc = F.pmod(a, w) - F.pmod(b, w)
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def attention_pairs(attention: DataFrame, width: int, layer: str = "layer") -> DataFrame:
    """Mean weight per causal, non-self pair with its grid distance."""
    return (attention.where(F.col("j") < F.col("i")).groupBy(layer, "i", "j").agg(F.avg("weight").alias("weight"))
            .withColumn("dist", grid_distance(F.col("i"), F.col("j"), width)))


def distance_bins(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean weight by unit distance bins, labelled by their centre."""
    return (pairs.groupBy(*keys, F.floor("dist").alias("__b")).agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
            .select(*keys, (F.col("__b") + 0.5).alias("centre"), "weight", "n"))


def near_far(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean weight nearby and far away, and their ratio."""
    return pairs.groupBy(*keys).agg(F.avg(F.when(F.col("dist") < NEAR, F.col("weight"))).alias("near"),
                                    F.avg(F.when(F.col("dist") > FAR, F.col("weight"))).alias("far")).withColumn(
        "ratio", F.col("near") / F.greatest(F.col("far"), F.lit(RATIO_FLOOR)))


def _blend(points: DataFrame, keys: Sequence[str], scores: DataFrame, model: str, roi: str, value: str) -> DataFrame:
    """Linear blend of the two layers around each point (keys, model, n, t): k = 0..t-1.

    Both neighbours are found by equality on (model, layer).
    """
    spots = (points.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("t") - 1).cast("int"))))
             .withColumn("__p", F.when(F.col("t") > 1, F.col("k") * (F.col("n") - 1) / (F.col("t") - 1)).otherwise(0.0)))
    low = F.floor("__p")
    ends = F.explode(F.array(F.struct(low.cast("int").alias("layer"), (1 - (F.col("__p") - low)).alias("w")),
                             F.struct((low + 1).cast("int").alias("layer"), (F.col("__p") - low).alias("w"))))
    ends = spots.select(*keys, model, "k", ends.alias("e")).select(*keys, model, "k", "e.layer", F.col("e.w").alias("__w")).where("__w > 0")
    return (scores.select(model, F.col("layer").cast("int").alias("layer"), roi, value).join(ends, [model, "layer"])
            .groupBy(*keys, model, "k", roi).agg(F.sum(F.col(value) * F.col("__w")).alias(value)))


def layer_counts(scores: DataFrame, model: str) -> DataFrame:
    return scores.groupBy(model).agg((F.max("layer") + 1).alias("n"))


def resample_layers(scores: DataFrame, model: str, roi: str, value: str, target: Column) -> DataFrame:
    """Each model's layer curve at ``target`` evenly spaced points, linear in between.

    ``scores`` has (model, layer, roi, value) with layers 0..n-1.
    """
    return _blend(layer_counts(scores, model).withColumn("t", target), [], scores, model, roi, value)


def model_convergence(scores: DataFrame, model: str, roi: str, value: str, names: Sequence[str]) -> DataFrame:
    """Spearman of the layer-by-region matrices of each model pair, at the smaller layer count."""
    both = [(a, b) for p, a in enumerate(names) for b in names[p + 1:]]
    pairs = scores.sparkSession.createDataFrame(both, "model_a string, model_b string")
    n = layer_counts(scores, model)
    sized = (pairs.join(n.select(F.col(model).alias("model_a"), F.col("n").alias("na")), "model_a")
             .join(n.select(F.col(model).alias("model_b"), F.col("n").alias("nb")), "model_b"))
    keys = ["model_a", "model_b"]
    sides = F.explode(F.array(F.struct(F.col("model_a").alias(model), F.col("na").alias("n")),
                              F.struct(F.col("model_b").alias(model), F.col("nb").alias("n"))))
    points = sized.select(*keys, F.least("na", "nb").alias("t"), sides.alias("s")).select(*keys, "t", "s.*")
    curves = _blend(points, keys, scores, model, roi, value)
    cells = curves.groupBy(*keys, "k", roi).agg(F.max(F.when(F.col(model) == F.col("model_a"), F.col(value))).alias("x"),
                                                F.max(F.when(F.col(model) == F.col("model_b"), F.col(value))).alias("y"))
    cells = cells.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = cells.withColumn("__x", small_group_rank(keys, "x")).withColumn("__y", small_group_rank(keys, "y"))
    return ranked.groupBy(*keys).agg(pearson("__x", "__y").alias("rho"), F.count(F.lit(1)).alias("n"))


def convergence_report(scores: DataFrame, model: str, roi: str, value: str, names: Sequence[str]) -> DataFrame:
    """``model_convergence`` with the p of each pair and the mean over all pairs of models."""
    pairs = model_convergence(scores, model, roi, value, names)
    everything = Window.partitionBy(F.lit(0))  # pairs of the listed models
    return (pairs.withColumn("p", correlation_p(F.col("rho"), F.col("n"))).withColumn("mean_rho", F.avg("rho").over(everything)))


def variance_report(r: DataFrame, keys: Sequence[str], snr: DataFrame, names: tuple[str, str, str] = ("V", "L", "VL"), reps: int = 3) -> DataFrame:
    """Squared r of both parts and of the whole, what is unique to a part and shared, and the squared ceiling.

    ``r`` has (keys, model, r), ``snr`` (keys, snr). A key without a ratio has no ceiling.
    """
    v, l, vl = (F.max(F.when(F.col("model") == m, F.col("r") * F.col("r"))).alias(f"r2_{part}")
                for m, part in zip(names, ("vision", "language", "multimodal")))
    v_, l_, both = F.col("r2_vision"), F.col("r2_language"), F.col("r2_multimodal")
    out = r.groupBy(*keys).agg(v, l, vl).join(snr.select(*keys, (ceiling_from_snr("snr", reps) * ceiling_from_snr("snr", reps)).alias("noise_ceiling_r2")), list(keys), "left")
    return out.select(*keys, v_, l_, both, (both - l_).alias("unique_vision"), (both - v_).alias("unique_language"), (v_ + l_ - both).alias("shared"), "noise_ceiling_r2")


# ---- roll-ups ----------------------------------------------------------------------------

def region_class_summary(scores: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, minimum, maximum and count over the regions of a class."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
                                     F.count(value).alias("n"))


def subject_summary(scores: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation and count over subjects, missing values left out (A4)."""
    v = F.when(~F.isnan(value), F.col(value))
    return scores.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def common_average(scores: DataFrame, keys: Sequence[str], subject: str, value: str) -> DataFrame:
    """Mean over subjects of the keys (items, targets) that every subject has (A3)."""
    per = scores.groupBy(*keys, subject).agg(F.avg(value).alias("__v"))
    subjects = scores.select(F.count_distinct(subject)).scalar()
    means = per.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.where(F.col("n") == subjects)


def layer_region_rollup(scores: DataFrame, layer: str, roi: str, value: str) -> DataFrame:
    """Means per (layer, region), per layer and overall in one pass."""
    return scores.rollup(layer, roi).agg(F.avg(value).alias("mean"), F.grouping_id().alias("level"))


def normalised_summary(scores: DataFrame, keys: Sequence[str], subject: str, r: str, ceiling: str, threshold: float = 0.15,
                       minimum: int = 10) -> DataFrame:
    """Raw, reliable raw, ceiling and normalised score per key, averaged over subjects."""
    ok = (F.col(ceiling) > threshold) & F.col(r).isNotNull() & ~F.isnan(r)
    per = scores.groupBy(*keys, subject).agg(F.avg(F.when(~F.isnan(r), F.col(r))).alias("raw"), F.sum(ok.cast("int")).alias("__k"),
                                             F.avg(F.when(ok, F.col(r))).alias("rel"), F.avg(F.when(ok, F.col(ceiling))).alias("ceil"))
    enough = F.col("__k") >= minimum
    g = per.groupBy(*keys).agg(F.avg("raw").alias("raw_all"), F.avg(F.when(enough, F.col("rel"))).alias("raw_reliable"),
                               F.avg(F.when(enough, F.col("ceil"))).alias("ceiling"))
    return g.withColumn("normalized", F.when(F.col("ceiling") > 0, F.col("raw_reliable") / F.col("ceiling")))


def compare_vectors(left: DataFrame, right: DataFrame, key: str, vector: str, mean_tolerance: float = MEAN_TOLERANCE,
                    max_tolerance: float = MAX_TOLERANCE) -> DataFrame:
    """Mean and largest absolute difference per key and whether both are within tolerance."""
    both = left.select(key, F.col(vector).alias("__a")).join(right.select(key, F.col(vector).alias("__b")), key)
    d = both.select(key, F.zip_with("__a", "__b", lambda x, y: F.abs(x - y)).alias("__d"))
    mean = F.aggregate("__d", F.lit(0.0), lambda s, x: s + x) / F.size("__d")
    return (d.select(key, mean.alias("mean_diff"), F.array_max("__d").alias("max_diff"))
            .withColumn("ok", (F.col("mean_diff") < mean_tolerance) & (F.col("max_diff") < max_tolerance)))


def all_pass(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_and("ok").alias("all_pass"), F.count(F.lit(1)).alias("n_checked"))


def convergence_summary(rsa: DataFrame, keys: Sequence[str], value: str = "rsa") -> DataFrame:
    """Mean, deviation and count over units."""
    return subject_summary(rsa, keys, value)
