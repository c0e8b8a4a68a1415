"""Queries on summary matrices and reports (sections R, A, J, W and M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import pearson
from ..operators import inference as I, order as O, rankpairs as K, ridge as G, similarity as S, summaries as R
from ..session import cut_lineage
from .inputs import LAYERS, SUBJECTS, EMB, FEAT, avg_rank, features, items, r_of, region_scores, response_vectors, segments, streams, student_sql, table
from .registry import query
from .similarity import SEG_RANKS

SCORES = f"{FEAT}, sc AS (SELECT layer, label AS roi, avg(list_avg(v)) AS value FROM feat GROUP BY ALL)"
# Layers of documents, tasks by language, scores by quality.
DOCS = "ds AS (SELECT (doc_id % 32)::INT AS layer, lang, quality::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"
RANGES = ("early", 0, 10), ("middle", 11, 22), ("late", 23, 31), ("none", 40, 41)
RANGES_SQL = "rg AS (SELECT * FROM (VALUES ('early', 0, 10), ('middle', 11, 22), ('late', 23, 31), ('none', 40, 41)) r(stage, lo, hi))"


def doc_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select(
        F.pmod("doc_id", F.lit(32)).cast("int").alias("layer"), "lang", F.col("quality").cast("double").alias("score"))


def ranges(spark):
    return spark.createDataFrame(list(RANGES), "stage string, lo int, hi int")


LAYER_MEANS = f"{DOCS}, lm AS (SELECT lang, layer, avg(score) AS score FROM ds GROUP BY ALL)"


def layer_means(spark, d):
    return doc_scores(spark, d).groupBy("lang", "layer").agg(F.avg("score").alias("score"))


@query("stage_means", f"WITH {LAYER_MEANS}, {RANGES_SQL} SELECT l.lang, stage, avg(score) AS score FROM (SELECT DISTINCT lang FROM lm) l CROSS JOIN rg LEFT JOIN lm ON lm.lang = l.lang AND layer BETWEEN lo AND hi GROUP BY ALL", "score")
def stage_means(spark, d):
    return R.stage_means(layer_means(spark, d), RANGES, ["lang"], "score")


@query("peak_layers", f"WITH {LAYER_MEANS} SELECT lang, layer AS peak_layer, score AS peak_score FROM lm QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, layer) = 1", "peak_score")
def peak_layers(spark, d):
    return R.peak(layer_means(spark, d), ["lang"], "layer", "score")


@query("peak_histogram", f"WITH {LAYER_MEANS}, p AS (SELECT lang, layer FROM lm QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, layer) = 1) SELECT layer AS peak_layer, count(*) AS n FROM p GROUP BY 1")
def peak_histogram(spark, d):
    return R.peak(layer_means(spark, d), ["lang"], "layer", "score").groupBy("peak_layer").agg(F.count(F.lit(1)).alias("n"))


@query("expected_peaks", f"""WITH {LAYER_MEANS}, p AS (SELECT lang, layer AS peak_layer FROM lm QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, layer) = 1)
    SELECT p.lang, peak_layer, peak_layer BETWEEN lo AND hi AS as_expected FROM p JOIN (VALUES ('en', 0, 3), ('fr', 2, 12), ('de', 4, 31), ('es', 6, 10)) x(lang, lo, hi) USING (lang)""")
def expected_peaks(spark, d):
    expected = spark.createDataFrame([("en", 0, 3), ("fr", 2, 12), ("de", 4, 31), ("es", 6, 10)], "lang string, lo int, hi int")
    p = R.expected_peaks(R.peak(layer_means(spark, d), ["lang"], "layer", "score"), expected, "lang", "peak_layer")
    return p.select("lang", "peak_layer", "as_expected")


# Conditions are sources 0..3, measures are the four languages in order: a 4 x 4 matrix of mean length.
CELLS = """cells AS (SELECT substr(source, 4)::INT % 4 AS r, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS c, avg(n_chars) AS v FROM documents GROUP BY ALL)"""


def cells(spark, d):
    lang = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return table(spark, d, "documents").groupBy(F.pmod(F.substring("source", 4, 9).cast("int"), F.lit(4)).alias("r"), lang.alias("c")).agg(F.avg("n_chars").alias("v"))


@query("dissociation_matrix", f"WITH {CELLS} SELECT r, max(v) FILTER (c = 0) AS de, max(v) FILTER (c = 1) AS en, max(v) FILTER (c = 2) AS es, max(v) FILTER (c = 3) AS fr FROM cells GROUP BY r", "de en es fr")
def dissociation_matrix(spark, d):
    w = R.wide(cells(spark, d), "r", "c", "v", [0, 1, 2, 3])
    return w.toDF("r", "de", "en", "es", "fr")


@query("selectivity", f"""WITH {CELLS}, g AS (SELECT r, max(v) FILTER (r = c) AS diagonal, avg(v) FILTER (r <> c) AS off_mean, max(v) FILTER (r <> c) AS off_max FROM cells GROUP BY r)
    SELECT *, diagonal - off_mean AS selectivity, diagonal / greatest(off_max, 1e-6) AS ratio FROM g""", "diagonal off_mean off_max selectivity ratio")
def selectivity(spark, d):
    return R.selectivity(cells(spark, d), "r", "c", "v")


@query("interaction", f"WITH {CELLS} SELECT r, c, v, v - avg(v) OVER (PARTITION BY r) - avg(v) OVER (PARTITION BY c) + avg(v) OVER () AS interaction FROM cells", "v interaction")
def interaction(spark, d):
    return R.interaction(cells(spark, d), "r", "c", "v")


@query("dissociation_stats", f"""WITH {CELLS}, k AS (SELECT r, c, v, {avg_rank('v')} AS rk FROM cells), s AS (SELECT r, max(v) FILTER (r = c) - avg(v) FILTER (r <> c) AS s FROM cells GROUP BY r)
    SELECT avg(v) FILTER (r = c) AS diagonal_mean, avg(v) FILTER (r <> c) AS off_diagonal_mean, sum(rk) FILTER (r = c) - 10 AS u, (SELECT avg(s) FROM s) AS mean_selectivity FROM k""",
       "diagonal_mean off_diagonal_mean u mean_selectivity")
def dissociation_stats(spark, d):
    return R.dissociation_statistics(cells(spark, d), "r", "c", "v").drop("p")


@query("dissociation_p")
def dissociation_p(spark, d):
    return R.dissociation_statistics(cells(spark, d), "r", "c", "v").select("u", "p")


# Streams are event types, regions items mod 11 in the fixed order, layers users mod 4.
ROIS = ("V1", "V2", "V3", "V4", "FFA", "PPA", "EBA", "STS", "AG", "Broca", "IFG_extended")
KNOWN = ", ".join(f"('{k}', {v})" for k, v in R.VISUAL_SCORE.items())
SPEC = (f"ss AS (SELECT (user_id % 4)::INT AS layer, {list(ROIS)}[(props->>'$.k')::INT % 11 + 1] AS roi, event_type AS stream, value FROM events), "
        f"known AS (SELECT * FROM (VALUES {KNOWN}) k(roi, known)), vis AS (SELECT roi, CASE WHEN known > 0 THEN 'visual' ELSE 'language' END AS grp, known FROM known), apart AS (SELECT roi, grp FROM vis WHERE known <> 0)")


def stream_scores(spark, d):
    names = F.array(*[F.lit(r) for r in ROIS])
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(F.pmod("user_id", F.lit(4)).cast("int").alias("layer"), F.element_at(names, F.pmod(k, F.lit(11)) + 1).alias("roi"),
                                            F.col("event_type").alias("stream"), "value")


def known_scores(spark):
    return spark.createDataFrame(list(R.VISUAL_SCORE.items()), "roi string, known double")


CON = f"{SPEC}, con AS (SELECT layer, roi, avg(value) FILTER (stream = 'click') AS a, avg(value) FILTER (stream = 'view') AS b FROM ss GROUP BY ALL)"


@query("specialisation", f"WITH {CON} SELECT layer, roi, a, b, a - b AS difference, (a - b) / (a + b + 1e-8) AS \"index\", coalesce(known, 0) AS known FROM con LEFT JOIN known USING (roi)", 'a b difference "index" known')
def specialisation(spark, d):
    c = R.stream_contrast(stream_scores(spark, d), ["layer", "roi"], "stream", "click", "view", "value")
    return R.with_known_score(c, "roi", known_scores(spark))


@query("specialisation_fit", f"""WITH {CON}, x AS (SELECT layer, (a - b) / (a + b + 1e-8) AS v, known FROM con JOIN known USING (roi)), k AS (SELECT layer, v, known, {avg_rank('v', 'layer')} AS ra, {avg_rank('known', 'layer')} AS rb FROM x),
    r AS (SELECT layer, {r_of('ra', 'rb')} AS spearman, {r_of('v', 'known')} AS pearson, count(*) AS n FROM k GROUP BY layer)
    SELECT *, {student_sql('(spearman * sqrt((n - 2) / (1 - spearman * spearman)))', 'n - 2')} AS spearman_p, {student_sql('(pearson * sqrt((n - 2) / (1 - pearson * pearson)))', 'n - 2')} AS pearson_p FROM r""",
       "spearman pearson spearman_p pearson_p")
def specialisation_fit(spark, d):
    c = R.with_known_score(R.stream_contrast(stream_scores(spark, d), ["layer", "roi"], "stream", "click", "view", "value"), "roi", known_scores(spark))
    return R.specialisation_fit(c, ["layer"], "index")


@query("crossover", f"""WITH {SPEC}, m AS (SELECT layer, avg(value) FILTER (grp = 'visual' AND stream = 'click') AS a_first, avg(value) FILTER (grp = 'language' AND stream = 'click') AS a_second,
    avg(value) FILTER (grp = 'visual' AND stream = 'view') AS b_first, avg(value) FILTER (grp = 'language' AND stream = 'view') AS b_second FROM ss JOIN apart USING (roi) GROUP BY layer)
    SELECT *, CASE WHEN a_first > b_first AND b_second > a_second THEN 'double' WHEN a_first > b_first THEN 'single' ELSE 'none' END AS verdict FROM m""", "a_first a_second b_first b_second")
def crossover(spark, d):
    s = R.with_known_score(stream_scores(spark, d), "roi", known_scores(spark))
    return R.crossover(s.withColumn("grp", R.region_class("known")), "grp", "visual", "language", "stream", "click", "view", "value", ["layer"])


@query("win_verdict", f"""WITH {CON}, w AS (SELECT layer, count(*) FILTER (grp = 'visual' AND a > b) AS first_wins, count(*) FILTER (grp = 'visual') AS first_n, count(*) FILTER (grp = 'language' AND a < b) AS second_wins, count(*) FILTER (grp = 'language') AS second_n FROM con JOIN vis USING (roi) GROUP BY layer)
    SELECT *, CASE WHEN first_wins = first_n AND second_wins = second_n THEN 'DOUBLE' WHEN first_wins > first_n // 2 AND second_wins > second_n // 2 THEN 'partial' ELSE '-' END AS verdict FROM w""")
def win_verdict(spark, d):
    c = R.with_known_score(R.stream_contrast(stream_scores(spark, d), ["layer", "roi"], "stream", "click", "view", "value"), "roi", known_scores(spark))
    c = c.withColumn("grp", F.when(F.col("known") > 0, "visual").otherwise("language"))
    return R.win_verdict(c, ["layer"], "grp", "visual", "language")


@query("contrast_t", f"""WITH {CON}, x AS (SELECT grp, a - b AS v FROM con JOIN vis USING (roi)), g AS (SELECT count(*) FILTER (grp = 'visual') AS n_a, count(*) FILTER (grp = 'language') AS n_b, avg(v) FILTER (grp = 'visual') AS mean_a, avg(v) FILTER (grp = 'language') AS mean_b, var_samp(v) FILTER (grp = 'visual') AS va, var_samp(v) FILTER (grp = 'language') AS vb FROM x),
    t AS (SELECT n_a, n_b, mean_a, mean_b, (n_a + n_b - 2)::DOUBLE AS df, (mean_a - mean_b) / sqrt(((n_a-1)*va + (n_b-1)*vb) / (n_a+n_b-2) * (1.0/n_a + 1.0/n_b)) AS t FROM g) SELECT *, {student_sql('t', 'df')} AS p FROM t""", "mean_a mean_b df t p")
def contrast_t(spark, d):
    """Equal-variance t of the stream difference between region groups."""
    c = R.with_known_score(R.stream_contrast(stream_scores(spark, d), ["layer", "roi"], "stream", "click", "view", "value"), "roi", known_scores(spark))
    return I.two_sample_t(c, [], F.col("known") > 0, "difference")


@query("labour_report", f"""WITH {CON}, sc AS (SELECT 'L' || layer AS scope, roi, a, b FROM con UNION ALL SELECT 'all', roi, a, b FROM con UNION ALL SELECT 'beyond first', roi, a, b FROM con WHERE layer > 0),
    m AS (SELECT scope, roi, avg(a) - avg(b) AS v FROM sc GROUP BY ALL), x AS (SELECT scope, v, coalesce(known, 0) AS known, CASE WHEN known > 0 THEN 'visual' ELSE 'language' END AS grp FROM m LEFT JOIN known USING (roi) WHERE v IS NOT NULL),
    k AS (SELECT *, {avg_rank('v', 'scope')} AS ra, {avg_rank('known', 'scope')} AS rb FROM x),
    r AS (SELECT scope, {r_of('ra', 'rb')} AS spearman, count(*) AS n, count(*) FILTER (grp = 'visual' AND v > 0) AS first_wins, count(*) FILTER (grp = 'visual') AS first_n,
      count(*) FILTER (grp = 'language' AND v < 0) AS second_wins, count(*) FILTER (grp = 'language') AS second_n FROM k GROUP BY scope)
    SELECT scope, spearman, {student_sql('(spearman * sqrt((n - 2) / (1 - spearman * spearman)))', 'n - 2')} AS spearman_p, first_wins, first_n, second_wins, second_n,
      CASE WHEN first_wins = first_n AND second_wins = second_n THEN 'DOUBLE'
        WHEN scope LIKE 'L%' AND first_wins > first_n // 2 AND second_wins > second_n // 2 THEN 'partial'
        WHEN scope NOT LIKE 'L%' AND (first_wins = first_n OR second_wins = second_n) THEN 'partial' ELSE '-' END AS verdict,
      (SELECT substr(scope, 2)::INT FROM r WHERE scope LIKE 'L%' AND spearman IS NOT NULL ORDER BY spearman DESC, substr(scope, 2)::INT LIMIT 1) AS peak_layer FROM r""",
       "spearman spearman_p")
def labour_report(spark, d):
    return R.labour_report(stream_scores(spark, d), known_scores(spark), "click", "view")


TASKS = ("de", "en", "es", "fr")


@query("stage_task_report", f"""WITH {LAYER_MEANS}, {RANGES_SQL}, st AS (SELECT stage, list_position({[r[0] for r in RANGES]}, stage) AS r, lo, hi FROM rg),
    m AS (SELECT stage, r, l.lang, list_position({list(TASKS)}, l.lang) AS c, avg(score) AS score FROM (SELECT DISTINCT lang FROM lm) l CROSS JOIN st LEFT JOIN lm ON lm.lang = l.lang AND layer BETWEEN lo AND hi GROUP BY ALL),
    g AS (SELECT r, max(score) FILTER (r = c) AS diagonal, coalesce(max(score) FILTER (r <> c), 0) AS off_max FROM m GROUP BY r HAVING max(score) FILTER (r = c) IS NOT NULL),
    p AS (SELECT lang, layer AS peak_layer, score AS peak_score FROM lm QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, layer) = 1)
    SELECT stage, lang, score, diagonal, off_max, diagonal / greatest(off_max, 1e-6) AS ratio, peak_layer, peak_score FROM m LEFT JOIN g USING (r) JOIN p USING (lang)""",
       "score diagonal off_max ratio peak_score")
def stage_task_report(spark, d):
    return R.stage_task_report(layer_means(spark, d), "lang", "score", RANGES, TASKS)


@query("region_class_summary", f"WITH {SPEC} SELECT layer, grp, avg(m) AS mean, min(m) AS min, max(m) AS max, count(m) AS n FROM (SELECT layer, roi, avg(value) AS m FROM ss GROUP BY ALL) JOIN apart USING (roi) GROUP BY ALL", "mean min max")
def region_class_summary(spark, d):
    s = stream_scores(spark, d).groupBy("layer", "roi").agg(F.avg("value").alias("m"))
    s = R.with_known_score(s, "roi", known_scores(spark)).withColumn("grp", R.region_class("known")).where("grp is not null")
    return R.region_class_summary(s, ["layer", "grp"], "m")


@query("layer_region_rollup", f"WITH {SPEC} SELECT layer, roi, avg(value) AS mean, grouping_id(layer, roi) AS level FROM ss GROUP BY ROLLUP (layer, roi)", "mean")
def layer_region_rollup(spark, d):
    return R.layer_region_rollup(stream_scores(spark, d), "layer", "roi", "value")


@query("cross_token_means", f"WITH {FEAT} SELECT layer, avg(m) AS mean FROM (SELECT layer, label, avg(x) AS m FROM (SELECT layer, label, list_avg(v) AS x FROM feat) GROUP BY ALL) GROUP BY layer", "mean")
def cross_token_means(spark, d):
    """Mean over items, then over regions, per layer."""
    return region_scores(spark, d).groupBy("layer").agg(F.avg("value").alias("mean"))


# ---- grids and attention -----------------------------------------------------------------

@query("grid_coherence", f"""WITH {EMB}, g AS (SELECT k.k::INT AS layer, item_id // 20 AS r, item_id % 20 AS c, e[k.k + 1] AS v FROM emb, range(4) k(k)),
    h AS (SELECT a.layer, avg(abs(a.v - b.v)) AS dh FROM g a JOIN g b ON a.layer = b.layer AND a.r = b.r AND b.c = a.c + 1 GROUP BY a.layer),
    w AS (SELECT a.layer, avg(abs(a.v - b.v)) AS dv FROM g a JOIN g b ON a.layer = b.layer AND a.c = b.c AND b.r = a.r + 1 GROUP BY a.layer)
    SELECT layer, (dh + dv) / 2 / (sd + 1e-8) AS coherence FROM h JOIN w USING (layer) JOIN (SELECT layer, stddev_pop(v) AS sd FROM g GROUP BY layer) USING (layer)""", "coherence")
def grid_coherence(spark, d):
    g = items(spark, d).select(F.posexplode(F.slice("e", 1, 4)).alias("layer", "v"), F.floor(F.col("item_id") / 20).alias("r"), F.pmod("item_id", F.lit(20)).alias("c"))
    return R.grid_coherence(g, ["layer"], "r", "c", "v")


# Attention: layer by ship mode of the line, image = supplier, tokens from quantity and line number.
ATT = """att AS (SELECT l_returnflag AS layer, l_suppkey AS image, (l_quantity::INT * 7 + l_linenumber) AS i, (l_partkey % 360)::INT AS j, l_extendedprice AS weight FROM lineitem),
    ap AS (SELECT layer, i, j, avg(weight) AS weight, sqrt((i // 20 - j // 20) * (i // 20 - j // 20) + (i % 20 - j % 20) * (i % 20 - j % 20)) AS dist FROM att WHERE j < i GROUP BY ALL)"""


def attention(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_suppkey").alias("image"),
                                            (F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber")).alias("i"),
                                            F.pmod("l_partkey", F.lit(360)).cast("int").alias("j"), F.col("l_extendedprice").alias("weight"))
    return R.attention_pairs(li, 20)


@query("attention_distance", f"WITH {ATT}, k AS (SELECT layer, {avg_rank('weight', 'layer')} AS a, {avg_rank('dist', 'layer')} AS b FROM ap) SELECT layer, {r_of('a', 'b')} AS r, count(*) AS n FROM k GROUP BY layer", "r")
def attention_distance(spark, d):
    return I.correlate(cut_lineage(attention(spark, d).select("layer", "weight", "dist")), ["layer"], "weight", "dist", with_p=False)


@query("attention_bins", f"WITH {ATT} SELECT layer, floor(dist) + 0.5 AS centre, avg(weight) AS weight, count(*) AS n FROM ap GROUP BY ALL", "centre weight")
def attention_bins(spark, d):
    return R.distance_bins(attention(spark, d), ["layer"])


@query("attention_near_far", f"WITH {ATT} SELECT layer, avg(weight) FILTER (dist < 3) AS near, avg(weight) FILTER (dist > 15) AS far, avg(weight) FILTER (dist < 3) / greatest(avg(weight) FILTER (dist > 15), 1e-10) AS ratio FROM ap GROUP BY layer", "near far ratio")
def attention_near_far(spark, d):
    return R.near_far(attention(spark, d), ["layer"])


# ---- layers across models ----------------------------------------------------------------

# Models are event types with 5, 6, .. layers; regions are items mod 3.
MODELS = ("click", "error", "purchase", "signup", "view")


def model_scores(spark, d):
    names = F.array(*[F.lit(m) for m in MODELS])
    e = table(spark, d, "events").withColumn("m", F.array_position(names, F.col("event_type")).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy(F.col("event_type").alias("model"), F.pmod("user_id", F.col("m") + 4).cast("int").alias("layer"), F.pmod(k, F.lit(3)).alias("roi")).agg(F.avg("value").alias("value"))


MS = f"""ms AS (SELECT event_type AS model, (user_id % (list_position({list(MODELS)}, event_type) + 4))::INT AS layer, ((props->>'$.k')::INT % 3)::INT AS roi, avg(value) AS value FROM events GROUP BY ALL),
    sz AS (SELECT model, max(layer) + 1 AS n FROM ms GROUP BY model)"""


@query("layer_resample", f"""WITH {MS}, p AS (SELECT model, k.k AS k, k.k * (n - 1) / 3.0 AS p FROM sz, range(4) k(k))
    SELECT p.model, k::INT AS k, a.roi, a.value * (1 - (p - floor(p))) + coalesce(b.value, 0) * (p - floor(p)) AS value FROM p JOIN ms a ON a.model = p.model AND a.layer = floor(p) LEFT JOIN ms b ON b.model = p.model AND b.layer = floor(p) + 1 AND b.roi = a.roi""", "value")
def layer_resample(spark, d):
    return R.resample_layers(model_scores(spark, d), "model", "roi", "value", F.lit(4))


CONVERGENCE = f"""WITH {MS}, pr AS (SELECT a.model AS ma, b.model AS mb, least(a.n, b.n) AS t FROM sz a JOIN sz b ON a.model < b.model),
    pt AS (SELECT ma, mb, m.model, k.k, k.k * (n - 1)::DOUBLE / (t - 1) AS p FROM pr JOIN sz m ON m.model IN (ma, mb), range(20) k(k) WHERE k.k < t),
    v AS (SELECT ma, mb, pt.model, k, a.roi, a.value * (1 - (p - floor(p))) + coalesce(b.value, 0) * (p - floor(p)) AS v FROM pt JOIN ms a ON a.model = pt.model AND a.layer = floor(p) LEFT JOIN ms b ON b.model = pt.model AND b.layer = floor(p) + 1 AND b.roi = a.roi),
    x AS (SELECT l.ma, l.mb, l.v AS x, r.v AS y FROM v l JOIN v r ON l.ma = r.ma AND l.mb = r.mb AND l.k = r.k AND l.roi = r.roi AND l.model = l.ma AND r.model = r.mb),
    k AS (SELECT ma, mb, {avg_rank('x', 'ma, mb')} AS a, {avg_rank('y', 'ma, mb')} AS b FROM x)
    SELECT ma AS model_a, mb AS model_b, {r_of('a', 'b')} AS rho, count(*) AS n FROM k GROUP BY ALL"""


@query("model_convergence", CONVERGENCE, "rho")
def model_convergence(spark, d):
    return R.model_convergence(model_scores(spark, d), "model", "roi", "value", MODELS)


@query("convergence_report", f"SELECT *, {student_sql('(rho * sqrt((n - 2) / (1 - rho * rho)))', 'n - 2')} AS p, avg(rho) OVER () AS mean_rho FROM ({CONVERGENCE})", "rho p mean_rho")
def convergence_report(spark, d):
    return R.convergence_report(model_scores(spark, d), "model", "roi", "value", MODELS)


@query("vector_difference", f"WITH {EMB}, x AS (SELECT item_id, list_transform(list_zip(e[1:32], e[33:64]), lambda p: abs(p[1] - p[2])) AS d FROM emb) SELECT item_id, list_avg(d) AS mean_diff, list_max(d) AS max_diff, list_avg(d) < 0.12 AND list_max(d) < 0.5 AS ok FROM x", "mean_diff max_diff")
def vector_difference(spark, d):
    s = streams(spark, d)
    return R.compare_vectors(s.select("item_id", F.col("vis").alias("v")), s.select("item_id", F.col("txt").alias("v")), "item_id", "v", 0.12, 0.5)


@query("vector_difference_all", f"WITH {EMB}, x AS (SELECT item_id, list_transform(list_zip(e[1:32], e[33:64]), lambda p: abs(p[1] - p[2])) AS d FROM emb) SELECT bool_and(list_avg(d) < 0.12 AND list_max(d) < 0.5) AS all_pass, count(*) AS n_checked FROM x")
def vector_difference_all(spark, d):
    return R.all_pass(vector_difference(spark, d))


PERMUTATIONS, RESAMPLES = 5_000, 10_000  # as the reference


@query("rsa_full_table")
def rsa_full_table(spark, d):
    """Observed RSA, interval, p and ceiling per layer against the subject-mean RDM."""
    seg, names, keys = segments(spark, d), LAYERS + SUBJECTS, ["g", "layer"]
    n = len(LAYERS)

    def with_mean(distances):
        return np.hstack([distances[:, :n], distances[:, n:].mean(axis=1, keepdims=True)])

    test = I.permutation_test_rank_rsa_in_tiles(seg, ["g"], "item_id", names, {name: k for k, name in enumerate(LAYERS)}, [n], PERMUTATIONS, before=with_mean)
    ci = I.bootstrap_rank_rsa_of_columns(seg, ["g"], "item_id", names, [(k, n) for k in range(n)], RESAMPLES, before=with_mean)
    ci = ci.withColumn("layer", F.get(F.array(*[F.lit(name) for name in LAYERS]), "a")).drop("a", "b")
    ceiling = K.rdm_ceiling(seg, ["g"], "item_id", SUBJECTS, "spearman")
    out = test.join(ci, keys).join(ceiling, "g")
    return out.select("layer", F.col("observed").alias("rsa"), "p", "ci_low", "ci_high", "upper", "lower")


@query("metric_agreement")
def metric_agreement(spark, d):
    """Do RSA, CKA and the encoder peak at the same layer for each subject?"""
    left, right = LAYERS, SUBJECTS
    seg = segments(spark, d)
    names = lambda df, v: df.select(F.col("right").alias("subject"), F.substring("left", 2, 1).cast("int").alias("layer"), F.col(v).alias("score"))
    rsa = names(S.rsa_matrix(seg, ["g"], "item_id", left, right, "pearson"), "rsa")
    cka = names(S.cka_matrix(seg.select("g", F.concat(*left, *right).alias("z")), ["g"], "z", {n: 8 for n in left}, {n: 8 for n in right}), "cka")
    rows = features(spark, d).select("layer", "item_id", F.col("vector").alias("x")).join(response_vectors(spark, d), "item_id")
    enc = G.fold_local_ridge(rows, ["subject", "layer"], "item_id", "x", "y", pca_dim=None).groupBy(
        F.concat(F.lit("S"), F.col("subject")).alias("subject"), "layer").agg(F.avg("r").alias("score"))
    return R.agreement([R.peak(f, ["subject"], "layer", "score") for f in (rsa, cka, enc)], ["subject"], "peak_layer")


@query("wide_scores", f"WITH {SCORES} SELECT layer, max(value) FILTER (roi = 0) AS r0, max(value) FILTER (roi = 4) AS r4, max(value) FILTER (roi = 9) AS r9 FROM sc GROUP BY layer", "r0 r4 r9")
def wide_scores(spark, d):
    return R.wide(region_scores(spark, d), "layer", "roi", "value", [0, 4, 9]).toDF("layer", "r0", "r4", "r9")


@query("nested_json_report", f"WITH {LAYER_MEANS} SELECT lang, count(*) AS n_layers, min(layer) AS first_layer FROM lm GROUP BY lang")
def nested_json_report(spark, d):
    """The report text of each language, read back for its keys."""
    from ..sources.tables import nested_report

    rep = nested_report(layer_means(spark, d), "lang", "layer", ["score"])
    keys = F.map_keys(F.from_json("report", "map<string, struct<score: double>>"))
    return rep.select("lang", F.size(keys).cast("bigint").alias("n_layers"), F.array_min(F.transform(keys, lambda k: k.cast("int"))).alias("first_layer"))
