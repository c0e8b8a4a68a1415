"""Queries on ridge encoders, PCA and noise ceilings (section E).

A ridge with one or two features has a closed form, so those fits are also stated in SQL; the
same code with many features is checked against numpy in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ceiling_from_snr, ceiling_normalised
from ..operators import features as X, inference as I, order as O, ridge as G, summaries as R, wide as W
from .inputs import ALL_RESP, EMB, FEAT, N_ALL_SUBJECTS, features, items, r_of, response_vectors, responses, segments, streams, table
from .registry import query

# x is the element after the targets, y the first eight elements, in long form.
ONE = (EMB + ", long AS (SELECT item_id, e[9] AS x, t.t::INT AS target, e[t.t + 1] AS y FROM emb, range(8) t(t)), "
       "fold AS (SELECT item_id, (ntile(5) OVER (ORDER BY md5('42-' || item_id)) - 1)::INT AS fold FROM emb), "
       "f AS (SELECT item_id, fold, target, x, y, y - avg(y) OVER (PARTITION BY target) AS yc FROM long JOIN fold USING (item_id))")


def one_feature(spark, d):
    return items(spark, d).select("g", "item_id", F.slice("e", 9, 1).alias("x"), F.slice("e", 1, 8).alias("y"))


def train_and_test(rows):
    """Rows of the md5 folds 1 to 4 of 5, and those of fold 0."""
    folds = O.kfold(rows, ["g"], "item_id", 5)
    return folds.where("fold <> 0").drop("fold"), folds.where("fold = 0").drop("fold")


@query("kfold_md5", f"WITH {EMB} SELECT item_id, (ntile(5) OVER (ORDER BY md5('42-' || item_id)) - 1)::INT AS fold FROM emb")
def kfold_md5(spark, d):
    return O.kfold(items(spark, d).select("g", "item_id"), ["g"], "item_id", 5).select("item_id", "fold")


@query("ordered_holdout", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= floor(0.8 * count(*) OVER (PARTITION BY event_type)) AS is_train FROM events")
def ordered_holdout(spark, d):

    return O.ordered_holdout(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id").select("event_id", "is_train")


@query("random_holdout", f"WITH {EMB} SELECT item_id, row_number() OVER (ORDER BY md5('42-' || item_id)) > greatest(1, floor(count(*) OVER () * 0.2)) AS is_train FROM emb")
def random_holdout(spark, d):
    return O.random_holdout(items(spark, d).select("g", "item_id"), ["g"], "item_id").select("item_id", "is_train")


@query("random_subset", f"WITH {FEAT} SELECT layer, item_id FROM feat QUALIFY row_number() OVER (PARTITION BY layer ORDER BY md5('42-' || item_id)) <= 60")
def random_subset(spark, d):
    return O.random_subset(features(spark, d).select("layer", "item_id"), ["layer"], "item_id", 60)


@query("target_stride", """WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p,
    count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id FROM p WHERE p % greatest(1, n // 200) = 0""")
def target_stride(spark, d):

    return O.every_nth(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@query("ridge_fold_local_one_feature", f"""WITH {ONE}, tr AS (SELECT k.k, target, avg(x) AS mu, stddev_pop(x) + 1e-8 AS sd FROM f, range(5) k(k) WHERE fold <> k.k GROUP BY ALL),
    w AS (SELECT tr.k, tr.target, any_value(mu) AS mu, any_value(sd) AS sd, sum((x - mu) / sd * yc) / (sum(((x - mu) / sd) * ((x - mu) / sd)) + 10000) AS w
      FROM f JOIN tr ON f.target = tr.target AND fold <> tr.k GROUP BY ALL),
    p AS (SELECT f.target, yc, (x - mu) / sd * w AS p FROM f JOIN w ON f.target = w.target AND f.fold = w.k)
    SELECT target, {r_of('p', 'yc')} AS r, count(*) AS n FROM p GROUP BY target""", "r")
def ridge_fold_local_one_feature(spark, d):
    return G.fold_local_ridge(one_feature(spark, d), ["g"], "item_id", "x", "y").select("target", "r", "n")


@query("ridge_single_split_one_feature", f"""WITH {ONE}, s AS (SELECT *, dense_rank() OVER (ORDER BY md5('42-' || item_id), item_id) > greatest(1, floor((SELECT count(*) FROM emb) * 0.2)) AS tr FROM long),
    m AS (SELECT target, avg(x) AS mu, stddev_pop(x) + 1e-8 AS sd, avg(y) AS yb FROM s WHERE tr GROUP BY target),
    w AS (SELECT target, sum((x - mu) / sd * (y - yb)) / (sum(((x - mu) / sd) * ((x - mu) / sd)) + 10000) AS w FROM s JOIN m USING (target) WHERE tr GROUP BY target)
    SELECT target, {r_of('(x - mu) / sd * w', 'y')} AS r FROM s JOIN m USING (target) JOIN w USING (target) WHERE NOT tr GROUP BY target""", "r")
def ridge_single_split_one_feature(spark, d):
    return G.single_split_ridge(one_feature(spark, d), ["g"], "item_id", "x", "y").select("target", "r")


@query("ridge_global_scaling_one_feature", f"""WITH {ONE}, z AS (SELECT item_id, fold, target, yc, (x - avg(x) OVER (PARTITION BY target)) / (stddev_pop(x) OVER (PARTITION BY target) + 1e-8) AS z FROM f),
    w AS (SELECT k.k, target, sum(z * yc) / (sum(z * z) + 10) AS w FROM z, range(5) k(k) WHERE fold <> k.k GROUP BY k.k, target)
    SELECT z.target, {r_of('z * w', 'yc')} AS r FROM z JOIN w ON w.k = z.fold AND w.target = z.target GROUP BY z.target""", "r")
def ridge_global_scaling_one_feature(spark, d):
    """One penalty only: with one feature all penalties give the same r inside a fold."""
    return G.optimistic_ridge(one_feature(spark, d), ["g"], "item_id", "x", "y", alphas=(10.0,)).select("target", "r")


TWO_FEATURES = f"""WITH {EMB}, long AS (SELECT item_id, e[9] AS a, e[10] AS b, t.t::INT AS target, e[t.t + 1] AS y FROM emb, range(8) t(t)),
    fold AS (SELECT item_id, ntile(5) OVER (ORDER BY md5('42-' || item_id)) - 1 AS fold FROM emb), f AS (SELECT * FROM long JOIN fold USING (item_id)),
    s AS (SELECT k.k, target, sum(a*a) + 1000 AS aa, sum(a*b) AS ab, sum(b*b) + 1000 AS bb, sum(a*y) AS ay, sum(b*y) AS byy FROM f, range(5) k(k) WHERE fold <> k.k GROUP BY ALL),
    w AS (SELECT k, target, (ay*bb - byy*ab) / (aa*bb - ab*ab) AS wa, (byy*aa - ay*ab) / (aa*bb - ab*ab) AS wb, ay / aa AS w1, byy / bb AS w2 FROM s),
    r AS (SELECT f.target, {r_of('a*wa + b*wb', 'y')} AS r12, {r_of('a*w1', 'y')} AS r1, {r_of('b*w2', 'y')} AS r2
      FROM f JOIN w ON f.target = w.target AND f.fold = w.k GROUP BY f.target)"""


@query("ridge_plain_two_features", f"{TWO_FEATURES} SELECT target, r12*r12 - r2*r2 AS unique_v, r12*r12 - r1*r1 AS unique_l, r1*r1 + r2*r2 - r12*r12 AS shared FROM r", "unique_v unique_l shared")
def ridge_plain_two_features(spark, d):
    z = items(spark, d).select("g", "item_id", F.slice("e", 9, 2).alias("z"), F.slice("e", 1, 8).alias("y"))
    r = G.partitioned_ridge(z, ["g"], "item_id", "z", {"V": [(0, 1)], "L": [(1, 1)], "VL": [(0, 2)]}, "y",
                            fixed_alpha=G.ALPHA_PARTITION, n_components=256)
    return unique_parts(r, ["target"])


@query("variance_report", f"""{TWO_FEATURES}, n AS (SELECT target, pow(4 * stddev_pop(y), 2) AS s FROM long GROUP BY target)
    SELECT target, r1*r1 AS r2_vision, r2*r2 AS r2_language, r12*r12 AS r2_multimodal, r12*r12 - r2*r2 AS unique_vision, r12*r12 - r1*r1 AS unique_language,
      r1*r1 + r2*r2 - r12*r12 AS shared, s / (s + 1.0/3) AS noise_ceiling_r2 FROM r JOIN n USING (target)""",
       "r2_vision r2_language r2_multimodal unique_vision unique_language shared noise_ceiling_r2")
def variance_report(spark, d):
    """The whole result of a variance partition, with the ceiling of each target."""
    z = items(spark, d).select("g", "item_id", F.slice("e", 9, 2).alias("z"), F.slice("e", 1, 8).alias("y"))
    r = G.partitioned_ridge(z, ["g"], "item_id", "z", {"V": [(0, 1)], "L": [(1, 1)], "VL": [(0, 2)]}, "y", fixed_alpha=G.ALPHA_PARTITION, n_components=256)
    snr = z.select("g", F.posexplode("y").alias("target", "v")).groupBy("g", "target").agg((F.stddev_pop("v") * 4).alias("snr"))
    return R.variance_report(r, ["g", "target"], snr).drop("g")


def unique_parts(r, keys):
    """Unique and shared shares of r squared per key."""
    sq = {m: F.max(F.when(F.col("model") == m, F.col("r") * F.col("r"))) for m in ("V", "L", "VL")}
    g = r.groupBy(*keys).agg(*[c.alias(m) for m, c in sq.items()])
    return g.select(*keys, (F.col("VL") - F.col("L")).alias("unique_v"), (F.col("VL") - F.col("V")).alias("unique_l"),
                    (F.col("V") + F.col("L") - F.col("VL")).alias("shared"))


@query("ridge_holdout_one_feature", f"""WITH {ONE}, tr AS (SELECT target, avg(x) AS mu, stddev_pop(x) AS sd FROM f WHERE fold <> 0 GROUP BY target),
    s AS (SELECT f.target, avg(y) AS yb, sum(pow((x - mu) / sd, 2)) AS zz, sum((x - mu) / sd * y) AS zy FROM f JOIN tr USING (target) WHERE fold <> 0 GROUP BY f.target),
    c AS (SELECT item_id, t.t::INT AS target, e[t.t + 1] AS yw, e[t.t + 33] AS yx FROM emb, range(8) t(t)),
    p AS (SELECT target, yw, yx, yb + (x - mu) / sd * zy / (zz + 100) AS p FROM f JOIN tr USING (target) JOIN s USING (target) JOIN c USING (item_id, target) WHERE fold = 0)
    SELECT 'within' AS condition, target, {r_of('p', 'yw')} AS r FROM p GROUP BY target UNION ALL
    SELECT 'cross', target, {r_of('p', 'yx')} FROM p GROUP BY target""", "r")
def ridge_holdout_one_feature(spark, d):
    """One feature: the penalty never changes r, so the first is kept. The first md5 fold is for testing only."""
    train, test = train_and_test(items(spark, d).select("g", "item_id", F.slice("e", 9, 1).alias("x"), F.slice("e", 1, 8).alias("within"), F.slice("e", 33, 8).alias("cross")))
    tests = {name: test.withColumnRenamed(name, "y") for name in ("within", "cross")}
    return G.holdout_ridge(train.withColumnRenamed("within", "y"), tests, ["g"], "item_id", "x", "y").select("condition", "target", "r")


LOO = "(VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0), (100.0), (1000.0)) a(a)"


@query("ridge_loo_one_feature", f"""WITH {ONE}, s AS (SELECT k.k, target, count(*) AS n, avg(x) AS mu, avg(y) AS yb, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy FROM f, range(5) k(k) WHERE fold <> k.k GROUP BY ALL),
    e AS (SELECT s.k, a.a, sum(pow((y - yb - (x - mu) * xy / (xx + a.a)) / (1 - 1.0 / n - (x - mu) * (x - mu) / (xx + a.a)), 2)) AS sq FROM f JOIN s ON f.target = s.target AND f.fold <> s.k, {LOO} GROUP BY ALL),
    best AS (SELECT k, a FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY sq, a) = 1),
    p AS (SELECT f.fold, f.target, y, yb + (x - mu) * xy / (xx + a) AS p FROM f JOIN s ON f.target = s.target AND f.fold = s.k JOIN best ON best.k = s.k)
    SELECT p.fold, target, {r_of('p', 'y')} AS r, any_value(best.a) AS alpha FROM p JOIN best ON best.k = p.fold GROUP BY p.fold, target""", "r alpha")
def ridge_loo_one_feature(spark, d):
    return G.loo_ridge(one_feature(spark, d), ["g"], "item_id", "x", "y").select("fold", "target", "r", "alpha")


@query("ridge_nested_one_feature", f"""WITH {ONE}, tr AS (SELECT k.k, target, avg(x) AS mu, stddev_pop(x) + 1e-8 AS sd FROM f, range(5) k(k) WHERE fold <> k.k GROUP BY ALL),
    w AS (SELECT tr.k, tr.target, any_value(mu) AS mu, any_value(sd) AS sd, sum((x - mu) / sd * yc) / (sum(((x - mu) / sd) * ((x - mu) / sd)) + 1) AS w
      FROM f JOIN tr ON f.target = tr.target AND fold <> tr.k GROUP BY ALL),
    p AS (SELECT f.target, yc, (x - mu) / sd * w AS p FROM f JOIN w ON f.target = w.target AND f.fold = w.k)
    SELECT target, {r_of('p', 'yc')} AS r FROM p GROUP BY target""", "r")
def ridge_nested_one_feature(spark, d):
    return G.nested_ridge(one_feature(spark, d), ["g"], "item_id", "x", "y", alphas=(1.0,)).select("target", "r")


@query("inner_rows", f"""WITH {EMB}, fold AS (SELECT item_id, (ntile(5) OVER (ORDER BY md5('42-' || item_id)) - 1)::INT AS fold FROM emb),
    t AS (SELECT k.k::INT AS k, item_id, row_number() OVER (PARTITION BY k.k ORDER BY item_id DESC) AS p, count(*) OVER (PARTITION BY k.k) AS n FROM fold, range(5) k(k) WHERE fold <> k.k)
    SELECT k, item_id FROM t WHERE p <= greatest(1, n // 5)""")
def inner_rows(spark, d):
    rows = O.kfold(items(spark, d).select("g", "item_id"), ["g"], "item_id", 5)
    marked = G.mark_inner_rows(rows, ["g"], "item_id", 5)
    return marked.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(
        F.expr("(shiftright(mask, k) & 1) = 1")).select("k", "item_id")


def layer_rows(spark, d):
    """(subject, layer, item_id, x, y): every layer against every subject."""
    return features(spark, d).select("layer", "item_id", F.col("vector").alias("x")).join(response_vectors(spark, d), "item_id")


@query("encoding_layer_subject")
def encoding_layer_subject(spark, d):
    r = G.fold_local_ridge(layer_rows(spark, d), ["subject", "layer"], "item_id", "x", "y", pca_dim=6)
    return r.groupBy("subject", "layer").agg(F.avg("r").alias("mean_r"), F.max("r").alias("max_r"),
                                             F.max_by("target", F.struct("r", -F.col("target"))).alias("best_target"))


@query("encoding_nested")
def encoding_nested(spark, d):
    r = G.nested_ridge(layer_rows(spark, d), ["subject", "layer"], "item_id", "x", "y")
    return r.groupBy("subject", "layer").agg(F.avg("r").alias("mean_r"), F.max("alpha").alias("alpha"))


@query("encoding_optimistic")
def encoding_optimistic(spark, d):
    r = G.optimistic_ridge(layer_rows(spark, d), ["subject", "layer"], "item_id", "x", "y", n_components=6)
    return r.groupBy("subject", "layer").agg(F.avg("r").alias("mean_r"), F.median("r").alias("median_r"), F.max("alpha").alias("alpha"))


@query("encoding_loo")
def encoding_loo(spark, d):
    r = G.loo_ridge(layer_rows(spark, d), ["subject", "layer"], "item_id", "x", "y")
    per = r.groupBy("subject", "layer", "target").agg(F.avg("r").alias("r"), F.median("alpha").alias("alpha"))
    return per.groupBy("subject", "layer").agg(F.avg("r").alias("mean_r"), F.median("r").alias("median_r"), F.max("alpha").alias("best_alpha"))


@query("encoding_within_cross")
def encoding_within_cross(spark, d):
    """Within- and cross-condition scores of test items per layer and region of targets.

    A layer is every fourth element from its number on, the targets are all others, so that none predicts itself.
    """
    train, test = train_and_test(items(spark, d).select("g", "item_id", "e"))

    def layer(k, part):
        own, rest = F.filter("e", lambda v, i: i % 4 == k), F.filter("e", lambda v, i: i % 4 != k)
        return F.struct(F.lit(k).alias("layer"), own.alias("x"), F.slice(rest, 1 + 24 * part, 24).alias("y"))

    def rows(df, part):
        layers = [layer(k, part) for k in range(4)]
        return df.select("item_id", F.explode(F.array(*layers)).alias("c")).select("item_id", "c.*")

    r = G.holdout_ridge(rows(train, 0), {"within": rows(test, 0), "cross": rows(test, 1)}, ["layer"], "item_id", "x", "y", n_components=12)
    return (r.withColumn("roi", F.floor(F.col("target") / 8).cast("int")).groupBy("layer", "roi")
            .agg(F.avg(F.when(F.col("condition") == "within", F.col("r"))).alias("within_r"),
                 F.avg(F.when(F.col("condition") == "cross", F.col("r"))).alias("cross_r"), F.max("alpha").alias("alpha")))


@query("encoding_cross_modal")
def encoding_cross_modal(spark, d):
    """r of both streams and r squared of each and of both together."""
    s = streams(spark, d).select("g", "item_id", F.concat("vis", "txt").alias("z")).join(response_vectors(spark, d), "item_id")
    models = {"V": [(32, 16)], "T": [(48, 16)], "VT": [(32, 32)]}  # the half that holds no targets
    r = G.partitioned_ridge(s.drop("g"), ["subject"], "item_id", "z", models, "y")
    g = r.groupBy("subject").agg(*[F.avg(F.when(F.col("model") == m, F.col("r") * F.col("r"))).alias(f"r2_{m}") for m in models],
                                 *[F.avg(F.when(F.col("model") == m, F.col("r"))).alias(f"r_{m}") for m in ("V", "T")])
    return g.withColumn("interaction", F.col("r2_VT") - F.col("r2_V") - F.col("r2_T"))


@query("encoding_variance_partition")
def encoding_variance_partition(spark, d):
    s = streams(spark, d).select("item_id", F.concat("vis", "txt").alias("z")).join(response_vectors(spark, d), "item_id")
    r = G.partitioned_ridge(s, ["subject"], "item_id", "z", {"V": [(32, 16)], "L": [(48, 16)], "VL": [(32, 32)]}, "y", fixed_alpha=G.ALPHA_PARTITION)
    return unique_parts(r, ["subject", "target"])


@query("encoding_token_spatial")
def encoding_token_spatial(spark, d):
    """Every token of every layer against the first region: mean, best r and best target."""
    e = items(spark, d)
    toks = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(t).alias("token"), F.slice("e", 14 * k + 2 * t + 9, 2).alias("x")) for k in range(4) for t in range(7)])
    rows = e.select("item_id", F.slice("e", 1, 8).alias("y"), F.explode(toks).alias("t")).select("item_id", "y", "t.*")
    r = G.fold_local_ridge(rows, ["layer", "token"], "item_id", "x", "y")
    return r.groupBy("layer", "token").agg(F.avg("r").alias("mean_r"), F.max("r").alias("best_r"),
                                           F.max_by("target", F.struct("r", -F.col("target"))).alias("best_target"))


@query("encoding_streams")
def encoding_streams(spark, d):
    """The same encoder per stream (E14) and feature set."""
    halves = F.array(*[F.struct(F.lit(n).alias("stream"), F.slice("e", at, 16).alias("x")) for n, at in (("vis", 33), ("txt", 49))])
    rows = items(spark, d).select("item_id", F.explode(halves).alias("c")).select("item_id", "c.*")
    r = G.fold_local_ridge(rows.join(response_vectors(spark, d), "item_id"), ["subject", "stream"], "item_id", "x", "y", pca_dim=12)
    return r.groupBy("subject", "stream").agg(F.avg("r").alias("mean_r"))


@query("encoding_random_projection")
def encoding_random_projection(spark, d):
    """Control features: an orthonormal random projection of one stream."""
    s = X.random_projection(streams(spark, d).select("g", "item_id", "txt"), "txt", 32, 48)
    y = items(spark, d).select("item_id", F.slice("e", 1, 8).alias("y"))
    return G.fold_local_ridge(s.join(y, "item_id"), ["g"], "item_id", "txt", "y", pca_dim=16).select("target", "r")


@query("encoding_semantic")
def encoding_semantic(spark, d):
    """Top-10 lists over a vocabulary to semantic vectors to encoders per layer and token."""
    from ..functions.vectors import softmax_top_k

    e = items(spark, d)
    toks = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(t).alias("token"), F.slice("e", 28 * k + 14 * t + 1, 14).alias("l")) for k in range(2) for t in range(2)])
    rows = e.select("item_id", F.explode(toks).alias("t")).select("item_id", "t.*")
    topk = softmax_top_k(rows, "l", 10, "topk").select("layer", "token", "item_id", "topk")
    vocab = e.groupBy(F.pmod("label", F.lit(16)).cast("int").alias("token_id"), F.lit(0).alias("z")).agg(
        *[F.avg(F.col("e")[p]).alias(f"c{p}") for p in range(8)]).select("token_id", F.array(*[f"c{p}" for p in range(8)]).alias("vector"))
    sem = X.semantic_vectors(topk, vocab, ["layer", "token", "item_id"])
    y = e.select("item_id", F.slice("e", 57, 8).alias("y"), F.lit(0).alias("subject"))
    r = X.semantic_encoding(sem, y, ["subject"], "item_id", 4)
    return r.groupBy("layer", "token").agg(F.max("r").alias("best_r"), F.avg("r").alias("mean_r"))


@query("pca_explained")
def pca_explained(spark, d):
    """Share of variance and length of the first components per layer."""
    p = G.pca(features(spark, d), ["layer"], "item_id", "vector", 3)
    return p.groupBy("layer").agg(F.max("explained").alias("explained"), F.var_pop(F.col("pc")[0]).alias("v0"),
                                  F.var_pop(F.col("pc")[1]).alias("v1"), F.count(F.lit(1)).alias("n"))


# The larger root of a 2 x 2 covariance.
_TOP = "((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b))"


@query("pca_two_features", f"""WITH {EMB}, s AS (SELECT label, var_pop(e[1]) AS a, covar_pop(e[1], e[64]) AS b, var_pop(e[64]) AS c, count(*) AS n FROM emb GROUP BY label)
    SELECT label, {_TOP} AS variance, {_TOP} / (a + c) AS explained, n FROM s WHERE n > 1""", "variance explained")
def pca_two_features(spark, d):
    """First component of two elements per label, by the passes that form no d x d matrix."""
    e = items(spark, d).select("label", "item_id", F.array(F.col("e")[0], F.col("e")[63]).alias("v"))
    size = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return W.krylov_pca(e, ["label"], "item_id", "v", 1).select("label", F.col("variances")[0].alias("variance"), "explained").join(size.where("n > 1"), "label")


@query("encoding_small_groups")
def encoding_small_groups(spark, d):
    """Many small fits of more features than rows, in the n x n form (E10): the last 56 elements against the first 8."""
    e = items(spark, d).select("label", (F.floor(F.col("item_id") / 300)).alias("block"), "item_id", F.slice("e", 9, 56).alias("x"), F.slice("e", 1, 8).alias("y"))
    r = G.fold_local_ridge(e, ["label", "block"], "item_id", "x", "y", alpha=1.0)
    return r.groupBy("label", "block").agg(F.avg("r").alias("mean_r"), F.max("r").alias("best_r"), F.max("n").alias("n"))


@query("standardise_columns", f"""WITH {FEAT}, c AS (SELECT layer, item_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS p FROM feat),
    z AS (SELECT layer, item_id, p, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM c WINDOW w AS (PARTITION BY layer, p))
    SELECT layer, item_id, max(z) AS top, sum(z) AS total FROM z GROUP BY ALL""", "top total")
def standardise_columns(spark, d):
    z = X.standardise_columns(features(spark, d).select("layer", "item_id", "vector"), ["layer"], "vector")
    return z.select("layer", "item_id", F.array_max("vector").alias("top"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("target_ceiling", f"""WITH {ALL_RESP}, l AS (SELECT *, (sum(value) OVER c - value) / (count(*) OVER c - 1) AS loo FROM resp WINDOW c AS (PARTITION BY item_id, target)),
    r AS (SELECT subject, target, {r_of('value', 'loo')} AS r FROM l GROUP BY ALL) SELECT target, avg(r) AS ceiling, count(r) AS n_subjects FROM r GROUP BY target""", "ceiling")
def target_ceiling(spark, d):
    return I.target_ceiling(responses(spark, d, N_ALL_SUBJECTS), [], "subject", "item_id", "target", "value")


@query("encoding_noise_ceiling", f"""WITH {ALL_RESP}, l AS (SELECT *, (sum(value) OVER c - value) / (count(*) OVER c - 1) AS loo, avg(value) OVER c AS f FROM resp WINDOW c AS (PARTITION BY item_id, target)),
    r AS (SELECT subject, target, {r_of('value', 'f')} AS u, {r_of('value', 'loo')} AS l FROM l GROUP BY ALL), s AS (SELECT subject, avg(u) AS u, avg(l) AS l FROM r GROUP BY subject)
    SELECT avg(u) AS upper, avg(l) AS lower, count(*) AS n_subjects FROM s""", "upper lower")
def encoding_noise_ceiling(spark, d):
    return I.encoding_ceiling(responses(spark, d, N_ALL_SUBJECTS).withColumn("g", F.lit(0)), ["g"], "subject", "item_id", "target", "value").drop("g")


SNR = f"{ALL_RESP}, snr AS (SELECT subject, label AS roi, target, stddev_pop(value) * 4 AS s, {r_of('value', 'value * value')} AS r FROM resp GROUP BY ALL)"


@query("snr_ceiling", f"""WITH {SNR} SELECT roi, avg(c) AS nc_mean, median(c) AS nc_median, stddev_pop(c) AS nc_std, count(*) AS n, avg(s) AS snr_mean,
    avg(CASE WHEN c > 0.05 THEN greatest(-1, least(1, r / c)) ELSE 0 END) AS normalised FROM (SELECT *, sqrt(s*s / (s*s + 1.0/3)) AS c FROM snr) GROUP BY roi""",
       "nc_mean nc_median nc_std snr_mean normalised")
def snr_ceiling(spark, d):
    """Ceilings from signal-to-noise ratios by region, and r over its ceiling."""
    from ..functions.scalars import pearson

    s = responses(spark, d, N_ALL_SUBJECTS).groupBy("subject", F.col("label").alias("roi"), "target").agg(
        (F.stddev_pop("value") * 4).alias("s"), pearson("value", F.col("value") * F.col("value")).alias("r"))
    s = s.withColumn("c", ceiling_from_snr("s")).withColumn("norm", ceiling_normalised("r", "c"))
    mid = O.exact_quantiles(s, ["roi"], "c", {"nc_median": 0.5})
    g = s.groupBy("roi").agg(F.avg("c").alias("nc_mean"), F.stddev_pop("c").alias("nc_std"), F.count(F.lit(1)).alias("n"),
                             F.avg("s").alias("snr_mean"), F.avg("norm").alias("normalised"))
    return g.join(mid, "roi")


@query("ceiling_normalised_encoder", f"""WITH {ALL_RESP}, l AS (SELECT *, (sum(value) OVER c - value) / (count(*) OVER c - 1) AS loo FROM resp WINDOW c AS (PARTITION BY item_id, target)),
    r AS (SELECT subject, label AS roi, target, {r_of('value', 'loo')} AS ceiling, {r_of('value', 'value * loo')} AS r FROM l GROUP BY ALL),
    s AS (SELECT roi, subject, avg(r) AS raw, count(*) FILTER (ceiling > 0.05) AS k, avg(r) FILTER (ceiling > 0.05) AS rel, avg(ceiling) FILTER (ceiling > 0.05) AS ceil FROM r GROUP BY ALL),
    g AS (SELECT roi, avg(raw) AS raw_all, avg(rel) FILTER (k >= 2) AS raw_reliable, avg(ceil) FILTER (k >= 2) AS ceiling FROM s GROUP BY roi)
    SELECT *, CASE WHEN ceiling > 0 THEN raw_reliable / ceiling END AS normalized FROM g""", "raw_all raw_reliable ceiling normalized")
def ceiling_normalised_encoder(spark, d):
    """Raw, reliable and normalised scores by region."""
    from ..functions.scalars import pearson

    l = I.leave_one_out(responses(spark, d, N_ALL_SUBJECTS), ["item_id", "target"], "value", "loo")
    r = l.groupBy("subject", F.col("label").alias("roi"), "target").agg(
        pearson("value", "loo").alias("ceiling"), pearson("value", F.col("value") * F.col("loo")).alias("r"))
    return R.normalised_summary(r, ["roi"], "subject", "r", "ceiling", 0.05, 2)


@query("pearson_by_target", f"WITH {ALL_RESP} SELECT label, target, {r_of('value', 'item_id')} AS r FROM resp GROUP BY ALL", "r")
def pearson_by_target(spark, d):
    from ..functions.scalars import pearson

    return responses(spark, d, N_ALL_SUBJECTS).groupBy("label", "target").agg(pearson("value", "item_id").alias("r"))


@query("loo_mean", f"WITH {ALL_RESP} SELECT subject, item_id, target, (sum(value) OVER c - value) / (count(*) OVER c - 1) AS loo FROM resp WINDOW c AS (PARTITION BY item_id, target)", "loo")
def loo_mean(spark, d):
    return I.leave_one_out(responses(spark, d, N_ALL_SUBJECTS), ["item_id", "target"], "value").select("subject", "item_id", "target", "loo")


@query("common_average", """WITH v AS (SELECT user_id AS item, event_type AS subject, avg(value) AS v FROM events GROUP BY ALL)
    SELECT item, avg(v) AS mean, count(*) AS n FROM v GROUP BY item HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)""", "mean")
def common_average(spark, d):
    """Event types as subjects, users as items (A3)."""
    e = table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("subject"), "value")
    return R.common_average(e, ["item"], "subject", "value")


@query("subject_average", f"WITH {ALL_RESP} SELECT item_id, target, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM resp GROUP BY ALL", "mean std")
def subject_average(spark, d):
    return R.subject_summary(responses(spark, d, N_ALL_SUBJECTS), ["item_id", "target"], "value")
