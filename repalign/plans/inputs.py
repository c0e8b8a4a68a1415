"""Views of the given tables in the layouts the operators expect.

The tables carry no neural meaning; the mapping is structural. The first half of an embedding is
what subjects answer with (four subjects of eight targets), the second half what models hold (four
layers of eight elements): no target is among its predictors, and the two together are the whole vector.
Where no model takes part, six subjects answer with the first 48 elements (``ALL_SUBJECTS``). The SQL twins below are used by the agreement checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

N_SUBJECTS, N_TARGETS, N_LAYERS, LAYER_WIDTH, MODEL_AT = 4, 8, 4, 8, 32
N_ALL_SUBJECTS = 6
LAYERS, SUBJECTS = [f"L{k}" for k in range(N_LAYERS)], [f"S{s}" for s in range(N_SUBJECTS)]
ALL_SUBJECTS = [f"S{s}" for s in range(N_ALL_SUBJECTS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, item_id, label, e): one row per embedding, all in group 0.

    The group is computed, not a literal: joins on a literal key lose their key in the optimizer.
    """
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.pmod("vec_id", F.lit(1)).cast("int").alias("g"), F.col("vec_id").alias("item_id"), "label",
                    F.col("embedding").cast("array<double>").alias("e"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, item_id, label, vis, txt): two halves of each embedding."""
    return items(spark, sf_dir).select("g", "item_id", "label", F.slice("e", 1, 32).alias("vis"), F.slice("e", 33, 32).alias("txt"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, item_id, L0..L3, S0..S3): layers and subjects as eight-element slices."""
    e = items(spark, sf_dir)
    cols = [F.slice("e", MODEL_AT + LAYER_WIDTH * k + 1, LAYER_WIDTH).alias(f"L{k}") for k in range(N_LAYERS)]
    cols += [F.slice("e", N_TARGETS * s + 1, N_TARGETS).alias(f"S{s}") for s in range(N_SUBJECTS)]
    return e.select("g", "item_id", *cols)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, item_id, label, vector) in long form."""
    slices = F.array(*[F.slice("e", MODEL_AT + LAYER_WIDTH * k + 1, LAYER_WIDTH) for k in range(N_LAYERS)])
    return items(spark, sf_dir).select("item_id", "label", F.posexplode(slices).alias("layer", "vector"))


def subject_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, item_id, S0..S5): all subjects, for queries without layers."""
    return items(spark, sf_dir).select("g", "item_id", *[F.slice("e", N_TARGETS * s + 1, N_TARGETS).alias(n) for s, n in enumerate(ALL_SUBJECTS)])


def responses(spark: SparkSession, sf_dir: str, n_subjects: int = N_SUBJECTS) -> DataFrame:
    """(subject, item_id, label, target, value)."""
    cells = items(spark, sf_dir).select("item_id", "label", F.posexplode(F.slice("e", 1, n_subjects * N_TARGETS)).alias("p", "value"))
    return cells.select(F.floor(F.col("p") / N_TARGETS).cast("int").alias("subject"), "item_id", "label",
                        F.pmod("p", F.lit(N_TARGETS)).cast("int").alias("target"), "value")


def response_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, item_id, y): the targets of one subject as a vector."""
    slices = F.array(*[F.slice("e", N_TARGETS * s + 1, N_TARGETS) for s in range(N_SUBJECTS)])
    return items(spark, sf_dir).select("item_id", F.posexplode(slices).alias("subject", "y"))


def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, roi, value): mean element of each layer slice by label, a small layer-by-region table."""
    f = features(spark, sf_dir)
    mean = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x) / F.size("vector")
    return f.groupBy("layer", F.col("label").alias("roi")).agg(F.avg(mean).alias("value"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, item, ts, event_id, value): events as presentations of items to subjects."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("subject"), F.get_json_object("props", "$.k").cast("int").alias("item"),
                    "ts", "event_id", "event_type", "value")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pos, category, area): line items as annotated objects of an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("pos"), F.col("p_brand").alias("category"),
                    F.col("p_type").alias("super"), F.col("l_extendedprice").alias("area")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, gt, pred): each user turn with the assistant turn that follows it."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gt"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return user.join(reply, ["conv_id", "turn"])


# ---- the same views in SQL ---------------------------------------------------------------

EMB = "emb AS (SELECT vec_id AS item_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
RESP, ALL_RESP = (EMB + f", resp AS (SELECT s.s::INT AS subject, t.t::INT AS target, item_id, label, e[{N_TARGETS}*s.s + t.t + 1] AS value "
                  f"FROM emb, range({n}) s(s), range({N_TARGETS}) t(t))" for n in (N_SUBJECTS, N_ALL_SUBJECTS))
FEAT = (EMB + f", feat AS (SELECT k.k::INT AS layer, item_id, label, e[({MODEL_AT}+{LAYER_WIDTH}*k.k+1):({MODEL_AT}+{LAYER_WIDTH}*k.k+{LAYER_WIDTH})] AS v "
        f"FROM emb, range({N_LAYERS}) k(k))")
SEG = (EMB + f", seg AS (SELECT 'L' || k.k AS segment, item_id, label, e[({MODEL_AT}+8*k.k+1):({MODEL_AT}+8*k.k+8)] AS v FROM emb, range({N_LAYERS}) k(k) "
       f"UNION ALL SELECT 'S' || k.k, item_id, label, e[(8*k.k+1):(8*k.k+8)] FROM emb, range({N_SUBJECTS}) k(k))")
SUBJECT_SEG = EMB + f", seg AS (SELECT 'S' || k.k AS segment, item_id, label, e[(8*k.k+1):(8*k.k+8)] AS v FROM emb, range({N_ALL_SUBJECTS}) k(k))"
VIEWS = ("views AS (SELECT user_id AS subject, (props->>'$.k')::INT AS item, ts, event_id, event_type, value FROM events)")
ANNOT = ("annot AS (SELECT l_orderkey AS image_id, l_linenumber AS pos, p_brand AS category, p_type AS super, l_extendedprice AS area "
         "FROM lineitem JOIN part ON l_partkey = p_partkey)")
ANSWERS = ("answers AS (SELECT u.conv_id, u.turn, u.text AS gt, a.text AS pred FROM conversations u JOIN conversations a "
           "ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')")


def unit_rows(source: str, vector: str, keep: str, name: str = "unit") -> str:
    """CTEs that centre each row vector and divide by its norm floored at 1e-8."""
    return (f"{name}_m AS (SELECT {keep}, {vector} AS w, list_avg({vector}) AS m FROM {source}), "
            f"{name}_c AS (SELECT {keep}, list_transform(w, lambda x: x - m) AS w FROM {name}_m), "
            f"{name}_n AS (SELECT {keep}, w, greatest(sqrt(list_inner_product(w, w)), 1e-8) AS n FROM {name}_c), "
            f"{name} AS (SELECT {keep}, list_transform(w, lambda x: x / n) AS u FROM {name}_n)")


def pair_distances(unit: str, keys: str = "", name: str = "pairs") -> str:
    """CTE of correlation distances i < j within ``keys``."""
    on = "".join(f" AND a.{k} = b.{k}" for k in keys.split())
    cols = "".join(f"a.{k}, " for k in keys.split())
    return (f"{name} AS (SELECT {cols}a.item_id AS i, b.item_id AS j, 1 - greatest(-1.0, least(1.0, list_inner_product(a.u, b.u))) AS d "
            f"FROM {unit} a JOIN {unit} b ON a.item_id < b.item_id{on})")


def avg_rank(value: str, partition: str = "") -> str:
    over = f"PARTITION BY {partition} " if partition else ""
    same = f"PARTITION BY {partition}, {value}" if partition else f"PARTITION BY {value}"
    return f"(rank() OVER ({over}ORDER BY {value}) + (count(*) OVER ({same}) - 1) / 2.0)"


def r_of(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0))"


def student_sql(t: str, df: str) -> str:
    """Two-sided Student p by Simpson's rule on the density from 0 to |t|."""
    def dens(x):
        return f"pow(1 + ({x})*({x})/({df}), -(({df})+1)/2.0)"
    n = 2000
    h = f"(abs({t})/{n}.0)"
    grid = (f"(list_sum(list_transform(range(1, {n}), lambda k: (CASE WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END) * {dens('k*' + h)})) "
            f"+ 1.0 + {dens(f'abs({t})')})")
    return (f"(1 - 2 * exp(lgamma((({df})+1)/2.0) - lgamma(({df})/2.0)) / sqrt(({df}) * pi()) * {grid} * {h} / 3.0)")
