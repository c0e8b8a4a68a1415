"""The ceiling of Pearson RSA from one pass over the rows equals that over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repalign.operators import rankpairs as K, similarity as S
from repalign.plans import similarity as plans

NAMES = ["a", "b", "c"]


def frame(spark, n=40):
    rng = np.random.default_rng(8)
    table = pd.DataFrame({"g": np.arange(n) % 2, "item": np.arange(n), **{c: list(rng.standard_normal((n, w)) + 50) for c, w in zip(NAMES, (4, 7, 5))}})
    return spark.createDataFrame(table, "g int, item bigint, " + ", ".join(f"{c} array<double>" for c in NAMES))


def test_ceiling_of_moments_equals_ceiling_of_pairs(spark):
    """With a constant row, copies, and a group of one item, which has no pair."""
    df = frame(spark).withColumn("a", F.when(F.col("item") == 4, F.array(*[F.lit(2.0)] * 4)).otherwise(F.col("a")))
    df = df.unionByName(df.where("item IN (6, 8)").withColumn("item", F.col("item") + 100)).unionByName(df.where("item = 3").withColumn("g", F.lit(9)))
    want = {r["g"]: list(r) for r in K.rdm_ceiling(df.where("g < 9"), ["g"], "item", NAMES, "pearson").collect()}
    got = {r["g"]: list(r) for r in S.pearson_ceiling(df, ["g"], dict(zip(NAMES, (4, 7, 5)))).collect()}
    assert want.keys() == got.keys() == {0, 1}
    assert all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)


def test_a_subject_of_one_distance_has_no_r(spark):
    df = frame(spark).withColumn("c", F.array(*[F.lit(float(k % 3)) for k in range(5)]))
    got = S.pearson_ceiling(df.where("g = 0"), ["g"], dict(zip(NAMES, (4, 7, 5)))).first()
    two = S.pearson_ceiling(df.where("g = 0"), ["g"], {"a": 4, "b": 7}).first()
    assert got["n_subjects"] == 3 and got["upper"] == pytest.approx(two["upper"], abs=1e-9) and got["lower"] == pytest.approx(two["lower"], abs=1e-9)


def test_the_query_forms_no_pair(spark):
    plan = plans.rsa_noise_ceiling_pearson(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
