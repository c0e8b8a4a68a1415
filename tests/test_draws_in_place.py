"""Bootstrap draws that look their values up where they are made."""

import pytest

from repalign.operators import inference as I
from repalign.plans import catalog
from repalign.plans import inference as plans


def frame(spark):
    """Groups of 70, 64, 9 and one rows, some values null."""
    sizes = {"a": 70, "b": 64, "c": 9, "d": 1}
    return spark.createDataFrame([(g, 1000 * k + 3 * ord(g), float(k * 37 % 101) if k % 11 != 5 else None) for g, n in sizes.items() for k in range(n)],
                                 "g string, id long, v double")


@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_looked_up_draws_equal_joined_ones(spark, monkeypatch, statistic):
    df = frame(spark)
    monkeypatch.setattr(I, "VALUES_PER_TASK", 100)  # fewer than the rows: draws are joined
    want = {r.g: r for r in I.bootstrap_ci(df, ["g"], "id", "v", 13, statistic).collect()}
    monkeypatch.setattr(I, "VALUES_PER_TASK", 1000)
    monkeypatch.setattr(I, "VALUES_PER_ARRAY", 16)
    monkeypatch.setattr(I, "_places_drawn", None)  # no draw moves
    got = {r.g: r for r in I.bootstrap_ci(df, ["g"], "id", "v", 13, statistic).collect()}
    assert set(got) == set("abcd")
    for g, row in got.items():
        assert list(row) == [pytest.approx(x, abs=1e-12) for x in want[g]]


def test_no_draw_is_shuffled(spark):
    df = frame(spark).withColumnRenamed("id", "__p").selectExpr("g", "row_number() OVER (PARTITION BY g ORDER BY __p) - 1L AS __p", "count(*) OVER (PARTITION BY g) AS __n", "v")
    plan = I._values_drawn(df, ["g"], "v", 13, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert "RepartitionByExpression" not in plan[:plan.index("explode(sequence")]  # nothing above the draws


def test_the_mean_takes_the_draws_of_the_reference(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(I, "bootstrap_ci", lambda df, *args: seen.append(args) or df)
    plans.bootstrap_ci_mean(spark, "/root/testdata/sf0.001")
    assert seen == [(["event_type"], "event_id", "value", 10_000)]
    assert "range(10000)" in catalog.ORACLE["bootstrap_ci_mean"]
