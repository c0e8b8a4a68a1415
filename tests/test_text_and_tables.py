"""Text edge cases, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from repalign.functions import scalars as C, text as T
from repalign.operators import features as X, scoring as S, stimuli as M, trials as TR
from repalign.sources import tables as D


def test_normalise_answer(spark):
    rows = [("The Élan, of a  dog!",), ("",), (" An apple_pie ",), ("theory",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.normalise_answer("t")).collect()]
    assert got == ["élan of dog", "", "apple_pie", "theory"]


def test_vqa_rules(spark):
    rows = [("k", "red car", "The red car."), ("k", "", "dog"), ("k", "blue cat sat", "green cat"), ("k", "x", ""), ("k", "a big dog", "dog")]
    df = spark.createDataFrame(rows, "k string, p string, g string")
    assert S.vqa_accuracy(df, ["k"], "p", "g").first()["score"] == pytest.approx((1 + 0.5 + 0.25 + 0.5) / 4)
    empty = df.withColumn("g", F.lit("the"))
    assert S.vqa_accuracy(empty, ["k"], "p", "g").first()["score"] == 0.0


def test_binding_rules(spark):
    rows = [("k", "a red cars and small tree", "Red car near house"), ("k", "plain words here", "some words"), ("k", "x", "")]
    # red-car is found by containment, near-house is not; the second has no pair: 1 of 2 words
    df = spark.createDataFrame(rows, "k string, p string, g string")
    assert S.binding_accuracy(df, ["k"], "p", "g").first()["score"] == pytest.approx((1 + 0.5) / 3)


def test_language_quality(spark):
    text = "one two three. one two three! one two three?"
    got = S.language_quality(spark.createDataFrame([("k", text), ("k", "")], "k string, t string"), ["k"], "t").first()
    words = text.split()
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    rep = sum(1 for t in set(tri) if tri.count(t) > 1) / len(tri)
    assert got["length"] == 4.5 and got["sentence_count"] == 1.5
    assert got["repetition_rate"] == pytest.approx(rep / 2)
    assert got["vocab_richness"] == pytest.approx(len({w.lower() for w in words}) / len(words) / 2)


def test_options_and_exact(spark):
    df = spark.createDataFrame([("k", "It is a Cat or dog", ["dog", "cat"], 0), ("k", "none", ["dog", "cat"], 1)], "k string, p string, o array<string>, c int")
    assert S.option_accuracy(df, ["k"], "p", "o", "c").first()["score"] == 0.5
    assert S.exact_match(df.withColumn("g", F.lit(" CAT")), ["k"], "p", "g").first()["score"] == 0.5


def test_empty_reference_is_filled_from_baseline(spark):
    a = spark.createDataFrame([(0, "visual_recognition", "dog", "cat", "")], "stage int, task string, baseline string, patched string, ground_truth string")
    row = S.performance_drop(a, ["stage"], "task").where("task = 'visual_recognition'").first()
    assert (row["baseline_score"], row["patched_score"], row["drop"]) == (1.0, 0.0, 1.0)


def test_paths_and_crop(spark):
    df = spark.createDataFrame([("val2017", 42, "(0.1, 0.0, 0.5, 0.5)")], "s string, i bigint, b string")
    r = df.select(C.image_path("s", "i", M.SPLITS).alias("p"), C.crop_rectangle(F.lit(100.0), F.lit(25.0), C.crop_fractions("b")).alias("c")).first()
    assert r["p"] == "val2017/000000000042.jpg"
    assert (r["c"]["top"], r["c"]["left"], r["c"]["right"], r["c"]["valid"]) == (2, 50, 50, False)
    with pytest.raises(Exception, match="unknown split"):
        df.select(C.image_path(F.lit("test"), "i", M.SPLITS)).collect()


def test_assert_aligned_fails(spark):
    a, b = spark.range(3).toDF("item"), spark.range(4).toDF("item")
    assert TR.assert_aligned(a, a, "item").count() == 3
    with pytest.raises(Exception, match="id sets differ"):
        TR.assert_aligned(a, b, "item").collect()


def test_shared_items_fallbacks(spark):
    info = spark.createDataFrame([(1, 1, 2, True), (2, 0, 1, False)], "item_id bigint, subject1 int, subject2 int, shared boolean")
    assert [r[0] for r in M.shared_items(info).collect()] == [1]
    assert [r[0] for r in M.shared_items(info.drop("shared")).collect()] == [1]
    assert M.shared_items(info, info.select("item_id")).count() == 2
    with pytest.raises(ValueError):
        M.shared_items(info.select("item_id"))


def test_json_and_csv_readers(spark, tmp_path):
    caps = {"annotations": [{"image_id": 7, "caption": " a cat "}, {"image_id": 7, "caption": "two"}]}
    inst = {"categories": [{"id": 3, "name": "cat", "supercategory": "animal"}],
            "annotations": [{"image_id": 7, "category_id": 3, "bbox": [0.0, 1.0, 2.0, 3.0], "area": 6.0}, {"image_id": 7, "category_id": 9, "bbox": [], "area": 1.0}]}
    for name, body in (("c", caps), ("i", inst), ("m", {"12": {"caption": "x", "n": 2}}),
                       ("t", {"object": [{"image_path": "p", "prompt": "q", "ground_truth": "g"}] * 3}),
                       ("p", {"image_paths": ["a", "b"], "texts": ["s", "t"], "nsd_ids": [1, 2], "coco_ids": [5, 6]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    got = D.read_captions(spark, {"train2017": f"{tmp_path}/c.json"}).orderBy("pos").collect()
    assert [r["caption"] for r in got] == ["a cat", "two"]
    assert {r["category"] for r in D.read_instances(spark, {"train2017": f"{tmp_path}/i.json"}).collect()} == {"cat", "unknown"}
    assert D.read_record_map(spark, f"{tmp_path}/m.json", "caption: string, n: int").first().asDict() == {"item_id": 12, "caption": "x", "n": 2}
    assert D.read_task_lists(spark, f"{tmp_path}/t.json", 2).count() == 2
    assert [(r["item_id"], r["text"]) for r in D.read_pairs(spark, f"{tmp_path}/p.json").collect()] == [(1, "s"), (2, "t")]
    (tmp_path / "s.csv").write_text("nsdId,cocoId,cocoSplit,cropBox,shared1000,subject1,subject2,subject3,subject4,subject5,subject6,subject7,subject8\n"
                                    '0,532481,val2017,"(0, 0, 0.1, 0.1)",True,0,0,0,0,0,0,0,1\n')
    row = D.read_stim_info(spark, f"{tmp_path}/s.csv").first()
    assert row["cocoId"] == 532481 and row["shared1000"] is True


def test_resume_and_partition_overwrite(spark, tmp_path):
    path = f"{tmp_path}/scores"
    wanted = spark.createDataFrame([("V1", 0, 0.1), ("V1", 1, 0.2), ("V2", 0, 0.3)], "roi string, layer int, r double")
    assert D.missing_keys(wanted, spark, path, ["roi", "layer"]).count() == 3
    D.write_scores(wanted.where("roi = 'V1'"), path)
    assert [r["roi"] for r in D.missing_keys(wanted, spark, path, ["roi", "layer"]).collect()] == ["V2"]
    D.write_scores(wanted.where("roi = 'V1' AND layer = 1").withColumn("r", F.lit(0.9)), path)
    order = spark.createDataFrame([("V1", 1), ("V2", 0)], "roi string, ord int")
    assert [(r["layer"], r["r"]) for r in D.read_scores(spark, path, order).collect()] == [(0, 0.1), (1, 0.9)]
    D.write_json_report(D.nested_report(wanted, "roi", "layer", ["r"]), f"{tmp_path}/rep")
    rep = {r["roi"]: json.loads(r["report"]) for r in spark.read.json(f"{tmp_path}/rep").collect()}
    assert rep["V1"]["1"]["r"] == 0.2


def test_layer_pruning(spark, tmp_path):
    f = spark.createDataFrame([("a", 0, "vis", 1, [1.0]), ("a", 3, "vis", 1, [2.0])], "feature_set string, layer int, stream string, item_id bigint, vector array<double>")
    f.write.partitionBy("feature_set", "layer").parquet(f"{tmp_path}/f")
    df = D.read_features(spark, f"{tmp_path}/f", [3])
    assert [r["vector"] for r in df.collect()] == [[2.0]]
    assert "PartitionFilters: [isnotnull(layer" in df._jdf.queryExecution().toString().replace("layer#", "layer") or "PartitionFilters" in df._jdf.queryExecution().toString()


def test_bundles_keep_first_source(spark, tmp_path):
    for name, value in (("a", 1.0), ("b", 2.0)):
        ids = [1] if name == "a" else [1, 2]
        spark.createDataFrame([(i, 0, [value], 0) for i in ids], D.SCHEMAS["feature_bundle"]).write.parquet(f"{tmp_path}/{name}")
    df = D.read_bundles(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    got = {r["item_id"]: r["vector"][0] for r in X.first_source(df, ["item_id", "layer"], "source_priority").collect()}
    assert got == {1: 1.0, 2: 2.0}


def test_random_projection_is_orthonormal(spark):
    eye = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(4)]) for i in range(4)], "i int, v array<double>")
    import numpy as np

    m = np.array([r["v"] for r in X.random_projection(eye, "v", 4, 7).orderBy("i").collect()])
    np.testing.assert_allclose(m @ m.T, np.eye(4), atol=1e-12)


def test_strict_items(spark):
    r = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "subject string, item_id int")
    want = spark.createDataFrame([(1,), (2,)], "item_id int")
    assert TR.requested_items(r, want, "subject", "item_id").count() == 3
    assert {x["subject"] for x in TR.requested_items(r, want, "subject", "item_id", True).collect()} == {"a"}


def test_nested_regions_and_fallback_sides(spark):
    from repalign.operators import regions as Z

    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "leaf"), ("d", "lost")], "parent string, child string")
    assert {tuple(r) for r in Z.region_closure(tree).collect()} == {("a", "b"), ("a", "c"), ("a", "leaf"), ("b", "c"), ("b", "leaf"), ("c", "leaf"), ("d", "lost")}
    atlas = spark.createDataFrame([("x", "lh", 1, 5, 0.2), ("x", "rh", 1, 5, 0.9), ("x", "mid", 2, 6, 0.9), ("x", None, 3, 5, 0.9)], "atlas string, hemi string, target_id int, label int, prob double")
    leaves = spark.createDataFrame([("leaf", "x", "both", [5], None), ("mask", "x", "rh", None, 0.5)], "roi string, atlas string, hemi string, labels array<int>, threshold double")
    got = {tuple(r) for r in Z.nested_targets(atlas, leaves, tree).collect()}
    assert got == {(r, h, 1) for r in ("a", "b", "c", "leaf") for h in ("lh", "rh")} | {("mask", "rh", 1)}
    assert [tuple(r) for r in Z.unknown_parts(leaves, tree).collect()] == [("d", "lost")]
    wanted = spark.createDataFrame([("leaf",), ("new",)], "roi string")
    filled = Z.with_fallback(Z.nested_targets(atlas, leaves, tree), wanted, atlas.select("hemi", "target_id")).where("roi = 'new'")
    assert {(r["hemi"], r["target_id"]) for r in filled.collect()} == {("lh", 1), ("rh", 1), ("mid", 2), (None, 3)}
    nothing = Z.with_fallback(Z.nested_targets(atlas, leaves, tree), wanted, atlas.limit(0).select("hemi", "target_id"))
    assert nothing.where("roi = 'new'").count() == 0
