"""Regions given by names, names looked up target by target."""

from repalign.operators import regions as Z


def test_named_targets_equal_the_targets_of_resolved_labels(spark):
    spec = spark.createDataFrame([("A", "x", "both", ["n", "m", "n", "none"]), ("B", "x", "lh", ["m"]), ("C", "y", "rh", [])],
                                 "roi string, atlas string, hemi string, names array<string>")
    names = spark.createDataFrame([("n", 1), ("n", 2), ("m", 2), ("m", 3), ("o", 4), (None, 1)], "name string, label int")
    atlas = spark.createDataFrame([("x", h, l, 10 * l + k) for h in ("lh", "rh") for l in (1, 2, 3, 4, None) if l for k in (0, 1)] + [("y", "lh", 1, 99)],
                                  "atlas string, hemi string, label int, target_id int")
    want = Z.region_targets(atlas, Z.region_labels(spec, names)).collect()
    got = Z.named_targets(atlas, spec, names).collect()
    assert sorted(got) == sorted(want) and len(got) == 16


def test_a_name_of_many_labels_is_not_multiplied_by_its_regions(spark):
    spec = spark.range(20).selectExpr("string(id) roi", "string(id) atlas", "'lh' hemi", "array('n') names")
    names = spark.range(3000).selectExpr("'n' name", "int(id) label")
    atlas = spark.range(3000).selectExpr("string(id % 20) atlas", "'lh' hemi", "int(id) label", "int(id) target_id")
    hit = Z.named_targets(atlas, spec, names)
    assert hit.count() == 3000
