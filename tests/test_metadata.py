"""Drawn options and metadata records against plain Python."""

import hashlib
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from repalign.operators import stimuli as M


def key(*parts):
    return hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()


def floyd(n, k, seed, item):
    taken = []
    for s in range(k):
        last = n - k + s
        if last >= 0:
            r = int(key(seed, item, s)[:8], 16) % (last + 1)
            taken.append(last if r in taken else r)
    return taken


def test_drawn_places_are_distinct_and_even(spark):
    df = spark.range(3000).crossJoin(spark.createDataFrame([(0,), (1,), (2,), (3,), (5,)], "n int"))
    rows = df.select("id", "n", M.drawn_places(F.col("n"), 3, 7, "id").alias("p")).collect()
    for r in rows:
        assert r.p == floyd(r.n, 3, 7, r.id)
        assert len(set(r.p)) == len(r.p) == min(3, r.n) and all(0 <= x < r.n for x in r.p)
    sets = Counter(tuple(sorted(r.p)) for r in rows if r.n == 5)
    assert set(sets) == set(combinations(range(5), 3)) and max(sets.values()) < 1.25 * min(sets.values())


def test_options_hold_the_truth_once(spark):
    names = ["ant", "bee", "cat", "dog", "elk"]
    rows = [(k, t) for k, t in enumerate(names * 20 + ["object", None])]
    df = spark.createDataFrame(rows, "item int, truth string")
    for size in (1, 2, 5):
        known = F.array(*[F.lit(n) for n in names[:size]])
        for r in M.with_options(df, "truth", known, "item").collect():
            if r.truth is None:
                assert r.options is None and r.correct_idx is None
                continue
            others = [n for n in names[:size] if n != r.truth]
            want = [r.truth] + [others[p] for p in floyd(len(others), 3, 42, r.item)]
            assert r.options == sorted(want, key=lambda c: key(43, r.item, c)) and r.options[r.correct_idx] == r.truth
    assert M.with_options(df, "truth", F.array().cast("array<string>"), "item").where("truth = 'ant'").first().options == ["ant"]


def test_metadata_record_and_prompts(spark):
    items = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "item int, ext int")
    objects = spark.createDataFrame([(10, "cat", 17, 5.0)], "ext int, category string, category_id int, area double")
    texts = spark.createDataFrame([(10, 1, " second "), (10, 0, "first"), (20, 0, "second")], "ext int, pos int, text string")
    counts = spark.createDataFrame([(10, 4)], "ext int, n_objects int")
    names = F.array(F.lit("cat"), F.lit("dog"))
    meta = M.item_metadata(items, objects, M.caption_lists(texts, "ext", ["pos"], "text"), counts, names, "item", "ext")
    got = {r.item: r for r in meta.collect()}
    assert (got[1].category, got[1].category_id, got[1].caption, got[1].all_captions, got[1].n_objects) == ("cat", 17, "first", ["first", "second"], 4)
    assert (got[2].category, got[2].category_id, got[2].all_captions, got[2].main_object_area) == ("object", -1, ["second"], 0.0)
    assert got[3].all_captions == [] and got[3].caption == "" and got[3].no_caption and sorted(got[3].options) == ["cat", "dog", "object"]
    tasks = {(r.item, r.task): r for r in M.task_prompts(meta, "item").collect()}
    assert len(tasks) == 9 and tasks[1, "object"].options is None and tasks[1, "caption"].all_captions == ["first", "second"]
    choice = tasks[1, "category_mc"]
    assert choice.options[choice.correct_idx] == "cat" and ", ".join(choice.options) in choice.prompt


def test_named_files(spark):
    row = spark.range(1).select(*[M.named_file(p, F.lit(73)).alias(f"p{k}") for k, p in enumerate(M.ITEM_FILE_FORMATS)]).first()
    assert tuple(row) == tuple(p.format(73) for p in M.ITEM_FILE_FORMATS)
