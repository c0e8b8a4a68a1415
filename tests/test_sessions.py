"""Session files: round trip, pruning, and the rules for sides."""

import math

import pytest

from repalign.operators import trials as T
from repalign.sources import sessions as W

COLUMNS = "subject string, session int, trial_in_session int, hemi string, target_id int, value double"


@pytest.fixture(scope="module")
def rows():
    out = [(s, n, t, h, v, 100.0 * n + t + v / 8) for s in ("subj 1", "a/b,c") for n in (1, 2, 12) for t in range(5) for h in ("lh", "rh") for v in range(11)
           if not (s == "subj 1" and n == 2 and h == "rh")]
    return [r for k, r in enumerate(out) if k % 7]  # cells without a row


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sessions"))
    extra = [("subj 1", 1, 4, "lh", 10, None), ("subj 1", 1, 3, "lh", 10, math.nan)]
    rest = [r for r in rows if (r[0], r[1], r[2], r[3], r[4]) not in {e[:5] for e in extra}]
    df = spark.createDataFrame(rest + extra + rest[:9], COLUMNS)  # nulls, NaN and repeated rows
    assert W.write_sessions(df, path, 4) == 33
    assert W.write_sessions(df, path, 4) == 33  # again: the same files
    return path, sorted(rest)


def test_round_trip(spark, folder):
    path, want = folder
    for split, parts in ((1, 33), (3 << 20, 17), (1 << 30, 1)):  # every size packs all files
        df = W.read_sessions(spark, path, split=split)
        assert df.rdd.getNumPartitions() == parts and sorted(map(tuple, df.collect())) == want
    assert {tuple(r) for r in W.read_session_files(spark, path).collect()} == {(r[0], r[1], r[3]) for r in want}


def test_options_prune_files(spark, folder):
    path, want = folder
    df = W.read_sessions(spark, path, ["a/b,c"], [2, 12], ["rh"], split=1)
    assert df.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, df.collect())) == [r for r in want if r[0] == "a/b,c" and r[1] in (2, 12) and r[3] == "rh"]
    assert W.read_sessions(spark, path, []).count() == 0 and W.read_sessions(spark, path, ["none"]).count() == 0


def test_filters_prune_files_and_targets(spark, folder):
    path, want = folder
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        df = W.read_sessions(spark, path, split=1).where("subject = 'subj 1' AND hemi IN ('lh', 'rh') AND session = 1 AND target_id IN (2, 3, 9) AND value > 101")
        assert df.rdd.getNumPartitions() == 6
        assert sorted(map(tuple, df.collect())) == [r for r in want if r[0] == "subj 1" and r[1] == 1 and r[4] in (2, 3, 9) and r[5] > 101]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_empty_folders_and_bad_sides(spark, tmp_path):
    assert W.read_sessions(spark, f"{tmp_path}/none").count() == 0 and W.read_session_files(spark, f"{tmp_path}/none").count() == 0
    assert W.write_sessions(spark.createDataFrame([], COLUMNS), str(tmp_path)) == 0
    with pytest.raises(Exception, match="unknown side"):
        W.write_sessions(spark.createDataFrame([("a", 1, 0, "up", 0, 1.0)], COLUMNS), str(tmp_path))


def test_sides_follow_the_files(spark, folder):
    path, want = folder
    data, files = W.read_sessions(spark, path), W.read_session_files(spark, path)

    def kept(**how):
        return {(r.subject, r.session, r.hemi, r.hemi_used) for r in T.session_responses(data, files, **how).collect()}

    assert {(s, n) for s, n, _, u in kept() if u == "both"} == {("subj 1", 1), ("subj 1", 12), ("a/b,c", 1), ("a/b,c", 2), ("a/b,c", 12)}
    assert {(s, n, h) for s, n, h, _ in kept(side="lh", max_sessions=2)} == {(s, n, "lh") for s in ("subj 1", "a/b,c") for n in (1, 2)}
    only_left = data.where("subject <> 'subj 1' OR hemi = 'lh'"), files.where("subject <> 'subj 1' OR hemi = 'lh'")
    got = {(r.subject, r.session, r.hemi_used) for r in T.session_responses(*only_left).collect()}
    assert {g for g in got if g[0] == "subj 1"} == {("subj 1", n, "lh") for n in (1, 2, 12)}
    assert all(r.subject != "subj 1" for r in T.session_responses(*only_left, fallback=False).collect())
    sizes = spark.createDataFrame([("a/b,c", 11)], "subject string, n_left int")
    places = T.joined_sides(T.session_responses(data.where("subject = 'a/b,c'"), files), sizes)
    assert {(r.hemi, r.target_id, r.target_pos) for r in places.collect()} == {("lh", v, v) for v in range(11)} | {("rh", v, v + 11) for v in range(11)}


def test_region_responses_where_filters_are_pushed(spark):
    """A filter pushed for the left side must not reach the rows of both."""
    from repalign.plans import catalog
    from oracle import compare, connect

    before, name, d = spark.conf.get("spark.sql.python.filterPushdown.enabled"), "session_region_responses", "/root/testdata/sf0.001"
    try:
        for value in ("true", "false"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", value)
            ok, note = compare(spark, connect(d), d, name, catalog.QUERIES[name], catalog.ORACLE[name])
            assert ok, note
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
