"""Queries on trials, regions, items and feature tables (sections S, P, F, J, A, U)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import features as X, order as O, regions as Z, stimuli as M, trials as T
from ..session import shared_folder
from ..sources import sessions as W
from .inputs import ALL_RESP, ANNOT, EMB, FEAT, N_ALL_SUBJECTS, RESP, VIEWS, annotations, features, items, responses, table, views
from .registry import query

TRIALS = f"{VIEWS}, tr AS (SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY ts, event_id) - 1)::BIGINT AS trial_idx FROM views)"


def trials(spark, d):
    v = views(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return T.trial_index(v, ["subject"], "t", ["event_id"])


@query("trial_sessions", f"WITH {TRIALS} SELECT event_id, trial_idx, (trial_idx // 10 + 1)::INT AS session, (trial_idx % 10)::INT AS off, (trial_idx // 10)::INT AS session0 FROM tr")
def trial_sessions(spark, d):
    return trials(spark, d).select("event_id", "trial_idx", T.session_of("trial_idx", 1, 10).alias("session"),
                                   T.offset_of("trial_idx", 10).alias("off"), T.session_of("trial_idx", 0, 10).alias("session0"))


@query("rep_index", f"WITH {VIEWS} SELECT event_id, (row_number() OVER (PARTITION BY subject, item ORDER BY event_id) - 1)::BIGINT AS rep FROM views")
def rep_index(spark, d):
    return T.repetition_index(views(spark, d), ["subject", "item"], "event_id").select("event_id", "rep")


@query("rep_average", f"WITH {VIEWS} SELECT event_type, item, avg(value) AS value, count(*) AS n_reps FROM views GROUP BY ALL", "value")
def rep_average(spark, d):
    return T.repetition_average(views(spark, d), ["event_type", "item"], "value")


@query("last_trial", f"WITH {VIEWS} SELECT subject, item, max_by(value, event_id) AS value FROM views GROUP BY ALL", "value")
def last_trial(spark, d):
    return T.last_trial(views(spark, d), ["subject", "item"], "value", "event_id")


FILES = f"{VIEWS}, files AS (SELECT subject, item // 10 AS session, CASE WHEN event_type IN ('click', 'view') THEN 'lh' ELSE 'rh' END AS hemi FROM views)"


def files(spark, d):
    return views(spark, d).select("subject", F.floor(F.col("item") / 10).cast("int").alias("session"),
                                  F.when(F.col("event_type").isin("click", "view"), "lh").otherwise("rh").alias("hemi"))


@query("available_sessions", f"WITH {FILES} SELECT subject, session FROM files GROUP BY ALL HAVING count(DISTINCT hemi) = 2")
def available_sessions(spark, d):
    return T.available_sessions(files(spark, d))


@query("first_sessions", f"WITH {FILES}, a AS (SELECT subject, session FROM files GROUP BY ALL HAVING count(DISTINCT hemi) = 2) SELECT subject, session FROM a QUALIFY dense_rank() OVER (PARTITION BY subject ORDER BY session) <= 3")
def first_sessions(spark, d):
    return T.first_sessions(T.available_sessions(files(spark, d)), 3)


@query("hemisphere_used", f"""WITH {FILES}, s AS (SELECT subject, session, max((hemi = 'lh')::INT) AS l, max((hemi = 'rh')::INT) AS r FROM files GROUP BY ALL),
    g AS (SELECT subject, max(l) AS l, max(r) AS r, max(l * r) AS b FROM s GROUP BY subject)
    SELECT subject, CASE WHEN b = 1 THEN 'both' WHEN l = 1 AND r = 0 THEN 'lh' WHEN r = 1 AND l = 0 THEN 'rh' END AS hemi_used FROM g""")
def hemisphere_used(spark, d):
    return T.hemisphere_used(files(spark, d))


@query("seen_by_all", f"WITH {VIEWS} SELECT item FROM views GROUP BY item HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM views)")
def seen_by_all(spark, d):
    return M.seen_by_all(views(spark, d), "event_type", "item")


@query("shared_trials", f"""WITH {TRIALS}, sh AS (SELECT item FROM views WHERE event_type = 'error'),
    sl AS (SELECT DISTINCT subject, item AS slot, item + 1000 AS item_id FROM views WHERE event_type IN ('click', 'error'))
    SELECT sl.subject, item_id::BIGINT AS item_id, slot, trial_idx FROM sl LEFT JOIN (SELECT * FROM tr WHERE event_type <> 'click') t ON t.subject = sl.subject AND t.item = sl.slot WHERE slot IN (SELECT item FROM sh)""")
def shared_trials(spark, d):
    """Trials of shared items; an item never shown keeps a row without a trial."""
    t = trials(spark, d)
    slots = t.where("event_type IN ('click', 'error')").select("subject", F.col("item").alias("slot"), (F.col("item") + 1000).cast("bigint").alias("item_id")).distinct()
    shared = t.where("event_type = 'error'").select((F.col("item") + 1000).cast("bigint").alias("item_id"))
    shown = t.where("event_type <> 'click'").select("subject", "trial_idx", F.col("item").alias("slot"))
    return T.shared_trials(shown, slots, shared)


@query("requested_lenient", f"WITH {VIEWS}, w AS (SELECT DISTINCT item FROM views WHERE event_type = 'error') SELECT event_type, count(*) AS n, sum(value) AS total FROM views WHERE item IN (SELECT item FROM w) GROUP BY event_type", "total")
def requested_lenient(spark, d):
    v = views(spark, d)
    return T.requested_items(v, v.where("event_type = 'error'"), "event_type", "item").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("requested_strict", f"""WITH {VIEWS}, w AS (SELECT DISTINCT item FROM views WHERE event_type = 'purchase'), f AS (SELECT * FROM views WHERE item IN (SELECT item FROM w)),
    ok AS (SELECT event_type FROM f GROUP BY event_type HAVING count(DISTINCT item) = (SELECT count(*) FROM w)) SELECT event_type, count(*) AS n, sum(value) AS total FROM f WHERE event_type IN (SELECT event_type FROM ok) GROUP BY event_type""", "total")
def requested_strict(spark, d):
    v = views(spark, d)
    return T.requested_items(v, v.where("event_type = 'purchase'"), "event_type", "item", strict=True).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("complete_subjects", f"""WITH {RESP}, r AS (SELECT label AS subject, target % 2 AS c, item_id // 50 AS item_id FROM resp), w AS (SELECT DISTINCT item_id FROM r)
    SELECT subject FROM (SELECT subject, c FROM r GROUP BY ALL HAVING count(DISTINCT item_id) = (SELECT count(*) FROM w)) GROUP BY subject HAVING count(*) = 2""")
def complete_subjects(spark, d):
    r = responses(spark, d).select(F.col("label").alias("subject"), F.pmod("target", F.lit(2)).cast("string").alias("condition"),
                                   F.floor(F.col("item_id") / 50).alias("item_id"))
    return T.complete_subjects(r, r, ["0", "1"])


@query("align_report", "SELECT (SELECT count(*) FROM documents d WHERE EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)) AS common, (SELECT count(*) FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)) AS left_only, (SELECT count(*) FROM labels l WHERE NOT EXISTS (FROM documents d WHERE l.doc_id = d.doc_id)) AS right_only")
def align_report(spark, d):
    return T.alignment_report(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("aligned_ids", f"WITH {FEAT} SELECT count(*) AS n FROM feat")
def aligned_ids(spark, d):
    f, r = features(spark, d), responses(spark, d)
    return T.assert_aligned(f, r, "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("truncate_align", """WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, n_chars FROM documents), b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality FROM labels)
    SELECT pos, n_chars, quality FROM a JOIN b USING (pos)""")
def truncate_align(spark, d):
    return T.truncate_to_common(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", ["n_chars"], ["quality"])


@query("features_with_responses", f"WITH {FEAT}, {RESP.replace(EMB + ', ', '')} SELECT layer, subject, target, count(*) AS n, sum(v[1] * value) AS s FROM feat JOIN resp USING (item_id) GROUP BY ALL", "s")
def features_with_responses(spark, d):
    j = features(spark, d).join(responses(spark, d).drop("label"), "item_id")
    return j.groupBy("layer", "subject", "target").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("vector")[0] * F.col("value")).alias("s"))


@query("feature_dedupe", """SELECT doc_id, arg_min(x, prio) AS x, min(prio)::INT AS source_priority FROM (SELECT doc_id, quality::DOUBLE AS x, 0 AS prio FROM labels UNION ALL SELECT doc_id, n_chars::DOUBLE, 1 FROM documents) GROUP BY doc_id""", "x")
def feature_dedupe(spark, d):
    """Two sources with overlapping ids: the first one wins."""
    a = table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("double")).alias("vector"), F.lit(0).alias("source_priority"))
    b = table(spark, d, "documents").select("doc_id", F.array(F.col("n_chars").cast("double")).alias("vector"), F.lit(1).alias("source_priority"))
    return X.first_source(a.unionByName(b), ["doc_id"], "source_priority").select("doc_id", F.col("vector")[0].alias("x"), "source_priority")


@query("dropped_items", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dropped_items(spark, d):
    return X.dropped_items(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


# ---- regions -----------------------------------------------------------------------------

ATLAS = f"""{EMB}, atlas AS (SELECT 'hcp' AS atlas, CASE WHEN item_id % 2 = 0 THEN 'lh' ELSE 'rh' END AS hemi, item_id::INT AS target_id, label, 0.5 + e[1] AS prob FROM emb)"""
SPEC = "spec AS (SELECT * FROM (VALUES ('V1', 'both', [1, 2]), ('STS', 'both', [2, 3, 4]), ('Broca', 'lh', [7]), ('none', 'rh', [99])) s(roi, hemi, labels))"
ROI = f"{ATLAS}, {SPEC}, rl AS (SELECT roi, hemi, unnest(labels) AS label FROM spec), rt AS (SELECT DISTINCT roi, a.hemi, target_id FROM rl JOIN atlas a ON a.label = rl.label AND (rl.hemi = 'both' OR rl.hemi = a.hemi))"


def atlas(spark, d):
    return items(spark, d).select(F.lit("hcp").alias("atlas"), F.when(F.pmod("item_id", F.lit(2)) == 0, "lh").otherwise("rh").alias("hemi"),
                                  F.col("item_id").cast("int").alias("target_id"), "label", (F.col("e")[0] + 0.5).alias("prob"))


def spec(spark):
    return spark.createDataFrame([("V1", "hcp", "both", [1, 2]), ("STS", "hcp", "both", [2, 3, 4]), ("Broca", "hcp", "lh", [7]), ("none", "hcp", "rh", [99])],
                                 "roi string, atlas string, hemi string, labels array<int>")


@query("roi_mask", f"WITH {ROI} SELECT roi, hemi, target_id FROM rt")
def roi_mask(spark, d):
    return Z.region_targets(atlas(spark, d), Z.region_labels(spec(spark)))


@query("roi_threshold", f"WITH {ATLAS} SELECT label, hemi, count(*) AS n FROM atlas WHERE prob > 0.5 GROUP BY ALL")
def roi_threshold(spark, d):
    a = atlas(spark, d).withColumn("atlas", F.col("label"))
    return Z.probability_targets(a).groupBy(F.col("roi").alias("label"), "hemi").agg(F.count(F.lit(1)).alias("n"))


@query("roi_stage", f"WITH {ROI} SELECT roi, CASE roi WHEN 'V1' THEN 'visual' WHEN 'STS' THEN 'fusion' WHEN 'Broca' THEN 'language' ELSE 'other' END AS stage, count(*) AS n FROM rt GROUP BY ALL")
def roi_stage(spark, d):
    t = Z.region_targets(atlas(spark, d), Z.region_labels(spec(spark)))
    return t.groupBy("roi", Z.stage_of("roi").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("roi_fallback", f"WITH {ROI}, g AS (SELECT hemi, target_id FROM atlas WHERE prob > 0.5) SELECT roi, count(*) AS n FROM (SELECT roi, hemi, target_id FROM rt UNION ALL SELECT roi, g.hemi, g.target_id FROM (SELECT roi FROM spec WHERE roi NOT IN (SELECT roi FROM rt)), g) GROUP BY roi")
def roi_fallback(spark, d):
    t = Z.region_targets(atlas(spark, d), Z.region_labels(spec(spark)))
    general = Z.probability_targets(atlas(spark, d)).select("hemi", "target_id")
    return Z.with_fallback(t, spec(spark), general).groupBy("roi").agg(F.count(F.lit(1)).alias("n"))


NESTED = [("visual", "early"), ("visual", "late"), ("early", "V1"), ("early", "mask"), ("late", "STS"), ("language", "Broca"), ("language", "nowhere")]
LEAVES = [("V1", "both", [1, 2], None), ("STS", "both", [2, 3, 4], None), ("Broca", "lh", [7], None), ("mask", "rh", None, 0.6)]


@query("roi_nested", f"""WITH RECURSIVE {ATLAS}, tree(parent, child) AS (VALUES {", ".join(map(str, NESTED))}),
    leaf(roi, hemi, labels, threshold) AS (VALUES {", ".join(str(x).replace("None", "NULL") for x in LEAVES)}),
    below AS (SELECT parent AS roi, child AS part FROM tree UNION SELECT below.roi, tree.child FROM below JOIN tree ON below.part = tree.parent),
    own AS (SELECT DISTINCT roi, a.hemi, target_id FROM leaf l JOIN atlas a ON (l.hemi = 'both' OR l.hemi = a.hemi) AND CASE WHEN threshold IS NULL THEN list_contains(labels, a.label) ELSE prob > threshold END),
    every AS (SELECT * FROM own UNION SELECT below.roi, hemi, target_id FROM below JOIN own ON own.roi = below.part)
    SELECT roi, hemi, NULL AS unknown, count(*) AS n FROM every GROUP BY roi, hemi
    UNION ALL SELECT roi, NULL, part, 0 FROM below WHERE part NOT IN (SELECT roi FROM leaf) AND part NOT IN (SELECT parent FROM tree)""")
def roi_nested(spark, d):
    """Targets of leaves and of two levels of regions above them, labels or probability masks; names that lead nowhere."""
    tree = spark.createDataFrame(NESTED, "parent string, child string")
    leaves = spark.createDataFrame([(roi, "hcp", hemi, labels, t) for roi, hemi, labels, t in LEAVES], "roi string, atlas string, hemi string, labels array<int>, threshold double")
    sizes = Z.nested_targets(atlas(spark, d), leaves, tree).groupBy("roi", "hemi").agg(F.count(F.lit(1)).alias("n"))
    lost = Z.unknown_parts(leaves, tree).select("roi", F.lit(None).cast("string").alias("hemi"), F.col("part").alias("unknown"), F.lit(0).cast("long").alias("n"))
    return sizes.withColumn("unknown", F.lit(None).cast("string")).unionByName(lost)


@query("roi_by_name", "SELECT p_brand AS roi, p_type AS name, count(*) AS n FROM part GROUP BY ALL")
def roi_by_name(spark, d):
    """Regions given by names: each brand lists its types, each type names its parts."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("roi"), F.col("p_type").alias("name"), F.col("p_partkey").cast("int").alias("label"))
    s = p.select("roi", "name").distinct().groupBy("roi").agg(F.sort_array(F.collect_set("name")).alias("names"))
    s = s.withColumn("atlas", F.col("roi")).withColumn("hemi", F.lit("lh"))
    target = p.select(F.col("roi").alias("atlas"), F.lit("lh").alias("hemi"), "label", F.col("label").alias("target_id"))
    hit = Z.named_targets(target, s, p.select("name", "label"))
    named = p.select(F.col("label").alias("target_id"), "name")
    return hit.join(named, "target_id").groupBy("roi", "name").agg(F.count(F.lit(1)).alias("n"))


@query("roi_responses", f"""WITH {ROI}, v AS (SELECT user_id AS subject, CASE WHEN user_id % 2 = 0 THEN 'lh' ELSE 'rh' END AS hemi, (props->>'$.k')::INT AS target_id, value FROM events)
    SELECT roi, v.hemi, count(*) AS n, avg(value) AS mean FROM v JOIN rt ON rt.hemi = v.hemi AND rt.target_id = v.target_id GROUP BY ALL""", "mean")
def roi_responses(spark, d):
    v = views(spark, d).select("subject", F.when(F.pmod("subject", F.lit(2)) == 0, "lh").otherwise("rh").alias("hemi"), F.col("item").alias("target_id"), "value")
    r = Z.region_responses(v, Z.region_targets(atlas(spark, d), Z.region_labels(spec(spark))))
    return r.groupBy("roi", "hemi").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


SIDES = f"""{RESP}, cells AS (SELECT 'S' || subject AS subject, (item_id // 50 + 1)::INT AS session, CASE WHEN target < 4 THEN 'lh' ELSE 'rh' END AS hemi, target % 4 AS target_id, value FROM resp WHERE subject <> 3 OR target < 4)"""


@query("session_region_responses", f"""WITH {SIDES}, snr AS (SELECT subject, hemi, target_id, abs(avg(value)) AS ncsnr FROM cells GROUP BY ALL),
    rt AS (SELECT * FROM (VALUES ('V1', 'lh', 0), ('V1', 'lh', 1), ('V1', 'rh', 0), ('V1', 'rh', 1), ('STS', 'lh', 1), ('STS', 'lh', 2)) r(roi, hemi, target_id))
    SELECT roi, c.subject, c.hemi, CASE WHEN c.subject = 'S3' THEN 'lh' ELSE 'both' END AS hemi_used, count(*) AS n, count(DISTINCT session) AS n_sessions, max(c.target_id + CASE WHEN c.hemi = 'rh' THEN 4 ELSE 0 END)::INT AS last_pos, avg(value) AS mean, avg(ncsnr) AS reliability
    FROM cells c JOIN rt USING (hemi, target_id) JOIN snr USING (subject, hemi, target_id) GROUP BY ALL""", "mean reliability")
def session_region_responses(spark, d):
    """Responses written as session files and read back: sides by what there is, regions with reliability.

    Sessions of 50 items; one subject has no right side.
    """
    at = F.col("target") < 4
    cells = (responses(spark, d).where(at | (F.col("subject") != 3))
             .select(F.concat(F.lit("S"), "subject").alias("subject"), T.session_of("item_id", size=50).alias("session"), T.offset_of("item_id", 50).alias("trial_in_session"),
                     F.when(at, "lh").otherwise("rh").alias("hemi"), F.pmod("target", F.lit(4)).alias("target_id"), "value"))
    path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    W.write_sessions(cells, path)
    files = W.read_session_files(spark, path)
    left = T.session_responses(W.read_sessions(spark, path, sides=["lh"]), files)  # a read of its own: see read_sessions
    rows = T.joined_sides(T.session_responses(W.read_sessions(spark, path), files),
                          left.groupBy("subject").agg((F.max("target_id") + 1).alias("n_left")))
    labels = spark.createDataFrame([("V1", "lh", 0), ("V1", "lh", 1), ("V1", "rh", 0), ("V1", "rh", 1), ("STS", "lh", 1), ("STS", "lh", 2)], "roi string, hemi string, target_id int")
    snr = cells.groupBy("subject", "hemi", "target_id").agg(F.abs(F.avg("value")).alias("ncsnr"))
    return Z.region_responses(rows, labels, ncsnr=snr).groupBy("roi", "subject", "hemi", "hemi_used").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("n_sessions"), F.max("target_pos").alias("last_pos"),
        F.avg("value").alias("mean"), F.avg("ncsnr").alias("reliability"))


@query("size_gate", "SELECT lang, source, doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY lang, source) >= 10")
def size_gate(spark, d):
    return Z.at_least(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], 10)


# ---- items and annotations ---------------------------------------------------------------

@query("largest_object", f"WITH {ANNOT} SELECT image_id, category, area FROM annot QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, pos) = 1", "area")
def largest_object(spark, d):
    return M.largest_object(annotations(spark, d), "image_id", "area", "pos", ["category", "area"])


@query("multi_object_scenes", f"WITH {ANNOT} SELECT image_id, count(*) AS n_objects, count(DISTINCT category) AS n_categories, list_sort(list(DISTINCT category)) AS categories FROM annot WHERE image_id > 0 GROUP BY image_id HAVING count(DISTINCT category) >= 3")
def multi_object_scenes(spark, d):
    return M.multi_object_scenes(annotations(spark, d), "image_id", "category")


@query("captions_in_order", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, trim(text, ' ') AS caption, count(*) OVER (PARTITION BY conv_id) AS n_captions FROM conversations")
def captions_in_order(spark, d):
    return M.captions_in_order(table(spark, d, "conversations"), "conv_id", ["turn"], "text")


@query("first_caption", "SELECT conv_id, arg_min(trim(text, ' '), turn) AS caption FROM conversations GROUP BY conv_id")
def first_caption(spark, d):
    return M.first_caption(table(spark, d, "conversations"), "conv_id", ["turn"], "text")


@query("external_ids", "SELECT d.doc_id, coalesce(quality, -1)::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def external_ids(spark, d):
    return M.external_id(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality")


OPTIONS = """names AS (SELECT list(DISTINCT p_brand ORDER BY p_brand) AS names FROM part),
    o0 AS (SELECT item, truth, names, coalesce(list_position(names, truth), 0) AS own, len(names) - (own > 0)::INT AS m FROM src, names),
    o1 AS (SELECT *, ('0x' || substr(md5('42-' || item || '-0'), 1, 8))::BIGINT % (m - 2) AS d0, ('0x' || substr(md5('42-' || item || '-1'), 1, 8))::BIGINT % (m - 1) AS r1,
      ('0x' || substr(md5('42-' || item || '-2'), 1, 8))::BIGINT % m AS r2, CASE WHEN r1 = d0 THEN m - 2 ELSE r1 END AS d1, CASE WHEN r2 IN (d0, d1) THEN m - 1 ELSE r2 END AS d2 FROM o0),
    named AS (SELECT item, truth, unnest([truth, names[d0 + 1 + (own > 0 AND d0 >= own - 1)::INT], names[d1 + 1 + (own > 0 AND d1 >= own - 1)::INT], names[d2 + 1 + (own > 0 AND d2 >= own - 1)::INT]]) AS name FROM o1),
    o2 AS (SELECT item, truth, list(name ORDER BY md5('43-' || item || '-' || name)) AS options FROM named GROUP BY item, truth)"""


@query("mc_options", f"WITH src AS (SELECT p_partkey AS item, p_brand AS truth FROM part), {OPTIONS} SELECT item AS p_partkey, options, (list_position(options, truth) - 1)::INT AS correct_idx FROM o2")
def mc_options(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return M.with_options(p, "p_brand", M.category_list(p, "p_brand"), "p_partkey").select("p_partkey", "options", "correct_idx")


@query("color_options", "SELECT p_partkey, greatest(coalesce(list_position(['red','green','blue','yellow','white','black','gray','brown'], split_part(p_name, ' ', 1)), 0) - 1, 0)::INT AS idx FROM part")
def color_options(spark, d):
    _, at = M.color_options(F.element_at(F.split("p_name", " "), 1))
    return table(spark, d, "part").select("p_partkey", at.alias("idx"))


META = f"""{ANNOT}, obj AS (SELECT image_id, category, replace(category, 'Brand#', '')::INT AS category_id, area FROM annot QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, pos) = 1),
    cnt AS (SELECT image_id, count(*) AS n_objects FROM annot GROUP BY image_id), cap AS (SELECT conv_id AS image_id, list(trim(text, ' ') ORDER BY turn) AS all_captions, all_captions[1] AS caption FROM conversations GROUP BY conv_id),
    src AS (SELECT o_orderkey AS item, coalesce(category, 'object') AS truth, coalesce(category_id, -1) AS category_id, coalesce(all_captions, []) AS all_captions, coalesce(caption, '') AS caption, coalesce(n_objects, 0) AS n_objects, coalesce(area, 0) AS area, category IS NULL AS no_objects, caption IS NULL AS no_caption
      FROM orders LEFT JOIN obj ON obj.image_id = o_orderkey LEFT JOIN cnt ON cnt.image_id = o_orderkey LEFT JOIN cap ON cap.image_id = o_orderkey), {OPTIONS}"""


def metadata(spark, d):
    ann = annotations(spark, d).withColumn("category_id", F.regexp_replace("category", "Brand#", "").cast("int"))
    names = M.category_list(table(spark, d, "part").select(F.col("p_brand").alias("category")), "category")
    items_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("image_id"))
    captions = M.caption_lists(table(spark, d, "conversations"), "conv_id", ["turn"], "text").withColumnRenamed("conv_id", "image_id")
    counts = ann.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_objects"))
    return M.item_metadata(items_, M.largest_object(ann, "image_id", "area", "pos", ["category", "category_id", "area"]), captions, counts, names, "item_id", "image_id")


@query("task_metadata", f"""WITH {META} SELECT src.item AS item_id, src.truth AS category, category_id, caption, all_captions, n_objects, area AS main_object_area,
      no_objects, no_caption, options, (list_position(options, src.truth) - 1)::INT AS correct_idx FROM src JOIN o2 USING (item)""", "main_object_area")
def task_metadata(spark, d):
    return metadata(spark, d).select("item_id", "category", "category_id", "caption", "all_captions", "n_objects", "main_object_area", "no_objects",
                                     "no_caption", "options", "correct_idx")


@query("metadata_missing", f"WITH {META} SELECT count(*) AS n, count_if(no_objects)::BIGINT AS missing_objects, count_if(no_caption)::BIGINT AS missing_captions FROM src")
def metadata_missing(spark, d):
    return metadata(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if("no_objects").alias("missing_objects"), F.count_if("no_caption").alias("missing_captions"))


@query("task_prompts", f"""WITH {META}, t AS (SELECT item, src.truth, caption, all_captions, options, (list_position(options, src.truth) - 1)::INT AS idx FROM src JOIN o2 USING (item))
    SELECT item AS item_id, 'object' AS task, '{M.OBJECT_PROMPT}' AS prompt, truth AS ground_truth, NULL::VARCHAR[] AS options, NULL::INT AS correct_idx, NULL::VARCHAR[] AS all_captions FROM t
    UNION ALL SELECT item, 'category_mc', '{M.OPTION_PROMPT[0]}' || array_to_string(options, ', ') || '{M.OPTION_PROMPT[1]}', truth, options, idx, NULL FROM t
    UNION ALL SELECT item, 'caption', '{M.CAPTION_PROMPT}', caption, NULL, NULL, all_captions FROM t""")
def task_prompts(spark, d):
    return M.task_prompts(metadata(spark, d), "item_id")


@query("rotating_prompts", f"""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p, (SELECT ceil(count(*) / 3.0)::BIGINT FROM customer) AS m FROM customer),
    t AS (SELECT {list(M.TASK_PROMPTS)} AS names, {[list(prompts) for prompts in M.TASK_PROMPTS.values()]} AS lists)
    SELECT c_custkey, names[p // m + 1] AS task, lists[p // m + 1][(p % m) % 3 + 1] AS prompt FROM p, t""")
def rotating_prompts(spark, d):
    return M.rotating_prompts(table(spark, d, "customer"), "c_custkey")


@query("chat_prompts", "SELECT o_orderkey, 'USER: ' || o_orderpriority || chr(10) || 'ASSISTANT:' AS prompt FROM orders")
def chat_prompts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.chat_prompt("o_orderpriority").alias("prompt"))


@query("path_resolution", """WITH c AS (SELECT o_orderkey AS item_id, unnest([printf('nsd%05d.png', o_orderkey), printf('nsd-%05d.png', o_orderkey), printf('stimuli_%05d.png', o_orderkey), printf('%d.png', o_orderkey),
      printf('train2017/%012d.jpg', o_custkey), printf('val2017/%012d.jpg', o_custkey), printf('train2014/%012d.jpg', o_custkey), printf('val2014/%012d.jpg', o_custkey), printf('images/train2017/%012d.jpg', o_custkey), printf('images/val2017/%012d.jpg', o_custkey)]) AS path,
      unnest(range(10)) AS prio, o_custkey FROM orders),
    f AS (SELECT printf('nsd-%05d.png', l_orderkey) AS path FROM lineitem WHERE l_returnflag = 'R' UNION SELECT printf('val2014/%012d.jpg', c_custkey) FROM customer WHERE c_acctbal > 0)
    SELECT item_id, arg_min(path, prio) AS path FROM c JOIN f USING (path) WHERE prio < 4 OR o_custkey > 0 GROUP BY item_id""")
def path_resolution(spark, d):
    """First existing file among the candidates (P5, P6); the file list comes from other tables."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("ext_id"))
    local = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.format_string("nsd-%05d.png", "l_orderkey").alias("path"))
    remote = table(spark, d, "customer").where("c_acctbal > 0").select(C.image_path(F.lit("val2014"), "c_custkey", M.SPLITS).alias("path"))
    return M.resolve_path(M.candidate_paths(o, "item_id", "ext_id"), local.unionByName(remote), "item_id")


@query("pair_build", """WITH img AS (SELECT l_orderkey AS item_id, min(l_shipdate)::DATE::VARCHAR AS path FROM lineitem GROUP BY 1), cap AS (SELECT conv_id, arg_min(trim(text, ' '), turn) AS caption FROM conversations GROUP BY conv_id)
    SELECT o_orderkey AS item_id, o_custkey AS ext_id, path, coalesce(caption, 'Describe this image in detail.') AS text FROM orders JOIN img ON item_id = o_orderkey LEFT JOIN cap ON conv_id = o_custkey""")
def pair_build(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("ext_id"))
    images = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.min("l_shipdate").cast("date").cast("string").alias("path"))
    captions = M.first_caption(table(spark, d, "conversations"), "conv_id", ["turn"], "text").select(F.col("conv_id").alias("image_id"), "caption")
    return M.stimulus_pairs(o, images, captions, "item_id", "ext_id")


@query("most_common", f"WITH {ANNOT} SELECT category, count(*) AS n FROM annot GROUP BY category ORDER BY n DESC, category LIMIT 15")
def most_common(spark, d):
    return M.most_common(annotations(spark, d), "category")


@query("crop_box", """WITH b AS (SELECT p_partkey, p_size AS s, '(' || (p_size / 200.0)::DECIMAL(6,3)::VARCHAR || ', 0.1, ' || (p_size / 100.0)::DECIMAL(6,3)::VARCHAR || ', 0.5)' AS box FROM part),
    f AS (SELECT p_partkey, s, (s / 200.0)::DECIMAL(6,3)::DOUBLE AS t, 0.1 AS bo, (s / 100.0)::DECIMAL(6,3)::DOUBLE AS l, 0.5 AS r FROM b),
    q AS (SELECT p_partkey, round_even(640.0::DOUBLE * l, 0)::INT AS "left", round_even(480.0::DOUBLE * t, 0)::INT AS top, round_even(640.0::DOUBLE * (1 - r), 0)::INT AS "right", round_even(480.0::DOUBLE * (1 - bo), 0)::INT AS bottom FROM f)
    SELECT *, "right" > "left" AND bottom > top AS valid FROM q""")
def crop_box(spark, d):
    p = table(spark, d, "part")
    box = F.concat(F.lit("("), (F.col("p_size") / 200.0).cast("decimal(6,3)").cast("string"), F.lit(", 0.1, "),
                   (F.col("p_size") / 100.0).cast("decimal(6,3)").cast("string"), F.lit(", 0.5)"))
    r = p.select("p_partkey", C.crop_fractions(box).alias("b")).select("p_partkey", C.crop_rectangle(F.lit(640.0), F.lit(480.0), F.col("b")).alias("r"))
    return r.select("p_partkey", "r.*")


# ---- features ----------------------------------------------------------------------------

@query("layer_subset", f"WITH {FEAT} SELECT layer, count(*) AS n, sum(v[1]) AS s FROM feat WHERE layer IN (0, 2) GROUP BY layer", "s")
def layer_subset(spark, d):
    return X.layer_subset(features(spark, d), [0, 2]).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("vector")[0]).alias("s"))


@query("mean_pool", f"WITH {FEAT} SELECT label, layer, p, avg(x) AS m FROM (SELECT label, layer, unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INT AS p FROM feat) GROUP BY ALL", "m")
def mean_pool(spark, d):
    return X.mean_pool(features(spark, d), ["label", "layer"]).select("label", "layer", F.posexplode("vector").alias("p", "m"))


@query("pool_streams", f"""WITH {FEAT}, t AS (SELECT item_id, layer, p, x, unnest(CASE WHEN layer < 2 THEN ['vis', 'all'] ELSE ['txt', 'all'] END) AS stream FROM (SELECT item_id, layer, unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INT AS p FROM feat))
    SELECT item_id, stream, p, avg(x) AS m FROM t GROUP BY ALL""", "m")
def pool_streams(spark, d):
    """Layers stand for token positions: the first two are visual."""
    t = features(spark, d).withColumnRenamed("layer", "pos")
    return X.pool_streams(t, ["item_id"], "pos", F.lit(2)).select("item_id", "stream", F.posexplode("vector").alias("p", "m"))


@query("ablate_mean", f"""WITH {FEAT}, x AS (SELECT item_id, layer, unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INT AS p FROM feat), m AS (SELECT layer, p, avg(x) AS m FROM x GROUP BY ALL)
    SELECT layer, p, count(*) AS n, sum(m) AS s FROM x JOIN m USING (layer, p) GROUP BY ALL""", "s")
def ablate_mean(spark, d):
    f = features(spark, d)
    out = X.ablate(f, "mean", X.mean_activation(f))
    return out.select("layer", F.posexplode("vector").alias("p", "x")).groupBy("layer", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))


@query("ablate_zero", f"WITH {FEAT} SELECT layer, count(*) AS n, 0.0 AS s FROM feat GROUP BY layer", "s")
def ablate_zero(spark, d):
    out = X.ablate(features(spark, d), "zero")
    return out.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("s"))


@query("ablate_noise", f"""WITH {FEAT}, x AS (SELECT item_id, layer, unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INT AS i FROM feat), sd AS (SELECT layer, item_id, stddev_samp(x) AS sd FROM x GROUP BY ALL),
    u AS (SELECT layer, item_id, x, sd, (('0x' || substr(md5('42-' || layer || '-' || item_id || '-0-' || i), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0 AS u, (('0x' || substr(md5('43-' || layer || '-' || item_id || '-0-' || i), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0 AS w FROM x JOIN sd USING (layer, item_id))
    SELECT layer, item_id, sum(x + sqrt(-2 * ln(u)) * cos(2 * pi() * w) * sd) AS s FROM u GROUP BY ALL""", "s")
def ablate_noise(spark, d):
    out = X.ablate(features(spark, d).withColumn("token", F.lit(0)), "noise")
    return out.select("layer", "item_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("s"))


@query("semantic_vectors", f"""WITH {EMB}, x AS (SELECT item_id, unnest(e[1:16]) AS v, generate_subscripts(e[1:16], 1) - 1 AS id FROM emb),
    p AS (SELECT item_id, id, exp(v) / sum(exp(v)) OVER (PARTITION BY item_id) AS prob, row_number() OVER (PARTITION BY item_id ORDER BY v DESC, id) AS k FROM x),
    voc AS (SELECT label AS id, p, avg(x) AS x FROM (SELECT label, unnest(e[1:8]) AS x, (generate_subscripts(e[1:8], 1) - 1)::INT AS p FROM emb) GROUP BY ALL)
    SELECT item_id, voc.p, sum(prob / (z + 1e-8) * x) AS v FROM (SELECT *, sum(prob) OVER (PARTITION BY item_id) AS z FROM p WHERE k <= 10) t JOIN voc USING (id) GROUP BY ALL""", "v")
def semantic_vectors(spark, d):
    from ..functions.vectors import softmax_top_k

    e = items(spark, d)
    topk = softmax_top_k(e.select("item_id", F.slice("e", 1, 16).alias("l")), "l", 10, "topk")
    vocab = X.mean_pool(e.select(F.col("label").alias("token_id"), F.slice("e", 1, 8).alias("vector")), ["token_id"])
    return X.semantic_vectors(topk, vocab, ["item_id"]).select("item_id", F.posexplode("vector").alias("p", "v"))


@query("pack_targets", f"WITH {ALL_RESP} SELECT subject, target // 4 AS target_block, item_id, sum(value) AS s, count(*)::INT AS w FROM resp GROUP BY ALL", "s")
def pack_targets(spark, d):
    p = X.pack_targets(responses(spark, d, N_ALL_SUBJECTS), ["subject"], "item_id", "target", "value", 4)
    return p.select("subject", "target_block", "item_id", F.aggregate("y", F.lit(0.0), lambda s, x: s + x).alias("s"), F.size("y").alias("w"))
