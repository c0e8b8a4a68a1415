"""Queries on text answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C, text as T
from ..operators import scoring as S
from .inputs import ANSWERS, answers, table
from .registry import query
from ..session import spread

B = chr(92)
UNI = r"\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{B}s{UNI}]"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def norm_sql(c: str) -> str:
    return (f"array_to_string(list_filter({words_sql(f'''regexp_replace(lower({c}), '[^{B}p{{L}}{B}p{{N}}_{B}s{UNI}]', '', 'g')''')}, "
            "lambda w: w NOT IN ('a', 'an', 'the')), ' ')")


def quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query("normalize_answer", f"SELECT doc_id, md5({norm_sql('text')}) AS h FROM documents")
def normalize_answer(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(T.normalise_answer("text").cast("binary")).alias("h"))


VQA = f"""{ANSWERS}, n AS (SELECT conv_id, {norm_sql('pred')} AS p, {norm_sql('gt')} AS g FROM answers),
    s AS (SELECT conv_id, CASE WHEN g = '' THEN NULL WHEN p = g THEN 1.0 WHEN contains(p, g) OR contains(g, p) THEN 0.5
      ELSE len(list_intersect(list_distinct(string_split(p, ' ')), list_distinct(string_split(g, ' '))))::DOUBLE / len(list_distinct(string_split(g, ' '))) * 0.5 END AS s FROM n)"""


@query("vqa_accuracy", f"WITH {VQA} SELECT conv_id, coalesce(sum(s), 0) / greatest(count(s), 1) AS score FROM s GROUP BY conv_id", "score")
def vqa_accuracy(spark, d):
    return S.vqa_accuracy(answers(spark, d), ["conv_id"], "pred", "gt")


ATTR = ("the", "de", "is", "les", "que")
BINDS = """list_filter(list_transform({0}, lambda x, i: {{'a': x, 'o': {0}[i + 1]}}), lambda s: s.a IN {1} AND s.o IS NOT NULL AND s.o NOT IN {2})"""


@query("bindings", f"""WITH w AS (SELECT doc_id, {words_sql('lower(text)')} AS w FROM documents)
    SELECT doc_id, len({BINDS.format('w', quoted(T.COLORS + T.SIZES + T.POSITIONS), quoted(T.NOT_OBJECTS))})::INT AS n, len({BINDS.format('w', quoted(ATTR), quoted(T.NOT_OBJECTS))})::INT AS n_common FROM w""")
def bindings(spark, d):
    w = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("w", T.words(F.lower("text")))
    return w.select("doc_id", F.size(T.bindings("w")).alias("n"), F.size(T.bindings("w", ATTR)).alias("n_common"))


FUZZY = """(contains(g.o, p.o) OR contains(p.o, g.o) OR (length(g.o) > 3 AND length(p.o) > 3 AND
    len(list_intersect(list_distinct(string_split(g.o, '')), list_distinct(string_split(p.o, ''))))::DOUBLE / greatest(len(list_distinct(string_split(g.o, ''))), len(list_distinct(string_split(p.o, '')))) > 0.6))"""


@query("fuzzy_match", f"SELECT g.p_partkey, {FUZZY} AS hit FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS o, p_brand FROM part) g JOIN (SELECT p_partkey, split_part(p_name, ' ', 2) AS o FROM part) p USING (p_partkey)")
def fuzzy_match(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", T.fuzzy_match(F.element_at(w, 1), F.element_at(w, 2)).alias("hit"))


PARTS = """ans AS (SELECT a.p_brand AS k, a.p_name AS gt, coalesce(b.p_name, a.p_name) || ' and ' || a.p_name AS pred FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def part_answers(spark, d):
    """Part names as references; the next part's name and the name itself as prediction."""
    p = table(spark, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("nxt"))
    return p.join(nxt, "p_partkey", "left").select(F.col("p_brand").alias("k"), F.col("p_name").alias("gt"),
                                                   F.concat(F.coalesce("nxt", "p_name"), F.lit(" and "), "p_name").alias("pred"))


def binding_sql(source: str, key: str) -> str:
    attrs, stop = quoted(T.COLORS + T.SIZES + T.POSITIONS), quoted(T.NOT_OBJECTS)
    return f"""w AS (SELECT {key} AS k, {words_sql('lower(gt)')} AS gw, {words_sql('lower(pred)')} AS pw FROM {source}),
    b AS (SELECT k, gw, pw, {BINDS.format('gw', attrs, stop)} AS gb, {BINDS.format('pw', attrs, stop)} AS pb FROM w),
    c AS (SELECT k, CASE WHEN len(gw) = 0 THEN 0.0 WHEN len(gb) = 0 THEN len(list_intersect(list_distinct(pw), list_distinct(gw)))::DOUBLE / len(list_distinct(gw))
        ELSE len(list_filter(gb, lambda g: len(list_filter(pb, lambda p: g.a = p.a AND {FUZZY})) > 0))::DOUBLE END AS hits,
      CASE WHEN len(gw) = 0 THEN 0 WHEN len(gb) = 0 THEN 1 ELSE len(gb) END AS total FROM b)"""


@query("binding_accuracy", f"WITH {PARTS}, {binding_sql('ans', 'k')} SELECT k, sum(hits) / greatest(sum(total), 1) AS score FROM c GROUP BY k", "score")
def binding_accuracy(spark, d):
    return S.binding_accuracy(part_answers(spark, d), ["k"], "pred", "gt")


@query("binding_accuracy_turns", f"WITH {ANSWERS}, {binding_sql('answers', 'conv_id')} SELECT k AS conv_id, sum(hits) / greatest(sum(total), 1) AS score FROM c GROUP BY k", "score")
def binding_accuracy_turns(spark, d):
    return S.binding_accuracy(answers(spark, d), ["conv_id"], "pred", "gt")


def quality_sql(source: str, key: str, text: str = "text") -> str:
    return f"""w AS (SELECT {key} AS k, {text} AS text, {words_sql(text)} AS w FROM {source}),
    t AS (SELECT k, text, w, list_sort(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS t FROM w),
    q AS (SELECT k, len(w) AS n, CASE WHEN len(w) > 0 THEN len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE / len(w) ELSE 0 END AS ttr,
      CASE WHEN len(w) >= 3 THEN len(list_filter(t, lambda x, i: x = t[i+1] AND (i = 1 OR x <> t[i-1])))::DOUBLE / (len(w) - 2) ELSE 0 END AS rep,
      len(regexp_extract_all(text, '[^.!?{B}s{UNI}][^.!?]*')) AS sent FROM t),
    g AS (SELECT k, avg(n) AS length, avg(ttr) AS vocab_richness, avg(rep) AS repetition_rate, avg(sent) AS sentence_count FROM q GROUP BY k)"""


COMPOSITE = "0.3 * least(length / 50.0, 1) + 0.3 * vocab_richness + 0.2 * (1 - repetition_rate) + 0.2 * least(sentence_count / 3.0, 1)"


@query("language_quality", f"WITH {quality_sql('documents', 'lang')} SELECT k AS lang, length, vocab_richness, repetition_rate, sentence_count, {COMPOSITE} AS composite FROM g",
       "length vocab_richness repetition_rate sentence_count composite")
def language_quality(spark, d):
    return S.language_quality(spread(table(spark, d, "documents").select("lang", "text")), ["lang"], "text")


@query("exact_match", "WITH " + ANSWERS + f""", t AS (SELECT conv_id, regexp_replace(lower(pred), '^{WS}+|{WS}+$', '', 'g') AS p, regexp_replace(lower(gt), '^{WS}+|{WS}+$', '', 'g') AS g FROM answers)
    SELECT conv_id, avg(CASE WHEN g <> '' AND contains(p, g) THEN 1.0 ELSE 0.0 END) AS score FROM t GROUP BY conv_id""", "score")
def exact_match(spark, d):
    """The whole question counts as the reference."""
    return S.exact_match(answers(spark, d), ["conv_id"], "pred", "gt")


OPTS = ["zz", "un", "es", "th"]


@query("mc_accuracy", "WITH " + ANSWERS + f""", t AS (SELECT conv_id, lower(pred) AS p, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE {OPTS} END AS o, turn % 4 AS c, regexp_replace(lower(gt), '^{WS}+|{WS}+$', '', 'g') AS g FROM answers),
    h AS (SELECT conv_id, CASE WHEN o IS NULL THEN (g <> '' AND contains(p, g))::INT ELSE coalesce((list_filter([0,1,2,3], lambda i: contains(p, o[i+1]))[1] = c)::INT, 0) END AS h FROM t)
    SELECT conv_id, avg(h) AS score FROM h GROUP BY conv_id""", "score")
def mc_accuracy(spark, d):
    a = (answers(spark, d).withColumn("o", F.when(F.pmod("conv_id", F.lit(4)) != 0, F.array(*[F.lit(o) for o in OPTS])))
         .withColumn("c", F.pmod("turn", F.lit(4))))
    return S.option_accuracy(a, ["conv_id"], "pred", "o", "c", "gt")


@query("caption_fluency", "SELECT l_returnflag, avg(1 - ln(greatest(1, least(1000, l_extendedprice / 50))) / ln(1000)) AS score FROM lineitem GROUP BY 1", "score")
def caption_fluency(spark, d):
    p = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 50).alias("ppl"))
    return S.caption_fluency(p, ["l_returnflag"], "ppl")


@query("clean_pieces", "WITH w AS (SELECT p_partkey, replace(replace('Ġ' || p_name || '▁', 'Ġ', ''), '▁', '') AS w FROM part) SELECT p_partkey, CASE WHEN length(w) > 8 THEN substr(w, 1, 7) || '.' ELSE w END AS piece FROM w")
def clean_pieces(spark, d):
    return table(spark, d, "part").select("p_partkey", C.clean_piece(F.concat(F.lit("Ġ"), "p_name", F.lit("▁"))).alias("piece"))


@query("significance_stars", "SELECT event_id, CASE WHEN value / 1000 < 0.001 THEN '***' WHEN value / 1000 < 0.01 THEN '**' WHEN value / 1000 < 0.05 THEN '*' ELSE 'ns' END AS mark FROM events")
def significance_stars(spark, d):
    return table(spark, d, "events").select("event_id", C.stars(F.col("value") / 1000).alias("mark"))


DROP = f"""{ANSWERS}, a AS (SELECT conv_id % 3 AS stage, gt AS baseline, pred AS patched, CASE WHEN turn % 2 = 0 THEN '' ELSE pred END AS g0 FROM answers),
    f AS (SELECT stage, baseline, patched, CASE WHEN g0 = '' THEN baseline ELSE g0 END AS gt FROM a)"""


@query("performance_drop", f"""WITH {DROP},
    x AS (SELECT stage, {norm_sql('baseline')} AS b, {norm_sql('patched')} AS p, {norm_sql('gt')} AS g FROM f),
    s AS (SELECT stage, CASE WHEN g = '' THEN NULL WHEN b = g THEN 1.0 WHEN contains(b, g) OR contains(g, b) THEN 0.5 ELSE len(list_intersect(list_distinct(string_split(b, ' ')), list_distinct(string_split(g, ' '))))::DOUBLE / len(list_distinct(string_split(g, ' '))) * 0.5 END AS sb,
      CASE WHEN g = '' THEN NULL WHEN p = g THEN 1.0 WHEN contains(p, g) OR contains(g, p) THEN 0.5 ELSE len(list_intersect(list_distinct(string_split(p, ' ')), list_distinct(string_split(g, ' '))))::DOUBLE / len(list_distinct(string_split(g, ' '))) * 0.5 END AS sp FROM x),
    v AS (SELECT stage, 'visual_recognition' AS task, coalesce(sum(sb), 0) / greatest(count(sb), 1) AS baseline_score, coalesce(sum(sp), 0) / greatest(count(sp), 1) AS patched_score, count(*) AS n FROM s GROUP BY stage)
    SELECT *, baseline_score - patched_score AS "drop" FROM v""", 'baseline_score patched_score "drop"')
def performance_drop(spark, d):
    """Drop per stage for one task; empty references are filled from the baseline."""
    a = answers(spark, d).select(F.pmod("conv_id", F.lit(3)).alias("stage"), F.lit("visual_recognition").alias("task"), F.col("gt").alias("baseline"),
                                 F.col("pred").alias("patched"), F.when(F.pmod("turn", F.lit(2)) == 0, "").otherwise(F.col("pred")).alias("ground_truth"))
    return S.performance_drop(a, ["stage"], "task", scorers={"visual_recognition": S.vqa_accuracy})


@query("performance_drop_all_tasks")
def performance_drop_all_tasks(spark, d):
    """Every task with its own scorer."""
    tasks = F.explode(F.array(*[F.lit(t) for t in S.SCORERS]))
    a = answers(spark, d).select(F.pmod("conv_id", F.lit(3)).alias("stage"), tasks.alias("task"), F.col("gt").alias("baseline"),
                                 F.col("pred").alias("patched"), F.lit("").alias("ground_truth"))
    return S.performance_drop(a, ["stage"], "task")
