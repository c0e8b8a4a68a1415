"""Queries on resampling, permutation and tests (section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import stars
from ..operators import inference as I, order as O, resample as B, ridge as G, similarity as S
from ..session import cut_lineage
from .inputs import ALL_RESP, LAYERS, N_ALL_SUBJECTS, SUBJECTS, EMB, avg_rank, items, pair_distances, r_of, responses, segments, streams, student_sql, table, unit_rows
from .registry import query
from .similarity import SEG_RANKS, TWO, TWO_BY_LABEL, centred, VIS

DRAW = "(('0x' || substr(md5('42-' || r.r || '-' || p.p), 1, 8))::BIGINT % n)"


def boot_sql(reps: int, group: str, source: str, item: str) -> str:
    """CTEs idx and m: draws with replacement within each group, and their multiplicities."""
    return (f"idx AS (SELECT {group} AS grp, {item} AS item, row_number() OVER (PARTITION BY {group} ORDER BY {item}) - 1 AS p, count(*) OVER (PARTITION BY {group}) AS n FROM {source}), "
            f"m AS (SELECT p.grp, r.r AS rep, {DRAW} AS d, count(*) AS m FROM idx p, range({reps}) r(r) GROUP BY ALL), "
            f"mi AS (SELECT m.grp, rep, item, m FROM m JOIN idx ON idx.grp = m.grp AND idx.p = m.d)")


MEAN_DRAWS = 10_000  # as the reference
EVENT_BOOT = boot_sql(20, "event_type", "events", "event_id")


@query("bootstrap_ci_mean", f"""WITH {boot_sql(MEAN_DRAWS, "event_type", "events", "event_id")}, s AS (SELECT grp, rep, sum(value * m) / sum(m) AS s FROM mi JOIN events ON event_id = item GROUP BY ALL)
    SELECT grp AS event_type, observed, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high, stddev_pop(s) AS se
    FROM s JOIN (SELECT event_type AS grp, avg(value) AS observed FROM events GROUP BY 1) USING (grp) GROUP BY ALL""", "observed ci_low ci_high se")
def bootstrap_ci_mean(spark, d):
    return I.bootstrap_ci(table(spark, d, "events"), ["event_type"], "event_id", "value", MEAN_DRAWS)


@query("bootstrap_ci_median", f"""WITH {EVENT_BOOT}, x AS (SELECT grp, rep, value, unnest(range(m)) FROM mi JOIN events ON event_id = item),
    s AS (SELECT grp, rep, median(value) AS s FROM x GROUP BY ALL)
    SELECT grp AS event_type, observed, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high, stddev_pop(s) AS se
    FROM s JOIN (SELECT event_type AS grp, median(value) AS observed FROM events GROUP BY 1) USING (grp) GROUP BY ALL""", "observed ci_low ci_high se")
def bootstrap_ci_median(spark, d):
    return I.bootstrap_ci(table(spark, d, "events"), ["event_type"], "event_id", "value", 20, "median")


@query("trimmed_means", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE isfinite(value))
    SELECT event_type, n, avg(value) AS stat FROM r WHERE p >= floor(0.1::DOUBLE * n) AND p < n - floor(0.1::DOUBLE * n) GROUP BY ALL""", "stat")
def trimmed_means(spark, d):
    return B.statistic_of(table(spark, d, "events"), ["event_type"], "value", B.trimmed_mean(0.1))


@query("bootstrap_trimmed_mean")
def bootstrap_trimmed_mean(spark, d):
    """1,000 draws of a statistic given as a function; numpy's draws have no SQL twin."""
    return B.bootstrap_statistic(table(spark, d, "events"), ["event_type"], "value", B.trimmed_mean(0.1), 1000)


def boot_rsa_sql(rank: bool, reps: int) -> str:
    value = "ra, rb" if rank else "a AS ra, b AS rb"
    weighted = ("SELECT grp, rep, w, sum(w) OVER (PARTITION BY grp, rep ORDER BY a) - (sum(w) OVER (PARTITION BY grp, rep, a) - 1) / 2 AS ra, "
                "sum(w) OVER (PARTITION BY grp, rep ORDER BY b) - (sum(w) OVER (PARTITION BY grp, rep, b) - 1) / 2 AS rb FROM rows"
                if rank else "SELECT grp, rep, w, a AS ra, b AS rb FROM rows")
    return f"""WITH {TWO_BY_LABEL}, {boot_sql(reps, 'label', 'emb', 'item_id')},
    rows AS (SELECT pv.label AS grp, x.rep, pv.d AS a, pt.d AS b, (x.m * y.m)::DOUBLE AS w FROM pv JOIN pt USING (i, j) JOIN mi x ON x.item = i JOIN mi y ON y.item = j AND y.rep = x.rep
      UNION ALL SELECT grp, rep, 0, 0, sum(m * (m - 1) / 2)::DOUBLE FROM mi GROUP BY grp, rep HAVING sum(m * (m - 1) / 2) > 0),
    rk AS ({weighted}),
    s AS (SELECT grp, rep, (sum(w*ra*rb) - sum(w*ra)*sum(w*rb)/sum(w)) / sqrt((sum(w*ra*ra) - sum(w*ra)*sum(w*ra)/sum(w)) * (sum(w*rb*rb) - sum(w*rb)*sum(w*rb)/sum(w))) AS s FROM rk GROUP BY ALL)
    SELECT grp AS label, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high, stddev_pop(s) AS se FROM s GROUP BY grp"""


@query("bootstrap_rsa_spearman", boot_rsa_sql(True, 1000), "ci_low ci_high se")
def bootstrap_rsa_spearman(spark, d):
    return I.bootstrap_rank_rsa_in_tiles(streams(spark, d), ["label"], "item_id", "vis", "txt", 1000)


@query("bootstrap_rsa_pearson", boot_rsa_sql(False, 1000), "ci_low ci_high se")
def bootstrap_rsa_pearson(spark, d):
    return I.bootstrap_rsa_in_tiles(streams(spark, d), ["label"], "item_id", "vis", "txt", 1000)


@query("bootstrap_cka", f"""WITH {VIS} {boot_sql(8, 'label', 'emb', 'item_id')},
    x AS (SELECT grp, rep, m, item, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM mi JOIN vis ON vis.item_id = item),
    y AS (SELECT grp, rep, m, item, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM mi JOIN txt ON txt.item_id = item),
    cx AS (SELECT grp, rep, item, list(c ORDER BY p) AS c FROM (SELECT *, sqrt(m) * (x - sum(m * x) OVER w / sum(m) OVER w) AS c FROM x WINDOW w AS (PARTITION BY grp, rep, p)) GROUP BY ALL),
    cy AS (SELECT grp, rep, item, list(c ORDER BY p) AS c FROM (SELECT *, sqrt(m) * (x - sum(m * x) OVER w / sum(m) OVER w) AS c FROM y WINDOW w AS (PARTITION BY grp, rep, p)) GROUP BY ALL),
    z AS (SELECT grp, rep, item, cx.c AS a, cy.c AS b FROM cx JOIN cy USING (grp, rep, item)),
    s AS (SELECT grp, rep, sum(k*l) / sqrt(sum(k*k) * sum(l*l)) AS s FROM (SELECT p.grp, p.rep, list_inner_product(p.a, q.a) AS k, list_inner_product(p.b, q.b) AS l FROM z p JOIN z q ON p.grp = q.grp AND p.rep = q.rep) GROUP BY ALL)
    SELECT grp AS label, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high, stddev_pop(s) AS se FROM s GROUP BY grp""", "ci_low ci_high se")
def bootstrap_cka(spark, d):
    return I.bootstrap_cka(streams(spark, d), ["label"], "item_id", "vis", "txt", 32, 32, 8)


def perm_sql(reps: int, group: str, source: str, item: str) -> str:
    return (f"home AS (SELECT {group} AS grp, {item} AS item, row_number() OVER (PARTITION BY {group} ORDER BY {item}) AS p FROM {source}), "
            f"moved AS (SELECT {group} AS grp, r.r AS rep, {item} AS other, row_number() OVER (PARTITION BY {group}, r.r ORDER BY md5('42-' || r.r || '-' || {item}), {item}) AS p FROM {source}, range({reps}) r(r)), "
            f"perm AS (SELECT home.grp, rep, item, other FROM home JOIN moved ON home.grp = moved.grp AND home.p = moved.p)")


@query("permutation_table", f"WITH {EMB}, {perm_sql(1000, '0', 'emb', 'item_id')} SELECT rep::INT AS rep, item AS item_id, other FROM perm")
def permutation_table(spark, d):
    return I.permutation_table(items(spark, d).select("g", "item_id"), ["g"], "item_id", 1000).drop("g")


@query("perm_rsa_by_label", f"""WITH {TWO_BY_LABEL}, {perm_sql(20, 'label', 'emb', 'item_id')},
    rk AS (SELECT pv.label AS grp, i, j, {avg_rank('pv.d', 'pv.label')} AS a, {avg_rank('pt.d', 'pv.label')} AS b FROM pv JOIN pt USING (i, j)),
    o AS (SELECT grp, {r_of('a', 'b')} AS observed FROM rk GROUP BY grp),
    n AS (SELECT x.grp, p.rep, {r_of('x.a', 'y.b')} AS s FROM rk x JOIN perm p ON p.item = x.i JOIN perm q ON q.item = x.j AND q.rep = p.rep
      JOIN rk y ON y.i = least(p.other, q.other) AND y.j = greatest(p.other, q.other) GROUP BY ALL)
    SELECT grp AS label, observed, avg((s >= observed - 1e-12)::INT) AS p, avg(s) AS null_mean, stddev_pop(s) AS null_std FROM n JOIN o USING (grp) GROUP BY ALL""", "observed p null_mean null_std")
def perm_rsa_by_label(spark, d):
    return I.permutation_test_rank_rsa_in_tiles(streams(spark, d), ["label"], "item_id", ["vis", "txt"], {"vis": 0}, [1], 20).drop("layer")


@query("perm_rsa_pearson", f"""WITH {TWO}, {perm_sql(1000, '0', 'emb', 'item_id')},
    rk AS (SELECT i, j, pv.d AS a, pt.d AS b FROM pv JOIN pt USING (i, j)), o AS (SELECT {r_of('a', 'b')} AS observed FROM rk),
    n AS (SELECT p.rep, {r_of('x.a', 'y.b')} AS s FROM rk x JOIN perm p ON p.item = x.i JOIN perm q ON q.item = x.j AND q.rep = p.rep
      JOIN rk y ON y.i = least(p.other, q.other) AND y.j = greatest(p.other, q.other) GROUP BY ALL)
    SELECT observed, (1 + sum((s >= observed - 1e-12)::INT)) / (count(*) + 1) AS p, avg(s) AS null_mean, stddev_pop(s) AS null_std FROM n, o GROUP BY observed""", "observed p null_mean null_std")
def perm_rsa_pearson(spark, d):
    return I.permutation_test_rsa_linear(streams(spark, d), ["g"], "item_id", "vis", "txt", 32, 32, 1000, plus_one=True).drop("g")


@query("perm_rsa_shared", f"""WITH {SEG_RANKS}, {perm_sql(5, '0', 'emb', 'item_id')},
    l AS (SELECT * FROM rk WHERE segment LIKE 'L%'), s AS (SELECT * FROM rk WHERE segment LIKE 'S%'),
    o AS (SELECT segment, avg(r) AS observed FROM (SELECT l.segment, s.segment AS t, {r_of('l.r', 's.r')} AS r FROM l JOIN s USING (i, j) GROUP BY ALL) GROUP BY segment),
    n AS (SELECT segment, rep, avg(r) AS stat FROM (SELECT l.segment, s.segment AS t, p.rep, {r_of('l.r', 's.r')} AS r FROM l JOIN perm p ON p.item = l.i JOIN perm q ON q.item = l.j AND q.rep = p.rep
      JOIN s ON s.i = least(p.other, q.other) AND s.j = greatest(p.other, q.other) GROUP BY ALL) GROUP BY ALL)
    SELECT segment AS layer, observed, avg((stat >= observed - 1e-12)::INT) AS p, avg(stat) AS null_mean, stddev_pop(stat) AS null_std FROM n JOIN o USING (segment) GROUP BY ALL""", "observed p null_mean null_std")
def perm_rsa_shared(spark, d):
    layers = {name: k for k, name in enumerate(LAYERS)}
    subjects = [len(LAYERS) + k for k in range(len(SUBJECTS))]
    return I.permutation_test_rank_rsa_in_tiles(segments(spark, d), ["g"], "item_id", LAYERS + SUBJECTS, layers, subjects, 5).drop("g")


@query("perm_cka", f"""WITH {VIS} {centred('vis', 'v', 'label', 'cv')}, {centred('txt', 'v', 'label', 'ct')}, {perm_sql(8, 'label', 'emb', 'item_id')},
    f AS (SELECT label, sqrt(sum(pow(list_inner_product(p.c, q.c), 2))) AS nx FROM cv p JOIN cv q USING (label) GROUP BY label),
    h AS (SELECT label, sqrt(sum(pow(list_inner_product(p.c, q.c), 2))) AS ny FROM ct p JOIN ct q USING (label) GROUP BY label),
    z AS (SELECT perm.grp AS label, rep, cv.c AS a, ct.c AS b FROM perm JOIN cv ON cv.item_id = other JOIN ct ON ct.item_id = item
      UNION ALL SELECT label, -1, cv.c, ct.c FROM cv JOIN ct USING (label, item_id)),
    s AS (SELECT label, rep, sum(k*l) AS xy FROM (SELECT p.label, p.rep, list_inner_product(p.a, q.a) AS k, list_inner_product(p.b, q.b) AS l FROM z p JOIN z q ON p.label = q.label AND p.rep = q.rep) GROUP BY ALL),
    c AS (SELECT label, rep, xy / (nx * ny) AS s FROM s JOIN f USING (label) JOIN h USING (label))
    SELECT n.label, o.s AS observed, avg((n.s >= o.s - 1e-12)::INT) AS p, avg(n.s) AS null_mean, stddev_pop(n.s) AS null_std FROM c n JOIN c o ON n.label = o.label AND o.rep = -1 WHERE n.rep >= 0 GROUP BY ALL""", "observed p null_mean null_std")
def perm_cka(spark, d):
    return I.permutation_test_cka(streams(spark, d), ["label"], "item_id", "vis", "txt", 32, 32, 8)


def two_sample_sql(stat: str, hit: str, reps: int = 1000) -> str:
    return f"""WITH e AS (SELECT lang, doc_id, source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6') AS a, n_chars AS v0 FROM documents),
    v AS (SELECT lang, doc_id, a, {stat} AS v, sum(a::INT) OVER (PARTITION BY lang) AS na FROM e),
    n AS (SELECT lang, r.r AS rep, v, na, row_number() OVER (PARTITION BY lang, r.r ORDER BY md5('42-' || r.r || '-' || doc_id), doc_id) AS p FROM v, range({reps}) r(r))"""


MEAN_DIFF = "sum(v) FILTER ({0}) / count(*) FILTER ({0}) - sum(v) FILTER (NOT ({0})) / count(*) FILTER (NOT ({0}))"


@query("perm_two_sample_mean", two_sample_sql("v0", "") + f""", o AS (SELECT lang, {MEAN_DIFF.format('a')} AS observed FROM v GROUP BY lang),
    s AS (SELECT lang, rep, {MEAN_DIFF.format('p <= na')} AS s FROM n GROUP BY ALL)
    SELECT lang, observed, avg((abs(s) >= abs(observed) - 1e-12)::INT) AS p FROM s JOIN o USING (lang) GROUP BY ALL""", "observed p")
def perm_two_sample_mean(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "source", F.col("n_chars").cast("double").alias("v"))
    return I.permutation_test(docs, ["lang"], "doc_id", F.col("source").isin(*[f"src{k}" for k in range(7)]), "v", 1000)


@query("perm_two_sample_rank", two_sample_sql(avg_rank("v0", "lang"), "") + """, o AS (SELECT lang, sum(v) FILTER (a) AS observed FROM v GROUP BY lang),
    s AS (SELECT lang, rep, sum(v) FILTER (p <= na) AS s FROM n GROUP BY ALL)
    SELECT lang, observed, avg((s >= observed - 1e-12)::INT) AS p FROM s JOIN o USING (lang) GROUP BY ALL""", "observed p")
def perm_two_sample_rank(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "source", F.col("n_chars").cast("double").alias("v"))
    return I.permutation_test(docs, ["lang"], "doc_id", F.col("source").isin(*[f"src{k}" for k in range(7)]), "v", 1000, "rank_sum", "greater")


@query("null_encoder")
def null_encoder(spark, d):
    """Encoder r with 200 permutations of the targets against the observed one."""
    e = items(spark, d).select("g", "item_id", F.slice("e", 9, 56).alias("x"), F.slice("e", 1, 8).alias("y"))
    r = cut_lineage(G.null_ridge(e, ["g"], "item_id", "x", "y", 200, pca_dim=None).groupBy("g", "rep").agg(F.avg("r").alias("stat")))
    out = I.p_value(r.where("rep >= 0"), r.where("rep < 0").select("g", F.col("stat").alias("observed")), ["g"])
    return out.drop("g").withColumn("mark", stars("p"))


@query("shuffled_layers", """WITH l AS (SELECT DISTINCT lang FROM documents), home AS (SELECT lang, row_number() OVER (ORDER BY lang) AS p FROM l),
    moved AS (SELECT r.r AS rep, lang AS other, row_number() OVER (PARTITION BY r.r ORDER BY md5('42-' || r.r || '-' || lang), lang) AS p FROM l, range(1000) r(r))
    SELECT rep::INT AS rep, other AS lang, avg(n_chars) AS mean FROM documents JOIN home USING (lang) JOIN moved USING (p) GROUP BY ALL""", "mean")
def shuffled_layers(spark, d):
    docs = table(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean"))  # labels move whole groups
    return I.shuffled_labels(docs, "lang", 1000).select("rep", "lang", "mean")


PAIRED = f"{ALL_RESP}, c AS (SELECT label, subject, {r_of('value', 'item_id')} AS a, {r_of('value', 'item_id * target')} AS b FROM resp GROUP BY ALL)"


def t_sql(mean: str, sd: str) -> str:
    return f"(CASE WHEN n > 1 AND {sd} > 0 THEN {mean} / ({sd} / sqrt(n)) ELSE 0 END)"


@query("paired_t", f"""WITH {PAIRED}, g AS (SELECT label, count(*) AS n, avg(a) AS a_mean, avg(b) AS b_mean, avg(a - b) AS diff_mean, stddev_samp(a - b) AS sd, stddev_samp(a) AS sa, count(*) FILTER (a - b > 0) AS n_pos FROM c GROUP BY label),
    t AS (SELECT *, {t_sql('diff_mean', 'sd')} AS t, {t_sql('a_mean', 'sa')} AS a_vs0_t FROM g)
    SELECT label, n, a_mean, b_mean, diff_mean, n_pos, t, a_vs0_t, {student_sql('t', 'n - 1')} AS p, {student_sql('a_vs0_t', 'n - 1')} AS a_vs0_p FROM t""",
       "a_mean b_mean diff_mean t a_vs0_t p a_vs0_p")
def paired_t(spark, d):
    from ..functions.scalars import pearson

    c = responses(spark, d, N_ALL_SUBJECTS).groupBy("label", "subject").agg(pearson("value", "item_id").alias("a"),
                                                            pearson("value", F.col("item_id") * F.col("target")).alias("b"))
    return I.paired_t(c, ["label"], "a", "b")


@query("two_sample_t", f"""WITH g AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS n_a, count(*) FILTER (user_id % 2 <> 0) AS n_b, avg(value) FILTER (user_id % 2 = 0) AS mean_a, avg(value) FILTER (user_id % 2 <> 0) AS mean_b,
    var_samp(value) FILTER (user_id % 2 = 0) AS va, var_samp(value) FILTER (user_id % 2 <> 0) AS vb FROM events GROUP BY event_type),
    t AS (SELECT *, (n_a + n_b - 2)::DOUBLE AS df, (mean_a - mean_b) / sqrt(((n_a-1)*va + (n_b-1)*vb) / (n_a+n_b-2) * (1.0/n_a + 1.0/n_b)) AS t FROM g)
    SELECT event_type, n_a, n_b, mean_a, mean_b, t, df, {student_sql('t', 'df')} AS p FROM t""", "mean_a mean_b t df p")
def two_sample_t(spark, d):
    return I.two_sample_t(table(spark, d, "events"), ["event_type"], F.pmod("user_id", F.lit(2)) == 0, "value")


@query("mann_whitney", f"""WITH e AS (SELECT event_type, user_id % 2 = 0 AS a, {avg_rank('value', 'event_type')} AS r, value FROM events),
    g AS (SELECT event_type, count(*) FILTER (a) AS m, count(*) FILTER (NOT a) AS n, sum(r) FILTER (a) AS w FROM e GROUP BY event_type),
    t AS (SELECT event_type, sum(c*c*c - c)::DOUBLE AS ties FROM (SELECT event_type, value, count(*)::DOUBLE AS c FROM events GROUP BY ALL) GROUP BY event_type)
    SELECT event_type, m, n, ties, w - m*(m+1)/2.0 AS u FROM g JOIN t USING (event_type)""", "ties u")
def mann_whitney(spark, d):
    """The p of the normal tail is checked in the tests; SQL has no such function."""
    return I.mann_whitney(table(spark, d, "events"), ["event_type"], F.pmod("user_id", F.lit(2)) == 0, "value").drop("p")


@query("mann_whitney_p")
def mann_whitney_p(spark, d):
    return I.mann_whitney(table(spark, d, "events"), ["event_type"], F.pmod("user_id", F.lit(2)) == 0, "value").select("event_type", "p")


PV = "pv AS (SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value)::DOUBLE / (count(*) OVER (PARTITION BY event_type) * 4) AS p FROM events)"
BH = f"""{PV}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM pv),
    a AS (SELECT event_id, event_type, p, least(1, min(p * n / k) OVER (PARTITION BY event_type ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS adjusted_p FROM o)"""


def p_values(spark, d):
    """A p per event: a quarter of its rank share within the event type."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    size = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    r = O.average_rank(e, ["event_type"], "value").join(size, "event_type")
    same = e.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    return r.join(same, ["event_type", "value"]).select("event_id", "event_type", ((F.col("rank") - (F.col("c") - 1) / 2) / (F.col("n") * 4)).alias("p"))


@query("bh_fdr", f"WITH {BH} SELECT event_id, event_type, adjusted_p, adjusted_p <= 0.05 AS reject FROM a", "adjusted_p")
def bh_fdr(spark, d):
    return I.benjamini_hochberg(p_values(spark, d), ["event_type"], "p").drop("p")


@query("bh_fdr_summary", f"WITH {BH} SELECT event_type, coalesce(max(p) FILTER (adjusted_p <= 0.05), 0) AS threshold, count(*) FILTER (adjusted_p <= 0.05) AS n_rejected, count(*) AS n_total FROM a GROUP BY event_type", "threshold")
def bh_fdr_summary(spark, d):
    return I.fdr_summary(I.benjamini_hochberg(p_values(spark, d), ["event_type"], "p"), ["event_type"], "p")


@query("correlation_with_p", f"""WITH rk AS (SELECT event_type, {avg_rank('value', 'event_type')} AS a, {avg_rank('user_id', 'event_type')} AS b FROM events),
    r AS (SELECT event_type, {r_of('a', 'b')} AS r, count(*) AS n FROM rk GROUP BY event_type)
    SELECT event_type, r, n, {student_sql('(r * sqrt((n - 2) / (1 - r * r)))', 'n - 2')} AS p FROM r""", "r p")
def correlation_with_p(spark, d):
    e = table(spark, d, "events").select("event_type", "value", F.col("user_id").cast("double").alias("u"))
    return I.correlate(e, ["event_type"], "value", "u")


@query("exact_quantiles", "SELECT event_type, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.975) AS high FROM events GROUP BY event_type", "low mid high")
def exact_quantiles(spark, d):
    return O.exact_quantiles(table(spark, d, "events"), ["event_type"], "value", {"low": 0.025, "mid": 0.5, "high": 0.975})
