"""Periodic runs and URL rules against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repalign.llm import runs, urls


def plain_runs(words, exponent=4, shortest=6):
    n, seen = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, exponent * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_collapse(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def loopy(rng, alphabet, n):
    out = []
    while len(out) < n:
        block = [str(rng.randrange(alphabet)) for _ in range(rng.randrange(1, 7))]
        out += (block * rng.randrange(1, 9))[:rng.randrange(1, 40)]
    return out


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 1), (3, 7)])
def test_runs_of_random_words(exponent, shortest):
    rng = random.Random(exponent)
    for _ in range(400):
        texts = [loopy(rng, rng.choice([1, 2, 3, 30]), rng.choice([0, 5, 30, 120])) for _ in range(4)]
        got = runs._runs_of([[w.encode() for w in t] for t in texts], exponent, shortest)
        assert got == [plain_runs(t, exponent, shortest) for t in texts]


def test_segments_hold_no_rare_word():
    rng = random.Random(2)
    ids = np.array([rng.randrange(40) for _ in range(900)])
    text = np.repeat([0, 1, 2], 300)
    for at in runs.segments(ids, text, 4, 6):
        assert len(at) >= 6 and len(set(text[at])) == 1 and (np.diff(at) == 1).all() and min(Counter(ids[at].tolist()).values()) >= 4


def test_very_long_texts():
    period = [b"%d" % (i % 977) for i in range(60_000)]
    assert runs._runs_of([period, [b"a"] * 100_000, []], 4, 6) == [[(0, 60_000, 977)], [(0, 100_000, 1)], []]


def test_chunks_of_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(runs, "CHUNK_BYTES", 5)
    for texts in ([], ["abcdef"], ["ab", None, "cdefgh"], ["a", "bcdefg", "h"]):
        parts = list(runs._bytes_of(pa.array(texts, pa.string())))
        assert [t for part in parts for t in part] == [(t or "").encode() for t in texts] and all(parts)
    assert runs._runs_of([], 4, 6) == [] and runs._runs_of([[]], 4, 6) == [[]]


def test_find_runs(spark, docs, texts, nothing):
    table = docs.withColumn("periodic", F.lit("old")).withColumn("runs", F.lit(1))
    got = Counter((r.doc_id, tuple(map(tuple, r.periodic.runs)), r.periodic.collapsed, r.runs, r.key) for r in runs.find_runs(table).collect())
    want = Counter()
    for i, t in texts:
        words = plain_words(t)
        found = [(0, len(words), 1)] if len(words) == 3_000 else plain_runs(words) if len(words) < 3_000 else []
        want[i, tuple(found), plain_collapse(words, found), 1, "x"] += 1
    assert got == want and any(k[1] for k in want)
    assert runs.find_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, exponent=1)


def test_run_digests(spark):
    rng = random.Random(9)
    table = [(k, " ".join(loopy(rng, 3, 40) + [f"w{rng.randrange(9)}" for _ in range(rng.randrange(30))])) for k in range(60)]
    table += [(k, " \n".join(f"w{rng.randrange(99)}" for _ in range(200))) for k in range(60, 160)] + [(200, None), (201, ""), (None, "a b"), (-7, "x y"), (3, table[3][1])]
    wanted = Counter()
    for i, t in table:
        words = plain_words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = plain_runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        wanted[(i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
                hashlib.sha256(plain_collapse(words, found).encode()).hexdigest())] += 1
    rows = spark.createDataFrame(table, "doc_id long, text string").withColumn("n_runs", F.lit("x"))
    assert Counter(tuple(r) for r in runs.run_digests(rows).collect()) == wanted
    assert runs.run_digests(rows.limit(0)).count() == 0


# ---- URL rules -----------------------------------------------------------------------------------


def plain_fits(glob, text):
    parts = re.findall(r"\\.|\*+|\?|[^\\*?]+|\\$", glob, re.DOTALL)
    regex = "".join(".*" if re.fullmatch(r"\*\*+", p) else "[^/]*" if p == "*" else "." if p == "?" else re.escape(p[1:] if p[0] == "\\" and len(p) > 1 else p) for p in parts)
    return re.fullmatch(regex, text, re.DOTALL) is not None


def bytes_of(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def test_automaton_against_regular_expressions():
    rng = random.Random(4)
    for _ in range(150):
        globs = {"".join(rng.choice(["a", "b", "/", "é", "?", "*", "**", "\\*", "\\\\", "ab" * 20]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 30))}
        rules = [urls.Rule(g, rng.choice([urls.ALLOW, urls.BLOCK]), g, rng.randrange(3)) for g in globs]
        texts = ["".join(rng.choice(["a", "b", "/", "é", "*", "\\", "\n", "ab" * 20]) for _ in range(rng.randrange(0, 12))) for _ in range(40)] + [""]
        automaton = urls.compiled(rules)
        which = urls.judge(automaton, *bytes_of(texts))
        for text, k in zip(texts, which.tolist()):
            fit = [r for r in automaton.rules if plain_fits(r.glob, text)]
            assert (automaton.rules[k] if k >= 0 else None) == (fit[0] if fit else None), (text, fit)


ODD = [None, "", "no scheme", "://", "http://", "HTTP://Example.COM/EN/", "https://example.com/en/x", "https://a.example.com/en/", "https://www.example.com/en/1?q", "http://x.www.example.com/en/",
       "http://notexample.com/en/", "http://example.com", "http://example.com?x/en/", "http://example.net/es", "http://net/es/#a", "http://a.net/fr/a://b.com/en/", "x://casino.org/", "x://a.casinos.org/p",
       "x://free-bets.org/a", "x://org/login/x", "x://ÄB.org/é?", "x://a.org/" + "y" * 30_000 + ".exe", "x://a.org/x.exe?y", "x://ads1.org/", "x://a\nb.org/\n"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in urls.SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda r: len(r[0]), default=(None, None))
    glob = None if rule else next((g for g in sorted(urls.GLOBS, key=lambda g: (-len(g), g)) if plain_fits(g, f".{host}{path}")), None)
    return host, path, rule, verdict or ("block" if glob else "allow"), glob


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_BITS", most)
    rows = [(k, u, "x") for k, u in enumerate(ODD)] + [(None, ODD[6], "x"), (3, ODD[7], "y"), (3, ODD[7], "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("rank", F.lit("r")).repartition(3)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in urls.verdicts(table).collect())
    assert got == Counter((i, *plain_verdict(u)) for i, u, _ in rows)
    assert {k[3] for k in got} > {"com/", "example.com/en/", "www.example.com/en/", "net/es/"} and sum(k[5] is not None for k in got) >= 5
    assert urls.verdicts(table.limit(0)).count() == 0


def test_filter_urls_keeps_other_columns(spark):
    got = urls.filter_urls(spark.createDataFrame([("x://a.org/", 1)], "link string, fits int"), [], url="link", default=urls.BLOCK).first()
    assert got.asDict() == {"link": "x://a.org/", "host": "a.org", "path": "/", "fits": None, "rank": None, "verdict": "block"}
