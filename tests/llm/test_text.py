"""Operators on texts against brute force, with the odd rows of conftest."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from repalign.llm import contamination, hashing, jaccard, licenses, pieces, pii, sharding, tokens, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PIECES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json"))


def by_row(df, *columns):
    """Rows as a counter: repeated rows count."""
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- toxicity ------------------------------------------------------------------------------------


def test_toxicity_learns_and_scores_everything(spark, docs, texts, nothing):
    rows = [(k, f"{'you zorgle fool' if k % 4 == 0 else 'a fine day'} {k % 17} house walk river") for k in range(400)]
    known = spark.createDataFrame([(k, 1 if k % 4 == 0 else 0, 0) for k in range(400)] + [(None, 1, 0), (7, None, 0)], "doc_id long, toxic int, quality int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(table, known, features=256).collect()
    assert all(r.predicted == (1 if r.doc_id % 4 == 0 else 0) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    model = toxicity.fit(table, known.select("doc_id", F.col("toxic").alias("label")), features=256)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(texts) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(nothing, model).count() == 0


def test_labels_other_than_zero_and_one(spark):
    rows = spark.createDataFrame([(k, f"{'you zorgle fool' if k % 4 == 0 else 'a fine day'} {k % 17} house") for k in range(200)], "doc_id long, text string")
    known = spark.createDataFrame([(k, 2 if k % 4 == 0 else -1 if k % 4 == 1 else 0) for k in range(200)] + [(4, 0)], "doc_id long, toxic int")
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in toxicity.toxicity(rows, known).collect())


def test_toxicity_without_labels_or_of_one_kind(spark, docs, texts):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    clean = spark.createDataFrame([(k, 0) for k in range(9)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.toxicity(docs, clean).collect()}) == 1


def test_distinct_character_grams():
    grams = toxicity._Grams()
    for text in ("abcabcabc", "ab", "", None, "Ä\nß x" * 50):
        s = f" {(text or '').lower()} ".replace("\n", " ")
        want = {s[i:i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1)}
        assert len(grams.of(text)) == len(want) and len(set(grams.of(text).tolist())) == len(want)


# ---- sharding ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    x = np.arange(n)
    y = sharding.permuted(x, n, 3)
    assert sorted(y) == list(x) and (sharding.permuted(y, n, 3, back=True) == x).all()
    shard, slot = sharding.place(x, n, 5, 3)
    assert (sharding.row_at(shard, slot, n, 5, 3) == x).all()


def test_shards(docs, texts, nothing):
    got = sharding.shard_documents(docs).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert [(r.doc_id, r["size"], r.text_crc32) for r in sorted(got, key=lambda r: r.row)] == want
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {tuple(r) for r in sharding.shard_documents(docs.repartition(7)).collect()} == {tuple(r) for r in got}
    assert sharding.shard_documents(nothing).count() == 0


# ---- personal data -------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_match_the_plain_expressions():
    import random

    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("ab1234.@-+ ()é_%\n") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)
    for text in ("a.b@c.d.e_f@g.h", "4111 1111 1111 1111", "4111-1111-1111-1111x", "+1 (988) 555-2485", "1.2.3.4.5.6.7.8", "000255.1.1.1 256.1.1.1", None, ""):
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("1" * 30_000, "a" * 30_000 + "@", "1." * 15_000):  # must not take quadratic time
        pii.base_spans(text)


def test_contexts_discover_identifiers(spark):
    rows = [(k, f"word{k % 7} please write to: user{k}@mail.example.com thanks a lot") for k in range(30)]
    rows += [(100, "and please write to: user77-at-mail0 thanks"), (101, "please write down user78-at-mail0 thanks"), (None, None), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.spans): r for r in pii.spans(table).collect()}
    found = {i: s for i, s in got}
    assert found[100] == "email:21:36" and found[101] == "" and found[None] == ""
    assert found[0].startswith("email:") and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for (i, _), r in got.items() if i in (100, 101, None))
    clean = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert clean[100] == "and please write to: <EMAIL> thanks" and clean[101].startswith("please write down user78") and clean[None] is None


def test_discovered_identifiers_seed_new_contexts_and_spread(spark):
    seeds = [f"please write to: user{k}@mail.example.com thanks" for k in range(30)]
    first = [f"please write to: nick{k}-at-home thanks" for k in range(3)]  # found behind the context of the seeds
    second = [f"his handle is nick{k}-at-home indeed" for k in range(3)] * 3 + ["his handle is other9-at-work indeed"]  # a context only of what was found
    spread = ["yesterday we met nick1-at-home there", "nick2-at-home stands first", "perhaps other9-at-work too", "perhaps unseen5-at-work too"]
    rows = list(enumerate(seeds + first + second + spread))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {rows[r.doc_id][1]: r.text for r in pii.redact(table).collect()}
    for text in first + second + spread[:3]:
        assert clean[text] == re.sub(r"\S+-at-\S+", "<EMAIL>", text)
    assert clean[spread[3]] == spread[3]
    once = {rows[r.doc_id][1]: r.text for r in pii.redact(table, rounds=1).collect()}
    assert once[second[-1]] == second[-1] and once[spread[0]] == clean[spread[0]]
    halves = ["+12345678901 is known", "not so +12345678901 234567 89"]  # a number that its surroundings hide
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame([*enumerate(halves)], "doc_id long, text string")).collect()}
    assert got[1].n_phone == 0 and got[1].spans == "phone:7:19" and got[1].n_added == 1


def test_personal_data_of_odd_rows(docs, texts, nothing):
    got = by_row(pii.spans(docs), "doc_id", "spans")
    assert got == Counter((i, pii.joined(plain_spans(t))) for i, t in texts)
    assert by_row(pii.redact(docs), "doc_id", "text", "key") == Counter((i, t, "x") for i, t in texts)
    assert pii.spans(nothing).count() == 0 and pii.redact(nothing).count() == 0


# ---- benchmark decontamination -------------------------------------------------------------------


def edits_inside(item, text):
    """The least edits between an item and any part of a text (no bands, no filter)."""
    now = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(now[j - 1] + (c != d), now[j] + 1, new[j - 1] + 1))
        now = new
    return min(now)


def test_contamination_against_plain_alignment(spark, texts):
    import random

    rng = random.Random(2)
    items = [t for _, t in texts[:8]]

    def worn(text, edits):
        chars = list(text)
        for _ in range(edits):
            k = rng.randrange(len(chars))
            chars[k:k + 1] = rng.choice([[], ["q"], [chars[k], "z"]])
        return "".join(chars)

    items = [t[:rng.randrange(60, 160)] for t in items] + ["tiny", None, "", items[0][:100]]
    rows = []
    for k in range(60):
        item = items[k % 8]
        rows.append((k, texts[20 + k % 5][1] + " " + worn(item, rng.randrange(0, 22)) + (", and. " if k % 2 else "") + texts[12][1]))
    rows += [(100, None), (101, ""), (102, items[1]), (None, items[2])]
    table = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, items[0])], "item_id long, text string")
    for chars in (4_000_000, 300):  # one block, many blocks
        got = {(r.doc_id, m.item_id): m.edits for r in contamination.find(table, bench, block_chars=chars).collect() for m in r.matches}
        want = {}
        for i, t in rows:
            for k, item in enumerate(items):
                p = contamination.plain(item)
                if t and len(p) >= contamination.Q and (e := edits_inside(p, contamination.plain(t))) <= contamination.budget(len(p), 0.1):
                    want[i, k] = e
        assert got == want and len(want) > 20
    kept = {r.doc_id for r in contamination.clean(table, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert contamination.clean(table, bench.limit(0)).count() == len(rows) and contamination.clean(table.limit(0), bench).count() == 0


def test_normalised_code_points():
    for text in ("Ab, c__d!", "", None, " .a", "a. ", "É\u0301x \u00a0İ9", "...", "日本 語", "x" * 9):
        assert contamination.plain_codes(text).tolist() == [ord(c) for c in contamination.plain(text)]


def test_long_and_periodic_texts(spark):
    item = "abcdefgh" * 12
    rows = [(1, "abcdefgh" * 9000), (2, "z" * 100_000), (3, "y " * 30_000 + item + " x" * 30_000)]
    got = {r.doc_id: len(r.matches) for r in contamination.find(spark.createDataFrame(rows, "doc_id long, text string"),
                                                                 spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


# ---- license scans -------------------------------------------------------------------------------


def test_licenses(spark, docs, texts, nothing):
    lines = ["Released under the MIT License.", "x under the mit license; CC BY-NC cc by nc, Apache License, Version 2.0", "all rights  RESERVED",
             "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu license", "é under the mit licenseé"]
    rows = [(i, t) for i, t in texts] + [(1000 + k, f"{texts[k][1]}\n{line}\n{texts[3][1]}") for k, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(label, set(w.split())) for label, w in licenses.TEMPLATES]
    want = Counter()
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        found, share = {label for _, label in at}, 1.0 if at else 0.0
        for line in (t or "").translate(LOWER).split("\n"):
            block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            for label, s in sets:
                if len(block & s) >= -(-len(s) * 9 // 10):
                    found.add(label)
                    share = max(share, len(block & s) / len(s))
        places = [k for k, _ in at]
        want[i, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in at})), ",".join(sorted(found)), round(share, 9)] += 1
    got = Counter((*r[:7], round(r.score, 9)) for r in licenses.scan(table).collect())
    assert got == want
    assert licenses.scan(nothing).count() == 0 and licenses.scan(docs).count() == len(texts)


def test_license_windows_cross_lines_and_end(spark):
    wrapped = {"mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files",
               "bsd": " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted",
               "apache-2": "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n  http://www.apache.org/"}
    rng, common = random.Random(4), sorted({w for _, words in licenses.TEMPLATES for w in words.split()})
    noise = lambda n: " ".join(rng.choice(["river", "walk", "seven"]) for _ in range(n))
    rows = [(k, f"{noise(lead)} {text} {noise(300)}") for k, (lead, text) in enumerate((lead, t) for lead in (0, 30, 47, 90, 95, 700) for t in wrapped.values())]
    far = "all " + noise(60) + " rights " + noise(60) + " reserved"  # one line, but no notice
    rows += [(500, far), (501, " ".join(f"{w} {noise(40)}" for w in wrapped["mit"].split()))]
    rows += [(600 + k, " ".join(rng.choice(common) if rng.random() < 0.8 else "x" for _ in range(400))) for k in range(20)]
    rows += [(700 + k, noise(40 + k) + " all" + " x" * (k // 2) + " rights " + noise(k % 2) + " reserved") for k in range(12)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].labels == list(wrapped)[k % 3] and got[k].score == 1.0 for k in range(18))
    assert got[500].labels == got[501].labels == "" and got[500].score == 0
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        found, share = set(), 0.0
        for label, w in licenses.TEMPLATES:
            s, width = set(w.split()), 2 * len(w.split())
            most = max(len(s.intersection(words[k:k + width])) for k in range(len(words)))
            if most >= -(-len(s) * 9 // 10):
                found.add(label)
                share = max(share, most / len(s))
        phrases = {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {' '.join(words)} "}
        assert got[i].labels == ",".join(sorted(found | phrases)) and abs(got[i].score - (1.0 if phrases else share)) < 1e-9


# ---- n-gram Jaccard join -------------------------------------------------------------------------


def sets_of(texts):
    out = []
    for _, t in texts:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate(LOWER)) if x]
        out.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    return out


@pytest.mark.parametrize("weight", [600_000, 3_000])
def test_jaccard_against_all_pairs(docs, texts, monkeypatch, weight):
    monkeypatch.setattr(jaccard, "PART_WEIGHT", weight)  # the smaller one cuts groups into many tiles
    sets, n = sets_of(texts), len(texts)
    near = [[j for j in range(n) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(n)]
    reach = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        reach[i] = min((texts[j][0] for j in seen if texts[j][0] is not None), default=None)
    want = Counter((texts[i][0], len(sets[i]), len(near[i]), reach[i]) for i in range(n))
    assert by_row(jaccard.jaccard_links(docs), "doc_id", "n_shingles", "n_links", "component_id") == want


def test_one_document_of_each_group_stays(docs, texts, nothing):
    kept = [(r.doc_id, r.text) for r in jaccard.distinct(docs).collect()]
    sets = {row: s for row, s in zip(texts, sets_of(texts))}
    assert len(kept) == len(set(kept)) and (None, "nobody's") in kept and (1, "another text of the id one") in kept
    for a in kept:
        for b in kept:
            assert a is b or not sets[a] or 100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b])
    assert {i for i, t in texts if not sets[i, t]} <= {i for i, _ in kept}
    assert jaccard.distinct(nothing).count() == 0 and jaccard.jaccard_links(nothing).count() == 0


def test_shingles_of_short_texts_and_separators():
    import pyarrow as pa

    column = pa.array(["a b c d e f", "a  B\tc", "", None, "a b c", "x", "a b c d e", "é f g"])
    parts = list(hashing.text_chunks(column, 8))
    sets = []
    for _, _, data, offsets in parts:
        words, _, _, first = hashing.word_hashes(data, offsets, hashing.WHITE_SPACE)
        grams, begin = hashing.shingle_hashes(words, first, 5)
        sets += [grams[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 1, 1, 1]
    assert sets[1] == sets[4] and sets[0][0] == sets[6][0] and len({s[0] for s in sets if s}) == 4


# ---- SentencePiece -------------------------------------------------------------------------------


def test_pieces_are_lossless_and_reproducible(docs, texts, nothing):
    a = pieces.encoded(docs, PIECES)
    back = by_row(pieces.decoded(a, PIECES, out="again"), "doc_id", "again")
    assert back == Counter((i, t or "") for i, t in texts)
    once = by_row(a.withColumn("p", F.concat_ws(",", "pieces")), "doc_id", "text", "p")
    assert once == by_row(pieces.encoded(docs.repartition(5), PIECES).withColumn("p", F.concat_ws(",", "pieces")), "doc_id", "text", "p")
    other = by_row(pieces.encoded(docs, PIECES, seed=1).withColumn("p", F.concat_ws(",", "pieces")), "doc_id", "text", "p")
    assert once != other and pieces.encoded(nothing, PIECES).count() == 0


def test_samples_follow_the_weights():
    v = pieces.load(PIECES)
    weight = dict(zip(v.ids.tolist(), v.weights))
    text, n = "the sea", 20_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.encode([text] * n, np.arange(n), v, 9))
    total = {}

    def walk(rest, ids, w):
        if not rest:
            total[tuple(ids)] = w
        for k in range(1, len(rest) + 1):
            if rest[:k] in by_name and (" " not in rest[1:k]):
                walk(rest[k:], [*ids, by_name[rest[:k]]], w + weight[by_name[rest[:k]]])

    by_name = {bytes(v.flat[v.starts[i]:v.starts[i + 1]]).decode(): i for i in v.ids.tolist()}
    walk(" " + text, [], 0.0)
    norm = sum(np.exp(w) for w in total.values())
    assert set(drawn) <= set(total)
    for ids, w in total.items():
        share = np.exp(w) / norm
        assert abs(drawn[ids] / n - share) < 5 * np.sqrt(share / n) + 1e-3


# ---- token files ---------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files_round_trip(docs, texts, nothing, mode, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    got = tokens.round_trip(docs, WORDS, mode=mode, block=1000).collect()
    want, start = Counter(), 0
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in got) == want
    assert tokens.round_trip(nothing, WORDS).count() == 0


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_any_range_of_ids(mode, tmp_path):
    ids = np.random.default_rng(0).integers(0, 2**32, 2500, dtype=np.uint32)
    writer = tokens.Writer(open(tmp_path / "f", "wb"), mode, 700)
    for a, b in ((0, 1), (1, 1500), (1500, 1500), (1500, 2500)):
        writer.add(a, ids[a:b])
    writer.close()
    reader = tokens.Reader(str(tmp_path / "f"))
    for a, n in ((0, 2500), (699, 2), (1400, 700), (2499, 1), (5, 0)):
        assert (reader.ids(a, n) == ids[a:a + n]).all()
    assert [len(x) for _, x in reader.documents()] == [1, 1499, 0, 1000]


def test_words_with_the_separator_and_rare_spaces():
    from tokenizers import Tokenizer

    model, words = Tokenizer.from_file(WORDS), tokens.Words(WORDS, 2)
    texts = ["a~b ~ c", "don't 12,5 é", "x y\x1cz", "~", "  lead", "Á ́"]
    assert [x.tolist() for x in words.encode(texts)] == [[*model.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_contexts_hold_whole_words():
    long = "x" * 300
    assert pii._context(f"call {long} 12", len(f"call {long} ")) == pii._context(f"a b call {long} 12", len(f"a b call {long} ")) != pii._context(f"hall {long} 12", len(f"hall {long} "))
    assert pii._context("one 12", 4) is None and pii._context("", 0) is None
    assert pii._context("one two 12", 8) == pii._context(f"{long * 50} one two 12", len(long) * 50 + 9)
