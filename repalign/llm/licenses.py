"""License scans: phrases, and an exact set-similarity join of word windows with license templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .storage import kept

# Phrases (as words) and the labels they mean.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wordings of public license notices and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("all-rights-reserved", "all rights reserved"),
)
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 2  # words of a window for each word of the template


def _plain(text: Column) -> Column:
    """The words of the text, A-Z lower-cased, with one space for every run of other ASCII characters."""
    upper = "".join(map(chr, range(65, 91)))
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), _OTHER, " "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _base(row: DataFrame) -> DataFrame:
    """Places of PHRASES: words stand between spaces of their own, so that places can't share one."""
    wide = F.replace("plain", F.lit(" "), F.lit("  "))
    row = row.withColumn("wide", F.when(wide == "", F.lit("")).otherwise(F.concat(F.lit(" "), wide, F.lit(" "))))
    row = row.withColumn("n_words", F.expr("(length(wide) - length(replace(wide, ' ', ''))) div 2"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        p = F.lit(f" {phrase.replace(' ', '  ')} ")
        has = F.contains("wide", p)
        counts.append(F.when(has, ((F.length("wide") - F.length(F.replace("wide", p, F.lit("")))) / F.length(p)).cast("long")).otherwise(F.lit(0)))
        start, end = F.substring_index("wide", f" {phrase.replace(' ', '  ')} ", 1), F.substring_index("wide", f" {phrase.replace(' ', '  ')} ", -1)
        firsts.append(F.when(has, (_spaces(start) / 2).cast("long")))
        lasts.append(F.when(has, (F.col("n_words") - _spaces(end) / 2 - len(phrase.split())).cast("long")))
        labels.append(F.when(has, F.lit(label)))
    return (row.withColumn("n_base", sum(counts[1:], counts[0]).cast("long"))
            .withColumn("first_word", F.least(*firsts)).withColumn("last_word", F.greatest(*lasts))
            .withColumn("base", F.array_compact(F.array(*labels))).drop("wide"))


def scan(docs: DataFrame, threshold: float = 0.9, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    A template is found in a text if some window of the text, WIDTH words for each word of the
    template, holds ceil(threshold * size) of the template's distinct words. Line feeds are
    separators like all others. ``labels`` joins the labels of phrases and of found templates,
    ``score`` is the largest share that a window holds of any template found, or 1 with a phrase.

    The join: words are ordered by the number of blocks that hold them, rare first. A block must
    be as large as the least overlap (length filter) and hold one of the rare words of the
    template that a match can't do without (prefix filter); words after the first common one
    bound the overlap (positional filter); what is left is counted. Only words of templates
    can overlap, so blocks are cut down to them first. A block is two neighbouring pieces of the
    text, each as long as the widest window, so every window lies in a block and blocks are of
    bounded size; the windows of the blocks that are left are counted one by one. The templates
    are constants of this module, so their table is of fixed size and is broadcast.

    Null and empty texts have no words and no labels (empty strings), score 0 and null places. Rows of one
    doc_id are judged by their own text; equal rows are equal in the result. Other columns are ignored.
    """
    spark = docs.sparkSession
    sets = [(k, label, sorted(set(words.split()))) for k, (label, words) in enumerate(templates)]
    need = {k: math.ceil(threshold * len(words)) for k, _, words in sets}
    vocabulary, least = sorted({w for _, _, words in sets for w in words}), min(need.values())

    width = {k: WIDTH * len(words.split()) for k, (_, words) in enumerate(templates)}
    step = max(width.values())

    row = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), _plain(F.col("text")).alias("plain"))
    piece = lambda k: F.transform(F.slice("words", k * step + 1, step), lambda w, i: F.struct(i.cast("short").alias("at"), w.alias("word")))
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {step}").cast("int")), lambda k: F.filter(piece(k), lambda h: h["word"].isin(vocabulary)))
    rows = kept(_base(row.withColumn("words", F.split("plain", " ")).withColumn("pieces", pieces).drop("words")).drop("plain"), "licenses")

    words_of = lambda hits: F.array_distinct(hits["word"])
    after = lambda k: F.transform(F.coalesce(F.get("pieces", k + 1), F.array().cast(rows.schema["pieces"].dataType.elementType)),
                                  lambda h: F.struct((h["at"] + step).cast("short").alias("at"), h["word"].alias("word")))
    joined = F.transform(F.sequence(F.lit(0), F.greatest(F.size("pieces") - 2, F.lit(0))), lambda k: F.concat(F.get("pieces", k), after(k)))
    block = rows.select("key", F.explode(F.filter(joined, lambda b: F.size(words_of(b)) >= least)).alias("hits")).withColumn("block", words_of(F.col("hits")))
    held = {r["word"]: r["count"] for r in rows.select(F.explode("pieces").alias("hits")).select(F.explode(words_of(F.col("hits"))).alias("word")).groupBy("word").count().collect()}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (held.get(w, 0), w)))}
    prefixes = []
    for k, label, words in sets:
        ranks = sorted(order[w] for w in words)
        prefixes += [(k, label, ranks, need[k], width[k], rank, pos) for pos, rank in enumerate(ranks[:len(ranks) - need[k] + 1])]
    table = F.broadcast(spark.createDataFrame(prefixes, "template int, label string, ranks array<int>, need int, width int, rank int, at int"))
    rare = sorted({w for w in vocabulary if order[w] in {p[5] for p in prefixes}})
    rank_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    found = (block.where(F.arrays_overlap("block", F.array(*map(F.lit, rare)))).distinct()
             .select("key", F.array_sort(F.transform("block", lambda w: rank_of[w])).alias("has"), F.transform("hits", lambda h: F.struct(h["at"], rank_of[h["word"]].alias("rank"))).alias("hits"))
             .select("key", "has", "hits", F.posexplode("has").alias("pos", "rank"))
             .where(F.col("pos") <= F.size("has") - least)
             .join(table, "rank")
             .where((F.size("has") >= F.col("need")) & (F.lit(1) + F.least(F.size("has") - F.col("pos"), F.size("ranks") - F.col("at")) - 1 + F.least("pos", "at") >= F.col("need")))
             .where(F.size(F.array_intersect("has", "ranks")) >= F.col("need"))
             .select("key", "template", "label", "ranks", "need", "width", F.filter("hits", lambda h: F.array_contains("ranks", h["rank"])).alias("hits"))
             .withColumn("both", F.array_max(F.transform("hits", lambda a: F.size(F.array_distinct(F.filter("hits", lambda h: (h["at"] >= a["at"]) & (h["at"] < a["at"] + F.col("width")))["rank"])))))
             .where("both >= need")
             .groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.col("both") / F.size("ranks")).alias("share")))
    more = F.coalesce("more", F.array().cast("array<string>"))
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return (rows.join(found, "key", "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"),
                    text(F.concat("base", more)).alias("labels"),
                    F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score")))
