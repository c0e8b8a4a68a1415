"""Text scoring rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import col

# Word lists and patterns the scores depend on.
ARTICLES = ("a", "an", "the")
COLORS = ("red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "brown", "gray", "grey")
SIZES = ("large", "small", "big", "tiny", "huge", "little")
POSITIONS = ("left", "right", "top", "bottom", "center", "middle", "above", "below", "beside", "near")
NOT_OBJECTS = ("a", "an", "the", "is", "are", "and", "or", "of", "in")
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PUNCTUATION = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SENTENCE = r"[^.!?\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][^.!?]*"
FULL_LENGTH, FULL_SENTENCES = 50.0, 3.0
WEIGHTS = {"length": 0.3, "vocab": 0.3, "repetition": 0.2, "sentences": 0.2}


def strip(text: str | Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def words(text: str | Column) -> Column:
    """Split on runs of white space; no empty words."""
    return F.filter(F.split(col(text), f"{SPACE}+"), lambda w: w != "")


def normalise_answer(text: str | Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(col(text)), PUNCTUATION, "")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin(*ARTICLES)), " ")


def shared_share(pred_words: Column, gt_words: Column) -> Column:
    """Distinct shared words over distinct reference words."""
    return F.size(F.array_intersect(pred_words, gt_words)) / F.size(F.array_distinct(gt_words))


def vqa_score(pred: str | Column, gt: str | Column) -> Column:
    """Score of two normalised answers; null where the reference is empty."""
    p, g = col(pred), col(gt)
    return (F.when(g == "", F.lit(None).cast("double")).when(p == g, 1.0)
            .when(F.contains(p, g) | F.contains(g, p), 0.5)
            .otherwise(shared_share(F.split(p, " "), F.split(g, " ")) * 0.5))


def bindings(word_column: str, attributes: tuple[str, ...] = COLORS + SIZES + POSITIONS) -> Column:
    """(attr, obj) for each attribute word followed by a word that can be an object."""
    w = F.col(word_column)
    near = F.transform(w, lambda x, i: F.struct(x.alias("attr"), F.get(w, i + 1).alias("obj")))
    return F.filter(near, lambda s: s["attr"].isin(*attributes) & s["obj"].isNotNull() & ~s["obj"].isin(*NOT_OBJECTS))


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal, contained, or long words sharing most of their letters."""
    la, lb = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    close = F.size(F.array_intersect(la, lb)) / F.greatest(F.size(la), F.size(lb)) > 0.6
    return F.contains(a, b) | F.contains(b, a) | ((F.length(a) > 3) & (F.length(b) > 3) & close)


def with_binding_counts(df: DataFrame, pred: str, gt: str) -> DataFrame:
    """Add ``hits`` and ``total`` of each answer (X24); a reference without pairs counts once by word overlap."""
    low = df.withColumn("__gw", words(F.lower(gt))).withColumn("__pw", words(F.lower(pred)))
    low = low.withColumn("__gb", bindings("__gw")).withColumn("__pb", bindings("__pw"))
    found = F.size(F.filter("__gb", lambda g: F.exists(
        "__pb", lambda p: (g["attr"] == p["attr"]) & fuzzy_match(g["obj"], p["obj"]))))
    empty, none = F.size("__gw") == 0, F.size("__gb") == 0
    return (low.withColumn("hits", F.when(empty, 0.0).when(none, shared_share(F.col("__pw"), F.col("__gw")))
                           .otherwise(found.cast("double")))
            .withColumn("total", F.when(empty, 0).when(none, 1).otherwise(F.size("__gb")))
            .drop("__gw", "__pw", "__gb", "__pb"))


def substring_hit(pred: str | Column, gt: str | Column) -> Column:
    """1 if the non-empty reference occurs in the prediction, ignoring case."""
    p, g = strip(F.lower(col(pred))), strip(F.lower(col(gt)))
    return F.when((g != "") & F.contains(p, g), 1.0).otherwise(0.0)


def chosen_option(pred: str | Column, options: str | Column) -> Column:
    """Index of the first option contained in the prediction, or null."""
    p = strip(F.lower(col(pred)))
    hit = F.filter(F.transform(col(options), lambda o, i: F.when(F.contains(p, F.lower(o)), i)), lambda i: i.isNotNull())
    return F.get(hit, F.lit(0))


def with_quality_parts(df: DataFrame, text: str) -> DataFrame:
    """Add ``n_words``, ``ttr``, ``repetition`` and ``n_sentences`` of each text.

    Repeated trigrams are counted inside the row: equal neighbours after sorting.
    """
    w = df.withColumn("__w", words(text))
    n = F.size("__w")
    tri = F.transform(F.slice("__w", 1, F.greatest(n - 2, F.lit(0))),
                      lambda x, i: F.concat_ws(" ", x, F.get("__w", i + 1), F.get("__w", i + 2)))
    w = w.withColumn("__t", F.sort_array(tri))
    repeated = F.size(F.filter("__t", lambda x, i: (x == F.get("__t", i + 1)) & ((i == 0) | (x != F.get("__t", i - 1)))))
    return (w.withColumn("n_words", n)
            .withColumn("ttr", F.when(n > 0, F.size(F.array_distinct(F.transform("__w", F.lower))) / n).otherwise(0.0))
            .withColumn("repetition", F.when(n >= 3, repeated / (n - 2)).otherwise(0.0))
            .withColumn("n_sentences", F.regexp_count(F.col(text), F.lit(SENTENCE)))
            .drop("__w", "__t"))
