"""Personal data: patterns of fixed forms, and contexts learnt from them by bootstrapping."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import WHITE_SPACE, mix, text_chunks, word_hashes
from .storage import kept, text_batches

KINDS = ("email", "ip", "card", "phone")
BITS = 22  # of the filter of context hashes: 512 KB
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SHAPED = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^ \t-\r]+")
_EDGE = "\"'`.,;:!?()[]{}<>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part runs up to its @; of a run that the last match cut short the rest counts."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost and not overlapping within a kind, by start and kind.

    The expressions match what the plain ones match, without their repeated scans of long runs.
    """
    if not text:
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    if _SHAPED.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                found.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9FB21C651E98DF25) + second)


def _context(text: str, start: int) -> int | None:
    """The hash of the two words before ``start``, or of a word and the beginning of the one there, however long they are."""
    back = 64
    while len(words := _WORD.findall(text[max(0, start - back):start])) < 3 and back < start:
        back *= 4  # with three words in sight the last two are whole
    words = words[-2:]
    if len(words) < 2:
        return None
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes = word_hashes(data, np.array([0, len(data)]), WHITE_SPACE)[0]
    return int(_pair_hash(hashes[:1], hashes[1:])[0].view(np.int64))


_FOUND = "kind int, doc_id long, key long, spans string, counts array<long>, start int, stop int, context long, item long, seed string"
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.string()), ("counts", pa.list_(pa.int64())),
                           ("start", pa.int32()), ("stop", pa.int32()), ("context", pa.int64()), ("item", pa.int64()), ("seed", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) -> kind 0: a row's base spans; kind 1: words formed like identifiers, with their context if they have one."""
    for batch in batches:
        out = []
        for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            spans = base_spans(text)
            counts = [sum(k == kind for _, _, k in spans) for kind in KINDS]
            out.append((0, doc_id, key, joined(spans), counts, None, None, None, None, None))
            if not text:
                continue
            places = [(a, b, kind) for a, b, kind in spans]
            done, taken, at = 0, sorted((a, b) for a, b, _ in spans), 0
            for m in _SHAPED.finditer(text):
                if m.start() < done:
                    continue
                a = m.start()
                while a > done and text[a - 1] not in " \t\n\v\f\r":
                    a -= 1
                word = _WORD.match(text, a)
                done = word.end()
                core = word.group().strip(_EDGE)
                if len(core) < 6:
                    continue
                a += word.group().index(core)
                while at < len(taken) and taken[at][1] <= a:  # spans and words both go from left to right
                    at += 1
                if not any(x < a + len(core) and a < y for x, y in taken[at:at + 4]):
                    places.append((a, a + len(core), None))
            for a, b, kind in places:
                item = int.from_bytes(hashlib.blake2b(text[a:b].lower().encode(), digest_size=8).digest(), "little", signed=True)
                out.append((1, None, key, None, None, a, b, _context(text, a), item, kind))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND_SCHEMA)], schema=_FOUND_SCHEMA)


def _fillers(marked: np.ndarray):
    """How often any word at all follows each context that ``marked`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words, _, _, first = word_hashes(data, offsets, WHITE_SPACE)
                if len(words) < 3:
                    continue
                inside = np.ones(len(words), bool)
                inside[first[1:][first[1:] > 0] - 1] = False  # a text's last word has none after it
                pairs = _pair_hash(words[:-1], words[1:])
                last = np.zeros(len(words), bool)
                last[np.maximum(first[1:] - 2, 0)[first[1:] - first[:-1] >= 2]] = True
                pairs = pairs[inside[:-1] & ~last[:-1]]
                spot = (pairs >> np.uint64(64 - BITS)).astype(np.int64)
                pairs = pairs[(marked[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
                names, counts = np.unique(pairs, return_counts=True)
                if len(names):
                    yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(counts)], names=["context", "n"])

    return run


def row_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _trusted(docs: DataFrame, found: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """(item, seed) of the items to be trusted with a kind: all seeds and what the rounds discover."""
    spark = docs.sparkSession
    edges = kept(found.where("kind = 1 and context is not null").groupBy("context", "item").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "contexts")
    # Seeds of any round are items, so no other context can come to be supported.
    able = edges.groupBy("context").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") >= support).select("context")
    marked = np.zeros(1 << (BITS - 3), np.uint8)
    for r in (able.groupBy(F.expr(f"shiftrightunsigned(context, {64 - BITS}) div 64").alias("at"))
              .agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(context, {64 - BITS}) % 64 AS int)))").alias("bits")).toLocalIterator()):
        marked[r["at"] * 8:r["at"] * 8 + 8] = np.frombuffer(np.int64(r["bits"]).tobytes(), np.uint8)
    shared = spark.sparkContext.broadcast(marked)
    fillers = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _fillers(shared.value)(it), "context long, n long")
               .groupBy("context").agg(F.sum("n").alias("all")))
    near = kept(edges.join(able, "context", "left_semi"), "near")
    totals = kept(near.groupBy("context").agg(F.sum("n").alias("seen")).join(fillers, "context", "left").select(
        "context", F.greatest("seen", F.coalesce("all", F.lit(0))).alias("all")), "totals")
    prior = support * (1 / confidence - 1)  # of ``support`` words that all are seeds the confidence is just enough
    base = near.where("seed is not null").select("item", "seed").distinct()
    seeds, new = base.withColumn("s", F.lit(1.0)), None
    for _ in range(rounds):
        weighed = (near.select("context", "item", "n").join(seeds, "item").groupBy("context", "seed")
                   .agg(F.sum(F.col("s") * F.col("n")).alias("good"), F.count(F.lit(1)).alias("items")).where(F.col("items") >= support))
        conf = weighed.join(totals, "context").select("context", "seed", (F.col("good") / (F.col("all") + prior)).alias("conf"))
        strong = conf.where(F.col("conf") >= confidence - 1e-9)
        scores = (near.where("seed is null").select("context", "item").join(strong, "context").groupBy("item", "seed")
                  .agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("s")))
        new = kept(scores.where(F.col("s") >= confidence - 1e-9).join(base, ["item", "seed"], "left_anti"), "trusted")
        seeds = base.withColumn("s", F.lit(1.0)).unionByName(new.select("item", "seed", "s"))
    known = found.where("kind = 1 and seed is not null").select("item", "seed").distinct()
    return known if new is None else known.unionByName(new.select("item", "seed"))


def find(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(rows, added): base spans of every row of ``docs``, and further spans by the key of the text.

    Bootstrapping: base spans are the first seeds. A context is the pair of words before an item.
    For contexts that introduce ``support`` different items, all words that follow them anywhere
    are counted. Then, in ``rounds``: a context that introduces ``support`` different seeds of a
    kind has as confidence the scores of the seeds it introduces over everything that follows it
    (plus as much as makes ``support`` pure occurrences just enough); an item's score is 1 for a
    base span, else the chance that one of its contexts of at least ``confidence`` is right; items
    of at least ``confidence`` are seeds of the next round. Words formed like an identifier (with
    a digit or @, six characters or more, no base span) that are seeds after the last round become
    spans of their kind wherever they stand, also behind other contexts or none.

    Null texts are empty. Rows of one doc_id keep their own text's spans. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    found = kept(pairs.mapInArrow(_find, _FOUND), "pii")
    trusted = _trusted(docs, found, rounds, support, confidence)
    added = (found.where("kind = 1 and seed is null").drop("seed").join(trusted, "item")
             .groupBy("key").agg(F.collect_set(F.concat_ws(":", "seed", "start", "stop")).alias("added")))
    return found.where("kind = 0"), added


def _merged(base: str, added: np.ndarray | None) -> str:
    spans = [s.split(":") for s in ([*base.split(",")] if base else []) + ([] if added is None else list(added))]
    return ",".join(":".join(s) for s in sorted(spans, key=lambda s: (int(s[1]), KINDS.index(s[0]), int(s[2]))))


def spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of ``docs``; see ``find``."""
    rows, added = find(docs, **options)

    @F.pandas_udf("string")
    def merged(base: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([_merged(b, m) for b, m in zip(base, more)])

    counts = [F.col("counts")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return (rows.drop("start", "stop").join(added, "key", "left")
            .select("doc_id", *counts, F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), merged("spans", "added").alias("spans"),
                    F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added")))


def _redacted(text: str | None, spans_text: str) -> str | None:
    if text is None or not spans_text:
        return text
    out, end = [], 0
    for kind, a, b in (s.split(":") for s in spans_text.split(",")):
        if int(a) >= end:
            out += [text[end:int(a)], f"<{kind.upper()}>"]
        end = max(end, int(b))
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind; all rows and other columns stay."""
    _, added = find(docs, **options)

    @F.pandas_udf("string")
    def redacted(text: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([_redacted(t, _merged(joined(base_spans(t)), m)) for t, m in zip(text, more)])

    names = docs.columns
    rows = docs.withColumn("__key", row_key()).join(added.select(F.col("key").alias("__key"), F.col("added").alias("__added")), "__key", "left")
    return rows.withColumn("text", redacted(F.col("text").cast("string"), "__added")).select(*names)
