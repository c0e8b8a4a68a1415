"""Benchmark decontamination: q-gram counts in diagonal bands, verified by banded alignment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .hashing import mix
from .storage import process_cache, text_batches

Q = 8
FILTER_BITS = 22
WINDOW = 1 << 14
_GAP = re.compile(r"[\W_]+")
_STEPS = [(1 << k, step) for k, step in enumerate(mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1))]  # 2, 4 and Q characters
MATCHES = "array<struct<item_id:long,edits:int,start:int>>"


def plain(text: str | None) -> str:
    """Lower case, with runs of anything but letters and digits as one space, none at the ends."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def plain_codes(text: str | None) -> np.ndarray:
    """The code points of ``plain(text)``, by a table of letters and digits instead of an expression."""
    loaded = process_cache("contamination")
    if "alnum" not in loaded:
        loaded["alnum"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    keep = loaded["alnum"][codes]
    first = np.empty(len(codes), bool)
    first[:1] = False
    first[1:] = keep[:-1] & ~keep[1:]  # of each gap its first character stays, as a space
    out = np.where(keep, codes, np.uint32(32))[keep | first]
    return out[:-1] if len(out) and out[-1] == 32 else out


def _grams(codes: np.ndarray) -> np.ndarray:
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    out = codes.astype(np.uint64)
    for reach, step in _STEPS:
        longer = out[:-reach] * step
        longer += out[reach:]
        out = longer
    return mix(out)


def budget(length: int, rate: float) -> int:
    """Edits allowed in an item: rate * length, but so few that the lemma asks for one q-gram at least."""
    return max(0, min(int(length * rate), (length + 1) // Q - 1))


@dataclass
class Index:
    """Q-grams of some items: sorted hashes with the (item, place) pairs of each, and a filter before them."""

    ids: np.ndarray
    codes: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray  # q-grams that an occurrence shares with the item
    overlap: int
    hashes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def build(items: list[tuple[int, str]], rate: float) -> Index | None:
    """An index of (item_id, text); items of fewer than Q normalised characters are left out."""
    items = [(i, c) for i, c in ((i, plain_codes(t)) for i, t in items) if len(c) >= Q]
    if not items:
        return None
    codes = [c for _, c in items]
    grams = [_grams(c) for c in codes]
    flat = np.concatenate(grams)
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(flat, kind="stable")
    hashes, starts = np.unique(flat[order], return_index=True)
    marks = np.zeros(1 << FILTER_BITS, bool)
    marks[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    lengths, edits = np.array([len(c) for c in codes]), np.array([budget(len(c), rate) for c in codes])
    overlap = 2 * int(lengths.max()) + 8 * int(edits.max() + 1)  # of windows of a text, so that one of them holds an occurrence
    return Index(np.array([i for i, _ in items]), codes, edits, lengths - Q + 1 - Q * edits, overlap, hashes,
                 np.append(starts, len(flat)), item[order].astype(np.int64), place[order].astype(np.int64), marks)


def _bands(grams: np.ndarray, offset: int, index: Index) -> list[tuple[int, int]]:
    """(item, first diagonal) of bands of 2 (edits + 1) diagonals that hold the q-grams an occurrence must share.

    An occurrence within e edits shares at least length - Q + 1 - Q e q-grams with its item, on
    diagonals at most e apart, hence inside one of the bands, which overlap by half.
    """
    at = np.flatnonzero(index.filter.take((grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)))
    if not len(at):
        return []
    spot = np.searchsorted(index.hashes, grams[at])
    spot[spot == len(index.hashes)] = 0
    same = index.hashes[spot] == grams[at]
    at, spot = at[same], spot[same]
    sizes = index.starts[spot + 1] - index.starts[spot]
    if not sizes.sum():
        return []
    ends = np.cumsum(sizes)
    pick = np.arange(ends[-1]) + np.repeat(index.starts[spot] - (ends - sizes), sizes)
    item = index.item[pick]
    enough = np.bincount(item, minlength=len(index.least)) >= index.least  # else no band of the item can have them
    kept = np.flatnonzero(enough[item])
    if not len(kept):
        return []
    item = item[kept]
    diagonal = np.repeat(at + offset, sizes)[kept] - index.place[pick[kept]]
    step = index.edits[item] + 1
    band = np.floor_divide(diagonal, step)
    names, counts = np.unique(item << np.int64(40) | (band + (1 << 39)), return_counts=True)
    after = np.zeros(len(names), np.int64)
    follows = np.flatnonzero(np.diff(names) == 1)
    after[follows] = counts[follows + 1]
    before = np.ones(len(names), bool)
    before[follows + 1] = False  # the band that begins one earlier holds these too
    item = names >> 40
    first = (names & ((1 << 40) - 1)) - (1 << 39)
    step = index.edits[item] + 1
    hit = counts + after >= index.least[item]
    return [(int(i), int(b * s)) for i, b, s in zip(item[hit], first[hit], step[hit])]


def _aligned(jobs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[tuple[int, int]]:
    """(least edits, end in the text) of each (item, text, first diagonal, edits) inside its band, all at once.

    Row by row of the items; a cell (i, k) stands for text position i + k + low. The text may
    begin and end anywhere in the band. Items that have used up their edits are not followed to their end.
    """
    wide = max(4 * (e + 1) for *_, e in jobs)
    low = np.array([d - e for _, _, d, e in jobs])
    longest = max(len(i) for i, *_ in jobs)
    items = np.zeros((len(jobs), longest), np.int32)
    texts = np.full((len(jobs), longest + wide + 1), -1, np.int32)
    for n, (item, text, _, _) in enumerate(jobs):
        items[n, :len(item)] = item
        a, b = max(0, low[n]), min(len(text), low[n] + longest + wide + 1)
        if b > a:
            texts[n, a - low[n]:b - low[n]] = text[a:b]
    lengths, edits = np.array([len(i) for i, *_ in jobs]), np.array([e for *_, e in jobs])
    alive = np.arange(len(jobs))
    slide = np.arange(wide, dtype=np.int32)
    now = np.zeros((len(jobs), wide), np.int32)
    out: list[tuple[int, int]] = [(1 << 30, 0)] * len(jobs)
    for i in range(1, longest + 1):
        if i % 32 == 0:  # the least of a row never falls from row to row
            near = (now.min(axis=1) <= edits[alive]) & (lengths[alive] >= i)
            alive, now, texts, items = (x[near] for x in (alive, now, texts, items))
            if not len(alive):
                break
        new = now + (texts[:, i - 1:i - 1 + wide] != items[:, i - 1:i])
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        now = np.minimum.accumulate(new - slide, axis=1) + slide
        for row in np.flatnonzero(lengths[alive] == i):
            k, n = int(np.argmin(now[row])), alive[row]
            out[n] = int(now[row, k]), int(low[n] + i + k)
    return out


def _search(codes: np.ndarray, index: Index) -> list[tuple[int, int]]:
    grams = _grams(codes)
    found: set[tuple[int, int]] = set()
    for a in range(0, max(1, len(grams)), WINDOW):
        found.update(_bands(grams[a:a + WINDOW + index.overlap], a, index))
    return sorted(found)


def _matches(texts: pd.Series, index: Index) -> list[list[dict]]:
    out: list[list[dict]] = []
    jobs, whose = [], []
    for n, text in enumerate(texts):
        out.append([])
        codes = plain_codes(text)
        for item, diagonal in _search(codes, index):
            jobs.append((index.codes[item], codes, diagonal, int(index.edits[item])))
            whose.append((n, item))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    order = sorted(range(len(jobs)), key=lambda n: len(jobs[n][0]))  # items of about one length at a time
    for k in range(0, len(jobs), 256):
        some = order[k:k + 256]
        for (n, item), (edits, end) in zip([whose[n] for n in some], _aligned([jobs[n] for n in some])):
            if edits <= index.edits[item]:
                best[n, item] = min(best.get((n, item), (1 << 30, 0)), (edits, max(0, end - len(index.codes[item]))))
    for (n, item), (edits, start) in sorted(best.items()):
        out[n].append({"item_id": int(index.ids[item]), "edits": edits, "start": start})
    return out


def _matcher(shared):
    @F.pandas_udf(MATCHES)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_matches(texts, shared.value))

    return matched


def find(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000, out: str = "matches") -> DataFrame:
    """Add ``out``: the benchmark items that occur in each whole text within rate * length edits.

    Texts are compared in lower case with runs of other characters than letters and digits as
    one space. Each match has item_id, the least number of edits and about where it begins in
    the normalised text. Items come in blocks of about ``block_chars`` characters; each block's
    index, of bounded size, is broadcast, and the texts are searched for one block after the
    other. Items that are null, have a null id or fewer than Q normalised characters match nothing.
    Null and empty texts match nothing. All rows and other columns stay; ``out`` is replaced.
    """
    spark = docs.sparkSession
    text_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    found = []
    for b in range(blocks):
        index = build([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toLocalIterator()], rate)
        if index is None:
            continue
        found.append(_matcher(spark.sparkContext.broadcast(index))(F.col("text").cast("string")))
    return docs.withColumn(out, F.concat(*found) if found else F.array().cast(MATCHES))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs; see ``find``."""
    names = docs.columns
    return find(docs, benchmark, out="__matches", **options).where(F.size("__matches") == 0).select(*names)
