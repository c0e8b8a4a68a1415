"""Periodic runs of words: recursive splitting at rare words, then a scan of lags in what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import text_batches

CHUNK_BYTES = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def segments(ids: np.ndarray, text: np.ndarray, exponent: int, shortest: int) -> Iterator[np.ndarray]:
    """Positions of the stretches of words that may hold runs; ``text`` tells the words of one text from the next.

    Inside a run of period q every word comes at least ``exponent`` times, so a word that comes less
    often within its segment belongs to no run there and splits it. The parts count anew, until no
    segment has such a word; what is shorter than ``shortest`` falls away.
    """
    at, part = np.arange(len(ids)), np.asarray(text, np.int64)
    names = int(ids.max(initial=0)) + 1
    while len(at):
        _, place, count = np.unique(part * names + ids[at], return_inverse=True, return_counts=True)
        rare = count[place] < exponent
        splits = np.zeros(part[-1] + 1, bool)
        splits[part[rare]] = True
        stable = ~splits[part]
        if stable.any():
            done = at[stable]
            yield from np.split(done, np.flatnonzero((np.diff(done) != 1) | (np.diff(part[stable]) != 0)) + 1)
        kept = ~rare & ~stable
        at, part = at[kept], part[kept]
        if not len(at):
            return
        part = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(part) != 0))])
        kept = np.bincount(part)[part] >= shortest
        at, part = at[kept], part[kept]


def _agree(w: np.ndarray, i: int, q: int, step: int) -> int:
    """How many positions i, i + step, ... in a row hold the word that stands q later."""
    n, size, most = 0, 64, (len(w) - q - i if step > 0 else i + 1)
    while n < most:
        size = min(size, most - n)
        lo = i + n if step > 0 else i - n - size + 1
        differ = w[lo:lo + size] != w[lo + q:lo + q + size]
        if differ.any():
            return n + int((differ if step > 0 else differ[::-1]).argmax())
        n, size = n + size, size * 2
    return n


def lag_scan(w: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the word ids of one segment, by start, then period.

    A run of period q and at least ``exponent`` periods covers that many multiples of q, which hold one
    word: for each lag only those are looked at, n / q places, so all lags take n log n. Where they
    agree the stretch is followed both ways. A stretch of a multiple of its period is found already.
    """
    found: dict[tuple[int, int], int] = {}
    wide: list[tuple[int, int, int]] = []  # runs that may hold multiples of their period as long as the lag
    for q in range(1, len(w) // exponent + 1):
        every = w[::q]
        same = every[1:] == every[:-1]
        spots = same[:len(same) - exponent + 2]
        for k in range(1, exponent - 1):
            spots = spots & same[k:len(same) - exponent + 2 + k]
        spots = np.flatnonzero(spots) * q
        if not len(spots):
            continue
        reach = (exponent - 1) * q
        wide = [(start, end, p) for start, end, p in wide if end - start > reach]
        for start, end, p in wide:
            if q % p == 0:
                spots = spots[(spots < start) | (spots + reach >= end)]
        for t in range(1, 6):  # a few places between the multiples, before anything is followed
            probe = spots + (reach - q) * t // 6
            spots = spots[w[probe] == w[probe + q]]
        past = -1
        for i in spots.tolist():
            if i < past:
                continue
            right = _agree(w, i, q, 1)
            if right < reach - q:
                continue
            start, end = i - _agree(w, i - 1, q, -1), i + right + q
            past = i + right - reach + q  # later multiples of q inside this stretch
            if end - start >= max(shortest, exponent * q) and (start, end) not in found:
                found[start, end] = q
                wide.append((start, end, q))
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _runs_of(texts: list[list[bytes]], exponent: int, shortest: int) -> list[list[tuple[int, int, int]]]:
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for at in segments(ids, np.repeat(np.arange(len(texts)), sizes), exponent, shortest):
        t = int(np.searchsorted(first, at[0], "right")) - 1
        out[t] += [(int(at[0] - first[t]) + s, length, q) for s, length, q in lag_scan(ids[at], exponent, shortest)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            edges[start + q] += 1
            edges[start + length] -= 1
        words = [w for w, out in zip(words, (np.cumsum(edges[:-1]) > 0).tolist()) if not out]
    return b" ".join(words)


def _bytes_of(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts in lists of about CHUNK_BYTES; nulls are empty."""
    held, size = [], 0
    for value in column.cast(pa.large_binary()):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size > CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_runs(docs: DataFrame, text: str = "text", out: str = "periodic", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """Add ``out``: struct of ``runs`` (start, length, period in words from 0) and ``collapsed`` text.

    Words are stretches of anything but ASCII white space, told apart by case. A run is a stretch of
    smallest period q and at least max(``shortest``, ``exponent`` * q) words that no neighbour extends. In the
    collapsed text each run has its first period only, and single spaces stand between words.
    Null, empty and blank texts have no runs and collapse to nothing. Texts are looked at whole, each by
    itself: no row moves, so repeated rows and copies are no group. Runs come by start, then
    period. Other columns stay as they are; one named ``out`` is replaced.
    """
    if exponent < 2 or shortest < 1:
        raise ValueError("exponent must be at least 2 and shortest at least 1")
    text_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<runs:array<{RUN}>,collapsed:string>")
    def found(column: pa.Array) -> pa.Array:
        runs, texts = [], []
        for few in _bytes_of(column):
            words = [t.split() for t in few]
            some = _runs_of(words, exponent, shortest)
            texts += [_collapsed(w, r) for w, r in zip(words, some)]
            runs += some
        flat = np.array([r for some in runs for r in some], np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), each)
        return pa.StructArray.from_arrays([lists, pa.array(texts, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return docs.withColumn(out, found(F.col(text).cast("string")))


def looped(doc_id: str, text: str) -> Column:
    """The text of a row, or for one id in ten its words with a loop in place of the end.

    With h the crc32 of the id in decimal and g = h // 10, texts with h % 10 = 0 and n > 0 words repeat, from word
    a = g % n on, the 1 + (n - a) // (3 + g % 8) words that stand there. A null id changes nothing.
    """
    @F.arrow_udf("string")
    def loop(h: pa.Array, column: pa.Array) -> pa.Array:
        out = []
        for code, value in zip(h.to_pylist(), column.cast(pa.large_binary())):
            words = (value.as_py() or b"").split()
            if code is not None and code % 10 == 0 and words:
                g, n = code // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = (words[a:a + p] * (-(-(n - a) // p)))[:n - a]
                out.append(b" ".join(words))
            else:
                out.append(value.as_py())
        return pa.array(out, pa.binary()).cast(pa.string())

    return loop(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.col(text).cast("string"))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document with the digest columns of its runs, after ``looped`` (docs: doc_id, text)."""
    rows = find_runs(docs.select("doc_id", looped("doc_id", "text").alias("text")))
    runs = F.col("periodic.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = rows.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("best"), runs.alias("runs"), F.col("periodic.collapsed").alias("collapsed"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
