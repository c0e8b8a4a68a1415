"""URL rules as one bit-parallel automaton: all patterns advance together, a byte of each URL at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .storage import kept

ALLOW, BLOCK = "allow", "block"
# Patterns of more symbols than this are cut into automata of their own, a table between them:
# the compiled tables of one automaton take at most MOST_BITS / 8 * 512 bytes (16 MB).
MOST_BITS = 1 << 18
CELLS = 1 << 19
_UPPER = "".join(map(chr, range(65, 91)))


@dataclass(frozen=True)
class Rule:
    """``glob`` over ``.host/path``: ``?`` is one character, ``*`` any without ``/``, ``**`` any; ``\\`` escapes.

    Of the rules that fit a URL the one of highest ``rank`` decides, then the longer ``name``, then a blocking one,
    then the smaller ``name``.
    """

    glob: str
    verdict: str
    name: str
    rank: int = 0


def site(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, and paths that start with ``path``; it goes before plain globs."""
    literal = re.sub(r"([*?\\])", r"\\\1", host + path)
    return Rule(f"*.{literal}**", verdict, host + path, 1)


# The rules of the query.
SITES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))
# Where no site rule fits: kinds of hosts and paths that a corpus does without.
GLOBS = ("*casino*/**", "*-bets.**", "*pills*/**", "*.ads-track.**", "*.ads?.*/**", "**/login/**", "**/cart/**", "**.exe")
RULES = tuple(site(*s) for s in SITES) + tuple(Rule(g, BLOCK, g) for g in GLOBS)


def _symbols(glob: str) -> list[tuple[str, int]]:
    """(kind, byte): literal bytes, ``one`` character, ``within`` (no slash) and ``any`` runs."""
    out: list[tuple[str, int]] = []
    for token in re.findall(r"\\.|\*+|\?|[^\\*?]+|\\$", glob, re.DOTALL):
        if token[0] == "*":
            out.append(("any" if len(token) > 1 else "within", 0))
        elif token == "?":
            out.append(("one", 0))
        else:
            out += [("byte", b) for b in (token[1:] if token[0] == "\\" and len(token) > 1 else token).encode()]
    return out


@dataclass(frozen=True)
class Automaton:
    """Masks by byte, in words of 64 bits: ``step`` may be entered, ``stay`` is kept; each rule ends at a bit."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    ends: np.ndarray
    rules: tuple[Rule, ...]


def compiled(rules: Sequence[Rule]) -> Automaton:
    """Rules in the order in which they decide, their states one after the other in the masks."""
    rules = tuple(sorted(rules, key=lambda r: (-r.rank, -len(r.name), r.verdict != BLOCK, r.name)))
    shapes = [_symbols(r.glob) for r in rules]
    bits = sum(1 + sum(kind in ("byte", "one") for kind, _ in shape) for shape in shapes)
    step, stay = np.zeros((bits, 256), bool), np.zeros((bits, 256), bool)
    start, ends, at = np.zeros(bits, bool), [], 0
    inner = np.zeros(256, bool)
    inner[0x80:0xC0] = True  # the later bytes of a character
    slash = np.arange(256) == ord("/")
    for shape in shapes:
        start[at] = True
        for kind, byte in shape:
            if kind in ("byte", "one"):
                at += 1
                step[at] = np.arange(256) == byte if kind == "byte" else ~inner
                if kind == "one":
                    stay[at] = inner
            else:
                stay[at] |= True if kind == "any" else ~slash
        ends.append(at)
        at += 1

    def packed(rows: np.ndarray) -> np.ndarray:
        """(bits, n) booleans -> (n, words) of 64 bits, the first bit lowest."""
        rows = np.pad(rows, ((0, -len(rows) % 64), (0, 0)))
        return np.ascontiguousarray(np.packbits(rows.T, axis=1, bitorder="little")).view(np.uint64)

    return Automaton(packed(step), packed(stay), packed(start[:, None])[0], np.array(ends, np.int64), rules)


def judge(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The place of the deciding rule of each URL, -1 where none fits.

    Longer URLs stand first, so those not yet at their end are always the first rows. Shift-And with
    gaps: a state is entered from the one before it by a byte of its class, or kept by its loop.
    """
    sizes = np.diff(offsets)
    out = np.full(len(sizes), -1, np.int32)
    rows = max(1, CELLS // automaton.step.shape[1])
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), rows):
        some = order[lo:lo + rows]
        begin, length = offsets[some], sizes[some]
        states = np.repeat(automaton.start[None], len(some), axis=0)
        for i in range(int(length[0])):
            live = int(np.searchsorted(-length, -i, "left"))  # rows longer than i
            now, byte = states[:live], data[begin[:live] + i]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:live] = (moved & automaton.step[byte]) | (now & automaton.stay[byte])
        best = np.full(len(some), -1, np.int32)
        for k, end in enumerate(automaton.ends.tolist()):
            hit = (states[:, end >> 6] >> np.uint64(end & 63)) & np.uint64(1) == 1
            best[hit & (best < 0)] = k
        out[some] = best
    return out


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; empty where it is null or has no ``://``."""
    text = F.col(url).cast("string")
    rest = F.when(F.instr(text, "://") > 0, text.substr(F.instr(text, "://") + 3, F.length(text)))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _UPPER.lower()), path


def _blocks(rules: Sequence[Rule], most: int) -> list[list[Rule]]:
    out: list[list[Rule]] = [[]]
    held = 0
    for r in rules:
        need = len(r.glob.encode()) + 1
        if out[-1] and held + need > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += need
    return out


def _decider(shared: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("struct<fits:string,rank:int,verdict:string>")
    def decided(column: pa.Array) -> pa.Array:
        a = shared.value
        text = column.cast(pa.large_string())
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        which = judge(a, data, offsets)
        place = pa.array(which, mask=which < 0)
        fields = (pa.array([r.name for r in a.rules], pa.string()), pa.array([r.rank for r in a.rules], pa.int32()), pa.array([r.verdict for r in a.rules], pa.string()))
        return pa.StructArray.from_arrays([f.take(place) for f in fields], ["fits", "rank", "verdict"])

    return decided


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = ALLOW) -> DataFrame:
    """Add host, path, fits (name of the deciding rule, else null), rank and verdict to every row.

    The canonical URL that the automaton reads is ``.`` + host + path. A null URL, an empty one and one without ``://`` have an
    empty host and path and still meet the rules; where no rule fits, ``default`` is the verdict. No
    row moves and none is grouped, so many rows of one host or URL are no burden; repeated rows are
    judged alike. Very long URLs cost a step a byte. Columns of the five names and ``__fit`` are replaced, others stay. Rules
    beyond MOST_BITS symbols are judged one block after the other, with a table in the shared folder between.
    """
    host, path = host_and_path(url)
    rows = pages.drop("host", "path", "fits", "rank", "verdict", "__fit").withColumn("host", host).withColumn("path", path)
    blocks = [compiled(block) for block in _blocks(sorted(rules, key=lambda r: (-r.rank, -len(r.name), r.verdict != BLOCK, r.name)), MOST_BITS) if block]
    rows = rows.withColumn("__fit", F.lit(None).cast("struct<fits:string,rank:int,verdict:string>"))
    for at, automaton in enumerate(blocks):
        decided = _decider(rows.sparkSession.sparkContext.broadcast(automaton))
        if at:
            rows = kept(rows, "urls")
        now = decided(F.concat(F.lit("."), "host", "path"))
        # blocks come in the order in which rules decide
        rows = rows.withColumn("__fit", F.when(F.col("__fit.fits").isNotNull(), F.col("__fit")).otherwise(now) if at else now)
    return rows.select(*[c for c in rows.columns if c != "__fit"], F.col("__fit.fits").alias("fits"), F.col("__fit.rank").alias("rank"),
                       F.coalesce("__fit.verdict", F.lit(default)).alias("verdict"))


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every page; ``rule`` names a site rule, ``pattern`` one of GLOBS."""
    rows = filter_urls(pages.select("page_id", "url"))
    return rows.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("fits")).alias("rule"), "verdict",
                       F.when(F.col("rank") == 0, F.col("fits")).alias("pattern"))
