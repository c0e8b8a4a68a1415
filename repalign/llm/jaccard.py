"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import connected_components
from .hashing import WHITE_SPACE, mix, shingle_hashes, text_chunks, word_hashes
from .storage import kept, shuffle_parts, text_batches
from .tiles import dealt, spread_in_tiles, tiles_of

# Weight of a tile part in n-grams; a document counts for DOC_WEIGHT more, which bounds its rows.
PART_WEIGHT, DOC_WEIGHT = 600_000, 1_000

_ENTRY = "kind int, slot long, doc_id long, text_key long, sig long, n long, keys binary, sizes binary, counts binary, grams binary, extra binary"
_ROWS = pa.schema([("kind", pa.int32()), ("slot", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()),
                   ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("extra", pa.binary())])


def _batch(**columns) -> pa.RecordBatch:
    """Rows of _ROWS; columns left out are null."""
    size = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ROWS], schema=_ROWS)


def _needed(n: np.ndarray | int, percent: int):
    """The least overlap of a linked set of n: percent * n / 100, rounded up."""
    return -(-n * percent // 100)


def _packed(kind: int, slots: np.ndarray, doc: np.ndarray, keys: np.ndarray, sizes: np.ndarray, grams: np.ndarray,
            extra: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per slot: its documents (key, set size, number of n-grams) and their n-grams, by document."""
    order = np.lexsort((doc, slots))
    slots, doc, grams = slots[order], doc[order], grams[order]
    extra = extra[order] if extra is not None else None
    cuts = np.flatnonzero(np.diff(slots)) + 1
    columns = {k: [] for k in ("slot", "keys", "sizes", "counts", "grams", "extra")}
    for a, b in zip([0, *cuts], [*cuts, len(slots)]):
        if a == b:
            continue
        turns = np.concatenate([[0], np.flatnonzero(np.diff(doc[a:b])) + 1, [b - a]])
        who = doc[a:b][turns[:-1]]
        columns["slot"].append(int(slots[a]))
        columns["keys"].append(keys[who].tobytes())
        columns["sizes"].append(sizes[who].astype(np.uint32).tobytes())
        columns["counts"].append(np.diff(turns).astype(np.uint32).tobytes())
        columns["grams"].append(grams[a:b].tobytes())
        columns["extra"].append(extra[a:b].tobytes() if extra is not None else b"")
    return _batch(kind=[kind] * len(columns["slot"]), **columns)


def _unpacked(rows: list[tuple[bytes, ...]]) -> tuple[np.ndarray, ...]:
    """(keys, sizes, counts, n-grams, extra) of packed rows, each key once."""
    keys, sizes, counts, grams, extra = (np.frombuffer(b"".join(r[k] for r in rows), t)
                                         for k, t in enumerate((np.uint64, np.uint32, np.uint32, np.uint64, np.uint32)))
    return keys, sizes, counts, grams, extra


def _sets(width: int, slots: int):
    """Documents -> kind 0: (doc_id, sig, n); kind 1: their distinct n-grams dealt to slots by value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for a, b, data, offsets in text_chunks(batch.column(2)):
                hashes, _, _, first = word_hashes(data, offsets, WHITE_SPACE)
                grams, begin = shingle_hashes(hashes, first, width)
                sets = [np.unique(grams[begin[k]:begin[k + 1]]) for k in range(b - a)]
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(b - a), n)
                total = np.zeros(len(flat) + 1, np.uint64)
                np.cumsum(mix(flat + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
                ends = np.cumsum(n)
                sig = mix(total[ends] - total[ends - n])
                spread = (mix(sig + np.arange(a, b, dtype=np.uint64)) % np.uint64(slots)).astype(np.int64)
                yield _batch(kind=[0] * (b - a), slot=spread, doc_id=ids.slice(a, b - a), text_key=keys.slice(a, b - a), sig=sig.view(np.int64), n=n)
                _, once = np.unique(sig, return_index=True)  # copies in this chunk count once
                keep = np.isin(doc, once)
                flat, doc = flat[keep], doc[keep]
                if len(flat):
                    slot = ((flat >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
                    yield _packed(1, slot, doc, sig, n, flat)

    return run


def _by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[tuple[bytes, ...]]]]:
    """Rows of kind 0 as they come, and the packed rows of each slot (rows are sorted by kind and slot)."""
    slot, rows = None, []
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        plain = int(np.searchsorted(kinds, 1))
        if plain:
            yield batch.slice(0, plain), []
        slots = batch.column(1)
        for k in range(plain, batch.num_rows):
            if slots[k].as_py() != slot:
                if rows:
                    yield None, rows
                slot, rows = slots[k].as_py(), []
            rows.append(tuple(batch.column(c)[k].as_py() or b"" for c in range(6, 11)))
    if rows:
        yield None, rows


def _shared(slots: int):
    """Columns of the matrix: of each n-gram the number of different sets that hold it; those of one set go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for plain, rows in _by_slot(batches):
            if plain is not None:
                yield plain
                continue
            keys, sizes, counts, grams, _ = _unpacked(rows)
            _, once = np.unique(keys, return_index=True)
            first = np.zeros(len(keys), bool)
            first[once] = True
            doc = np.repeat(np.arange(len(keys)), counts)
            chosen = np.flatnonzero(first[doc])
            order = chosen[np.argsort(grams[chosen], kind="stable")]
            doc, grams = doc[order], grams[order]
            new = np.concatenate([[True], grams[1:] != grams[:-1]])
            df = np.diff(np.append(np.flatnonzero(new), len(grams)))
            df = np.repeat(df, df)
            many = df > 1
            if many.any():
                doc, grams, df = doc[many], grams[many], df[many]
                slot = (keys[doc] % np.uint64(slots)).astype(np.int64)
                yield _packed(1, slot, doc, keys, sizes, grams, np.minimum(df, 2**32 - 1).astype(np.uint32))

    return run


def _prefixes(percent: int):
    """Rows of the matrix: sets whose shared n-grams can reach the bound, with the rarest ones as their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for plain, rows in _by_slot(batches):
            if plain is not None:
                yield plain
                continue
            keys, sizes, counts, grams, df = _unpacked(rows)
            names, who = np.unique(keys, return_inverse=True)
            n = np.zeros(len(names), np.int64)
            n[who] = sizes
            doc = np.repeat(who, counts)
            have = np.bincount(doc, minlength=len(names))
            enough = have >= _needed(n, percent)
            keep = enough[doc]
            doc, grams, df = doc[keep], grams[keep], df[keep]
            order = np.lexsort((grams, df, doc))  # the global order: rare first, then by value
            doc, grams = doc[order], grams[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                d = doc[a]
                length = n[d] - _needed(n[d], percent) + 1 - (n[d] - (b - a))  # n-grams of one set come first
                yield _batch(kind=[1], sig=[int(names[d].view(np.int64))], n=[int(n[d])],
                             grams=[np.sort(grams[a:b]).tobytes()], extra=[grams[a:a + max(0, length)].tobytes()])

    return run


def _longs(column: str):
    """An array<long> of a binary column of 64-bit numbers."""

    @F.pandas_udf("array<long>")
    def longs(s):
        return s.map(lambda b: np.frombuffer(b, np.int64))

    return longs(column)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (or of ``left``).

    The product of the incidence matrices, block of columns by block: columns that few sets
    hold are added pair by pair, those that many hold as dense blocks.
    """
    both = left if right is None else left + right
    rows = np.repeat(np.arange(len(both)), [len(s) for s in both])
    grams = np.concatenate(both)
    order = np.argsort(grams, kind="stable")
    rows, grams = rows[order], grams[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    df = np.diff(np.append(starts, len(grams)))
    size = len(both)
    total = np.zeros(size * size, np.float32 if size > 64 else np.float64)
    few = max(4, size // 8)
    for d in np.unique(df[df > 1]):
        at = starts[df == d]
        if d <= few:
            step = max(1, 4_000_000 // int(d * d))
            for k in range(0, len(at), step):
                r = rows[at[k:k + step, None] + np.arange(d)]
                total += np.bincount((r[:, :, None] * size + r[:, None, :]).ravel(), minlength=size * size).astype(total.dtype)
    wide = np.flatnonzero(df > few)
    total = total.reshape(size, size)
    for k in range(0, len(wide), 1024):
        some = wide[k:k + 1024]
        block = np.zeros((size, len(some)), np.float32)
        for c, w in enumerate(some):
            block[rows[starts[w]:starts[w] + df[w]], c] = 1
        total += block @ block.T
    return total if right is None else total[:len(left), len(left):]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            k = queue.pop()
            near = np.flatnonzero(linked[k] & left)
            left[near] = False
            queue.extend(near.tolist())
            edges += [(k, int(x)) for x in near]
    return edges


def _links(percent: int):
    """Tiles -> kind 1: edges (a, b) of a spanning forest of the links; kind 0: (sig, links to copies of other sets)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, ["root"]):
            sig, n, copies, part = (tile[c].to_numpy() for c in ("sig", "n", "copies", "part"))
            sets = [np.frombuffer(g.as_py(), np.uint64) for g in tile["grams"]]
            inside = tile["tile_i"][0].as_py() == tile["tile_j"][0].as_py()
            if len(sig) < 2:
                continue
            left = np.arange(len(sig)) if inside else np.flatnonzero(part == part.min())
            right = left if inside else np.flatnonzero(part != part.min())
            shared = _overlaps([sets[k] for k in left], None if inside else [sets[k] for k in right])
            union = n[left][:, None] + n[right][None, :] - shared
            linked = 100 * shared >= percent * union
            if inside:
                np.fill_diagonal(linked, False)
                whole, names = linked, sig
                degrees = linked @ copies
            else:
                whole = np.zeros((len(sig), len(sig)), bool)
                whole[:len(left), len(left):] = linked
                whole |= whole.T
                names = sig[np.concatenate([left, right])]
                degrees = whole @ copies[np.concatenate([left, right])]
            edges = np.array(_forest(whole), np.int64).reshape(-1, 2)
            some = np.flatnonzero(degrees)
            if len(some):
                yield pa.record_batch([pa.array([0] * len(some) + [1] * len(edges), pa.int32()),
                                       pa.array(np.concatenate([names[some], names[edges[:, 0]]])),
                                       pa.array(np.concatenate([degrees[some].astype(np.int64), names[edges[:, 1]]]))], schema=schema)

    return run


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id, text_key) of every row of ``docs``.

    A document's set holds its distinct shingles of ``width`` words (runs of other characters
    than ASCII white space, A-Z lower-cased); with fewer words the whole sequence is its only
    one. Documents link when 100 * intersection >= percent * union. ``component_id`` is the
    smallest doc_id that links reach, ``n_links`` the number of other rows that link directly.

    1. One pass over the texts deals the n-grams by value. Each slot (a block of columns) keeps
       only n-grams of two or more different sets and counts those sets.
    2. Dealt by set, a set stays if its shared n-grams reach the least overlap. Any link of a
       set of n n-grams shares one of its n - ceil(percent * n / 100) + 1 rarest: its prefix.
    3. Sets that share prefix n-grams, directly or over others, form groups; the overlaps
       inside a group are counted in tiles of bounded size, where pairs below the bound go.
       Tiles return link counts and spanning forests, never pairs.

    Copies are one set from step 1 on (equal 64-bit sums of n-gram hashes, and equal size).
    Null and empty texts have an empty set, no links and themselves as component. A row of a
    null doc_id counts as a link of others' but never names a component; if no member has an
    id, component_id is null. Rows of one doc_id and different texts are judged by their own
    text. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    text_batches(spark)
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    deal = lambda df: df.repartitionById(parts, F.col("slot").cast("int")).sortWithinPartitions("kind", "slot")
    by_gram = deal(pairs.mapInArrow(_sets(width, parts), _ENTRY)).mapInArrow(_shared(parts), _ENTRY)
    rows = kept(deal(by_gram).mapInArrow(_prefixes(percent), _ENTRY).drop("slot", "keys", "sizes", "counts"), "jaccard")

    members = rows.where("kind = 0").select("doc_id", "text_key", "sig", "n")
    classes = members.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = rows.where("kind = 1").select("sig", "n", "grams", "extra")
    prefixes = sets.select("sig", F.explode(_longs("extra")).alias("gram"))
    firsts = prefixes.groupBy("gram").agg(F.min("sig").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    groups = connected_components(prefixes.join(firsts, "gram").where("sig <> first").select("sig", "first").distinct(), "sig", "first")
    grouped = (sets.select("sig", "n", "grams").join(groups.withColumnRenamed("node", "sig"), "sig")
               .join(classes.select("sig", "n", "copies"), ["sig", "n"]))
    tiles = spread_in_tiles(grouped, ["root"], "sig", F.col("n") + DOC_WEIGHT, PART_WEIGHT)
    links = kept(dealt(tiles, ["root"], parts).mapInArrow(_links(percent), "kind int, a long, b long"), "links")

    degrees = links.where("kind = 0").groupBy(F.col("a").alias("sig")).agg(F.sum("b").alias("others"))
    roots = connected_components(links.where("kind = 1")).withColumnRenamed("node", "sig")
    named = roots.join(classes.where("rep is not null"), "sig").groupBy("root").agg(F.min("rep").alias("least"))
    labels = (classes.join(roots, "sig", "left").join(named, "root", "left").join(degrees, "sig", "left")
              .select("sig", "n", F.coalesce("least", "rep").alias("component"),
                      (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return (members.join(labels, ["sig", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "doc_id").alias("component_id"), "text_key"))


def distinct(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that stay when each group of linked ones keeps its smallest doc_id.

    Of rows with one doc_id and one text one stays. Rows without an id stay unless they link to
    one that has an id or are its copy, or a copy of each other.
    """
    links = jaccard_links(docs, **options)
    links = kept(links.groupBy("doc_id", "text_key").agg(F.first("component_id").alias("component"), F.count(F.lit(1)).alias("rows")), "groups")
    gone = links.where("component is not null and not (doc_id <=> component)").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    names, keyed = docs.columns, docs.withColumn("__k", F.xxhash64("text"))
    left = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")), "left_anti")
    if links.where("rows > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "__k"])
    return left.select(*names)
