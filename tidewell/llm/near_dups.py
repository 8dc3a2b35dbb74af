"""Near-duplicate documents by order min-hash, verified by banded alignment.

Every run of five words, labelled with how often it occurred before in the
text, is hashed by several functions.  A sketch is the hash of the few
smallest of one function taken in text order, so it agrees between texts that
share runs in the same order (edit similarity), not only the same set.  Texts
that share a sketch are candidates.  A candidate pair is verified on its whole
texts: common labelled runs within a band of diagonals are chained by the
longest increasing sequence, and the chain over all runs of both texts must
reach the similarity.

A short text has hardly more runs than a sketch takes, so near copies of it
would share none.  Short texts are therefore also candidates of each other by
a prefix filter: with the runs of all of them in one order, rare ones first,
two texts that reach the similarity share one of the first few of each.  This
is exact.

Equal texts (equal word sequences) are one class from the start.  The texts
of all buckets whose smallest id is the same are one group, and every pair
that shares a bucket is in such a group.  A group is dealt into blocks of
bounded size with its smallest text in each.  A block's texts travel as run
keys; they are first held against the smallest one, then every pair in
different components is intersected in numpy, unless what the other
components hold of a text bounds it under the similarity.  Pairs of different
blocks meet in tiles, for groups of several blocks that are still split.
Blocks and tiles return a spanning forest, never their pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BASE, Words, fresh_names, mix, powers, text_bytes, text_chunks, window_hashes, written
from .components import components
from .substrings import MAP_BITS, texts_among

#: Words of a run; similarity of a link; sketches; runs in a sketch.
RUN, SIMILARITY, SKETCHES, PICKS = 5, 0.8, 32, 7
#: Texts of fewer runs meet all that are near to them by rare runs; those that may be near to one of them have fewer than FEW.
SHORT = 40
FEW = int(SHORT / SIMILARITY)
#: Run keys of one block (expected number); run keys of a text that a sketch's runs are looked for among (expected number).
BLOCK_RUNS, DRAWN = 1 << 19, 24
#: Diagonals on either side, as a share of the longer text and at least so many.
BAND, LEAST_BAND = 0.25, 64
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_MAX = np.uint64((1 << 64) - 1)


def labelled_runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, bounds, contents): occurrence-labelled run keys of all texts in order; keys of text i are bounds[i]:bounds[i+1]; two hashes of each whole word sequence.

    A text of fewer words than a run has one key, that of all its words.
    """
    hashes, n = w.hashes(), len(w.count)
    contents = np.zeros((2, n), dtype=np.uint64)
    for lane, base in enumerate((WORD_BASE, np.uint64(0xA24BAED4963EE407))):
        prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(lane * 0x5851F42D4C957F2D)) * powers(base, len(hashes)), out=prefix[1:])
        back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(hashes) + 1)
        contents[lane] = mix((prefix[w.lo[1:]] - prefix[w.lo[:-1]]) * back[w.lo[:-1]] + w.count.astype(np.uint64))
    runs = window_hashes(hashes, RUN)
    at = np.flatnonzero(np.arange(len(runs)) + RUN <= w.last()[: len(runs)])
    per_text = np.maximum(w.count - RUN + 1, 0)
    runs, text = runs[at], np.repeat(np.arange(n), per_text)
    order = np.argsort(runs ^ mix(text.astype(np.uint64)), kind="stable")
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (runs[order[1:]] != runs[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    began = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    label = np.empty(len(order), dtype=np.uint64)
    label[order] = (np.arange(len(order)) - began).astype(np.uint64)
    own = mix(runs + label * np.uint64(0xC2B2AE3D27D4EB4F))
    short = per_text == 0
    bounds = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.maximum(per_text, 1), out=bounds[1:])
    keys = np.zeros(bounds[-1], dtype=np.uint64)
    keys[np.repeat(~short, np.maximum(per_text, 1))] = own
    keys[bounds[:-1][short]] = contents[0][short]
    return keys, bounds, contents


def mixed(keys: np.ndarray, seed: np.uint64, room: np.ndarray) -> np.ndarray:
    """``mix(keys ^ seed)`` with a given array for what lies between; fresh pages cost more than the work on them."""
    h = keys ^ seed
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= np.right_shift(h, np.uint64(shift), out=room)
        h *= np.uint64(factor)
    h ^= np.right_shift(h, np.uint64(31), out=room)
    return h


def sketches(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of sketches for each text."""
    n, size = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((n, SKETCHES), dtype=np.uint64)
    if not n:
        return out
    doc, take = np.repeat(np.arange(n), size), np.minimum(size, PICKS)
    begin = np.cumsum(take) - take
    limit = np.where(size > DRAWN, _MAX // size.astype(np.uint64) * np.uint64(DRAWN), _MAX)[doc]
    room = np.empty_like(keys)
    for j, seed in enumerate(_SEEDS):
        h = mixed(keys, seed, room)
        at = np.flatnonzero(h <= limit)
        got = np.bincount(doc[at], minlength=n)
        if (got < take).any():  # fewer than asked for lie under the limit
            at = np.flatnonzero((h <= limit) | (got < take)[doc])
            got = np.bincount(doc[at], minlength=n)
        order = np.argsort(doc[at].astype(np.uint64) << np.uint64(40) | h[at] >> np.uint64(24))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(got) - got, got)
        picks = np.sort(at[order[rank < PICKS]])  # back in text order
        value = np.full(n, seed, dtype=np.uint64)
        for r in range(PICKS):
            has = take > r
            value[has] = mix(value[has] * WORD_BASE + keys[picks[begin[has] + r]])
        out[:, j] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the longest in-order chain of common keys inside the band, over the keys of both."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    whole = len(a) + len(b)
    if len(common) / (whole - len(common)) < SIMILARITY:
        return 0.0
    band = max(LEAST_BAND, int(BAND * max(len(a), len(b))))
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(j - i) <= band]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        chain = len(tails)
    return chain / (whole - chain)


def forest(comp: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs of texts that join all components which links between texts of different ones join; the keys of text i are keys[bounds[i]:bounds[i+1]].

    Text 0 is held against all others first.
    """
    _, root = np.unique(comp, return_inverse=True)
    distinct, ids = np.unique(keys, return_inverse=True)
    size, found = np.diff(bounds), []
    live, flat, starts = np.arange(len(size)), ids, bounds[:-1]
    mark = np.zeros(len(distinct), dtype=np.int64)

    def compare(x: int) -> None:
        own = ids[bounds[x] : bounds[x + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        hopeful = np.flatnonzero((common / (size[live] + size[x] - common) >= SIMILARITY) & (root[live] != root[x]))
        for y in live[hopeful[np.argsort(-common[hopeful], kind="stable")]].tolist():
            if root[y] != root[x] and aligned(keys[bounds[x] : bounds[x + 1]], keys[bounds[y] : bounds[y + 1]]) >= SIMILARITY:
                found.append((x, y))
                root[root == root[y]] = root[x]

    compare(0)
    while True:  # keys that one component alone holds are in no intersection with another's
        of = np.repeat(root[live], size[live])
        low, high = np.full(len(distinct), len(root)), np.full(len(distinct), -1)
        np.minimum.at(low, flat, of)
        np.maximum.at(high, flat, of)
        keep = np.add.reduceat(low[flat] != high[flat], starts, dtype=np.int64) >= SIMILARITY * size[live] - 1e-6
        if keep.all():
            break
        flat, live = flat[np.repeat(keep, size[live])], live[keep]
        if not len(live):
            return found
        starts = np.cumsum(size[live]) - size[live]
    main = np.bincount(root[live]).argmax()  # of two texts in different components one is outside this
    for x in live[root[live] != main].tolist():
        compare(x)
    return found


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, c1, keys): the run keys of each text in order."""
    for batch in batches:
        for part in text_chunks(batch, "text"):
            keys, bounds, contents = labelled_runs(Words(*text_bytes(part.column(1))))
            packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(contents[0].view(np.int64)), packed.cast(pa.binary())], names=["rep", "c1", "keys"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each edge of the forests of rows tile, rep, comp, keys that come in order of their tiles, each tile's main text first."""
    held: list[pa.Table] = []

    def edges() -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks()
        held.clear()
        rep, raw = rows.column("rep").to_numpy(), [x.as_buffer() for x in rows.column("keys").combine_chunks()]
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
        pairs = forest(rows.column("comp").to_numpy(), np.frombuffer(b"".join(raw), np.uint64), bounds) if len(rep) > 1 else []
        a, b = np.array([x for x, _ in pairs], dtype=np.int64), np.array([y for _, y in pairs], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], names=["a", "b"])

    last = None
    for batch in batches:
        tile = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                if held and tile[lo] != last:
                    yield edges()
                held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
                last = tile[lo]
    if held:
        yield edges()


def joined(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): edges of the forests of ``members`` (tile, rep, c1, comp, main), whose keys are made from ``texts``."""
    keys = texts_among(texts, members.select(F.col("rep").alias("id"))).where("id IS NOT NULL").mapInArrow(_keys, "rep bigint, c1 bigint, keys binary")
    once = keys.groupBy("rep", "c1").agg(F.first("keys").alias("keys"))  # rows may repeat an id
    rows = members.join(once, ["rep", "c1"]).repartition("tile").sortWithinPartitions("tile", F.desc("main"), "rep", "c1")
    return rows.select("tile", "rep", "comp", "keys").mapInArrow(_forests, "a bigint, b bigint")


def firsts(short: DataFrame) -> DataFrame:
    """(rep, c1, runs, firsts) of short texts (rep, c1, runs, few) with their keys in ``few``: the first of each one's keys that another holds too.

    Keys are in order of how many texts hold them.  Two texts of the
    similarity share at least that part of the keys of each, so they share one
    of the first ``runs`` less that part, plus one.  Keys of one text only are
    the first of all and are shared with none.
    """
    own = written(short.select("rep", "c1", "runs", F.explode("few").alias("key")), "near")
    held = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = own.join(held, "key").groupBy("rep", "c1", "runs").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    most = F.col("runs") - F.ceil(F.col("runs") * SIMILARITY - 1e-6) + 1 - (F.col("runs") - F.size("keys"))
    return shared.where(most > 0).select("rep", "c1", "runs", F.transform(F.slice("keys", F.lit(1), most.cast("int")), lambda x: x["key"]).alias("firsts"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: class_id (the smallest id of its class), n_words, kept (the class's smallest id).

    A null text counts as empty; all empty texts are one class.  Texts of
    fewer than five words are near only to texts with the same words.  Rows
    that repeat an id are one document; a null id stands alone, with a null
    class, and is kept.  Other columns don't matter.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                w = Words(*text_bytes(part.column(1)))
                keys, bounds, contents = labelled_runs(w)
                sizes = np.where(np.diff(bounds) < FEW, np.diff(bounds), 0)
                few = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[np.repeat(sizes > 0, np.diff(bounds))].view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * SKETCHES, pa.int32()), pa.array(sketches(keys, bounds).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(contents[0].view(np.int64)), pa.array(contents[1].view(np.int64)), pa.array(w.count.astype(np.int64)), pa.array(np.diff(bounds)), lists, few], names=["id", "c1", "c2", "n_words", "runs", "sketch", "few"])

    every = written(texts.mapInArrow(sketch, "id bigint, c1 bigint, c2 bigint, n_words bigint, runs bigint, sketch array<bigint>, few array<bigint>"), "near")
    known = every.where("id IS NOT NULL")
    reps = written(known.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("runs").alias("runs"), F.min_by("sketch", "id").alias("sketch")), "near")
    short = known.where(F.col("runs") < FEW).groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("runs").alias("runs"), F.min_by("few", "id").alias("few"))
    first = written(firsts(short), "near")
    flat = reps.select("rep", "c1", "runs", F.posexplode("sketch").alias("j", "v")).unionByName(first.select("rep", "c1", "runs", F.lit(SKETCHES).alias("j"), F.explode("firsts").alias("v")))
    shared = flat.groupBy("j", "v").agg(F.min("rep").alias("centre"), F.max("rep").alias("high")).where("centre < high").drop("high")
    groups = written(flat.join(shared, ["j", "v"]).select("centre", "rep", "c1", "runs").distinct(), "near")
    main = F.col("rep") == F.col("centre")
    blocks = written(groups.groupBy("centre").agg(F.ceil(F.sum("runs") / BLOCK_RUNS).alias("blocks")).where("blocks > 1"), "near")
    dealt = groups.join(blocks, "centre", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    place = F.pmod(F.xxhash64("rep", "c1"), F.col("blocks"))
    dealt = dealt.withColumn("block", F.explode(F.when(main, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(place))))
    own = F.xxhash64("centre", "block").alias("tile")  # two groups in one tile would only be compared as well
    edges = written(joined(dealt.select(own, "rep", "c1", F.col("rep").alias("comp"), main.alias("main")), texts), "near")
    parts = components(edges, "near")
    if blocks.limit(1).count():  # pairs of different blocks
        wide = groups.join(blocks, "centre").join(parts.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        wide = wide.join(parts.select(F.col("node").alias("centre"), F.col("component").alias("most")), "centre", "left").withColumn("inner", F.col("comp") == F.coalesce("most", "centre"))
        runs = lambda inner: F.greatest(F.ceil(F.sum(F.when(F.col("inner") == inner, F.col("runs")).otherwise(0)) / BLOCK_RUNS), F.lit(1))
        split = wide.groupBy("centre").agg(runs(True).alias("n"), runs(False).alias("m"), F.bool_and("inner").alias("one")).where("NOT one").drop("one")
        wide = wide.drop("blocks").join(split, "centre")
        at = F.pmod(F.xxhash64("rep", "c1"), F.when(F.col("inner"), F.col("n")).otherwise(F.col("m")))
        upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
        cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
        # texts of the centre's component meet the others; the others meet each other
        outer = F.concat(F.transform(upto("n"), lambda x: cell(0, x, at)), F.transform(upto("m"), lambda y: cell(1, F.least(at, y), F.greatest(at, y))))
        tiles = wide.withColumn("cell", F.explode(F.when(F.col("inner"), F.transform(upto("m"), lambda y: cell(0, at, y))).otherwise(outer)))
        more = joined(tiles.select(F.xxhash64("centre", "cell").alias("tile"), "rep", "c1", "comp", F.lit(False).alias("main")), texts)
        parts = components(written(edges.union(more), "near"), "near")
    parts = parts.withColumnRenamed("node", "rep")
    classes = reps.select("c1", "c2", "rep").join(parts, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("class_id"))
    out = every.select("id", "c1", "c2", "n_words").join(classes, ["c1", "c2"], "left")
    own = F.when(F.col("id").isNotNull(), F.col("class_id"))
    return out.select(F.col("id").alias(id_col), own.alias("class_id"), "n_words", F.col("id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class: that of the smallest id.  Rows without an id all stay.

    Only rows whose id may be among those that go are shuffled: a bitmap of
    bounded size tells which.
    """
    gone, repeats, word, bits = fresh_names(docs, "gone", "repeats", "word", "bits")
    flags = near_duplicates(docs, id_col, text_col).groupBy(F.col(id_col).alias(gone)).agg(F.bool_or("kept").alias("kept"), F.count("*").alias(repeats))
    flags = written(flags.where(F.col(gone).isNotNull()), "near")
    dropped, own = flags.where("NOT kept").select(gone), F.col(f"`{id_col}`")
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(MAP_BITS))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 32).cast("int"))
    words = written(dropped.select(F.floor(place(F.col(gone)) / 32).alias(word), bit(place(F.col(gone))).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits)), "near")
    rows = docs.join(F.broadcast(words), F.floor(place(own) / 32) == F.col(word), "left")  # at most MAP_BITS / 32 rows
    may_go = F.coalesce(own.isNotNull() & (F.col(bits).bitwiseAND(bit(place(own))) != 0), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    doubtful = rows.where(may_go).select(*columns).join(dropped.hint("merge"), own == F.col(gone), "left_anti")  # the same plan at every size
    rows = rows.where(~may_go).select(*columns).unionByName(doubtful)
    if not flags.where(F.col("kept") & (F.col(repeats) > 1)).limit(1).count():
        return rows
    return rows.where(own.isNotNull()).dropDuplicates([id_col]).unionByName(rows.where(own.isNull()))
