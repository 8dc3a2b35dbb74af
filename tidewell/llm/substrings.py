"""Substring dedup: passages of 50 words that a document with a smaller id holds too.

Windows are brought together by content: a window's key is the least hash of
the runs of RUN words in it, so equal windows have equal keys, and consecutive
windows with one key travel as one segment of words.  Segments of equal
content are one row with the smallest id, made before each shuffle: every
other document's windows in it go.  What is left, for keys that have several
different segments, is dealt to shards.

A shard holds a compressed FM-index of its segments, ordered by document id:
the Burrows-Wheeler transform in a wavelet tree of packed bit vectors.  Every
segment is streamed through it from its end by backward search, all of a
shard at once.  A match counts only while its range of suffixes has one of a
smaller document (a range minimum); where it can't be extended, the range
falls back to the parent interval.  The matching statistics that result give
the windows to remove: those from which at least 50 words match.

Keys that very many documents hold in different segments don't go to one
shard: their windows are compared by their hashes in a plain aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BASE, Words, mix, powers, text_bytes, text_chunks, window_hashes, written

#: Words of a window; of a run whose hash may be a key; windows of one segment.
WINDOW, RUN, SEGMENT = 50, 10, 64
#: Words of one shard; segments of one key beyond which windows are compared by hashes.
SHARD_WORDS, HOT_SEGMENTS = 400_000, 2_000
#: Bits of the map of documents that tells which texts may be needed; it is 4 MB at most.
MAP_BITS = 1 << 25


class BitVector:
    """Packed bits with counts before each block of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletTree:
    """Rank of any symbol in a sequence, by one bit vector for each bit of the symbols (all nodes of a level side by side)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        s = symbols
        for d in range(self.depth - 1, -1, -1):
            bit = (s >> d & 1).astype(np.uint8)
            zeros = len(s) - int(bit.sum())
            self.levels.append((BitVector(bit), zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i."""
        low, high = np.zeros_like(i), i
        for d, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = (c >> d & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class RangeMinimum:
    """Least value of a range, from minima over spans of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))
        self.longest = len(self.rows) - 1

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over [low, high), which may not be empty."""
        k = np.maximum(np.frexp((high - low).astype(np.float64))[1] - 1, 0)
        out = np.empty(len(low), dtype=self.rows[0].dtype)
        for j in np.unique(k):
            at = k == j
            out[at] = np.minimum(self.rows[j][low[at]], self.rows[j][high[at] - (1 << j)])
        return out


class FMIndex:
    """FM-index of a text of symbols 1.. with 0 between and after the segments, whose matches stay under LONGEST words."""

    LONGEST = 128

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = text
        rank, kept = text.astype(np.int64), []
        h = 1
        while True:  # ranks by the first h symbols, doubled
            kept.append(rank.astype(np.int32))
            second = np.zeros(n, dtype=np.int64)
            second[: max(n - h, 0)] = rank[h:] + 1
            key = rank * (n + 2 + int(text.max())) + second
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, dtype=np.int64)
            fresh[0] = 0
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(fresh)
            h *= 2
            if h >= self.LONGEST or rank[order[-1]] == n - 1:
                break
        self.suffix = order
        # common prefixes of neighbours, from the kept ranks, longest first
        a, b, self.lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n + 1, dtype=np.int32)
        for i in range(len(kept) - 1, -1, -1):
            step = 1 << i
            inside = (a + step <= n) & (b + step <= n)
            same = inside & (kept[i][np.minimum(a, n - 1)] == kept[i][np.minimum(b, n - 1)])
            self.lcp[1:n][same] += step
            a[same] += step
            b[same] += step
        self.lcp[0] = self.lcp[n] = -1
        alphabet = int(text.max()) + 1
        self.tree = WaveletTree(text[(order - 1) % n], alphabet)
        self.first = np.zeros(alphabet + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet), out=self.first[1:])
        self.places = RangeMinimum(order)
        self.common = RangeMinimum(self.lcp)

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of c followed by what the ranges stand for."""
        return self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, depth) of the smallest larger interval."""
        depth = np.maximum(self.lcp[low], self.lcp[high])
        low, high, n = low.copy(), high.copy(), len(self.suffix)
        for k in range(self.common.longest, -1, -1):
            row, span = self.common.rows[k], 1 << k
            at = low - span + 1  # lcp[at .. low] all reach the depth: the interval goes on to the left
            go = (at >= 0) & (row[np.clip(at, 0, len(row) - 1)] >= depth)
            low[go] -= span
            go = (high + span <= n + 1) & (row[np.clip(high, 0, len(row) - 1)] >= depth)
            high[go] += span
        return low, high, depth

    def statistics(self, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each place of the text in the spans, the longest match from there (inside the span) that also begins before ``limit``."""
        out, n = np.zeros(len(self.text), dtype=np.int32), len(self.suffix)
        at, low, high, size = end - 1, np.zeros(len(end), np.int64), np.full(len(end), n), np.zeros(len(end), np.int64)
        live = np.flatnonzero(at >= start)
        while len(live):
            c = self.text[at[live]]
            l, h = self.step(c, low[live], high[live])
            good = h > l
            good[good] = self.places.least(l[good], h[good]) < limit[live[good]]
            go = live[good]
            low[go], high[go] = l[good], h[good]
            size[go] += 1
            out[at[go]] = size[go]
            stuck = live[~good]
            none = stuck[size[stuck] == 0]
            at[go] -= 1
            at[none] -= 1
            fall = stuck[size[stuck] > 0]
            if len(fall):
                low[fall], high[fall], size[fall] = self.parent(low[fall], high[fall])
            live = live[at[live] >= start[live]]
        return out


def segments(w: Words) -> tuple[np.ndarray, ...]:
    """(text, first, last, key, content) of the segments of all texts: windows first..last, counted within the text, share the key; content is a hash of their words."""
    hashes, last = w.hashes(), w.last()
    runs = window_hashes(hashes, RUN)
    width = WINDOW - RUN + 1
    none = np.zeros(0, np.int64)
    if len(runs) < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    low, span = runs, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    rest = width - span
    low = np.minimum(low[: len(low) - rest], low[rest:])
    ok = np.flatnonzero(np.arange(len(low)) + WINDOW <= last[: len(low)])
    if not len(ok):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    doc = w.doc()[ok]
    new = np.ones(len(ok), dtype=bool)
    new[1:] = (low[ok[1:]] != low[ok[:-1]]) | (doc[1:] != doc[:-1])
    began = np.maximum.accumulate(np.where(new, np.arange(len(ok)), 0))
    new |= (np.arange(len(ok)) - began) % SEGMENT == 0
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(ok)))
    first, text = ok[at], doc[at]
    prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(WORD_BASE, len(hashes)), out=prefix[1:])
    back = powers(np.uint64(pow(int(WORD_BASE), -1, 1 << 64)), len(hashes) + 1)
    content = mix((prefix[first + size + WINDOW - 1] - prefix[first]) * back[first] + size.astype(np.uint64))
    return text, first - w.lo[text], first - w.lo[text] + size - 1, low[first], content


def joined_words(w: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """The words of text i, or those of a mask, joined by one space."""
    lo, hi = w.lo[i], w.lo[i + 1]
    if keep is None:
        keep = np.ones(hi - lo, dtype=bool)
    raw = w.buf.tobytes() if len(w.lo) == 2 else None
    which = np.flatnonzero(keep) + lo
    if raw is None:
        a, b = w.offsets[i], w.offsets[i + 1]
        raw, shift = w.buf[a:b].tobytes(), a
    else:
        shift = 0
    return b" ".join([raw[s:e] for s, e in zip((w.start[which] - shift).tolist(), (w.end[which] - shift).tolist(), strict=True)])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch, "text"):
            w = Words(*text_bytes(part.column(1)))
            text, first, last, key, content = segments(w)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            kinds = (("key", key.view(np.int64)), ("content", content.view(np.int64)), ("first", first.astype(np.int32)), ("last", last.astype(np.int32)))
            rows = pa.StructArray.from_arrays([pa.array(x) for _, x in kinds], names=[n for n, _ in kinds])
            digest = [hashlib.sha256(joined_words(w, i)).hexdigest() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.count.astype(np.int64)), pa.array(digest), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)], names=["id", "n_words", "digest", "segments"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted segments of each text, or the hashes of their windows where the key is hot."""
    for batch in batches:
        for part in text_chunks(batch, "text"):
            w = Words(*text_bytes(part.column(1)))
            hashes = w.hashes()
            whole = [window_hashes(hashes, WINDOW), window_hashes(mix(hashes ^ np.uint64(0x1B873593CC9E2D51)), WINDOW)]
            ids = part.column(0).to_pylist()
            rows: list[tuple] = []
            for i, wanted in enumerate(part.column(2).to_pylist()):
                lo = int(w.lo[i])
                for x in wanted:
                    a, b = x["first"], x["last"]
                    if b + WINDOW > w.count[i]:
                        continue  # of another text with the same id
                    if x["hot"]:
                        rows += [(ids[i], s, x["key"], int(whole[0][lo + s].view(np.int64)), int(whole[1][lo + s].view(np.int64)), None) for s in range(a, b + 1)]
                    else:
                        rows.append((ids[i], a, x["key"], None, None, hashes[lo + a : lo + b + WINDOW].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "first", "key", "w1", "w2", "words"])


def shard_ranges(ids: np.ndarray, first: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, from, to): runs of windows of a shard's segments that segments of smaller ids hold too."""
    order = np.lexsort((first, ids))
    ids, first = ids[order], first[order]
    parts = [np.frombuffer(words[i], np.uint64) for i in order]
    size = np.array([len(p) for p in parts])
    _, symbols = np.unique(np.concatenate(parts), return_inverse=True)
    text = np.zeros(int(size.sum()) + len(parts), dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    place = np.arange(int(size.sum())) + np.repeat(np.arange(len(parts)), size)
    text[place] = symbols + 1
    # of one document's segments none counts for another
    limit = start[np.searchsorted(ids, ids, side="left")]
    matched = FMIndex(text).statistics(start, start + size, limit) >= WINDOW
    edge = np.diff(np.concatenate([[0], matched.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    of = np.searchsorted(start, a, side="right") - 1
    return ids[of], first[of] + a - start[of], first[of] + b - start[of]


def _shard(table: pa.Table) -> pa.Table:
    ids, low, high = shard_ranges(table.column("id").to_numpy(), table.column("first").to_numpy(), table.column("words").to_pylist())
    return pa.table({"id": ids, "low": low.astype(np.int32), "high": high.astype(np.int32)})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch, "text"):
            w = Words(*text_bytes(part.column(1)))
            removed, digest = [], []
            for i, ranges in enumerate(part.column(2).to_pylist()):
                n = int(w.count[i])
                step = np.zeros(n + 1, dtype=np.int32)
                for r in ranges:
                    if r["low"] < n:
                        step[r["low"]] += 1
                        step[min(r["high"] + WINDOW, n)] -= 1
                keep = np.cumsum(step[:-1]) == 0
                removed.append(n - int(keep.sum()))
                digest.append(hashlib.sha256(joined_words(w, i, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])


def texts_among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may be among ``ids``: a bitmap of bounded size spares most others the shuffle."""
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    words = ids.select(place.alias("p")).select(F.expr("p div 32").alias("w"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()  # at most MAP_BITS / 32 rows
    bits = np.zeros(MAP_BITS // 32, dtype=np.uint32)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    where = texts.select("id", "text", place.alias("p"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.select(["id", "text"]).filter(pa.array((shared.value[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool)))

    return where.mapInArrow(sift, "id bigint, text string")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A word goes when a window of 50 words around it also starts in a document
    with a smaller id; windows are those of the input.  A null text counts as
    empty.  Rows that repeat an id are one document (if their texts differ,
    windows removed from one go from the other too where it has them).  A null
    id neither loses words nor counts as smaller.  Other columns don't matter.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    survey = written(texts.mapInArrow(_survey, "id bigint, n_words bigint, digest string, segments array<struct<key:bigint,content:bigint,first:int,last:int>>"), "substrings")
    flat = survey.where("id IS NOT NULL").select("id", F.explode("segments").alias("s")).select("id", "s.*")
    shared = flat.groupBy("key").agg(F.min("id").alias("l"), F.max("id").alias("h")).where("l < h").select("key")
    some = written(flat.join(shared, "key"), "substrings")
    least = written(some.groupBy("key", "content").agg(F.min("id").alias("rep")), "substrings")
    several = least.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("l"), F.max("rep").alias("h")).where("l < h").select("key", (F.col("n") > HOT_SEGMENTS).alias("hot"))
    known = written(some.join(least, ["key", "content"]).select("id", "key", "first", "last", "rep"), "substrings")
    later = known.where("id > rep").select("id", F.col("first").alias("low"), F.col("last").alias("high"))
    asked = known.where("id = rep").join(several, "key")
    per_document = written(asked.groupBy("id").agg(F.collect_list(F.struct("first", "last", "key", "hot")).alias("wanted")), "substrings")
    cut = written(texts_among(texts, per_document.select("id")).join(per_document, "id").select("id", "text", "wanted").mapInArrow(_cut, "id bigint, first int, key bigint, w1 bigint, w2 bigint, words binary"), "substrings")
    size = cut.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = max(1, int(size // SHARD_WORDS) + 1)
    ranges = cut.where("words IS NOT NULL").select("id", "first", "words", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(_shard, "id bigint, low int, high int")
    hot = cut.where("w1 IS NOT NULL").select("id", "first", "w1", "w2")
    smallest = hot.groupBy("w1", "w2").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep < top").drop("top")
    by_window = hot.join(smallest, ["w1", "w2"]).where("id > rep").select("id", F.col("first").alias("low"), F.col("first").alias("high"))
    gone = written(later.union(ranges).union(by_window).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "substrings")
    changed = texts_among(texts, gone.select("id")).join(gone, "id").select("id", "text", "ranges").mapInArrow(_apply, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    same = survey.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256")).join(gone.select("id"), "id", "left_anti")
    return changed.union(same).withColumnRenamed("id", id_col)


#: Windows as lists of words; DuckDB compares them whole.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(array_agg(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), ' ')) AS h, n FROM word),
low AS (SELECT h, min(doc_id) AS d FROM win WHERE i + 49 <= n GROUP BY h),
hit AS (SELECT win.doc_id, i FROM win JOIN low ON win.h = low.h WHERE i + 49 <= n AND d < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.i) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.doc_id) k USING (doc_id)
"""
