"""Quality rules: how much of a text is made of repeated n-grams and repeated lines.

For every text, word hashes are rolled into n-gram hashes of several lengths
in numpy.  An n-gram occurrence that equals an earlier one of the same text
is a repeat; the characters of all words that a repeat covers, counted once,
are measured against all word characters.  Whole lines are treated alike.
The lengths go up from the shortest: only positions whose shorter n-gram
occurs more than once can repeat at the next length, so one sort over all
positions serves all lengths.

Hashes have 64 bits and are compared only within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BASE, Words, mix, text_bytes, text_chunks

#: Largest share of word characters that may lie inside repeated n-grams, by length; wide
#: enough that one repeated sentence in a short clean text passes.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of lines, and of line characters, that may repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.50, 0.35
#: The base rules: fewest words, window length, percentage of words in repeated windows.
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later occurrences, all occurrences of keys found twice or more) as masks; keys of one group only meet each other."""
    later, every = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys ^ mix(groups.astype(np.uint64)), kind="stable")
    same = (keys[order[1:]] == keys[order[:-1]]) & (groups[order[1:]] == groups[order[:-1]])
    later[order[1:][same]] = True
    every[order[1:][same]] = True
    every[order[:-1][same]] = True
    return later, every


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    step = np.zeros(size + 1, dtype=np.int64)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of a run of texts given as UTF-8 bytes and offsets."""
    w = Words(buf, offsets)
    chars = w.codepoints_before()
    word_len = chars[w.end] - chars[w.start]
    out = {"n_words": w.count.astype(np.int64), "word_chars": _per_text(word_len, w.lo)}
    out["n_symbols"] = _per_text(_SYMBOL[buf], offsets)

    # lines: a newline ends one, as does the end of the text
    newline = np.flatnonzero(buf == 0x0A)
    start = np.sort(np.concatenate([offsets[:-1], newline + 1]), kind="stable")
    per_text = np.searchsorted(newline, offsets[1:]) - np.searchsorted(newline, offsets[:-1]) + 1
    line_doc = np.repeat(np.arange(len(offsets) - 1), per_text)
    # a text's last newline may stand right before the next text's start: order by text, then position
    nl_doc = np.searchsorted(offsets, newline, side="right") - 1
    docs = np.concatenate([np.arange(len(offsets) - 1), nl_doc])
    start = np.concatenate([offsets[:-1], newline + 1])
    order = np.lexsort((start, docs))
    start = start[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    ends_text = np.ones(len(start), dtype=bool)
    ends_text[:-1] = line_doc[1:] != line_doc[:-1]
    end[ends_text] = offsets[1:][line_doc[ends_text]]
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_doc = start[has_word], end[has_word], line_doc[has_word]
    later, _ = _repeats(w.span_hash(start, end), line_doc) if len(start) else (np.zeros(0, bool), None)
    size = len(offsets) - 1
    line_chars = chars[end] - chars[start]
    out["n_lines"] = np.bincount(line_doc, minlength=size).astype(np.int64)
    out["line_chars"] = np.bincount(line_doc, weights=line_chars, minlength=size).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=size).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=line_chars[later], minlength=size).astype(np.int64)

    # n-grams of growing length; alive: positions whose n-gram so far occurs twice or more
    hashes, doc, last = w.hashes(), w.doc(), w.last()
    total = len(hashes)
    out["n_repeat_words"] = np.zeros(size, dtype=np.int64)
    rolled = hashes.copy()
    alive = np.arange(total)
    length = 1
    for n in sorted({*NGRAM_LIMITS, BASE_WINDOW}):
        while length < n:  # roll by one more word
            alive = alive[alive + length < last[alive]]
            rolled[alive] = mix(rolled[alive] * WORD_BASE + hashes[alive + length])
            length += 1
        later, every = _repeats(rolled[alive], doc[alive]) if len(alive) else (np.zeros(0, bool), np.zeros(0, bool))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = _per_text(_covered(alive[every], n, total), w.lo)
        if n in NGRAM_LIMITS:
            out[f"dup_chars_{n}"] = _per_text(np.where(_covered(alive[later], n, total), word_len, 0), w.lo)
        alive = alive[every]
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts."""
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    keep = ~base
    keep &= m["n_dup_lines"] <= LINE_LIMIT * m["n_lines"]
    keep &= m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["line_chars"]
    for n, limit in NGRAM_LIMITS.items():
        keep &= m[f"dup_chars_{n}"] <= limit * m["word_chars"]
    return base, keep


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_LIMITS)]
_COLUMNS = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    With ``carry`` the result is instead the input rows that are kept, with
    all their columns.  A null text counts as empty: no words, so the base
    rules reject it.  Repeated rows and repeated or null ids are judged one
    by one.  Other columns of the input, whatever their names, don't matter.
    Memory is bounded by a text chunk (1 MB, or one longer text) per task;
    there is no shuffle.
    """

    def judge(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        m = measure(*text_bytes(batch.column(batch.schema.get_field_index(text_col))))
        return m, *verdict(m)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text_col):
                m, base, keep = judge(part)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[c]) for c in COUNTS), pa.array(base), pa.array(keep)], names=[id_col, *COUNTS, "base_failed", "kept"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text_col):
                yield part.filter(pa.array(judge(part)[2]))

    if carry:
        return docs.mapInArrow(kept, docs.schema)
    id_type = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    return picked.mapInArrow(rows, f"`{id_col}` {id_type}, {_COLUMNS}")


def oracle() -> str:
    """DuckDB SQL for the rows of ``quality_rules`` over ``documents``."""
    one = lambda n: f"SELECT doc_id, {n} AS n, i, md5(concat_ws(' ', word, {', '.join(f'lead(word, {j}) OVER w' for j in range(1, n))})) AS g FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(word, {n - 1}) OVER w IS NOT NULL"
    grams = " UNION ALL ".join(map(one, NGRAM_LIMITS))
    dup = ", ".join(f"coalesce(sum(chars) FILTER (WHERE n = {n}), 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_LIMITS)
    keep = " AND ".join(f"coalesce(dup_chars_{n}, 0) <= {limit}::DOUBLE * word_chars" for n, limit in NGRAM_LIMITS.items())
    columns = ", ".join(f"coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_LIMITS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM t),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM l),
lines AS (SELECT doc_id, length(line) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_sum AS (SELECT doc_id, count(*) AS n_lines, sum(chars) AS line_chars, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE again), 0) AS dup_line_chars FROM lines GROUP BY doc_id),
gram AS ({grams}),
rep AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) > 1 AS later, count(*) OVER (PARTITION BY doc_id, n, g) > 1 AS every FROM gram),
covered AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM rep WHERE later),
dup AS (SELECT doc_id, {dup} FROM (SELECT c.doc_id, c.n, length(w.word) AS chars FROM covered c JOIN word w ON c.doc_id = w.doc_id AND c.i = w.i) GROUP BY doc_id),
base AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {BASE_WINDOW})) AS i FROM rep WHERE n = {BASE_WINDOW} AND every) GROUP BY doc_id),
counts AS (SELECT l.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {columns}
  FROM l LEFT JOIN line_sum USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN base USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND n_dup_lines <= {LINE_LIMIT}::DOUBLE * n_lines AND dup_line_chars <= {LINE_CHAR_LIMIT}::DOUBLE * line_chars AND {keep} AS kept FROM judged
"""
