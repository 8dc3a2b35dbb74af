"""Toxicity: a lexicon found with its misspellings, scored by what stands around each term.

The lexicon is learned from labelled documents: words whose log odds between
toxic and other documents are high.  It is kept as a trie; the trie is
intersected with Levenshtein automata (one edit, for terms long enough) and
the product is made deterministic, so that one table walk per character tells
for every word of a text which term it spells and with how many errors.

Each hit is weighted by its term and by its context window: learned weights
of the surrounding words, and whether the term stands in quotation marks,
tell reports about abuse from abuse.  A logistic regression over sums of
these turns a text into a score between 0 and 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, text_chunks, written

#: Labelled rows that the model is fitted on (expected number, drawn by a hash of the id).
FIT_ROWS = 20_000
#: Most terms; fewest toxic documents of a term; least log odds; shortest term that may be misspelled.
TERMS, SUPPORT, LEAST_ODDS, FUZZY_LENGTH = 600, 4, 2.5, 6
#: Words on either side of a hit; most context words kept; fewest windows of one.
WINDOW, CONTEXT_WORDS, CONTEXT_SUPPORT = 6, 4000, 20
#: Score from which a document counts as toxic.
CUT = 0.3
FEATURES = 7
_QUOTES = "\"'«»“”„‘’‹›"
_DEAD = 0


def automaton(terms: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """(class of each character, transitions, term and errors accepted by each state; -1 where none)."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for t, term in enumerate(terms):
        node = 0
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends.setdefault(node, t)
    # errors that the terms below a node allow
    budget = [0] * len(children)

    for t, term in enumerate(terms):
        allowed, node = int(len(term) >= FUZZY_LENGTH), 0
        budget[0] = max(budget[0], allowed)
        for c in term:
            node = children[node][c]
            budget[node] = max(budget[node], allowed)

    def closed(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        out = set(states)
        for node, e in states:  # a character of the term left out
            if e == 0:
                out |= {(n, 1) for n in children[node].values() if budget[n]}
        return frozenset(s for s in out if s[1] == 0 or (s[0], 0) not in out)

    alphabet = sorted({c for kids in children for c in kids})
    cls = {c: i + 1 for i, c in enumerate(alphabet)}
    start = closed({(0, 0)})
    index: dict[frozenset, int] = {frozenset(): _DEAD, start: 1}
    todo, table = [start], [[_DEAD] * (len(alphabet) + 1), []]
    while todo:
        state = todo.pop()
        wrong: set[tuple[int, int]] = set()
        for node, e in state:
            if e == 0:
                if budget[node]:
                    wrong.add((node, 1))  # a character too many
                wrong |= {(n, 1) for n in children[node].values() if budget[n]}  # a wrong character
        row = []
        for c in [None, *alphabet]:
            right = {(children[node][c], e) for node, e in state if c in children[node]} if c is not None else set()
            to = closed(right | wrong)
            if to not in index:
                index[to] = len(table)
                table.append([])
                todo.append(to)
            row.append(index[to])
        table[index[state]] = row
    term_of, errors = np.full(len(table), -1, np.int32), np.full(len(table), -1, np.int32)
    for state, i in index.items():
        hits = [(e, ends[n]) for n, e in state if n in ends and e <= int(len(terms[ends[n]]) >= FUZZY_LENGTH)]
        if hits:
            errors[i], term_of[i] = min(hits)
    return cls, np.array(table, dtype=np.int32), term_of, errors


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    context: dict[str, float] = field(default_factory=dict)
    beta: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def __post_init__(self) -> None:
        self.cls, self.table, self.term_of, self.errors = automaton(self.terms)
        self._class_of: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_class_of": None}

    def class_of(self) -> np.ndarray:
        if self._class_of is None:
            self._class_of = np.zeros(0x110000, dtype=np.int32)
            for c, i in self.cls.items():
                self._class_of[ord(c)] = i
        return self._class_of

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
        """(text, word, term, errors) of every hit, words per text, and the joined text; words are runs of letters."""
        joined = "\0".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(codes) + 2, dtype=bool)
        inside[1:-1] = letters()[codes]
        start, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        kinds = self.class_of()[codes]
        state = np.ones(len(start), dtype=np.int32)
        live, at = np.arange(len(start)), 0
        while len(live):
            going = live[end[live] - start[live] > at]
            state[going] = self.table[state[going], kinds[start[going] + at]]
            live, at = going[state[going] != _DEAD], at + 1
        found = np.flatnonzero(self.term_of[state] >= 0)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(bounds, start[found], side="right") - 1
        first = np.searchsorted(start, bounds)
        self._spans = start, end, first
        return text, found, self.term_of[state[found]], self.errors[state[found]], np.diff(first), joined

    def windows(self, texts: list[str]) -> Iterator[tuple[int, int, int, list[str], bool]]:
        """(text, term, errors, words around, quoted) of every hit."""
        text, word, term, errors, _, joined = self.hits(texts)
        start, end, first = self._spans
        for d, w, t, e in zip(text.tolist(), word.tolist(), term.tolist(), errors.tolist(), strict=True):
            lo, hi = max(first[d], w - WINDOW), min(first[d + 1], w + WINDOW + 1)
            around = [joined[start[i] : end[i]] for i in range(lo, hi) if i != w]
            before, after = joined[start[lo] : start[w]], joined[end[w] : end[hi - 1]] + joined[end[hi - 1] : end[hi - 1] + 1]
            quoted = bool(re.search(f"(?:^|[^\\w])[{_QUOTES}]", before)) and any(q in after for q in _QUOTES)
            yield d, t, e, around, quoted

    def features(self, texts: list[str]) -> np.ndarray:
        """A row of features for each text: sums and maxima of weighted hits, their number and density, their contexts."""
        low = [t.lower() for t in texts]
        out = np.zeros((len(texts), FEATURES))
        n = np.zeros(len(texts))
        for d, t, e, around, quoted in self.windows(low):
            context = sum(self.context.get(w, 0.0) for w in around) / math.sqrt(len(around) or 1)
            weight = self.weights[t] * (0.5 if quoted else 1.0) / (1 + math.exp(-context - 1))
            out[d, 1 if e else 0] += weight
            out[d, 2] = max(out[d, 2], weight if not e else weight / 2)
            out[d, 4] += context
            out[d, 5] += quoted
            n[d] += 1
        words = np.maximum(1, np.array([t.count(" ") + 1 for t in low]))
        out[:, 3] = np.log1p(n)
        out[:, 4:6] /= np.maximum(1, n)[:, None]
        out[:, 0:2] = np.log1p(np.maximum(out[:, 0:2], 0))
        out[:, 6] = np.minimum(n / words * 100, 10)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.features(texts) @ self.beta[1:] + self.beta[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge (none on the intercept)."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = FIT_ROWS) -> Model:
    """Learns lexicon and contexts on three fifths, the regression on the rest, of about ``limit`` labelled documents.

    Null labels and ids are left out; where an id has several labels, the
    largest counts.  Without both labels the model scores everything 0 or 1
    like its only label, 0 where there is none.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = marked.count()
    share = min(1.0, limit / n) if n else 1.0
    # about ``limit`` rows of two numbers each: the bound of what is broadcast
    drawn = marked.where(F.pmod(F.xxhash64(F.lit("tox"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = written(texts.join(F.broadcast(drawn), "id").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5))), "toxicity")
    learn, fitting = sample.where("part < 3"), sample.where("part >= 3")
    sizes = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        model = Model([], np.zeros(0))
        model.beta[0] = 30.0 if pos else -30.0
        return model
    word = learn.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    counts = word.groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).where(F.col("p") >= SUPPORT)
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("q") + 0.5) / (neg + 1.0))
    lexicon = counts.withColumn("o", odds).where((F.col("o") >= LEAST_ODDS) & (F.length("w") >= 3) & (F.length("w") <= 24)).orderBy(F.desc("o"), F.desc("p"), "w").limit(TERMS).collect()
    model = Model([r["w"] for r in lexicon], np.array([r["o"] for r in lexicon]))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                y = part.column(1).to_pylist()
                rows = [(w, y[d], 1 - y[d]) for d, _, _, around, _ in model.windows([t.lower() for t in part.column(0).to_pylist()]) for w in around]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["w", "p", "q"])

    near = learn.select("text", "y").mapInArrow(contexts, "w string, p bigint, q bigint").groupBy("w").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    near = near.where(F.col("p") + F.col("q") >= CONTEXT_SUPPORT).orderBy(F.desc(F.col("p") + F.col("q")), "w").limit(CONTEXT_WORDS).collect()
    whole = [sum(r["p"] for r in near), sum(r["q"] for r in near)]
    if min(whole) > 0:
        model.context = {r["w"]: math.log((r["p"] + 1) / (whole[0] + 1)) - math.log((r["q"] + 1) / (whole[1] + 1)) for r in near}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                x = model.features(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), part.column(1)], names=[*(f"x{i}" for i in range(FEATURES)), "y"])

    # at most about ``limit`` rows of numbers
    fit = fitting.select("text", "y").mapInArrow(rows, ", ".join(f"x{i} double" for i in range(FEATURES)) + ", y int").collect()
    values = np.array([list(r) for r in fit], dtype=np.float64).reshape(-1, FEATURES + 1)
    model.beta = regression(values[:, :-1], values[:, -1])
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document: 0 to 1, higher where the text is likelier toxic.

    A null text counts as empty and gets the score of a text without hits.
    Rows are scored one by one, without a shuffle; memory is bounded by a text
    chunk.  Other columns don't matter.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text_col, CHUNK_BYTES):
                score = model.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=[id_col, "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(rows, f"`{id_col}` {id_type}, score double")
