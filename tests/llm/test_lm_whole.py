"""The language model learns from every training document, not from a share of them."""

import os
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import lm, registry


def test_every_window_is_learned_from(monkeypatch):
    ids = np.arange(40 * 300) % 391
    model, seen = lm.untrained(np.full(400, 5)), []
    own = lm.AttentionModel.gradients
    monkeypatch.setattr(lm.AttentionModel, "gradients", lambda m, inputs, goals: seen.append(inputs) or own(m, inputs, goals))
    start = lm.moments(model)
    n = [lm.fit(model, *start, ids, np.full(300, 40), (r, lm.ROUNDS), 0, (5, 0)) for r in range(lm.ROUNDS)]
    assert n == [300] * lm.ROUNDS and sum(map(len, seen)) == 5 * lm.BATCH  # the last step is filled up
    assert len(np.unique(np.vstack(seen), axis=0)) == len(np.unique(lm.windows(ids, np.full(300, 40), -1)[0], axis=0))


def test_parts_hold_every_training_document(spark, monkeypatch):
    got = []
    monkeypatch.setattr(lm, "fit_parts", lambda model, learned, parts, dtype, steps: got.append((learned.count(), parts, learned.select("part").distinct().count())) or model)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert lm.score_documents(rows, F.col("doc_id") < 300, registry.tokenizer_path("byte_bpe_multi_50k.tiktoken"), train_documents=50).count() == 400
    assert got == [(300, 6, 6)]


def test_parts_are_dealt_once_for_all_rounds(spark, monkeypatch):
    texts = [(i % 3, (np.arange(50) * (i + 1) % 97).astype(np.uint16).tobytes()) for i in range(30)]
    rows, start, dealt, made = spark.createDataFrame(texts, "part int, pieces binary"), lm.untrained(np.full(100, 5)), [], []
    own = type(rows).repartitionById
    monkeypatch.setattr(type(rows), "repartitionById", lambda df, *a: dealt.append(a) or own(df, *a))
    monkeypatch.setattr(lm, "mean_of", lambda states, mean=lm.mean_of: made.append(sum(states.column("windows").to_pylist())) or mean(states))
    lm.fit_parts(start, rows, 3, np.dtype(np.uint16), 1)
    assert len(dealt) == 1 and made == [60] * lm.ROUNDS  # two windows a text, all of them in each round's weights


def test_long_parts_are_learned_from_in_several_rows(spark, monkeypatch):
    texts = [(0, (np.arange(50) * (i + 1) % 97).astype(np.uint16).tobytes()) for i in range(30)]
    seen, rows = [], []
    monkeypatch.setattr(lm, "PART_BYTES", 1000)
    monkeypatch.setattr(lm, "removed", lambda df: rows.append(df.count()))
    monkeypatch.setattr(lm, "mean_of", lambda states, mean=lm.mean_of: seen.append(sum(states.column("windows").to_pylist())) or mean(states))
    lm.fit_parts(lm.untrained(np.full(100, 5)), spark.createDataFrame(texts, "part int, pieces binary"), 1, np.dtype(np.uint16), 1)
    assert set(seen) == {60} and set(rows) == {3}


def test_a_round_makes_its_own_windows_only(monkeypatch):
    made, own = [], lm.windows
    monkeypatch.setattr(lm, "windows", lambda *a: made.append(own(*a)) or made[-1])
    model = lm.untrained(np.full(400, 5))
    for r in range(lm.ROUNDS):
        lm.fit(model, *lm.moments(model), np.arange(40 * 1024) % 391, np.full(1024, 40), (r, lm.ROUNDS), 0, (5, 0))
    assert [len(m[0]) for m in made] == [1024 // lm.ROUNDS] * lm.ROUNDS


def test_training_leaves_no_tables(spark, monkeypatch):
    made, own = [], lm.written
    monkeypatch.setattr(lm, "written", lambda df, purpose: made.append(own(df, purpose)) or made[-1])
    rows = spark.createDataFrame([(i % 3, np.arange(50, dtype=np.uint16).tobytes()) for i in range(30)], "part int, pieces binary")
    folders = []
    monkeypatch.setattr(lm, "removed", lambda df, remove=lm.removed: folders.append(df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")) or remove(df))
    lm.fit_parts(lm.untrained(np.full(100, 5)), rows, 3, np.dtype(np.uint16), 1)
    assert len(made) == len(folders) == lm.ROUNDS + 1 and not any(os.path.exists(f) for f in folders)


def test_steps_use_their_arrays_again():
    """After the first step, no step takes fresh memory for what has a row for each token."""
    model, rng = lm.untrained(np.full(400, 5)), np.random.default_rng(3)
    x, y = rng.integers(0, 300, (64, lm.WINDOW)), rng.integers(0, lm.CLASSES, (64, lm.WINDOW))
    first = model.gradients(x, y)
    tracemalloc.start()
    again, (_, peak) = model.gradients(x, y), tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 64 * lm.WINDOW * lm.CLASSES * 4  # bytes; less than the exponents of the classes alone
    assert first[0] == again[0] and all(np.array_equal(first[1][k], again[1][k]) for k in first[1])


def test_no_query_where_nothing_is_scored(monkeypatch):
    """A later window's first tokens are keys and values only."""
    model, weights, exp = lm.untrained(np.full(400, 5)), [], np.exp
    monkeypatch.setattr(lm.np, "exp", lambda x, out=None: weights.append(x.shape) or exp(x, out=out))
    model.score(np.arange(40 + 32 * 50) % 391, np.array([40 + 32 * 50]))
    queries = sum(n * q for n, q, _ in (w for w in weights if len(w) == 3))
    assert queries == 40 + 32 * 50  # each token once
