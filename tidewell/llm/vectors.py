"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own; the length of
what quantisation leaves over is kept per vector.  For two vectors x = x' + r
and y = y' + s the product of the originals differs from that of the
quantised ones by at most |r||y'| + |s||x'| + |r||s|, so only pairs whose
quantised product comes within that of the threshold are computed in full
precision, and no pair at or above it is missed.  Products of int8 values
are exact in single precision up to 1040 components of 127 * 127 < 2^24; for longer ones double precision is used.

Vectors of one label are dealt into blocks, and each pair of blocks is one
task's tile.  Equal vectors are one class with a multiplicity before that.
A tile gives back link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Vectors of one block; rows of one product; pairs recomputed at once.
BLOCK, STRIP, PAIRS = 16384, 2048, 1 << 16
#: Covers the rounding of the double-precision steps themselves.
SLACK = 1e-9


class Quantised:
    """Unit vectors in double precision with their int8 forms and bounds."""

    def __init__(self, vectors: np.ndarray):
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        scale = np.abs(self.unit).max(axis=1, keepdims=True) / 127
        self.q = np.rint(self.unit / scale).astype(np.int8)
        back = self.q * scale
        self.scale = scale[:, 0]
        self.rest = np.linalg.norm(self.unit - back, axis=1)
        self.length = np.linalg.norm(back, axis=1)

    def as_float(self) -> np.ndarray:
        return self.q.astype(np.float32 if self.q.shape[1] * 127 * 127 < 1 << 24 else np.float64)


def linked(x: Quantised, y: Quantised, threshold: float, same: bool):
    """Yields (rows of x, rows of y) of pairs at or above the threshold; with ``same`` each pair once, none of a row with itself."""
    left, right = x.as_float(), y.as_float()
    for i in range(0, len(left), STRIP):
        for j in range(i if same else 0, len(right), STRIP):
            a, b = slice(i, i + STRIP), slice(j, j + STRIP)
            product = (left[a] @ right[b].T).astype(np.float64) * x.scale[a, None] * y.scale[None, b]
            bound = x.rest[a, None] * y.length[None, b] + (x.length[a] + x.rest[a])[:, None] * y.rest[None, b]
            u, v = np.nonzero(product + bound >= threshold - SLACK)
            u, v = u + i, v + j
            if same:
                u, v = u[u < v], v[u < v]
            for k in range(0, len(u), PAIRS):
                p, q = u[k : k + PAIRS], v[k : k + PAIRS]
                hit = np.einsum("ij,ij->i", x.unit[p], y.unit[q]) >= threshold
                if hit.any():
                    yield p[hit], q[hit]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n nodes is joined to."""
    label = np.arange(n)
    moved = True
    while moved:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        moved = (label != before).any()
    return label


def _tile(threshold: float):
    def work(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        rep = batch.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        rep = rep[order]
        times, side = batch.column("mult").to_numpy()[order], batch.column("side").to_numpy()[order]
        flat = batch.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(len(order), -1)[order]
        links = np.zeros(len(rep), dtype=np.int64)
        pairs = []
        if (side == 0).all():
            x = Quantised(vectors)
            found = linked(x, x, threshold, True)
            places = (np.arange(len(rep)),) * 2
        else:
            places = (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
            empty = not len(places[0]) or not len(places[1])
            found = [] if empty else linked(Quantised(vectors[places[0]]), Quantised(vectors[places[1]]), threshold, False)
        for a, b in found:
            a, b = places[0][a], places[1][b]
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            pairs.append((a, b))
        root = forest(len(rep), pairs)
        has = links > 0
        return pa.table({"rep": rep[has], "links": links[has], "root": rep[root[has]]})

    return work


def vector_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths agree
    and their cosine reaches ``threshold``.  Null or empty vectors, zero
    vectors, and those with null or non-finite components link with nothing;
    they are components of their own.  Rows that repeat an id are vectors of
    their own.  The work is that of all pairs of one label, in tiles; a vector
    is sent to as many tiles as its label has blocks.  Ids may not be null
    where a component is asked for: a null id keeps null.
    """
    base = vectors.select(F.col(id_col).alias("vid"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    big = F.col("embedding").cast("array<double>")
    fine = F.forall(big, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(big, lambda v: v != 0)
    ok = F.coalesce(F.col("vid").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine, F.lit(False))
    base = base.withColumn("ok", ok).withColumn("key", F.when(F.col("ok"), F.struct("label", "embedding")))
    reps = written(base.where("ok").groupBy("key").agg(F.min("vid").alias("rep"), F.count("*").alias("mult")), "vectors")
    rows = reps.select("rep", "mult", F.col("key.label").alias("label"), F.col("key.embedding").alias("embedding"), F.size("key.embedding").alias("dim"))
    blocks = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(blocks, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = other.select("rep", "mult", "embedding", "label", "dim", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"))
    found = written(tiles.groupBy("label", "dim", "i", "j").applyInArrow(_tile(threshold), "rep bigint, links bigint, root bigint"), "vectors")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors").select(F.col("node").alias("rep"), "component")
    known = reps.join(links, "rep", "left").join(parts, "rep", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.select("vid", "key").join(known, "key", "left")
    own = F.coalesce("component_id", "vid")
    return out.select(F.col("vid").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.cast("long").alias("component_id"), F.col("vid").eqNullSafe(own).alias("kept"))


ORACLE = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (WITH RECURSIVE r AS (SELECT vec_id AS v, vec_id AS w FROM v UNION SELECT r.v, link.b FROM r JOIN link ON r.w = link.a) SELECT v, min(w) AS component_id FROM r GROUP BY v)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN reach ON reach.v = v.vec_id
"""
