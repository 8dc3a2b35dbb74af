"""Mixing sources to target weights by Poisson replication.

A source's target weight gives the mean number of times that each of its
documents is repeated.  A document's count is drawn by inverting the Poisson
distribution at a number in [0, 1) hashed from the seed and the document's id,
so it doesn't depend on partitions or order.  Documents are exploded by their
counts, and copies are dealt over all partitions and sorted by a hash of
their own.  Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import fresh_names, written

#: Means above this are drawn as sums of several smaller ones.
PART_MEAN = 16.0
#: Beyond so many terms the distribution function of a part is 1 in double precision.
TERMS = 96
#: Means are cut to multiples of this, so that summing in another order changes nothing.
STEP = 1e-6


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts; null counts as the word null."""
    text = F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k at which the distribution function with this mean (at most PART_MEAN) exceeds u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.when(u >= s["c"], i.cast("int")).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source, documents, rate): the mean repetitions that bring each source to its weight.

    Without ``weights`` a source's weight is its number of documents to the
    power ``temperature``.  ``size`` is the expected size of the mix in units
    of the input.  Sources without a weight get rate 0.
    """
    counts = written(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("documents")), "mixing")
    if weights is None:
        weight = F.pow(F.col("documents").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, value in sorted(weights.items()):
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    total = counts.agg(F.sum("documents").alias("n"), F.sum("w").alias("w")).first()
    n, w = float(total["n"] or 0), float(total["w"] or 0.0)
    rate = F.col("w") / F.lit(w or 1.0) * F.lit(n * size) / F.col("documents")
    return written(counts.select("source", "documents", (F.floor(rate / STEP) * STEP).alias("rate")), "mixing")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix: each document as often as drawn, with ``copy_no`` from 1, in globally shuffled order.

    A null source is a source of its own.  Rows that repeat an id draw the same
    count.  An input column named ``copy_no`` is replaced.  Copies are dealt by
    hashes of their whole rows and numbers, so neither a hot source nor an
    often drawn document lands in one task, nor do the rows without an id;
    rows that repeat in every column do.  The table of rates has a row per source; Spark joins it
    by broadcast only while its written size is under the session's limit.
    """
    columns = [c for c in docs.columns if c != "copy_no"]
    own = [F.col(f"`{c}`") for c in columns]
    of, rate, count, key = fresh_names(docs, "mix_source", "mix_rate", "mix_count", "mix_key")
    rates = source_rates(docs, source_col, weights, temperature, size).select(F.col("source").alias(of), F.col("rate").alias(rate))
    rated = docs.select(*own).join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(of)))
    parts = F.greatest(F.lit(1), F.ceil(F.col(rate) / PART_MEAN).cast("int"))
    drawn = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda s, i: s + poisson(uniform(F.lit(seed), id_col, i), F.col(rate) / parts))
    copies = rated.withColumn(count, drawn).where(F.col(count) > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(count))))
    hashed = [c for c, f in zip(own, docs.select(*own).schema, strict=True) if isinstance(f.dataType, AtomicType)]
    keyed = copies.withColumn(key, F.xxhash64(F.lit(seed), F.col("copy_no"), *hashed))
    return keyed.repartition(key).sortWithinPartitions(key).select(*own, "copy_no")


def oracle(temperature: float = 0.5, seed: int = 17) -> str:
    """DuckDB SQL for ``mix_sources`` over ``documents`` with weights by temperature."""
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature}::DOUBLE) AS w FROM documents GROUP BY source),
total AS (SELECT sum(n)::DOUBLE AS n, sum(w) AS w FROM counts),
rates AS (SELECT source, floor(c.w / t.w * t.n / c.n / {STEP}::DOUBLE) * {STEP}::DOUBLE AS rate FROM counts c, total t),
parts AS (SELECT source, greatest(1, ceil(rate / {PART_MEAN}::DOUBLE)::INT) AS m, rate / greatest(1, ceil(rate / {PART_MEAN}::DOUBLE)::INT) AS mean FROM rates),
cdf AS (SELECT source, m, mean, 0 AS k, exp(-mean) AS p, 0::DOUBLE AS lo, exp(-mean) AS hi FROM parts
  UNION ALL SELECT source, m, mean, k + 1, p * mean / (k + 1)::DOUBLE, hi, hi + p * mean / (k + 1)::DOUBLE FROM cdf WHERE k < {TERMS}),
draws AS (SELECT d.doc_id, d.source, ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r}::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.m + 1)) AS i)),
count_of AS (SELECT w.doc_id, w.source, sum(k)::BIGINT AS n FROM draws w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND w.u >= c.lo AND w.u < c.hi GROUP BY w.doc_id, w.source)
SELECT d.*, unnest(range(1, n + 1))::INT AS copy_no FROM documents d JOIN count_of c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source WHERE n > 0
"""
