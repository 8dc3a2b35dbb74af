"""Ordered analytics: gaps and islands, sequence audits, candles, as-of joins, rolling and running measures.

All of it is window functions and aggregations partitioned by a stream key,
so a stream is one sort; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def _over(keys: Cols, order: Cols | list[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def first_wins(df: DataFrame, keys: Cols, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(_over(keys, order))).where("_rn = 1").drop("_rn")


def classify_repeats(df: DataFrame, keys: Cols, content: Column, order: list[Column]) -> DataFrame:
    """``repeat_class`` of each row against the first of its key: first, exact_duplicate or sequence_conflict."""
    w = _over(keys, order)
    return (
        df.withColumn("_content", content)
        .withColumn("_first", F.first("_content").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("repeat_class", F.when(F.col("_rn") == 1, "first").when(F.col("_content") == F.col("_first"), "exact_duplicate").otherwise("sequence_conflict"))
        .drop("_content", "_first", "_rn")
    )


def sequence_audit(df: DataFrame, keys: Cols, seq: str, order: list[Column]) -> DataFrame:
    """Per row: prev, the numbers missing before it, and whether it repeats or goes back against the row before."""
    prev = F.lag(seq).over(_over(keys, order))
    return (
        df.withColumn("prev_seq", prev)
        .withColumn("missing", F.when(F.col(seq) > F.col("prev_seq") + 1, F.col(seq) - F.col("prev_seq") - 1).otherwise(F.lit(0)).cast("long"))
        .withColumn("regressed", F.coalesce(F.col(seq) < F.col("prev_seq"), F.lit(False)))
        .withColumn("repeated", F.coalesce(F.col(seq) == F.col("prev_seq"), F.lit(False)))
    )


def high_water_audit(df: DataFrame, keys: Cols, seq: str, order: list[Column]) -> DataFrame:
    """Sequence audit against the highest number seen so far rather than the last one."""
    high = F.max(seq).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("high_seq", high)
        .withColumn("gap_size", F.when(F.col("high_seq").isNull(), F.greatest(F.col(seq), F.lit(0))).when(F.col(seq) > F.col("high_seq") + 1, F.col(seq) - F.col("high_seq") - 1).otherwise(0).cast("long"))
        .withColumn("regressed", F.coalesce(F.col(seq) < F.col("high_seq"), F.lit(False)))
    )


def infer_epochs(df: DataFrame, keys: Cols, seq: str, order: list[Column]) -> DataFrame:
    """``epoch`` from 1: each step back of the sequence opens the next one."""
    w = _over(keys, order)
    back = F.when(F.col(seq) < F.lag(seq).over(w), 1).otherwise(0)
    return df.withColumn("_back", back).withColumn("epoch", (F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_back")


def contiguous_ordinals(df: DataFrame, keys: Cols, ordinal: str, base: int = 1) -> DataFrame:
    """Per key: rows, and rows whose ordinal isn't its position counted from ``base``."""
    at = F.row_number().over(_over(keys, [F.col(ordinal)])) - 1 + base
    return df.withColumn("_ok", F.col(ordinal) == at).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col("_ok"), 0).otherwise(1)).cast("long").alias("n_defects"))


def merge_intervals(df: DataFrame, keys: Cols, start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """Merged intervals per key: a new one begins where a start lies beyond the running maximum end plus ``tolerance`` seconds."""
    w = _over(keys, [F.col(start), F.col(end)])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("_reach").isNull() | (F.unix_micros(F.col(start).cast("timestamp")) > F.unix_micros(F.col("_reach").cast("timestamp")) + F.lit(int(tolerance * 1e6))), 1).otherwise(0)
    marked = df.withColumn("_reach", reach).withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count("*").alias("n_intervals"))


def interval_gaps(islands: DataFrame, keys: Cols) -> DataFrame:
    """Gaps between merged intervals, with their seconds."""
    w = _over(keys, [F.col("island")])
    rows = islands.withColumn("gap_start", F.lag("island_end").over(w)).withColumn("gap_end", F.col("island_start"))
    micros = F.unix_micros(F.col("gap_end").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))
    return rows.where("gap_start IS NOT NULL").select(*keys, "gap_start", "gap_end", (micros / F.lit(1e6)).alias("gap_seconds"))


def row_islands(df: DataFrame, keys: Cols, ts: str, order: list[Column], seconds: float) -> DataFrame:
    """``island`` from 1 per key: a row more than ``seconds`` after the one before begins the next."""
    w = _over(keys, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    step = micros - F.lag(micros).over(w)
    return df.withColumn("_new", F.when(step.isNull() | (step > int(seconds * 1e6)), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def candles(df: DataFrame, keys: Cols, ts: str, price: str, size: str, order: Cols, seconds: int) -> DataFrame:
    """Open, high, low, close and volume per key and bucket of ``seconds``; ties of time go by ``order``."""
    bucket = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    at = F.struct(*[F.col(c) for c in order])
    return df.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"), F.count("*").alias("n_ticks"))


def missing_buckets(bars: DataFrame, keys: Cols, seconds: int) -> DataFrame:
    """Buckets between a key's first and last bar that have none."""
    span = bars.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("bucket"))
    return grid.join(bars.select(*keys, "bucket"), [*keys, "bucket"], "left_anti")


def asof_join(left: DataFrame, right: DataFrame, keys: Cols, on: str, values: Cols, forward: bool = False) -> DataFrame:
    """Each left row with the ``values`` of the last right row at or before it (first at or after it, ``forward``).

    One union and one sort per key; both sides need ``keys`` and ``on``.  At
    equal places the right row counts.  ``forward`` sorts backwards: a frame
    up to the end would be read again for each row.
    """
    side = left.columns
    pad = left.withColumn("_left", F.lit(True))
    other = right.where(F.col(on).isNotNull()).select(*keys, on, *[F.col(v).alias(f"_r_{v}") for v in values], F.col(on).alias("_r_at")).withColumn("_left", F.lit(False))
    rows = pad.unionByName(other, allowMissingColumns=True)
    frame = _over(keys, [F.desc_nulls_first(on) if forward else F.asc_nulls_first(on), F.col("_left")]).rowsBetween(Window.unboundedPreceding, 0)
    # the key's own column is never null, so a matched row with null values still counts
    found = F.struct(*[F.col(f"_r_{v}").alias(v) for v in values], F.col("_r_at").alias("_at"))
    rows = rows.withColumn("_m", F.last(F.when(~F.col("_left"), found), ignorenulls=True).over(frame)).where("_left")
    return rows.select(*side, *[F.col(f"_m.{v}").alias(f"asof_{v}") for v in values], F.col("_m._at").alias(f"asof_{on}"))


def last_n(df: DataFrame, keys: Cols, order: Cols, n: int, **sums: Column) -> DataFrame:
    """Sums over the last ``n`` rows, this one included."""
    frame = _over(keys, [F.col(c) for c in order]).rowsBetween(-(n - 1), 0)
    return df.withColumns({name: F.sum(value).over(frame) for name, value in sums.items()})


def trade_imbalance(trades: DataFrame, keys: Cols, order: Cols, n: int = 100, side: str = "side", size: str = "size") -> DataFrame:
    """(buy - sell) / (buy + sell) volume over the last ``n`` trades; trades of an unknown side take a place and add nothing, trades without size take none."""
    rows = last_n(trades.where(F.col(size).isNotNull()), keys, order, n, buy_volume=F.when(F.col(side) == "buy", F.col(size)).otherwise(0), sell_volume=F.when(F.col(side) == "sell", F.col(size)).otherwise(0))
    total = F.col("buy_volume") + F.col("sell_volume")
    return rows.withColumn("imbalance", F.when(total != 0, (F.col("buy_volume") - F.col("sell_volume")).cast("double") / total.cast("double")))


def histogram(df: DataFrame, value: str, bounds: list[float], upper_inclusive: bool = False) -> DataFrame:
    """``bin`` of each value: bounds reached so far ([lo, hi)), or passed so far ((lo, hi]) with ``upper_inclusive``."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    inside = (lambda b: b < F.col(value)) if upper_inclusive else (lambda b: b <= F.col(value))
    return df.withColumn("bin", F.size(F.filter(edges, inside)))


def histogram_quantile(bins: DataFrame, bin_col: str, count: str, q: float, bounds: list[float]) -> DataFrame:
    """The upper bound of the first bin at which the cumulative count reaches ceil(n * q)."""
    w = Window.orderBy(bin_col)
    cum = bins.withColumn("_cum", F.sum(count).over(w)).withColumn("_n", F.sum(count).over(Window.partitionBy()))
    edges = F.array(*[F.lit(float(b)) for b in [*bounds, float("inf")]])
    return cum.where(F.col("_cum") >= F.ceil(F.col("_n") * F.lit(q))).agg(F.min(F.element_at(edges, F.col(bin_col) + 1)).alias("upper_bound"))


def drawdown(df: DataFrame, keys: Cols, order: Cols, equity: str) -> DataFrame:
    """Running maximum of equity, drawdown from it and the largest so far."""
    w = _over(keys, [F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(equity).over(w)).withColumn("drawdown", F.col("peak") - F.col(equity)).withColumn("max_drawdown", F.max("drawdown").over(w))


def ema(df: DataFrame, keys: Cols, order: str, value: str, span: int) -> DataFrame:
    """The last exponential moving average per key, seeded with the first value, alpha 2 / (span + 1)."""
    alpha = 2.0 / (span + 1)
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    return df.groupBy(*keys).agg(values.alias("_v")).select(*keys, F.aggregate(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), F.element_at("_v", 1), lambda a, x: F.lit(alpha) * x + F.lit(1 - alpha) * a).alias("ema"), F.size("_v").cast("long").alias("n"))


def overlaps(points: DataFrame, gaps: DataFrame, key: str, start: str, end: str, bucket_seconds: int = 86400) -> DataFrame:
    """Rows of ``points`` whose [start, end) overlaps a gap of their key; both meet in the buckets of time that they touch."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000))
    touched = lambda a, b: F.explode(F.sequence(bucket(a), F.greatest(bucket(a), bucket(b))))
    g = gaps.select(F.col(key).alias("_k"), F.col("gap_start").alias("_gs"), F.col("gap_end").alias("_ge")).withColumn("_b", touched("_gs", "_ge"))
    rows = points.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_row", F.monotonically_increasing_id()).withColumn("_b", touched(start, end))
    hit = rows.join(g, (F.col(key) == F.col("_k")) & (rows["_b"] == g["_b"]) & (F.col("_gs") < F.col(end)) & (F.col("_ge") > F.col(start)), "left_semi").drop("_b")
    return hit.dropDuplicates(["_row"]).drop("_row")


def every_nth(df: DataFrame, keys: Cols, order: list[Column], n: int, reset: Column) -> DataFrame:
    """Rows that are emitted: those that ``reset`` the counter, and each n-th after one."""
    w = _over(keys, order)
    rows = df.withColumn("_g", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_reset", reset)
    inner = _over([*keys, "_g"], order)
    rows = rows.withColumn("_i", F.sum(F.when(F.col("_reset"), 0).otherwise(1)).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("_reset") | (F.col("_i") % n == 0)).drop("_g", "_reset", "_i")
