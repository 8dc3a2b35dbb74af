"""Diagnostics of lots, streams, files and stored windows: coverage, recovery, replicas, boundaries, claims.

All are windows and aggregations by their keys.  Gaps of a key don't overlap,
so whether an interval meets one is a question to the first gap that ends
after its start: an as-of join, no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as S
from tidewell.operators.timeseries import asof_join

#: A step between bars of more than this many intervals is a gap.
GAP_TOLERANCE = 1.5


def coverage_gaps(bars: DataFrame, keys: list[str], seconds: int, tolerance: float = GAP_TOLERANCE) -> DataFrame:
    """(keys, gap_start, gap_end, gap_seconds): steps between bars of a key that are too long; ``bars``: keys, bucket."""
    after = F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket"))
    steps = bars.select(*keys, F.col("bucket").alias("gap_start"), after.alias("gap_end")).withColumn("gap_seconds", F.col("gap_end") - F.col("gap_start"))
    return steps.where(F.col("gap_seconds") > seconds * tolerance)


def lot_coverage(lots: DataFrame, bars: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """``lots`` with final_ts (the last bar of the key), gap_from, at_gap_end and covered.

    ``lots``: keys, entry_ts, exit_ts (null while open), in seconds.
    ``gap_from`` is where the first gap begins that ends at or after the
    entry; a lot that enters where a gap ends is never covered; others are
    while no gap meets the time from entry to exit or last bar.
    """
    gaps = coverage_gaps(bars, keys, seconds).select(*keys, F.col("gap_end").alias("bucket"), "gap_start")
    ends = bars.groupBy(*keys).agg(F.max("bucket").alias("final_ts"))
    found = asof_join(lots.join(ends, keys).withColumn("bucket", F.col("entry_ts")), gaps, keys, "bucket", ["gap_start"], forward=True)
    until = F.coalesce("exit_ts", "final_ts")
    edge = F.coalesce(F.col("asof_bucket") == F.col("entry_ts"), F.lit(False))
    met = F.coalesce((until > F.col("entry_ts")) & (F.col("asof_gap_start") < until), F.lit(False))
    return found.select(*lots.columns, "final_ts", F.col("asof_gap_start").alias("gap_from"), edge.alias("at_gap_end"), (~edge & ~met).alias("covered"))


def recovery_statuses(covered: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """A row per lot of ``lot_coverage`` and horizon: status, and whether the lot could be followed to the deadline without a gap."""
    every = covered.withColumn("_h", F.explode(F.array(*[F.struct(F.lit(name).alias("horizon"), F.lit(s).cast("long").alias("seconds")) for name, s in horizons.items()])))
    every = every.select(*covered.columns, "_h.horizon", (F.col("entry_ts") + F.col("_h.seconds")).alias("deadline"))
    reaches = F.col("final_ts") >= F.col("deadline")
    gap = F.col("at_gap_end") | F.coalesce(F.col("gap_from") < F.col("deadline"), F.lit(False))
    status = F.when(F.col("exit_ts") <= F.col("deadline"), "recovered").when(~reaches, "right_censored").when(gap, "data_gap_unknown").otherwise("not_recovered")
    return every.withColumn("eligible", reaches & ~gap).withColumn("status", status)


def recovery_summary(statuses: DataFrame) -> DataFrame:
    """Counts by horizon, and the rate of recovery among the eligible (null without any)."""
    is_ = lambda s: F.col("status") == s
    rows = statuses.groupBy("horizon").agg(
        F.count_if("eligible").alias("eligible"),
        F.count_if(F.col("eligible") & is_("recovered")).alias("recovered"),
        F.count_if(is_("not_recovered")).alias("known_failure"),
        F.count_if(is_("right_censored")).alias("right_censored"),
        F.count_if(is_("data_gap_unknown")).alias("data_gap_unknown"),
        F.count_if(~F.col("eligible") & is_("recovered")).alias("recovered_but_ineligible"),
    )
    return rows.withColumn("rate", F.when(F.col("eligible") > 0, F.col("recovered") / F.col("eligible")))


def markout_statistics(marks: DataFrame) -> DataFrame:
    """By horizon of ``ledger.markouts``: lots per status, negative ones, and mean, median, least and largest markout of exact marks.

    The median holds the distinct values of a horizon in its task.  Finite
    markouts are summed as decimals; infinite ones and NaN count as they are,
    in the mean too.
    """
    exact = F.when(F.col("status") == "exact", F.col("markout_bps"))
    finite = F.abs(exact) < float("inf")
    rows = marks.groupBy("horizon").agg(
        F.count(exact).alias("observed"),
        F.count_if(F.col("status") == "delayed").alias("delayed"),
        F.count_if(F.col("status") == "censored").alias("censored"),
        F.count_if(exact < 0).alias("negative"),
        (F.coalesce(F.sum(F.when(finite, exact).cast("decimal(28,8)")).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(~finite, exact)), F.lit(0.0))).alias("_sum"),
        F.percentile(exact, 0.5).alias("median"),
        F.min(exact).alias("least"),
        F.max(exact).alias("largest"),
    )
    share = lambda c: F.when(F.col("observed") > 0, F.col(c) / F.col("observed"))
    return rows.select("horizon", "observed", "delayed", "censored", "negative", share("negative").alias("negative_rate"), share("_sum").alias("average"), "median", "least", "largest")


def transitions(df: DataFrame, keys: list[str], order: str, state: Column, counted: Column) -> DataFrame:
    """(keys, n_rows, n_transitions): changes of a state from one counted row to the next."""
    rows = df.where(counted).withColumn("_state", state)
    moved = F.col("_state") != F.lag("_state").over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_moved", moved).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if("_moved").alias("n_transitions"))


def utilisation(closes: DataFrame, keys: list[str], active: Column, capital: Column) -> DataFrame:
    """(keys, n_closes, average, largest): the share of capital in use, sampled at closes."""
    return closes.withColumn("_share", active / capital).groupBy(*keys).agg(F.count("*").alias("n_closes"), (F.sum(active.cast("decimal(28,8)")).cast("double") / F.sum(capital)).alias("average"), F.max("_share").alias("largest"))


def blocked(events: DataFrame, reason: str, slot: str, band: str) -> DataFrame:
    """(reason, n_events, n_slots, n_bands): what each reason blocked, slots and bands counted once."""
    return events.groupBy(reason).agg(F.count("*").alias("n_events"), F.countDistinct(slot).alias("n_slots"), F.countDistinct(band).alias("n_bands"))


def replica_streams(rows: DataFrame, declared: DataFrame, keys: list[str], route: str, ordinal: str, content: list[str]) -> DataFrame:
    """A row per declared stream: missing, first, match or mismatch with the first route of its keys that is there.

    ``rows``: keys, route, ordinal, content; ``declared``: keys, route.
    Streams are equal when count and two sums of hashes of (ordinal, content)
    are, which combine before the shuffle.
    """
    digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(ordinal), *[F.col(c) for c in content]).cast("decimal(38,0)"))
    streams = rows.groupBy(*keys, route).agg(F.struct(F.count("*").alias("n"), digest(1).alias("a"), digest(2).alias("b")).alias("_digest"))
    both = declared.join(streams, [*keys, route], "left")
    expected = F.first("_digest", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(route).rowsBetween(Window.unboundedPreceding, 0))
    before = F.count("_digest").over(Window.partitionBy(*keys).orderBy(route).rowsBetween(Window.unboundedPreceding, -1))
    status = F.when(F.col("_digest").isNull(), "missing").when(F.col("_before") == 0, "first").when(F.col("_digest") == F.col("_expected"), "match").otherwise("mismatch")
    return both.withColumns({"_expected": expected, "_before": before}).select(*keys, route, F.coalesce("_digest.n", F.lit(0)).cast("long").alias("n"), status.alias("status"))


def audit_windows(windows: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window_id, states, stored, errors) of every declared or stored validity window.

    ``windows``: keys, window_id, epoch, first_seq, states; ``states``: keys,
    window_id, epoch, seq.  A window's first stored state must carry its first
    sequence and epoch, and as many states must be stored as declared.
    """
    at = [*keys, "window_id"]
    stored = states.groupBy(*at).agg(F.count("*").alias("stored"), F.min_by("epoch", "seq").alias("_epoch"), F.min("seq").alias("_seq"))
    both = windows.select(*at, "epoch", "first_seq", "states").join(stored, at, "full")
    kept = F.coalesce("stored", F.lit(0)).cast("long")
    errors = F.array_compact(F.array(
        F.when(F.col("states").isNull(), "undeclared_window"),
        F.when(F.col("states") != kept, "row_count_mismatch"),
        F.when(F.col("states").isNotNull() & F.col("stored").isNull(), "origin_missing"),
        F.when(F.col("_seq") != F.col("first_seq"), "origin_sequence_mismatch"),
        F.when(F.col("_epoch") != F.col("epoch"), "origin_epoch_mismatch"),
    ))
    return both.select(*at, "states", kept.alias("stored"), F.array_join(errors, ",").alias("errors"))


def right_boundaries(rows: DataFrame, keys: list[str], file: str, line: str, seq: str) -> DataFrame:
    """Per file: the last sequence so far, the first of the next file, and whether it follows on.

    A row without a sequence is passed over; the next file must have one.
    """
    numbered = F.when(F.col(seq).isNotNull(), F.col(line))
    files = rows.groupBy(*keys, file).agg(F.min_by(seq, numbered).alias("_first"), F.max_by(seq, numbered).alias("_last"))
    w = Window.partitionBy(*keys).orderBy(file)
    after = files.withColumns({"expected": F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1, "observed": F.lead("_first").over(w), "_more": F.lead(F.lit(1)).over(w)})
    status = F.when(F.col("_more").isNull(), "last_file").when(F.col("observed").isNull(), "no_sequence").when(F.col("observed") == F.col("expected"), "contiguous").otherwise("not_contiguous")
    return after.select(*keys, file, "expected", "observed", status.alias("status"))


def receive_regressions(rows: DataFrame, file: str, line: str, recv: str) -> DataFrame:
    """(file, n_lines, n_missing, n_invalid, n_regressions): receive times of each file against the last valid one before."""
    ns = S.iso_ns(F.col(recv))
    before = F.last("_ns", ignorenulls=True).over(Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_ns", ns).withColumn("_back", F.col("_ns") < before)
    return marked.groupBy(file).agg(F.count("*").alias("n_lines"), F.count_if(F.col(recv).isNull()).alias("n_missing"), F.count_if(F.col(recv).isNotNull() & F.col("_ns").isNull()).alias("n_invalid"), F.count_if("_back").alias("n_regressions"))


def selected_sources(rows: DataFrame, path: str, ts: str) -> DataFrame:
    """(path, selected_rows, first, last) of the files that chosen rows come from."""
    return rows.groupBy(path).agg(F.count("*").alias("selected_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def level_order(levels: Column, descending: bool) -> Column:
    """What is wrong with a side of a book, an array of (price, quantity): empty, not_positive, out_of_order or ok."""
    prices = F.transform(levels, lambda x: x["price"])
    bad = F.exists(levels, lambda x: ~F.coalesce((x["price"] > 0) & (x["quantity"] > 0), F.lit(False)))
    return F.when(F.coalesce(F.size(levels), F.lit(0)) <= 0, "empty").when(bad, "not_positive").when(prices != F.sort_array(prices, not descending), "out_of_order").otherwise("ok")


def claim_failures(counts: DataFrame, keys: list[str], reasons: dict[str, str]) -> DataFrame:
    """``counts`` by keys with ``failures``: the reason of each count that isn't zero, and of each that is missing or negative."""
    def one(name: str, reason: str) -> Column:
        c = F.col(name)
        return F.when(c.isNull() | (c < 0), f"{name}_missing_or_invalid").when(c > 0, reason)

    return counts.select(*keys, F.array_join(F.array_compact(F.array(*[one(n, r) for n, r in reasons.items()])), ",").alias("failures"))


def row_estimate(size: Column, sampled_bytes: Column, n_sampled: Column) -> Column:
    """Rows of a file by the mean length of sampled lines; at least those sampled, null without a length."""
    mean = F.greatest(sampled_bytes / n_sampled, F.lit(1.0))
    return F.when(n_sampled == 0, F.lit(0).cast("long")).when(sampled_bytes.isNull(), None).otherwise(F.greatest(n_sampled.cast("long"), F.floor(size / mean).cast("long")))
