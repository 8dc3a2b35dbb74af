"""Fees, grid levels, sizing and lot diagnostics, as expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import ceil_to, floor_to, ratio


def fee_quotes(fills: DataFrame, keys: list[str], order: str, notional: str, rate: Column, rebate_rate: float, cap: float, used: float = 0.0) -> DataFrame:
    """gross_fee, rebate and net_fee of each fill; the rebates of a key together never exceed what is left of the cap.

    Targets are not negative, so the capped running sum is the smaller of the
    plain running sum and the room, and a fill's rebate is its step.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    room = F.lit(max(0.0, cap - used)).cast("decimal(28,8)")
    rows = fills.withColumn("gross_fee", (F.col(notional) * rate).cast("decimal(28,8)")).withColumn("_target", (F.col("gross_fee") * F.lit(rebate_rate).cast("decimal(8,4)")).cast("decimal(28,8)"))
    rows = rows.withColumn("_cum", F.sum("_target").over(w))
    rows = rows.withColumn("rebate", F.least(F.col("_cum"), room) - F.least(F.col("_cum") - F.col("_target"), room))
    return rows.withColumn("net_fee", F.col("gross_fee") - F.col("rebate")).drop("_target", "_cum")


def grid_levels(lower: Column, upper: Column, count: Column) -> Column:
    """The count + 1 prices of an arithmetic grid."""
    return F.transform(F.sequence(F.lit(0), count), lambda i: lower + (upper - lower) / count * i)


def nearest_level(levels: Column, price: Column) -> Column:
    """Index of the level nearest to the price; of equally near ones the lower."""
    near = F.transform(levels, lambda p, i: F.struct(F.abs(p - price).alias("d"), i.alias("i")))
    return F.array_min(near)["i"]


def plan_buy(price: Column, budget: Column, fee_rate: Column, increment: Column, least_notional: Column) -> Column:
    """struct(base, notional, fee, cost, feasible): what an all-in budget buys at a price, floored to the increment.

    At a price of zero the base is infinite and what follows from it NaN, as in SQL.
    """
    base = floor_to(ratio(budget, price * (1 + fee_rate)), increment)
    notional = base * price
    fee = notional * fee_rate
    return F.struct(base.alias("base"), notional.alias("notional"), fee.alias("fee"), (notional + fee).alias("cost"), ((base > 0) & (notional >= least_notional)).alias("feasible"))


def plan_exit(cost: Column, base: Column, target: Column, profit_bps: Column, fee_rate: Column, increment: Column) -> Column:
    """struct(sell_base, reserve_base, proceeds, feasible): the least sale at the target that brings cost and profit back.

    At a target of zero no sale does: it is infinite, or NaN where nothing has to come back.
    """
    need = cost * (1 + profit_bps / 10000)
    sell = ceil_to(ratio(need, target * (1 - fee_rate)), increment)
    return F.struct(sell.alias("sell_base"), (base - sell).alias("reserve_base"), (sell * target * (1 - fee_rate)).alias("proceeds"), (sell <= base).alias("feasible"))


def bands_and_slots(config: DataFrame) -> DataFrame:
    """One row per slot of configs with lower, upper, band_width, levels_per_band: bands [lower, upper) in steps, levels evenly inside."""
    bands = config.withColumn("band", F.explode(F.sequence(F.lit(0), ((F.col("upper") - F.col("lower")) / F.col("band_width")).cast("int") - 1)))
    bands = bands.withColumn("band_lower", F.col("lower") + F.col("band") * F.col("band_width")).withColumn("band_upper", F.col("band_lower") + F.col("band_width"))
    slots = bands.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels_per_band") - 1)))
    return slots.withColumn("entry_price", F.col("band_lower") + F.col("band_width") / F.col("levels_per_band") * F.col("level"))


def markouts(lots: DataFrame, bars: DataFrame, horizons: list[int], now: Column) -> DataFrame:
    """Each lot's close at its entry plus each horizon: exact, delayed (a later bar stands in) or censored.

    ``lots``: lot_id, product, entry_ts (seconds), entry_price; ``bars``:
    product, bucket, close.  Markouts of a lot that cost nothing are infinite or NaN.
    """
    from .timeseries import asof_join

    asked = lots.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("bucket", (F.col("entry_ts") + F.col("horizon")).cast("long"))
    found = asof_join(asked, bars.select("product", "bucket", F.col("close").alias("mark")), ["product"], "bucket", ["mark"], forward=True)
    status = F.when(F.col("asof_bucket") == F.col("bucket"), "exact").when(F.col("asof_bucket").isNotNull() & (F.col("bucket") <= now), "delayed").otherwise("censored")
    return found.withColumn("status", status).withColumn("markout_bps", F.when(status != "censored", (ratio(F.col("asof_mark"), F.col("entry_price")) - 1) * 10000))


def recovery_cohorts(lots: DataFrame, horizons: dict[str, int], now: Column) -> DataFrame:
    """Lots by horizon and status: recovered in time, known_failure, right_censored.

    ``lots``: entry_ts and exit_ts in seconds, exit_ts null while open;
    ``now`` may be a column of it.
    """
    every = lots.select("*", F.explode(F.map_from_arrays(F.array(*map(F.lit, horizons)), F.array(*map(F.lit, horizons.values())))).alias("horizon", "seconds"))
    took = F.col("exit_ts") - F.col("entry_ts")
    status = F.when(took <= F.col("seconds"), "recovered").when((now - F.col("entry_ts")) >= F.col("seconds"), "known_failure").otherwise("right_censored")
    return every.withColumn("status", status).groupBy("horizon", "status").agg(F.count("*").alias("n_lots"))


def cost_time(events: DataFrame, keys: list[str], order: str, ts: str, cost: str) -> DataFrame:
    """Integral of the active cost over time (cost times seconds)."""
    step = F.lead(ts).over(Window.partitionBy(*keys).orderBy(order)) - F.col(ts)
    return events.withColumn("_area", F.col(cost) * step).groupBy(*keys).agg(F.sum("_area").alias("cost_seconds"))
