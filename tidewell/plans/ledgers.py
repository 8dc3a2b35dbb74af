"""Queries about grids, fees, lots and reconciliations, over ticks and the trade tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import ratio
from tidewell.operators import ledger, level_book
from tidewell.operators import timeseries as ts
from tidewell.plans.catalog import ORACLES, register
from tidewell.plans.ticks import TICKS, ticks


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@register("grid_levels", "SELECT p_partkey, i::INTEGER AS level, p_retailprice + 1.5::DOUBLE * i AS price FROM part, (SELECT unnest(range(0, 11)) AS i)")
def grid_levels(spark, d):
    """The levels of every part."""
    levels = ledger.grid_levels(F.col("p_retailprice"), F.col("p_retailprice") + 15.0, F.lit(10))
    return table(spark, d, "part").select("p_partkey", F.posexplode(levels).alias("level", "price"))


register("grid_levels_all", ORACLES["grid_levels"])(grid_levels)  # its former name


@register("nearest_level", TICKS + ", g AS (SELECT unnest(range(0, 11)) AS i), d AS (SELECT seq, price::DOUBLE AS price, i, abs(50.0 * i - price::DOUBLE) AS dist FROM t, g) SELECT seq, arg_min(i, dist * 1000 + i / 1000.0)::INTEGER AS level FROM d GROUP BY seq")
def nearest_level(spark, d):
    levels = F.array(*[F.lit(50.0 * i) for i in range(11)])
    return ticks(spark, d).select("seq", ledger.nearest_level(levels, F.col("price").cast("double")).alias("level"))


@register("level_touches", TICKS + ", c AS (SELECT product, (epoch_us(ts) // 3600000000) * 3600 AS bucket, max(price) AS high, min(price) AS low FROM t GROUP BY 1, 2), g AS (SELECT unnest(range(0, 11)) * 50 AS level) SELECT product, level::INTEGER AS level, count(*) AS n_touches FROM c, g WHERE low <= level AND level <= high GROUP BY product, level")
def level_touches(spark, d):
    c = ts.candles(ticks(spark, d), ["product"], "ts", "price", "size", ["seq"], 3600)
    grid = spark.range(11).select((F.col("id") * 50).cast("int").alias("level"))  # eleven rows
    return c.join(F.broadcast(grid), (F.col("low") <= F.col("level")) & (F.col("level") <= F.col("high"))).groupBy("product", "level").agg(F.count("*").alias("n_touches"))


FEES = TICKS + """, f AS (SELECT product, seq, (price * size)::DECIMAL(28,8) AS notional, CASE WHEN k % 2 = 0 THEN 0.004 ELSE 0.006 END::DECIMAL(8,4) AS rate FROM t),
g AS (SELECT product, seq, (notional * rate)::DECIMAL(28,8) AS gross FROM f), h AS (SELECT *, (gross * 0.25::DECIMAL(8,4))::DECIMAL(28,8) AS target FROM g),
c AS (SELECT *, sum(target) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM h),
r AS (SELECT product, seq, gross, least(cum, 500) - least(cum - target, 500) AS rebate FROM c)
"""


@register("fee_rebate_capped", FEES + "SELECT product, seq, gross::DOUBLE AS gross_fee, rebate::DOUBLE AS rebate, (gross - rebate)::DOUBLE AS net_fee FROM r")
def fee_rebate_capped(spark, d):
    f = ticks(spark, d).select("product", "seq", (F.col("price") * F.col("size")).cast("decimal(18,2)").alias("notional"), "k")
    rate = F.when(F.col("k") % 2 == 0, F.lit("0.0040").cast("decimal(8,4)")).otherwise(F.lit("0.0060").cast("decimal(8,4)"))
    q = ledger.fee_quotes(f, ["product"], "seq", "notional", rate, 0.25, 500.0)
    return q.select("product", "seq", *[F.col(c).cast("double").alias(c) for c in ("gross_fee", "rebate", "net_fee")])


@register("increments_rounding", TICKS + "SELECT seq, floor(price::DOUBLE / 0.5) * 0.5 AS floored, ceil(price::DOUBLE / 0.5) * 0.5 AS ceiled, (price * 100)::BIGINT % 50 = 0 AS aligned FROM t")
def increments_rounding(spark, d):
    p = F.col("price").cast("double")
    from tidewell.functions.scalars import ceil_to, floor_to

    half = F.lit(0.5)
    return ticks(spark, d).select("seq", floor_to(p, half).alias("floored"), ceil_to(p, half).alias("ceiled"), ((F.col("price") * 100).cast("long") % 50 == 0).alias("aligned"))


@register("plan_buy", TICKS + ", b AS (SELECT seq, price::DOUBLE AS p, floor((100.0 + lvl)::DOUBLE / (price::DOUBLE * (1 + 0.004::DOUBLE)) / 0.125) * 0.125 AS base FROM t) SELECT seq, base, base * p AS notional, base * p * 0.004::DOUBLE AS fee, base * p + base * p * 0.004::DOUBLE AS cost, base > 0 AND base * p >= 10 AS feasible FROM b")
def plan_buy(spark, d):
    budget = (F.lit("100.0").cast("decimal(4,1)") + F.col("lvl")).cast("double")  # added exactly and rounded once, as in SQL
    plan = ledger.plan_buy(F.col("price").cast("double"), budget, F.lit(0.004), F.lit(0.125), F.lit(10.0))
    return ticks(spark, d).withColumn("x", plan).select("seq", "x.*")


@register("plan_exit", TICKS + ", b AS (SELECT seq, price::DOUBLE AS p, size::DOUBLE AS base, price::DOUBLE * size * 0.97::DOUBLE AS cost FROM t), s AS (SELECT *, ceil(cost * (1 + 50.0::DOUBLE / 10000) / (p * (1 - 0.006::DOUBLE)) / 0.125) * 0.125 AS sell FROM b) SELECT seq, sell AS sell_base, base - sell AS reserve_base, sell * p * (1 - 0.006::DOUBLE) AS proceeds, sell <= base AS feasible FROM s")
def plan_exit(spark, d):
    p, base = F.col("price").cast("double"), F.col("size").cast("double")
    plan = ledger.plan_exit(p * F.col("size") * 0.97, base, p, F.lit(50.0), F.lit(0.006), F.lit(0.125))
    return ticks(spark, d).withColumn("x", plan).select("seq", "x.*")


@register("greedy_depth_consume", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem), p AS (SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c) SELECT l_orderkey, rn, l_quantity, greatest(0, least(l_quantity, 60 - prior))::DOUBLE AS consumed FROM p")
def greedy_depth_consume(spark, d):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    l = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long"))
    return level_book.greedy_consume(l, ["l_orderkey"], [F.col("rn")], "l_quantity", F.lit(60.0)).select("l_orderkey", "rn", "l_quantity", F.col("consumed").cast("double").alias("consumed"))


@register("bands_slots", "SELECT n_nationkey AS config, b::INTEGER AS band, l::INTEGER AS level, 10.0 + n_nationkey + b * 5.0 AS band_lower, 10.0 + n_nationkey + b * 5.0 + 5.0 AS band_upper, (10.0 + n_nationkey + b * 5.0 + 1.25 * l)::DOUBLE AS entry_price FROM nation, (SELECT unnest(range(0, 8)) AS b), (SELECT unnest(range(0, 4)) AS l)".replace("10.0 + n_nationkey + b * 5.0 AS band_lower", "(10.0 + n_nationkey + b * 5.0)::DOUBLE AS band_lower").replace("10.0 + n_nationkey + b * 5.0 + 5.0 AS band_upper", "(10.0 + n_nationkey + b * 5.0 + 5.0)::DOUBLE AS band_upper"))
def bands_slots(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("config"), (F.lit(10.0) + F.col("n_nationkey")).alias("lower"), (F.lit(50.0) + F.col("n_nationkey")).alias("upper"), F.lit(5.0).alias("band_width"), F.lit(4).alias("levels_per_band"))
    return ledger.bands_and_slots(c).select("config", "band", "level", "band_lower", "band_upper", "entry_price")


LOTS = "WITH lot AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag AS tranche, l_linestatus AS state, floor(l_extendedprice / 10000)::INTEGER AS band FROM lineitem) "


def lots(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", F.col("l_returnflag").alias("tranche"), F.col("l_linestatus").alias("state"), F.floor(F.col("l_extendedprice") / 10000).cast("int").alias("band"))


@register("band_rollup", LOTS + "SELECT band, count(*) FILTER (WHERE state = 'O') AS n_open, count(*) FILTER (WHERE state <> 'O') AS n_done, sum((CASE WHEN state = 'O' THEN l_quantity ELSE 0 END)::DECIMAL(18,2))::DOUBLE AS open_base, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS cost FROM lot GROUP BY band")
def band_rollup(spark, d):
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return lots(spark, d).groupBy("band").agg(F.count_if(F.col("state") == "O").alias("n_open"), F.count_if(F.col("state") != "O").alias("n_done"), F.sum(F.when(F.col("state") == "O", F.col("l_quantity")).otherwise(0).cast("decimal(18,2)")).cast("double").alias("open_base"), money.alias("cost"))


@register("tranche_cube", LOTS + "SELECT band, tranche, count(*) AS n_lots, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS cost FROM lot GROUP BY CUBE (band, tranche)")
def tranche_cube(spark, d):
    return lots(spark, d).cube("band", "tranche").agg(F.count("*").alias("n_lots"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("cost"))


@register("tranche_totals", LOTS + "SELECT tranche, count(*) AS n_lots, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS base, count(DISTINCT band) AS n_bands FROM lot GROUP BY ROLLUP (tranche)")
def tranche_totals(spark, d):
    return lots(spark, d).rollup("tranche").agg(F.count("*").alias("n_lots"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("base"), F.countDistinct("band").alias("n_bands"))


ENTRIES = TICKS + ", bars AS (SELECT product, (epoch_us(ts) // 3600000000) * 3600 AS bucket, arg_max(price, seq)::DOUBLE AS close FROM t GROUP BY 1, 2), lot AS (SELECT seq AS lot_id, product, (epoch_us(ts) // 3600000000) * 3600 AS entry_ts, price::DOUBLE AS entry_price FROM t WHERE k = 7) "


def entries(spark, d):
    t = ticks(spark, d)
    bars = ts.candles(t, ["product"], "ts", "price", "size", ["seq"], 3600).select("product", "bucket", F.col("close").cast("double").alias("close"))
    hour = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3600).cast("long")
    return t.where("k = 7").select(F.col("seq").alias("lot_id"), "product", hour.alias("entry_ts"), F.col("price").cast("double").alias("entry_price")), bars


@register("markouts", ENTRIES + ", n AS (SELECT max(bucket) AS now FROM bars), a AS (SELECT lot_id, product, entry_price, h AS horizon, entry_ts + h AS bucket FROM lot, (SELECT unnest([3600, 14400, 86400, 604800]) AS h)), f AS (SELECT a.*, b.bucket AS hit, b.close FROM a ASOF LEFT JOIN bars b ON a.product = b.product AND a.bucket <= b.bucket) SELECT lot_id, horizon::INTEGER AS horizon, CASE WHEN hit = bucket THEN 'exact' WHEN hit IS NOT NULL AND bucket <= now THEN 'delayed' ELSE 'censored' END AS status, close AS mark FROM f, n")
def markouts(spark, d):
    lot, bars = entries(spark, d)
    now = bars.agg(F.max("bucket").alias("now"))
    # one row: the end of the data
    m = ledger.markouts(lot.crossJoin(F.broadcast(now)), bars, [3600, 14400, 86400, 604800], F.col("now"))
    return m.select("lot_id", "horizon", "status", F.col("asof_mark").alias("mark"))


CLOSED = "WITH lot AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS entry_ts, CASE WHEN o_orderstatus = 'F' THEN (epoch(o_orderdate) + (o_orderkey % 60) * 86400)::BIGINT END AS exit_ts FROM orders), n AS (SELECT max(entry_ts) AS now FROM lot) "


def closed_lots(spark, d):
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    o = table(spark, d, "orders").select("o_orderkey", at.alias("entry_ts"), F.when(F.col("o_orderstatus") == "F", at + F.col("o_orderkey") % 60 * 86400).alias("exit_ts"))
    return o.crossJoin(F.broadcast(o.agg(F.max("entry_ts").alias("now"))))


@register("recovery_cohorts", CLOSED + ", h AS (SELECT unnest(['1d', '7d', '30d']) AS horizon, unnest([86400, 604800, 2592000]) AS seconds) SELECT horizon, CASE WHEN exit_ts - entry_ts <= seconds THEN 'recovered' WHEN now - entry_ts >= seconds THEN 'known_failure' ELSE 'right_censored' END AS status, count(*) AS n_lots FROM lot, n, h GROUP BY 1, 2")
def recovery_cohorts(spark, d):
    return ledger.recovery_cohorts(closed_lots(spark, d), {"1d": 86400, "7d": 604800, "30d": 2592000}, F.col("now"))


@register("mae_bps", ENTRIES + "SELECT lot_id, min(close) AS min_close, (min(close) / entry_price - 1) * 10000 AS mae_bps FROM lot JOIN bars ON lot.product = bars.product AND bars.bucket >= entry_ts AND bars.bucket < entry_ts + 86400 GROUP BY lot_id, entry_price")
def mae_bps(spark, d):
    lot, bars = entries(spark, d)
    # a lot meets the bars of its day and the next only: the range join runs on day keys
    day = lambda c: F.floor(c / 86400)
    asked = lot.withColumn("day", F.explode(F.array(day(F.col("entry_ts")), day(F.col("entry_ts")) + 1)))
    j = asked.join(bars.withColumn("day", day(F.col("bucket"))), ["product", "day"]).where("bucket >= entry_ts AND bucket < entry_ts + 86400")
    return j.groupBy("lot_id", "entry_price").agg(F.min("close").alias("min_close")).select("lot_id", "min_close", ((ratio(F.col("min_close"), F.col("entry_price")) - 1) * 10000).alias("mae_bps"))


@register("cash_cost_time", TICKS + ", s AS (SELECT product, (lead(epoch_us(ts)) OVER (PARTITION BY product ORDER BY seq) - epoch_us(ts)) * size AS area FROM t) SELECT product, sum(area)::BIGINT AS cost_seconds FROM s GROUP BY product")
def cash_cost_time(spark, d):
    t = ticks(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return ledger.cost_time(t, ["product"], "seq", "us", "size").select("product", F.col("cost_seconds").cast("long").alias("cost_seconds"))


@register("decimal_stats", TICKS + "SELECT product, count(*) AS n, avg(price::DOUBLE) AS mean, quantile_cont(price::DOUBLE, 0.5) AS median, min(price)::DOUBLE AS lo, max(price)::DOUBLE AS hi FROM t GROUP BY product".replace("avg(price::DOUBLE)", "sum(price)::DOUBLE / count(*)"))
def decimal_stats(spark, d):
    p = F.col("price").cast("double")
    return ticks(spark, d).groupBy("product").agg(F.count("*").alias("n"), (F.sum("price").cast("double") / F.count("*")).alias("mean"), F.percentile(p, 0.5).alias("median"), F.min(p).alias("lo"), F.max(p).alias("hi"))


@register("interval_gap_overlap", TICKS + ", g AS (SELECT product, ts AS gap_start, ts + INTERVAL 30 MINUTE AS gap_end FROM t WHERE k = 11) SELECT seq, product FROM t WHERE k = 7 AND EXISTS (SELECT 1 FROM g WHERE g.product = t.product AND gap_start < t.ts + INTERVAL 1 HOUR AND gap_end > t.ts)")
def interval_gap_overlap(spark, d):
    t = ticks(spark, d)
    gaps = t.where("k = 11").select("product", F.col("ts").alias("gap_start"), (F.col("ts") + F.expr("INTERVAL 30 MINUTE")).alias("gap_end"))
    return ts.overlaps(t.where("k = 7").withColumn("until", F.col("ts") + F.expr("INTERVAL 1 HOUR")), gaps, "product", "ts", "until").select("seq", "product")
