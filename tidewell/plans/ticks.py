"""Queries over a tick stream made of the ``events`` table.

Ticks: the product is the event type, the sequence the event id; price,
size, side, level and level quantity derive from value, props and user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import book_fold, level_book
from tidewell.operators import timeseries as ts
from tidewell.plans.catalog import register
from tidewell.session import ship

TICKS = """WITH ticks AS (SELECT event_id AS seq, ts, event_type AS product, CAST(value AS DECIMAL(18,2)) AS price, user_id AS lvl,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
t AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, k + 1 AS size, k % 4 AS qty FROM ticks)
"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick view."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("product"),
        F.col("value").cast("decimal(18,2)").alias("price"),
        F.col("user_id").alias("lvl"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return rows.withColumns({"side": F.when(F.col("k") % 2 == 0, "buy").otherwise("sell"), "size": F.col("k") + 1, "qty": F.col("k") % 4})


def _double(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


@register("tick_projection", TICKS + "SELECT seq, product, upper(product) AS product_id, price::DOUBLE AS price, side, size::INTEGER AS size FROM t")
def tick_projection(spark, d):
    return ticks(spark, d).select("seq", "product", F.upper("product").alias("product_id"), *_double("price"), "side", "size")


@register("json_extract_props", "SELECT event_id, json_extract_string(props, '$.k') AS k_text, len(json_keys(props))::INTEGER AS n_keys FROM events")
def json_extract_props(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k_text"), F.size(F.json_object_keys("props")).alias("n_keys"))


@register("canonical_timestamp", "SELECT event_id, epoch_us(ts) * 1000 AS ts_epoch_ns, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS ts_text FROM events")
def canonical_timestamp(spark, d):
    from tidewell.functions.scalars import ns_text

    e = spark.read.parquet(f"{d}/events.parquet")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select("event_id", ns.alias("ts_epoch_ns"), ns_text(ns).alias("ts_text"))


@register("strict_filter_window", TICKS + ", b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM t) SELECT seq, product, price::DOUBLE AS price FROM t, b WHERE ts >= lo + INTERVAL 1 HOUR AND ts < hi - INTERVAL 1 HOUR AND product IN ('click', 'view', 'purchase')")
def strict_filter_window(spark, d):
    t = ticks(spark, d)
    b = t.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return t.join(F.broadcast(b), (F.col("ts") >= F.col("lo") + F.expr("INTERVAL 1 HOUR")) & (F.col("ts") < F.col("hi") - F.expr("INTERVAL 1 HOUR"))).where(F.col("product").isin("click", "view", "purchase")).select("seq", "product", *_double("price"))


QUARANTINE = ", q AS (SELECT *, CASE WHEN k IS NULL THEN 'missing_k' WHEN price < 50 THEN 'price_too_low' WHEN lvl % 10 = 0 THEN 'invalid_level' END AS reason FROM t) "


def quarantined(t: DataFrame) -> DataFrame:
    """Ticks with the first reason that keeps them out, if any."""
    return t.withColumn("reason", F.when(F.col("k").isNull(), "missing_k").when(F.col("price") < 50, "price_too_low").when(F.col("lvl") % 10 == 0, "invalid_level"))


@register("quarantine_split", TICKS + QUARANTINE + "SELECT seq, product, reason FROM q WHERE reason IS NOT NULL")
def quarantine_split(spark, d):
    return quarantined(ticks(spark, d)).where("reason IS NOT NULL").select("seq", "product", "reason")


@register("quarantine_counts", TICKS + QUARANTINE + "SELECT product, count(*) AS n_rows, count(*) FILTER (WHERE reason IS NULL) AS n_accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS n_quarantined, count(*) - count(*) FILTER (WHERE reason IS NULL) - count(*) FILTER (WHERE reason IS NOT NULL) AS imbalance FROM q GROUP BY product")
def quarantine_counts(spark, d):
    q = quarantined(ticks(spark, d)).groupBy("product").agg(F.count("*").alias("n_rows"), F.count_if(F.col("reason").isNull()).alias("n_accepted"), F.count_if(F.col("reason").isNotNull()).alias("n_quarantined"))
    return q.withColumn("imbalance", F.col("n_rows") - F.col("n_accepted") - F.col("n_quarantined"))


@register("null_rates", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE props IS NULL) AS null_props, count(*) FILTER (WHERE value IS NULL) AS null_value, (count(*) FILTER (WHERE value > 250 OR value IS NULL))::DOUBLE / count(*)::DOUBLE AS rate_high FROM events")
def null_rates(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.agg(F.count("*").alias("n_rows"), F.count_if(F.col("props").isNull()).alias("null_props"), F.count_if(F.col("value").isNull()).alias("null_value"), (F.count_if((F.col("value") > 250) | F.col("value").isNull()).cast("double") / F.count("*").cast("double")).alias("rate_high"))


@register("time_coverage_sets", TICKS + "SELECT product, side, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(seq, ts) AS first_seq, arg_max(seq, ts) AS last_seq FROM t GROUP BY GROUPING SETS ((product), (side), ())")
def time_coverage_sets(spark, d):
    t = ticks(spark, d)
    return t.groupingSets([[F.col("product")], [F.col("side")], []], F.col("product"), F.col("side")).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("seq", "ts").alias("first_seq"), F.max_by("seq", "ts").alias("last_seq"))


#: Bin edges of latencies, in milliseconds (fixed values).
LATENCY_BOUNDS = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 300.0, 400.0, 500.0]
_BOUNDS = "[" + ", ".join(map(str, LATENCY_BOUNDS)) + "]"
_BINS = f"b AS (SELECT event_type AS product, len(list_filter({_BOUNDS}::DOUBLE[], lambda x: x <= value))::INTEGER AS bin, value FROM events)"


@register("latency_histogram", f"WITH {_BINS} SELECT product, bin, count(*) AS n, min(value) AS lo, max(value) AS hi FROM b GROUP BY product, bin")
def latency_histogram(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "product")
    return ts.histogram(e, "value", LATENCY_BOUNDS).groupBy("product", "bin").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@register("latency_histogram_closed", f"SELECT len(list_filter({_BOUNDS}::DOUBLE[], lambda x: x < value))::INTEGER AS bin, count(*) AS n FROM events GROUP BY bin")
def latency_histogram_closed(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return ts.histogram(e, "value", LATENCY_BOUNDS, upper_inclusive=True).groupBy("bin").agg(F.count("*").alias("n"))


@register("latency_quantile_bound", f"WITH b AS (SELECT len(list_filter({_BOUNDS}::DOUBLE[], lambda x: x < value))::INTEGER AS bin, count(*) AS n FROM events GROUP BY bin), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM b), q AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q) SELECT q, min(coalesce(list_extract({_BOUNDS}::DOUBLE[], bin + 1), 'inf'::DOUBLE)) AS upper_bound FROM c, q WHERE cum >= ceil(total * q) GROUP BY q")
def latency_quantile_bound(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    bins = ts.histogram(e, "value", LATENCY_BOUNDS, upper_inclusive=True).groupBy("bin").agg(F.count("*").alias("n"))
    out = None
    for q in (0.5, 0.95, 0.99):
        row = ts.histogram_quantile(bins, "bin", "n", q, LATENCY_BOUNDS).select(F.lit(q).alias("q"), "upper_bound")
        out = row if out is None else out.unionByName(row)
    return out


@register("ohlcv_candles", TICKS + "SELECT product, (epoch_us(ts) // 3600000000) * 3600 AS bucket, arg_min(price, seq)::DOUBLE AS open, max(price)::DOUBLE AS high, min(price)::DOUBLE AS low, arg_max(price, seq)::DOUBLE AS close, sum(size)::BIGINT AS volume, count(*) AS n_ticks FROM t GROUP BY 1, 2")
def ohlcv_candles(spark, d):
    c = ts.candles(ticks(spark, d), ["product"], "ts", "price", "size", ["seq"], 3600)
    return c.select("product", "bucket", *_double("open", "high", "low", "close"), F.col("volume").cast("long").alias("volume"), "n_ticks")


@register("candle_missing_grid", TICKS + ", c AS (SELECT DISTINCT product, (epoch_us(ts) // 600000000) * 600 AS bucket FROM t), g AS (SELECT product, unnest(generate_series(min(bucket), max(bucket), 600)) AS bucket FROM c GROUP BY product) SELECT g.product, g.bucket FROM g ANTI JOIN c ON g.product = c.product AND g.bucket = c.bucket")
def candle_missing_grid(spark, d):
    return ts.missing_buckets(ts.candles(ticks(spark, d), ["product"], "ts", "price", "size", ["seq"], 600), ["product"], 600).select("product", "bucket")


INTERVALS = TICKS + """, iv AS (SELECT product, ts AS s, ts + INTERVAL 60 SECOND AS e FROM t),
r AS (SELECT *, max(e) OVER (PARTITION BY product ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
m AS (SELECT *, sum(CASE WHEN reach IS NULL OR epoch_us(s) > epoch_us(reach) + 120000000 THEN 1 ELSE 0 END) OVER (PARTITION BY product ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM r),
isl AS (SELECT product, island, min(s) AS island_start, max(e) AS island_end, count(*) AS n_intervals FROM m GROUP BY product, island),
gap AS (SELECT product, lag(island_end) OVER (PARTITION BY product ORDER BY island) AS gap_start, island_start AS gap_end FROM isl),
gaps AS (SELECT product, gap_start, gap_end, (epoch_us(gap_end) - epoch_us(gap_start))::DOUBLE / 1000000 AS gap_seconds FROM gap WHERE gap_start IS NOT NULL)
"""


def islands(spark, d) -> DataFrame:
    """Each tick covers a minute; up to two more minutes without one are no gap."""
    iv = ticks(spark, d).select("product", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 60 SECOND")).alias("e"))
    return ts.merge_intervals(iv, ["product"], "s", "e", 120)


@register("gap_islands", INTERVALS + "SELECT * FROM isl")
def gap_islands(spark, d):
    return islands(spark, d)


@register("gap_summary", INTERVALS + "SELECT product, count(*) AS n_gaps, sum(gap_seconds) AS total_seconds, max(gap_seconds) AS largest_seconds, min(gap_start) AS first_gap, max(gap_end) AS last_gap FROM gaps GROUP BY product")
def gap_summary(spark, d):
    return ts.interval_gaps(islands(spark, d), ["product"]).groupBy("product").agg(F.count("*").alias("n_gaps"), F.sum("gap_seconds").alias("total_seconds"), F.max("gap_seconds").alias("largest_seconds"), F.min("gap_start").alias("first_gap"), F.max("gap_end").alias("last_gap"))


@register("topk_gaps", INTERVALS + ", cap AS (SELECT *, row_number() OVER (ORDER BY product, gap_start) AS rn FROM gaps) SELECT product, gap_start, gap_end, gap_seconds FROM cap WHERE rn <= 50 ORDER BY gap_seconds DESC, product, gap_start LIMIT 10")
def topk_gaps(spark, d):
    found = ts.interval_gaps(islands(spark, d), ["product"])
    return found.orderBy("product", "gap_start").limit(50).orderBy(F.desc("gap_seconds"), "product", "gap_start").limit(10)


KEPT = TICKS + ", f AS (SELECT * FROM t WHERE seq % 7 <> 3 AND seq % 11 <> 5) "


@register("seq_gap_audit", KEPT + ", a AS (SELECT product, seq, lag(seq) OVER (PARTITION BY k % 3 ORDER BY seq) AS p, k % 3 AS stream FROM f) SELECT stream, count(*) AS n_rows, count(*) FILTER (WHERE seq > p + 1) AS n_gaps, coalesce(sum(seq - p - 1) FILTER (WHERE seq > p + 1), 0)::BIGINT AS missing FROM a GROUP BY stream")
def seq_gap_audit(spark, d):
    f = ticks(spark, d).where("seq % 7 <> 3 AND seq % 11 <> 5").withColumn("stream", F.col("k") % 3)
    return ts.sequence_audit(f, ["stream"], "seq", [F.col("seq")]).groupBy("stream").agg(F.count("*").alias("n_rows"), F.count_if(F.col("missing") > 0).alias("n_gaps"), F.sum("missing").alias("missing"))


SHAKEN = TICKS + ", f AS (SELECT product, seq, k, ts, (seq % 400) * 10 + (k % 5) AS num FROM t) "


@register("epoch_inference", SHAKEN + ", e AS (SELECT product, seq, num, CASE WHEN num < lag(num) OVER (PARTITION BY product ORDER BY seq) THEN 1 ELSE 0 END AS back FROM f), g AS (SELECT *, sum(back) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) + 1 AS epoch FROM e) SELECT product, epoch::BIGINT AS epoch, count(*) AS n_rows, min(num) AS lo, max(num) AS hi FROM g GROUP BY product, epoch")
def epoch_inference(spark, d):
    f = ticks(spark, d).withColumn("num", (F.col("seq") % 400) * 10 + F.col("k") % 5)
    return ts.infer_epochs(f, ["product"], "num", [F.col("seq")]).groupBy("product", "epoch").agg(F.count("*").alias("n_rows"), F.min("num").alias("lo"), F.max("num").alias("hi"))


@register("seq_high_water_audit", SHAKEN + ", e AS (SELECT product, num, max(num) OVER (PARTITION BY product ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM f) SELECT product, count(*) FILTER (WHERE num < high) AS n_regressed, count(*) FILTER (WHERE num > high + 1) AS n_gaps, sum(CASE WHEN high IS NULL THEN greatest(num, 0) WHEN num > high + 1 THEN num - high - 1 ELSE 0 END)::BIGINT AS missing FROM e GROUP BY product")
def seq_high_water_audit(spark, d):
    f = ticks(spark, d).withColumn("num", (F.col("seq") % 400) * 10 + F.col("k") % 5)
    a = ts.high_water_audit(f, ["product"], "num", [F.col("seq")])
    return a.groupBy("product").agg(F.count_if(F.col("regressed")).alias("n_regressed"), F.count_if(F.col("num") > F.col("high_seq") + 1).alias("n_gaps"), F.sum("gap_size").alias("missing"))


@register("frame_ordinals", "SELECT conv_id, count(*) AS n_rows, sum(CASE WHEN turn = rn THEN 0 ELSE 1 END)::BIGINT AS n_defects FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations WHERE turn <> 2) GROUP BY conv_id")
def frame_ordinals(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("turn <> 2")
    return ts.contiguous_ordinals(c, ["conv_id"], "turn", base=0)


@register("heartbeat_intervals", TICKS + ", h AS (SELECT product, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY product ORDER BY seq) AS us FROM t) SELECT product, count(*) AS n_beats, max(us) AS max_us, count(*) FILTER (WHERE us > 600000000) AS n_stale, count(*) FILTER (WHERE us < 0) AS n_regressed FROM h GROUP BY product")
def heartbeat_intervals(spark, d):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    h = ticks(spark, d).withColumn("us", us - F.lag(us).over(Window.partitionBy("product").orderBy("seq")))
    return h.groupBy("product").agg(F.count("*").alias("n_beats"), F.max("us").alias("max_us"), F.count_if(F.col("us") > 600_000_000).alias("n_stale"), F.count_if(F.col("us") < 0).alias("n_regressed"))


@register("rolling_trade_imbalance", TICKS + ", r AS (SELECT product, seq, sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) OVER w AS b, sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) OVER w AS s FROM t WINDOW w AS (PARTITION BY product ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT product, seq, b::BIGINT AS buy_volume, s::BIGINT AS sell_volume, CASE WHEN b + s <> 0 THEN (b - s)::DOUBLE / (b + s)::DOUBLE END AS imbalance FROM r")
def rolling_trade_imbalance(spark, d):
    return ts.trade_imbalance(ticks(spark, d), ["product"], ["seq"], 100).select("product", "seq", "buy_volume", "sell_volume", "imbalance")


LEVELS = TICKS + ", a AS (SELECT product, seq, lvl, qty, coalesce(lag(qty) OVER (PARTITION BY product, lvl ORDER BY seq), 0) AS prev FROM t), b AS (SELECT *, CASE WHEN qty > 0 AND prev > 0 THEN 'replace' WHEN qty > 0 THEN 'add' WHEN prev > 0 THEN 'delete' ELSE 'missing_delete' END AS action FROM a) "


@register("book_level_actions", LEVELS + "SELECT product, seq, lvl, action FROM b")
def book_level_actions(spark, d):
    return level_book.level_actions(ticks(spark, d), ["product"], ["lvl"], "seq").select("product", "seq", "lvl", "action")


@register("book_running_depth", LEVELS + "SELECT product, seq, sum(qty - prev) OVER w::BIGINT AS depth, sum(CASE action WHEN 'add' THEN 1 WHEN 'delete' THEN -1 ELSE 0 END) OVER w::BIGINT AS live_levels FROM b WINDOW w AS (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def book_running_depth(spark, d):
    return level_book.running_depth(ticks(spark, d), ["product"], ["lvl"], "seq").select("product", "seq", F.col("depth").cast("long").alias("depth"), F.col("live_levels").cast("long").alias("live_levels"))


@register("set_xor", LEVELS + ", l AS (SELECT product, seq, CASE WHEN prev > 0 THEN ('0x' || substr(sha256(concat_ws('|', lvl, prev)), 1, 15))::BIGINT ELSE 0 END AS x, CASE WHEN qty > 0 THEN ('0x' || substr(sha256(concat_ws('|', lvl, qty)), 1, 15))::BIGINT ELSE 0 END AS y FROM b) SELECT product, seq, bit_xor(xor(x, y)) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) AS fingerprint FROM l")
def set_xor(spark, d):
    return level_book.running_fingerprint(ticks(spark, d), ["product"], ["lvl"], "seq").select("product", "seq", "fingerprint")


BOOK = TICKS + """, u AS (SELECT product, seq, CASE WHEN lvl < 75 THEN 'bid' ELSE 'ask' END AS side, lvl AS price, qty FROM t),
iv AS (SELECT *, lead(seq) OVER (PARTITION BY product, side, price ORDER BY seq) AS until FROM u),
live AS (SELECT p.product, p.seq, iv.side, iv.price, iv.qty FROM u p JOIN iv ON iv.product = p.product AND iv.seq <= p.seq AND (iv.until IS NULL OR iv.until > p.seq) AND iv.qty > 0)
"""


def updates(spark, d) -> DataFrame:
    """Level updates: prices below 75 are bids, others asks."""
    return ticks(spark, d).select("product", "seq", F.when(F.col("lvl") < 75, "bid").otherwise("ask").alias("side"), F.col("lvl").alias("price"), "qty")


@register("book_bbo", BOOK + ", g AS (SELECT product, seq, max(price) FILTER (WHERE side = 'bid')::DOUBLE AS best_bid, min(price) FILTER (WHERE side = 'ask')::DOUBLE AS best_ask, coalesce(sum(qty) FILTER (WHERE side = 'bid'), 0)::BIGINT AS bid_depth, coalesce(sum(qty) FILTER (WHERE side = 'ask'), 0)::BIGINT AS ask_depth FROM live GROUP BY product, seq) SELECT u.product, u.seq, best_bid, best_ask, coalesce(bid_depth, 0)::BIGINT AS bid_depth, coalesce(ask_depth, 0)::BIGINT AS ask_depth, (best_bid + best_ask) / 2 AS midpoint, best_ask - best_bid AS spread FROM u LEFT JOIN g ON g.product = u.product AND g.seq = u.seq")
def book_bbo(spark, d):
    ship(spark)
    return book_fold.fold_bbo(updates(spark, d)).withColumn("midpoint", (F.col("best_bid") + F.col("best_ask")) / 2).withColumn("spread", F.col("best_ask") - F.col("best_bid"))


TOP = ", fin AS (SELECT product, side, price, arg_max(qty, seq) AS qty FROM u GROUP BY product, side, price HAVING arg_max(qty, seq) > 0), rk AS (SELECT *, row_number() OVER (PARTITION BY product, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM fin) "


def final_levels(spark, d) -> DataFrame:
    """Live levels after the last update, as arrays per product and side."""
    last = updates(spark, d).groupBy("product", "side", "price").agg(F.max_by("qty", "seq").alias("qty")).where("qty > 0")
    return last.groupBy("product", "side").agg(F.collect_list(F.struct("price", "qty")).alias("levels"))


@register("book_topn", BOOK + TOP + "SELECT product, side, level::INTEGER AS level, price, qty::INTEGER AS qty FROM rk WHERE level <= 10")
def book_topn(spark, d):
    top = final_levels(spark, d).withColumn("top", F.when(F.col("side") == "bid", level_book.top_levels(F.col("levels"), 10, True)).otherwise(level_book.top_levels(F.col("levels"), 10, False)))
    return top.select("product", "side", F.posexplode("top").alias("pos", "x")).select("product", "side", (F.col("pos") + 1).alias("level"), F.col("x.price").alias("price"), F.col("x.qty").alias("qty"))


@register("book_imbalance", BOOK + TOP + ", s AS (SELECT product, coalesce(sum(qty) FILTER (WHERE side = 'bid'), 0) AS b, coalesce(sum(qty) FILTER (WHERE side = 'ask'), 0) AS a FROM rk WHERE level <= 10 GROUP BY product) SELECT product, b::BIGINT AS bid_depth, a::BIGINT AS ask_depth, (b - a)::DOUBLE / (b + a)::DOUBLE AS imbalance FROM s")
def book_imbalance(spark, d):
    top = final_levels(spark, d).withColumn("depth", F.aggregate(level_book.top_levels(F.col("levels"), 10, False), F.lit(0).cast("long"), lambda a, x: a + x["qty"]))
    top = top.withColumn("depth", F.when(F.col("side") == "bid", F.aggregate(level_book.top_levels(F.col("levels"), 10, True), F.lit(0).cast("long"), lambda a, x: a + x["qty"])).otherwise(F.col("depth")))
    s = top.groupBy("product").agg(F.coalesce(F.sum(F.when(F.col("side") == "bid", F.col("depth"))), F.lit(0)).alias("bid_depth"), F.coalesce(F.sum(F.when(F.col("side") == "ask", F.col("depth"))), F.lit(0)).alias("ask_depth"))
    return s.withColumn("imbalance", (F.col("bid_depth") - F.col("ask_depth")).cast("double") / (F.col("bid_depth") + F.col("ask_depth")).cast("double"))


WINDOWS = TICKS + """, f AS (SELECT product, seq, k, k % 20 = 0 AS snap, k % 20 = 7 AS bad FROM t),
g AS (SELECT *, sum(CASE WHEN snap AND NOT bad THEN 1 ELSE 0 END) OVER w AS window_id, max(CASE WHEN snap AND NOT bad THEN seq END) OVER w AS lo, max(CASE WHEN bad THEN seq END) OVER w AS ld FROM f WINDOW w AS (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING)),
v AS (SELECT product, seq, k, snap, window_id::BIGINT AS window_id, coalesce(lo IS NOT NULL AND (ld IS NULL OR lo > ld), false) AS valid FROM g)
"""


def windows(spark, d) -> DataFrame:
    return level_book.validity_windows(ticks(spark, d), ["product"], "seq", F.col("k") % 20 == 0, F.col("k") % 20 == 7)


@register("book_windows", WINDOWS + "SELECT product, window_id, count(*) AS n_states, min(seq) AS first_seq, max(seq) AS last_seq FROM v WHERE valid GROUP BY product, window_id")
def book_windows(spark, d):
    return windows(spark, d).where("valid").groupBy("product", "window_id").agg(F.count("*").alias("n_states"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@register("emit_every_n", WINDOWS + ", e AS (SELECT *, sum(CASE WHEN snap THEN 1 ELSE 0 END) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grp FROM v WHERE valid), i AS (SELECT *, sum(CASE WHEN snap THEN 0 ELSE 1 END) OVER (PARTITION BY product, grp ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT product, seq, window_id FROM i WHERE snap OR n % 3 = 0")
def emit_every_n(spark, d):
    return ts.every_nth(windows(spark, d).where("valid"), ["product"], [F.col("seq")], 3, F.col("k") % 20 == 0).select("product", "seq", "window_id")


@register("ticker_vs_book_asof", TICKS + ", l AS (SELECT product, seq, price FROM t WHERE k % 3 = 0), r AS (SELECT product, seq, price AS ref FROM t WHERE k % 3 = 1) SELECT l.product, l.seq, r.seq AS asof_seq, r.ref::DOUBLE AS asof_ref, abs(l.price - r.ref)::DOUBLE <= 5 AS within FROM l ASOF LEFT JOIN r ON l.product = r.product AND l.seq >= r.seq")
def ticker_vs_book_asof(spark, d):
    t = ticks(spark, d)
    left, right = t.where("k % 3 = 0").select("product", "seq", "price"), t.where("k % 3 = 1").select("product", "seq", F.col("price").alias("ref"))
    return ts.asof_join(left, right, ["product"], "seq", ["ref"]).select("product", "seq", "asof_seq", *_double("asof_ref"), (F.abs(F.col("price") - F.col("asof_ref")).cast("double") <= 5).alias("within"))


@register("drawdown_curve", TICKS + ", q AS (SELECT product, seq, sum(CASE WHEN side = 'buy' THEN size ELSE -size END) OVER w::BIGINT AS equity FROM t WINDOW w AS (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, max(equity) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM q) SELECT product, seq, equity, peak, peak - equity AS drawdown, max(peak - equity) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) AS max_drawdown FROM p")
def drawdown_curve(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("product").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    q = ticks(spark, d).withColumn("equity", F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))).over(w))
    return ts.drawdown(q, ["product"], ["seq"], "equity").select("product", "seq", "equity", "peak", "drawdown", "max_drawdown")


@register("ema_cross_guard", TICKS + ", c AS (SELECT product, (epoch_us(ts) // 3600000000) * 3600 AS bucket, arg_max(price, seq)::DOUBLE AS close FROM t GROUP BY 1, 2), l AS (SELECT product, list(close ORDER BY bucket) AS xs FROM c GROUP BY product), e AS (SELECT product, list_reduce(xs, lambda a, x: (2.0::DOUBLE / 13) * x + (1 - 2.0::DOUBLE / 13) * a) AS fast, list_reduce(xs, lambda a, x: (2.0::DOUBLE / 27) * x + (1 - 2.0::DOUBLE / 27) * a) AS slow, len(xs) AS n FROM l) SELECT product, fast, slow, n, CASE WHEN n < 26 THEN 'warmup' WHEN fast >= slow THEN 'allowed' ELSE 'downtrend' END AS status FROM e")
def ema_cross_guard(spark, d):
    c = ts.candles(ticks(spark, d), ["product"], "ts", "price", "size", ["seq"], 3600)
    fast = ts.ema(c, ["product"], "bucket", "close", 12).withColumnRenamed("ema", "fast")
    slow = ts.ema(c, ["product"], "bucket", "close", 26).select("product", F.col("ema").alias("slow"))
    e = fast.join(slow, "product")
    return e.select("product", "fast", "slow", "n", F.when(F.col("n") < 26, "warmup").when(F.col("fast") >= F.col("slow"), "allowed").otherwise("downtrend").alias("status"))
