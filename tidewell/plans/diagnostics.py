"""Queries of the diagnostics, over ticks, replayed books and the trade tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as S
from tidewell.operators import diagnostics, ledger
from tidewell.operators import timeseries as ts
from tidewell.plans.captures import BOOK, replayed
from tidewell.plans.catalog import register
from tidewell.plans.ledgers import table
from tidewell.plans.ticks import TICKS, ticks

#: Seconds of a bar; at these sizes some products have gaps between bars.
BAR = 7200
HORIZONS = {"7d": 604800, "14d": 1209600, "28d": 2419200}
MARKS = [3600, 21600, 86400, 604800]

# Every tick is a lot that enters at its bar; two of three leave after 0 to 39 days, unless the bars end before.
LOTS = TICKS + f""", bars AS (SELECT product, epoch_us(ts) // {BAR}000000 * {BAR} AS bucket, arg_max(price, seq)::DOUBLE AS close FROM t GROUP BY 1, 2),
last AS (SELECT product, max(bucket) AS final FROM bars GROUP BY product),
held AS (SELECT seq AS lot_id, t.product, epoch_us(ts) // {BAR}000000 * {BAR} AS entry_ts, price::DOUBLE AS entry_price, final, epoch_us(ts) // {BAR}000000 * {BAR} + seq % 40 * 86400 AS leaves FROM t JOIN last ON t.product = last.product),
lot AS (SELECT lot_id, product, entry_ts, entry_price, final, CASE WHEN lot_id % 3 <> 0 AND leaves <= final THEN leaves END AS exit_ts FROM held),
step AS (SELECT product, bucket AS gap_start, lead(bucket) OVER (PARTITION BY product ORDER BY bucket) AS gap_end FROM bars),
gaps AS (SELECT product, gap_start, gap_end, gap_end - gap_start AS gap_seconds FROM step WHERE gap_end - gap_start > {BAR * 3 // 2}),
edge AS (SELECT lot.*, EXISTS (SELECT 1 FROM gaps g WHERE g.product = lot.product AND g.gap_end = entry_ts) AS at_gap_end FROM lot)
"""
_STATUS = f"""{LOTS}, d AS (SELECT edge.*, horizon, entry_ts + seconds AS deadline FROM edge, (SELECT unnest({list(HORIZONS)}) AS horizon, unnest({list(HORIZONS.values())}) AS seconds)),
e AS (SELECT d.*, at_gap_end OR EXISTS (SELECT 1 FROM gaps g WHERE g.product = d.product AND gap_start < deadline AND gap_end > entry_ts) AS gap FROM d),
s AS (SELECT lot_id, horizon, final >= deadline AND NOT gap AS eligible, CASE WHEN exit_ts <= deadline THEN 'recovered' WHEN final < deadline THEN 'right_censored' WHEN gap THEN 'data_gap_unknown' ELSE 'not_recovered' END AS status FROM e)
"""


def _bars(spark, d):
    bars = ts.candles(ticks(spark, d), ["product"], "ts", "price", "size", ["seq"], BAR)
    return bars.select("product", "bucket", F.col("close").cast("double").alias("close"))


def _lots(spark, d, bars):
    entry = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (BAR * 1_000_000)) * BAR).cast("long")
    held = ticks(spark, d).select(F.col("seq").alias("lot_id"), "product", entry.alias("entry_ts"), F.col("price").cast("double").alias("entry_price"))
    final = bars.groupBy("product").agg(F.max("bucket").alias("final"))
    leaves = F.col("entry_ts") + F.col("lot_id") % 40 * 86400
    return held.join(final, "product").withColumn("exit_ts", F.when((F.col("lot_id") % 3 != 0) & (leaves <= F.col("final")), leaves)).drop("final")


def _covered(spark, d):
    bars = _bars(spark, d)
    return diagnostics.lot_coverage(_lots(spark, d, bars), bars, ["product"], BAR)


@register("coverage_gaps", LOTS + "SELECT product, gap_start, gap_end, gap_seconds FROM gaps")
def coverage_gaps(spark, d):
    """Steps between bars of more than one and a half intervals."""
    return diagnostics.coverage_gaps(_bars(spark, d), ["product"], BAR)


@register("lot_coverage", LOTS + "SELECT lot_id, at_gap_end, NOT (at_gap_end OR EXISTS (SELECT 1 FROM gaps g WHERE g.product = edge.product AND coalesce(exit_ts, final) > entry_ts AND gap_start < coalesce(exit_ts, final) AND gap_end > entry_ts)) AS covered FROM edge")
def lot_coverage(spark, d):
    """Whether the bars cover a lot from entry to exit."""
    return _covered(spark, d).select("lot_id", "at_gap_end", "covered")


@register("recovery_statuses", _STATUS + "SELECT lot_id, horizon, eligible, status FROM s")
def recovery_statuses(spark, d):
    """Every lot at every horizon."""
    return diagnostics.recovery_statuses(_covered(spark, d), HORIZONS).select("lot_id", "horizon", "eligible", "status")


@register("recovery_summary", _STATUS + ", c AS (SELECT horizon, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND status = 'recovered') AS recovered, count(*) FILTER (WHERE status = 'not_recovered') AS known_failure, count(*) FILTER (WHERE status = 'right_censored') AS right_censored, count(*) FILTER (WHERE status = 'data_gap_unknown') AS data_gap_unknown, count(*) FILTER (WHERE NOT eligible AND status = 'recovered') AS recovered_but_ineligible FROM s GROUP BY horizon) SELECT *, CASE WHEN eligible > 0 THEN recovered::DOUBLE / eligible END AS rate FROM c")
def recovery_summary(spark, d):
    """Recovery by horizon in six counts and a rate."""
    return diagnostics.recovery_summary(diagnostics.recovery_statuses(_covered(spark, d), HORIZONS))


@register("markout_statistics", LOTS + f""", a AS (SELECT lot_id, product, entry_price, h AS horizon, entry_ts + h AS bucket FROM lot, (SELECT unnest({MARKS}) AS h)),
f AS (SELECT a.horizon, a.bucket, a.entry_price, b.bucket AS hit, b.close FROM a ASOF LEFT JOIN bars b ON a.product = b.product AND a.bucket <= b.bucket), m AS (SELECT horizon, CASE WHEN hit IS NULL THEN 'censored' WHEN hit = bucket THEN 'exact' ELSE 'delayed' END AS status, CASE WHEN hit = bucket THEN (close / entry_price - 1) * 10000 END AS bps FROM f),
c AS (SELECT horizon, count(bps) AS observed, count(*) FILTER (WHERE status = 'delayed') AS delayed, count(*) FILTER (WHERE status = 'censored') AS censored, count(*) FILTER (WHERE bps < 0) AS negative, sum(bps::DECIMAL(28,8))::DOUBLE AS total, quantile_cont(bps, 0.5) AS median, min(bps) AS least, max(bps) AS largest FROM m GROUP BY horizon)
SELECT horizon::INTEGER AS horizon, observed, delayed, censored, negative, CASE WHEN observed > 0 THEN negative::DOUBLE / observed END AS negative_rate, CASE WHEN observed > 0 THEN total / observed END AS average, median, least, largest FROM c""")
def markout_statistics(spark, d):
    """Markouts of all lots by horizon."""
    bars = _bars(spark, d)
    lots = _lots(spark, d, bars).where("entry_price IS NOT NULL").crossJoin(F.broadcast(bars.agg(F.max("bucket").alias("now"))))  # one row: the end of the data
    return diagnostics.markout_statistics(ledger.markouts(lots, bars, MARKS, F.col("now")))


@register("guard_transitions", TICKS + ", a AS (SELECT product, seq, price * 20 >= sum(price) OVER (PARTITION BY product ORDER BY seq ROWS 19 PRECEDING) AS allowed, count(*) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) >= 20 AS ready FROM t), b AS (SELECT *, lag(allowed) OVER (PARTITION BY product ORDER BY seq) AS before FROM a WHERE ready) SELECT product, count(*) AS n_rows, count(*) FILTER (WHERE allowed <> before) AS n_transitions FROM b GROUP BY product")
def guard_transitions(spark, d):
    """How often the price crosses the mean of its last twenty, once there are twenty."""
    w = Window.partitionBy("product").orderBy("seq")
    t = ticks(spark, d).withColumns({"recent": F.sum("price").over(w.rowsBetween(-19, 0)), "at": F.row_number().over(w)})
    return diagnostics.transitions(t, ["product"], "seq", F.col("price") * 20 >= F.col("recent"), F.col("at") >= 20)


@register("utilisation", TICKS + f", a AS (SELECT product, epoch_us(ts) // {BAR}000000 AS bar, seq, sum(CASE WHEN side = 'buy' THEN size ELSE -size END) OVER (PARTITION BY product ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held FROM t), c AS (SELECT product, bar, greatest(arg_max(held, seq), 0) AS held FROM a GROUP BY 1, 2) SELECT product, count(*) AS n_closes, sum(held)::DOUBLE / (count(*) * 1000.0::DOUBLE) AS average, max(held)::DOUBLE / 1000.0::DOUBLE AS largest FROM c GROUP BY product")
def utilisation(spark, d):
    """The share of a capital of 1000 in use, where buys add their size and sells take it away, at the close of each bar."""
    held = F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))).over(Window.partitionBy("product").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    bar = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (BAR * 1_000_000))
    closes = ticks(spark, d).withColumns({"held": held, "bar": bar}).groupBy("product", "bar").agg(F.greatest(F.max_by("held", "seq"), F.lit(0)).alias("held"))
    return diagnostics.utilisation(closes, ["product"], F.col("held"), F.lit(1000.0))


@register("blocked", TICKS + "SELECT product, count(*) AS n_events, count(DISTINCT lvl) AS n_slots, count(DISTINCT k) AS n_bands FROM t GROUP BY product")
def blocked(spark, d):
    """Events, slots and bands by what blocked them."""
    return diagnostics.blocked(ticks(spark, d), "product", "lvl", "k")


@register("replica_streams", TICKS + """, n AS (SELECT product, price, row_number() OVER (PARTITION BY product ORDER BY seq) AS i FROM t),
r AS (SELECT product, unnest(['a', 'b', 'c']) AS route, i, price FROM n), x AS (SELECT product, route, i, CASE WHEN route = 'b' AND product = 'view' AND i = 7 THEN price + 1 ELSE price END AS price FROM r WHERE NOT (route = 'c' AND product = 'error') AND NOT (route = 'a' AND product = 'click')),
g AS (SELECT product, route, count(*) AS n, string_agg(price::VARCHAR, ',' ORDER BY i) AS digest FROM x GROUP BY 1, 2), p AS (SELECT DISTINCT product, route FROM r), j AS (SELECT p.product, p.route, n, digest FROM p LEFT JOIN g ON p.product = g.product AND p.route = g.route),
w AS (SELECT *, first_value(digest IGNORE NULLS) OVER o AS expected, count(digest) OVER (PARTITION BY product ORDER BY route ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j WINDOW o AS (PARTITION BY product ORDER BY route ROWS UNBOUNDED PRECEDING))
SELECT product, route, coalesce(n, 0) AS n, CASE WHEN digest IS NULL THEN 'missing' WHEN before = 0 THEN 'first' WHEN digest = expected THEN 'match' ELSE 'mismatch' END AS status FROM w""")
def replica_streams(spark, d):
    """Three routes of every product's ticks; one has a changed price, two are missing."""
    i = F.row_number().over(Window.partitionBy("product").orderBy("seq"))
    every = ticks(spark, d).select("product", "price", i.alias("i")).withColumn("route", F.explode(F.array(*map(F.lit, "abc"))))
    there = every.where("NOT (route = 'c' AND product = 'error') AND NOT (route = 'a' AND product = 'click')")
    there = there.withColumn("price", F.expr("CASE WHEN route = 'b' AND product = 'view' AND i = 7 THEN price + 1 ELSE price END").cast("decimal(18,2)"))
    return diagnostics.replica_streams(there, every.select("product", "route").distinct(), ["product"], "route", "i", ["price"])


@register("window_audit", BOOK + """, d AS (SELECT stream, window_id, min(n) AS first_n, count(CASE WHEN NOT other THEN 1 END) AS states, min(epoch) AS epoch FROM v WHERE valid GROUP BY 1, 2), k AS (SELECT stream, window_id, count(*) AS stored, min(n) AS kept_n FROM v WHERE valid AND NOT other AND seq % 40 <> 0 GROUP BY 1, 2)
SELECT d.stream, d.window_id::BIGINT AS window_id, states::BIGINT AS states, coalesce(stored, 0) AS stored, concat_ws(',', CASE WHEN states <> coalesce(stored, 0) THEN 'row_count_mismatch' END, CASE WHEN stored IS NULL THEN 'origin_missing' END, CASE WHEN kept_n <> first_n THEN 'origin_sequence_mismatch' END) AS errors FROM d LEFT JOIN k ON d.stream = k.stream AND d.window_id = k.window_id""")
def window_audit(spark, d):
    """Replayed validity windows against their states, of which a store has lost those of each fortieth sequence number."""
    states = replayed(spark, d, "state").where("seq % 40 <> 0").select("stream", "window_id", "epoch", "seq")
    return diagnostics.audit_windows(replayed(spark, d, "window").select("stream", "window_id", "epoch", "first_seq", "states"), states, ["stream"])


@register("right_boundaries", TICKS + """, n AS (SELECT product, k, row_number() OVER (PARTITION BY product ORDER BY seq) - 1 AS i FROM t), f AS (SELECT product, i // 50 AS file, i AS line, CASE WHEN k > 9 AND i // 50 % 7 <> 5 THEN i END AS n FROM n),
g AS (SELECT product, file, min(n) AS first, max(n) AS last FROM f GROUP BY 1, 2), w AS (SELECT product, file, max(last) OVER (PARTITION BY product ORDER BY file ROWS UNBOUNDED PRECEDING) + 1 AS expected, lead(first) OVER (PARTITION BY product ORDER BY file) AS observed, lead(1) OVER (PARTITION BY product ORDER BY file) AS more FROM g)
SELECT product, file, expected, observed, CASE WHEN more IS NULL THEN 'last_file' WHEN observed IS NULL THEN 'no_sequence' WHEN observed = expected THEN 'contiguous' ELSE 'not_contiguous' END AS status FROM w""")
def right_boundaries(spark, d):
    """Files of fifty lines, where some lines, and all of some files, carry no sequence."""
    i = (F.row_number().over(Window.partitionBy("product").orderBy("seq")) - 1).cast("long")
    rows = ticks(spark, d).select("product", "k", i.alias("i")).withColumn("file", F.floor(F.col("i") / 50))
    return diagnostics.right_boundaries(rows.withColumn("n", F.when((F.col("k") > 9) & (F.col("file") % 7 != 5), F.col("i"))), ["product"], "file", "i", "n")


@register("receive_regressions", """WITH r AS (SELECT user_id AS file, event_id AS line, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch(date_trunc('second', ts))::BIGINT AS s FROM events),
v AS (SELECT file, line, k, CASE WHEN k > 1 THEN s - k % 5 * 3600 END AS recv FROM r), b AS (SELECT *, last_value(recv IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
SELECT file, count(*) AS n_lines, count(*) FILTER (WHERE k = 0) AS n_missing, count(*) FILTER (WHERE k = 1) AS n_invalid, count(*) FILTER (WHERE recv < before) AS n_regressions FROM b GROUP BY file""")
def receive_regressions(spark, d):
    """Receive times of every user's lines, up to four hours late, some missing or without a zone."""
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) - k % 5 * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    recv = F.when(k == 0, None).when(k == 1, at).otherwise(F.concat(at, F.lit("Z")))
    rows = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), recv.alias("recv"))
    return diagnostics.receive_regressions(rows, "file", "line", "recv")


@register("selected_sources", TICKS + f", p AS (SELECT product, epoch_us(ts) // {BAR}000000 * {BAR} AS bucket, lvl, row_number() OVER (PARTITION BY product, epoch_us(ts) // {BAR}000000 ORDER BY lvl, seq) AS rn FROM t) SELECT lvl, count(*) AS selected_rows, min(bucket) AS first, max(bucket) AS last FROM p WHERE rn = 1 GROUP BY lvl")
def selected_sources(spark, d):
    """The files that the first row of every bar comes from."""
    bucket = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (BAR * 1_000_000)) * BAR).cast("long")
    chosen = ticks(spark, d).withColumn("bucket", bucket).groupBy("product", "bucket").agg(F.min(F.struct("lvl", "seq")).alias("at")).select("bucket", "at.lvl")
    return diagnostics.selected_sources(chosen, "lvl", "bucket")


@register("level_order", TICKS + "SELECT seq, CASE WHEN k % 11 = 0 THEN 'empty' WHEN price <= 2 OR qty = 0 THEN 'not_positive' WHEN k % 5 = 0 THEN 'out_of_order' ELSE 'ok' END AS bids FROM t")
def level_order(spark, d):
    """Three bids a tick: none at all, or the second without quantity, or the third above the first."""
    p = F.col("price")
    level = lambda price, q: F.struct(price.cast("decimal(18,2)").alias("price"), q.alias("quantity"))
    third = F.when(F.col("k") % 5 == 0, p + 1).otherwise(p - 2)
    levels = F.array(level(p, F.lit(1)), level(p - 1, F.col("qty")), level(third, F.col("size")), level(p - 2, F.lit(1)))
    return ticks(spark, d).select("seq", diagnostics.level_order(F.when(F.col("k") % 11 != 0, levels), True).alias("bids"))


@register("claim_failures", TICKS + ", c AS (SELECT lvl, count(*) FILTER (WHERE k = 0) AS malformed, count(*) FILTER (WHERE k > 97) AS gaps, CASE WHEN max(k) > 50 THEN count(*) FILTER (WHERE product = 'error') END AS errors FROM t GROUP BY lvl) SELECT lvl, concat_ws(',', CASE WHEN malformed > 0 THEN 'malformed_sequence' END, CASE WHEN gaps > 0 THEN 'sequence_gap' END, CASE WHEN errors IS NULL THEN 'errors_missing_or_invalid' WHEN errors > 0 THEN 'collector_errors' END) AS failures FROM c")
def claim_failures(spark, d):
    """What stands against a claim of completeness for every user."""
    counts = ticks(spark, d).groupBy("lvl").agg(F.count_if(F.col("k") == 0).alias("malformed"), F.count_if(F.col("k") > 97).alias("gaps"), F.when(F.max("k") > 50, F.count_if(F.col("product") == "error")).alias("errors"))
    return diagnostics.claim_failures(counts, ["lvl"], {"malformed": "malformed_sequence", "gaps": "sequence_gap", "errors": "collector_errors"})


@register("row_estimates", "WITH s AS (SELECT source, sum(octet_length(encode(text))) AS size, min(octet_length(encode(text))) AS shortest, count(*) AS n FROM documents GROUP BY source) SELECT source, greatest(1, floor(size / greatest(shortest::DOUBLE, 1)))::BIGINT AS n_rows FROM s")
def row_estimates(spark, d):
    """Rows of every source, as one sampled line (the shortest) would have it."""
    s = table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("size"), F.min(F.octet_length("text")).alias("shortest"))
    return s.select("source", diagnostics.row_estimate(F.col("size"), F.col("shortest"), F.lit(1)).alias("n_rows"))


@register("session_states", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 9 AS a FROM orders)
SELECT id, ['no_manifest', 'invalid_manifest', 'invalid_manifest', 'closed', 'open', 'closed', 'open', 'open', 'open'][a + 1] AS state, CASE WHEN a % 3 = 0 THEN NULL ELSE 'l2_data' || a END AS name, '["' || least(a::VARCHAR, 'b', id::VARCHAR) || '","' || greatest(a::VARCHAR, id::VARCHAR) || '"]' AS listed FROM t""")
def session_states(spark, d):
    """Manifests of every kind, file names and lists in JSON."""
    a = F.col("o_orderkey") % 9
    manifest = F.element_at(F.array(F.lit(None), *map(F.lit, ("{", "[1]", '{"end_ts":"x"}', '{"end_ts":""}', '{"status":"closed","end_ts":"x","session_end":{"all_writers_closed":true}}', '{"status":"closed","end_ts":"x","session_end":{"all_writers_closed":false}}', '{"status":"open","end_ts":"x","session_end":{"all_writers_closed":true}}', '{"status":"closed","end_ts":"x"}'))), (a + 1).cast("int"))
    name = F.concat(F.when(a % 3 == 0, "L2/").otherwise("L2-Data"), a.cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.session_state(manifest).alias("state"), S.safe_name(name).alias("name"), S.json_list(F.array(F.col("o_orderkey"), a)).alias("listed"))
