import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars as S
from tidewell.operators import book_replay, datasets, normalize
from tidewell.operators import timeseries as ts
from tidewell.sources import candles, jsonl, listing
from tidewell.streaming import capture


def env(channel, seq, events, **more):
    return {"channel": channel, "timestamp": f"2026-01-01T00:00:{seq:02d}Z", "_recv_ts": f"2026-01-01T00:00:{seq:02d}.5Z", "sequence_num": seq, "events": events, **more}


def session():
    quote = {"product_id": "BTC-USD", "price": "100", "best_bid": "99", "best_ask": "101"}
    return [
        env("subscriptions", 0, [{"subscriptions": {"ticker": ["BTC-USD"]}}]),
        env("ticker", 1, [{"type": "update", "tickers": [quote, {"product_id": "BTC-USD", "price": "1"}]}]),
        env("candles", 2, [{"type": "snapshot", "candles": [{"product_id": "BTC-USD", "start": "1767225600", "open": "1", "high": "2", "low": "1", "close": "2", "volume": "5"}]}]),
        env("l2_data", 3, [{"type": "snapshot", "product_id": "BTC-USD", "updates": [{"side": "bid", "price_level": "99", "new_quantity": "1"}, {"side": "offer", "price_level": "101", "new_quantity": "2"}]}]),
        env("market_trades", 4, [{"type": "update", "trades": [{"trade_id": "1", "product_id": "BTC-USD", "price": "100.00", "size": "1", "side": "BUY", "time": "2026-01-01T00:00:05.123456789Z"}]}]),
        env("heartbeats", 5, [{"current_time": "2026-01-01T00:00:06Z", "heartbeat_counter": 7}]),
        env("status", 6, [{"type": "snapshot", "products": [{"id": "BTC-USD", "status": "online"}, {"id": "ETH-USD", "status": "online"}]}]),
        {"type": "error", "message": "x", "sequence_num": 7, "_recv_ts": "2026-01-01T00:00:07Z"},
    ]


@pytest.fixture
def raw(tmp_path):
    rows = [json.dumps(e) for e in session()]
    a = tmp_path / "raw" / "session=s" / "product=BTC-USD"
    b = tmp_path / "raw" / "session=s" / "channel=status"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    odd = [json.dumps(env("market_trades", 8, 0)), json.dumps(env("ticker", 9, []) | {"sequence_num": True}), "{broken", "[1]"]
    (a / "a.jsonl").write_text("\n".join([*rows[:6], "", rows[5], *odd]) + "\n")
    with gzip.open(b / "b.jsonl.gz", "wt") as f:
        f.write("\n".join([*rows[6:], rows[1]]))
    return tmp_path / "raw"


def test_lines_keep_their_numbers(spark, raw):
    r = jsonl.read_jsonl(spark, str(raw))
    got = {(x.source_path[-8:], x.source_line): x.error for x in r.collect()}
    assert got["/a.jsonl", 8] is None and ("/a.jsonl", 7) not in got
    assert got["/a.jsonl", 11] == "invalid_json" and got["/a.jsonl", 12] == "not_an_object"
    assert jsonl.read_jsonl(spark, str(raw), limit_per_file=2).count() == 4


def test_normalize_counts(spark, raw):
    n = normalize.normalize(jsonl.read_jsonl(spark, str(raw)))
    assert {t: d.count() for t, d in n.tables.items()} == {"trades": 1, "l2_updates": 2, "quotes": 1, "candles": 1, "heartbeats": 1, "status": 2, "control": 2}
    q = n.quality.first()
    assert (q.n_exact_transport_duplicate, q.n_routing_replica, q.n_malformed, q.n_ticker_without_bbo) == (1, 1, 2, 1)
    normalize.audit_quality(n.quality)
    reasons = sorted(r.reason for r in n.quarantine.collect())
    assert reasons == ["events_not_list", "invalid_json", "malformed_sequence", "not_an_object"]
    assert n.tables["trades"].first().event_ns % 1_000_000_000 == 123456789


def test_dataset_is_reused_and_audited(spark, raw, tmp_path):
    out = tmp_path / "out"
    first = datasets.run_normalize(spark, str(raw), str(out))
    assert first["status"] == "completed" and datasets.run_normalize(spark, str(raw), str(out))["status"] == "reused"
    manifest = out / first["dataset_id"] / "manifest.json"
    doc = json.loads(manifest.read_text())
    doc["tables"]["trades"] = 5
    datasets.write_json(manifest, doc)
    assert datasets.audit_dataset(spark, str(manifest)) == ["trades has 1 rows, not 5"]
    with pytest.raises(ValueError):
        datasets.guard_roots(raw, raw / "inside")


def test_batch_and_stream_books_agree(spark, tmp_path):
    def l2(seq, kind, *ups):
        return env("l2_data", seq, [{"type": kind, "product_id": "BTC-USD", "updates": [{"side": s, "price_level": str(p), "new_quantity": str(q)} for s, p, q in ups]}], _connection_epoch=1)

    rows = [l2(0, "snapshot", ("bid", 99, 1), ("offer", 101, 2)), l2(1, "update", ("bid", 98, 2)), env("heartbeats", 2, [{"heartbeat_counter": 5}], _connection_epoch=1), l2(4, "update", ("bid", 97, 1)), l2(5, "snapshot", ("bid", 90, 1), ("offer", 91, 1))]
    where = tmp_path / "cap" / "session=s"
    where.mkdir(parents=True)
    (where / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    batch = book_replay.reconstruct(book_replay.l2_envelopes(normalize.classify(normalize.envelopes(jsonl.read_jsonl(spark, str(tmp_path / "cap")))), "BTC-USD"))
    expected = sorted((r.kind, r.seq, r.reason or "") for r in batch.collect() if r.reason != "end_of_input")
    stream = normalize.envelopes(capture.read_capture(spark, str(tmp_path / "cap")).withColumn("source_line", F.lit(0))).withColumn("envelope_class", F.lit("canonical"))
    q = capture.live_books(book_replay.l2_envelopes(stream, "BTC-USD")).writeStream.outputMode("append").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.seq, r.reason or "") for r in spark.table("live").collect()) == expected
    a = capture.annotate(capture.read_capture(spark, str(tmp_path / "cap")), ["BTC-USD"])
    q = capture.audit_connections(a).writeStream.outputMode("update").format("memory").queryName("audit").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("audit").first()
    assert (got.messages, got.gaps, got.missing, got.heartbeats) == (5, 1, 1, 1)
    q = capture.write_routed(a, str(tmp_path / "routed"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.route: r["count"] for r in spark.read.parquet(str(tmp_path / "routed")).groupBy("route").count().collect()} == {"product=BTC-USD": 4, "channel=heartbeats": 1}


def test_timestamps(spark):
    rows = [("2026-01-01T00:00:00.000000001Z", 1767225600000000001), ("2026-01-01T01:00:00+01:00", 1767225600000000000), ("2026-01-01T00:00:00", None), ("x", None), ("2026-01-01T00:00:00.1234567890Z", None)]
    got = spark.createDataFrame(rows, "t string, ns bigint").select("ns", S.iso_ns(F.col("t")).alias("got"), S.ns_text(S.iso_ns(F.col("t"))).alias("text")).collect()
    assert [r.got for r in got] == [r.ns for r in got] and got[0].text == "2026-01-01T00:00:00.000000001Z"


def test_names(spark):
    row = spark.range(1).select(S.normal_product(F.lit(" btc_usd ")), S.normal_product(F.lit("ethusd")), S.path_part(F.lit("a/session=x/product=P-Q/f"), "product"), S.timeframe_seconds(F.lit("4h")), S.stem(F.lit("/a/b_2026-01-01_00-10.jsonl.gz")), S.book_side(F.lit("Offer")), S.timeframe_label(F.lit(3600))).first()
    assert list(row) == ["BTC-USD", "ETH-USD", "P-Q", 14400, "b_2026-01-01_00-10", "ask", "1h"]


def files(spark, names):
    return listing.describe_paths(spark.createDataFrame([(n, 10) for n in names], "path string, length bigint"))


def test_gaps_between_files(spark):
    f = files(spark, [f"/btc-usd_ws_data/1/btc-usd_2026-01-01_00-{m}.jsonl" for m in ("00", "10", "40")])
    gaps = listing.raw_gaps(f).collect()
    assert [(g.product, g.gap_seconds, g.gap_start.minute, g.gap_end.minute) for g in gaps] == [("BTC-USD", 1200.0, 20, 40)]


def test_coverage_and_cleanup(spark):
    d = "/btc-usd_ws_data/1/x_2026-01-01_00-"
    f = files(spark, [f"{d}00.jsonl", f"{d}10.feather", "/other_ws_data/9/x_2026-01-01_00-10.feather"])
    kinds = {r.path: r.coverage for r in listing.derived_coverage(f).collect()}
    assert kinds[f"{d}10.feather"] == "previous_window" and kinds["/other_ws_data/9/x_2026-01-01_00-10.feather"] == "none"
    assert [r.path for r in listing.cleanup_plan(f).collect()] == [f"{d}10.feather"]


def test_candle_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("time,open,high,low,close,volume\n2026-01-01T00:00:00Z,1,2,1,2,5\n2026-01-01T00:01:00Z,1,0.5,1,2,5\nx,1,2,1,2,5\n1767225720,1,2,1,2,\n")
    got = candles.read_candle_csv(spark, str(p), "BTC-USD", "csv").collect()
    assert [r.error for r in got] == [None, "impossible_candle", "bad_time", "missing_field"]


def test_candles_first_wins_and_tail(spark):
    """Hours 5 to 9 in three files; two files hold hour 7, and one of them holds it twice."""
    rows = [("x/1", 5, "20.5"), ("x/1", 7, "21.5"), ("x/1", 7, "0"), ("x/2", 7, "77"), ("x/2", 8, "22.5"), ("x/3", 9, "23.5"), ("x/3", 6, "24.5")]
    df = spark.createDataFrame([(f"2025-03-02T0{h}:00:00Z", "SOL-EUR", "price_only_fallback", "q", path, n, close) for n, (path, h, close) in enumerate(rows)], "start_ts string, product_id string, source_kind string, source_provider string, source_path string, source_line long, close string")
    load = lambda **kw: [r.close for r in candles.load_candles(df, "SOL-EUR", **kw).orderBy("start_ts").collect()]
    assert load() == ["20.5", "24.5", "21.5", "22.5", "23.5"]
    assert load(tail_rows=2) == ["22.5", "23.5"] and load(max_rows=3) == ["20.5", "21.5", "22.5"]
    assert load(start="2025-03-02T08:00:00+01:00", end="2025-03-02T09:00:00Z") == ["21.5", "22.5"]


def test_rest_source(spark):
    def fetch(product, start, end, grain):
        if start >= 1200:
            raise OSError("down")
        return [[t, 1, 2, 1, 2, 3] for t in range(start, end, grain)]

    spark.dataSource.register(candles.rest_candle_source(fetch))
    got = spark.read.format("rest_candles").options(product="P", start="0", end="1800", granularity="60", most="10").load().collect()
    assert sum(r.error is None for r in got) == 20 and sum(r.error is not None for r in got) == 1


def test_asof_forward_and_back(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, None)], "k string, t int, v int")
    back = {r.t: (r.asof_v, r.asof_t) for r in ts.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    ahead = {r.t: (r.asof_v, r.asof_t) for r in ts.asof_join(left, right, ["k"], "t", ["v"], forward=True).collect()}
    assert back == {1: (None, None), 5: (None, 5)} and ahead == {1: (30, 3), 5: (None, 5)}
