"""Queries on rows that the driver's small tables lack, against their SQL."""

import math

import duckdb
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (it registers the queries)
from tidewell.functions import scalars as S
from tidewell.operators import book_replay, diagnostics, ledger, normalize
from tidewell.operators import timeseries as ts
from tidewell.plans import captures, catalog
from tidewell.sources.jsonl import with_payload


@pytest.fixture(scope="module")
def free(tmp_path_factory):
    """(folder, connection): events of which some have a price of zero."""
    d = tmp_path_factory.mktemp("free")
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i * 7) AS ts, i % 9 AS user_id, ['view', 'click'][i % 2 + 1] AS event_type,
      CASE WHEN i % 5 = 0 THEN 0.0 ELSE (i * 37 % 101)::DOUBLE END AS value, '{{"k": ' || CASE WHEN i % 3 = 0 THEN 7 ELSE i % 100 END || '}}' AS props FROM range(400) t(i)) TO '{d}/events.parquet'""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    return str(d), con


def test_plan_buy_at_no_price(spark, free):
    same_rows(catalog.QUERIES["plan_buy"](spark, free[0]), free[1], catalog.ORACLES["plan_buy"])


def test_plan_buy_of_budgets_that_doubles_round(spark, tmp_path):
    """Beyond 2^54 a user id rounded before the addition gives another budget; the last digit counts."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, CASE WHEN i % 2 = 0 THEN 9223372036854775807 - i ELSE 59000000000000000 + i END AS user_id, 'view' AS event_type,
      1.0 + i AS value, '{{"k": 1}}' AS props FROM range(200) t(i)) TO '{tmp_path}/events.parquet'""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    columns = ("seq", "base", "notional", "fee", "cost", "feasible")
    rows = catalog.QUERIES["plan_buy"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(con.sql(catalog.ORACLES["plan_buy"]).select(*columns).fetchall())


def test_plan_exit_at_no_price(spark, free):
    same_rows(catalog.QUERIES["plan_exit"](spark, free[0]), free[1], catalog.ORACLES["plan_exit"])


def test_mae_of_a_lot_that_cost_nothing(spark, free):
    same_rows(catalog.QUERIES["mae_bps"](spark, free[0]), free[1], catalog.ORACLES["mae_bps"])


def test_forward_asof_reads_no_frame_twice(spark):
    """A frame up to the end is summed again for each row: quadratic in a product's rows."""
    left = spark.range(3).selectExpr("'a' AS k", "id AS t").unionByName(spark.sql("SELECT 'a' AS k, CAST(NULL AS BIGINT) AS t"))
    right = spark.sql("SELECT 'a' AS k, CAST(1 AS BIGINT) AS t, 5 AS v UNION ALL SELECT 'a', NULL, 6")
    found = ts.asof_join(left, right, ["k"], "t", ["v"], forward=True)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {r.t: r.asof_v for r in found.collect()} == {0: 5, 1: 5, 2: None, None: None}


@pytest.mark.parametrize("name", ["lot_coverage", "recovery_statuses", "recovery_summary"])
def test_lots_are_followed_in_one_pass(spark, name):
    assert "unboundedfollowing" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().lower()


def test_markouts_of_a_lot_that_cost_nothing(spark):
    """It counts as observed, and its infinite markout in the mean; the SQL can't cast it to a decimal."""
    lots = spark.createDataFrame([("p", 0, 0.0), ("p", 0, 10.0), ("p", 0, 20.0), ("q", 0, 0.0)], "product string, entry_ts long, entry_price double")
    bars = spark.createDataFrame([("p", 60, 15.0), ("q", 60, 0.0), ("p", 120, 10.0)], "product string, bucket long, close double")
    marks = ledger.markouts(lots.withColumn("lot_id", F.monotonically_increasing_id()), bars, [60, 120], F.lit(120))
    got = {r.horizon: r for r in diagnostics.markout_statistics(marks.where("product = 'p'")).collect()}
    assert got[60][1:5] == (3, 0, 0, 1) and got[60].average == got[60].largest == float("inf") and (got[60].median, got[60].least) == (5000.0, -2500.0)
    nothing = {r.horizon: r for r in diagnostics.markout_statistics(marks.where("product = 'q'")).collect()}
    assert nothing[60].observed == 1 and math.isnan(nothing[60].average) and nothing[120].censored == 1 and nothing[120].average is None


def test_replay_passes_through_and_its_input_is_that_of_classified_envelopes(spark):
    """Streams in batches of three rows; repeated, replicated and broken lines; nothing holds a whole stream."""
    messages = captures.book_messages(spark, "/root/testdata/sf0.001").select("source_path", "source_line", "raw_line")
    line = F.col("source_line")
    copies = messages.where(line % 11 == 0).withColumn("source_path", F.regexp_replace("source_path", "channel=all", "channel=copy")).unionByName(messages.where(line % 13 == 0).withColumn("source_line", line + 1))
    broken = messages.where(line % 17 == 0).withColumns({"source_line": line + 2, "raw_line": F.lit("{")})
    env = normalize.envelopes(with_payload(messages.unionByName(copies).unionByName(broken)))
    slim = book_replay.replay_input(env, "A-B")
    whole = book_replay.l2_envelopes(normalize.classify(env), "A-B")
    rows = lambda df: sorted(map(repr, df.select(*slim.columns).collect()))
    got = rows(slim)
    assert got == rows(whole) and len(got) < env.count()
    kept = sorted(map(repr, book_replay.reconstruct(whole, product="A-B").collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = book_replay.reconstruct(slim, product="A-B")
        assert sorted(map(repr, out.collect())) == kept
        windows = book_replay.reconstruct(slim, product="A-B", kinds=("window",)).collect()
        assert sorted(map(repr, windows)) == [r for r in kept if "kind='window'" in r] and windows
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["replay_quality", "replay_windows", "window_audit"])
def test_replays_hold_no_stream_whole(spark, name):
    assert "FlatMapGroupsInPandas" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_parsing_a_message_reads_no_schema_of_all_it_holds(spark, monkeypatch):
    """The schema of a variant is that of everything below it."""
    asked, own = [], F.schema_of_variant
    monkeypatch.setattr(F, "schema_of_variant", lambda v: asked.append(str(v)) or own(v))
    line = spark.createDataFrame([("/a/session=s/x.jsonl", 1, "{}")], "source_path string, source_line long, raw_line string")
    book_replay.replay_input(normalize.envelopes(with_payload(line)), "A-B")
    assert all("sequence_num" in v or "_connection_epoch" in v for v in asked)  # single numbers


def test_objects_are_told_from_other_values(spark):
    texts = ['{}', '{"_":null}', '{"a":[{}]}', '[]', '[{}]', 'null', '1', '"{}"', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.is_object(F.parse_json("t")).alias("o"), (F.coalesce(F.schema_of_variant(F.parse_json("t")).startswith("OBJECT"), F.lit(False))).alias("w"))
    got = rows.collect()
    assert [r.o for r in got] == [r.w for r in got] == [True] * 3 + [False] * 6
