"""Diagnostics on hand-made cases that the queries' tables don't hold."""

from pyspark.sql import functions as F

from tidewell.operators import diagnostics

HOUR = 3600


def bars(spark, hours):
    return spark.createDataFrame([("p", h * HOUR) for h in hours], "product string, bucket long")


def test_gap_needs_more_than_one_and_a_half_intervals(spark):
    rows = spark.createDataFrame([("p", 0), ("p", 5400), ("p", 10801)], "product string, bucket long")
    assert [(r.gap_start, r.gap_end, r.gap_seconds) for r in diagnostics.coverage_gaps(rows, ["product"], HOUR).collect()] == [(5400, 10801, 5401)]


def test_recovery_around_one_gap(spark):
    """Bars at hours 0 to 4 and 8 to 12; the gap is (4, 8)."""
    b = bars(spark, [0, 1, 2, 3, 4, 8, 9, 10, 11, 12])
    lots = [("before", 1, 3), ("across", 3, 9), ("open", 2, None), ("edge", 8, 9), ("after", 9, None), ("at_start", 4, 4), ("late", 9, 12)]
    df = spark.createDataFrame([(i, "p", e * HOUR, x and x * HOUR) for i, e, x in lots], "lot_id string, product string, entry_ts long, exit_ts long")
    covered = diagnostics.lot_coverage(df, b, ["product"], HOUR)
    assert {r.lot_id: r.covered for r in covered.collect()} == {"before": True, "across": False, "open": False, "edge": False, "after": True, "at_start": True, "late": True}
    got = {(r.lot_id, r.horizon): (r.status, r.eligible) for r in diagnostics.recovery_statuses(covered, {"2h": 2 * HOUR, "6h": 6 * HOUR}).collect()}
    assert got["before", "2h"] == ("recovered", True) and got["before", "6h"] == ("recovered", False)
    assert got["across", "2h"] == ("data_gap_unknown", False) and got["across", "6h"] == ("recovered", False)
    assert got["open", "2h"] == ("not_recovered", True) and got["open", "6h"] == ("data_gap_unknown", False)
    assert got["edge", "2h"] == ("recovered", False)
    assert got["after", "2h"] == ("not_recovered", True) and got["after", "6h"] == ("right_censored", False)
    assert got["late", "2h"] == ("not_recovered", True) and got["late", "6h"] == ("recovered", False)
    total = {r.horizon: r for r in diagnostics.recovery_summary(diagnostics.recovery_statuses(covered, {"2h": 2 * HOUR})).collect()}["2h"]
    assert (total.eligible, total.recovered, total.known_failure, total.data_gap_unknown, total.recovered_but_ineligible, total.rate) == (4, 1, 3, 1, 2, 0.25)


def test_equal_streams_in_another_order_differ(spark):
    rows = spark.createDataFrame([("x", "a", 1, "u"), ("x", "a", 2, "v"), ("x", "b", 1, "v"), ("x", "b", 2, "u"), ("x", "c", 2, "v"), ("x", "c", 1, "u")], "g string, route string, i int, c string")
    declared = spark.createDataFrame([("x", r) for r in "abcd"], "g string, route string")
    got = diagnostics.replica_streams(rows, declared, ["g"], "route", "i", ["c"])
    assert {r.route: r.status for r in got.collect()} == {"a": "first", "b": "mismatch", "c": "match", "d": "missing"}


def test_windows_that_no_one_declared_and_wrong_epochs(spark):
    windows = spark.createDataFrame([("s", 1, 0, 5, 2), ("s", 2, 1, 9, 1)], "stream string, window_id long, epoch long, first_seq long, states long")
    states = spark.createDataFrame([("s", 1, 0, 5), ("s", 1, 0, 6), ("s", 2, 0, 9), ("s", 3, 1, 1)], "stream string, window_id long, epoch long, seq long")
    assert {r.window_id: r.errors for r in diagnostics.audit_windows(windows, states, ["stream"]).collect()} == {1: "", 2: "origin_epoch_mismatch", 3: "undeclared_window"}


def test_empty_tables(spark):
    b, lots = bars(spark, []), spark.createDataFrame([], "lot_id string, product string, entry_ts long, exit_ts long")
    assert diagnostics.recovery_summary(diagnostics.recovery_statuses(diagnostics.lot_coverage(lots, b, ["product"], HOUR), {"2h": 7200})).count() == 0
    assert diagnostics.coverage_gaps(b, ["product"], HOUR).count() == 0


def test_row_estimate(spark):
    rows = spark.createDataFrame([(1000, 50, 5), (1000, 0, 5), (10, 500, 5), (10, None, 5), (10, 5, 0)], "size int, seen int, n int")
    got = rows.select(diagnostics.row_estimate(F.col("size"), F.col("seen"), F.col("n")).alias("e")).collect()
    assert [r.e for r in got] == [100, 1000, 5, None, 0]
