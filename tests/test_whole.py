from tidewell.plans import catalog, files, ledgers, ticks  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"


def test_every_part_has_levels(spark):
    parts = ledgers.table(spark, SF, "part").count()
    assert parts > 50 and catalog.QUERIES["grid_levels_all"](spark, SF).count() == 11 * parts


def test_every_row_is_interleaved(spark):
    rows = ticks.ticks(spark, SF).count()
    assert rows > 200 and catalog.QUERIES["union_interleave_all"](spark, SF).count() == 2 * rows


def test_former_names_are_the_same_queries():
    for name in ("grid_levels", "union_interleave"):
        assert catalog.QUERIES[name] is catalog.QUERIES[f"{name}_all"] and catalog.ORACLES[name] == catalog.ORACLES[f"{name}_all"]
