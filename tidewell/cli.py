"""Command line: every verb prints one JSON document; only failed audits exit with 1."""

from __future__ import annotations

import argparse
import json
import sys
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators import book_replay, datasets, fees, grid_sim, normalize, reserve_sim
from tidewell.operators import features as feature_ops
from tidewell.sources import candles, jsonl, listing


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _rows(df: DataFrame, most: int = 1000) -> list[dict]:
    """Report rows for the console; tables are written to --out instead."""
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def _bars(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from pyspark.sql import functions as F

    rows = candles.load_candles(spark.read.parquet(a.candles), a.product, a.start, a.end)
    return rows.select(F.col("product_id").alias("product"), F.unix_seconds(F.try_to_timestamp("start_ts")).alias("bucket"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])


def _schedule(a: argparse.Namespace) -> fees.FeeSchedule:
    return fees.FeeSchedule(Decimal(a.maker), Decimal(a.taker), Decimal(a.rebate), Decimal(a.rebate_cap))


def run(verb: str, a: argparse.Namespace, spark: SparkSession) -> Any:
    files = lambda: listing.list_files(spark, a.root)
    if verb == "inventory":
        return _rows(files())
    if verb == "storage-audit":
        return {"totals": _rows(listing.storage_totals(files())), "stems": _rows(listing.stem_coverage(files()))}
    if verb == "coverage":
        return _rows(listing.coverage_report(files(), a.roll_seconds))
    if verb == "cleanup-plan":
        return _rows(listing.cleanup_plan(files(), a.required, a.roll_seconds))
    if verb == "raw-gaps":
        return _rows(listing.raw_gaps(files(), a.roll_seconds, a.tolerance))
    if verb in ("centralize-plan", "move-sessions-plan", "move-candles-plan"):
        return _rows(listing.move_plan(files(), a.out))
    if verb == "read-check":
        return {"files": _rows(listing.content_boundaries(jsonl.read_jsonl(spark, a.root))), "same_stem": _rows(listing.same_stem_groups(files()))}
    if verb == "normalize":
        return datasets.run_normalize(spark, a.root, a.out)
    if verb == "audit-normalization":
        return {"problems": datasets.audit_dataset(spark, a.root)}
    if verb == "audit-session":
        with open(a.manifest) as f:
            declared = json.load(f)["files"]
        bad = _rows(datasets.audit_session(jsonl.read_jsonl(spark, a.root), declared).where("status <> 'ok'"))
        return {"problems": bad}
    if verb == "reconstruct-book":
        env = normalize.classify(normalize.envelopes(jsonl.read_jsonl(spark, a.root)))
        config = book_replay.ReplayConfig(a.depth, a.emit_every, int(a.max_gap * 1e9) if a.max_gap else None)
        out = book_replay.reconstruct(book_replay.l2_envelopes(env, a.product), config, a.product)
        out.write.mode("overwrite").partitionBy("kind").parquet(a.out)
        return _rows(spark.read.parquet(a.out).groupBy("kind", "reason").count())
    if verb == "features":
        from pyspark.sql import functions as F

        trades, l2 = (spark.read.parquet(f"{a.root}/{t}").where(F.col("product_id") == a.product) for t in ("trades", "l2_updates"))
        events = l2.select(F.col("product_id").alias("product"), F.col("event_ns").alias("seq"), F.lit("l2").alias("kind"), "side", F.col("price_level").alias("price"), F.col("new_quantity").alias("size")).unionByName(trades.select(F.col("product_id").alias("product"), F.col("event_ns").alias("seq"), F.lit("trade").alias("kind"), "side", "price", "size"))
        feature_ops.feature_rows(events, a.window).write.mode("overwrite").parquet(a.out)
        return {"rows": spark.read.parquet(a.out).count()}
    if verb == "import-candles":
        got = candles.read_candle_csv(spark, a.root, a.product, a.provider)
        got.where("error IS NULL").drop("error").write.mode("append").parquet(a.out)
        return {"good": got.where("error IS NULL").count(), "errors": _rows(got.where("error IS NOT NULL"), 25)}
    if verb == "fetch-candles":
        raise SystemExit("register a source made by tidewell.sources.candles.rest_candle_source and read it with spark.read")
    if verb == "fee-profile":
        return {k: str(v) for k, v in vars(_schedule(a)).items()}
    if verb == "grid-backtest":
        config = spark.createDataFrame([(1, a.lower, a.upper, a.grid_count, a.quote, a.base, a.order, not a.high_first)], "config bigint, lower double, upper double, grid_count int, quote_start double, base_start double, order_quote double, low_first boolean")
        out = grid_sim.simulate_candles(_bars(spark, a), config, _schedule(a))
        out.write.mode("overwrite").partitionBy("kind").parquet(a.out)
        return _rows(spark.read.parquet(a.out).where("kind = 'summary'"))
    if verb == "reserve-backtest":
        d = lambda x: Decimal(str(x))
        c = reserve_sim.ReserveConfig(d(a.lower), d(a.upper), d(a.band_width), a.levels, d(a.band_cap), d(a.quote), d(a.exit_move), d(a.profit_bps), d(a.overflow_cap), low_first=not a.high_first)
        out = reserve_sim.simulate_reserve(_bars(spark, a), [(1, c)], _schedule(a))
        out.write.mode("overwrite").partitionBy("event").parquet(a.out)
        return _rows(spark.read.parquet(a.out).groupBy("event", "reason").count())
    raise ValueError(verb)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewell")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *options: tuple) -> None:
        p = verbs.add_parser(name)
        for flag, default in options:
            if isinstance(default, bool):
                p.add_argument(f"--{flag}", action="store_true")
            else:
                p.add_argument(f"--{flag}", default=default, type=str if default is None else type(default), required=default == "")

    root, out = ("root", ""), ("out", "")
    money = [("maker", "0.004"), ("taker", "0.006"), ("rebate", "0"), ("rebate-cap", "0")]
    span = [("candles", ""), ("product", ""), ("start", None), ("end", None)]
    for name in ("inventory", "storage-audit", "read-check", "audit-normalization"):
        verb(name, root)
    verb("coverage", root, ("roll-seconds", 600))
    verb("cleanup-plan", root, ("roll-seconds", 600), ("required", "previous_window"))
    verb("raw-gaps", root, ("roll-seconds", 600), ("tolerance", 0.0))
    for name in ("centralize-plan", "move-sessions-plan", "move-candles-plan", "normalize"):
        verb(name, root, out)
    verb("audit-session", root, ("manifest", ""))
    verb("reconstruct-book", root, out, ("product", ""), ("depth", 10), ("emit-every", 1), ("max-gap", 0.0))
    verb("features", root, out, ("product", ""), ("window", 100))
    verb("import-candles", root, out, ("product", ""), ("provider", "csv"))
    verb("fetch-candles")
    verb("fee-profile", *money)
    verb("grid-backtest", out, *span, *money, ("lower", 1.0), ("upper", 2.0), ("grid-count", 10), ("quote", 1000.0), ("base", 0.0), ("order", 25.0), ("high-first", False))
    verb("reserve-backtest", out, *span, *money, ("lower", 1.0), ("upper", 2.0), ("band-width", 0.5), ("levels", 5), ("band-cap", 100.0), ("quote", 1000.0), ("exit-move", 0.02), ("profit-bps", 20.0), ("overflow-cap", 0.0), ("high-first", False))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    result = run(a.verb, a, _spark())
    print(json.dumps(result, default=str, indent=1))
    return int(isinstance(result, dict) and bool(result.get("problems")))


if __name__ == "__main__":
    sys.exit(main())
