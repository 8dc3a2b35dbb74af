"""OHLCV sources: CSV files, and a REST source with an injectable fetcher as a Python data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = ["time", "open", "high", "low", "close", "volume"]


def read_candle_csv(spark: SparkSession, paths: str | list[str], product: str, provider: str) -> DataFrame:
    """Candles of CSV files with the columns of HEADER, and ``error`` for rows that aren't one (all as texts, as written)."""
    from tidewell.functions.scalars import lenient_timestamp

    rows = spark.read.csv(paths, header=True, mode="PERMISSIVE", schema=", ".join(f"{c} string" for c in HEADER), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.withColumns({"source_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    rows = rows.withColumn("source_line", F.row_number().over(Window.partitionBy("source_path").orderBy("_block", "_at")).cast("long"))
    at = lenient_timestamp(F.col("time"))
    numbers = [F.col(c).try_cast("decimal(38,18)") for c in HEADER[1:]]
    o, h, low, c, v = numbers
    error = F.when(F.exists(F.array(*[F.coalesce(F.trim(F.col(x)), F.lit("")) for x in HEADER]), lambda x: x == ""), "missing_field").when(at.isNull(), "bad_time").when(F.greatest(*[n.isNull().cast("int") for n in numbers]) == 1, "bad_number").when((low > F.least(o, c)) | (h < F.greatest(o, c)) | (v < 0), "impossible_candle")
    return rows.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_ts"), F.lit(product).alias("product_id"), *HEADER[1:], F.lit("price_only_fallback").alias("source_kind"), F.lit(provider).alias("source_provider"), "source_path", "source_line", error.alias("error"))


def load_candles(candles: DataFrame, product: str, start: str | None = None, end: str | None = None, providers: list[str] | None = None, max_rows: int | None = None, tail_rows: int | None = None) -> DataFrame:
    """Candles of one product in [start, end), the first of each time in order of path and line.

    Times are compared as times, whatever zone their texts have.  ``max_rows``
    keeps the first unique rows in that order, ``tail_rows`` the latest.
    """
    from tidewell.functions.scalars import lenient_timestamp
    from tidewell.operators.timeseries import first_wins

    rows = candles.where((F.col("product_id") == product) & (F.col("source_kind") == "price_only_fallback")).withColumn("_time", lenient_timestamp(F.col("start_ts")))
    if start is not None:
        rows = rows.where(F.col("_time") >= lenient_timestamp(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("_time") < lenient_timestamp(F.lit(end)))
    if providers is not None:
        rows = rows.where(F.col("source_provider").isin(providers))
    order = [F.col(c) for c in ("source_path", "source_line", "start_ts") if c in rows.columns]
    rows = first_wins(rows, ["_time"], order)
    if max_rows is not None:
        rows = rows.orderBy(*order).limit(max_rows)
    return (rows.orderBy(F.desc("_time")).limit(tail_rows) if tail_rows is not None else rows).drop("_time")


def selected_files(candles: DataFrame) -> DataFrame:
    """The files that chosen candles come from: rows, first and last time of each."""
    return candles.groupBy("source_path").agg(F.count("*").alias("n_rows"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"))


def request_windows(start: int, end: int, granularity: int, most: int = 300) -> list[tuple[int, int]]:
    """[from, to) chunks of at most ``most`` candles."""
    step = granularity * most
    return [(a, min(a + step, end)) for a in range(start, end, step)]


class _Chunk(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


Fetcher = Callable[[str, int, int, int], list[list[float]]]


def rest_candle_source(fetch: Fetcher, name: str = "rest_candles") -> type[DataSource]:
    """A data source whose partitions are request windows; ``fetch(product, start, end, granularity)`` gives arrays of
    (epoch, low, high, open, close, volume).  A failed request is a row with its error."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.o = options

        def partitions(self) -> list[_Chunk]:
            return [_Chunk(a, b) for a, b in request_windows(int(self.o["start"]), int(self.o["end"]), int(self.o.get("granularity", 60)), int(self.o.get("most", 300)))]

        def read(self, partition: _Chunk) -> Iterator[tuple]:
            product, grain = self.o["product"], int(self.o.get("granularity", 60))
            try:
                got = fetch(product, partition.start, partition.end, grain)
            except Exception as e:  # a failed request is data here
                yield product, None, None, None, None, None, None, partition.start, partition.end, f"{type(e).__name__}: {e}"
                return
            for at, low, high, open_, close, volume in got:
                if partition.start <= at < partition.end:
                    yield product, int(at), str(open_), str(high), str(low), str(close), str(volume), partition.start, partition.end, None

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "product_id string, epoch bigint, open string, high string, low string, close string, volume string, request_start bigint, request_end bigint, error string"

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Source
