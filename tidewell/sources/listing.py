"""File listings as DataFrames, and the metadata queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalars as S
from tidewell.operators import timeseries as ts


def list_files(spark: SparkSession, roots: str | list[str], pattern: str = "*") -> DataFrame:
    """path, length, modified and what the path tells: kind, stem, directory, product, session, filename_time.  Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots).select("path", "length", F.col("modificationTime").alias("modified"))
    return describe_paths(rows)


def describe_paths(rows: DataFrame) -> DataFrame:
    """Adds what a path tells to rows with ``path``."""
    stem = S.stem(F.col("path"))
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    legacy = F.regexp_extract("path", r"/([A-Za-z0-9]+-[A-Za-z0-9]+)_ws_data/", 1)
    return rows.withColumns({
        "kind": S.suffix_class(F.col("path")),
        "stem": stem,
        "directory": parent,
        "product": F.upper(F.coalesce(S.path_part(F.col("path"), "product"), F.nullif(legacy, F.lit("")), F.nullif(F.regexp_extract(stem, r"([A-Za-z0-9]+-[A-Za-z0-9]+)_\d{4}-", 1), F.lit("")))),
        "session": S.path_part(F.col("path"), "session"),
        "filename_time": S.filename_time(stem),
    })


def with_hashes(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """path, length and SHA-256 of whole files (each under 2 GB)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _is_raw(kind: str = "kind"):
    return F.col(kind).isin("jsonl", "jsonl.gz")


def storage_totals(files: DataFrame) -> DataFrame:
    """Files and bytes by kind, and in all."""
    return files.rollup("kind").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def derived_coverage(files: DataFrame, roll_seconds: int = 600) -> DataFrame:
    """Each derived file (Parquet, Feather) with the raw file that covers it: previous_window, exact, same_directory or none."""
    raw = files.where(_is_raw())
    times = raw.where("filename_time IS NOT NULL").select("directory", "filename_time").distinct()
    exact = times.withColumn("_exact", F.lit(True))
    prev = times.withColumn("filename_time", F.col("filename_time") + F.make_dt_interval(secs=F.lit(float(roll_seconds)))).withColumn("_prev", F.lit(True))
    same = raw.select("directory").distinct().withColumn("_same", F.lit(True))
    rows = files.where(F.col("kind").isin("parquet", "feather")).join(prev, ["directory", "filename_time"], "left").join(exact, ["directory", "filename_time"], "left").join(same, "directory", "left")
    kind = F.when(F.col("_prev"), "previous_window").when(F.col("_exact"), "exact").when(F.col("_same"), "same_directory").otherwise("none")
    return rows.withColumn("coverage", kind).drop("_prev", "_exact", "_same")


def coverage_report(files: DataFrame, roll_seconds: int = 600) -> DataFrame:
    """Files and bytes by derived kind and coverage."""
    return derived_coverage(files, roll_seconds).groupBy("kind", "coverage").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def cleanup_plan(files: DataFrame, required: str = "previous_window", roll_seconds: int = 600) -> DataFrame:
    """Feather files whose raw coverage is at least as good as required.  A plan: nothing is deleted here."""
    allowed = {"previous_window": ["previous_window"], "exact": ["previous_window", "exact"], "same_directory": ["previous_window", "exact", "same_directory"]}[required]
    return derived_coverage(files, roll_seconds).where((F.col("kind") == "feather") & F.col("coverage").isin(allowed))


def stem_coverage(files: DataFrame) -> DataFrame:
    """Derived files by kind: with and without a raw file of the same stem."""
    stems = files.where(_is_raw()).select("stem").distinct().withColumn("_raw", F.lit(True))
    rows = files.where(F.col("kind").isin("parquet", "feather")).join(stems, "stem", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.count_if(F.col("_raw")).alias("n_with_raw"), F.coalesce(F.sum(F.when(F.col("_raw"), F.col("length"))), F.lit(0)).alias("bytes_with_raw"))


def product_ranges(files: DataFrame) -> DataFrame:
    """Raw and derived files and bytes of each product, and its first and last time by file names."""
    raw, derived = _is_raw(), F.col("kind").isin("parquet", "feather")
    length = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0))
    return files.groupBy("product").agg(F.count_if(raw).alias("n_raw"), F.count_if(derived).alias("n_derived"), length(raw).alias("raw_bytes"), length(derived).alias("derived_bytes"), F.min("filename_time").alias("first_time"), F.max("filename_time").alias("last_time"))


def same_stem_groups(files: DataFrame) -> DataFrame:
    """Stems found in two formats or more."""
    return files.groupBy("directory", "stem").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n_files")).where(F.size("kinds") >= 2)


def raw_gaps(files: DataFrame, roll_seconds: int = 600, tolerance: float = 0.0, most: int = 1000) -> DataFrame:
    """Gaps between raw files by product, each file covering ``roll_seconds`` from its name's time; the first ``most`` in product and time order, largest first."""
    iv = files.where(_is_raw() & F.col("filename_time").isNotNull()).select("product", F.col("filename_time").alias("s"), (F.col("filename_time") + F.make_dt_interval(secs=F.lit(float(roll_seconds)))).alias("e"))
    gaps = ts.interval_gaps(ts.merge_intervals(iv, ["product"], "s", "e", tolerance), ["product"])
    return gaps.orderBy("product", "gap_start").limit(most).orderBy(F.desc("gap_seconds"), "product", "gap_start")


def content_boundaries(records: DataFrame) -> DataFrame:
    """Per file of ``read_jsonl`` records: lines, errors, first and last receive time, channels and products."""
    text = lambda p: F.try_variant_get("payload", p, "string")
    recv = S.iso_ns(S.first_text(text("$._recv_ts"), text("$.recv_ts")))
    channel = F.coalesce(S.first_text(text("$._channel"), text("$.channel"), text("$.type")), F.lit("unknown"))
    rows = records.select("source_path", "source_line", "error", recv.alias("recv_ns"), channel.alias("channel"))
    return rows.groupBy("source_path").agg(F.count("*").alias("n_lines"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.min("recv_ns").alias("first_recv_ns"), F.max("recv_ns").alias("last_recv_ns"), F.min_by("channel", "source_line").alias("first_channel"), F.max_by("channel", "source_line").alias("last_channel"), F.array_sort(F.collect_set("channel")).alias("channels"))


def move_plan(files: DataFrame, target_root: str) -> DataFrame:
    """Where each raw file would go below ``target_root``; a plan with ``status`` planned or skip_same_root."""
    to = F.concat(F.lit(target_root.rstrip("/") + "/"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    return files.select("path", "length", to.alias("destination"), F.when(F.col("path").startswith(target_root), "skip_same_root").otherwise("planned").alias("status"))
