"""Scalar functions of market-data captures, as column expressions.

Timestamps are ordered by whole nanoseconds since the epoch (long); texts
keep nine fraction digits.  Decimals are cast with ``try_cast``, so malformed
numbers are null instead of errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"


def iso_ns(text: Column) -> Column:
    """Nanoseconds of an ISO-8601 text with a zone and at most nine fraction digits; null otherwise."""
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.regexp_extract(text, _ISO, 1), F.lit("T"), F.regexp_extract(text, _ISO, 2), F.regexp_extract(text, _ISO, 4))))
    fraction = F.rpad(F.regexp_extract(text, _ISO, 3), 9, "0").cast("long")
    return F.when(text.rlike(_ISO), seconds * 1_000_000_000 + fraction)


def epoch_seconds_ns(text: Column) -> Column:
    """Nanoseconds of an epoch-seconds number given as text; null where it isn't one."""
    return F.when(text.rlike(r"^\d{1,11}(\.\d{1,9})?$"), (text.try_cast("decimal(38,9)") * F.lit(1_000_000_000)).cast("decimal(38,0)").cast("long"))


def ns_text(ns: Column) -> Column:
    """UTC text with nine fraction digits of nanoseconds since the epoch."""
    seconds = ((ns - F.pmod(ns, F.lit(1_000_000_000))).cast("decimal(20,0)") / F.lit(1_000_000_000)).cast("long")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def lenient_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text (no zone: UTC) or of epoch seconds; null otherwise."""
    number = text.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("long"))), F.try_to_timestamp(text))


def filename_time(stem: Column) -> Column:
    """Time of a file stem that ends in YYYY-MM-DD_HH-MM."""
    return F.try_to_timestamp(F.right(stem, F.lit(16)), F.lit("yyyy-MM-dd_HH-mm"))


def timeframe_seconds(text: Column) -> Column:
    """Seconds of a timeframe like 30s, 1m, 4h or 1d; null otherwise."""
    unit = F.create_map(F.lit("s"), F.lit(1), F.lit("m"), F.lit(60), F.lit("h"), F.lit(3600), F.lit("d"), F.lit(86400))
    low = F.lower(F.trim(text))
    return F.when(low.rlike(r"^[1-9]\d*[smhd]$"), F.regexp_extract(low, r"^(\d+)", 1).cast("long") * unit[F.right(low, F.lit(1))])


def timeframe_label(seconds: Column) -> Column:
    """The shortest timeframe text of a number of seconds."""
    part = lambda n, u: F.when(seconds % n == 0, F.concat((seconds / n).cast("long").cast("string"), F.lit(u)))
    return F.coalesce(part(86400, "d"), part(3600, "h"), part(60, "m"), F.concat(seconds.cast("string"), F.lit("s")))


def normal_product(text: Column) -> Column:
    """Product id: trimmed, upper case, underscores as dashes, a dash before the last three characters where there is none."""
    up = F.translate(F.upper(F.trim(text)), "_", "-")
    return F.when(up.contains("-") | (F.length(up) <= 3), up).otherwise(F.regexp_replace(up, r"^(.*)(.{3})$", "$1-$2"))


def strict_product(text: Column) -> Column:
    """The text where it is a well-formed product id, else null."""
    return F.when(text.rlike(r"^[A-Z0-9]+-[A-Z0-9]+$"), text)


def path_part(path: Column, name: str) -> Column:
    """Value of the last ``name=value`` part of a path, null without one."""
    hit = F.filter(F.split(path, "/"), lambda p: p.startswith(f"{name}="))
    return F.when(F.size(hit) > 0, F.substring(F.element_at(hit, -1), len(name) + 2, 1_000_000))


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def is_object(v: Column) -> Column:
    """Whether a variant is an object, never null; the schema of a variant would be that of all it holds."""
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def suffix_class(path: Column) -> Column:
    """Kind of a file by its suffix."""
    low = F.lower(path)
    return F.when(low.endswith(".jsonl.gz"), "jsonl.gz").when(low.endswith(".jsonl"), "jsonl").when(low.endswith(".parquet"), "parquet").when(low.endswith(".feather"), "feather").when(low.endswith(".csv"), "csv").otherwise("other")


def stem(path: Column) -> Column:
    """File name without its known suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.(jsonl\.gz|jsonl|parquet|feather|csv)$", "")


def book_side(text: Column) -> Column:
    """bid for bid and buy, ask for ask, offer and sell, else null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("bid", "buy"), "bid").when(low.isin("ask", "offer", "sell"), "ask")


def ratio(a: Column, b: Column) -> Column:
    """The quotient as floating-point arithmetic has it: infinite, or NaN for 0 / 0, where the divisor is zero."""
    return F.when(b == 0, a.cast("double") * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def _whole(value: Column, rounded: Column) -> Column:
    """``rounded``; the value itself where it is too large to have a fraction, infinite or NaN."""
    return F.when(F.abs(value) < float(1 << 53), rounded).otherwise(value)


def floor_to(value: Column, increment: Column) -> Column:
    """Largest multiple of the increment not above the value."""
    steps = ratio(value, increment)
    return _whole(steps, F.floor(steps)) * increment


def ceil_to(value: Column, increment: Column) -> Column:
    """Smallest multiple of the increment not below the value."""
    steps = ratio(value, increment)
    return _whole(steps, F.ceil(steps)) * increment


def safe_partition(text: Column) -> Column:
    """Text fit for a partition directory."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")


def json_list(values: Column) -> Column:
    """JSON text of the sorted values; an empty list for null."""
    return F.coalesce(F.to_json(F.array_sort(values.cast("array<string>"))), F.lit("[]"))


def safe_name(text: Column) -> Column:
    """A route as part of a file name, in lower case with _ for -; null where it has other characters."""
    return F.when(text.rlike(r"\A[A-Za-z0-9_-]+\z"), F.translate(F.lower(text), "-", "_"))


def session_state(manifest: Column) -> Column:
    """open, closed, no_manifest or invalid_manifest, by the text of a session's manifest.

    With a status, only a session of status closed that has an end and all
    writers closed is closed; without one, any that has an end.
    """
    v = F.try_parse_json(manifest)
    text = lambda path: F.try_variant_get(v, path, "string")
    ended = F.coalesce(~text("$.end_ts").isin("", "0", "false"), F.lit(False))
    writers = F.coalesce(F.try_variant_get(v, "$.session_end.all_writers_closed", "boolean"), F.lit(False))
    clean = F.when(text("$.status").isNull(), ended).otherwise((text("$.status") == "closed") & ended & writers)
    return F.when(manifest.isNull(), "no_manifest").when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "invalid_manifest").when(clean, "closed").otherwise("open")
