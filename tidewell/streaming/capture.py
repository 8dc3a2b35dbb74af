"""Capture streams: landed JSON lines are annotated, routed and written to partitions, with audits per connection.

Late or backward data is never reordered: it is counted, or makes a book
invalid.  Watermarks only bound state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidewell.functions import scalars as S
from tidewell.operators.book_replay import RESULT, Replay, ReplayConfig, as_frame, messages
from tidewell.sources.jsonl import with_payload


def read_capture(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of lines landed below ``path``: raw_line, payload, error, source_path."""
    rows = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").text(path)
    return with_payload(rows.select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("source_path")).where("trim(raw_line) <> ''"))


def annotate(records: DataFrame, products: list[str]) -> DataFrame:
    """Channel, sequence, connection, receive time, latency and ``destinations`` of each record.

    A message goes to the shards of the configured products that it names,
    else to its channel's shard; malformed ones go to ``malformed``, messages
    whose channel is no fit name to ``invalid_route``.
    """
    text = lambda p: F.try_variant_get("payload", p, "string")
    channel = F.coalesce(S.first_text(text("$.channel"), text("$.type")), F.lit("unknown"))
    events = F.try_variant_get("payload", "$.events", "array<variant>")
    lists = ["trades", "updates", "tickers", "candles", "products"]
    named = F.flatten(F.transform(events, lambda e: F.concat(F.array(F.try_variant_get(e, "$.product_id", "string")), *[F.transform(F.coalesce(F.try_variant_get(e, f"$.{x}", "array<variant>"), F.array().cast("array<variant>")), lambda i: F.coalesce(F.try_variant_get(i, "$.product_id", "string"), F.try_variant_get(i, "$.id", "string"))) for x in lists])))
    known = F.array_sort(F.array_intersect(F.coalesce(named, F.array().cast("array<string>")), F.array(*map(F.lit, products))))
    shards = F.transform(known, lambda p: F.concat(F.lit("product="), p))
    to = F.when(F.col("error").isNotNull(), F.array(F.lit("malformed"))).when(F.size(shards) > 0, shards).when(channel.rlike("^[a-z0-9_]+$"), F.array(F.concat(F.lit("channel="), channel))).otherwise(F.array(F.lit("invalid_route")))
    recv, sent = S.iso_ns(S.first_text(text("$._recv_ts"), text("$.recv_ts"))), S.iso_ns(text("$.timestamp"))
    session = F.coalesce(S.path_part(F.col("source_path"), "session"), text("$._collector_session_id"), F.lit(""))
    return records.withColumns({"channel": channel, "session": session, "epoch": F.coalesce(F.try_variant_get("payload", "$._connection_epoch", "bigint"), F.lit(1)), "seq": F.try_variant_get("payload", "$.sequence_num", "bigint"), "heartbeat": F.try_variant_get("payload", "$.events[0].heartbeat_counter", "bigint"), "recv_ns": recv, "latency_ms": (recv - sent) / F.lit(1e6), "destinations": to})


def write_routed(annotated: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Raw lines to one directory per destination; a message with several destinations is written to each."""
    rows = annotated.select("raw_line", "epoch", "recv_ns", F.explode("destinations").alias("route"))
    writer = rows.writeStream.format("parquet").partitionBy("route").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class ConnectionAudit(StatefulProcessor):
    """Per connection: messages, gaps against the highest number, numbers seen again among the last LOOKBACK, steps back, heartbeat defects."""

    LOOKBACK = 4096
    FIELDS = ["messages", "gaps", "missing", "duplicates", "regressions", "high", "heartbeats", "heartbeat_gaps", "heartbeat_repeats", "last_heartbeat", "last_heartbeat_ns", "stale_heartbeats"]

    def __init__(self, dead_seconds: float = 15.0):
        self.dead_ns = int(dead_seconds * 1e9)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", ", ".join(f"{f} long" for f in self.FIELDS))
        self.recent = handle.getListState("recent", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        t = dict(zip(self.FIELDS, self.totals.get() if self.totals.exists() else [0] * 5 + [-1] + [0] * 3 + [-1, -1, 0], strict=True))
        recent = deque(r[0] for r in self.recent.get())
        seen = set(recent)
        for pdf in rows:
            for seq, beat, ns in pdf.sort_values(["recv_ns", "seq"], kind="stable")[["seq", "heartbeat", "recv_ns"]].itertuples(index=False, name=None):
                t["messages"] += 1
                if not pd.isna(seq):
                    seq = int(seq)
                    if seq in seen:
                        t["duplicates"] += 1
                    elif seq > t["high"] + 1:
                        t["gaps"] += 1
                        t["missing"] += seq - t["high"] - 1
                    elif seq < t["high"]:
                        t["regressions"] += 1
                    t["high"] = max(t["high"], seq)
                    if seq not in seen:
                        recent.append(seq)
                        seen.add(seq)
                        if len(recent) > self.LOOKBACK:
                            seen.discard(recent.popleft())
                if not pd.isna(beat):
                    beat, t["heartbeats"] = int(beat), t["heartbeats"] + 1
                    if t["last_heartbeat"] >= 0:
                        t["heartbeat_gaps"] += int(beat > t["last_heartbeat"] + 1)
                        t["heartbeat_repeats"] += int(beat <= t["last_heartbeat"])
                    if t["last_heartbeat_ns"] >= 0 and not pd.isna(ns):
                        t["stale_heartbeats"] += int(ns - t["last_heartbeat_ns"] > self.dead_ns)
                    t["last_heartbeat"] = max(beat, t["last_heartbeat"])
                    t["last_heartbeat_ns"] = int(ns) if not pd.isna(ns) else t["last_heartbeat_ns"]
        self.totals.update(tuple(t[f] for f in self.FIELDS))
        self.recent.put([(s,) for s in recent])
        yield pd.DataFrame([{"session": key[0], "epoch": key[1], **t}])

    def close(self) -> None:
        pass


def audit_connections(annotated: DataFrame, dead_seconds: float = 15.0) -> DataFrame:
    """Running totals of each connection after each batch (update mode); needs the RocksDB state store."""
    rows = annotated.where("error IS NULL").select("session", "epoch", "seq", "heartbeat", "recv_ns")
    return rows.groupBy("session", "epoch").transformWithStateInPandas(ConnectionAudit(dead_seconds), "session string, epoch long, " + ", ".join(f"{f} long" for f in ConnectionAudit.FIELDS), "Update", "None")


class LiveBook(StatefulProcessor):
    """The replay's step on a stream of envelopes, state kept as one pickled value per stream.

    Rows of a batch are ordered by time and number; across batches nothing is
    reordered, so a late envelope is a sequence defect as in batch.
    """

    def __init__(self, config: ReplayConfig = ReplayConfig(), product: str = ""):
        self.config, self.product = replace(config, lookback=config.lookback or ConnectionAudit.LOOKBACK), product  # bounds the state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("replay", "state binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        import pickle

        replay = pickle.loads(self.saved.get()[0]) if self.saved.exists() else Replay(self.config)
        out: list[dict] = []
        for m in messages(pd.concat(list(rows)).sort_values(["ns", "seq"], kind="stable", na_position="last")):
            out += replay.apply(m)
        self.saved.update((pickle.dumps(replay),))
        yield as_frame(out, stream=key[0], product=self.product)

    def close(self) -> None:
        pass


def live_books(envelopes: DataFrame, config: ReplayConfig = ReplayConfig(), product: str = "") -> DataFrame:
    """States and quality events of each stream as they happen (append mode); needs the RocksDB state store."""
    return envelopes.groupBy("stream").transformWithStateInPandas(LiveBook(config, product), f"stream string, product string, {RESULT}", "Append", "None")


def tumbling_files(annotated: DataFrame, seconds: int = 600) -> DataFrame:
    """Messages and latency by route and roll interval of event time, closed by a watermark."""
    at = F.timestamp_micros((F.col("recv_ns") / 1000).cast("long"))
    rows = annotated.where("recv_ns IS NOT NULL").withColumn("at", at).withWatermark("at", f"{seconds} seconds")
    return rows.select("at", "latency_ms", F.explode("destinations").alias("route")).groupBy(F.window("at", f"{seconds} seconds"), "route").agg(F.count("*").alias("n_messages"), F.avg("latency_ms").alias("mean_latency_ms"))


def drop_replicas(annotated: DataFrame, seconds: int = 3600) -> DataFrame:
    """The first of equal lines of a connection within a bounded time; older lines leave the state."""
    at = F.timestamp_micros((F.col("recv_ns") / 1000).cast("long"))
    rows = annotated.withColumn("at", at).withColumn("line_sha256", F.sha2("raw_line", 256)).withWatermark("at", f"{seconds} seconds")
    return rows.dropDuplicatesWithinWatermark(["session", "epoch", "line_sha256"])


def with_manifest(query_rows: DataFrame, path: str):
    """A ``foreachBatch`` function that writes each batch to ``path`` by route and a manifest of its counts beside it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")
        counts = batch.groupBy("route").agg(F.count("*").alias("n_rows"), F.min("recv_ns").alias("first_recv_ns"), F.max("recv_ns").alias("last_recv_ns"))
        counts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest={number}")

    return query_rows.writeStream.foreachBatch(write)
