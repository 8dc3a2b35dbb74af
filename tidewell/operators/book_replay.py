"""Gap-aware order-book reconstruction: envelopes in, book states, quality events, ticker checks and validity windows out.

The state machine is one pure step per envelope.  A book is invalid until a
snapshot; any sequence defect, stale or backward clock, bad update or broken
invariant (empty side, locked, crossed) empties it and makes it invalid again
until the next snapshot.  A number below the last one that isn't the same
message again is a reconnect: a new epoch begins with that envelope.  All
updates of an envelope are parsed before the first is applied, and all are
applied before the book is judged.  The same step runs in batch, one group
per stream, and in Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .book_fold import Book


@dataclass(frozen=True)
class ReplayConfig:
    depth: int = 10
    emit_every: int = 1
    max_gap_ns: int | None = None
    #: Gaps of a filtered sequence are reported but don't invalidate.
    filtered_sequence: bool = False
    #: A ticker's best prices agree with the book's within this.
    ticker_tolerance: Decimal = Decimal(0)
    #: Numbers of an epoch whose messages are remembered (None: all); older ones seen again count as a reconnect.
    lookback: int | None = None


@dataclass
class Message:
    """One envelope as the replay sees it; ``events`` of its product as {snapshot, updates: [(side, price, quantity)]}."""

    seq: int | None
    ns: int | None
    events: list[dict] | None = None
    #: The line is no message; the events can't be read; the number or the time is there but malformed.
    error: str | None = None
    event_error: str | None = None
    bad_seq: bool = False
    bad_time: bool = False
    #: Of a book channel; the message's identity; (best bid, best ask) of the product's tickers.
    l2: bool | None = None
    digest: Any = None
    tickers: list[tuple] = ()


@dataclass
class Replay:
    config: ReplayConfig = field(default_factory=ReplayConfig)
    book: Book = field(default_factory=Book)
    valid: bool = False
    window: int = 0
    epoch: int = 0
    opened: tuple[int, int] | None = None
    states: int = 0
    last_seq: int | None = None
    last_ns: int | None = None
    since_emit: int = 0
    good: tuple[int | None, int | None] = (None, None)
    seen: dict[int, Any] = field(default_factory=dict)

    def _row(self, kind: str, seq: int | None, ns: int | None, reason: str | None = None, **more: Any) -> dict[str, Any]:
        return {"kind": kind, "seq": seq, "ns": ns, "epoch": self.epoch, "window_id": self.window if self.window else None, "reason": reason, **more}

    def _close(self, seq: int | None, ns: int | None, reason: str) -> list[dict]:
        self.valid = False
        return [self._row("window", seq, ns, reason, first_seq=self.opened[0], first_ns=self.opened[1], last_seq=self.good[0], last_ns=self.good[1], states=self.states)]

    def _invalidate(self, seq: int | None, ns: int | None, reason: str) -> list[dict]:
        rows = [self._row("quality", seq, ns, reason)]
        if self.valid:
            rows += self._close(seq, ns, reason)
        self.book.clear()
        self.since_emit = 0
        return rows

    def _clock(self, m: Message) -> tuple[list[dict], bool]:
        """(rows, usable): time must be there for a numbered message, and may neither go back nor stand still for too long."""
        rows, usable = [], True
        if m.bad_seq:
            rows, usable = rows + self._invalidate(m.seq, m.ns, "malformed_sequence"), False
        if m.seq is not None and m.ns is None:
            rows, usable = rows + self._invalidate(m.seq, m.ns, "malformed_timestamp" if m.bad_time else "missing_timestamp"), False
        if m.ns is not None:
            if self.last_ns is not None and m.ns < self.last_ns:
                rows, usable = rows + self._invalidate(m.seq, m.ns, "clock_regression"), False
            elif self.last_ns is not None and self.config.max_gap_ns is not None and m.ns - self.last_ns > self.config.max_gap_ns:
                rows += self._invalidate(m.seq, m.ns, "stale_gap")
            self.last_ns = m.ns
        return rows, usable

    def _number(self, m: Message) -> tuple[list[dict], bool]:
        """(rows, usable): each number once, none left out; a smaller one begins a new epoch."""
        if m.seq is None:
            if m.bad_seq:
                return [], False
            if m.l2:
                return self._invalidate(m.seq, m.ns, "missing_sequence"), False
            return [self._row("quality", m.seq, m.ns, "unsequenced_control")], True
        rows, last = [], self.last_seq
        if m.seq in self.seen and self.seen[m.seq] == m.digest:
            return self._invalidate(m.seq, m.ns, "sequence_duplicate"), False
        if last is not None and m.seq < last:
            closed = self._close(m.seq, m.ns, "sequence_regression") if self.valid else []  # in its own epoch
            self.epoch, self.seen, last = self.epoch + 1, {}, None
            rows += self._invalidate(m.seq, m.ns, "sequence_regression") + closed
        elif m.seq in self.seen:
            return self._invalidate(m.seq, m.ns, "sequence_conflict"), False
        if last is not None and m.seq > last + 1:
            rows += [self._row("quality", m.seq, m.ns, "sequence_gap")] if self.config.filtered_sequence else self._invalidate(m.seq, m.ns, "sequence_gap")
        self.last_seq, self.seen[m.seq] = m.seq, m.digest
        if self.config.lookback is not None and len(self.seen) > self.config.lookback:
            del self.seen[next(iter(self.seen))]
        return rows, True

    def _tickers(self, m: Message) -> list[dict]:
        """How each ticker's best prices agree with the book's; only prices that a book could have are compared."""
        rows = []
        for bid, ask in m.tickers if self.valid else ():
            if bid is None or ask is None:
                rows.append(self._row("ticker", m.seq, m.ns, "without_bbo"))
            elif bid <= 0 or ask <= 0 or bid >= ask:
                rows.append(self._row("ticker", m.seq, m.ns, "rejected_bbo"))
            else:
                best = self.book.best("bid"), self.book.best("ask")
                off = abs(best[0] - bid), abs(best[1] - ask)
                reason = "exact" if off == (0, 0) else "within_tolerance" if max(off) <= self.config.ticker_tolerance else "mismatch"
                rows.append(self._row("ticker", m.seq, m.ns, reason, best_bid=best[0], best_ask=best[1], bid_delta=off[0], ask_delta=off[1]))
        return rows

    def step(self, seq: int | None, ns: int | None, events: list[dict] | None, error: str | None = None) -> list[dict]:
        """``apply`` of a message that has only these; one with events is of a book channel."""
        return self.apply(Message(seq, ns, events, error, l2=bool(events), digest=repr(events)))

    def apply(self, m: Message) -> list[dict]:
        """One envelope."""
        if m.error:
            return self._invalidate(m.seq, m.ns, m.error)
        rows, in_time = self._clock(m)
        more, usable = self._number(m)
        rows += more
        if not (in_time and usable):
            return rows
        rows += self._tickers(m)
        if m.event_error:
            return rows + self._invalidate(m.seq, m.ns, m.event_error)
        if not m.events:
            if self.valid:
                self.good = (m.seq, m.ns)  # other channels and products carry the window on
            return rows
        if any(side is None or price is None or quantity is None or price <= 0 or quantity < 0 for e in m.events for side, price, quantity in e["updates"]):
            return rows + self._invalidate(m.seq, m.ns, "bad_update")
        snapshot = any(e["snapshot"] for e in m.events)
        if not self.valid and not snapshot:
            return [*rows, self._row("quality", m.seq, m.ns, "update_ignored_while_invalid")]
        for e in m.events:
            if e["snapshot"]:
                self.book.clear()
            for side, price, quantity in e["updates"]:
                self.book.set(side, price, quantity)
        defect = self.book.defect()
        if defect:
            return rows + self._invalidate(m.seq, m.ns, defect)
        if snapshot:
            if self.valid:
                rows += self._close(m.seq, m.ns, "fresh_snapshot")
            self.valid, self.opened, self.states, self.window = True, (m.seq, m.ns), 0, self.window + 1
        self.states += 1
        self.good = (m.seq, m.ns)
        self.since_emit += 1
        if snapshot or self.since_emit >= self.config.emit_every:
            self.since_emit = 0
            rows.append(self._state(m.seq, m.ns))
        return rows

    def _state(self, seq: int | None, ns: int | None) -> dict:
        bids, asks = self.book.levels("bid", self.config.depth), self.book.levels("ask", self.config.depth)
        b, a = sum(q for _, q in bids), sum(q for _, q in asks)
        best_bid, best_ask = bids[0][0], asks[0][0]
        return self._row("state", seq, ns, best_bid=best_bid, best_ask=best_ask, midpoint=(best_bid + best_ask) / 2, spread=best_ask - best_bid, imbalance=(b - a) / (b + a) if b + a else None, bid_depth=self.book.depth["bid"], ask_depth=self.book.depth["ask"], truncated=len(self.book.prices["bid"]) > self.config.depth or len(self.book.prices["ask"]) > self.config.depth, bid_levels=bids, ask_levels=asks)

    def finish(self) -> list[dict]:
        """The open window, closed by the end of the input."""
        return self._close(*self.good, "end_of_input") if self.valid else []


_LEVELS = "array<struct<price:double,quantity:double>>"
RESULT = f"kind string, seq bigint, ns bigint, epoch bigint, window_id bigint, reason string, first_seq bigint, first_ns bigint, last_seq bigint, last_ns bigint, states bigint, best_bid double, best_ask double, midpoint double, spread double, imbalance double, bid_depth double, ask_depth double, bid_delta double, ask_delta double, truncated boolean, bid_levels {_LEVELS}, ask_levels {_LEVELS}"
_NAMES = [f.split()[0] for f in RESULT.replace(_LEVELS, "x").split(", ")]
KINDS = ("state", "quality", "ticker", "window")
#: Tasks that streams are dealt to: more than the streams, so that few share one while others idle.
TASKS = 200


def as_events(raw: Any) -> list[dict] | None:
    """Events as they arrive from Spark, with decimals for arithmetic."""
    if raw is None:
        return None
    number = lambda x: None if x is None else Decimal(str(x))
    return [{"snapshot": bool(e["snapshot"]), "updates": [(u["side"], number(u["price"]), number(u["quantity"])) for u in e["updates"]]} for e in raw]


def as_frame(rows: list[dict], **keys: Any) -> pd.DataFrame:
    def plain(v: Any) -> Any:
        if isinstance(v, Decimal):
            return float(v)
        return [{"price": float(p), "quantity": float(q)} for p, q in v] if isinstance(v, list) else v

    out = pd.DataFrame([{n: plain(r.get(n)) for n in _NAMES} for r in rows], columns=_NAMES)
    for i, (k, v) in enumerate(keys.items()):
        out.insert(i, k, v)
    return out.astype({n: "Int64" for n in ("seq", "ns", "epoch", "window_id", "first_seq", "first_ns", "last_seq", "last_ns", "states")})


def _whole(x: Any) -> int | None:
    return None if pd.isna(x) else int(x)


def messages(pdf: pd.DataFrame) -> list[Message]:
    """Rows of ``l2_envelopes`` in their order."""
    price = lambda x: None if x is None else Decimal(str(x))
    columns = ["seq", "ns", "events", "error", "event_error", "bad_seq", "bad_time", "l2", "digest", "tickers"]
    return [Message(_whole(seq), _whole(ns), as_events(events), error, event_error, bool(bad_seq), bool(bad_time), bool(l2), digest, [(price(t["bid"]), price(t["ask"])) for t in ([] if tickers is None else tickers)]) for seq, ns, events, error, event_error, bad_seq, bad_time, l2, digest, tickers in pdf[columns].itertuples(index=False, name=None)]


def l2_envelopes(classified: DataFrame, product: str) -> DataFrame:
    """Envelopes of ``normalize.classify`` as replay input for one product, without routing replicas (see ``_parsed``)."""
    return _parsed(classified.where("envelope_class <> 'routing_replica'"), product)


def replay_input(env: DataFrame, product: str) -> DataFrame:
    """What ``l2_envelopes`` makes of ``normalize.envelopes`` once they are classified.

    Texts are parsed where they are read; what is sorted and shuffled is the
    replay's input alone.
    """
    from .normalize import without_replicas

    rows = _parsed(env, product, "exchange_sha256", "recv_ns", "sequence_num", "route")
    return without_replicas(rows).drop("exchange_sha256", "recv_ns", "sequence_num", "route")


def _parsed(rows: DataFrame, product: str, *more: str) -> DataFrame:
    """Envelopes as replay input for one product, each with what ``Message`` holds and its file and line, and ``more`` columns.

    Other channels pass without events, as they carry sequence numbers too.
    An event belongs to a product that it, one of its updates or the message
    names.  What can't be read makes the whole message an error, but for the
    updates of other products.
    """
    from tidewell.functions import scalars as S

    text = lambda v, p: F.try_variant_get(v, p, "string")
    listed = lambda v, p: F.try_variant_get(v, p, "array<variant>")
    message_product = text("payload", "$.product_id")

    # each step reads what the one before has found: a name used twice in one expression would be evaluated twice
    def read(e):
        return F.struct(S.is_object(e).alias("is_object"), F.coalesce(text(e, "$.product_id"), message_product).alias("own"), listed(e, "$.updates").alias("updates"), F.coalesce(F.lower(text(e, "$.type")), F.lit("")).alias("type"))

    def chosen(e):
        own = F.filter(e["updates"], lambda u: F.coalesce(text(u, "$.product_id"), e["own"]) == product)
        return F.struct(*(e[n].alias(n) for n in ("is_object", "own", "updates", "type")), own.alias("mine"))

    def event(e):
        own, type_ = e["own"], e["type"]
        relevant = F.coalesce(own == product, F.lit(False)) | (F.coalesce(F.size(e["mine"]), F.lit(0)) > 0)
        error = F.when(~e["is_object"], "event_not_object").when(e["updates"].isNull() & (own.isNull() | (own == product)), "updates_not_list").when(F.exists(e["updates"], lambda u: ~S.is_object(u)), "update_not_object").when(relevant & ~type_.isin("snapshot", "update"), "unknown_event_type")
        return F.struct((type_ == "snapshot").alias("snapshot"), F.coalesce(F.transform(e["mine"], update), F.array().cast("array<struct<side:string,price:decimal(28,10),quantity:decimal(28,10)>>")).alias("updates"), relevant.alias("relevant"), error.alias("error"))

    def update(u):
        return F.struct(S.book_side(text(u, "$.side")).alias("side"), S.first_text(text(u, "$.price_level"), text(u, "$.price")).try_cast("decimal(28,10)").alias("price"), S.first_text(text(u, "$.new_quantity"), text(u, "$.quantity"), text(u, "$.size")).try_cast("decimal(28,10)").alias("quantity"))

    is_l2, is_ticker = F.col("channel").isin("l2_data", "level2"), F.col("channel").isin("ticker", "ticker_batch")
    rows = rows.withColumn("_events", F.when(is_l2, F.transform(F.transform(F.transform(listed("payload", "$.events"), read), chosen), event)))
    failure = F.when(is_l2 & listed("payload", "$.events").isNull(), "events_not_list").otherwise(F.get(F.filter(F.transform("_events", lambda e: e["error"]), lambda x: x.isNotNull()), F.lit(0)))
    tickers = F.filter(F.flatten(F.transform(listed("payload", "$.events"), lambda e: F.coalesce(listed(e, "$.tickers"), F.array().cast("array<variant>")))), lambda t: text(t, "$.product_id") == product)
    price = lambda t, p: text(t, p).try_cast("decimal(28,10)")
    received, sent = S.first_text(text("payload", "$._recv_ts"), text("payload", "$.recv_ts")), S.first_text(text("payload", "$.timestamp"))
    return rows.select(
        "stream",
        F.col("sequence_num").alias("seq"),
        F.when(received.isNotNull(), F.col("recv_ns")).otherwise(S.iso_ns(sent)).alias("ns"),
        F.transform(F.filter("_events", lambda e: e["relevant"]), lambda e: F.struct(e["snapshot"].alias("snapshot"), e["updates"].alias("updates"))).alias("events"),
        "error",
        failure.alias("event_error"),
        F.col("sequence_bad").alias("bad_seq"),
        F.coalesce(received, sent).isNotNull().alias("bad_time"),
        is_l2.alias("l2"),
        F.sha2(F.to_json("payload"), 256).alias("digest"),
        F.when(is_ticker, F.transform(tickers, lambda t: F.struct(price(t, "$.best_bid").alias("bid"), price(t, "$.best_ask").alias("ask")))).alias("tickers"),
        "source_path",
        "source_line",
        *more,
    )


#: The orders of a replay: merged by time, or as the files are.
ORDERS = {"receive_time": ["ns", "seq", "source_path", "source_line"], "file": ["source_path", "source_line"]}
_READ = ["stream", "seq", "ns", "events", "error", "event_error", "bad_seq", "bad_time", "l2", "digest", "tickers"]


def _lists(column: pa.ListArray) -> tuple[list[int], pa.Array]:
    """(offsets from 0, values) of a column of lists; null ones are empty."""
    if not len(column):  # without rows, there may be no offset to read
        return [0], column.values.slice(0, 0)
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).tolist(), column.values.slice(offsets[0], offsets[-1] - offsets[0])


def batch_messages(batch: pa.RecordBatch) -> Iterator[tuple[str | None, Message]]:
    """(stream, message) of rows of ``_READ``; nested columns are read flat, once a batch."""
    seqs, times, errors, event_errors, bad_seqs, bad_times, l2s, digests = (batch.column(n).to_pylist() for n in ("seq", "ns", "error", "event_error", "bad_seq", "bad_time", "l2", "digest"))
    known = batch.column("events").is_valid().to_pylist()
    at, events = _lists(batch.column("events"))
    inner, updates = _lists(events.field("updates"))
    snapshots = events.field("snapshot").to_pylist()
    flat = list(zip(*(updates.field(n).to_pylist() for n in ("side", "price", "quantity")), strict=True))
    tick, tickers = _lists(batch.column("tickers"))
    quotes = list(zip(tickers.field("bid").to_pylist(), tickers.field("ask").to_pylist(), strict=True))
    for i, stream in enumerate(batch.column("stream").to_pylist()):
        own = [{"snapshot": bool(snapshots[j]), "updates": flat[inner[j] : inner[j + 1]]} for j in range(at[i], at[i + 1])] if known[i] else None
        yield stream, Message(seqs[i], times[i], own, errors[i], event_errors[i], bool(bad_seqs[i]), bool(bad_times[i]), bool(l2s[i]), digests[i], quotes[tick[i] : tick[i + 1]])


_WHOLE = {"seq", "ns", "epoch", "window_id", "first_seq", "first_ns", "last_seq", "last_ns", "states"}
_TEXT = {"kind", "reason"}


def as_batch(rows: list[tuple[str | None, dict]], product: str) -> pa.RecordBatch:
    """Rows of the replay, each with its stream, as the result's columns."""
    def levels(name: str) -> pa.Array:
        sides = [r.get(name) for _, r in rows]
        flat = [x for side in sides if side for x in side]
        # a list without an offset of its own is null
        ends, total = [], 0
        for side in sides:
            ends.append(None if side is None else total)
            total += len(side or ())
        pairs = pa.StructArray.from_arrays([pa.array([float(x[k]) for x in flat], pa.float64()) for k in (0, 1)], names=["price", "quantity"])
        return pa.ListArray.from_arrays(pa.array([*ends, total], pa.int32()), pairs)

    def column(name: str) -> pa.Array:
        if name.endswith("_levels"):
            return levels(name)
        values = [r.get(name) for _, r in rows]
        if name in _WHOLE or name in _TEXT or name == "truncated":
            return pa.array(values, pa.int64() if name in _WHOLE else pa.string() if name in _TEXT else pa.bool_())
        return pa.array([None if v is None else float(v) for v in values], pa.float64())

    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([product] * len(rows), pa.string()), *map(column, _NAMES)], names=["stream", "product", *_NAMES])


def reconstruct(envelopes: DataFrame, config: ReplayConfig = ReplayConfig(), product: str = "", order: str = "receive_time", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """States, quality events, ticker checks and windows (``kind``) of each stream, replayed in one of ORDERS; only rows of ``kinds``.

    A stream is one task, since its validity depends on everything before, but
    it passes through: a task holds the book, the numbers of an epoch and a
    batch of rows.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, replay = None, None
        for batch in batches:
            rows: list[tuple[str | None, dict]] = []
            for stream, m in batch_messages(batch):
                if replay is None or stream != at:
                    rows += [(at, r) for r in replay.finish() if r["kind"] in kinds] if replay else []
                    at, replay = stream, Replay(config)
                rows += [(at, r) for r in replay.apply(m) if r["kind"] in kinds]
            yield as_batch(rows, product)
        if replay:
            yield as_batch([(at, r) for r in replay.finish() if r["kind"] in kinds], product)

    rows = envelopes.repartition(TASKS, "stream").sortWithinPartitions("stream", *[F.asc_nulls_last(c) for c in ORDERS[order]])
    return rows.select(*_READ).mapInArrow(fold, f"stream string, product string, {RESULT}")


def boundary_is_continuous(windows: DataFrame, after: DataFrame) -> DataFrame:
    """Streams of ``reconstruct``'s windows with the first number of the records that follow (see ``l2_envelopes``), and whether it is the next one."""
    last = windows.where("kind = 'window'").groupBy("stream").agg(F.max_by("last_seq", F.struct("window_id", "last_ns")).alias("last_seq"))
    first = after.where("seq IS NOT NULL").groupBy("stream").agg(F.min_by("seq", F.struct("source_path", "source_line")).alias("next_seq"))
    return last.join(first, "stream", "left").withColumn("continuous", F.coalesce(F.col("next_seq") == F.col("last_seq") + 1, F.lit(False)))
