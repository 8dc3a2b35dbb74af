"""A live message source with an injectable connection: receive, annotate, reconnect with growing pauses."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any, Protocol

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class Connection(Protocol):
    """What a transport must offer; ``receive`` returns None when nothing came within the timeout."""

    def send(self, message: str) -> None: ...

    def receive(self, timeout: float) -> str | None: ...

    def close(self) -> None: ...


Connect = Callable[[], Connection]


def subscriptions(products: list[str], channels: list[str]) -> list[dict[str, Any]]:
    """One subscription message per channel; heartbeats name no products."""
    for name, values in (("products", products), ("channels", channels)):
        if len(set(values)) != len(values):
            raise ValueError(f"{name} repeat")
    return [{"type": "subscribe", "channel": c} | ({} if c == "heartbeats" else {"product_ids": products}) for c in channels]


def annotated(text: str, epoch: int, ordinal: int, now: datetime) -> str:
    """The message with its receive time, connection and frame number; text that isn't an object is wrapped."""
    try:
        message = json.loads(text)
    except ValueError:
        message = None
    if not isinstance(message, dict):
        message = {"channel": "malformed", "raw": text}
    message |= {"_recv_ts": now.isoformat(timespec="microseconds").replace("+00:00", "Z"), "_connection_epoch": epoch, "_received_frame_ordinal": ordinal}
    return json.dumps(message, separators=(",", ":"))


class Session:
    """Keeps a connection: subscribes after each connect, reconnects after failures or silence."""

    def __init__(self, connect: Connect, products: list[str], channels: list[str], silence: float = 15.0, pause: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.connect, self.messages = connect, [json.dumps(s) for s in subscriptions(products, channels)]
        self.silence, self.first_pause, self.longest, self.sleep, self.clock = silence, pause, longest, sleep, clock
        self.link: Connection | None = None
        self.epoch = self.ordinal = 0
        self.pause, self.heard = pause, 0.0
        self.failures: list[str] = []

    def _open(self) -> None:
        while self.link is None:
            try:
                self.link = self.connect()
                for m in self.messages:
                    self.link.send(m)
                self.epoch, self.pause, self.heard = self.epoch + 1, self.first_pause, self.clock()
            except OSError as e:
                self._drop(f"connect: {e}")

    def _drop(self, why: str) -> None:
        self.failures.append(why)
        if self.link is not None:
            self.link.close()
        self.link = None
        self.sleep(self.pause * random.uniform(0.5, 1.0))
        self.pause = min(self.longest, self.pause * 2)

    def poll(self, most: int, timeout: float = 5.0) -> Iterator[str]:
        """Up to ``most`` annotated messages; fewer when the line is quiet."""
        for _ in range(most):
            self._open()
            try:
                text = self.link.receive(timeout)
            except OSError as e:
                self._drop(f"receive: {e}")
                continue
            if text is None:
                if self.clock() - self.heard > self.silence:
                    self._drop("silence")
                return
            self.heard = self.clock()
            self.ordinal += 1
            yield annotated(text, self.epoch, self.ordinal, datetime.now(timezone.utc))


def live_source(session: Callable[[], Session], name: str = "live_capture", batch: int = 1000) -> type[DataSource]:
    """A streaming data source over a session; a batch is kept until Spark has committed it."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self) -> None:
            self.session: Session | None = None
            self.kept: dict[int, list[tuple[str]]] = {}

        def initialOffset(self) -> dict:
            return {"at": 0}

        def read(self, start: dict):
            self.session = self.session or session()
            rows = [(m,) for m in self.session.poll(batch)]
            end = start["at"] + len(rows)
            if rows:
                self.kept[start["at"]] = rows
            return iter(rows), {"at": end}

        def readBetweenOffsets(self, start: dict, end: dict):
            rows = [r for at in sorted(self.kept) if start["at"] <= at < end["at"] for r in self.kept[at]]
            return iter(rows)

        def commit(self, end: dict) -> None:
            self.kept = {at: r for at, r in self.kept.items() if at >= end["at"]}

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "raw_line string"

        def simpleStreamReader(self, schema) -> Reader:
            return Reader()

    return Source
