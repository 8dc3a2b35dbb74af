import json

import pytest

from tidewell.sources import live


class Line:
    def __init__(self, script):
        self.script, self.sent, self.closed = list(script), [], False

    def send(self, message):
        self.sent.append(json.loads(message))

    def receive(self, timeout):
        item = self.script.pop(0) if self.script else None
        if isinstance(item, Exception):
            raise item
        return item

    def close(self):
        self.closed = True


def test_reconnects_and_annotates():
    lines = [Line(['{"channel":"ticker"}', OSError("cut")]), Line(["[1]"])]
    made, pauses = [], []

    def connect():
        made.append(lines[len(made)])
        return made[-1]

    s = live.Session(connect, ["BTC-USD"], ["ticker", "heartbeats"], sleep=pauses.append)
    got = [json.loads(m) for m in s.poll(10)]
    assert [(m["channel"], m["_connection_epoch"], m["_received_frame_ordinal"]) for m in got] == [("ticker", 1, 1), ("malformed", 2, 2)]
    assert lines[0].closed and s.failures == ["receive: cut"] and len(pauses) == 1
    assert lines[0].sent == [{"type": "subscribe", "channel": "ticker", "product_ids": ["BTC-USD"]}, {"type": "subscribe", "channel": "heartbeats"}]


def test_silence_forces_a_new_connection():
    now = iter(range(0, 1000, 10))
    s = live.Session(lambda: Line([]), ["A-B"], ["ticker"], sleep=lambda _: None, clock=lambda: next(now))
    assert list(s.poll(3)) == [] and list(s.poll(3)) == [] and s.failures == ["silence"] * len(s.failures) and s.failures


def test_config_is_checked():
    with pytest.raises(ValueError):
        live.subscriptions(["A-B", "A-B"], ["ticker"])


def test_stream_of_a_session(spark):
    def session():
        import json as j

        class Quiet:
            def __init__(self):
                self.script = [j.dumps({"channel": "ticker", "n": i}) for i in range(5)]

            def send(self, message): ...

            def receive(self, timeout):
                return self.script.pop(0) if self.script else None

            def close(self): ...

        return live.Session(Quiet, ["A-B"], ["ticker"], sleep=lambda _: None)

    spark.dataSource.register(live.live_source(session))
    q = spark.readStream.format("live_capture").load().writeStream.format("memory").queryName("lines").trigger(processingTime="1 second").start()
    import time

    for _ in range(60):
        time.sleep(0.5)
        if spark.table("lines").count() >= 5:
            break
    q.stop()
    assert sorted(json.loads(r.raw_line)["n"] for r in spark.table("lines").collect()) == [0, 1, 2, 3, 4]
