from decimal import Decimal as D

import pytest

from tidewell.operators import fees, grid_sim, reserve_sim
from tidewell.operators.book_fold import Book, bbo_rows
from tidewell.operators.book_replay import Message, Replay, ReplayConfig
from tidewell.operators.features import FeatureState

FREE = fees.FeeSchedule(D(0), D(0))


def test_rebates_stop_at_the_cap():
    meter = fees.FeeMeter(fees.FeeSchedule(D("0.01"), D("0.02"), D("0.5"), D(2)))
    got = [meter.charge(D(100), "taker").rebate for _ in range(4)]
    assert got == [D(1), D(1), D(0), D(0)]
    with pytest.raises(ValueError):
        fees.FeeSchedule(D(-1), D(0))


def test_candle_grid_fees():
    """One candle over a grid of 1 to 5: three fills of 10 with 1 % fee and a quarter back."""
    run = grid_sim.CandleGrid(grid_sim.levels_of(D(1), D(5), 4), D(100), D(0), D(10), fees.FeeSchedule(D("0.01"), D("0.01"), D("0.25"), D(100)))
    rows = run.step(0, D(3), D("3.5"), D(1), D(3))
    filled = [r for r in rows if r["status"] == "filled"]
    assert [(r["side"], r["level"]) for r in filled] == [("buy", 1), ("buy", 0), ("sell", 1), ("sell", 2)]
    gross = sum(r["fee_gross"] for r in filled)
    assert gross == D("0.1") * len(filled) and run.purse.rebates == gross / 4


@pytest.mark.parametrize("low_first,expected", [(True, 1), (False, 0)])
def test_same_candle_round_trip_needs_the_low_first(low_first, expected):
    run = grid_sim.CandleGrid([D(1), D(2), D(3)], D(100), D(0), D(10), FREE, low_first)
    rows = run.step(0, D(2), D("2.5"), D(1), D(2))
    sells = [r for r in rows if r["side"] == "sell" and r["status"] == "filled"]
    assert len(sells) == expected


def test_missed_orders_are_gone():
    run = grid_sim.CandleGrid([D(1), D(2), D(3)], D(5), D(0), D(10), FREE)
    assert [r["status"] for r in run.step(0, D(2), D(2), D(1), D(2)) if r["kind"] == "fill"] == ["missed"]
    assert [r for r in run.step(1, D(2), D(2), D(1), D(2)) if r["kind"] == "fill"] == []


def book(**kw):
    args = {"levels": [D(100), D(110)], "start": 1, "quote": D(200), "base": D(0), "order_quote": D(100), "fees": fees.FeeSchedule(D("0.01"), D("0.02"))} | kw
    return grid_sim.BookGrid(**args)


def fills(rows):
    return [r for r in rows if r["kind"] == "fill"]


def test_touch_is_no_fill_and_price_through_fills_at_the_limit():
    run = book()
    assert not fills(run.step(0, 0, D(101), [(D(99), D(5))], [(D(103), D(5))]))
    assert not fills(run.step(1, 1, D(100), [(D(99), D(5))], [(D(100), D(5))]))
    got = fills(run.step(2, 2, D(99), [(D(98), D(5))], [(D("99.5"), D(5))]))
    assert len(got) == 1 and got[0]["liquidity"] == "maker"
    assert (got[0]["base"], got[0]["notional"], got[0]["fee_gross"], run.purse.quote) == (D(1), D(100), D(1), D(99))


def test_arrival_takes_visible_depth():
    """An order of 52 at 52 eats two levels of 0.25 and half of the third: 12.5 + 12.75 + 26 for one."""
    run = book(levels=[D(52), D(60)], order_quote=D(52))
    got = fills(run.step(0, 0, D(50), [(D(49), D(9))], [(D(50), D("0.25")), (D(51), D("0.25")), (D(52), D(1))]))
    assert (got[0]["base"], got[0]["price"], got[0]["fee_gross"], run.purse.quote) == (D(1), D("51.25"), D("1.025"), D("147.725"))


def test_depth_comes_back_only_by_what_is_new():
    depth = grid_sim.ShadowDepth()
    depth.observe([], [(D(100), D(1))])
    assert depth.take("ask", D(100), D(1), False) == (D(1), D(100))
    depth.observe([], [(D(100), D(1))])
    assert depth.best("ask") is None
    depth.observe([], [])
    depth.observe([], [(D(100), D("1.5"))])
    assert depth.left("ask", D(100)) == D("0.5")


def test_latency_delays_arrival_and_window_end_cancels():
    run = book(latency_ms=1)
    assert not [r for r in run.step(0, 0, D(90), [(D(89), D(5))], [(D(91), D(5))]) if r["kind"] == "fill"]
    assert fills(run.step(1, 2_000_000, D(90), [(D(89), D(5))], [(D(91), D(5))]))[0]["liquidity"] == "taker"
    with pytest.raises(ValueError):
        run.step(1, 3_000_000, D(90), [], [])
    assert {r["status"] for r in run.finish() if r["kind"] == "order"} == {"canceled_window_end"}


def reserve(**kw):
    base = {"lower": D(90), "upper": D(110), "band_width": D(10), "levels_per_band": 2, "band_cap": D(100), "quote_start": D(500), "exit_move": D("0.05"), "profit_bps": D(20)}
    return reserve_sim.ReserveConfig(**(base | kw))


def test_reserve_lot_sells_only_what_is_needed():
    run, rows = reserve_sim.play(reserve(), FREE, [(0, D(101), D(101), D(99), D(100)), (60, D(100), D(106), D(100), D(105))])
    lots = [r for r in rows if r["event"] == "lot"]
    done = [r for r in lots if r["reason"] == "completed"]
    assert len(lots) == 2 and len(done) == 1 and done[0]["price"] == D(100)  # the other is bought on the way back down
    assert run.reserve_base > 0 and run.cash + run.active_cost() > D(500)


def test_reserve_guard_blocks_until_warm():
    candles = [(60 * i, D(101), D(101), D(99), D(100)) for i in range(4)]
    run, _ = reserve_sim.play(reserve(guard=(1, 3)), FREE, candles)
    assert run.missed.get("guard_warmup") and not [x for x in run.lots if x.entry_ts < 180]


def test_reserve_infeasible_slot_is_disabled():
    run, rows = reserve_sim.play(reserve(exit_move=D("0.0001")), FREE, [(0, D(101), D(101), D(99), D(100))])
    assert any(r["event"] == "slot_disabled" for r in rows) and not run.lots


def test_reserve_config_is_checked():
    with pytest.raises(ValueError):
        reserve(band_width=D(7))


def l2(*updates, snapshot=False):
    return [{"snapshot": snapshot, "updates": [(s, D(p), D(q)) for s, p, q in updates]}]


SNAP = l2(("bid", 99, 1), ("ask", 101, 1), snapshot=True)


def test_replay_gap_is_sticky_until_a_snapshot():
    r = Replay()
    rows = r.step(0, 0, SNAP) + r.step(1, 1, l2(("bid", 98, 1))) + r.step(2, 2, None) + r.step(4, 4, l2(("bid", 97, 1))) + r.step(5, 5, l2(("bid", 97, 0))) + r.step(6, 6, SNAP) + r.finish()
    assert [x["seq"] for x in rows if x["kind"] == "state"] == [0, 1, 6]
    windows = [x for x in rows if x["kind"] == "window"]
    assert [(w["first_seq"], w["last_seq"]) for w in windows] == [(0, 2), (6, 6)]
    assert sum(x["reason"] == "update_ignored_while_invalid" for x in rows) == 2


def test_replay_stale_gap_lets_the_same_snapshot_in():
    r = Replay(ReplayConfig(max_gap_ns=1))
    rows = r.step(0, 0, SNAP) + r.step(1, 3, SNAP)
    assert [x["window_id"] for x in rows if x["kind"] == "state"] == [1, 2]


@pytest.mark.parametrize("seq,events,reason", [(7, SNAP, "sequence_duplicate"), (7, l2(("bid", 98, 1)), "sequence_conflict"), (9, SNAP, "sequence_gap")])
def test_replay_repeats_and_gaps_invalidate(seq, events, reason):
    r = Replay()
    r.step(7, 0, SNAP)
    rows = r.step(seq, 1, events)
    assert reason in [x["reason"] for x in rows] and [x["kind"] for x in rows][:2] == ["quality", "window"]
    assert r.valid == (reason == "sequence_gap")  # only there the snapshot may be used


def test_replay_reconnect_begins_an_epoch_and_a_snapshot_recovers():
    r = Replay()
    rows = r.step(40, 0, SNAP) + r.step(41, 1, l2(("bid", 98, 1))) + r.step(3, 2, l2(("bid", 97, 1))) + r.step(4, 3, SNAP) + r.step(5, 4, l2(("bid", 96, 1))) + r.finish()
    assert [(x["epoch"], x["seq"]) for x in rows if x["kind"] == "state"] == [(0, 40), (0, 41), (1, 4), (1, 5)]
    assert [x["reason"] for x in rows if x["kind"] == "quality"] == ["sequence_regression", "update_ignored_while_invalid"]
    assert [(x["epoch"], x["first_seq"], x["last_seq"]) for x in rows if x["kind"] == "window"] == [(0, 40, 41), (1, 4, 5)]


@pytest.mark.parametrize("message,reason", [(Message(None, 5, SNAP, l2=True), "missing_sequence"), (Message(2, None, SNAP, l2=True), "missing_timestamp"), (Message(2, None, SNAP, l2=True, bad_time=True), "malformed_timestamp"), (Message(None, 5, SNAP, l2=True, bad_seq=True), "malformed_sequence"), (Message(2, 5, SNAP, l2=True, event_error="updates_not_list"), "updates_not_list")])
def test_replay_needs_number_time_and_whole_events(message, reason):
    r = Replay()
    assert [x["reason"] for x in r.apply(message)] == [reason] and not r.valid and not r.window
    r = Replay()
    r.step(1, 4, SNAP)
    assert [x["reason"] for x in r.apply(message)] == [reason, reason] and not r.valid  # the window closes too


def test_replay_backward_clock_is_not_used():
    r = Replay()
    rows = r.step(0, 9, SNAP) + r.step(1, 4, SNAP) + r.step(2, 5, SNAP)
    assert [(x["seq"], x["window_id"]) for x in rows if x["kind"] == "state"] == [(0, 1), (2, 2)]


def test_replay_compares_tickers():
    r = Replay(ReplayConfig(ticker_tolerance=D(1)))
    r.step(0, 0, SNAP)
    quotes = [(D(99), D(101)), (D("98.5"), D(101)), (D(50), D(101)), (D(101), D(101)), (None, D(1))]
    rows = r.apply(Message(1, 1, tickers=quotes))
    assert [x["reason"] for x in rows] == ["exact", "within_tolerance", "mismatch", "rejected_bbo", "without_bbo"] and rows[2]["bid_delta"] == 49


@pytest.mark.parametrize("update,reason", [(("bid", 101, 1), "locked"), (("bid", 102, 1), "crossed"), (("bid", 99, 0), "empty_side"), (("bid", -1, 1), "bad_update")])
def test_replay_invariants(update, reason):
    r = Replay()
    r.step(0, 0, SNAP)
    assert reason in [x["reason"] for x in r.step(1, 1, l2(update))]


def test_book_levels_and_actions():
    b = Book()
    assert [b.set("bid", 1, 2), b.set("bid", 1, 3), b.set("bid", 2, 1), b.set("bid", 1, 0), b.set("bid", 1, 0)] == ["add", "replace", "add", "delete", "missing_delete"]
    assert b.levels("bid", 5) == [(2, 1)] and b.depth["bid"] == 1
    assert list(bbo_rows([(0, "bid", 1, 1), (1, "ask", 2, 1)]))[-1] == (1, 1, 2, 1, 1)


def test_features_need_both_sides_and_keep_the_last_n_trades():
    f = FeatureState(2)
    f.update("buy", 10, 1)
    assert f.row() is None
    f.update("offer", 9, 3)
    for side, size in (("buy", 5), ("sell", 1), ("buy", 1)):
        f.trade(side, size)
    row = f.row()
    assert row[-1] == "crossed_book" and row[7] == 0 and row[6] == -0.5
