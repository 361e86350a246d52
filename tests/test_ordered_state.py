"""The ordered state by itself: how often it goes to the store, and that runs and pages keep the order."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from lexiloom.streaming import state

SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("seq", "at_micros", "opening", "amount")] + [T.StructField("kind", T.StringType())])


class Store:
    """Stands in for the state of one key and counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _state(self):
        held = {}

        def call(name):
            def run(*args):
                self.calls += 1
                if name in ("update", "updateValue"):
                    held[args[0] if name == "updateValue" else ()] = args[-1]
                elif name in ("clear", "removeKey"):
                    held.pop(args[0] if args else (), None)
                else:
                    return held.get(args[0] if args else ())

            return run

        return SimpleNamespace(held=held, **{n: call(n) for n in ("get", "update", "clear", "getValue", "updateValue", "removeKey")})

    def getValueState(self, name, schema):
        return self._state()

    def getMapState(self, name, key, value):
        self.pages = self._state()
        return self.pages

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def expire(self, processor, watermark):
        out = []
        for at in sorted(t for t in self.timers if t <= watermark):
            self.timers.remove(at)
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
            out += processor.handleExpiredTimer(None, times, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
        return out


def rows_of(n: int, seed: int) -> list[Row]:
    dice = random.Random(seed)
    make = Row(*SCHEMA.names)
    return [make(i, dice.randrange(n * 500), 500, dice.randrange(1, 90), dice.choice(["add", "subtract"])) for i in range(n)]


def made() -> tuple[Store, state.CreditProcessor]:
    store, processor = Store(), state.CreditProcessor(SCHEMA, "seq")
    processor.init(store)
    return store, processor


def replayed(rows: list[Row]) -> list[tuple]:
    balance, out = 500, []
    for r in sorted(rows, key=lambda r: (r.at_micros, r.seq)):
        verdict, balance = state.move(r.kind, r.amount, balance)
        out.append((r.seq, verdict, balance))
    return out


def test_calls_grow_with_pages_not_with_rows():
    store, processor = made()
    rows = rows_of(3000, 1)
    assert list(processor.handleInputRows(None, iter(rows), None)) == []
    got = store.expire(processor, 10**9)
    assert [(r.seq, r.verdict, r.balance) for r in got] == replayed(rows)
    assert store.calls < 3 * 3000 / state.PAGE_ROWS + 20  # ten and more for each row before
    assert not store.timers and not store.pages.held


@pytest.mark.parametrize("run_rows, page_rows", [(64, 8), (10, 16), (1, 1)])
def test_runs_of_many_triggers_come_out_in_order_of_time(monkeypatch, run_rows, page_rows):
    monkeypatch.setattr(state, "RUN_ROWS", run_rows)
    monkeypatch.setattr(state, "PAGE_ROWS", page_rows)
    store, processor = made()
    rows = rows_of(400, 2)
    got, waiting = [], list(rows)
    for watermark in (0, 30, 31, 90, 150, 10**9):
        # Rows come in any order, but none that the watermark has passed.
        chosen = [r for r in waiting if r.at_micros < (watermark + 60) * 1000]
        waiting = [r for r in waiting if r not in chosen]
        random.Random(watermark).shuffle(chosen)
        for start in range(0, len(chosen), 37):
            list(processor.handleInputRows(None, iter(chosen[start : start + 37]), None))
        got += store.expire(processor, watermark)
        assert all(r.at_micros // 1000 < watermark for r in got)
    assert [(r.seq, r.verdict, r.balance) for r in got] == replayed(rows)
    assert not store.pages.held


def test_an_entry_is_forgotten_when_the_watermark_has_passed_it():
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at_micros", T.LongType()), T.StructField("can_keep", T.BooleanType())])
    store, processor = Store(), state.CacheProcessor(schema, "id", 2_000_000)
    processor.init(store)
    make = Row(*schema.names)
    rows = [make(1, 0, True), make(2, 1_999_999, True), make(3, 2_000_000, False), make(4, 5_000_000, True), make(5, None, True)]
    assert [(r.id, r.hit) for r in processor.handleInputRows(None, iter(rows), None)] == [(5, False)]
    assert [(r.id, r.hit) for r in store.expire(processor, 5_001)] == [(1, False), (2, True), (3, False), (4, False)]
    assert processor.recall() == 7_000_000
    assert store.expire(processor, 7_001) == [] and processor.recall() is None
