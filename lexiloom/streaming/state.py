"""Ordered state per key: the streaming forms of the cache and credit replays and of job progress.

Files reach a stream in any order, but a balance or a cache entry depends on
the order of time. So rows wait in state until the watermark has passed the
millisecond of their event time; then no earlier row can come, and they are
folded, with the same helper as in the batch form, and given out. What waits is
bounded by `lateness` and stays in the state store, on disk; a task holds at
most `RUN_ROWS` rows of one key, and later a page of `PAGE_ROWS` from each of its
sorted runs. Rows later than `lateness` are dropped, and counted
(`streaming.late`). Rows without a time have no order to wait for; they are
folded as they come. Helper columns have no leading underscore here: the
stateful API hands rows over as named tuples, which do not take such names.
"""

from __future__ import annotations

import heapq
import pickle
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.text import micros
from lexiloom.operators.cache import SECOND, serve
from lexiloom.operators.credits import NO_USER, move
from lexiloom.operators.jobs import progress_columns

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    """The state store these operators need; large state stays on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


#: Rows that are sorted at once, and rows that are stored together.
RUN_ROWS, PAGE_ROWS = 16384, 128


@dataclass
class _Run:
    """Sorted rows on pages from `page` up to `pages`, the first of them due at `due`."""

    number: int
    page: int
    pages: int
    rows: int
    due: int


@dataclass
class _Waiting:
    """What waits for a key: its timer, the number of the last run, and the runs."""

    timer: int | None
    last: int
    runs: list[_Run]


class _InOrder(StatefulProcessor):
    """Folds the rows of a key in order of time, and remembers one number between them.

    Every call to the state store is a trip to the JVM, so rows wait in sorted
    runs of pages, and a key has one timer, for the first row that waits. Runs
    are merged page by page.
    """

    def __init__(self, waiting: T.StructType, tie: str, added: Sequence[str]):
        self._waiting, self._tie, self._added = waiting, tie, added

    def init(self, handle) -> None:
        self._handle = handle
        self._number = handle.getValueState("number", "value BIGINT")
        self._runs = handle.getValueState("runs", "timer BIGINT, last INT, runs BINARY")
        self._pages = handle.getMapState("pages", "run INT, page INT", "rows BINARY")
        self._row, self._out = Row(*self._waiting.names), Row(*self._waiting.names, *self._added)
        self._at, self._tie_at = self._waiting.names.index("at_micros"), self._waiting.names.index(self._tie)

    def recall(self) -> int | None:
        found = self._number.get()
        return None if found is None else int(found[0])

    def keep(self, value: int | None) -> None:
        if value is not None:
            self._number.update((int(value),))

    def fold(self, row: Row, number: int | None) -> tuple[tuple, int | None]:
        """The values added to the row, and the number to remember."""
        raise NotImplementedError

    def folded(self, rows: Iterable[tuple], passed: int | None = None) -> Iterator[Row]:
        before = number = self.recall()
        for row in rows:
            added, number = self.fold(self._row(*row), number)
            yield self._out(*row, *added)
        if passed is not None and self.forgets(number, passed):
            if before is not None:
                self._number.clear()
        elif number != before:
            self.keep(number)

    def forgets(self, number: int | None, watermark: int) -> bool:
        """Whether the number means nothing any more for rows after the watermark."""
        return False

    def _order(self, row: tuple) -> tuple:
        return row[self._at], row[self._tie_at] is not None, row[self._tie_at]

    def _due(self, row: tuple) -> int:
        return row[self._at] // 1000 + 1  # a watermark that this row's millisecond is before

    def _write(self, run: int, page: int, rows: list[tuple]) -> None:
        self._pages.updateValue((run, page), (pickle.dumps(rows),))

    def _read(self, run: int, page: int) -> list[tuple]:
        return pickle.loads(self._pages.getValue((run, page))[0])

    def _add_run(self, held: _Waiting, rows: list[tuple]) -> None:
        """Rows as a new run; a last run of one page is taken in while all fit on it."""
        while held.runs and held.runs[-1].rows + len(rows) <= PAGE_ROWS and held.runs[-1].pages == held.runs[-1].page + 1:
            last = held.runs.pop()
            rows = self._read(last.number, last.page) + rows
            self._pages.removeKey((last.number, last.page))
        rows.sort(key=self._order)
        held.last += 1
        for page, start in enumerate(range(0, len(rows), PAGE_ROWS)):
            self._write(held.last, page, rows[start : start + PAGE_ROWS])
        held.runs.append(_Run(held.last, 0, page + 1, len(rows), self._due(rows[0])))

    def _due_of(self, run: _Run, watermark: int) -> Iterator[tuple]:
        """The rows of a run that the watermark has passed; the run begins after them then."""
        while run.page < run.pages:
            rows = self._read(run.number, run.page)
            n = bisect_right(rows, watermark, key=self._due)
            yield from rows[:n]
            run.rows -= n
            if n < len(rows):
                run.due = self._due(rows[n])
                if n:
                    self._write(run.number, run.page, rows[n:])
                return
            self._pages.removeKey((run.number, run.page))
            run.page += 1

    def _recall_waiting(self) -> _Waiting:
        found = self._runs.get()
        return _Waiting(None, 0, []) if found is None else _Waiting(found[0], found[1], [_Run(*run) for run in pickle.loads(found[2])])

    def _keep_waiting(self, held: _Waiting) -> None:
        """Keeps the list of runs, with a timer for the first row of all."""
        if not held.runs:
            self._runs.clear()
            return
        due = min(run.due for run in held.runs)
        if held.timer is None or due < held.timer:
            self._handle.registerTimer(due)  # a later one finds nothing due and does no harm
            held.timer = due
        self._runs.update((held.timer, held.last, pickle.dumps([astuple(run) for run in held.runs])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, fresh = None, []

        def untimed() -> Iterator[tuple]:
            nonlocal held, fresh
            for row in rows:
                if row["at_micros"] is None:
                    yield tuple(row)
                    continue
                fresh.append(tuple(row))
                if len(fresh) == RUN_ROWS:
                    held = held or self._recall_waiting()
                    self._add_run(held, fresh)
                    fresh = []

        yield from self.folded(untimed())
        if fresh:
            held = held or self._recall_waiting()
            self._add_run(held, fresh)
        if held:
            self._keep_waiting(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, watermark = self._recall_waiting(), timerValues.getCurrentWatermarkInMs()
        due = [run for run in held.runs if run.due <= watermark]
        yield from self.folded(heapq.merge(*[self._due_of(run, watermark) for run in due], key=self._order), watermark)
        if due:
            held.timer, held.runs = None, [run for run in held.runs if run.page < run.pages]
            self._keep_waiting(held)

    def close(self) -> None:
        pass


class CacheProcessor(_InOrder):
    """Remembers when the key's entry expires, and forgets entries that the watermark has passed."""

    def __init__(self, waiting: T.StructType, tie: str, ttl: int):
        super().__init__(waiting, tie, ("hit",))
        self._ttl = ttl

    def fold(self, row, number):
        hit, expires = serve(row["at_micros"], row["can_keep"], number, self._ttl)
        return (hit,), expires

    def keep(self, value) -> None:
        super().keep(value)
        if value is not None:
            self._handle.registerTimer(value // 1000 + 1)

    def forgets(self, number, watermark) -> bool:
        return number is not None and number < watermark * 1000


class CreditProcessor(_InOrder):
    """Remembers the balance. Rows whose `opening` is missing are of nobody and change nothing."""

    def __init__(self, waiting: T.StructType, tie: str):
        super().__init__(waiting, tie, ("verdict", "balance"))

    def fold(self, row, number):
        if row["opening"] is None:
            return (NO_USER, None), number
        verdict, balance = move(row["kind"], row["amount"], row["opening"] if number is None else number)
        return (verdict, balance), balance


class StartProcessor(_InOrder):
    """Remembers the job's first real start time, in microseconds; NULL and 0 are none."""

    def __init__(self, waiting: T.StructType, tie: str):
        super().__init__(waiting, tie, ("job_start",))

    def fold(self, row, number):
        if number is None and row["started_at"]:
            number = int(round(row["started_at"] * SECOND))
        return (None if number is None else number / SECOND,), number


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


LATENESS = "10 minutes"


def _waiting_for(rows: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Rows with their time as a number, and the watermark that they wait for."""
    use_state_store(rows.sparkSession)
    return rows.withColumn("at_micros", micros(F.col(ts))).withColumn("event_time", F.timestamp_micros("at_micros")).withWatermark("event_time", lateness)


def _in_order(rows: DataFrame, key: str, processor, *added: T.StructField) -> DataFrame:
    """`processor` is made with the rows' schema; state holds no copy of the key."""
    stateful = rows.groupBy(key).transformWithState(
        statefulProcessor=processor(rows.schema), outputStructType=_with(rows.schema, *added), outputMode="Append", timeMode="EventTime"
    )
    return stateful.drop("event_time")


def stream_cache_replay(
    requests: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str = "id",
    storable: str | None = None,
    ttl_seconds: int = fixed.CACHE_SECONDS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Adds `hit` to a stream of requests, as `ttl_cache_replay` does, whatever the order of its files up to `lateness`."""
    timed = _waiting_for(requests, ts, lateness).withColumn("can_keep", F.coalesce(F.col(storable), F.lit(False)) if storable else F.lit(True))
    replayed = _in_order(timed, key, lambda schema: CacheProcessor(schema, tie, ttl_seconds * SECOND), T.StructField("hit", T.BooleanType()))
    return replayed.drop("at_micros", "can_keep")


def stream_credit_replay(
    events: DataFrame, accounts: DataFrame | None = None, start: int = fixed.START_CREDITS, lateness: str = LATENESS
) -> DataFrame:
    """Adds `verdict` and `balance` to a stream of movements, as `replay_credits` does.

    `accounts` is a table, read anew in each trigger. Balances are kept for
    good: an account has no end.
    """
    timed = _waiting_for(events, "ts", lateness)
    if accounts is None:
        timed = timed.withColumn("opening", F.lit(start).cast("long"))
    else:
        timed = timed.join(accounts.select("user_id", F.col("credits").cast("long").alias("opening")), "user_id", "left")
    added = T.StructField("verdict", T.StringType()), T.StructField("balance", T.LongType())
    return _in_order(timed, "user_id", lambda schema: CreditProcessor(schema, "seq"), *added).drop("at_micros", "opening")


def stream_job_progress(events: DataFrame, job: str = "job_id", lateness: str = LATENESS) -> DataFrame:
    """Adds percent, elapsed time, ETA and speed to a stream of status events."""
    timed = _waiting_for(events, "ts", lateness)
    started = _in_order(timed, job, lambda schema: StartProcessor(schema, "seq"), T.StructField("job_start", T.DoubleType()))
    now = F.col("at_micros") / SECOND
    columns = progress_columns(F.col("job_start"), now, F.col("current"), F.col("total"))
    return started.withColumns(columns).drop("at_micros", "job_start")
