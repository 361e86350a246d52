"""The answer log: repeated tasks don't ask again, failures keep their cause."""

import os

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.answer_log import AnswerLog, answer_key
from lexiloom.functions.inference import _asked, constant_factory, log_bucket
from lexiloom.operators.memory import tm_misses, with_key
from lexiloom.plans.translation import empty_memory, translate_misses


def noting(folder, dies_after=None):
    """A service that notes each call; its worker dies once after so many calls."""

    def factory():
        def call(text):
            calls = os.path.join(folder, "calls")
            with open(calls, "a") as out:
                out.write(text + "\n")
            died = os.path.join(folder, "died")
            if dies_after is not None and not os.path.exists(died) and sum(1 for _ in open(calls)) >= dies_after:
                open(died, "w").close()
                os._exit(1)
            return text.upper()

        return call

    return factory


def misses_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return tm_misses(with_key(rows, "vi", "General"), empty_memory(spark))


@pytest.mark.parametrize("tasks", [1, 3])
def test_a_task_that_dies_pays_once_for_kept_answers(spark, tmp_path, tasks):
    texts = [f"text number {i}" for i in range(40)]
    log = AnswerLog(str(tmp_path / "log"), buckets=4, answers=1)
    service = noting(str(tmp_path), dies_after=20)
    misses = misses_of(spark, texts)
    with pytest.raises(Exception):  # noqa: B017 - a local session does not repeat tasks; the job is run again instead
        translate_misses(misses, service, protect=None, tasks=tasks, log=log).collect()
    # The other tasks may have gone on after the death.
    stored = sum(len(log.open()._read(b)) for b in range(4))
    assert stored >= 19
    got = translate_misses(misses, service, protect=None, tasks=tasks + 1, log=log).collect()
    assert sorted(r["target"] for r in got) == sorted(t.upper() for t in texts)
    calls = open(tmp_path / "calls").read().splitlines()
    assert set(calls) == set(texts) and len(calls) - len(texts) <= tasks  # the text each dying worker was asking for
    again = translate_misses(misses, service, protect=None, tasks=2, log=log).collect()
    assert len(again) == 40 and len(open(tmp_path / "calls").read().splitlines()) == len(calls)


def test_failures_keep_their_cause_and_are_asked_again(spark, tmp_path):
    def answer(text):
        if "bad" in text:
            raise ValueError(f"no answer to {text}")
        return text.upper()

    log = AnswerLog(str(tmp_path / "log"), buckets=2)
    misses = misses_of(spark, ["good", "bad one"])
    for _ in range(2):
        got = {r["source"]: (r["target"], r["outcome"], r["error"]) for r in translate_misses(misses, constant_factory(answer), protect=None, attempts=2, log=log).collect()}
        assert got == {"good": ("GOOD", "translated", None), "bad one": ("bad one", "failed", "ValueError: no answer to bad one")}


def test_pauses_double(monkeypatch):
    from lexiloom.functions import inference

    waited = []
    monkeypatch.setattr(inference.time, "sleep", waited.append)

    def busy():
        raise TimeoutError("busy")

    assert _asked(busy, 4, 0.5) == (None, "TimeoutError: busy") and waited == [0.5, 1.0, 2.0]


def test_rows_come_in_order_of_the_logs_buckets(spark, tmp_path):
    log = AnswerLog(str(tmp_path), buckets=8)
    texts = ["a", "é", "中文", "\U0001f600 smile", ""]
    rows = spark.createDataFrame([(t, "vi|General") for t in texts], "text string, context string")
    got = {r[0]: r[1] for r in rows.select("text", log_bucket(log, "text", "context")).collect()}
    assert got == {t: int(answer_key("vi|General", t), 16) % 8 for t in texts}
    with pytest.raises(ValueError):
        AnswerLog(str(tmp_path), buckets=6)


def test_a_log_read_back_by_another_task(tmp_path):
    log = AnswerLog(str(tmp_path), buckets=2, answers=3)
    one = log.open()
    keys = [answer_key(str(i)) for i in range(10)]
    for key in sorted(keys, key=lambda k: int(k, 16) % 2):
        assert one.answer(key) is None
        one.keep(key, "to " + key)
    one.flush()
    other = log.open()
    assert [other.answer(k) for k in keys] == ["to " + k for k in keys]
    assert other.answer(answer_key("unknown")) is None
