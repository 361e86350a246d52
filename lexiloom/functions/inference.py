"""Hooks for user functions: translation, grading and embedding.

The user gives a *factory*: it is called once per task and returns the function,
so clients and models are made once per task and never travel over the network.
Spark may run a task twice, so the function must be safe to repeat; a log of
answers keeps a repeated task from paying twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.answer_log import AnswerLog, answer_key

Factory = Callable[[], Callable]


def constant_factory(fn: Callable) -> Factory:
    """A factory for a function that needs no set-up."""
    return lambda: fn


def _asked(fn: Callable, attempts: int, pause: float, *args) -> tuple[object, str | None]:
    """(the function's answer, None), or (None, the last failure); `pause` seconds between tries, twice as long each time."""
    error = None
    for attempt in range(max(1, attempts)):
        if attempt and pause:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            return fn(*args), None
        except Exception as problem:  # noqa: BLE001 - any failure of the service counts as one
            error = f"{type(problem).__name__}: {problem}"
    return None, error


def _tried(fn: Callable, attempts: int, *args):
    """The function's answer, or None after the last failed attempt."""
    return _asked(fn, attempts, 0, *args)[0]


def text_hook(factory: Factory, attempts: int = 3, pause: float = 0, log: AnswerLog | None = None) -> Callable[..., Column]:
    """(text, what else decides its answer) -> `answer` and `error`; the answer is NULL and the error is not where the function failed.

    With a `log`, answers that were kept are not asked for again; failures are
    not kept. Rows should come in order of their log's bucket.
    """

    @F.pandas_udf("answer string, error string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        fn, kept = factory(), None if log is None else log.open()
        for texts, contexts in batches:
            rows = []
            for text, context in zip(texts, contexts):
                key = None if kept is None or text is None else answer_key(context or "", text)
                answer = None if key is None else kept.answer(key)
                if text is None or answer is not None:
                    rows.append((answer, None))
                    continue
                rows.append(_asked(fn, attempts, pause, text))
                if key is not None and rows[-1][0] is not None:
                    kept.keep(key, rows[-1][0])
            if kept is not None:
                kept.flush()
            yield pd.DataFrame(rows, columns=["answer", "error"], dtype=object)

    return apply


def log_bucket(log: AnswerLog, text: str, context: str) -> Column:
    """The bucket of a request, as the log computes it."""
    key = F.md5(F.concat(F.coalesce(F.col(context), F.lit("")), F.lit("\x1f"), F.col(text)).cast("binary"))
    # A remainder by a power of two needs the last digits only.
    return F.conv(F.right(key, F.lit(8)), 16, 10).cast("long") % F.lit(log.buckets)


def grade_hook(factory: Factory, attempts: int = 3) -> Callable[..., Column]:
    """(question, document) -> `yes` or `no`; a failed grading is NULL."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fn = factory()
        for questions, documents in batches:
            yield pd.Series([_tried(fn, attempts, q, d) for q, d in zip(questions, documents)], dtype=object)

    return apply


def embed_hook(factory: Factory, attempts: int = 3) -> Callable[..., Column]:
    """Text column -> vector column. The function takes a list of texts and gives a list of vectors.

    A batch that fails is tried text by text, so one bad text costs its own vector only; that one is NULL.
    """

    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for texts in batches:
            vectors = _tried(fn, attempts, texts.tolist())
            if vectors is None:
                vectors = [(_tried(fn, attempts, [text]) or [None])[0] for text in texts]
            yield pd.Series([None if v is None else list(map(float, v)) for v in vectors], dtype=object)

    return apply


def grade_batch(df, factory: Factory, question: str = "question", document: str = "document", attempts: int = 3):
    """Adds `grade`."""
    return df.withColumn("grade", grade_hook(factory, attempts)(F.col(question), F.col(document)))


def embed_batch(df, factory: Factory, text: str = "text", attempts: int = 3):
    """Adds `embedding`."""
    return df.withColumn("embedding", embed_hook(factory, attempts)(F.col(text)))
