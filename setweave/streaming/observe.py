"""Reactive evaluation: a mutable root that watchers follow, file streams, and event-time windows."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.lang.engine import Engine


class Reactor:
    """``update(text)`` evaluates with the root as ``$`` and replaces it; each watcher is then evaluated anew.

    A watcher gets a first value when it registers; one whose expression fails is closed with the error.
    """

    def __init__(self, spark: SparkSession | None = None, root: Any = frozenset()):
        self.engine = Engine(spark)
        self.engine.bind("$", root)
        self.watchers: dict[int, tuple[str, Callable, Callable]] = {}
        self.last = 0

    def update(self, text: str) -> Any:
        self.engine.scope["$"] = self.engine.eval(text)
        for key in list(self.watchers):
            self._push(key)
        return self.engine.scope["$"]

    def replace(self, root: Any) -> None:
        """Another value as the root."""
        self.engine.bind("$", root)
        for key in list(self.watchers):
            self._push(key)

    def observe(self, text: str, on_update: Callable, on_close: Callable = lambda error: None) -> Callable[[], None]:
        self.last += 1
        key = self.last
        self.watchers[key] = (text, on_update, on_close)
        self._push(key)
        return lambda: self.watchers.pop(key, None) and None

    def _push(self, key: int) -> None:
        text, on_update, on_close = self.watchers[key]
        try:
            on_update(self.engine.eval(text))
        except Exception as error:  # the watcher's expression, not the engine, is at fault
            self.watchers.pop(key, None)
            on_close(error)


def observe_stream(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], on_update: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Evaluates each micro-batch and hands over the result."""
    return stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: on_update(evaluate(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_files(spark: SparkSession, path: str) -> DataFrame:
    """New and changed files of a folder as a stream of ``path``, ``modificationTime``, ``length`` and ``content``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)


def folder(path: str) -> dict:
    """The files of a folder of the driver as a nested dictionary of bytes."""
    out: dict = {}
    for entry in sorted(os.scandir(path), key=lambda e: e.name):
        if entry.is_dir():
            out[entry.name] = folder(entry.path)
        else:
            with open(entry.path, "rb") as f:
                out[entry.name] = f.read()
    return out


def sync(reactor: Reactor, spark: SparkSession, path: str, checkpoint: str):
    """Makes a folder's tree the root, anew with each batch of new or changed files; the stream that does so."""
    return observe_stream(watch_files(spark, path), lambda df: df, lambda df, n: reactor.replace(folder(path)), checkpoint)


def windowed(events: DataFrame, time: str, width: str, late: str, slide: str | None = None, **folds) -> DataFrame:
    """Tumbling or sliding windows over event time, with a watermark for late rows."""
    kind = events.schema[time].dataType.simpleString()
    grouped = _timed(events, time).withWatermark(time, late).groupBy(F.window(time, width, slide))
    return grouped.agg(*[c.alias(n) for n, c in folds.items()]).select(F.col("window.start").cast(kind).alias("start"), *folds)


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need times with a zone: the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str, **folds) -> DataFrame:
    """Windows that end once a key has no event for ``gap``."""
    kind = events.schema[time].dataType.simpleString()
    grouped = _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)
    return grouped.agg(*[c.alias(n) for n, c in folds.items()]).select(F.col("session_window.start").cast(kind).alias("start"), *keys, *folds)
