"""Typed events by topic: a bus in memory, and Structured Streaming sources and sinks."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)


def topic_regex(pattern: str) -> str:
    """A pattern of ``:``-separated segments where ``*`` stands for one segment."""
    return "^" + ":".join("[^:]*" if s == "*" else re.escape(s) for s in pattern.split(":")) + "$"


def topic_matches(topic: Column, pattern: str) -> Column:
    return topic.rlike(topic_regex(pattern))


class EventBus:
    """Publish and subscribe within the driver. A handler that fails, or a payload that does not fit, stops no other."""

    def __init__(self):
        self.handlers: list[tuple[re.Pattern, type | None, Callable[[str, Any], None]]] = []

    def subscribe(self, pattern: str, handler: Callable[[str, Any], None], of: type | None = None) -> Callable[[], None]:
        """``handler(topic, payload)``; ``of`` makes payloads from JSON objects. Returns what ends the subscription."""
        entry = (re.compile(topic_regex(pattern)), of, handler)
        self.handlers.append(entry)
        return lambda: self.handlers.remove(entry) if entry in self.handlers else None

    def publish(self, topic: str, payload: Any) -> int:
        """To all subscribers at once; returns how many handled it."""
        done, text = 0, json.dumps(payload, default=lambda o: o.__dict__)
        for pattern, of, handler in list(self.handlers):
            if not pattern.match(topic):
                continue
            try:
                body = json.loads(text)
                handler(topic, of(**body) if of else body)
                done += 1
            except Exception:
                log.exception("a handler of %s failed", topic)
        return done


def typed_events(raw: DataFrame, pattern: str, schema: T.StructType, topic: str = "topic", payload: str = "payload") -> DataFrame:
    """Events of ``raw`` (topic, payload: JSON text), batch or stream, whose topic matches; payloads that are no JSON object of the schema are dropped."""
    parsed = raw.where(topic_matches(F.col(topic), pattern)).withColumn("__e", F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE"}))
    some = F.lit(False)
    for f in schema:
        some = some | F.col("__e")[f.name].isNotNull()
    return parsed.where(F.col("__e").isNotNull() & some).select(F.col(topic), "__e.*")


def deliver(stream: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hand each micro-batch to every handler; one that fails is logged and stops no other."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for h in handlers:
                try:
                    h(kept, number)
                except Exception:
                    log.exception("a handler of batch %d failed", number)
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str, width: str, *by: str, late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window and group; in a stream, windows close when the watermark passes them."""
    df = stream.withWatermark(time, late) if stream.isStreaming else stream
    return df.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")
