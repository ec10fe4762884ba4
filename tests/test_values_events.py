import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.errors import QueryError
from nestq.functions.values import decode_cursor, encode_cursor, erase_path, flexible_timestamp, get_path, parse_datetime
from nestq.streaming.events import EventBus, deliver, topic_regex, typed_events, windowed_counts


def test_datetimes(spark):
    want = dt.datetime(2024, 1, 2, 3, 4, 5)
    texts = ["1704164645", "1704164645000", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05"]
    assert all(parse_datetime(t) == want for t in texts)
    rows = spark.createDataFrame([(t,) for t in [*texts, "2024-01-02", "soon", None]], "t string").select(flexible_timestamp(F.col("t")).cast("timestamp_ntz")).collect()
    assert [r[0] for r in rows] == [want] * 4 + [dt.datetime(2024, 1, 2), None, None]
    for bad in ("soon", True):
        with pytest.raises(QueryError):
            parse_datetime(bad)


def test_cursors_and_paths(spark):
    assert decode_cursor(encode_cursor({"id": 10}), ["id"]) == {"id": 10} and decode_cursor(7, ["id"]) == {"id": 7}
    with pytest.raises(QueryError):
        decode_cursor(7, ["a", "b"])
    assert erase_path({"a": {"b": 1, "c": 2}}, "a.b") == {"a": {"c": 2}}
    assert spark.createDataFrame([('{"a": {"b": 1}}',)], "j string").select(get_path(F.col("j"), "a.b")).first()[0] == "1"


def test_bus():
    bus, seen = EventBus(), []
    bus.subscribe("a:*:c", lambda t, p: 1 / 0)
    stop = bus.subscribe("a:*:c", lambda t, p: seen.append((t, p)))
    assert bus.publish("a:b:c", {"x": 1}) == 1 and bus.publish("a:b:x:c", {}) == 0
    stop()
    assert bus.publish("a:b:c", {}) == 0 and seen == [("a:b:c", {"x": 1})]
    assert topic_regex("a.b:*") == r"^a\.b:[^:]*$"


def test_streams(spark, tmp_path):
    raw = [("u:1:click", '{"n": 1}'), ("u:2:click", "broken"), ("u:3:view", '{"n": 3}')]
    spark.createDataFrame(raw, "topic string, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("topic string, payload string").parquet(str(tmp_path / "in"))
    seen = []
    q = deliver(typed_events(stream, "u:*:click", T.StructType([T.StructField("n", T.IntegerType())])), [lambda df, n: 1 / 0, lambda df, n: seen.extend(map(tuple, df.collect()))], str(tmp_path / "c"))
    q.awaitTermination(60)
    assert seen == [("u:1:click", 1)]
    times = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 1), "a"), (dt.datetime(2024, 1, 1, 0, 9), "a"), (dt.datetime(2024, 1, 1, 0, 11), "a")], "ts timestamp_ntz, k string")
    assert sorted(r["n"] for r in windowed_counts(times, "ts", "10 minutes", "k").collect()) == [1, 2]
