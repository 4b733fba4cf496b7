"""Intake shapes: Kafka-source rows map onto the event log columns."""

import datetime as dt

from pipewright.sources.tables import kafka_to_events


def test_kafka_rows_to_events(spark):
    schema = ("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
              "timestampType int, headers array<struct<key:string,value:binary>>")
    rows = [(b"k1", b'{"a":1}', "orders", 3, 42, dt.datetime(2024, 1, 2), 0,
             [("pw-producer-id", b"svc-a"), ("x", b"y")]),
            (None, b"raw", "orders", 0, 7, dt.datetime(2024, 1, 3), 0, None)]
    out = kafka_to_events(spark.createDataFrame(rows, schema)).orderBy("kafka_offset").collect()
    assert [(r.topic, r.partition_id, r.kafka_offset, r.msg_key, r.payload, r.producer_id) for r in out] == [
        ("orders", 0, 7, None, "raw", None), ("orders", 3, 42, "k1", '{"a":1}', "svc-a")]
