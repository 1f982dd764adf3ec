import numpy as np
import pytest
from conftest import rows
from test_signal import unwrapped

from sonargrid.streaming import streams


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return rows(df.sparkSession.table(name))


def source(spark, path, frames, schema):
    for i, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_blocks_and_sessions(spark, tmp_path):
    schema = "rec_id bigint, channel int, ts timestamp, x double"
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    data = [(1, 0, t0 + timedelta(seconds=s), float(s)) for s in (0, 1, 2, 10, 11, 4000)]
    s = source(spark, tmp_path / "a", [data], schema)
    got = drain(streams.block_stats(s, "ts", "10 seconds", "5 seconds", late="1 minute"), "blocks", "complete")
    assert (1, 0, t0, 3, 0.0, 2.0) in got and (1, 0, t0 + timedelta(seconds=5), 2, 10.0, 11.0) in got
    got = drain(streams.sessions(s, "ts", "5 seconds", late="1 minute"), "sessions", "complete")
    assert sorted(r[3] for r in got) == [1, 2, 3]


def test_continuity_over_batches(spark, tmp_path):
    schema = "rec_id bigint, file_idx int, start_us bigint, length_us bigint"
    s = 1_000_000
    batches = [[(1, 0, 0, 10 * s), (2, 0, 5, 10 * s)], [(1, 1, 10 * s, 10 * s)], [(1, 2, 25 * s, 10 * s), (2, 1, None, 10 * s)], [(1, 3, 35 * s, 10 * s)]]
    got = drain(streams.continuity(source(spark, tmp_path / "b", batches, schema)), "continuity")
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, False), (2, 0, True), (2, 1, False)]


def test_unwrap_over_batches(spark, tmp_path):
    y = 1.6 * np.sin(2 * np.pi * 0.01 * np.arange(300))
    x = y - 2 * np.floor((y + 1) / 2)
    schema = "rec_id bigint, channel int, frame bigint, x double"
    batches = [[(1, 0, i, float(x[i])) for i in range(a, a + 100)] for a in (0, 100, 200)]
    got = drain(streams.unwrap(source(spark, tmp_path / "c", batches, schema)), "unwrapped")
    assert np.allclose([r[3] for r in sorted(got, key=lambda r: r[2])], unwrapped(x, 1.5, 1.0))


def test_stream_and_batch_unwrap_alike_with_nulls_and_refuse_disorder(spark, tmp_path):
    from sonargrid.operators import signal

    y = 1.6 * np.sin(2 * np.pi * 0.02 * np.arange(200))
    x = y - 2 * np.floor((y + 1) / 2)
    schema = "rec_id bigint, channel int, frame bigint, x double"
    data = [(1, 0, i, None if i in (40, 99, 100, 131) else float(x[i])) for i in range(200)]
    got = drain(streams.unwrap(source(spark, tmp_path / "d", [data[:100], data[100:]], schema)), "nulls")
    want = rows(signal.unwrap(spark.createDataFrame(data, schema)))
    assert sorted((r[2], None if r[3] is None or r[3] != r[3] else r[3]) for r in got) == sorted((r[2], r[3]) for r in want)
    with pytest.raises(Exception, match="in order"):
        drain(streams.unwrap(source(spark, tmp_path / "e", [data[100:], data[:100]], schema)), "disorder")


def test_continuity_by_rate_and_order(spark, tmp_path):
    schema = "rec_id bigint, file_idx int, start_us bigint, length_us bigint, rate double, channels int"
    s = 1_000_000
    batches = [[(1, 0, 0, s, 10.0, 1), (2, 0, 0, s, 10.0, 1)], [(1, 2, s, s, 10.0, 1), (2, 1, s, s, 11.0, 1)], [(1, 1, 2 * s, s, 10.0, 1), (1, 3, 2 * s, s, 10.0, 1)]]
    got = drain(streams.continuity(source(spark, tmp_path / "f", batches, schema)), "rates")
    assert [r[:3] for r in got] == [(1, 0, True), (1, 1, False), (1, 2, True), (1, 3, True), (2, 0, True), (2, 1, False)]
