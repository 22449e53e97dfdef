"""Streams over files, a batch a file, against the same operators over the whole table."""

import datetime as dt

from pyspark.sql import functions as F

from voxloom.operators.intensity import carry_forward
from voxloom.streaming import frames as fr


def drained(spark, stream, mode, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stored(spark, rows, schema, path):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_and_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    schema = "ts timestamp, channel string, value double"
    rows = [[(at(1), "a", 1.0), (at(5), "a", 3.0), (at(8), "b", 5.0)], [(at(12), "a", 7.0), (at(65), "a", 9.0)], [(at(66), "b", 1.0)], [(at(3), "a", 100.0)], [(at(200), "c", 0.0)]]
    s = stored(spark, rows, schema, f"{tmp_path}/in")
    got = drained(spark, fr.windowed(s, "10 seconds", late="20 seconds"), "append", tmp_path, "tumbling").collect()
    have = {((r.start - t0).seconds, r.channel): (r.n, r.mean) for r in got}
    assert have[0, "a"][0] == 2 and have[0, "a"][1] == 2.0  # the row 62 seconds late is left out
    assert have[0, "b"] == (1, 5.0) and have[10, "a"] == (1, 7.0) and have[60, "a"] == (1, 9.0)
    slid = drained(spark, fr.windowed(s, "10 seconds", "5 seconds", "20 seconds"), "append", tmp_path, "sliding")
    assert {((r.start - t0).total_seconds(), r.n) for r in slid.where("channel = 'b'").collect()} >= {(0, 1), (5, 1), (60, 1), (65, 1)}
    ses = drained(spark, fr.sessions(s, "10 seconds", "20 seconds"), "append", tmp_path, "sessions")
    assert {((r.start - t0).seconds, r.n) for r in ses.where("channel = 'a'").collect()} == {(1, 3), (65, 1)}


def test_carried(spark, tmp_path):
    thr = [10.0, 11.0, 30.0, None, 12.0, 12.5, 40.0, 12.0]
    rows = [[(c, i, v) for c in ("a", "b") for i, v in list(enumerate(thr))[k : k + 3]] for k in (0, 3, 6)]
    schema = "channel string, frame int, thr double"
    s = stored(spark, rows, schema, f"{tmp_path}/thr")
    # files are read in the order of their times; frames of a batch are in order then
    got = drained(spark, fr.carried_thresholds(s, 1.2), "append", tmp_path, "carried")
    whole = carry_forward(spark.read.schema(schema).parquet(f"{tmp_path}/thr"), 1.2)
    key = [F.col("channel"), F.col("frame")]
    assert [(r.channel, r.frame, r.thr, r.used) for r in got.orderBy(*key).collect()] == [(r.channel, r.frame, r.thr, r.used) for r in whole.orderBy(*key).collect()]
