"""Streams over files that land one after another: watermarks close days, state of ended windows goes."""

import datetime
import random

from pyspark.sql import functions as F

from docketry.operators import ordering
from docketry.streaming import health

AT = datetime.datetime(2026, 1, 1, 12)


def test_state_of_ended_windows_goes(spark, tmp_path):
    """A source that lands in parts gives what the batch gives, and only open windows stay in state."""
    rng, rows = random.Random(3), []
    for k in range(12):
        rows += [(f"w{k}", AT + datetime.timedelta(minutes=40 * k + rng.randrange(35), seconds=rng.randrange(60))) for _ in range(6)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[a : a + 18] for a in range(0, len(rows), 18)]
    schema = "who string, at timestamp"
    (tmp_path / "in").mkdir()
    stream = health.limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "who", "at", allowed=2)
    left = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.who, r.window_start, r.attempts, r.ok) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = health.number_attempts(spark.createDataFrame(rows, schema), "who", "at", "at", allowed=2).collect()
    assert got == sorted((r.who, r.window_start, r.attempt, r.ok) for r in want)
    assert left[-1] < 5 and max(left) < 12


def test_days_close_behind_the_watermark(spark, tmp_path):
    schema = "scraper_id string, success boolean, run_timestamp timestamp"
    day = lambda n, h: AT + datetime.timedelta(days=n, hours=h)
    parts = [[("s", True, day(0, 0)), ("s", False, day(0, 1))], [("s", True, day(0, 2)), ("s", True, day(1, 0))], [("s", True, day(4, 0))], [("s", True, day(0, 3)), ("s", True, day(9, 0))]]
    (tmp_path / "in").mkdir()
    stream = health.daily_successes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r.day), r.runs, r.successes) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # the run that came days late isn't counted; the last day is open still
    assert got == [("2026-01-01", 3, 2), ("2026-01-02", 1, 1), ("2026-01-05", 1, 1)]


def test_split_keys_have_the_windows_of_whole_ones(spark):
    """Pointer doubling against the attempts in order: random times, ties, ends that are times, one key of many."""
    rng, rows = random.Random(8), []
    for k, (n, spread) in enumerate([(1, 1), (40, 30), (300, 4000), (3000, 90_000), (500, 800)]):
        rows += [(f"k{k}", AT + datetime.timedelta(seconds=rng.randrange(spread), microseconds=rng.choice([0, 1])), i) for i in range(n)]
    rows += [("ends", AT + datetime.timedelta(seconds=900 * i), i) for i in range(70)] + [("ends", AT + datetime.timedelta(seconds=900 * 3), 99)]
    rows += [(None, AT, 1), ("k0", None, 2)]
    df = spark.createDataFrame(rows, "who string, at timestamp, n int")
    take = lambda d: sorted((r.who, r.at, r.n, r.window_start, r.attempt, r.ok) for r in d.collect())
    want = take(health.number_attempts(df, "who", "at", "n", allowed=3))
    assert len(want) == len(rows) - 2
    assert take(health.number_attempts(df, "who", "at", "n", allowed=3, hot=300)) == want
    assert take(health.number_attempts(df.withColumn("at", df.at.cast("timestamp_ntz")), "who", "at", "n", allowed=3, hot=1)) == want
    starts, end = {}, None
    for who, at, *_ in want:  # plainly, attempt by attempt
        if who not in starts or at >= end:
            starts.setdefault(who, []).append(at)
            end = at + datetime.timedelta(seconds=900)
    got = health.window_starts(df.where("who is not null and at is not null"), "who", "at").collect()
    assert sorted((r.who, r.window_start) for r in got) == sorted((w, t) for w, ts in starts.items() for t in ts)
    assert health.number_attempts(df.limit(0), "who", "at", "n", hot=1).count() == 0


def test_one_key_is_many_tasks(spark, monkeypatch):
    """Each numbering, of times, of times and ends, and of attempts in windows, is written by several tasks."""
    paths, folder = [], ordering.scratch_folder
    monkeypatch.setattr(ordering, "scratch_folder", lambda *a: paths.append(folder(*a)) or paths[-1])
    df = spark.range(60_000).select(F.lit("one").alias("who"), F.timestamp_seconds(F.col("id") * 7 % 50_000).alias("at"), F.col("id").alias("n"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert health.split_attempts(df, "who", "at", "n").count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [[r["count"] for r in spark.read.parquet(p).groupBy("__range").count().collect()] for p in paths]
    assert [sum(s) for s in sizes] == [50_000, 100_000, 60_000] and all(max(s) < 0.7 * sum(s) for s in sizes)
