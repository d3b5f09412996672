from pyspark.sql import functions as F

from tallyforge.streaming import usage

DATA = "/root/testdata/sf0.001/events.parquet"


def parts(spark, tmp_path):
    rows = spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    for week in range(5):  # one after another, so that files come in order of time
        rows.where(F.floor((F.dayofmonth("ts") - 1) / 7) == week).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp")), usage.read_events(spark, str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    out = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    out.awaitTermination()
    return df.sparkSession.table(name)


def test_hourly_equals_batch(spark, tmp_path):
    batch, stream = parts(spark, tmp_path)
    got = run(usage.hourly(stream, "40 days"), tmp_path, "hourly", "update")
    last = {(r.start, r.event_type): 0 for r in got.collect()}
    for r in got.collect():
        last[r.start, r.event_type] = max(last[r.start, r.event_type], r.calls)
    assert last == {(r.start, r.event_type): r.calls for r in usage.hourly(batch).collect()}


def test_sessions_equal_batch(spark, tmp_path):
    batch, stream = parts(spark, tmp_path)
    got = run(usage.user_sessions(stream), tmp_path, "sessions")
    every = {(r.user_id, r.start, r.n) for r in usage.user_sessions(batch).collect()}
    closed = {(r.user_id, r.start, r.n) for r in got.collect()}
    assert closed and closed <= every


def test_daily_counters_survive_a_repeated_batch(spark, tmp_path):
    batch, stream = parts(spark, tmp_path)
    counters = usage.DailyCounters(str(tmp_path / "daily"))
    counters.start(stream, str(tmp_path / "c")).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "daily").iterdir())
    wanted = {(r.day, r.event_type): r.n for r in batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.day, r.event_type): r.calls for r in counters.read(spark, last).collect()} == wanted
    counters.merge(batch.limit(0), last + 1)
    counters.merge(batch.limit(0), last + 1)
    assert {(r.day, r.event_type): r.calls for r in counters.read(spark, last + 1).collect()} == wanted


def test_over_budget_warns_once(spark, tmp_path):
    _, stream = parts(spark, tmp_path)
    rows = run(usage.over_budget(stream.withColumn("user_id", F.col("user_id") % 2), 3), tmp_path, "budget", "append").collect()
    assert len({r.user_id for r in rows}) == len(rows) > 0
    assert all(r.calls == 4 for r in rows)
