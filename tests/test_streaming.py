from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transect.plans import fixtures as fx
from transect.streaming import telemetry


def stream_of(spark, rows, tmp_path, parts=3):
    rows.withColumn("ts", F.col("ts").cast("timestamp")).repartition(parts).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")


def test_stream_equals_batch(spark, smallest, tmp_path):
    rows = fx.telemetry(spark, smallest)
    stream = telemetry.enriched_stream(stream_of(spark, rows, tmp_path, 1))
    telemetry.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    found = {r.event_id: (r.topic_altitude, r.topic_gsd) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.event_id: (r.topic_altitude, r.topic_gsd) for r in telemetry.latest_before(rows).collect()}
    assert found == want
    numbers = spark.read.parquet(f"{tmp_path}/out").groupBy("flight").agg(F.count("*").alias("n"), F.max("n_frame").alias("m")).collect()
    assert all(r.n == r.m for r in numbers)


def test_decisions_of_a_stream(spark, smallest, tmp_path):
    rows = fx.telemetry(spark, smallest)
    live = telemetry.decisions(telemetry.enriched_stream(stream_of(spark, rows, tmp_path, 1)), param_altitude=120.0)
    telemetry.run_available(live, f"{tmp_path}/out", f"{tmp_path}/ck")
    batch = telemetry.decisions(telemetry.latest_before(rows), param_altitude=120.0)
    pick = lambda df: sorted((r.event_id, r.mode, r.slice or 0, r.tiles) for r in df.collect())
    assert pick(spark.read.parquet(f"{tmp_path}/out")) == pick(batch)


def test_modes(spark):
    frames = spark.createDataFrame([(1, None, None), (2, 0.02, None), (3, None, 100.0)], "id int, topic_gsd double, topic_altitude double")
    mode = lambda **k: {r.id: (r.mode, r.slice) for r in telemetry.decisions(frames, **k).collect()}
    assert mode(mode="fixed", fixed_slice=100) == {k: ("fixed", 512) for k in (1, 2, 3)}
    assert mode(mode="nonsense") == mode(mode="adaptive")
    assert mode()[1] == ("blind_sweep", None)
    assert mode(blind=F.lit(2048))[1] == ("blind_cached", 2048)
    assert mode(param_gsd=0.05)[2] == mode(param_gsd=0.05)[3]  # a set distance beats reports
    assert mode(param_altitude=300.0)[3] == mode()[3]  # a reported altitude beats the set one
    assert mode(mode="adaptive_range")[2][1] != mode()[2][1]


def test_windows_and_log(spark, smallest, tmp_path):
    rows = fx.telemetry(spark, smallest)
    counts = telemetry.tumbling_counts(stream_of(spark, rows, tmp_path), "6 hours")
    counts.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == rows.count()
    frames = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "frame string")
    log = spark.createDataFrame([("a.jpg", 80.0)], "frame string, altitude_m double")
    assert sorted((r.frame, r.logged_altitude) for r in telemetry.with_flight_log(frames, log).collect()) == [("a.jpg", 80.0), ("b.jpg", None)]


def test_carried_over_days(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", "altitude", 5.0, 1), (1, "2024-01-04 00:00:01", "image", None, 2), (1, "2024-01-04 00:00:01", "gsd", 0.1, 3), (2, "2024-01-04 00:00:01", "image", None, 4)], "flight int, ts string, kind string, value double, event_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r.event_id: (r.topic_altitude, r.topic_gsd) for r in telemetry.latest_before(rows).collect()} == {2: (5.0, 0.1), 4: (None, None)}


ROWS = "flight int, ts timestamp_ntz, kind string, value double, event_id long, swept int"


def appended(spark, folder, rows):
    spark.createDataFrame([(f, datetime.fromisoformat(t), *more) for f, t, *more in rows], ROWS).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_state_over_batches_and_a_restart(spark, tmp_path):
    """Batches of one file each, then another start from the checkpoint: values, counter and blind slice go on, late values count for nothing
    before them, and a flight that was idle for a day begins anew."""
    day = "2024-01-0"
    first = [(1, f"{day}1 00:00:05", "image", None, 1, 700), (1, f"{day}1 00:00:09", "altitude", 80.0, 2, None), (1, f"{day}1 00:00:09", "image", None, 3, 900), (None, f"{day}1 00:00:09", "image", None, 4, None)]
    second = [(1, f"{day}1 00:00:10", "image", None, 5, 901), (1, f"{day}1 00:00:07", "altitude", 10.0, 6, None), (1, f"{day}1 00:00:11", "gsd", None, 7, None), (1, f"{day}1 00:00:12", "gsd", 0.02, 8, None), (2, f"{day}1 00:00:12", "image", None, 9, None)]
    third = [(1, f"{day}1 00:30:00", "image", None, 10, 5), (2, f"{day}1 00:30:00", "image", None, 11, 640)]
    later, last = [(3, f"{day}4 00:00:00", "image", None, 12, None)], [(1, f"{day}4 00:00:01", "image", None, 13, 333)]
    schema = spark.createDataFrame([], ROWS).withColumn("ts", F.col("ts").cast("timestamp")).schema
    source = lambda: telemetry.enriched_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for k, rows in enumerate((first, second, third, later, last)):
        appended(spark, f"{tmp_path}/in", rows)
        if k:  # the first two are batches of one start, and each other one follows a restart
            telemetry.publish(source(), f"{tmp_path}/out", f"{tmp_path}/ck")
    found = {r.event_id: (r.flight, r.topic_altitude, r.topic_gsd, r.n_frame, r.blind_slice) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {
        1: (1, None, None, 1, 700), 3: (1, 80.0, None, 2, 700), 4: (None, None, None, 1, None), 5: (1, 80.0, None, 3, 700), 9: (2, None, None, 1, None),
        10: (1, 80.0, 0.02, 4, 700), 11: (2, None, None, 2, 640), 12: (3, None, None, 1, None), 13: (1, None, None, 1, 333),
    }


def test_a_batch_that_fails_is_published_once(spark, smallest, tmp_path):
    rows = fx.telemetry(spark, smallest)
    stream = lambda: telemetry.enriched_stream(spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "9999 days")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []

    def fails(batch, number):
        seen.append(number)
        if number == 1 and seen.count(1) == 1:
            raise RuntimeError("after the write")

    with pytest.raises(Exception, match="after the write"):
        telemetry.publish(stream(), f"{tmp_path}/out", f"{tmp_path}/ck", fails)
    telemetry.publish(stream(), f"{tmp_path}/out", f"{tmp_path}/ck", fails)
    assert seen.count(1) == 2
    ids = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(ids) == len(set(ids)) == rows.filter("kind = 'image'").count()
