"""What the inventory's queries don't show: errors, streams over several batches, state that ends."""

import pytest
from pyspark.sql import functions as F

from transect.operators import fusion, planning
from transect.sources import registry
from transect.streaming import telemetry


def test_an_unknown_source_is_an_error(spark):
    assert registry.sources(spark).count() == 9
    with pytest.raises(ValueError, match="unknown source: nowhere"):
        registry.sources(spark, ("dryad", "nowhere"))


def test_variants_are_lists_joined_and_less_one(spark):
    sizes = {r.variant: (len(r.sources), r.dose) for r in registry.variants(spark).collect()}
    assert sizes == {"B": (5, 0.1), "E1": (9, 0.1), "E2": (4, 0.1), "E4_0": (5, 0.0), "E4_20": (5, 0.2)}


def test_tiles_of_a_plan_are_as_many_as_counted(spark):
    from transect.functions import flight

    rows = [(k, w, h, s) for k, (w, h, s) in enumerate([(8192, 5460, 640), (8192, 5460, 1024), (8192, 5460, 1701), (8192, 5460, None), (14204, 10652, 2834), (100, 50, 512), (513, 512, 512)])]
    plan = spark.createDataFrame(rows, "frame int, width int, height int, slice int")
    tiles = planning.planned_tiles(plan)
    counted = {r.frame: r.n for r in tiles.groupBy("frame").agg(F.count("*").alias("n")).collect()}
    assert counted == {r.frame: r.n for r in plan.select("frame", flight.tile_count(F.col("width"), F.col("height"), F.col("slice")).alias("n")).collect()}
    assert tiles.filter("x < 0 OR y < 0 OR x + tile_w > width OR y + tile_h > height").count() == 0
    assert tiles.groupBy("frame").agg(F.max(F.col("x") + F.col("tile_w") - F.col("width")).alias("a"), F.max(F.col("y") + F.col("tile_h") - F.col("height")).alias("b")).filter("a <> 0 OR b <> 0").count() == 0


def test_fusion_of_boxes_without_score(spark):
    """A cluster without weight keeps its first box."""
    dets = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.0), (1, 0, 1, 1.0, 0.0, 11.0, 10.0, 0.0)], "frame int, model int, det_seq int, x1 double, y1 double, x2 double, y2 double, score double")
    assert [tuple(r) for r in fusion.weighted_fusion(dets, [1.0]).collect()] == [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.0)]


def test_stream_over_batches(spark, tmp_path):
    """State goes on from batch to batch, the blind slice is that of the first frame without geometry, and an idle flight begins anew."""
    kind = "flight long, ts timestamp, kind string, value double, event_id long, swept int"
    at = lambda day, minute: f"2024-01-{day:02d} 00:{minute:02d}:00"
    batches = [
        [(1, at(1, 1), "image", None, 1, 1024), (1, at(1, 2), "image", None, 2, 2048), (2, at(1, 1), "altitude", 50.0, 3, None)],
        [(1, at(1, 3), "gsd", 0.02, 4, None), (1, at(1, 4), "image", None, 5, 512), (2, at(1, 5), "image", None, 6, 512)],
        [(3, at(20, 1), "image", None, 7, None)],
        [(3, at(21, 1), "image", None, 8, 640)],
        [(1, at(22, 1), "image", None, 9, 2048)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "flight long, ts string, kind string, value double, event_id long, swept int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = telemetry.enriched_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
        telemetry.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    found = {r.event_id: (r.topic_altitude, r.topic_gsd, r.n_frame, r.blind_slice) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {1: (None, None, 1, 1024), 2: (None, None, 2, 1024), 5: (None, 0.02, 3, 1024), 6: (50.0, None, 1, None), 7: (None, None, 1, None), 8: (None, None, 2, 640), 9: (None, None, 1, 2048)}


@pytest.mark.parametrize("way", ["adaptive", "consensus", "models"])
def test_tiles_are_not_broadcast(spark, way):
    """Tiles are many more than the frames that Spark goes by, so no join with them may collect them."""
    frames = spark.range(40).select(F.col("id").alias("frame"), F.lit(8192).alias("width"), F.lit(5460).alias("height"), (0.01 + F.col("id") / 1000).alias("gsd"))
    objects, plans = spark.range(100000).select((F.col("id") % 40).alias("of"), F.col("id").alias("det_seq"), (F.col("id") % 8000).cast("double").alias("at")), []

    def detect(tiles):
        found = tiles.join(objects, (F.col("frame") == F.col("of")) & F.col("at").between(F.col("x"), F.col("x") + F.col("tile_w") - 20) & (F.col("y") == 0))
        plans.append(found._jdf.queryExecution().sparkPlan().toString())
        return found.select("frame", "x", "y", "det_seq", (F.col("at") - F.col("x")).alias("x1"), F.lit(0.0).alias("y1"), (F.col("at") - F.col("x") + 20).alias("x2"), F.lit(20.0).alias("y2"), F.lit(0.5).alias("score"))

    models = [{"label": "a", "detect": detect}, {"label": "b", "detect": detect}]
    run = {
        "adaptive": lambda: planning.adaptive_prediction(frames, detect, seams=None, given_gsd=F.col("gsd")),
        "consensus": lambda: planning.ensemble(frames, models, "consensus", seams=None, given_gsd=F.col("gsd")),
        "models": lambda: planning.ensemble_predict(frames, models, seams=None, given_gsd=F.col("gsd"))[1]["b"][1],
        "seams": lambda: planning.adaptive_prediction(frames.filter("frame < 4"), detect, given_gsd=F.col("gsd")),
    }
    run[way]()
    assert plans and all("Broadcast" not in p and "SortMergeJoin" in p for p in plans)


def test_members_of_an_ensemble_are_not_fused(spark, smallest):
    """What the models decide and find takes no job before its own: nothing of it is fused."""
    from transect.plans import evaluation

    spark.sparkContext.setJobGroup("members", "")
    evaluation.q79_ensemble_models(spark, smallest)
    jobs = [spark.sparkContext.statusTracker().getJobInfo(j) for j in spark.sparkContext.statusTracker().getJobIdsForGroup("members")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3  # schemas of three tables
