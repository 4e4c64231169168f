"""Annotation tasks and predictions as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transect import schema
from transect.functions import geometry as g
from transect.functions import naming


def task_boxes(tasks: DataFrame, json: str = "json", clamped: bool = False, every: bool = False) -> DataFrame:
    """Rows of tasks with image (a decoded local path), label and box, one for each rectangle.

    Of a task's annotations the last that isn't cancelled counts, or with ``every`` all of them. The label is a rectangle's
    first, ``certain`` without one. With ``clamped``, boxes are clamped and those without extent left out.
    """
    read = tasks.withColumn("_t", F.from_json(json, schema.TASK))
    live = F.filter("_t.annotations", lambda a: ~F.coalesce(a.was_cancelled, F.lit(False)))
    results = F.flatten(F.transform(live, lambda a: a.result)) if every else F.get(live, F.size(live) - 1)["result"]
    boxes = read.withColumn("_r", F.explode(F.filter(results, lambda r: r.type == "rectanglelabels")))
    v = F.col("_r.value")
    box = g.percent_to_centre(v.x, v.y, v.width, v.height, clamped)
    out = boxes.select(*[c for c in tasks.columns if c != json], naming.local_path(F.concat(F.lit("http://local"), F.col("_t.data.image"))).alias("image"), F.coalesce(F.get(v.rectanglelabels, F.lit(0)), F.lit("certain")).alias("label"), box.alias("box"))
    return out.filter("box IS NOT NULL")


def prediction_tasks(dets: DataFrame, model_version: str, label: Column) -> DataFrame:
    """(frame, json): one task for each frame, with its detections by det_seq, in percent, and their highest score."""
    box = g.corners_to_percent(F.struct("x1", "y1", "x2", "y2"), F.col("width"), F.col("height"))
    value = F.struct(box.x.alias("x"), box.y.alias("y"), box.width.alias("width"), box.height.alias("height"), F.array(label).alias("rectanglelabels"))
    result = F.struct(F.lit("rectanglelabels").alias("type"), F.col("score").alias("score"), value.alias("value"))
    listed = dets.select("frame", "det_seq", "score", result.alias("r")).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("det_seq", "r"))).alias("rs"), F.max("score").alias("best"))
    prediction = F.struct(F.lit(model_version).alias("model_version"), F.coalesce("best", F.lit(0.0)).alias("score"), F.transform("rs", lambda x: x.r).alias("result"))
    task = F.struct(F.struct(F.format_string("frame_%s", F.col("frame").cast("string")).alias("image")).alias("data"), F.array(prediction).alias("predictions"))
    return listed.select("frame", F.to_json(task).alias("json"))


def read_predictions(tasks: DataFrame, json: str = "json") -> DataFrame:
    """(frame, task_score, score, x, y, width, height), one row for each predicted box."""
    kind = "struct<predictions: array<struct<model_version: string, score: double, result: array<struct<type: string, score: double, value: struct<x: double, y: double, width: double, height: double, rectanglelabels: array<string>>>>>>>"
    read = tasks.withColumn("_p", F.explode(F.from_json(json, kind)["predictions"])).withColumn("_r", F.explode("_p.result"))
    return read.select("frame", F.col("_p.score").alias("task_score"), "_r.score", "_r.value.x", "_r.value.y", "_r.value.width", "_r.value.height")


def completions(completion: DataFrame, task: DataFrame) -> DataFrame:
    """Completed annotations joined with their tasks' data, cancelled ones left out: (id, task_id, result, data)."""
    live = completion.filter(~F.coalesce(F.col("was_cancelled").cast("boolean"), F.lit(False)))
    return live.join(task.select(F.col("id").alias("_id"), "project_id", "data"), F.col("task_id") == F.col("_id")).drop("_id")
