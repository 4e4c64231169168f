"""Shape annotations (one JSON object a file, keyed by image) and COCO records (a JSON object a line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transect import schema
from transect.functions import geometry as g

MODES = ("body", "all", "union")


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, key, filename, regions): regions as an array, whether the file has a list or an object of them. Entries without file name are left out."""
    return region_rows(spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def region_rows(text: DataFrame) -> DataFrame:
    """The same of texts (path, value)."""
    entries = text.select("path", F.explode(F.from_json("value", "map<string,string>")).alias("key", "entry"))
    raw = F.get_json_object("entry", "$.regions")
    listed = F.from_json(raw, f"array<{schema.REGION}>")
    keyed = F.map_values(F.from_json(raw, f"map<string,{schema.REGION}>"))
    shapes = F.when(raw.startswith("["), listed).when(raw.startswith("{"), keyed).otherwise(F.expr(f"cast(array() AS array<{schema.REGION}>)"))
    return entries.select("path", "key", F.get_json_object("entry", "$.filename").alias("filename"), shapes.alias("regions")).filter("filename IS NOT NULL AND filename <> ''")


def chosen(shapes: Column, mode: str = "body") -> Column:
    """Regions of the body part ``body``, or all where there are none of it; all of them for the other modes."""
    if mode not in MODES:
        raise ValueError(f"unknown box mode: {mode}")
    if mode != "body":
        return shapes
    body = lambda r: F.coalesce(r.region_attributes["body_part"] == "body", F.lit(False))
    return F.when(F.exists(shapes, body), F.filter(shapes, body)).otherwise(shapes)


def shape_boxes(entries: DataFrame, sizes: DataFrame, mode: str = "body") -> DataFrame:
    """(filename, seq, box): centre boxes as the image is shown. sizes: filename, width, height (as stored), orientation.

    Images that sizes lacks are left out. With ``union`` all regions of an image make one box."""
    corners = F.filter(F.transform(chosen(F.col("regions"), mode), lambda r: g.shape_to_corners(r.shape_attributes)), lambda b: b.isNotNull())
    boxes = entries.join(sizes, "filename").withColumn("_boxes", corners)
    if mode == "union":
        ends = [f(F.col(f"_boxes.{n}")).alias(n) for f, n in ((F.array_min, "x1"), (F.array_min, "y1"), (F.array_max, "x2"), (F.array_max, "y2"))]
        boxes = boxes.withColumn("_boxes", F.when(F.size("_boxes") > 0, F.array(F.struct(*ends))))
    rows = boxes.select("filename", "width", "height", "orientation", F.posexplode("_boxes").alias("seq", "_b"))
    return rows.select("filename", "seq", g.oriented_box(F.col("_b"), F.col("width"), F.col("height"), F.col("orientation")).alias("box"))


def coco_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.COCO_RECORD).json(path)


def with_missing(records: DataFrame, sizes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records whose image sizes has, one row with n_missing, the number of the others)."""
    known = sizes.select(key).distinct()
    return records.join(known, key, "left_semi"), records.join(known, key, "left_anti").agg(F.count("*").alias("n_missing"))


def coco_boxes(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_name, seq, box): boxes that aren't four numbers are left out, as are images that sizes lacks. sizes: file_name, width, height."""
    rows = records.drop("width", "height").join(sizes, "file_name").select("file_name", "width", "height", F.posexplode("annotations").alias("seq", "_a"))
    return rows.withColumn("box", g.coco_to_centre(F.col("_a.bbox"), F.col("_a.bbox_mode"), F.col("width"), F.col("height"))).filter("box IS NOT NULL").select("file_name", "seq", "box")
