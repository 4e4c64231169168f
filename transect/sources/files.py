"""File listings, label text, manifests and logs.

Frames come from the image listing, never from label files: Spark's readers skip empty files, and an empty label file is a
confirmed negative. Labels are joined to the listing from the left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transect import schema
from transect.functions import geometry as g
from transect.functions import naming

# Image extensions, in the order in which they are looked for.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "JPG", "JPEG", "PNG")


def images(spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, stem, extension, folder): a listing; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    ext = F.regexp_extract("path", "\\.([^./]+)$", 1)
    return listed.withColumn("extension", ext).filter(F.col("extension").isin(*extensions)).select("path", naming.file_stem(F.col("path")).alias("stem"), "extension", F.element_at(F.split("path", "/"), -2).alias("folder"))


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, md5) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.md5("content").alias("md5"))


def image_by_stem(listing: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(stem, path): of several files with one stem, that of the first extension."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("extension"))
    return listing.groupBy("stem").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def label_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, value) of label files, one text a file."""
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return read.filter(F.col("path").endswith(".txt")).withColumn("stem", naming.file_stem(F.col("path")))


def label_rows(texts: DataFrame, clamped: bool = True) -> DataFrame:
    """texts (value, ...) with line_no, cx, cy, w and h of each line instead of value: class and four shares; shorter lines are skipped, the class dropped."""
    keys = [c for c in texts.columns if c != "value"]
    lines = texts.select(*keys, F.posexplode(F.split("value", "\\r?\\n")).alias("line_no", "line"))
    parts = F.split(F.trim(F.regexp_replace("line", "\\s+", " ")), " ")
    share = g.clamp01 if clamped else lambda v: v
    box = [share(parts[k].cast("double")).alias(n) for k, n in zip(range(1, 5), ("cx", "cy", "w", "h"), strict=True)]
    return lines.filter(F.size(parts) >= 5).select(*keys, "line_no", *box)


def label_lines(spark: SparkSession, folder: str, clamped: bool = True) -> DataFrame:
    """(path, stem, line_no, cx, cy, w, h) of label files."""
    return label_rows(label_texts(spark, folder), clamped).select("path", "stem", "line_no", "cx", "cy", "w", "h")


def line_counts(frames: DataFrame, texts: DataFrame, key: str = "stem") -> DataFrame:
    """frames with n_lines: the lines of their label text that aren't blank; 0 without a text."""
    full = F.size(F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")) != ""))
    return frames.join(texts.select(key, full.alias("n_lines")), key, "left").fillna(0, "n_lines")


def export_frames(listing: DataFrame, splits: DataFrame) -> DataFrame:
    """listing (path, stem, ...) of .../<source>/<raw split>/images/<file> or .../<raw split>/<file> with raw_split and split.

    splits: raw_split, split. Files of other folders are left out."""
    parts = F.split("path", "/")
    folder = F.when(F.element_at(parts, -2) == "images", F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    return listing.withColumn("raw_split", folder).join(F.broadcast(splits), "raw_split")  # a few rows


def scene_frames(listing: DataFrame) -> DataFrame:
    """listing (path, ...) of .../<split>/<scene>/<frame>.<extension> with split and scene."""
    parts = F.split("path", "/")
    return listing.withColumn("split", F.element_at(parts, -3)).withColumn("scene", F.element_at(parts, -2))


def labelled_frames(listing: DataFrame, labels: DataFrame) -> DataFrame:
    """The listing with n_boxes, 0 for frames without label file or with an empty one."""
    counts = labels.groupBy("stem").agg(F.count("*").alias("n_boxes"))
    return listing.join(counts, "stem", "left").fillna(0, "n_boxes")


def pixel_boxes(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """labels (as ``label_rows`` gives them without clamping) with corners in pixels; sizes: stem, width, height."""
    box = g.centre_to_corners(F.struct("cx", "cy", "w", "h"), F.col("width"), F.col("height"))
    return labels.join(sizes, "stem").withColumn("_b", box).select(*labels.columns, "_b.x1", "_b.y1", "_b.x2", "_b.y2")


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema.SPLITS)


def normalized_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema.NORMALIZED)


def altitude_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema.ALTITUDE_MANIFEST)


def flight_log(spark: SparkSession, path: str) -> DataFrame:
    """(frame, altitude_m): file names of a column filename or else frame; rows without a number are left out, of several rows the last counts."""
    return logged_altitudes(spark.read.csv(path, header=True).withColumn("_n", F.monotonically_increasing_id()))


def logged_altitudes(read: DataFrame) -> DataFrame:
    """The same of rows of text columns, in the order of ``_n``."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("filename", "frame") if c in read.columns]
    rows = read.select(F.element_at(F.split(F.coalesce(*names), "/"), -1).alias("frame"), F.expr("try_cast(altitude_m AS double)").alias("altitude_m"), F.col("_n").alias("n"))
    return rows.filter("altitude_m IS NOT NULL").groupBy("frame").agg(F.max_by("altitude_m", "n").alias("altitude_m"))


def cached(spark: SparkSession, folder: str, key: dict, build, rebuild: bool = False) -> DataFrame:
    """The parquet partition of a prediction cache for a key (model, tile, overlap, ...), built where it is missing.

    ``build()`` gives the DataFrame to keep. A partition without rows counts as missing.
    """
    where = F.lit(True)
    for name, value in key.items():
        where = where & (F.col(name).cast("string") == str(value))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and not rebuild:
        found = spark.read.parquet(folder).filter(where)
        if not found.isEmpty():
            return found
    keyed = build()
    for name, value in key.items():
        keyed = keyed.withColumn(name, F.lit(value))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(folder)
    return spark.read.parquet(folder).filter(where)
