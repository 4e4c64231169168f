"""The registry of annotation sources, how each is split, and the training variants, as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transect import schema

# Name, domain, format, path, and raw splits with what they count as, in emission order.
SOURCES = (
    ("aerial-right-whale", "aerial", "roboflow", "aerial/labeled/aerial-right-whale", {"train": "train", "valid": "val", "test": "test"}),
    ("whale-bbox-layer", "aerial", "roboflow", "aerial/labeled/whale-bbox-layer", {"train": "train", "valid": "val", "test": "test"}),
    ("uav-porpoises", "aerial", "uav_scenes", "aerial/labeled/uav-porpoises", {"train": "train", "val": "val", "test": "test"}),
    ("dryad", "aerial", "via", "aerial/labeled/dryad", {"train_subset_1": "train", "train_subset_2": "train", "val": "val", "test": "test"}),
    ("cetacean-detection", "surface", "roboflow", "surface/labeled/cetacean-detection", {"train": "train", "valid": "val", "test": "test"}),
    ("cetacean-detector", "surface", "roboflow", "surface/labeled/cetacean-detector", {"train": "train", "valid": "val", "test": "test"}),
    ("dolphin", "surface", "roboflow", "surface/labeled/dolphin", {"train": "train", "valid": "val", "test": "test"}),
    ("dolphin2", "surface", "roboflow", "surface/labeled/dolphin2", {"train": "train", "valid": "val", "test": "test"}),
    ("whaleshape", "aerial", "coco", "aerial/labeled/dryad_doi_10_5061_dryad_6q573n668__v20260312", {"train.json": "train", "test.json": "test"}),
)
# Source, label folder, split strategy, stride, role.
SPLIT_CONFIG = (
    ("gommapps", "labels_with_inferred", "gommapps", None, None),
    ("uav-porpoises", "labels", "scene_stride", 5, None),
    ("whale-bbox-layer", "labels", "all_test_stride", 5, "precision_test"),
    ("aerial-right-whale", "labels", "random", None, None),
    ("cetacean-detection", "labels", "random", None, None),
    ("cetacean-detector", "labels", "random", None, None),
    ("dolphin", "labels", "random", None, None),
    ("dolphin2", "labels", "random", None, None),
    ("dryad", "labels", "random", None, None),
    ("whaleshape", "labels", "random", None, None),
)
AERIAL = ("aerial-right-whale", "dryad", "whaleshape", "uav-porpoises", "gommapps")
SURFACE = ("cetacean-detection", "cetacean-detector", "dolphin", "dolphin2")


def sources(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """The registered sources, or those named; a name that isn't registered is an error."""
    known = [s[0] for s in SOURCES]
    unknown = [n for n in names or () if n not in known]
    if unknown:
        raise ValueError(f"unknown source: {', '.join(unknown)}; known: {', '.join(known)}")
    rows = [(s[0], k, *s[1:]) for k, s in enumerate(SOURCES) if names is None or s[0] in names]
    return spark.createDataFrame(rows, schema.SOURCE_REGISTRY)


def selected(rows: DataFrame, names: Sequence[str], source: str = "source") -> DataFrame:
    """rows of the sources that are named, with what is registered of them; a name that isn't registered is an error. The registry is a few rows."""
    asked = sources(rows.sparkSession, names).withColumnRenamed("name", "_name")
    return rows.join(F.broadcast(asked), F.col(source) == F.col("_name")).drop("_name")


def split_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPLIT_CONFIG), schema.SPLIT_CONFIG)


def with_split_config(rows: DataFrame, source: str = "source") -> DataFrame:
    """rows with label_dir, strategy, stride and role of their source; null for sources without configuration. The table has ten rows."""
    config = split_config(rows.sparkSession).withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(config), F.col(source) == F.col("_source"), "left").drop("_source")


def variants(spark: SparkSession) -> DataFrame:
    """(variant, sources, dose): the training sets; sources by concatenation and difference of the lists of two domains."""
    strings = lambda names: F.array(*[F.lit(n) for n in names])
    both, aerial = F.concat(strings(AERIAL), strings(SURFACE)), strings(AERIAL)
    # fixed values: the doses
    rows = (("B", aerial, 0.10), ("E1", both, 0.10), ("E2", F.array_except(aerial, strings(["uav-porpoises"])), 0.10), ("E4_0", aerial, 0.00), ("E4_20", aerial, 0.20))
    made = F.array(*[F.struct(F.lit(v).alias("variant"), s.alias("sources"), F.lit(d).alias("dose")) for v, s, d in rows])
    return spark.range(1).select(F.explode(made).alias("v")).select("v.variant", "v.sources", "v.dose")
