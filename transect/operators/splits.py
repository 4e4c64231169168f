"""Train, validation and test splits. A seeded hash stands for a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transect.operators.ordering import hash_rank, running_total, seeded

TRAIN, VAL, TEST, SEED = 0.80, 0.15, 0.05, 1337


def random_split(frames: DataFrame, by: Sequence[str], key: str, seed: int = SEED) -> DataFrame:
    """frames with ``split``: of each group, the first rint(0.8 n) by hash to train, the next rint(0.15 n) to val."""
    sizes = frames.groupBy(*by).agg(F.count("*").alias("_size"))
    ranked = hash_rank(frames.withColumn("_digest", seeded(seed, F.col(key))), by, "_digest", "_rank").drop("_digest")
    same = F.lit(True)
    for b in by:
        same = same & ranked[b].eqNullSafe(sizes[b])
    ranked = ranked.join(sizes, same).drop(*[sizes[b] for b in by])
    train, val = F.rint(F.col("_size") * TRAIN), F.rint(F.col("_size") * VAL)
    return ranked.withColumn("split", F.when(F.col("_rank") < train, "train").when(F.col("_rank") < train + val, "val").otherwise("test")).drop("_rank", "_size")


def every_nth(frames: DataFrame, scene: str, order: Sequence[str], stride: int) -> DataFrame:
    """frames with ``kept``: 1 for every stride-th frame of a scene."""
    nth = F.row_number().over(Window.partitionBy(scene).orderBy(*order)) - 1
    return frames.withColumn("kept", F.when(nth % stride == 0, 1).otherwise(0))


def scene_split(frames: DataFrame, scene: str, order: Sequence[str], stride: int, seed: int = SEED) -> DataFrame:
    """Whole scenes, in hash order, to train while fewer than 0.8 of all frames came before, to val below 0.95, then to test; strided."""
    sizes = frames.groupBy(F.col(scene).alias("_scene")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    before = running_total(sizes.withColumn("_digest", seeded(seed, F.col("_scene"))), [F.col("_digest"), F.col("_scene")], F.col("_n"), "_before").crossJoin(F.broadcast(total))
    split = F.when(F.col("_before") < F.col("_total") * TRAIN, "train").when(F.col("_before") < F.col("_total") * (TRAIN + VAL), "val").otherwise("test")
    joined = frames.join(before.select("_scene", split.alias("split")), F.col(scene).eqNullSafe(F.col("_scene"))).drop("_scene")
    return every_nth(joined, scene, order, stride)


def all_test_split(frames: DataFrame, scene: str, order: Sequence[str], stride: int) -> DataFrame:
    return every_nth(frames.withColumn("split", F.lit("test")), scene, order, stride)


def density_split(groups: DataFrame) -> DataFrame:
    """groups (group, frames, boxes, first) with ``split``.

    Groups without boxes train. The others, thinnest and then largest first (then by ``first``), fill test while it has fewer
    than 0.05 of all frames, then val while that has fewer than 0.15; the densest train. val begins where test has overshot.
    """
    total = groups.agg(F.sum("frames").alias("_total")).crossJoin(groups.limit(0).agg(F.count("*").alias("_zero"))).select("_total")
    full = groups.filter("boxes > 0").withColumn("density", F.col("boxes").cast("double") / F.col("frames"))
    order = [F.col("density"), F.col("frames").desc(), F.col("first")]
    placed = running_total(full, order, F.col("frames"), "_before").crossJoin(F.broadcast(total))
    in_test = F.col("_before") < F.col("_total") * TEST
    test_size = placed.filter(in_test).agg(F.coalesce(F.sum("frames"), F.lit(0)).alias("_test"))
    placed = placed.crossJoin(F.broadcast(test_size))
    in_val = (F.col("_before") - F.col("_test")) < F.col("_total") * VAL
    placed = placed.withColumn("split", F.when(in_test, "test").when(in_val, "val").otherwise("train"))
    empty = groups.filter("boxes = 0").withColumn("density", F.lit(0.0)).withColumn("split", F.lit("train"))
    return placed.select(*empty.columns).unionByName(empty)


def straddling_groups(rows: DataFrame, group: str) -> DataFrame:
    """(group, splits) of the groups that lie in more than one split: none after a split by whole groups."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")
