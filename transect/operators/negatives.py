"""Negative frames and tiles: tile grids, overlap checks, decisions, ranking, dosing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transect.functions import geometry as g
from transect.operators.ordering import hash_rank, running_total, seeded


def empty_frames(frames: DataFrame, boxes: DataFrame, key: str = "frame") -> DataFrame:
    return frames.join(boxes.select(key).distinct(), key, "left_anti")


def tile_grid(frames: DataFrame, sizes: Sequence[int], width: str = "width", height: str = "height") -> DataFrame:
    """frames x tile sizes x origins, with the last tiles flush with the edges: tile, x, y."""
    tiled = frames.withColumn("tile", F.explode(F.array(*[F.lit(s) for s in sizes])))
    tiled = tiled.withColumn("x", F.explode(g.edge_flush_origins(F.col(width), F.col("tile"))))
    return tiled.withColumn("y", F.explode(g.edge_flush_origins(F.col(height), F.col("tile"))))


def negative_pool(frames: DataFrame, sizes: Sequence[int], validated: DataFrame) -> DataFrame:
    """(image, kind, parent, w, h): of frames (stem, width, height) without boxes the full frame and all tiles, and the validated tiles (name, w, h) of others."""
    full = frames.select(F.concat("stem", F.lit("__full.jpg")).alias("image"), F.lit("full").alias("kind"), F.col("stem").alias("parent"), F.col("width").alias("w"), F.col("height").alias("h"))
    tiles = tile_grid(frames, sizes).select(F.format_string("%s__t%d_x%d_y%d.jpg", "stem", "tile", "x", "y").alias("image"), F.concat(F.lit("tile"), "tile").alias("kind"), F.col("stem").alias("parent"), F.least("tile", "width").alias("w"), F.least("tile", "height").alias("h"))
    return full.unionByName(tiles).unionByName(validated.select(F.concat(F.lit("val__"), "name").alias("image"), F.lit("validated").alias("kind"), F.col("name").alias("parent"), "w", "h"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def tile_decisions(tiles: DataFrame, train_parents: DataFrame, boxes: DataFrame, geometry_known: Column) -> DataFrame:
    """tiles (pool, name, parent, x1, y1, x2, y2, pool_ord) with ``decision``, the first check that fails:
    no_geom, parent_not_train, overlaps, duplicate (a name that an earlier pool has), or keep.

    boxes: parent, bx1, by1, bx2, by2. The overlap check is a semi join on the parent with a residual."""
    known = tiles.withColumn("_row", F.struct("pool_ord", "name"))
    parents = train_parents.select(F.col("parent").alias("_p")).distinct().withColumn("_train", F.lit(True))
    hits = tiles.join(boxes.withColumnRenamed("parent", "_b"), (F.col("parent") == F.col("_b")) & g.overlaps("x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2"), "left_semi")
    hits = hits.select(F.struct("pool_ord", "name").alias("_hit")).distinct().withColumn("_overlaps", F.lit(True))
    flagged = known.join(parents, F.col("parent") == F.col("_p"), "left").join(hits, F.col("_row") == F.col("_hit"), "left")
    reason = F.when(~geometry_known, "drop:no_geom").when(F.col("_train").isNull(), "drop:parent_not_train").when(F.col("_overlaps"), "drop:overlaps")
    flagged = flagged.withColumn("_reason", reason)
    nth = F.row_number().over(Window.partitionBy("name", F.col("_reason").isNull()).orderBy("pool_ord"))
    decision = F.coalesce("_reason", F.when(nth > 1, F.lit("drop:duplicate")).otherwise(F.lit("keep")))
    return flagged.withColumn("decision", decision).select(*tiles.columns, "decision")


def hardness(frames: DataFrame, false_positives: str, confidence: str, stem: str) -> DataFrame:
    """frames with ``rank``, hardest first; equal ones by stem."""
    order = [F.col(false_positives).desc(), F.col(confidence).desc(), F.col(stem)]
    return running_total(frames, order, F.lit(1), "_before").withColumn("rank", F.col("_before") + 1).drop("_before")


def dose_count(positives: Column, dose: Column, pool: Column) -> Column:
    """Negatives for a share ``dose`` of all: rint(n d / (1 - d)), no more than the pool, 0 for no dose."""
    return F.when(dose > 0, F.least(F.rint(positives * dose / (1 - dose)).cast("long"), pool)).otherwise(F.lit(0).cast("long"))


def dosed(pool: DataFrame, key: str, counts: DataFrame, seed: int) -> DataFrame:
    """For each row (variant, n_neg) of counts, the first n_neg rows of the pool in hash order."""
    ranked = hash_rank(pool.withColumn("_digest", seeded(seed, F.col(key))).withColumn("_all", F.lit(1)), ["_all"], "_digest", "_rank").drop("_digest", "_all")
    return ranked.crossJoin(F.broadcast(counts)).filter(F.col("_rank") < F.col("n_neg")).drop("_rank")  # counts: a few variants
