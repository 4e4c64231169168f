"""Tiling plans: the knee of a blind sweep, method grids, animals onto crops."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transect.functions import flight
from transect.functions import geometry as g
from transect.operators import fusion, matching
from transect.operators.ordering import percentiles, running_min, running_total
from transect.session import prepare


def sweep_knee(counts: DataFrame, by: Sequence[str], ratio: float = 0.10) -> DataFrame:
    """(by, slice): of sweep counts (by, slice, n), the slice before the first that adds less than ``ratio``, from large to small; else the smallest."""
    w = Window.partitionBy(*by).orderBy(F.col("slice").desc())
    steps = counts.withColumn("_before", F.lag("n").over(w)).withColumn("_larger", F.lag("slice").over(w))
    gain = (F.col("n") - F.col("_before")) / F.greatest(F.col("_before"), F.lit(1))
    stop = F.when(F.col("_before").isNotNull() & (gain < ratio), F.col("_larger"))
    return steps.groupBy(*by).agg(F.coalesce(F.max(stop), F.min("slice")).alias("slice"))


def method_grid(frames: DataFrame, fixed: Sequence[int] = (640, 1024), overlap: float = 0.2) -> DataFrame:
    """frames (width, height, gsd, ...) x methods: plain, fixed slices, adaptive, adaptive_range, with slice and tiles."""
    width, height, distance = F.col("width"), F.col("height"), F.col("gsd")
    adaptive = flight.slice_decision(width, height, given_gsd=distance)
    ranged = flight.slice_decision(width, height, given_gsd=distance, max_len_m=F.lit(18.2))
    methods = [F.struct(F.lit("plain").alias("method"), F.lit(None).cast("int").alias("slice"))]
    methods += [F.struct(F.lit(f"fixed{s}").alias("method"), F.lit(s).alias("slice")) for s in fixed]
    methods += [F.struct(F.lit("adaptive").alias("method"), adaptive.slice_size.alias("slice")), F.struct(F.lit("adaptive_range").alias("method"), ranged.slice_size.alias("slice"))]
    out = frames.withColumn("_m", F.explode(F.array(*methods))).select(*frames.columns, "_m.method", "_m.slice")
    return out.withColumn("tiles", flight.tile_count(width, height, F.col("slice"), overlap))


def method_metrics(grid: DataFrame, dets: DataFrame, truth: DataFrame, threshold: float = 0.3) -> DataFrame:
    """grid (frame, method, ...) with tp, fp, fn, recall, precision and f1 of the frame by the method; frames without boxes or detections too.

    dets: frame, method, det_seq, box, score, as the detector finds them in a frame by a method. Each method is matched alone:
    matching's frame is a frame by a method.
    """
    key = F.struct("frame", "method")
    wanted = grid.select("frame", "method").distinct()
    boxes = truth.join(wanted, "frame").withColumn("frame", key).drop("method")
    matched = matching.greedy_match(dets.withColumn("frame", key).drop("method"), boxes, "iou", threshold)
    hits = matched.groupBy("frame").agg(F.count_if(F.col("gt_idx").isNotNull()).alias("tp"), F.count_if(F.col("gt_idx").isNull()).alias("fp")).select("frame.frame", "frame.method", "tp", "fp")
    return _metrics(grid, hits, truth)


def score_metrics(grid: DataFrame, least: dict[str, float], dets: DataFrame, truth: DataFrame, threshold: float = 0.3) -> DataFrame:
    """As method_metrics, where a method's detections are those of ``dets`` (frame, det_seq, box, score) from a score on.

    What a detection gets depends on higher scores alone, so one match serves all methods.
    """
    matched = matching.greedy_match(dets, truth, "iou", threshold).select("frame", "score", "gt_idx")
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(s)).alias("least")) for m, s in least.items()])
    reached = matched.withColumn("_m", F.explode(F.filter(methods, lambda m: F.col("score") >= m["least"]))).withColumn("method", F.col("_m.method"))
    hits = reached.groupBy("frame", "method").agg(F.count_if(F.col("gt_idx").isNotNull()).alias("tp"), F.count_if(F.col("gt_idx").isNull()).alias("fp"))
    return _metrics(grid, hits, truth)


def _metrics(grid: DataFrame, hits: DataFrame, truth: DataFrame) -> DataFrame:
    counts = grid.join(hits, ["frame", "method"], "left").join(truth.groupBy("frame").agg(F.count("*").alias("_gt")), "frame", "left").fillna(0, ["tp", "fp", "_gt"])
    fn = F.col("_gt") - F.col("tp")
    prec, rec = g.precision(F.col("tp"), F.col("fp")), g.recall(F.col("tp"), fn)
    return counts.select(*grid.columns, "tp", "fp", fn.alias("fn"), rec.alias("recall"), prec.alias("precision"), g.f1(prec, rec).alias("f1"))


def animals_at(animals: DataFrame, altitudes: DataFrame, least_px: float) -> DataFrame:
    """animals (native_px, length_m, ...) x altitudes (altitude_m, gsd in m/px) with apparent_px: never enlarged, and left out below ``least_px``."""
    seen = animals.crossJoin(F.broadcast(altitudes)).withColumn("apparent_px", g.apparent_size(F.col("native_px"), F.col("length_m"), F.col("gsd")))
    return seen.filter(F.col("apparent_px") >= least_px)


def altitude_manifest(animals: DataFrame, altitudes: DataFrame, least_px: float) -> DataFrame:
    """(altitude_m, gsd_cm_px, n_animals, min_px, max_px, len_min_m, len_max_m, len_median_m): sizes of what is shown at an
    altitude (0 where nothing is), lengths of all animals; of two middle lengths the larger."""
    sizes = animals_at(animals, altitudes, least_px).groupBy("altitude_m").agg(F.count("*").alias("n_animals"), F.min(F.rint("apparent_px")).alias("min_px"), F.max(F.rint("apparent_px")).alias("max_px"))
    # lengths are counted by value and summed in order, so no task has them all
    whole = percentiles(animals.select(F.lit(0).alias("whole"), "length_m"), "whole", "length_m", [0.0, 0.5, 1.0], "upper").filter("_all = 1")
    lengths = whole.select(*[F.bround(F.col("values")[k], 2).alias(n) for k, n in enumerate(("len_min_m", "len_median_m", "len_max_m"))])
    out = altitudes.join(sizes, "altitude_m", "left").fillna(0, ["n_animals", "min_px", "max_px"]).join(F.broadcast(lengths), F.lit(True), "left")
    return out.select("altitude_m", F.bround(F.col("gsd") * 100, 3).alias("gsd_cm_px"), "n_animals", "min_px", "max_px", "len_min_m", "len_max_m", "len_median_m")


def assign_crops(lengths: DataFrame, crops: DataFrame, gsd_min: float, by: str = "scene") -> DataFrame:
    """(by, len_id, crop_id): lengths, longest first, each take the largest unused crop that is at least length / gsd_min pixels;
    a length that no crop can show is left out and uses none.

    If the largest unused crop is too small for a length, it is for no later one alone that it may do: so crops are used in
    order, and a length fits exactly if the next unused crop does. With need(j) crops that are large enough for the j-th length,
    i + min(0, min over j <= i of (need(j) - j)) are used after i lengths: ranks and a running minimum, no scene in one row.
    """
    ls = lengths.filter("length_m IS NOT NULL").select(by, F.lit(1).alias("_kind"), (F.col("length_m") / F.lit(gsd_min)).cast("double").alias("_px"), F.col("length_m").cast("double").alias("_length"), "len_id")
    cs = crops.filter("native_px IS NOT NULL").select(by, F.lit(0).alias("_kind"), F.col("native_px").cast("double").alias("_px"), "crop_id")
    rows = ls.unionByName(cs, allowMissingColumns=True).filter(F.col(by).isNotNull())
    order = [F.col("_px").desc(), F.col("_kind"), F.col("_length").desc(), F.col("len_id"), F.col("crop_id")]  # crops before the lengths that they just do for
    for kind, name in ((0, "_crops"), (1, "_lengths")):
        rows = running_total(rows, [F.col(by), *order], F.when(F.col("_kind") == kind, 1).otherwise(0), name)
    firsts = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_crops").alias("_crops0"), F.min("_lengths").alias("_lengths0"))
    ranked = rows.join(firsts, F.col(by) == F.col("_by")).select(by, "_kind", "_px", "_length", "len_id", "crop_id", (F.col("_crops") - F.col("_crops0")).alias("_crops"), (F.col("_lengths") - F.col("_lengths0")).alias("_i"))
    wanted = running_min(ranked.filter("_kind = 1").drop("crop_id"), [by], order[:-1], F.col("_crops") - F.col("_i") - 1, "_least")
    wanted = wanted.withColumn("_next", F.col("_i") + F.least(F.lit(0), "_least")).filter("_next < _crops").select(by, "len_id", "_next")
    return wanted.join(ranked.filter("_kind = 0").select(by, "crop_id", F.col("_crops").alias("_next")), [by, "_next"]).select(by, "len_id", "crop_id")


def body_lengths(n: DataFrame, distribution: str, seed: int, fixed: float = 3.0, whole: tuple = (1.5, 18.0), small: tuple = (1.5, 4.0), large: tuple = (8.0, 18.0), share_large: float = 0.2) -> DataFrame:
    """n (rows with ``id``) with length_m: fixed, uniform, or a mixture of small and large animals; hashed from seed and id."""
    u = [F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(k), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52) for k in range(2)]
    between = lambda r: F.lit(r[0]) + u[1] * F.lit(r[1] - r[0])
    kinds = {"fixed": F.lit(fixed), "uniform": between(whole), "mixture": F.when(u[0] < share_large, between(large)).otherwise(between(small))}
    if distribution not in kinds:
        raise ValueError(f"unknown length distribution: {distribution}")
    return n.withColumn("length_m", kinds[distribution])


def detected_at_native_scale(animals: DataFrame, dets: DataFrame, least_px: float, threshold: float = 0.3) -> DataFrame:
    """animals (frame, x1, y1, x2, y2, ...) whose longer side, in whole pixels, is ``least_px`` or more and that some detection overlaps at the threshold or above."""
    size = F.greatest(F.rint("x2") - F.rint("x1"), F.rint("y2") - F.rint("y1"))
    other = dets.select(F.col("frame").alias("gframe"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    whole = [F.rint(c) for c in ("x1", "y1", "x2", "y2")]
    near = g.iou(*whole, "gx1", "gy1", "gx2", "gy2") >= threshold
    return animals.filter(size >= least_px).join(other, (F.col("frame") == F.col("gframe")) & near, "left_semi")


def planned_tiles(plan: DataFrame, overlap: float = 0.2) -> DataFrame:
    """plan (frame, width, height, slice, ...) with x, y, tile_w and tile_h of every tile; the whole frame for a null slice.

    Spark takes an explosion for as large as what explodes, and would broadcast the tiles of a million frames, through the driver. So
    frames are dealt out before they have tiles, and a join with tiles is one by sorting.
    """
    size = F.coalesce("slice", F.greatest("width", "height"))
    step = size - F.floor(F.lit(overlap) * size).cast("int")

    def along(side: str) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.col(side) - size) / step).cast("int"), F.lit(0))), lambda k: F.least(k * step, F.col(side) - F.least(size, F.col(side))))
        return F.when(size >= F.col(side), F.array(F.lit(0))).otherwise(full)

    out = plan.repartition("frame").withColumn("x", F.explode(along("width"))).withColumn("y", F.explode(along("height")))
    return out.withColumn("tile_w", F.least(size, F.col("width"))).withColumn("tile_h", F.least(size, F.col("height"))).hint("merge")


def adaptive_prediction(frames: DataFrame, detect: Callable[[DataFrame], DataFrame], conf: float = 0.3, overlap: float = 0.2, seams: float | None = 0.5, **decision: Column) -> DataFrame:
    """(frame, det_seq, x1, y1, x2, y2, score) of frames (frame, width, height, ...): the decision of each, its tiles, and what ``detect`` finds in them.

    detect gets the tiles (frame's columns, slice, mode, x, y, tile_w, tile_h) and gives (frame, x, y, det_seq, x1, y1, x2, y2,
    score) in pixels of the tile; those from ``conf`` on are kept, and moved to the frame. decision: arguments of
    ``flight.slice_decision``. A frame's detections are numbered by tile and det_seq. What tiles of a sliced frame saw twice is
    merged where it overlaps by ``seams`` of the smaller box (``fusion.merge_seams``); None leaves it.
    """
    return _predicted(decided(frames, **decision), detect, conf, overlap, seams)


def decided(frames: DataFrame, **decision: Column) -> DataFrame:
    """frames (width, height, ...) with mode and slice (null unless it is sliced); decision: arguments of ``flight.slice_decision``."""
    chosen = frames.withColumn("_d", flight.slice_decision(F.col("width"), F.col("height"), **decision))
    return chosen.withColumn("slice", F.when(F.col("_d.mode") == "sahi", F.col("_d.slice_size"))).withColumn("mode", F.col("_d.mode")).drop("_d")


def _predicted(chosen: DataFrame, detect: Callable[[DataFrame], DataFrame], conf: float, overlap: float, seams: float | None) -> DataFrame:
    found = detect(planned_tiles(chosen, overlap)).filter(F.col("score") >= conf)
    moved = found.select("frame", "x", "y", "det_seq", *[(F.col(c) + F.col(c[0])).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "score")
    nth = F.row_number().over(Window.partitionBy("frame").orderBy("y", "x", "det_seq"))  # a frame's detections
    moved = moved.withColumn("det_seq", nth.cast("long")).drop("x", "y")
    if seams is None:
        return moved
    prepare(moved.sparkSession)
    sliced = chosen.filter("slice IS NOT NULL").select(F.col("frame").alias("_of")).distinct().hint("merge")  # there may be millions of frames
    told = moved.join(sliced, F.col("frame") == F.col("_of"), "left").checkpoint()
    return told.filter("_of IS NULL").drop("_of").unionByName(fusion.merge_seams(told.filter("_of IS NOT NULL").drop("_of"), seams))


def ensemble_members(frames: DataFrame, models: Sequence[dict], overlap: float = 0.2, seams: float | None = 0.5, **decision: Column) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By label of a model its decisions (frames with mode and slice) and detections, each with tiles of its own scale.

    A model is a dict of ``detect`` (as in ``adaptive_prediction``), ``label`` (its number by default) and of what is its own: conf, and
    target_px, target_len_m and min_slice of its decision.
    """
    found = {}
    for k, model in enumerate(models):
        own = {n: F.lit(v) for n, v in model.items() if n in ("target_px", "target_len_m", "min_slice")}
        chosen = decided(frames, **decision, **own)
        found[str(model.get("label", k))] = chosen, _predicted(chosen, model["detect"], model.get("conf", 0.3), overlap, seams)
    if len(found) < len(models):
        raise ValueError("labels of models differ")
    return found


def ensemble_predict(frames: DataFrame, models: Sequence[dict], fuse: str = "wbf", weights: Sequence[float] | None = None, threshold: float | None = None, least: float = 0.0, overlap: float = 0.2, seams: float | None = 0.5, **decision: Column) -> tuple[DataFrame, dict[str, tuple[DataFrame, DataFrame]]]:
    """Fused detections of several models, and what ``ensemble_members`` gives. Fusion counts boxes of frames, so it runs all detectors once before
    its own job: who needs no fusion takes the members alone."""
    found = ensemble_members(frames, models, overlap, seams, **decision)
    return fusion.fuse_detections([dets for _, dets in found.values()], fuse, weights, threshold, least), found


def ensemble(frames: DataFrame, models: Sequence[dict], fuse: str = "wbf", weights: Sequence[float] | None = None, threshold: float | None = None, least: float = 0.0, overlap: float = 0.2, seams: float | None = 0.5, **decision: Column) -> DataFrame:
    """The fused detections of ``ensemble_predict``."""
    return ensemble_predict(frames, models, fuse, weights, threshold, least, overlap, seams, **decision)[0]


def score_frames(frames: DataFrame, load_model, columns: Sequence[str], conf: float = 0.0) -> DataFrame:
    """(frame, det_seq, x1, y1, x2, y2, score) by an opaque detector; scores below ``conf`` don't leave the task.

    load_model() is called once for each task and returns a function from a pandas frame of ``columns`` (with frame) to a list,
    for each row, of (x1, y1, x2, y2, score).
    """
    prepare(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load_model()
        for batch in batches:
            rows = [(f, k, *map(float, d)) for f, found in zip(batch["frame"], detect(batch), strict=True) for k, d in enumerate(found) if d[4] >= conf]
            yield pd.DataFrame(rows, columns=["frame", "det_seq", "x1", "y1", "x2", "y2", "score"])

    kind = dict(frames.dtypes)["frame"]
    return frames.select("frame", *columns).mapInPandas(run, f"frame {kind}, det_seq int, x1 double, y1 double, x2 double, y2 double, score double")
