"""Detections against ground truth: greedy one-to-one matching, sweeps, FROC curves.

Matching goes by descending score (equal scores in input order). With boxes, a detection takes the free ground truth of
highest IoU, at the threshold or above, of equal ones the last; with centres, the first free one that its centre lies in.
What a detection gets depends on higher scores alone, so one match without a threshold serves all thresholds: counts at a
threshold are those of the detections that reach it.

A frame's detections fold in one row, JVM-side, after an outer join on the frame with the overlap as a residual, all in the partition that
the frame is dealt to. Frames with more than ``spatial.HOT_BOXES`` boxes aren't folded: their pairs come from a join by
cells, and are matched by deferred acceptance, in rounds of joins and minima over all of them (``by_rounds``), with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transect.functions import geometry as g
from transect.operators import spatial
from transect.operators.ordering import running_min, running_total
from transect.session import prepare

_D, _G = ("x1", "y1", "x2", "y2"), ("gx1", "gy1", "gx2", "gy2")


def _truth(truth: DataFrame) -> DataFrame:
    return truth.select(F.col("frame").alias("gframe"), "gt_idx", *[F.col(c).alias(n) for c, n in zip(_D, _G, strict=True)])


def pairs(dets: DataFrame, truth: DataFrame, threshold: float = 0.3, most: int = spatial.HOT_BOXES) -> DataFrame:
    """(frame, det_seq, gt_idx, iou) of all pairs in a frame at the threshold or above."""
    return _iou_pairs(spatial.joined(dets, _truth(truth), most=most), threshold)


def _iou_pairs(met: DataFrame, threshold: float) -> DataFrame:
    return met.withColumn("iou", g.iou(*_D, *_G)).filter(F.col("iou") >= threshold).select("frame", "det_seq", "score", "gt_idx", "iou")


def centre_pairs(dets: DataFrame, truth: DataFrame, most: int = spatial.HOT_BOXES) -> DataFrame:
    return spatial.joined(dets, _truth(truth), True, most).select("frame", "det_seq", "score", "gt_idx", F.lit(1.0).alias("iou"))


def _choices(mode: str) -> Column:
    """What a detection takes first, as an order."""
    if mode == "iou":
        return F.struct((-F.col("iou")).alias("a"), (-F.col("gt_idx")).alias("b"), F.col("gt_idx").alias("g"))
    return F.struct(F.lit(0.0).alias("a"), F.col("gt_idx").alias("b"), F.col("gt_idx").alias("g"))


def by_rounds(found: DataFrame, mode: str) -> DataFrame:
    """(m_frame, m_seq, gt_idx): what detections take of pairs (frame, det_seq, score, gt_idx, iou), by deferred acceptance.

    Each detection asks for the first choice that is left to it, each box holds the best of those that ask, and all pairs of the box with worse
    detections go, whether they asked or not, until none goes. Boxes rank detections alike, by score, so what is held then
    is what taking turns by score gives. A round is two sums and a join over the pairs that are left, checkpointed; there is one
    for each step of the longest chain of detections that displace one another.
    """
    prepare(found.sparkSession)
    left = found.select("frame", "det_seq", "gt_idx", F.struct((-F.col("score")).alias("s"), F.col("det_seq").alias("d")).alias("rank"), _choices(mode).alias("choice")).checkpoint()
    n = left.count()
    while True:
        asks = left.groupBy("frame", "det_seq").agg(F.min(F.struct("choice", "rank")).alias("first")).select("frame", "det_seq", F.col("first.choice.g").alias("gt_idx"), "first.rank")
        held = asks.groupBy(F.col("frame").alias("_f"), F.col("gt_idx").alias("_g")).agg(F.min("rank").alias("held"))
        left = left.join(held, (F.col("frame") == F.col("_f")) & (F.col("gt_idx") == F.col("_g")), "left").filter("held IS NULL OR rank <= held").drop("_f", "_g", "held").checkpoint()
        before, n = n, left.count()
        if n == before:
            return asks.select(F.col("frame").alias("m_frame"), F.col("det_seq").alias("m_seq"), "gt_idx")


def _known(mode: str) -> None:
    if mode not in ("iou", "centre"):
        raise ValueError(f"unknown matching mode: {mode}")


def greedy_match(dets: DataFrame, truth: DataFrame, mode: str = "iou", threshold: float = 0.3, most: int = spatial.HOT_BOXES) -> DataFrame:
    """dets (frame, det_seq, box, score) with ``gt_idx``: what each one takes, or null for a false positive. Frames with more
    than ``most`` boxes go by cells and rounds, others fold in a row each."""
    _known(mode)
    return _matched(dets, truth, spatial.hot_frames(dets, truth, most=most), mode, threshold)


def _matched(dets: DataFrame, truth: DataFrame, hot: DataFrame | None, mode: str, threshold: float) -> DataFrame:
    """As greedy_match, where the frames that don't fold are known."""
    few, many = (dets, None) if hot is None else spatial.divided(dets, hot)
    of_few, of_many = (truth, None) if hot is None else spatial.divided(truth, hot)
    whole, back = ["frame", "det_seq", *_D, "score"], lambda taken: (F.col("frame") == F.col("m_frame")) & (F.col("det_seq") == F.col("m_seq"))
    near = g.overlaps(*_D, *_G) & (g.iou(*_D, *_G) >= threshold) if mode == "iou" else g.centre_inside(*_D, *_G)
    # detections that meet nothing stay in the join and in the fold, so that none is dealt out again to be put beside what it takes
    met = few.select(*whole).join(_truth(of_few), (F.col("frame") == F.col("gframe")) & near, "left")
    found = met.withColumn("iou", g.iou(*_D, *_G) if mode == "iou" else F.lit(1.0))
    matched = _folded(found, mode, dets, truth)
    if set(dets.columns) - set(whole):  # columns of other kinds needn't be sorted with the detections
        taken = matched.filter("gt_idx IS NOT NULL").select(F.col("frame").alias("m_frame"), F.col("det_seq").alias("m_seq"), "gt_idx")
        matched = few.join(taken, back(taken), "left")
    matched = matched.select(*dets.columns, "gt_idx")
    if hot is None:
        return matched
    found = _iou_pairs(spatial.overlapping(many, _truth(of_many)), threshold) if mode == "iou" else spatial.centred_in(many, _truth(of_many)).withColumn("iou", F.lit(1.0))
    taken = by_rounds(found, mode)
    return matched.unionByName(many.join(taken, back(taken), "left").select(*dets.columns, "gt_idx"))


def _folded(found: DataFrame, mode: str, dets: DataFrame, truth: DataFrame) -> DataFrame:
    """(frame, det_seq, score, gt_idx) and the box where found has it: what each detection takes of its pairs, as by_rounds, or null. A detection
    that meets nothing has one row without gt_idx. By a fold over a frame's pairs in one row, in order of their detections and choices."""
    kind, own = {**dict(dets.dtypes), "gt_idx": dict(truth.dtypes)["gt_idx"]}, [c for c in _D if c in found.columns]
    pair = F.struct((-F.col("score")).alias("s"), "det_seq", _choices(mode).alias("choice"), "gt_idx", "score", *own)
    listed = spatial.numbered_alone(found).groupBy("frame", "_alone").agg(F.array_sort(F.collect_list(pair)).alias("ps"))

    def step(acc: Column, p: Column) -> Column:
        takes = p.gt_idx.isNotNull() & ~F.array_contains(acc.used, p.gt_idx) & ~F.array_contains(acc.of, p.det_seq)
        return F.when(takes, F.struct(F.array_append(acc.used, p.gt_idx).alias("used"), F.array_append(acc.of, p.det_seq).alias("of"))).otherwise(acc)

    start = F.struct(F.expr(f"cast(array() AS array<{kind['gt_idx']}>)").alias("used"), F.expr(f"cast(array() AS array<{kind['det_seq']}>)").alias("of"))
    told = listed.select("frame", "ps", F.aggregate("ps", start, step).alias("t"))
    last = lambda p, k: F.coalesce(p.det_seq != F.get(F.col("ps"), k + 1).det_seq, F.lit(True))
    each = told.select("frame", "t", F.explode(F.filter("ps", last)).alias("p"))
    taken = F.get(F.col("t.used"), (F.array_position(F.col("t.of"), F.col("p.det_seq")) - 1).cast("int"))
    return each.select("frame", "p.det_seq", *[f"p.{c}" for c in own], "p.score", taken.alias("gt_idx"))


def greedy_match_grouped(dets: DataFrame, truth: DataFrame, threshold: float = 0.3) -> DataFrame:
    """As greedy_match with boxes, by a pandas function for each frame: for frames of many thousand boxes, and to check the fold."""
    prepare(dets.sparkSession)

    def match(key: tuple, d: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["score", "det_seq"], ascending=[False, True], kind="stable")
        t = t.sort_values("gt_idx")
        taken, free, out = t[list(_D)].to_numpy(float), np.ones(len(t), bool), []
        for box in d[list(_D)].to_numpy(float):
            w = np.minimum(taken[:, 2], box[2]) - np.maximum(taken[:, 0], box[0])
            h = np.minimum(taken[:, 3], box[3]) - np.maximum(taken[:, 1], box[1])
            inter = np.maximum(w, 0) * np.maximum(h, 0)
            union = (box[2] - box[0]) * (box[3] - box[1]) + (taken[:, 2] - taken[:, 0]) * (taken[:, 3] - taken[:, 1]) - inter
            value = np.where(free & (inter > 0) & (union > 0), inter / np.where(union > 0, union, 1), -1.0)
            if len(value) and value.max() >= threshold:
                j = len(value) - 1 - int(value[::-1].argmax())
                free[j] = False
                out.append(int(t["gt_idx"].iloc[j]))
            else:
                out.append(None)
        return d.assign(gt_idx=pd.array(out, "Int64"))

    columns = [*dets.columns, "gt_idx"]
    types = ", ".join(f"{c} {t}" for c, t in dets.dtypes)
    return dets.groupBy("frame").cogroup(truth.groupBy("frame")).applyInPandas(lambda k, a, b: match(k, a, b)[columns], f"{types}, gt_idx long")


def by_score(matched: DataFrame) -> DataFrame:
    """(score, tp, fp, frames_hit) of matched detections (frame, score, gt_idx): a frame is hit at the best score that takes something there."""
    hit = F.col("gt_idx").isNotNull()
    best = F.row_number().over(Window.partitionBy("frame").orderBy(hit.desc(), F.col("score").desc()))  # a frame's detections
    told = matched.select("score", hit.alias("_hit"), (hit & (best == 1)).alias("_best"))
    return told.groupBy("score").agg(F.count_if("_hit").alias("tp"), F.count_if(~F.col("_hit")).alias("fp"), F.count_if("_best").alias("frames_hit"))


def counts_at(matched: DataFrame, thresholds: DataFrame) -> DataFrame:
    """thresholds (conf) with tp, fp and frames_hit: of detections (frame, score, gt_idx) with score >= conf."""
    return _counts_of(by_score(matched), thresholds)


def _counts_of(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """As counts_at, of detections summed by score: a score counts for the largest threshold that it reaches; running sums over the
    thresholds, a few hundred rows, do the rest.
    """
    listed = thresholds.agg(F.array_sort(F.collect_set("conf")).alias("ts"))
    reached = F.array_max(F.filter("ts", lambda t: t <= F.col("score")))
    per = scores.crossJoin(F.broadcast(listed)).withColumn("conf", reached).filter("conf IS NOT NULL").groupBy("conf").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "frames_hit")])
    down = Window.orderBy(F.col("conf").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = thresholds.select("conf").distinct().join(per, "conf", "left").fillna(0)
    return joined.select("conf", *[F.sum(c).over(down).alias(c) for c in ("tp", "fp", "frames_hit")])


def totals(frames: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_img (frames without boxes too), total_gt, n_pos_frames."""
    return _with_images(frames, truth.agg(F.count("*").alias("total_gt"), F.count_distinct("frame").alias("n_pos_frames")))


def _with_images(frames: DataFrame, told: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("n_img")).crossJoin(told)


def census(dets: DataFrame, truth: DataFrame, most: int = spatial.HOT_BOXES) -> tuple[DataFrame | None, DataFrame]:
    """spatial.hot_frames of both, and one row (total_gt, n_pos_frames) of truth, from one count by frame. A row for each hot frame and one for
    all others are checkpointed, so that neither is counted again."""
    prepare(dets.sparkSession)
    rows = dets.select("frame", F.lit(False).alias("_of_truth")).unionByName(truth.select("frame", F.lit(True).alias("_of_truth")))
    per = rows.groupBy("frame").agg(F.count_if(~F.col("_of_truth")).alias("_d"), F.count_if("_of_truth").alias("_t"))
    hot = F.col("frame").isNotNull() & (F.greatest("_d", "_t") > most)
    sums = [F.sum("_t").alias("total_gt"), F.count_if(F.col("frame").isNotNull() & (F.col("_t") > 0)).alias("n_pos_frames")]
    found = per.groupBy(F.when(hot, F.col("frame")).alias("hot")).agg(*sums).checkpoint()
    told = found.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total_gt", "n_pos_frames")])
    return spatial.listed(found.select("hot").filter("hot IS NOT NULL")), told


def operating_points(counts: DataFrame, total: DataFrame) -> DataFrame:
    """(conf, tp, fp, fn, recall, precision, f1, fppi, frame_recall)."""
    p = counts.crossJoin(F.broadcast(total))
    fn = F.col("total_gt") - F.col("tp")
    prec, rec = g.precision(F.col("tp"), F.col("fp")), g.recall(F.col("tp"), fn)
    return p.select("conf", "tp", "fp", fn.alias("fn"), rec.alias("recall"), prec.alias("precision"), g.f1(prec, rec).alias("f1"), g.ratio(F.col("fp").cast("double"), F.col("n_img")).alias("fppi"), g.ratio(F.col("frames_hit").cast("double"), F.col("n_pos_frames")).alias("frame_recall"))


def froc_thresholds(dets: DataFrame, at_most: int = 200) -> DataFrame:
    """Distinct scores to four places, thinned out evenly; there are 10001 at most before that for scores from 0 to 1, in one checkpointed table."""
    prepare(dets.sparkSession)
    scores = dets.select(F.round("score", 4).alias("conf")).distinct().checkpoint()
    down = Window.orderBy(F.col("conf").desc())
    numbered = scores.withColumn("_i", F.row_number().over(down) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    # the i of the k-th threshold is rint(k (n - 1) / (at_most - 1)): of those near i / (n - 1), one must give i
    k = F.rint(F.col("_i") * (at_most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    kept = F.lit(False)
    for near in (-1, 0, 1):
        at = F.least(F.greatest(k + near, F.lit(0)), F.lit(at_most - 1))
        kept = kept | (F.rint(at * (F.col("_n") - 1) / (at_most - 1)) == F.col("_i"))
    return numbered.filter((F.col("_n") <= at_most) | kept).select("conf")


def froc(dets: DataFrame, truth: DataFrame, frames: DataFrame, mode: str = "iou", threshold: float = 0.3, at_most: int = 200) -> DataFrame:
    """Points of the curve, from one match, whose sums by score are checkpointed: they give the thresholds and the counts. One count by frame
    before it gives what is hot and the totals."""
    _known(mode)
    hot, told = census(dets, truth)
    scores = by_score(_matched(dets, truth, hot, mode, threshold)).checkpoint()
    return operating_points(_counts_of(scores, froc_thresholds(scores, at_most)), _with_images(frames, told))


def recall_at(points: DataFrame, targets: Sequence[float] = (0.1, 0.5, 1.0, 2.0)) -> DataFrame:
    """(target, recall, conf): the best recall at no more than so many false positives an image, the highest confidence of
    equal ones; null where there is none. The targets join a curve of some hundred points."""
    spark = points.sparkSession
    wanted = spark.createDataFrame([(float(t),) for t in targets], "target double")
    best = wanted.join(F.broadcast(points), F.col("fppi") <= F.col("target"), "left").groupBy("target").agg(F.max(F.struct("recall", "conf")).alias("best"))
    return best.select("target", "best.recall", "best.conf")


def average_precision(dets: DataFrame, truth: DataFrame, levels: Sequence[float] = tuple(round(0.5 + 0.05 * k, 2) for k in range(10)), most: int = spatial.HOT_BOXES) -> DataFrame:
    """(level, average_precision): the area under precision over recall, for each IoU that a match must reach; 0 without truth or detections.

    Pairs are joined once, at the least level, and matched for all levels together: a frame at a level is a frame of its own. Detections of
    one score are one point of the curve; of a point's precision, the best at its recall or a higher one counts. Sums and maxima run over
    the scores of a level in order by range, so no task has them all.
    """
    prepare(dets.sparkSession)
    found = pairs(dets, truth, min(levels), most).checkpoint()
    level = F.explode(F.filter(F.array(*[F.lit(float(v)) for v in levels]), lambda v: v <= F.col("iou")))
    each = found.withColumn("level", level).withColumn("frame", F.struct("frame", "level")).drop("level")
    hot = spatial.hot_frames(each, most=most * 10)
    few, many = (each, None) if hot is None else spatial.divided(each, hot)
    hits = _folded(few, "iou", dets, truth).filter("gt_idx IS NOT NULL").select(F.col("frame.level").alias("level"), "score")
    if hot is not None:
        scores = many.select("frame", "det_seq", "score").distinct()
        held = by_rounds(many, "iou").join(scores, (F.col("m_frame") == F.col("frame")) & (F.col("m_seq") == F.col("det_seq")))
        hits = hits.unionByName(held.select(F.col("frame.level").alias("level"), "score"))
    hits = hits.groupBy("level", "score").agg(F.count("*").alias("tp"))
    every = F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level")
    points = dets.groupBy("score").agg(F.count("*").alias("n")).select("score", "n", every).join(hits, ["level", "score"], "left").fillna(0, ["tp"])
    order = [F.col("level"), F.col("score").desc()]
    for part, name in (("tp", "_tps"), ("n", "_ns")):
        points = running_total(points, order, F.col(part), name)
    firsts = points.groupBy(F.col("level").alias("_level")).agg(F.min("_tps").alias("_tp0"), F.min("_ns").alias("_n0"))  # what the levels before it have
    shares = points.join(F.broadcast(firsts), F.col("level") == F.col("_level"))
    shares = shares.withColumn("_share", (F.col("_tps") - F.col("_tp0") + F.col("tp")) / (F.col("_ns") - F.col("_n0") + F.col("n")).cast("double")).select("level", "score", "tp", "_share")
    best = running_min(shares, ["level"], [F.col("score")], -F.col("_share"), "_least")
    area = best.groupBy("level").agg(F.sum(F.col("tp") * -F.least("_least", -F.col("_share"))).alias("_area"))
    whole = truth.agg(F.count("*").alias("_gt"))
    listed = dets.sparkSession.createDataFrame([(float(v),) for v in levels], "level double").crossJoin(F.broadcast(whole))
    return listed.join(area, "level", "left").select("level", F.coalesce(g.ratio(F.col("_area"), F.col("_gt")), F.lit(0.0)).alias("average_precision"))
