"""Detections of several models: agreement, weighted fusion; and of several tiles: merging at the seams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transect.functions import geometry as g
from transect.operators import spatial
from transect.operators.ordering import running_total
from transect.session import prepare

_D, _G = ("x1", "y1", "x2", "y2"), ("gx1", "gy1", "gx2", "gy2")


def consensus(a: DataFrame, b: DataFrame, threshold: float = 0.2, most: int = spatial.HOT_BOXES) -> DataFrame:
    """Detections of a that some detection of b in the same frame overlaps at the threshold or above (over 0). Of frames with
    more than ``most`` boxes, those (by frame and det_seq) that a join by cells finds."""
    near = g.iou(*_D, *_G) >= threshold
    named = lambda x: x.select(F.col("frame").alias("gframe"), *[F.col(c).alias(n) for c, n in zip(_D, _G, strict=True)])
    agreed = lambda p, q: p.join(named(q), (F.col("frame") == F.col("gframe")) & near, "left_semi")
    hot = spatial.hot_frames(a, b, most=most)
    if hot is None:
        return agreed(a, b)
    (a_few, a_many), (b_few, b_many) = spatial.divided(a, hot), spatial.divided(b, hot)
    found = spatial.overlapping(a_many.select("frame", "det_seq", *_D), named(b_many)).filter(near).select(F.col("frame").alias("_f"), F.col("det_seq").alias("_d")).distinct()
    return agreed(a_few, b_few).unionByName(a_many.join(found, (F.col("frame") == F.col("_f")) & (F.col("det_seq") == F.col("_d")), "left_semi"))


_NUMBERS = (*_D, "w", *(f"s{c}" for c in _D))


def weighted_fusion(dets: DataFrame, weights: Sequence[float], threshold: float = 0.5, least: float = 0.0, most: int = spatial.HOT_BOXES) -> DataFrame:
    """(frame, seq, x1, y1, x2, y2, score): clusters of overlapping detections as weighted means.

    dets: frame, model (its number), det_seq, box, score. By descending score times weight, each joins the cluster whose present
    mean it overlaps most (of equal ones the first), above the threshold (0 or more). A cluster's score is its sum of weighted scores
    over that of all weights, 1 at most. Means move as boxes join, so a frame's detections fold in one row, JVM-side. Frames with more
    than ``most`` fold by parts whose hulls don't overlap (``spatial.separate``): a mean stays in the hull of its boxes, so boxes of
    different parts never join. A part is one row, and what overlaps in a chain is one part.
    """
    whole = float(sum(weights)) or 1.0
    trust = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("model").cast("int"))
    entry = F.struct((-(F.col("score") * trust)).alias("order"), "model", "det_seq", (F.col("score") * trust).alias("t"), *_D)
    hot = spatial.hot_frames(dets, most=most)
    if hot is None:
        listed = spatial.in_rows(dets, alone=False).agg(F.array_sort(F.collect_list(entry)).alias("ds"))
    else:
        few, many = spatial.divided(dets, hot)
        rows = few.withColumn("part", F.lit(None).cast("long")).unionByName(spatial.separate(many))
        listed = spatial.in_rows(rows, "frame", "part", alone=False).agg(F.array_sort(F.collect_list(entry)).alias("ds"))

    def cluster(values: Sequence[Column]) -> Column:
        return F.struct(*[v.cast("double").alias(n) for n, v in zip(_NUMBERS, values, strict=True)])

    def step(clusters: Column, d: Column) -> Column:
        box = [d[c] for c in _D]

        def joined(c: Column) -> Column:
            sums = [c[f"s{n}"] + v * d.t for n, v in zip(_D, box, strict=True)]
            weight = c.w + d.t
            return cluster([*[F.when(weight != 0, v / weight).otherwise(c[n]) for n, v in zip(_D, sums, strict=True)], weight, *sums])

        def moved(at: Column) -> Column:
            there = F.transform(clusters, lambda c, k: F.when(k + 1 == at, joined(c)).otherwise(c))
            return F.when(at > 0, there).otherwise(F.array_append(clusters, cluster([*box, d.t, *[v * d.t for v in box]])))

        # shares and the place of the best are computed once for a detection, not once for each cluster
        place = lambda shares: F.when(F.array_max(shares) > threshold, F.array_position(shares, F.array_max(shares))).otherwise(0)
        return spatial.let(spatial.let(F.transform(clusters, lambda c: g.iou(*box, *[c[n] for n in _D])), place), moved)

    start = F.expr(f"cast(array() AS array<struct<{', '.join(f'{n}: double' for n in _NUMBERS)}>>)")
    scored = F.transform(F.col("_cs"), lambda c, k: F.struct((-F.least(F.lit(1.0), c.w / whole)).alias("order"), k.alias("k"), *[c[n].alias(n) for n in _D]))
    if hot is None:
        out = listed.select("frame", F.aggregate("ds", start, step).alias("_cs")).select("frame", F.array_sort(F.filter(scored, lambda c: -c.order >= least)).alias("_cs"))
        return out.select("frame", F.posexplode("_cs").alias("seq", "_c")).select("frame", "seq", *[F.col(f"_c.{n}").alias(n) for n in _D], (-F.col("_c.order")).alias("score"))
    # clusters of different parts are numbered together: equal scores by the first detection of each, so those are kept with the clusters
    prepare(dets.sparkSession)
    folded = listed.select("frame", F.aggregate("ds", start, step).alias("_cs"), _founders("ds", start, step).alias("_first")).select("frame", F.explode(F.zip_with(scored, F.col("_first"), lambda c, d: F.struct(c.alias("c"), d.alias("d")))).alias("_x"))
    kept = folded.select("frame", *[F.col(f"_x.c.{n}").alias(n) for n in _D], (-F.col("_x.c.order")).alias("score"), *[F.col(f"_x.d.{n}").alias(f"_{n}") for n in ("order", "model", "det_seq")]).filter(F.col("score") >= least)
    ranked = running_total(kept, [F.col("frame"), -F.col("score"), F.col("_order"), F.col("_model"), F.col("_det_seq")], F.lit(1), "_nth")
    first = ranked.groupBy(F.col("frame").alias("_f")).agg(F.min("_nth").alias("_from"))
    return ranked.join(first, F.col("frame") == F.col("_f")).select("frame", (F.col("_nth") - F.col("_from")).cast("int").alias("seq"), *_D, "score")


def _founders(ds: str, start: Column, step) -> Column:
    """For each cluster of the fold, the detection that began it: the one after which there is one more."""

    def told(acc: Column, d: Column) -> Column:
        after = step(acc["cs"], d)
        begun = F.when(F.size(after) > F.size(acc["cs"]), F.array(F.struct(d["order"].alias("order"), d["model"].alias("model"), d["det_seq"].alias("det_seq"))))
        return F.struct(after.alias("cs"), F.concat(acc["first"], F.coalesce(begun, F.slice(acc["first"], 1, 0))).alias("first"))

    none = F.transform(F.slice(F.col(ds), 1, 0), lambda d: F.struct(d["order"].alias("order"), d["model"].alias("model"), d["det_seq"].alias("det_seq")))
    return F.aggregate(ds, F.struct(start.alias("cs"), none.alias("first")), told, lambda acc: acc["first"])


def over_smaller(*boxes: Column | str) -> Column:
    """Intersection over the smaller of two boxes; 0 without overlap or area."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = (F.col(c) if isinstance(c, str) else c for c in boxes)
    inter = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0.0)) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0.0))
    smaller = F.least((ax2 - ax1) * (ay2 - ay1), (bx2 - bx1) * (by2 - by1))
    return F.when((inter > 0) & (smaller > 0), inter / smaller).otherwise(0.0)


def merge_seams(dets: DataFrame, threshold: float = 0.5, most: int = spatial.HOT_BOXES) -> DataFrame:
    """dets (frame, det_seq, box, score) without what overlapping tiles saw twice: greedy non-maximum merging.

    By descending score (equal ones by det_seq), a detection that nothing before it took is a seed, and takes all later ones that it overlaps
    at the threshold or above, by intersection over the smaller box; of several seeds the first takes. In that order, what is taken
    widens the seed's box to their hull, if it overlaps the box that it is by then by more than the threshold; the score is the seed's.

    A frame's detections fold in one row, JVM-side. Frames with more than ``most`` go by rounds (``_merged_by_rounds``), with the same result.
    """
    prepare(dets.sparkSession)
    hot = spatial.hot_frames(dets, most=most)
    if hot is None:
        return _merged_in_rows(dets, threshold)
    few, many = spatial.divided(dets, hot)
    return _merged_in_rows(few, threshold).unionByName(_merged_by_rounds(many, threshold, most))


def _widened(box: Column, d: Column) -> list[Column]:
    return [F.least(box[c], d[c]) for c in _D[:2]] + [F.greatest(box[c], d[c]) for c in _D[2:]]


def _merged_in_rows(dets: DataFrame, threshold: float) -> DataFrame:
    kind = dict(dets.dtypes)
    entry = F.struct((-F.col("score")).alias("s"), F.col("det_seq").alias("d"), F.col("score"), *[F.col(c).cast("double").alias(c) for c in _D])
    listed = spatial.in_rows(dets).agg(F.array_sort(F.collect_list(entry)).alias("ds"))
    first = tuple(f"o{c}" for c in _D)
    seed = lambda d, own, box: F.struct(d["d"].alias("d"), d["score"].alias("score"), *[v.alias(n) for n, v in zip(first, own, strict=True)], *[v.alias(n) for n, v in zip(_D, box, strict=True)])

    def step(seeds: Column, d: Column) -> Column:
        box = [d[c] for c in _D]
        takes = lambda s: g.overlaps(*[s[n] for n in first], *box) & (over_smaller(*[s[n] for n in first], *box) >= threshold)
        wide = lambda s: F.when(over_smaller(*[s[c] for c in _D], *box) > threshold, seed(s, [s[n] for n in first], _widened(s, d))).otherwise(s)
        place = F.array_position(F.transform(seeds, takes), True)
        return spatial.let(place, lambda at: F.when(at == 0, F.array_append(seeds, seed(d, box, box))).otherwise(F.transform(seeds, lambda s, k: F.when(k + 1 == at, wide(s)).otherwise(s))))

    start = F.expr(f"cast(array() AS array<struct<d: {kind['det_seq']}, score: {kind['score']}, {', '.join(f'{n}: double' for n in (*first, *_D))}>>)")
    merged = listed.select("frame", F.explode(F.aggregate("ds", start, step)).alias("_s")).select("frame", F.col("_s.d").alias("det_seq"), *[F.col(f"_s.{c}").alias(c) for c in _D], "_s.score")
    more = [c for c in dets.columns if c not in merged.columns]
    if more:  # columns of other kinds needn't be sorted with the detections
        merged = merged.join(dets.select(F.col("frame").alias("_f"), F.col("det_seq").alias("_d"), *more), (F.col("frame") == F.col("_f")) & (F.col("det_seq") == F.col("_d")))
        return merged.select(*dets.columns).unionByName(dets.filter("frame IS NULL"))
    return merged.select(*dets.columns)


def _merged_by_rounds(dets: DataFrame, threshold: float, most: int) -> DataFrame:
    """As _merged_in_rows, in rounds over the pairs at the threshold: what has no better one left is a seed, what has a better seed is taken, and both
    go. A round is a few joins over pairs that are left; there is one for each step of the longest chain in which a seed frees
    the next. Detections without a partner never enter them. A seed's box folds over what it took, in one row of these boxes.
    """
    rank = F.struct((-F.col("score")).alias("s"), F.col("det_seq").alias("d"))
    mine = dets.select("frame", rank.alias("rank"), *_D)
    other = dets.select(F.col("frame").alias("gframe"), rank.alias("grank"), *[F.col(c).alias(n) for c, n in zip(_D, _G, strict=True)])
    met = spatial.joined(mine, other, most=most).filter((F.col("rank") < F.col("grank")) & (over_smaller(*_D, *_G) >= threshold))
    pairs = met.select("frame", "rank", "grank").checkpoint()
    left, seeds = pairs, None
    while not left.isEmpty():
        behind = left.select(F.col("frame").alias("_f"), F.col("grank").alias("_r")).distinct()
        same = (F.col("frame") == F.col("_f")) & (F.col("rank") == F.col("_r"))
        new = left.select("frame", "rank").distinct().join(behind, same, "left_anti").checkpoint()
        seeds = new if seeds is None else seeds.unionByName(new)
        taken = left.join(new.select(F.col("frame").alias("_f"), F.col("rank").alias("_r")), same, "left_semi").select(F.col("frame").alias("_f"), F.col("grank").alias("_r")).distinct().checkpoint()
        gone = new.select(F.col("frame").alias("_f"), F.col("rank").alias("_r")).unionByName(taken)
        after = (F.col("frame") == F.col("_f")) & (F.col("grank") == F.col("_r"))
        # a pair of two that are left; one whose better end is taken frees the other, which then has no better one or is a seed of no pair
        rest = left.join(gone, same, "left_anti").join(gone, after, "left_anti").checkpoint()
        freed = left.select("frame", F.col("grank").alias("rank")).distinct().join(gone, same, "left_anti")
        freed = freed.join(rest.select(F.col("frame").alias("_f"), F.explode(F.array("rank", "grank")).alias("_r")), same, "left_anti")
        seeds, left = seeds.unionByName(freed.checkpoint()), rest
    if seeds is None:
        return dets
    named = seeds.select(F.col("frame").alias("_f"), F.col("rank").alias("_r"))
    first = pairs.join(named, (F.col("frame") == F.col("_f")) & (F.col("rank") == F.col("_r")), "left_semi").groupBy("frame", "grank").agg(F.min("rank").alias("seed"))
    ranked = dets.withColumn("_rank", rank)
    bodies = first.select(F.col("frame").alias("_f"), F.col("grank").alias("_g"), "seed").join(ranked.select("frame", "_rank", *_D), (F.col("frame") == F.col("_f")) & (F.col("_rank") == F.col("_g")))
    lists = bodies.groupBy(F.col("_f"), F.col("seed")).agg(F.array_sort(F.collect_list(F.struct("_rank", *_D))).alias("_own")).checkpoint()
    kept = ranked.join(first.select(F.col("frame").alias("_f"), F.col("grank").alias("_g")), (F.col("frame") == F.col("_f")) & (F.col("_rank") == F.col("_g")), "left_anti")
    kept = kept.join(lists, (F.col("frame") == F.col("_f")) & (F.col("_rank") == F.col("seed")), "left")

    def widen(box: Column, d: Column) -> Column:
        wide = F.struct(*[e.alias(c) for e, c in zip(_widened(box, d), _D, strict=True)])
        return F.when(over_smaller(*[box[c] for c in _D], *[d[c] for c in _D]) > threshold, wide).otherwise(box)

    start = F.struct(*[F.col(c).cast("double").alias(c) for c in _D])
    box = F.when(F.col("_own").isNotNull(), F.aggregate("_own", start, widen)).otherwise(start)
    return kept.withColumn("_box", box).select(*[F.col(f"_box.{c}").alias(c) if c in _D else F.col(c) for c in dets.columns])


def fuse_detections(models: Sequence[DataFrame], method: str = "wbf", weights: Sequence[float] | None = None, threshold: float | None = None, least: float = 0.0) -> DataFrame:
    """``consensus`` of exactly two models (proposer, confirmer), or ``wbf`` of any number."""
    if method == "consensus":
        if len(models) != 2:
            raise ValueError("consensus takes a proposer and a confirmer")
        return consensus(*models, 0.2 if threshold is None else threshold)
    if method != "wbf":
        raise ValueError(f"unknown fusion method: {method}")
    every = None
    for k, m in enumerate(models):
        own = m.withColumn("model", F.lit(k))
        every = own if every is None else every.unionByName(own)
    return weighted_fusion(every, weights or [1.0] * len(models), 0.5 if threshold is None else threshold, least)
