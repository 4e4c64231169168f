"""Frames with many boxes: cells, rounds and parts give what one row for a frame gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transect.operators import fusion, matching, planning, spatial
from tests.test_operators import iou, naive_fusion, survey  # noqa: F401

BOX = "x1 double, y1 double, x2 double, y2 double"


def crowd(n, seed, side=2000, largest=9):
    """Boxes of sizes from 1 to 2^largest, some empty, some equal, negative corners too."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w, h = (rng.choice([0, 1, 2, 3, 5, 8]) * 2 ** rng.randint(0, largest - 3) for _ in range(2))
        x, y = rng.randint(-50, side), rng.randint(-50, side)
        out.append((float(x), float(y), float(x + w), float(y + h)))
    return out + out[: n // 20]


def named(df):
    return df.select(F.col("frame").alias("gframe"), F.col("k").alias("gk"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])


@pytest.fixture(scope="module")
def crowds(spark):
    a = [(f, k, *b) for f, n in ((1, 300), (2, 40), (None, 3)) for k, b in enumerate(crowd(n, n))]
    b = [(f, k, *b) for f, n in ((1, 200), (2, 60), (3, 5)) for k, b in enumerate(crowd(n, n + 1))]
    return [spark.createDataFrame([*rows, (1, 9999, None, 1.0, 2.0, 3.0)], f"frame int, k int, {BOX}").repartition(4) for rows in (a, b)]


@pytest.mark.parametrize("most", [0, 100, 10_000])
def test_cells_give_each_pair_once(crowds, most):
    a, b = ([tuple(r) for r in x.collect() if r.x1 is not None] for x in crowds)
    meet = lambda p, q: p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]
    solid = lambda p: p[2] > p[0] and p[3] > p[1]
    want = sorted((f, k, j) for f, k, *p in a for g, j, *q in b if f == g and meet(p, q) and solid(p) and solid(q))
    got = spatial.joined(crowds[0], named(crowds[1]), most=most).filter("x2 > x1 AND y2 > y1 AND gx2 > gx1 AND gy2 > gy1")
    assert sorted(tuple(r) for r in got.select("frame", "k", "gk").collect()) == want and want
    inside = lambda p, q: q[0] <= (p[0] + p[2]) / 2 <= q[2] and q[1] <= (p[1] + p[3]) / 2 <= q[3]
    want = sorted((f, k, j) for f, k, *p in a for g, j, *q in b if f == g and inside(p, q))
    assert sorted(tuple(r) for r in spatial.joined(crowds[0], named(crowds[1]), True, most).select("frame", "k", "gk").collect()) == want


def test_small_coordinates(spark):
    """Shares of an image: all boxes are shorter than 1."""
    rng = np.random.default_rng(2)
    low = rng.random((300, 2))
    rows = [(1, k, *map(float, p), *map(float, p + rng.random(2) * 0.1)) for k, p in enumerate(low)]
    df = spark.createDataFrame(rows, f"frame int, k int, {BOX}")
    pick = lambda x: sorted(tuple(r) for r in x.select("k", "gk").collect())
    assert pick(spatial.joined(df, named(df), most=0)) == pick(spatial.joined(df, named(df)))


@pytest.mark.parametrize("mode", ["iou", "centre"])
@pytest.mark.parametrize("most", [0, 5])
def test_rounds_match_as_the_fold(survey, mode, most):  # noqa: F811
    d, t = survey[:2]
    pick = lambda x: {(r.frame, r.det_seq): r.gt_idx for r in x.collect()}
    assert pick(matching.greedy_match(d, t, mode, most=most)) == pick(matching.greedy_match(d, t, mode))


def test_a_chain_of_displacements(spark):
    """Each detection's first choice is held by the one before it; all have one score."""
    dets = spark.createDataFrame([(1, k, 10.0 * k, 0.0, 10.0 * k + 20, 10.0, 0.5) for k in range(12)], f"frame int, det_seq int, {BOX}, score double")
    truth = spark.createDataFrame([(1, k, 10.0 * k - 5, 0.0, 10.0 * k + 15, 10.0) for k in range(12)], f"frame int, gt_idx int, {BOX}")
    pick = lambda x: {r.det_seq: r.gt_idx for r in x.collect()}
    assert pick(matching.greedy_match(dets, truth, threshold=0.1, most=0)) == pick(matching.greedy_match(dets, truth, threshold=0.1))


def test_one_frame_of_many_boxes(spark):
    """100,000 boxes on either side, in one frame: against one pass over a grid in numpy."""
    rng = np.random.default_rng(8)
    n = 100_000
    corner = rng.integers(0, 30_000, (n, 2)).astype(float)
    truth = np.c_[corner, corner + rng.integers(20, 60, (n, 2))]
    moved = truth + rng.integers(-8, 9, (n, 4))
    dets, scores = moved[rng.permutation(n)], rng.integers(0, 1000, n) / 1000
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    import pandas as pd

    frame = lambda b, **more: spark.createDataFrame(pd.DataFrame({"frame": 1, **dict(zip(("x1", "y1", "x2", "y2"), b.T, strict=True)), **more}))
    got = {r.det_seq: r.gt_idx for r in matching.greedy_match(frame(dets, det_seq=np.arange(n), score=scores), frame(truth, gt_idx=np.arange(n))).collect()}
    cells = {}
    for j, (x, y, _, _) in enumerate(truth.astype(int) // 70):
        cells.setdefault((x, y), []).append(j)
    free, boxes = set(range(n)), truth.tolist()
    for k in np.lexsort((np.arange(n), -scores)).tolist():
        b = dets[k].tolist()
        x, y = int(b[0] // 70), int(b[1] // 70)
        near = [(iou(b, boxes[j]), j) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((x + dx, y + dy), ()) if j in free]
        best = max((c for c in near if c[0] >= 0.3), default=(0, None))[1]
        assert got[k] == best
        free.discard(best)


def test_consensus_by_cells(survey):  # noqa: F811
    d = survey[0]
    a, b = d.filter("det_seq < 4"), d.filter("det_seq >= 4")
    pick = lambda x: sorted((r.frame, r.det_seq) for r in x.collect())
    assert pick(fusion.consensus(a, b, most=0)) == pick(fusion.consensus(a, b)) != []


@pytest.mark.parametrize("most", [0, 6])
def test_fusion_by_parts(survey, most):  # noqa: F811
    d = survey[0]
    rows = d.withColumn("model", F.col("det_seq") % 2)
    pick = lambda x: sorted(tuple(r) for r in x.collect())
    for least in (0.0, 0.3):
        assert pick(fusion.weighted_fusion(rows, [1.0, 2.0], 0.4, least, most)) == pick(fusion.weighted_fusion(rows, [1.0, 2.0], 0.4, least))


def test_parts_of_a_long_chain(spark):
    rows = [(1, k, 10.0 * k, 0.0, 10.0 * k + 11, 5.0) for k in range(300)] + [(1, 1000 + k, 100.0 * k, 50.0, 100.0 * k + 90, 60.0) for k in range(20)]
    rows += [(2, 0, 0.0, 0.0, 100.0, 1.0), (2, 1, 0.0, 0.0, 1.0, 100.0), (2, 2, 90.0, 90.0, 95.0, 95.0)]  # the hull of the first two has the third
    found = spatial.separate(spark.createDataFrame(rows, f"frame int, k int, {BOX}")).collect()
    assert len(found) == len(rows)
    parts = {}
    for r in found:
        parts.setdefault((r.frame, r.part), set()).add(r.k)
    assert sorted(map(len, parts.values())) == [1] * 20 + [3, 300]


def plain_seams(dets, threshold):
    """dets (det_seq, box, score) of a frame, one after the other."""
    share = lambda p, q: 0 if (w := min(p[2], q[2]) - max(p[0], q[0])) <= 0 or (h := min(p[3], q[3]) - max(p[1], q[1])) <= 0 else w * h / min((b[2] - b[0]) * (b[3] - b[1]) for b in (p, q))
    seeds = []
    for k, *box, score in sorted(dets, key=lambda r: (-r[5], r[0])):
        for s in seeds:
            if share(s[1], box) >= threshold:
                if share(s[2], box) > threshold:
                    s[2] = [*map(min, s[2][:2], box[:2]), *map(max, s[2][2:], box[2:])]
                break
        else:
            seeds.append([k, box, list(box), score])
    return sorted((k, *wide, score) for k, _, wide, score in seeds)


@pytest.mark.parametrize("most", [0, 5, 2000])
@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_seams(survey, most, threshold):  # noqa: F811
    d = survey[0]
    got, want = {}, {}
    for r in fusion.merge_seams(d, threshold, most).collect():
        got.setdefault(r.frame, []).append((r.det_seq, r.x1, r.y1, r.x2, r.y2, r.score))
    for r in d.collect():
        want.setdefault(r.frame, []).append((r.det_seq, r.x1, r.y1, r.x2, r.y2, r.score))
    assert {f: sorted(x) for f, x in got.items()} == {f: plain_seams(x, threshold) for f, x in want.items()}


def test_seams_without_pairs(spark):
    dets = spark.createDataFrame([(1, k, 10.0 * k, 0.0, 10.0 * k + 5, 5.0, 0.5) for k in range(4)], f"frame int, det_seq int, {BOX}, score double")
    assert sorted(map(tuple, fusion.merge_seams(dets).collect())) == sorted(map(tuple, dets.collect()))
    assert fusion.merge_seams(dets.limit(0)).count() == 0


def test_no_duplicates_at_the_seams(spark):
    """Every object is seen, cut, by all tiles it lies in; after merging there is one detection for each, as large as the object."""
    frames = spark.createDataFrame([(f, 2000, 1500, 0.01) for f in range(4)], "frame int, width int, height int, gsd double")
    rng = random.Random(4)
    objects = [(f, 6 * i + j, 330.0 * i + rng.randint(0, 100), 350.0 * j + rng.randint(0, 100)) for f in range(4) for i in range(6) for j in range(4)]
    own = spark.createDataFrame(objects, "of int, k int, ox double, oy double").withColumn("ow", F.col("ox") + 100).withColumn("oh", F.col("oy") + 100)

    def detect(tiles):
        met = tiles.join(own, (F.col("frame") == F.col("of")) & (F.col("ox") < F.col("x") + F.col("tile_w")) & (F.col("ow") > F.col("x")) & (F.col("oy") < F.col("y") + F.col("tile_h")) & (F.col("oh") > F.col("y")))
        ends = [F.greatest(F.col("ox") - F.col("x"), F.lit(0)), F.greatest(F.col("oy") - F.col("y"), F.lit(0)), F.least(F.col("ow") - F.col("x"), F.col("tile_w")), F.least(F.col("oh") - F.col("y"), F.col("tile_h"))]
        seen = met.select("frame", "x", "y", F.col("k").alias("det_seq"), *[e.cast("double").alias(c) for e, c in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)])
        return seen.withColumn("score", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 10_000.0)

    def found(seams):
        return planning._predicted(frames.withColumn("slice", F.lit(512)).withColumn("mode", F.lit("sahi")), detect, 0.01, 0.2, seams)

    assert found(None).count() > len(objects)
    assert sorted((r.frame, r.x1, r.y1, r.x2, r.y2) for r in found(0.5).collect()) == sorted((f, x, y, min(x + 100, 2000), min(y + 100, 1500)) for f, _, x, y in objects)


def test_seams_of_small_frames_take_no_rounds(spark):
    """A chain in which every other box is freed in a round of its own: one fold in a row, whatever its length, columns besides and rows without a frame too."""
    chain = [(1, k, 6.0 * k, 0.0, 6.0 * k + 10, 10.0, 1 - k / 100, {"k": k}) for k in range(12)] + [(None, k, 0.0, 0.0, 9.0, 9.0, 0.5, {"k": k}) for k in (0, 0, 1)]
    dets = spark.createDataFrame(chain, f"frame int, det_seq int, {BOX}, score double, more map<string, int>")
    pick = lambda df: sorted((r.frame or 0, r.det_seq, r.x1, r.y1, r.x2, r.y2, r.score, r.more["k"]) for r in df.select(dets.columns).collect())
    spark.sparkContext.setJobGroup("seams", "")
    merged = fusion.merge_seams(dets, 0.3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("seams"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 6
    assert pick(merged) == pick(fusion.merge_seams(dets, 0.3, most=0))
    assert len(pick(merged)) == 6 + 3


def test_fusion_goes_in_as_many_tasks_as_told(spark, smallest):
    """Small partitions aren't joined before the fold, which costs far more than their bytes say."""
    from transect.plans import queries

    assert queries.q26_wbf(spark, smallest).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
