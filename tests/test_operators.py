import random
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from transect.operators import curation, fusion, matching, negatives, planning, spatial, splits
from transect.operators.ordering import hash_rank, running_total, seeded


def iou(p, q):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = max(w, 0.0) * max(h, 0.0)
    return inter / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter)


@pytest.fixture(scope="module")
def survey(spark):
    """60 frames with contested boxes, many equal scores, some frames without either."""
    rng = random.Random(5)
    box = lambda: (x := rng.randint(0, 40), y := rng.randint(0, 40), x + rng.randint(8, 25), y + rng.randint(8, 25))
    dets, truth = [], []
    for f in range(60):
        dets += [(f, k, *map(float, box()), rng.randint(1, 9) / 10) for k in range(rng.randint(0, 9))]
        truth += [(f, k, *map(float, box())) for k in range(rng.randint(0, 6))]
    d = spark.createDataFrame(dets, "frame int, det_seq int, x1 double, y1 double, x2 double, y2 double, score double").repartition(5)
    t = spark.createDataFrame(truth, "frame int, gt_idx int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    return d, t, spark.range(60).select(F.col("id").cast("int").alias("frame")), dets, truth


def naive(dets, truth, least, mode="iou", threshold=0.3):
    taken = {}
    by = defaultdict(list)
    for t in truth:
        by[t[0]].append(t)
    used = set()
    for d in sorted((d for d in dets if d[6] >= least), key=lambda d: (d[0], -d[6], d[1])):
        best, value = None, threshold
        for t in sorted(by[d[0]], key=lambda t: t[1]):
            if (t[0], t[1]) in used:
                continue
            if mode == "iou" and iou(d[2:6], t[2:6]) >= value:
                best, value = t, iou(d[2:6], t[2:6])
            if mode == "centre" and t[2] <= (d[2] + d[4]) / 2 <= t[4] and t[3] <= (d[3] + d[5]) / 2 <= t[5]:
                best = t
                break
        if best:
            used.add((best[0], best[1]))
        taken[d[0], d[1]] = best[1] if best else None
    return taken


@pytest.mark.parametrize("mode", ["iou", "centre"])
def test_matching_is_greedy(survey, mode):
    d, t, _, dets, truth = survey
    found = {(r.frame, r.det_seq): r.gt_idx for r in matching.greedy_match(d, t, mode).collect()}
    assert found == naive(dets, truth, 0, mode)


def test_both_matchers_agree(survey):
    d, t, *_ = survey
    pick = lambda df: sorted((r.frame, r.det_seq, -1 if r.gt_idx is None else r.gt_idx) for r in df.collect())
    assert pick(matching.greedy_match(d, t)) == pick(matching.greedy_match_grouped(d, t))


def test_one_match_serves_all_thresholds(spark, survey):
    d, t, frames, dets, truth = survey
    points = {r.conf: r for r in matching.froc(d, t, frames).collect()}
    assert set(points) == {x[6] for x in dets}
    positive = {x[0] for x in truth}
    for conf, p in points.items():
        taken = naive(dets, truth, conf)
        tp = sum(v is not None for v in taken.values())
        assert (p.tp, p.fp, p.fn) == (tp, len(taken) - tp, len(truth) - tp)
        assert p.frame_recall == len({k[0] for k, v in taken.items() if v is not None}) / len(positive)
        assert p.fppi == (len(taken) - tp) / 60
    down = [points[c] for c in sorted(points, reverse=True)]
    assert all(a.recall <= b.recall and a.fppi <= b.fppi for a, b in zip(down, down[1:], strict=False))
    best = {r.target: r for r in matching.recall_at(matching.froc(d, t, frames), [0.0, 0.5, 100.0]).collect()}
    assert best[100.0].recall == max(p.recall for p in points.values())
    fitting = [p for p in points.values() if p.fppi <= 0.5]
    assert best[0.5].recall == (max(p.recall for p in fitting) if fitting else None)
    assert best[0.0].recall is None or best[0.0].conf in points


def test_thresholds_are_thinned_evenly(spark):
    dets = spark.range(1000).select((F.col("id") / 1000.0).alias("score"))
    got = sorted(r.conf for r in matching.froc_thresholds(dets, 50).collect())
    scores = sorted((k / 1000 for k in range(1000)), reverse=True)
    assert got == sorted({scores[round(k * 999 / 49)] for k in range(50)})


def test_unknown_modes_are_errors(survey):
    d, t, *_ = survey
    with pytest.raises(ValueError, match="mode"):
        matching.greedy_match(d, t, "other")
    with pytest.raises(ValueError, match="method"):
        fusion.fuse_detections([d, d], "other")
    with pytest.raises(ValueError, match="consensus"):
        fusion.fuse_detections([d], "consensus")


def naive_fusion(lists, weights, threshold):
    entries = sorted(((d[6] * w, m, d) for m, (ds, w) in enumerate(zip(lists, weights, strict=True)) for d in ds), key=lambda e: (-e[0], e[1], e[2][1]))
    clusters = []
    for fw, _, d in entries:
        values = [iou(d[2:6], c["rep"]) for c in clusters]
        best = max(values, default=0)
        if best > threshold:
            c = clusters[values.index(best)]
        else:
            c = {"sum": [0.0] * 4, "w": 0.0}
            clusters.append(c)
        c["sum"] = [a + b * fw for a, b in zip(c["sum"], d[2:6], strict=True)]
        c["w"] += fw
        c["rep"] = [a / c["w"] for a in c["sum"]]
    return sorted((tuple(round(v, 9) for v in (*c["rep"], min(1.0, c["w"] / sum(weights)))) for c in clusters), key=lambda r: (-r[4], r))


def test_weighted_fusion(spark, survey):
    d, _, _, dets, _ = survey
    a, b = d.filter("det_seq % 2 = 0"), d.filter("det_seq % 2 = 1")
    found = defaultdict(list)
    for r in fusion.fuse_detections([a, b], "wbf", weights=[1.0, 2.0], threshold=0.4).collect():
        found[r.frame].append(tuple(round(v, 9) for v in (r.x1, r.y1, r.x2, r.y2, r.score)))
    for f in {x[0] for x in dets}:
        lists = [[x for x in dets if x[0] == f and x[1] % 2 == m] for m in range(2)]
        assert sorted(found[f], key=lambda r: (-r[4], r)) == naive_fusion(lists, [1.0, 2.0], 0.4)


def test_consensus(survey):
    d, _, _, dets, _ = survey
    found = {(r.frame, r.det_seq) for r in fusion.fuse_detections([d.filter("det_seq < 4"), d.filter("det_seq >= 4")], "consensus").collect()}
    assert found == {(x[0], x[1]) for x in dets if x[1] < 4 and any(y[0] == x[0] and y[1] >= 4 and iou(x[2:6], y[2:6]) >= 0.2 for y in dets)}


def test_running_totals_and_ranks(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, "hot").alias("by")).repartition(6)
    order = [F.col("v"), F.col("id")]
    total, want = running_total(rows, order, F.col("v"), "before").collect(), 0
    for r in sorted(total, key=lambda r: (r.v, r.id)):
        assert r.before == want
        want += r.v
    ranked = hash_rank(rows.withColumn("h", seeded(1, F.col("id"))), ["by"], "h", "rank").collect()
    assert len(ranked) == 5000
    for by in ("hot", None):
        own = sorted((r for r in ranked if r.by == by), key=lambda r: r.h)
        assert [r.rank for r in own] == list(range(len(own)))


def test_random_split_has_the_proportions(spark):
    rows = spark.range(1030).select("id", (F.col("id") % 3).alias("source"))
    for r in splits.random_split(rows, ["source"], "id").groupBy("source").pivot("split", ["train", "val", "test"]).count().collect():
        n = r.train + r.val + r.test
        assert (r.train, r.val) == (round(n * 0.8), round(n * 0.15))


def test_scenes_aren_t_split(spark):
    rows = spark.range(3000).select((F.col("id") % 97).alias("scene"), F.col("id").alias("nr"))
    out = splits.scene_split(rows, "scene", ["nr"], 4)
    assert splits.straddling_groups(out, "scene").count() == 0
    assert splits.straddling_groups(out.withColumn("split", F.when(F.col("nr") == 5, "other").otherwise(F.col("split"))), "scene").first().scene == 5
    shares = {r.split: r["count"] / 3000 for r in out.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03
    assert out.filter("kept = 1").count() == sum(-(-n // 4) for n in [31] * 90 + [30] * 7)


def test_density_split(spark):
    rng = random.Random(2)
    groups = [(k, rng.randint(1, 20), rng.choice([0, 0, rng.randint(1, 60)]), k) for k in range(80)]
    found = {r.group: r.split for r in splits.density_split(spark.createDataFrame(groups, "group int, frames int, boxes int, first int")).collect()}
    total, te, va, want = sum(x[1] for x in groups), 0, 0, {}
    for k, n, b, _ in sorted((x for x in groups if x[2]), key=lambda x: (x[2] / x[1], -x[1], x[3])):
        if te < total * 0.05:
            want[k], te = "test", te + n
        elif va < total * 0.15:
            want[k], va = "val", va + n
        else:
            want[k] = "train"
    want |= {x[0]: "train" for x in groups if not x[2]}
    assert found == want


def test_knee(spark):
    counts = [("rise", 2048, 10), ("rise", 1024, 20), ("rise", 512, 30), ("flat", 2048, 10), ("flat", 1024, 10), ("flat", 512, 50), ("fall", 2048, 10), ("fall", 1024, 5), ("zero", 2048, 0), ("zero", 1024, 0)]
    found = {r.f: r.slice for r in planning.sweep_knee(spark.createDataFrame(counts, "f string, slice int, n int"), ["f"]).collect()}
    assert found == {"rise": 512, "flat": 2048, "fall": 2048, "zero": 2048}


def test_crops_are_assigned_in_order(spark):
    rng = random.Random(3)
    lengths = [(s, k, rng.randint(1, 40) / 2) for s in range(5) for k in range(12)]
    crops = [(s, k, float(rng.randint(50, 900))) for s in range(5) for k in range(8)]
    found = {(r.scene, r.len_id): r.crop_id for r in planning.assign_crops(spark.createDataFrame(lengths, "scene int, len_id int, length_m double"), spark.createDataFrame(crops, "scene int, crop_id int, native_px double"), 0.02).collect()}
    want = {}
    for s in range(5):
        pool = sorted((c for c in crops if c[0] == s), key=lambda c: (-c[2], c[1]))
        for _, k, length in sorted((x for x in lengths if x[0] == s), key=lambda x: (-x[2], x[1])):
            pick = next((c for c in pool if c[2] >= length / 0.02), None)
            if pick:
                pool.remove(pick)
                want[s, k] = pick[1]
    assert found == want


def test_tile_decisions(spark):
    tiles = [("easy", 0, "a", "p1"), ("easy", 0, "b", "p2"), ("hard", 1, "a", "p1"), ("hard", 1, "c", "p3"), ("hard", 1, "d", "bad"), ("hard", 1, "e", "p4")]
    t = spark.createDataFrame([(*x, 0.0, 0.0, 10.0, 10.0) for x in tiles], "pool string, pool_ord int, name string, parent string, x1 double, y1 double, x2 double, y2 double")
    parents = spark.createDataFrame([("p1",), ("p2",), ("p4",), ("bad",)], "parent string")
    boxes = spark.createDataFrame([("p2", 5.0, 5.0, 6.0, 6.0), ("p4", 10.0, 0.0, 20.0, 10.0)], "parent string, bx1 double, by1 double, bx2 double, by2 double")
    found = {(r.pool, r.name): r.decision for r in negatives.tile_decisions(t, parents, boxes, F.col("parent") != "bad").collect()}
    assert found == {("easy", "a"): "keep", ("easy", "b"): "drop:overlaps", ("hard", "a"): "drop:duplicate", ("hard", "c"): "drop:parent_not_train", ("hard", "d"): "drop:no_geom", ("hard", "e"): "keep"}


def test_metrics_of_each_frame_and_method(spark, survey):
    d, t, frames, dets, truth = survey
    grid = frames.crossJoin(spark.createDataFrame([("plain", 0.5), ("fine", 0.2), ("none", 2.0)], "method string, least double"))
    found = planning.method_metrics(grid, d.join(grid, "frame").filter("score >= least").drop("least"), t).collect()
    least = {r.method: r.least for r in grid.select("method", "least").distinct().collect()}
    assert sorted(map(str, planning.score_metrics(grid, least, d, t).collect())) == sorted(map(str, found))
    assert len(found) == 180
    for r in found:
        mine = [x for x in dets if x[0] == r.frame and x[6] >= r.least]
        tp = sum(v is not None for v in naive(mine, [x for x in truth if x[0] == r.frame], 0).values())
        fp, fn = len(mine) - tp, sum(x[0] == r.frame for x in truth) - tp
        rec, prec = tp / (tp + fn) if tp + fn else 0.0, tp / (tp + fp) if tp + fp else 0.0
        assert (r.tp, r.fp, r.fn, r.recall, r.precision) == (tp, fp, fn, rec, prec)
        assert r.f1 == pytest.approx(2 * prec * rec / (prec + rec) if prec + rec else 0.0)


def test_altitude_manifest(spark):
    animals = spark.createDataFrame([(1, 100.0, 3.0), (2, 30.0, 5.0), (3, 400.0, 9.0), (4, 50.0, 4.0)], "animal int, native_px double, length_m double")
    altitudes = spark.createDataFrame([(60.0, 0.01), (300.0, 0.1), (9000.0, 10.0)], "altitude_m double, gsd double")
    found = {r[0]: tuple(r)[1:] for r in planning.altitude_manifest(animals, altitudes, 35.0).collect()}
    assert found == {60.0: (1.0, 3, 50.0, 400.0, 3.0, 9.0, 5.0), 300.0: (10.0, 2, 40.0, 90.0, 3.0, 9.0, 5.0), 9000.0: (1000.0, 0, 0.0, 0.0, 3.0, 9.0, 5.0)}


@pytest.mark.parametrize("most_chars", [2_000_000, 20, 1])
def test_passages_are_found_at_any_place(spark, most_chars):
    passages = ["a b c d e f g h i j", "one two three", " sp a\tb c d e f\n\ng h i ", "無空格", "", None, "a b c d e f g h i j"]
    texts = ["xx a b c d e f g h i j yy", "xxa b c d e f g h i jyy", "a b c d e f g h i", "a b c d e f g h i k", "a b c d e  f g h i j", "someone two threefold", "one  two three", "x sp a\tb c d e f\n\ng h i y", "這無空格的", "", None, "a b c d e f g h i j"]
    found = curation.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in passages], "text string"), "text", most_chars=most_chars).collect()
    want = {md5(t.encode()).hexdigest() for t in texts if t and any(p and p in t for p in passages)}
    assert len(want) == 6
    assert sorted(r.md5 for r in found) == sorted(want)


def test_counters_count_background_sources_in_all(spark):
    frames = spark.createDataFrame([(1, "s"), (2, "s"), (3, "empty")], "frame int, source string")
    boxes = spark.createDataFrame([(1, 4.0, 9.0), (1, 1.0, 1.0)], "frame int, w double, h double")
    found = {r.source: r for r in curation.box_scale(frames, boxes).collect()}
    assert set(found) == {"s", "ALL"}
    assert (found["ALL"].images, found["ALL"].background, found["ALL"].boxes, found["ALL"].p50) == (3, 2, 2, 3.5)


def test_scoring_loads_a_model_once_a_task(spark):
    def load():
        return lambda batch: [[(0, 0, f, f, 0.5)] * int(f % 3) for f in batch["frame"]]

    frames = spark.range(10).select(F.col("id").alias("frame"))
    assert planning.score_frames(frames, load, []).count() == sum(f % 3 for f in range(10))
    lengths = planning.body_lengths(spark.range(2000), "mixture", 1).agg(F.min("length_m").alias("a"), F.max("length_m").alias("b"), F.avg((F.col("length_m") > 8).cast("int")).alias("c")).first()
    assert 1.5 <= lengths.a and lengths.b <= 18.0 and abs(lengths.c - 0.2) < 0.04


def test_crops_of_a_large_scene_are_not_one_row(spark):
    """One scene with nearly all rows, ties, lengths that no crop shows, a scene without crops, nulls."""
    rng = random.Random(8)
    lengths = [("hot" if k % 50 else "thin", k, rng.randint(1, 40) / 2) for k in range(3000)] + [("bare", 1, 1.0), (None, 2, 1.0), ("hot", 3001, None)]
    crops = [("hot" if k % 50 else "thin", k, float(rng.randint(40, 1100))) for k in range(2500)] + [(None, 1, 900.0)]
    df = planning.assign_crops(spark.createDataFrame(lengths, "scene string, len_id int, length_m double"), spark.createDataFrame(crops, "scene string, crop_id int, native_px double"), 0.02)
    want = {}
    for s in ("hot", "thin"):
        pool = sorted((c for c in crops if c[0] == s), key=lambda c: (-c[2], c[1]))
        for _, k, length in sorted((x for x in lengths if x[0] == s and x[2] is not None), key=lambda x: (-x[2], x[1])):
            if pool and pool[0][2] >= length / 0.02:
                want[s, k] = pool.pop(0)[1]
    assert {(r.scene, r.len_id): r.crop_id for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "array_append" not in plan


def test_average_precision(spark, survey):
    """Against the definition, level by level and point by point."""
    d, t = survey[:2]
    dets, truth = [tuple(r) for r in d.collect()], [tuple(r) for r in t.collect()]
    got = {r.level: r.average_precision for r in matching.average_precision(d, t, [0.3, 0.5, 0.75], most=4).collect()}
    for level in (0.3, 0.5, 0.75):
        hit = {(r.frame, r.det_seq) for r in matching.greedy_match(d, t, threshold=level).collect() if r.gt_idx is not None}
        points, tp, n = [], 0, 0
        for s in sorted({r[6] for r in dets}, reverse=True):
            own = [r for r in dets if r[6] == s]
            new = sum((r[0], r[1]) in hit for r in own)
            tp, n = tp + new, n + len(own)
            points.append((new, tp / n))
        assert got[level] == pytest.approx(sum(new * max(p for _, p in points[k:]) for k, (new, _) in enumerate(points)) / len(truth))
    assert {r.average_precision for r in matching.average_precision(d.limit(0), t).collect()} == {0.0} == {r.average_precision for r in matching.average_precision(d, t.limit(0)).collect()}


def test_a_match_runs_once_and_deals_nothing_out_again(spark):
    """Detections and boxes are dealt out by frame, and nothing after that: neither what a detection takes, nor a frame's best for the counts."""
    rows = spark.range(4000).select((F.col("id") % 400).alias("frame"), (F.col("id") / 400).cast("long").alias("n"), *[(F.col("id") % 7 + k).cast("double").alias(c) for k, c in ((0, "x1"), (0, "y1"), (9, "x2"), (9, "y2"))], (F.col("id") % 97 / 97).alias("score"))
    d, t = rows.withColumnRenamed("n", "det_seq"), rows.withColumnRenamed("n", "gt_idx").drop("score")
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        match = planned(matching.greedy_match(d, t).select("frame", "det_seq", "score", "gt_idx"))
        counts = planned(matching.counts_at(matching.greedy_match(d, t), spark.createDataFrame([(0.5,)], "conf double")))
    finally:
        spark.conf.set(key, before)
    assert match.count("Exchange hashpartitioning(") == 2
    assert counts.count("aggregate(") == 1


def test_a_match_of_columns_of_other_kinds_and_rows_without_a_frame(spark):
    boxes = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 5.0, 0.0, 15.0, 10.0), (None, 0, 0.0, 0.0, 10.0, 10.0)]
    t = spark.createDataFrame(boxes, "frame int, gt_idx int, x1 double, y1 double, x2 double, y2 double")
    rows = [(1, 0, 1.0, 0.0, 11.0, 10.0, 0.5, {"k": 0}), (1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, {"k": 1}), (1, 2, 90.0, 0.0, 95.0, 9.0, 0.9, {"k": 2}), (None, 0, 0.0, 0.0, 10.0, 10.0, 0.5, {"k": 3}), (None, 0, 0.0, 0.0, 10.0, 10.0, 0.5, {"k": 4})]
    d = spark.createDataFrame(rows, "frame int, det_seq int, x1 double, y1 double, x2 double, y2 double, score double, more map<string, int>")
    want = [(0, 1), (1, 0), (2, None), (3, None), (4, None)]
    assert sorted((r.more["k"], r.gt_idx) for r in matching.greedy_match(d, t).collect()) == want
    bare = d.drop("more")
    found = matching.greedy_match(bare, t)
    assert found.columns == [*bare.columns, "gt_idx"]
    assert sorted((r.frame or 0, r.det_seq, -1 if r.gt_idx is None else r.gt_idx) for r in found.collect()) == [(0, 0, -1), (0, 0, -1), (1, 0, 1), (1, 1, 0), (1, 2, -1)]


def test_a_curve_counts_the_truth_once(spark, survey, tmp_path):
    """The totals of a curve come from the count that finds hot frames; the truth isn't read again for them."""
    d, t, frames, _, truth = survey
    t.write.parquet(str(tmp_path / "truth_of_a_curve"))
    points = matching.froc(d, spark.read.parquet(str(tmp_path / "truth_of_a_curve")), frames)
    assert not [f for f in points.inputFiles() if "truth_of_a_curve" in f]
    assert {r.tp + r.fn for r in points.collect()} == {len(truth)}
    with pytest.raises(ValueError, match="unknown matching mode"):
        matching.froc(d, t, frames, "other")


def test_a_census_is_hot_frames_and_totals(spark, survey):
    d, t, frames, dets, truth = survey
    bare = spark.createDataFrame([(None, k, 0.0, 0.0, 9.0, 9.0) for k in range(20)], t.schema)
    for most in (0, 4, 7, 100):
        for a, b in ((d, t), (d, t.unionByName(bare)), (d, t.limit(0)), (d.limit(0), t), (d.limit(0), t.limit(0))):
            hot, told = matching.census(a, b, most)
            want = spatial.hot_frames(a, b, most=most)
            listed = lambda x: set() if x is None else {r.hot for r in x.collect()} - {None}
            assert listed(hot) == listed(want)
            assert (hot is None) == (not listed(hot))
            assert told.collect() == matching.totals(frames, b).select("total_gt", "n_pos_frames").collect()


def test_a_curve_of_hot_frames(spark, survey, monkeypatch):
    d, t, frames, _, _ = survey
    want = sorted(matching.froc(d, t, frames).collect())
    found, census = [], matching.census
    monkeypatch.setattr(matching, "census", lambda a, b: found.append(census(a, b, 4)) or found[-1])
    assert sorted(matching.froc(d, t, frames).collect()) == want
    assert found[0][0] is not None
