import random

import pytest
from pyspark.sql import functions as F

from transect.functions import flight, naming
from transect.functions import geometry as g


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("w", "h", "size", "tiles"), [(8192, 5460, 640, 176), (8192, 5460, 1024, 70), (8192, 5460, 1701, 24), (8192, 5460, 512, 280), (14204, 10652, 640, 588), (14204, 10652, 1024, 234), (14204, 10652, 2834, 35), (8192, 5460, None, 1)])
def test_published_tile_counts(spark, w, h, size, tiles):
    assert one(spark, t=flight.tile_count(F.lit(w), F.lit(h), F.lit(size).cast("int"))).t == tiles


def test_published_slice_decision(spark):
    gsd = flight.gsd(F.lit(3.76), F.lit(448.5), F.lit(70.0))
    r = one(spark, gsd=gsd, d=flight.slice_decision(F.lit(14204), F.lit(10652), altitude_m=F.lit(448.5), camera_pitch_um=F.lit(3.76), camera_focal_mm=F.lit(70.0)))
    assert round(r.gsd * 100, 3) == 2.409
    assert (r.d.mode, r.d.slice_size, r.d.source) == ("sahi", 2834, "camera+altitude")


@pytest.mark.parametrize(("altitude", "fixed", "ranged"), [(60, None, None), (90, 6047, 1612), (120, 4536, 1209), (160, 3402, 907), (200, 2721, 726), (260, 2093, 558), (320, 1701, 512)])
def test_sweep_decisions(spark, altitude, fixed, ranged):
    common = dict(altitude_m=F.lit(float(altitude)), pitch_um=F.lit(4.39), focal_mm=F.lit(35.0))
    r = one(spark, a=flight.slice_decision(F.lit(8192), F.lit(5460), **common), b=flight.slice_decision(F.lit(8192), F.lit(5460), max_len_m=F.lit(18.2), **common))
    assert (r.a.slice_size, r.b.slice_size) == (fixed, ranged)
    assert r.a.mode == ("plain" if fixed is None else "sahi")


def test_decision_order(spark):
    size = F.lit(8192), F.lit(5460)
    r = one(
        spark,
        forced=flight.slice_decision(*size, force_slice=F.lit(100), given_gsd=F.lit(0.01)),
        low_wins=flight.slice_decision(*size, force_slice=F.lit(100), min_slice=F.lit(700), max_slice=F.lit(600)),
        nothing=flight.slice_decision(*size, altitude_m=F.lit(100.0)),
        zero=flight.slice_decision(*size, altitude_m=F.lit(100.0), pitch_um=F.lit(0.0), camera_pitch_um=F.lit(4.39), focal_mm=F.lit(35.0)),
        given=flight.slice_decision(*size, given_gsd=F.lit(0.05), altitude_m=F.lit(10.0), pitch_um=F.lit(4.39), focal_mm=F.lit(35.0)),
        skip=flight.slice_decision(*size, given_gsd=F.lit(0.0125), skip_px=F.lit(20.0)),
    )
    assert (r.forced.slice_size, r.forced.source, r.forced.gsd) == (512, "user_slice", None)
    assert r.low_wins.slice_size == 700
    assert (r.nothing.mode, r.nothing.source) == ("blind_sweep", "no_geometry")
    assert r.zero.source == "camera+altitude"
    assert (r.given.gsd, r.given.source) == (0.05, "user_gsd")
    assert r.skip.mode == "plain"


@pytest.mark.parametrize(("n", "dose", "negatives"), [(4855, 0.1, 539), (7756, 0.1, 862), (1355, 0.1, 151), (4855, 0.2, 1214), (4855, 0.0, 0), (100, 0.9, 300)])
def test_published_doses(spark, n, dose, negatives):
    from transect.operators.negatives import dose_count

    assert one(spark, d=dose_count(F.lit(n), F.lit(dose), F.lit(1715 if n > 1000 else 300))).d == negatives


def test_edge_flush_origins(spark):
    r = one(spark, a=g.edge_flush_origins(F.lit(100), F.lit(40)), b=g.edge_flush_origins(F.lit(80), F.lit(40)), c=g.edge_flush_origins(F.lit(40), F.lit(40)), d=g.edge_flush_origins(F.lit(30), F.lit(40)))
    assert (r.a, r.b, r.c, r.d) == ([0, 40, 60], [0, 40], [0], [0])


def test_box_round_trips(spark):
    rng = random.Random(1)
    for _ in range(5):
        cx, cy, w, h = rng.uniform(0.3, 0.7), rng.uniform(0.3, 0.7), rng.uniform(0.05, 0.4), rng.uniform(0.05, 0.4)
        b = g.centre_box(*[F.lit(v) for v in (cx, cy, w, h)])
        p = g.centre_to_percent(b)
        r = one(spark, c=g.corners_to_centre(g.centre_to_corners(b, F.lit(640), F.lit(480)), F.lit(640), F.lit(480)), p=g.percent_to_centre(p.x, p.y, p.width, p.height), k=g.percent_to_centre(p.x, p.y, F.lit(0.0), p.height, clamped=True))
        assert tuple(r.c) == pytest.approx((cx, cy, w, h))
        assert tuple(r.p) == pytest.approx((cx, cy, w, h))
        assert r.k is None


def test_coco_boxes(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, a=g.coco_to_centre(arr(10, 20, 30, 40), F.lit(0), F.lit(100), F.lit(100)), b=g.coco_to_centre(arr(10, 20, 30, 40), F.lit(None).cast("int"), F.lit(100), F.lit(100)), c=g.coco_to_centre(arr(1, 2, 3), F.lit(1), F.lit(100), F.lit(100)))
    assert tuple(r.a) == pytest.approx((0.2, 0.3, 0.2, 0.2))
    assert tuple(r.b) == pytest.approx((0.25, 0.4, 0.3, 0.4))
    assert r.c is None


def test_orientations(spark):
    """Turning an image by its tag turns its boxes: checked on a raster."""
    turns = {1: lambda m: m, 2: lambda m: [r[::-1] for r in m], 3: lambda m: [r[::-1] for r in m[::-1]], 4: lambda m: m[::-1], 5: lambda m: [list(r) for r in zip(*m, strict=True)], 6: lambda m: [list(r)[::-1] for r in zip(*m, strict=True)], 7: lambda m: [list(r) for r in zip(*[r[::-1] for r in m[::-1]], strict=True)], 8: lambda m: [list(r) for r in zip(*m, strict=True)][::-1]}
    m = [[1 if 1 <= x < 3 and 2 <= y < 3 else 0 for x in range(8)] for y in range(4)]
    for tag, turn in turns.items():
        out = turn(m)
        ys, xs = [y for y, r in enumerate(out) if any(r)], [x for r in out for x, v in enumerate(r) if v]
        want = ((min(xs) + max(xs) + 1) / 2 / len(out[0]), (min(ys) + max(ys) + 1) / 2 / len(out))
        box = g.box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(3.0))
        r = one(spark, b=g.oriented_box(box, F.lit(8), F.lit(4), F.lit(tag)))
        assert (r.b.cx, r.b.cy) == pytest.approx(want), tag


def test_overlap_rules(spark):
    touching = [F.lit(float(v)) for v in (0, 0, 10, 10, 10, 0, 20, 10)]
    r = one(spark, o=g.overlaps(*touching), i=g.iou(*touching), same=g.iou(*touching[:4], *touching[:4]), flat=g.iou(*[F.lit(0.0)] * 8), c=g.centre_inside(*[F.lit(float(v)) for v in (0, 0, 20, 20, 10, 0, 20, 10)]))
    assert (r.o, r.i, r.same, r.flat, r.c) == (False, 0.0, 1.0, 0.0, True)


def test_rates_on_nothing(spark):
    z = F.lit(0)
    r = one(spark, p=g.precision(z, z), r=g.recall(z, z), f=g.f1(F.lit(0.0), F.lit(0.0)))
    assert tuple(r) == (0.0, 0.0, 0.0)


def test_names(spark):
    r = one(
        spark,
        base=naming.augmentation_base(F.lit("a.b.rf.12.rf.3")),
        season=naming.season(F.lit("x_TO17Su_01")),
        none=naming.season(F.lit("x_y")),
        tile=naming.tile_origin(F.lit("p_x12_y34.jpg")),
        no_tile=naming.tile_origin(F.lit("p.jpg")),
        path=naming.local_path(F.lit("http://h/data?d=a%20b%2Fc.jpg&x=1")),
        group=naming.group_key(F.lit("TO17_S12_f3"), "^(TO\\d+)_(S\\d+)_", 2),
        stem=naming.file_stem(F.lit("/a/b.c/d.e.jpg")),
        xmp=naming.xmp_altitude(F.encode(F.lit('junk GPSAltitude="9" drone-dji:RelativeAltitude="-61.5" x'), "UTF-8")),
        key=naming.cache_key(F.lit("m"), F.lit(640), F.lit(0.2), F.lit(1024), F.lit(0.05), F.lit(7)),
    )
    assert (r.base, r.season, r.none, tuple(r.tile), r.no_tile, r.path, r.group, r.stem, r.xmp) == ("a.b", "TO17Su", "NA", (12, 34), None, "a b/c.jpg", "TO17_S12", "d.e", 61.5)
    assert r.key == "m_t640_o0.20_i1024_c0.050_n7"
    with pytest.raises(Exception, match="no group"):
        one(spark, g=naming.group_key(F.lit("zzz"), "^(TO\\d+)"))


def test_resolution_orders(spark):
    none = F.lit(None).cast("double")
    gsd, alt = flight.live_resolution(F.lit(0.1), F.lit(0.2), F.lit(50.0), F.lit(60.0))
    args = (F.lit(4.39), F.lit(35.0), F.lit(24.0))
    r = one(spark, gsd=gsd, alt=alt, a=flight.resolved_gsd(F.lit(0.03), F.lit(100.0), F.lit(90.0), *args), b=flight.resolved_gsd(none, F.lit(100.0), F.lit(90.0), *args), c=flight.resolved_gsd(none, none, F.lit(90.0), *args), d=flight.resolved_gsd(none, none, none, *args), s=flight.source_altitude(none, none, F.lit(0.0)))
    assert (r.gsd, r.alt) == (0.1, 60.0)
    assert (r.a.source, r.b.source, r.c.source, r.d.source) == ("gsd", "altitude", "exif", "none")
    assert r.c.gsd == pytest.approx(4.39e-6 * 90 / 24e-3)
    assert r.s is None


def test_zeros_are_not_given(spark):
    size, box = (F.lit(8192), F.lit(5460)), g.box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))
    r = one(
        spark,
        zero=flight.slice_decision(*size, given_gsd=F.lit(0.0)),
        derived=flight.slice_decision(*size, given_gsd=F.lit(0.0), altitude_m=F.lit(120.0), pitch_um=F.lit(4.39), focal_mm=F.lit(35.0)),
        ground=flight.slice_decision(*size, altitude_m=F.lit(0.0), pitch_um=F.lit(4.39), focal_mm=F.lit(35.0)),
        apparent=g.apparent_size(F.lit(50.0), F.lit(3.0), F.lit(0.0)),
        empty=g.apparent_size(F.lit(0.0), F.lit(3.0), F.lit(0.1)),
        share=g.corners_to_centre(box, F.lit(0), F.lit(10)),
        percent=g.corners_to_percent(box, F.lit(0), F.lit(10)),
        shown=g.oriented_box(box, F.lit(0), F.lit(10), F.lit(6)),
    )
    assert (r.zero.mode, r.zero.source, r.ground.mode) == ("blind_sweep", "no_geometry", "blind_sweep")
    assert (r.derived.slice_size, r.derived.source) == (4536, "camera+altitude")
    assert r.apparent is None and r.empty is None and r.shown is None
    assert (r.share.cx, r.share.w, r.share.cy, r.percent.x) == (None, None, 0.3, None)


def test_apparent_size(spark):
    r = one(spark, smaller=g.apparent_size(F.lit(100.0), F.lit(3.0), F.lit(0.05)), whole=g.apparent_size(F.lit(50.0), F.lit(3.0), F.lit(0.05)), dropped=g.apparent_size(F.lit(100.0), F.lit(3.0), F.lit(0.05), 61.0))
    assert (r.smaller, r.whole, r.dropped) == (pytest.approx(60.0), 50.0, None)


def test_camera_by_key(spark):
    rows = flight.with_camera(spark.createDataFrame([(1, "dji_zenmuse_p1"), (2, "unknown"), (3, None)], "n int, camera string")).orderBy("n").collect()
    assert [(r.pitch_um, r.focal_mm) for r in rows] == [(4.39, 35.0), (None, None), (None, None)]
