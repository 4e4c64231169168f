"""Queries over whole runs of detectors: seams of tiles, models of an ensemble, average precision; and over image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transect.operators import matching, planning
from transect.plans import fixtures as fx
from transect.plans.inventory import _PLANNED_SQL, _planned_frames
from transect.plans.queries import query
from transect.session import table
from transect.sources import images

_ENDS = ("x1", "y1", "x2", "y2")


def _spread_boxes(rows: DataFrame) -> DataFrame:
    x, y = ((F.col("l_partkey") * 37) % 7900).cast("double"), ((F.col("l_suppkey") * 53) % 5200).cast("double")
    w, h = 100 + F.col("l_quantity").cast("double"), (100 + F.col("l_linenumber") * 10).cast("double")
    return fx.line_boxes(rows).withColumn("x1", x).withColumn("y1", y).withColumn("x2", x + w).withColumn("y2", y + h)


def _spread_objects(spark: SparkSession, d: str) -> DataFrame:
    """frame, det_seq, box, score: objects of a hundred pixels and more, all over the frame."""
    return fx._numbered(fx._by_customer(spark, d).filter("l_linestatus = 'F' AND l_returnflag = 'A'"), "det_seq", _spread_boxes)


def _cutting_detector(objects: DataFrame):
    """Finds in a tile what of an object lies in it, scored by its share of the object."""

    def detect(tiles: DataFrame) -> DataFrame:
        own = objects.select(F.col("frame").alias("of"), "det_seq", *[F.col(c).alias(f"o{c}") for c in _ENDS], "score")
        ends = [F.greatest("ox1", "x"), F.greatest("oy1", "y"), F.least("ox2", F.col("x") + F.col("tile_w")), F.least("oy2", F.col("y") + F.col("tile_h"))]
        met = tiles.join(own, F.col("frame") == F.col("of")).withColumns({f"s{c}": e.cast("double") for c, e in zip(_ENDS, ends, strict=True)}).filter("sx2 > sx1 AND sy2 > sy1")
        share = (F.col("sx2") - F.col("sx1")) * (F.col("sy2") - F.col("sy1")) / ((F.col("ox2") - F.col("ox1")) * (F.col("oy2") - F.col("oy1")))
        return met.select("frame", "x", "y", "det_seq", *[(F.col(f"s{c}") - F.col(c[0])).alias(c) for c in _ENDS], (F.col("score") * share).alias("score"))

    return detect


_SEEN_SQL = (
    _PLANNED_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + f""",
sp AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY {', '.join(fx.LINE_ORDER)}) AS obj, ((l_partkey * 37) % 7900)::DOUBLE AS ox1, ((l_suppkey * 53) % 5200)::DOUBLE AS oy1,
  ((l_partkey * 37) % 7900)::DOUBLE + (100 + l_quantity::DOUBLE) AS ox2, ((l_suppkey * 53) % 5200)::DOUBLE + (100 + l_linenumber * 10)::DOUBLE AS oy2, score FROM m WHERE l_returnflag = 'A'),
cu AS (SELECT ti.frame, slice, tx, ty, obj, greatest(ox1, tx)::DOUBLE AS x1, greatest(oy1, ty)::DOUBLE AS y1, least(ox2, tx + least(s, 8192))::DOUBLE AS x2, least(oy2, ty + least(s, 5460))::DOUBLE AS y2, (ox2 - ox1) * (oy2 - oy1) AS area, score AS whole FROM ti JOIN sp ON ti.frame = sp.frame),
sc AS (SELECT *, whole * ((x2 - x1) * (y2 - y1) / area) AS score FROM cu WHERE x2 > x1 AND y2 > y1),
dd AS (SELECT frame, slice, row_number() OVER (PARTITION BY frame ORDER BY ty, tx, obj) AS det_seq, x1, y1, x2, y2, score FROM sc WHERE score >= 0.1::DOUBLE)"""
)
_SHARE = "CASE WHEN least({a}x2, {b}x2) > greatest({a}x1, {b}x1) AND least({a}y2, {b}y2) > greatest({a}y1, {b}y1) THEN (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1)) / least(({a}x2 - {a}x1) * ({a}y2 - {a}y1), ({b}x2 - {b}x1) * ({b}y2 - {b}y1)) ELSE 0 END"


@query(
    _SEEN_SQL
    + f""",
e AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_seq) AS rn FROM dd WHERE slice IS NOT NULL),
f AS (SELECT frame, 0::BIGINT AS rn, []::STRUCT(k BIGINT, score DOUBLE, ox1 DOUBLE, oy1 DOUBLE, ox2 DOUBLE, oy2 DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS seeds FROM (SELECT DISTINCT frame FROM e)
  UNION ALL SELECT frame, rn, CASE WHEN place = 0 THEN list_append(seeds, {{'k': det_seq, 'score': score, 'ox1': x1, 'oy1': y1, 'ox2': x2, 'oy2': y2, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}})
    ELSE list_transform(seeds, lambda s, i: CASE WHEN i = place AND {_SHARE.format(a='s.', b='')} > 0.5::DOUBLE
      THEN {{'k': s.k, 'score': s.score, 'ox1': s.ox1, 'oy1': s.oy1, 'ox2': s.ox2, 'oy2': s.oy2, 'x1': least(s.x1, x1), 'y1': least(s.y1, y1), 'x2': greatest(s.x2, x2), 'y2': greatest(s.y2, y2)}} ELSE s END) END
  FROM (SELECT e.*, f.seeds, coalesce(list_position(list_transform(f.seeds, lambda s: {_SHARE.format(a='s.o', b='e.')} >= 0.5::DOUBLE), true), 0) AS place FROM f JOIN e ON f.frame = e.frame AND e.rn = f.rn + 1)),
z AS (SELECT frame, unnest(arg_max(seeds, rn)) AS s FROM f GROUP BY frame)
SELECT frame, s.k AS det_seq, s.x1 AS x1, s.y1 AS y1, s.x2 AS x2, s.y2 AS y2, s.score AS score FROM z
UNION ALL SELECT frame, det_seq, x1, y1, x2, y2, score FROM dd WHERE slice IS NULL"""
)
def q78_seam_merge(spark: SparkSession, d: str) -> DataFrame:
    """Objects all over the frames, cut by the tiles that see them: one detection for what several tiles saw."""
    return planning.adaptive_prediction(_planned_frames(spark, d), _cutting_detector(_spread_objects(spark, d)), 0.1, given_gsd=F.col("gsd")).select("frame", "det_seq", *_ENDS, "score")


def _model_sql(name: str, target: float, conf: float) -> str:
    slices = _PLANNED_SQL[_PLANNED_SQL.index("de AS") :].replace("< 45", f"< {target}").replace("45.0", str(float(target)))
    renamed = slices.replace("de AS", f"{name}de AS").replace("sz AS", f"{name}sz AS").replace("tx AS (", f"{name}tx AS (").replace("ti AS", f"{name}ti AS").replace("FROM de", f"FROM {name}de").replace("FROM sz", f"FROM {name}sz").replace("FROM tx", f"FROM {name}tx")
    return renamed + f""",
{name}n AS (SELECT frame, count(*) AS n FROM {name}ti JOIN sp USING (frame) WHERE least(ox2, tx + least(s, 8192)) > greatest(ox1, tx) AND least(oy2, ty + least(s, 5460)) > greatest(oy1, ty)
  AND score * ((least(ox2, tx + least(s, 8192)) - greatest(ox1, tx)) * (least(oy2, ty + least(s, 5460)) - greatest(oy1, ty)) / ((ox2 - ox1) * (oy2 - oy1))) >= {conf}::DOUBLE GROUP BY frame),
{name}r AS (SELECT de.frame, '{name}' AS model, CASE WHEN slice IS NULL THEN 'plain' ELSE 'sahi' END AS mode, slice, coalesce(n, 0) AS n FROM {name}de de LEFT JOIN {name}n USING (frame))"""


@query(_SEEN_SQL + ",\n" + _model_sql("fine", 45, 0.3) + ",\n" + _model_sql("coarse", 60, 0.1) + " SELECT * FROM finer UNION ALL SELECT * FROM coarser")
def q79_ensemble_models(spark: SparkSession, d: str) -> DataFrame:
    """What each model of an ensemble decides for a frame, and how many detections its tiles give."""
    detect = _cutting_detector(_spread_objects(spark, d))
    models = [{"label": "fine", "detect": detect, "conf": 0.3, "target_px": 45.0}, {"label": "coarse", "detect": detect, "conf": 0.1, "target_px": 60.0}]
    found = planning.ensemble_members(_planned_frames(spark, d), models, seams=None, given_gsd=F.col("gsd"))
    out = None
    for label, (chosen, dets) in found.items():
        counts = dets.groupBy(F.col("frame").alias("of")).agg(F.count("*").alias("n"))
        own = chosen.join(counts, F.col("frame") == F.col("of"), "left").select("frame", F.lit(label).alias("model"), "mode", "slice", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


_LEVELS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


@query(
    "WITH RECURSIVE "
    + fx.MATCH_SQL
    + f""",
lv AS (SELECT unnest({_LEVELS})::DOUBLE AS level),
c AS (SELECT frame, det_seq, level, list(gt_idx ORDER BY iou DESC, gt_idx DESC) AS choices FROM i JOIN lv ON iou >= level GROUP BY frame, det_seq, level),
r AS (SELECT d.frame, d.score, level, choices, row_number() OVER (PARTITION BY d.frame, level ORDER BY d.score DESC, d.det_seq) AS rn FROM c JOIN d USING (frame, det_seq)),
f AS (SELECT frame, level, 0::BIGINT AS rn, []::BIGINT[] AS used, NULL::BIGINT AS gt_idx, NULL::DOUBLE AS score FROM (SELECT DISTINCT frame, level FROM c)
  UNION ALL SELECT frame, level, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick, score
  FROM (SELECT f.frame, f.level, r.rn, f.used, r.score, list_filter(r.choices, lambda x: NOT list_contains(f.used, x))[1] AS pick FROM f JOIN r ON f.frame = r.frame AND f.level = r.level AND r.rn = f.rn + 1)),
h AS (SELECT level, score, count(*) AS tp FROM f WHERE gt_idx IS NOT NULL GROUP BY level, score),
bs AS (SELECT score, count(*) AS n FROM d GROUP BY score),
s AS (SELECT level, score, coalesce(tp, 0) AS tp, sum(coalesce(tp, 0)) OVER w AS tps, sum(n) OVER w AS ns FROM bs CROSS JOIN lv LEFT JOIN h USING (level, score) WINDOW w AS (PARTITION BY level ORDER BY score DESC)),
p AS (SELECT level, tp, max(tps::DOUBLE / ns) OVER (PARTITION BY level ORDER BY score) AS best FROM s)
SELECT level, round(sum(tp * best) / (SELECT count(*) FROM g), 9) AS average_precision FROM p GROUP BY level"""
)
def q80_average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision at IoU 0.5, 0.55, ... 0.95."""
    return matching.average_precision(fx.detections(spark, d), fx.truth(spark, d), _LEVELS).withColumn("average_precision", F.round("average_precision", 9))


def _number(value: Column | int, size: int, little: Column) -> Column:
    """Hex digits of a whole number in ``size`` bytes, in either order."""
    big = F.lpad(F.hex(value if isinstance(value, Column) else F.lit(value)), 2 * size, "0")
    return F.when(little, F.concat(*[F.substring(big, 2 * k + 1, 2) for k in reversed(range(size))])).otherwise(big)


def _image_heads(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, content): parts as the first bytes of image files; every third is PNG, the others are JPEG with EXIF, every other one in Intel's order."""
    key = F.col("p_partkey").cast("long")
    little, always_big = key % 2 == 0, F.lit(False)
    width, height = 100 + key % 900, 60 + F.col("p_size").cast("long")
    n = lambda v, size: _number(v, size, little)
    big = lambda v, size: _number(v, size, always_big)
    entry = lambda tag, kind, value: F.concat(n(tag, 2), n(kind, 2), n(1, 4), value)
    top = F.concat(n(3, 2), entry(0x0112, 3, F.concat(n(key % 8 + 1, 2), F.lit("0000"))), entry(0x8769, 4, n(50, 4)), entry(0x8825, 4, n(68, 4)), n(0, 4))
    lens = F.concat(n(1, 2), entry(0x920A, 5, n(98, 4)), n(0, 4))
    position = F.concat(n(2, 2), entry(5, 1, F.concat(big(key % 5 % 2, 1), F.lit("000000"))), entry(6, 5, n(106, 4)), n(0, 4))
    tiff = F.concat(F.when(little, "4949").otherwise("4D4D"), n(42, 2), n(8, 4), top, lens, position, n(key % 500, 4), n(10, 4), n(key % 1000, 4), n(4, 4))
    jpeg = F.concat(F.lit("FFD8FFE1007A457869660000"), tiff, F.lit("FFC0001108"), big(height, 2), big(width, 2), F.lit("03" + "00" * 9 + "FFD9"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(height, 4), F.lit("08020000" + "00" * 5))
    return table(spark, d, "part").select("p_partkey", F.unhex(F.when(key % 3 == 0, png).otherwise(jpeg)).alias("content"))


@query(
    """SELECT p_partkey, (100 + p_partkey % 900)::INT AS width, (60 + p_size)::INT AS height, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 8 + 1)::INT END AS orientation,
  CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 500) / 10.0::DOUBLE END AS focal_mm, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 1000) / 4.0::DOUBLE * CASE WHEN p_partkey % 5 % 2 = 1 THEN -1 ELSE 1 END END AS altitude_m FROM part"""
)
def q81_image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, orientations, focal lengths and altitudes read from the bytes of image files."""
    return images.with_facts(_image_heads(spark, d)).select("p_partkey", "width", "height", "orientation", "focal_mm", "altitude_m")
