"""The registered queries, one for each operator of the inventory, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transect.functions import flight, naming
from transect.functions import geometry as g
from transect.operators import annotation, curation, fusion, matching, negatives, planning, spatial, splits
from transect.operators.ordering import hash_rank, seeded
from transect.plans import fixtures as fx
from transect.session import table
from transect.streaming import telemetry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- curation


@query(f"""
WITH {fx.BOXES_SQL},
s AS (SELECT o_orderpriority AS source, sqrt(greatest(x2 - x1, 0) * greatest(y2 - y1, 0)) AS size FROM b JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS boxes, quantile_cont(size, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM s GROUP BY ROLLUP (source)),
c AS (SELECT o_orderkey, any_value(o_orderpriority) AS source, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
n AS (SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS images, count(*) FILTER (WHERE n = 0) AS background FROM c GROUP BY ROLLUP (source))
SELECT n.source, images, background, boxes, round(q[1] * 1000)::BIGINT AS p5, round(q[2] * 1000)::BIGINT AS p25, round(q[3] * 1000)::BIGINT AS p50, round(q[4] * 1000)::BIGINT AS p75, round(q[5] * 1000)::BIGINT AS p95
FROM n JOIN p ON n.source = p.source
""")
def q01_box_scale(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles in thousandths of a pixel: the two engines' last bits may differ."""
    scale = curation.box_scale(fx.curation_frames(spark, d), fx.curation_boxes(spark, d))
    return scale.select("source", "images", "background", "boxes", *[F.round(F.col(p) * 1000).cast("long").alias(p) for p in ("p5", "p25", "p50", "p75", "p95")])


@query("""
WITH c AS (SELECT o_orderkey, any_value(o_orderpriority) AS source, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS images, sum(n)::BIGINT AS boxes, count(*) FILTER (WHERE n = 0) AS backgrounds FROM c GROUP BY ROLLUP (source)
""")
def q02_source_counters(spark: SparkSession, d: str) -> DataFrame:
    return curation.source_counters(curation.frame_counts(fx.curation_frames(spark, d), fx.curation_boxes(spark, d)))


_SPLIT_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('1337|' || frame)) - 1 AS rn, count(*) OVER (PARTITION BY source) AS size FROM fr),
s AS (SELECT *, CASE WHEN rn < round_even(size * 0.8, 0) THEN 'train' WHEN rn < round_even(size * 0.8, 0) + round_even(size * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query(f"""
WITH fr AS (SELECT o_orderkey AS frame, any_value(o_orderpriority) AS source, count(l_orderkey) AS boxes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
{_SPLIT_SQL}
SELECT source, count(*) FILTER (WHERE split = 'train') AS train_frames, coalesce(sum(boxes) FILTER (WHERE split = 'train'), 0)::BIGINT AS train_boxes,
  count(*) FILTER (WHERE split = 'val') AS val_frames, coalesce(sum(boxes) FILTER (WHERE split = 'val'), 0)::BIGINT AS val_boxes,
  count(*) FILTER (WHERE split = 'test') AS test_frames, coalesce(sum(boxes) FILTER (WHERE split = 'test'), 0)::BIGINT AS test_boxes FROM s GROUP BY source
""")
def q03_split_crosstab(spark: SparkSession, d: str) -> DataFrame:
    frames = curation.frame_counts(fx.curation_frames(spark, d), fx.curation_boxes(spark, d)).withColumnRenamed("n_boxes", "boxes")
    return curation.split_crosstab(splits.random_split(frames, ["source"], "frame"))


@query(f"""
WITH {fx.IMAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY source, split, doc_id) AS rn, count(*) OVER (PARTITION BY md5) AS copies FROM im)
SELECT md5, source, split, doc_id, copies FROM r WHERE rn = 1
""")
def q04_dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return curation.first_seen(fx.images(spark, d).drop("stem"), "md5", ["source", "split", "doc_id"])


@query(f"""
WITH {fx.IMAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY source, split, doc_id) AS rn FROM im),
k AS (SELECT doc_id, md5, stem, row_number() OVER (PARTITION BY source, stem ORDER BY split, doc_id) AS nth FROM r WHERE rn = 1)
SELECT doc_id, stem, CASE WHEN nth = 1 THEN stem ELSE stem || '_' || md5[1:8] END AS name FROM k
""")
def q05_name_collision(spark: SparkSession, d: str) -> DataFrame:
    seen = curation.first_seen(fx.images(spark, d), "md5", ["source", "split", "doc_id"])
    return curation.with_unique_names(seen, "stem", "md5", ["split", "doc_id"], within=["source"]).select("doc_id", "stem", "name")


_PAGE_SQL = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) || '.rf.' || page_id AS stem, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS split, url FROM pages"


@query(f"WITH p AS ({_PAGE_SQL}) SELECT split, string_split(stem, '.rf.')[1] AS base, min(url) AS url, count(*) AS n_files FROM p GROUP BY ALL")
def q06_aug_collapse(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1), F.lit(".rf."), F.col("page_id")).alias("stem"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("split"), "url")
    return curation.collapse_augmentations(pages.withColumn("base", naming.augmentation_base(F.col("stem"))), ["split"], "base", "url")


@query("""
WITH h AS (SELECT md5(text) AS md5 FROM documents WHERE md5(doc_id::VARCHAR) < '2' UNION SELECT md5(text) FROM benchmark)
SELECT doc_id, md5(text) AS md5 FROM documents WHERE md5(doc_id::VARCHAR) >= '2' AND md5(text) NOT IN (SELECT md5 FROM h)
""")
def q07_leak_guard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.md5(F.col("doc_id").cast("string")).alias("slot"))
    held = docs.filter("slot < '2'").select("md5").union(table(spark, d, "benchmark").select(F.md5("text")))
    return curation.without_leaks(docs.filter("slot >= '2'"), held, "md5").select("doc_id", "md5")


@query("""
WITH h AS (SELECT md5(text) AS md5 FROM documents WHERE md5(doc_id::VARCHAR) < '2' UNION SELECT md5(text) FROM benchmark)
SELECT doc_id, md5(text) AS md5 FROM documents WHERE md5(doc_id::VARCHAR) >= '2' AND md5(text) NOT IN (SELECT md5 FROM h)
AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(documents.text, b.text))
""")
def q37_leak_containment(spark: SparkSession, d: str) -> DataFrame:
    """The leak guard's containment variant: also without documents that have a benchmark text in them."""
    docs = table(spark, d, "documents").filter(F.md5(F.col("doc_id").cast("string")) >= "2")
    return curation.without_leaks(q07_leak_guard(spark, d), curation.containing(docs, table(spark, d, "benchmark"), "text"), "md5").select("doc_id", "md5")


@query(f"WITH fr AS (SELECT doc_id AS frame, source FROM documents), {_SPLIT_SQL} SELECT frame AS doc_id, source, split FROM s")
def q08_split_hash(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id").select("doc_id", "source", "split")


@query("""
WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, coalesce(sum(n) OVER (ORDER BY md5('1337|' || conv_id), conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM s)
SELECT c.conv_id, turn, CASE WHEN before < total::DOUBLE * 0.8::DOUBLE THEN 'train' WHEN before < total::DOUBLE * (0.8::DOUBLE + 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split,
  CASE WHEN (row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1) % 3 = 0 THEN 1 ELSE 0 END AS kept
FROM conversations c JOIN b ON c.conv_id = b.conv_id
""")
def q09_split_scene_stride(spark: SparkSession, d: str) -> DataFrame:
    return splits.scene_split(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], 3).select("conv_id", "turn", "split", "kept")


@query("SELECT conv_id, turn, 'test' AS split, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 5 = 0 THEN 1 ELSE 0 END AS kept FROM conversations")
def q10_split_alltest_stride(spark: SparkSession, d: str) -> DataFrame:
    return splits.all_test_split(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], 5).select("conv_id", "turn", "split", "kept")


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY ALL),
s AS (SELECT o_custkey AS scene, count(*) AS frames, sum(n)::BIGINT AS boxes, min(o_orderkey) AS first FROM f GROUP BY o_custkey),
t AS (SELECT *, boxes::DOUBLE / frames AS density, coalesce(sum(frames) OVER (ORDER BY boxes::DOUBLE / frames, frames DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT sum(frames) FROM s)::DOUBLE AS total FROM s WHERE boxes > 0),
e AS (SELECT *, before < total * 0.05::DOUBLE AS in_test FROM t),
v AS (SELECT *, coalesce(sum(frames) FILTER (WHERE in_test) OVER (), 0) AS test_size FROM e)
SELECT scene, frames, boxes, CASE WHEN in_test THEN 'test' WHEN before - test_size < total * 0.15::DOUBLE THEN 'val' ELSE 'train' END AS split FROM v
UNION ALL SELECT scene, frames, boxes, 'train' FROM s WHERE boxes = 0
""")
def q11_split_density(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    frames = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    scenes = frames.groupBy(F.col("o_custkey").alias("scene")).agg(F.count("*").alias("frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"), F.min("o_orderkey").alias("first"))
    return splits.density_split(scenes).select("scene", "frames", "boxes", "split")


# ---------------------------------------------------------------- negatives


@query("""
WITH f AS (SELECT p_partkey AS frame, 300 + p_size * 40 AS width, 200 + p_size * 25 AS height FROM part),
t AS (SELECT *, unnest([512, 1024]) AS tile FROM f),
x AS (SELECT *, unnest(CASE WHEN tile >= width THEN [0] ELSE list_distinct(list_concat(range(0, width - tile + 1, tile), [width - tile])) END) AS x FROM t)
SELECT frame, tile, x::INT AS x, unnest(CASE WHEN tile >= height THEN [0] ELSE list_distinct(list_concat(range(0, height - tile + 1, tile), [height - tile])) END)::INT AS y FROM x
""")
def q12_tile_grid(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "part").select(F.col("p_partkey").alias("frame"), (300 + F.col("p_size") * 40).alias("width"), (200 + F.col("p_size") * 25).alias("height"))
    return negatives.tile_grid(frames, [512, 1024]).select("frame", "tile", "x", "y")


_TILE_SQL = f"""WITH {fx.BOXES_SQL},
t AS (SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN 'easy' ELSE 'hard' END AS pool, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS pool_ord, l_orderkey AS parent, (l_partkey % 5) * 30 AS x, (l_suppkey % 5) * 30 AS y
  FROM lineitem WHERE l_linestatus = 'F' AND l_discount < 0.05),
n AS (SELECT *, 'o' || parent || '_x' || x || '_y' || y AS name FROM t),
g AS (SELECT l_orderkey AS parent, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2 FROM b WHERE l_linestatus = 'O'),
k AS (SELECT n.*, o_orderkey IS NOT NULL AS train, EXISTS (SELECT 1 FROM g WHERE g.parent = n.parent AND n.x < bx2 AND bx1 < n.x + 24 AND n.y < by2 AND by1 < n.y + 24) AS hit
  FROM n LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = n.parent),
r AS (SELECT *, CASE WHEN parent % 50 = 0 THEN 'drop:no_geom' WHEN NOT train THEN 'drop:parent_not_train' WHEN hit THEN 'drop:overlaps' END AS reason FROM k)
SELECT pool, name, parent, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY name, reason IS NULL ORDER BY pool_ord) > 1 THEN 'drop:duplicate' ELSE 'keep' END) AS decision FROM r"""


@query(_TILE_SQL)
def q13_clean_tiles(spark: SparkSession, d: str) -> DataFrame:
    lines = fx.line_boxes(table(spark, d, "lineitem"))
    easy = F.col("l_returnflag") == "A"
    tiles = lines.filter("l_linestatus = 'F' AND l_discount < 0.05").select(F.when(easy, "easy").otherwise("hard").alias("pool"), F.when(easy, 0).otherwise(1).alias("pool_ord"), F.col("l_orderkey").alias("parent"), ((F.col("l_partkey") % 5) * 30).alias("x1"), ((F.col("l_suppkey") % 5) * 30).alias("y1")).distinct()
    tiles = tiles.withColumn("name", F.format_string("o%d_x%d_y%d", "parent", "x1", "y1")).withColumn("x2", F.col("x1") + 24).withColumn("y2", F.col("y1") + 24)
    parents = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("parent"))
    boxes = lines.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("parent"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    return negatives.tile_decisions(tiles, parents, boxes, F.col("parent") % 50 != 0).select("pool", "name", "parent", "decision")


@query("""
WITH f AS (SELECT d.doc_id, source || '_TO' || (n_chars % 4) || '_' || d.doc_id AS stem, (n_chars % 7)::INT AS n_fp, (n_chars % 101) / 101.0::DOUBLE AS max_conf FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1)
SELECT stem, 'TO' || string_split(stem, '_TO')[2][1:1] AS season, n_fp, max_conf, row_number() OVER (ORDER BY n_fp DESC, max_conf DESC, stem) AS rank FROM f
""")
def q14_hard_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id")
    frames = docs.select(F.concat("source", F.lit("_TO"), F.col("n_chars") % 4, F.lit("_"), "doc_id").alias("stem"), (F.col("n_chars") % 7).cast("int").alias("n_fp"), ((F.col("n_chars") % 101) / F.lit(101.0)).alias("max_conf"))
    return negatives.hardness(frames, "n_fp", "max_conf", "stem").select("stem", naming.season(F.col("stem")).alias("season"), "n_fp", "max_conf", "rank")


VARIANTS = (("B", ["src0", "src1", "src2", "src3"], 0.1), ("E1", ["src0", "src1", "src2", "src3", "src4", "src5"], 0.1), ("E2", ["src1", "src2"], 0.1), ("E4_0", ["src0", "src1"], 0.0), ("E4_20", ["src0", "src1"], 0.2))
_VARIANTS_SQL = ", ".join(f"('{v}', {s}, {x}::DOUBLE)" for v, s, x in VARIANTS)


@query(f"""
WITH v(variant, sources, dose) AS (VALUES {_VARIANTS_SQL}),
p AS (SELECT v.variant, d.doc_id, dose FROM v JOIN documents d ON list_contains(sources, d.source) JOIN labels l ON d.doc_id = l.doc_id AND quality = 1),
c AS (SELECT v.variant, any_value(v.dose) AS dose, count(doc_id) AS n_pos FROM v LEFT JOIN p ON v.variant = p.variant GROUP BY v.variant),
n AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1337|' || doc_id)) - 1 AS rn, count(*) OVER () AS pool FROM labels WHERE quality = 0),
m AS (SELECT variant, n_pos, CASE WHEN dose > 0 THEN least(round_even(n_pos * dose / (1 - dose), 0)::BIGINT, (SELECT count(*) FROM labels WHERE quality = 0)) ELSE 0 END AS n_neg FROM c)
SELECT variant, doc_id, 'pos' AS kind FROM p UNION ALL SELECT variant, doc_id, 'neg' FROM m JOIN n ON rn < n_neg
""")
def q15_variant_mix(spark: SparkSession, d: str) -> DataFrame:
    variants = spark.createDataFrame(list(VARIANTS), "variant string, sources array<string>, dose double")
    labels = table(spark, d, "labels")
    positives = table(spark, d, "documents").join(labels.filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", "source")
    chosen = positives.join(F.broadcast(variants.select("variant", F.explode("sources").alias("s"))), F.col("source") == F.col("s")).select("variant", "doc_id")  # five rows
    pool = labels.filter("quality = 0").select("doc_id")
    sizes = variants.select("variant", "dose").join(chosen.groupBy("variant").agg(F.count("*").alias("n_pos")), "variant", "left").fillna(0, "n_pos").crossJoin(pool.agg(F.count("*").alias("pool")))
    counts = sizes.select("variant", negatives.dose_count(F.col("n_pos"), F.col("dose"), F.col("pool")).alias("n_neg"))
    return chosen.withColumn("kind", F.lit("pos")).unionByName(negatives.dosed(pool, "doc_id", counts, splits.SEED).select("variant", "doc_id", F.lit("neg").alias("kind")))


# ---------------------------------------------------------------- planning

_CAMERAS_SQL = ", ".join(f"({k}, '{c[0]}', {c[1]}::DOUBLE, {c[2]}::DOUBLE)" for k, c in enumerate(flight.CAMERAS))
_DECISION_SQL = f"""
WITH cam(camera, name, pitch, focal) AS (VALUES {_CAMERAS_SQL}), {fx.TELEMETRY_SQL},
i AS (SELECT event_id, k, pitch, focal, CASE WHEN kind = 'altitude' THEN value END AS altitude, CASE WHEN kind = 'gsd' THEN nullif(value, 0) END AS gsd0, CASE WHEN k % 11 = 0 THEN k * 60 END AS forced, CASE WHEN k % 3 = 0 THEN 18.2::DOUBLE END AS max_len FROM e JOIN cam ON e.camera = cam.camera),
g AS (SELECT *, coalesce(gsd0, nullif((pitch * 1e-6::DOUBLE) * altitude / (focal * 1e-3::DOUBLE), 0)) AS gsd, CASE WHEN gsd0 IS NOT NULL THEN 'user_gsd' WHEN altitude IS NOT NULL THEN 'camera+altitude' END AS src FROM i),
a AS (SELECT *, 3.0::DOUBLE / gsd AS animal, (3.0::DOUBLE / gsd) / (8192::DOUBLE / 1024) AS apparent FROM g),
m AS (SELECT *, CASE WHEN forced IS NOT NULL THEN 'sahi' WHEN gsd IS NULL THEN 'blind_sweep' WHEN apparent >= 45 THEN 'plain' ELSE 'sahi' END AS mode FROM a),
s AS (SELECT *, CASE WHEN forced IS NOT NULL THEN greatest(512, least(forced, 8192)) WHEN mode <> 'sahi' THEN NULL
  WHEN max_len IS NOT NULL THEN greatest(512, least(round_even((max_len / gsd) / greatest(1e-6::DOUBLE, 1.0::DOUBLE), 0), 8192)) ELSE greatest(512, least(round_even(animal * 1024 / 45.0::DOUBLE, 0), 8192)) END::INT AS slice_size FROM m)
"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*[F.lit(c[0]) for c in flight.CAMERAS])
    e = flight.with_camera(fx.telemetry(spark, d).withColumn("camera", F.get(keys, F.col("camera"))))
    k = F.col("k")
    decision = flight.slice_decision(
        F.lit(8192), F.lit(5460),
        given_gsd=F.when(F.col("kind") == "gsd", F.col("value")), altitude_m=F.when(F.col("kind") == "altitude", F.col("value")),
        camera_pitch_um=F.col("pitch_um"), camera_focal_mm=F.col("focal_mm"), force_slice=F.when(k % 11 == 0, k * 60), max_len_m=F.when(k % 3 == 0, F.lit(18.2)),
    )
    return e.select("event_id", decision.alias("d"))


@query(_DECISION_SQL + "SELECT event_id, mode, slice_size, CASE WHEN forced IS NULL THEN gsd END AS gsd, CASE WHEN forced IS NULL THEN animal END AS animal_px, CASE WHEN forced IS NULL THEN apparent END AS apparent_px, CASE WHEN forced IS NOT NULL THEN 'user_slice' WHEN gsd IS NULL THEN 'no_geometry' ELSE src END AS source FROM s")
def q16_gsd_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("event_id", "d.mode", "d.slice_size", "d.gsd", "d.animal_px", "d.apparent_px", "d.source")


def tiles_sql(size: str) -> str:
    step = f"({size} - floor(0.2::DOUBLE * {size}))"
    return f"coalesce((CASE WHEN {size} >= 8192 THEN 1 ELSE ceil((8192 - {size}) / {step}) + 1 END * CASE WHEN {size} >= 5460 THEN 1 ELSE ceil((5460 - {size}) / {step}) + 1 END)::BIGINT, 1)"


@query(_DECISION_SQL + f"SELECT mode, count(*) AS frames, sum({tiles_sql('slice_size')})::BIGINT AS tiles, max({tiles_sql('slice_size')}) AS most FROM s GROUP BY mode")
def q17_tile_cost(spark: SparkSession, d: str) -> DataFrame:
    tiles = flight.tile_count(F.lit(8192), F.lit(5460), F.col("d.slice_size"))
    return _decided(spark, d).select("d.mode", tiles.alias("t")).groupBy("mode").agg(F.count("*").alias("frames"), F.sum("t").alias("tiles"), F.max("t").alias("most"))


@query(f"""
WITH {fx.TELEMETRY_SQL}, c AS (SELECT flight, 512 * (1 + k % 4) AS slice, count(*) AS n FROM e GROUP BY ALL),
l AS (SELECT *, lag(n) OVER w AS before, lag(slice) OVER w AS larger FROM c WINDOW w AS (PARTITION BY flight ORDER BY slice DESC))
SELECT flight, coalesce(max(larger) FILTER (WHERE before IS NOT NULL AND (n - before) / greatest(before, 1) < 0.10), min(slice)) AS slice FROM l GROUP BY flight
""")
def q18_blind_knee(spark: SparkSession, d: str) -> DataFrame:
    counts = fx.telemetry(spark, d).groupBy("flight", (512 * (1 + F.col("k") % 4)).alias("slice")).agg(F.count("*").alias("n"))
    return planning.sweep_knee(counts, ["flight"])


# ---------------------------------------------------------------- matching


@query("WITH " + fx.MATCH_SQL + " SELECT frame, det_seq, gt_idx, iou FROM i")
def q19_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.pairs(fx.detections(spark, d), fx.truth(spark, d)).select("frame", "det_seq", "gt_idx", "iou")


@query(fx.GREEDY_SQL + " SELECT frame, det_seq, score, gt_idx FROM t")
def q20_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.greedy_match(fx.detections(spark, d), fx.truth(spark, d)).select("frame", "det_seq", "score", "gt_idx")


@query(fx.CENTRE_SQL + " SELECT frame, det_seq, score, gt_idx FROM t")
def q21_center_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.greedy_match(fx.detections(spark, d), fx.truth(spark, d), "centre").select("frame", "det_seq", "score", "gt_idx")


def points_sql(thresholds: str) -> str:
    return f""",
{fx.TOTALS_SQL},
q AS ({thresholds}),
k AS (SELECT conf, count(*) FILTER (WHERE gt_idx IS NOT NULL AND score >= conf) AS tp, count(*) FILTER (WHERE gt_idx IS NULL AND score >= conf) AS fp,
  count(DISTINCT frame) FILTER (WHERE gt_idx IS NOT NULL AND score >= conf) AS hit FROM q, t GROUP BY conf),
v AS (SELECT conf, tp, fp, total_gt - tp AS fn, CASE WHEN total_gt <> 0 THEN tp::DOUBLE / total_gt ELSE 0 END AS recall, CASE WHEN tp + fp <> 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN n_img <> 0 THEN fp::DOUBLE / n_img ELSE 0 END AS fppi, CASE WHEN n_pos_frames <> 0 THEN hit::DOUBLE / n_pos_frames ELSE 0 END AS frame_recall FROM k, n)"""


_FROC_Q = """SELECT conf FROM (SELECT conf, row_number() OVER (ORDER BY conf DESC) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT round(score, 4) AS conf FROM d))
  WHERE n <= 200 OR i IN (SELECT round_even(j * (n - 1) / 199.0::DOUBLE, 0)::BIGINT FROM range(200) AS x(j))"""
_POINTS = ["conf", "tp", "fp", "fn", "recall", "precision", "fppi", "frame_recall"]


@query(fx.GREEDY_SQL + points_sql("SELECT unnest([0.1, 0.25, 0.4, 0.5])::DOUBLE AS conf") + " SELECT conf, tp, fp, fn, recall, precision, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, fppi, frame_recall FROM v")
def q22_conf_sweep(spark: SparkSession, d: str) -> DataFrame:
    thresholds = spark.createDataFrame([(t,) for t in (0.1, 0.25, 0.4, 0.5)], "conf double")
    dets, truth = fx.detections(spark, d), fx.truth(spark, d)
    return matching.operating_points(matching.counts_at(matching.greedy_match(dets, truth), thresholds), matching.totals(fx.matching_frames(spark, d), truth))


@query(fx.GREEDY_SQL + points_sql(_FROC_Q) + f" SELECT {', '.join(_POINTS)} FROM v")
def q23_froc(spark: SparkSession, d: str) -> DataFrame:
    return matching.froc(fx.detections(spark, d), fx.truth(spark, d), fx.matching_frames(spark, d)).select(*_POINTS)


@query(fx.GREEDY_SQL + points_sql(_FROC_Q) + """ SELECT target, best.recall AS recall, best.conf AS conf FROM
(SELECT target, max({'recall': recall, 'conf': conf}) AS best FROM (SELECT unnest([0.1, 0.5, 1.0, 2.0])::DOUBLE AS target) LEFT JOIN v ON fppi <= target GROUP BY target)""")
def q24_recall_at_fppi(spark: SparkSession, d: str) -> DataFrame:
    return matching.recall_at(matching.froc(fx.detections(spark, d), fx.truth(spark, d), fx.matching_frames(spark, d)))


_TWO_SQL = f"""WITH {fx.BOXES_SQL}, m AS (SELECT o_custkey AS frame, b.* FROM b JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'),
a AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY {', '.join(fx.LINE_ORDER)}) AS det_seq, * EXCLUDE (frame) FROM m WHERE l_returnflag = 'A'), c AS (SELECT * FROM m WHERE l_returnflag = 'R')"""


def _two_models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = fx._by_customer(spark, d).filter("l_linestatus = 'F'")
    return tuple(fx._numbered(spatial.dealt(rows.filter(F.col("l_returnflag") == flag)), "det_seq") for flag in ("A", "R"))


@query(_TWO_SQL + """ SELECT frame, det_seq, score FROM a WHERE EXISTS (SELECT 1 FROM c WHERE c.frame = a.frame
  AND least(a.x2, c.x2) > greatest(a.x1, c.x1) AND least(a.y2, c.y2) > greatest(a.y1, c.y1)
  AND (least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - (least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1))) >= 0.2::DOUBLE)""")
def q25_consensus(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_detections(_two_models(spark, d), "consensus").select("frame", "det_seq", "score")


_CLUSTER = ("x1", "y1", "x2", "y2", "w", "sx1", "sy1", "sx2", "sy2")
_IOU = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"


@query(
    _TWO_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + f""", u AS (SELECT frame, 0 AS model, det_seq, score * 1.0::DOUBLE AS t, x1, y1, x2, y2 FROM a
  UNION ALL SELECT frame, 1, row_number() OVER (PARTITION BY frame ORDER BY {', '.join(fx.LINE_ORDER)}), score * 2.0::DOUBLE, x1, y1, x2, y2 FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY t DESC, model, det_seq) AS rn FROM u),
f AS (SELECT frame, 0::BIGINT AS rn, []::STRUCT({', '.join(f'{n} DOUBLE' for n in _CLUSTER)})[] AS cs FROM (SELECT DISTINCT frame FROM e)
  UNION ALL SELECT frame, rn, CASE WHEN coalesce(list_max(v), 0) > 0.5::DOUBLE
    THEN list_transform(cs, lambda k, i: CASE WHEN i = list_position(v, list_max(v)) THEN {{'x1': CASE WHEN k.w + t <> 0 THEN (k.sx1 + x1 * t) / (k.w + t) ELSE k.x1 END, 'y1': CASE WHEN k.w + t <> 0 THEN (k.sy1 + y1 * t) / (k.w + t) ELSE k.y1 END,
      'x2': CASE WHEN k.w + t <> 0 THEN (k.sx2 + x2 * t) / (k.w + t) ELSE k.x2 END, 'y2': CASE WHEN k.w + t <> 0 THEN (k.sy2 + y2 * t) / (k.w + t) ELSE k.y2 END,
      'w': k.w + t, 'sx1': k.sx1 + x1 * t, 'sy1': k.sy1 + y1 * t, 'sx2': k.sx2 + x2 * t, 'sy2': k.sy2 + y2 * t}} ELSE k END)
    ELSE list_append(cs, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'w': t, 'sx1': x1 * t, 'sy1': y1 * t, 'sx2': x2 * t, 'sy2': y2 * t}}) END
  FROM (SELECT e.*, f.cs, list_transform(f.cs, lambda k: CASE WHEN {_IOU.format(a='e', b='k')} > 0
      THEN {_IOU.format(a='e', b='k')} / ((e.x2 - e.x1) * (e.y2 - e.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - {_IOU.format(a='e', b='k')}) ELSE 0 END) AS v
    FROM f JOIN e ON f.frame = e.frame AND e.rn = f.rn + 1)),
z AS (SELECT frame, arg_max(cs, rn) AS cs FROM f GROUP BY frame),
y AS (SELECT frame, k, least(1.0::DOUBLE, cs[k].w / 3.0::DOUBLE) AS score, cs[k].x1 AS x1, cs[k].y1 AS y1, cs[k].x2 AS x2, cs[k].y2 AS y2 FROM (SELECT frame, cs, unnest(range(1, len(cs) + 1)) AS k FROM z))
SELECT frame, (row_number() OVER (PARTITION BY frame ORDER BY score DESC, k) - 1)::INT AS seq, x1, y1, x2, y2, score FROM y"""
)
def q26_wbf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_detections(_two_models(spark, d), "wbf", weights=[1.0, 2.0])


# ---------------------------------------------------------------- annotations

_TASK_SQL = """WITH r AS (SELECT conv_id AS task, turn, quality = 0 AS cancelled, role = 'user' AS is_box, (turn * 7) % 60 AS x, (conv_id * 11) % 50 AS y, 10.0 + turn AS w, CASE WHEN turn % 9 = 8 THEN 0 ELSE 5.0 + conv_id % 20 END AS h, CASE WHEN turn % 3 = 0 THEN 'certain' ELSE 'inferred' END AS tier
  FROM conversations JOIN labels ON doc_id = conv_id)"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """(task, json) of annotation tasks: an older annotation, a cancelled one where the label says so, and the last."""
    turns = table(spark, d, "conversations").join(table(spark, d, "labels").select("doc_id", "quality"), F.col("conv_id") == F.col("doc_id"))
    turn, conv = F.col("turn"), F.col("conv_id")
    value = F.struct(((turn * 7) % 60).cast("double").alias("x"), ((conv * 11) % 50).cast("double").alias("y"), (10.0 + turn).alias("width"), F.when(turn % 9 == 8, 0.0).otherwise(5.0 + conv % 20).alias("height"), F.array(F.when(turn % 3 == 0, "certain").otherwise("inferred")).alias("rectanglelabels"))
    result = F.struct(F.when(F.col("role") == "user", "rectanglelabels").otherwise("choices").alias("type"), value.alias("value"))
    grouped = turns.groupBy("conv_id", "quality").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", result.alias("r")))), lambda s: s.r).alias("result"))
    cancelled = F.struct((F.col("quality") == 0).alias("was_cancelled"), F.col("result").alias("result"))
    older = F.struct(F.lit(False).alias("was_cancelled"), F.slice("result", 1, 1).alias("result"))
    return grouped.select(F.col("conv_id").alias("task"), F.to_json(F.struct(F.struct(F.format_string("/data/local-files/?d=src%%20a%%2Fimg_%d.jpg", "conv_id").alias("image")).alias("data"), F.array(older, cancelled).alias("annotations"))).alias("json"))


@query(_TASK_SQL + """,
k AS (SELECT task, 'src a/img_' || task || '.jpg' AS image, x, y, w, h, tier FROM r WHERE is_box AND (NOT cancelled OR turn = 0)),
t AS (SELECT *, unnest(CASE WHEN tier = 'certain' THEN ['all', 'certain'] ELSE ['all'] END) AS tier_set FROM k)
SELECT task, image, tier_set AS tier, (x + w / 2) / 100::DOUBLE AS cx, (y + h / 2) / 100::DOUBLE AS cy, w / 100::DOUBLE AS w, h / 100::DOUBLE AS h FROM (SELECT task, image, tier_set, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM t)""")
def q27_annotation_export(spark: SparkSession, d: str) -> DataFrame:
    boxes = annotation.task_boxes(_tasks(spark, d))
    return curation.tier_boxes(boxes, F.col("label")).select("task", "image", "tier", "box.cx", "box.cy", "box.w", "box.h")


@query("WITH " + fx.MATCH_SQL + """ SELECT frame, count(*) AS n, coalesce(max(score), 0) AS score, min((x1 / 8192::DOUBLE * 100)) AS least_x, max(((y2 - y1) / 5460::DOUBLE * 100)) AS most_height FROM d GROUP BY frame""")
def q28_annotation_import(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as task JSON, read back."""
    tasks = annotation.prediction_tasks(fx.detections(spark, d).withColumn("width", F.lit(8192)).withColumn("height", F.lit(5460)), "detector", F.lit("whale"))
    read = annotation.read_predictions(tasks)
    return read.groupBy("frame").agg(F.count("*").alias("n"), F.first("task_score").alias("score"), F.min("x").alias("least_x"), F.max("height").alias("most_height"))


# ---------------------------------------------------------------- telemetry

_ASOF_SQL = f"""WITH {fx.TELEMETRY_SQL},
p AS (SELECT *, last_value(CASE WHEN kind = 'altitude' THEN value END IGNORE NULLS) OVER w AS topic_altitude, last_value(CASE WHEN kind = 'gsd' THEN value END IGNORE NULLS) OVER w AS topic_gsd
  FROM e WINDOW w AS (PARTITION BY flight ORDER BY ts, CASE WHEN kind = 'image' THEN 1 ELSE 0 END, event_id ROWS UNBOUNDED PRECEDING))"""


@query(_ASOF_SQL + " SELECT event_id, flight, ts, topic_altitude, topic_gsd FROM p WHERE kind = 'image'")
def q29_telemetry_asof(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.latest_before(fx.telemetry(spark, d)).select("event_id", "flight", "ts", "topic_altitude", "topic_gsd")


_LIVE_SQL = (
    _ASOF_SQL
    + """, u AS (SELECT *, nullif(topic_gsd, 0) AS used_gsd, coalesce(nullif(topic_altitude, 0), 120.0::DOUBLE) AS used_altitude FROM p WHERE kind = 'image'),
g AS (SELECT *, coalesce(used_gsd, (4.39::DOUBLE * 1e-6::DOUBLE) * used_altitude / (35.0::DOUBLE * 1e-3::DOUBLE)) AS gsd FROM u),
s AS (SELECT *, CASE WHEN (3.0::DOUBLE / gsd) / (8192::DOUBLE / 1024) >= 45 THEN 'plain' ELSE 'sahi' END AS mode, greatest(512, least(round_even((3.0::DOUBLE / gsd) * 1024 / 45.0::DOUBLE, 0), 8192))::INT AS size FROM g),
z AS (SELECT *, CASE WHEN mode = 'sahi' THEN size END AS slice FROM s)"""
)


@query(_LIVE_SQL + f" SELECT event_id, mode, slice, {tiles_sql('slice')} AS tiles FROM z")
def q30_stream_decision(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.decisions(telemetry.latest_before(fx.telemetry(spark, d)), param_altitude=120.0).select("event_id", "mode", "slice", "tiles")


@query(_LIVE_SQL + f" SELECT flight, mode, count(*) AS frames, sum({tiles_sql('slice')})::BIGINT AS tiles, min(ts) AS first_ts, max(ts) AS last_ts FROM z GROUP BY flight, mode")
def q31_flight_report(spark: SparkSession, d: str) -> DataFrame:
    live = telemetry.decisions(telemetry.latest_before(fx.telemetry(spark, d)), param_altitude=120.0)
    return live.groupBy("flight", "mode").agg(F.count("*").alias("frames"), F.sum("tiles").alias("tiles"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
WITH RECURSIVE l AS (SELECT p_brand AS scene, p_partkey AS len_id, (p_size % 30) / 2.0::DOUBLE AS length_m, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size % 30) / 2.0::DOUBLE DESC, p_partkey) AS rn FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT p_brand AS scene, p_partkey AS crop_id, p_retailprice - 880 AS native_px, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice - 880 DESC, p_partkey) AS k FROM part WHERE p_partkey % 2 = 1),
f AS (SELECT scene, 0::BIGINT AS rn, 1::BIGINT AS k, NULL::BIGINT AS len_id, NULL::BIGINT AS crop_id FROM (SELECT DISTINCT scene FROM l)
  UNION ALL SELECT f.scene, l.rn, f.k + CASE WHEN c.native_px >= l.length_m / 0.02::DOUBLE THEN 1 ELSE 0 END, l.len_id, CASE WHEN c.native_px >= l.length_m / 0.02::DOUBLE THEN c.crop_id END
  FROM f JOIN l ON f.scene = l.scene AND l.rn = f.rn + 1 LEFT JOIN c ON c.scene = f.scene AND c.k = f.k)
SELECT scene, len_id, crop_id FROM f WHERE crop_id IS NOT NULL
""")
def q32_length_crop_assign(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    lengths = part.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("scene"), F.col("p_partkey").alias("len_id"), ((F.col("p_size") % 30) / F.lit(2.0)).alias("length_m"))
    crops = part.filter("p_partkey % 2 = 1").select(F.col("p_brand").alias("scene"), F.col("p_partkey").alias("crop_id"), (F.col("p_retailprice") - 880).alias("native_px"))
    return planning.assign_crops(lengths, crops, 0.02)


@query("""
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT label, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM x),
c AS (SELECT label, k, round(avg(y), 6) AS y FROM e GROUP BY label, k),
m AS (SELECT label, list(y ORDER BY k) AS v FROM c GROUP BY label),
s AS (SELECT vec_id, x.label = m.label AS hit, round(1 / list_reduce(list_prepend(1.0::DOUBLE, list_transform(list_zip(x.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda a, b: a + b), 4) AS conf FROM x, m),
k AS (SELECT conf, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM s GROUP BY conf)
SELECT conf, (sum(tp) OVER w)::BIGINT AS tp, (sum(fp) OVER w)::BIGINT AS fp FROM k WINDOW w AS (ORDER BY conf DESC)
""")
def q33_vector_froc(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the mean of each class: the score falls with the distance, and the vector's own class is the truth."""
    x = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = x.select("label", F.posexplode("v").alias("k", "y")).groupBy("label", "k").agg(F.round(F.avg("y"), 6).alias("y"))
    means = parts.groupBy(F.col("label").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s.y).alias("m"))
    if means.count() > 1000:
        raise ValueError("a curve over classes takes a thousand of them at most")
    distance = F.aggregate(F.zip_with("v", "m", lambda p, q: (p - q) * (p - q)), F.lit(1.0), lambda a, y: a + y)
    scored = x.crossJoin(F.broadcast(means)).select(F.when(F.col("label") == F.col("of"), F.lit(1)).alias("gt_idx"), F.round(1 / distance, 4).alias("score"), F.col("vec_id").alias("frame"))
    thresholds = scored.select(F.col("score").alias("conf")).distinct()
    per = scored.groupBy(F.col("score").alias("conf")).agg(F.count_if(F.col("gt_idx").isNotNull()).alias("tp"), F.count_if(F.col("gt_idx").isNull()).alias("fp"))
    down = Window.orderBy(F.col("conf").desc()).rowsBetween(Window.unboundedPreceding, 0)  # 10001 scores at most
    return thresholds.join(per, "conf").select("conf", F.sum("tp").over(down).alias("tp"), F.sum("fp").over(down).alias("fp"))


@query("""
WITH p AS (SELECT p_partkey, p_size, (p_partkey % 9)::INT AS o, p_size::DOUBLE AS a, (p_size + p_partkey % 40)::DOUBLE AS b, (p_partkey % 30)::DOUBLE AS c, (p_partkey % 30 + p_size)::DOUBLE AS d, CASE p_partkey % 4 WHEN 0 THEN 'polygon' WHEN 1 THEN 'rect' WHEN 2 THEN 'circle' ELSE 'ellipse' END AS shape FROM part),
s AS (SELECT *, CASE shape WHEN 'polygon' THEN least(a, b) WHEN 'rect' THEN a WHEN 'circle' THEN a - c ELSE a - c END AS x1, CASE shape WHEN 'polygon' THEN least(c, d) WHEN 'rect' THEN c WHEN 'circle' THEN b - c ELSE b - d END AS y1,
  CASE shape WHEN 'polygon' THEN greatest(a, b) WHEN 'rect' THEN a + b WHEN 'circle' THEN a + c ELSE a + c END AS x2, CASE shape WHEN 'polygon' THEN greatest(c, d) WHEN 'rect' THEN c + d WHEN 'circle' THEN b + c ELSE b + d END AS y2 FROM p),
n AS (SELECT *, x1 / 128 AS u1, x2 / 128 AS u2, y1 / 64 AS v1, y2 / 64 AS v2 FROM s),
t AS (SELECT p_partkey, o, CASE o WHEN 2 THEN [1 - u1, 1 - u2] WHEN 3 THEN [1 - u1, 1 - u2] WHEN 5 THEN [v1, v2] WHEN 6 THEN [1 - v1, 1 - v2] WHEN 7 THEN [1 - v1, 1 - v2] WHEN 8 THEN [v1, v2] ELSE [u1, u2] END AS xs,
  CASE o WHEN 3 THEN [1 - v1, 1 - v2] WHEN 4 THEN [1 - v1, 1 - v2] WHEN 5 THEN [u1, u2] WHEN 6 THEN [u1, u2] WHEN 7 THEN [1 - u1, 1 - u2] WHEN 8 THEN [1 - u1, 1 - u2] ELSE [v1, v2] END AS ys FROM n),
e AS (SELECT p_partkey, list_min(xs) AS a, list_max(xs) AS b, list_min(ys) AS c, list_max(ys) AS d FROM t)
SELECT p_partkey, greatest(0, least(1, (a + b) / 2)) AS cx, greatest(0, least(1, (c + d) / 2)) AS cy, greatest(0, least(1, b - a)) AS w, greatest(0, least(1, d - c)) AS h FROM e
""")
def q34_exif_box(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_size").cast("double"), (F.col("p_size") + F.col("p_partkey") % 40).cast("double")
    c, e = (F.col("p_partkey") % 30).cast("double"), (F.col("p_partkey") % 30 + F.col("p_size")).cast("double")
    kind = F.col("p_partkey") % 4
    only = lambda k, x: F.when(kind == k, x)
    shape = F.struct(
        F.when(kind == 0, "polygon").when(kind == 1, "rect").when(kind == 2, "circle").otherwise("ellipse").alias("name"),
        only(0, F.array(a, b)).alias("all_points_x"), only(0, F.array(c, e)).alias("all_points_y"), only(1, a).alias("x"), only(1, c).alias("y"), only(1, b).alias("width"), only(1, e).alias("height"),
        F.when(kind >= 2, a).alias("cx"), F.when(kind >= 2, b).alias("cy"), only(2, c).alias("r"), only(3, c).alias("rx"), only(3, e).alias("ry"),
    )
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 9).alias("o"), shape.alias("shape")).withColumn("px", g.shape_to_corners(F.col("shape")))
    return parts.withColumn("box", g.oriented_box(F.col("px"), F.lit(128), F.lit(64), F.col("o"))).select("p_partkey", "box.cx", "box.cy", "box.w", "box.h")


@query(f"""
WITH f AS (SELECT DISTINCT (60 + 10 * (value::INT % 27))::DOUBLE AS altitude FROM events WHERE event_type = 'click'),
g AS (SELECT *, (4.39::DOUBLE * 1e-6::DOUBLE) * altitude / (35.0::DOUBLE * 1e-3::DOUBLE) AS gsd FROM f),
a AS (SELECT *, 3.0::DOUBLE / gsd AS animal, (3.0::DOUBLE / gsd) / 8::DOUBLE >= 45 AS plain FROM g),
m AS (SELECT altitude, gsd, unnest([{{'method': 'plain', 'slice': NULL}}, {{'method': 'fixed640', 'slice': 640}}, {{'method': 'fixed1024', 'slice': 1024}},
  {{'method': 'adaptive', 'slice': CASE WHEN NOT plain THEN greatest(512, least(round_even(animal * 1024 / 45.0::DOUBLE, 0), 8192))::INT END}},
  {{'method': 'adaptive_range', 'slice': CASE WHEN NOT plain THEN greatest(512, least(round_even((18.2::DOUBLE / gsd) / 1.0::DOUBLE, 0), 8192))::INT END}}]) AS m FROM a)
SELECT altitude, gsd, m.method AS method, m.slice AS slice, {tiles_sql('m.slice')} AS tiles FROM m
""")
def q35_method_grid_prf(spark: SparkSession, d: str) -> DataFrame:
    altitudes = table(spark, d, "events").filter("event_type = 'click'").select((60 + 10 * (F.rint("value").cast("int") % 27)).cast("double").alias("altitude")).distinct()
    frames = altitudes.withColumn("gsd", flight.gsd(F.lit(4.39), F.col("altitude"), F.lit(35.0))).withColumn("width", F.lit(8192)).withColumn("height", F.lit(5460))
    return planning.method_grid(frames).select("altitude", "gsd", "method", "slice", "tiles")


@query("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id)) AS nth FROM documents QUALIFY nth <= 10
""")
def q36_capped_sample(spark: SparkSession, d: str) -> DataFrame:
    """A cap for each source (the sampling operator): the first ten in hash order."""
    docs = table(spark, d, "documents").select("doc_id", "source").withColumn("digest", seeded(7, F.col("doc_id")))
    return hash_rank(docs, ["source"], "digest", "n").filter("n < 10").select("doc_id", "source", (F.col("n") + 1).cast("long").alias("nth"))


@query(f"""
{fx.GREEDY_SQL},
v AS (SELECT frame, (60 + 10 * (frame % 27))::DOUBLE AS altitude FROM (SELECT c_custkey AS frame FROM customer)),
w AS (SELECT *, (4.39::DOUBLE * 1e-6::DOUBLE) * altitude / (35.0::DOUBLE * 1e-3::DOUBLE) AS gsd FROM v),
a AS (SELECT *, 3.0::DOUBLE / gsd AS animal, (3.0::DOUBLE / gsd) / 8::DOUBLE >= 45 AS plain FROM w),
k AS (SELECT frame, altitude, gsd, unnest([{{'method': 'plain', 'slice': NULL}}, {{'method': 'fixed640', 'slice': 640}}, {{'method': 'fixed1024', 'slice': 1024}},
  {{'method': 'adaptive', 'slice': CASE WHEN NOT plain THEN greatest(512, least(round_even(animal * 1024 / 45.0::DOUBLE, 0), 8192))::INT END}},
  {{'method': 'adaptive_range', 'slice': CASE WHEN NOT plain THEN greatest(512, least(round_even((18.2::DOUBLE / gsd) / 1.0::DOUBLE, 0), 8192))::INT END}}]) AS m FROM a),
q AS (SELECT k.frame, m.method AS method, altitude, m.slice AS slice, CASE m.method WHEN 'plain' THEN 0.5::DOUBLE WHEN 'fixed640' THEN 0.4::DOUBLE WHEN 'fixed1024' THEN 0.3::DOUBLE WHEN 'adaptive' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS least_score FROM k),
h AS (SELECT q.frame, method, altitude, slice, count(gt_idx) AS tp, count(score) - count(gt_idx) AS fp FROM q LEFT JOIN t ON q.frame = t.frame AND score >= least_score GROUP BY ALL),
y AS (SELECT h.*, coalesce(n, 0) - tp AS fn FROM h LEFT JOIN (SELECT frame, count(*) AS n FROM g GROUP BY frame) z ON h.frame = z.frame),
x AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision FROM y)
SELECT frame, method, altitude, slice, tp, fp, fn, recall, precision, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM x
""")
def q38_method_prf(spark: SparkSession, d: str) -> DataFrame:
    """The grid of q35 for each frame, with precision, recall and F1. No table says what a method finds: a method's detections are those from a score on."""
    frames = table(spark, d, "customer").select(F.col("c_custkey").alias("frame"), (60 + 10 * (F.col("c_custkey") % 27)).cast("double").alias("altitude"))
    frames = frames.withColumn("gsd", flight.gsd(F.lit(4.39), F.col("altitude"), F.lit(35.0))).withColumn("width", F.lit(8192)).withColumn("height", F.lit(5460))
    least = {"plain": 0.5, "fixed640": 0.4, "fixed1024": 0.3, "adaptive": 0.2, "adaptive_range": 0.1}
    return planning.score_metrics(planning.method_grid(frames).select("frame", "method", "altitude", "slice"), least, fx.detections(spark, d), fx.truth(spark, d))


from transect.plans import evaluation, inventory  # noqa: E402, F401  (register more)
