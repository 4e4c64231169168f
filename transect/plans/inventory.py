"""More registered queries: conversions, scans of annotation texts, registries, benchmark tables, ensembles, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transect import schema
from transect.functions import flight, naming
from transect.functions import geometry as g
from transect.operators import annotation, curation, negatives, planning
from transect.plans import fixtures as fx
from transect.plans.queries import _TWO_SQL, _two_models, query
from transect.session import shared_dir, table
from transect.sources import files, registry, shapes, sinks
from transect.streaming import telemetry

# ---------------------------------------------------------------- boxes

_PART_BOX_SQL = """p AS (SELECT p_partkey, (p_partkey % 90)::DOUBLE AS x1, (p_partkey % 70)::DOUBLE AS y1, (p_partkey % 90 + p_size)::DOUBLE AS x2, (p_partkey % 70 + p_size / 2.0::DOUBLE) AS y2, p_size, p_partkey % 3 AS k FROM part),
c AS (SELECT *, greatest(0, least(1, (x1 + x2) / 2 / 128)) AS cx, greatest(0, least(1, (y1 + y2) / 2 / 64)) AS cy, greatest(0, least(1, (x2 - x1) / 128)) AS w, greatest(0, least(1, (y2 - y1) / 64)) AS h FROM p)"""


def _part_boxes(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    corners = g.box((key % 90).cast("double"), (key % 70).cast("double"), (key % 90 + size).cast("double"), key % 70 + size / F.lit(2.0))
    return table(spark, d, "part").select("p_partkey", "p_size", (key % 3).alias("k"), corners.alias("b"))


@query(f"""
WITH {_PART_BOX_SQL}
SELECT p_partkey, cx, cy, w, h, (cx - w / 2) * 128 AS x1, (cy - h / 2) * 64 AS y1, (cx + w / 2) * 128 AS x2, (cy + h / 2) * 64 AS y2, (cx - w / 2) * 100 AS left, w * 100 AS width, x1 / 128 * 100 AS px, (y2 - y1) / 64 * 100 AS ph FROM c
""".replace("AS left", "AS pleft").replace("AS width", "AS pwidth").replace("x1 / 128 * 100", "c.x1 / 128 * 100").replace("(y2 - y1) / 64 * 100", "(c.y2 - c.y1) / 64 * 100"))
def q39_box_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Corners to clamped shares, back to corners, and both to percent."""
    rows = _part_boxes(spark, d).withColumn("c", g.corners_to_centre(F.col("b"), F.lit(128), F.lit(64)))
    back, pct, corner = g.centre_to_corners(F.col("c"), F.lit(128), F.lit(64)), g.centre_to_percent(F.col("c")), g.corners_to_percent(F.col("b"), F.lit(128), F.lit(64))
    rows = rows.select("p_partkey", "c.*", back.alias("r"), pct.alias("t"), corner.alias("q"))
    return rows.select("p_partkey", "cx", "cy", "w", "h", "r.*", F.col("t.x").alias("pleft"), F.col("t.width").alias("pwidth"), F.col("q.x").alias("px"), F.col("q.height").alias("ph"))


@query("""
WITH p AS (SELECT p_partkey, (p_partkey % 120)::DOUBLE - 10 AS x, (p_partkey % 100)::DOUBLE AS y, (p_size - 5)::DOUBLE AS w, p_size::DOUBLE AS h FROM part)
SELECT p_partkey, greatest(0, least(1, (x + w / 2) / 100)) AS cx, greatest(0, least(1, (y + h / 2) / 100)) AS cy, greatest(0, least(1, w / 100)) AS bw, greatest(0, least(1, h / 100)) AS bh FROM p WHERE w > 0 AND h > 0
""")
def q40_percent_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Percent boxes as clamped shares; those without extent are dropped."""
    key, size = F.col("p_partkey"), F.col("p_size")
    box = g.percent_to_centre((key % 120).cast("double") - 10, (key % 100).cast("double"), (size - 5).cast("double"), size.cast("double"), clamped=True)
    return table(spark, d, "part").select("p_partkey", box.alias("b")).filter("b IS NOT NULL").select("p_partkey", "b.cx", "b.cy", F.col("b.w").alias("bw"), F.col("b.h").alias("bh"))


# ---------------------------------------------------------------- label text

_LABEL_SQL = """l AS (SELECT p_brand || '_' || p_size AS stem, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS line_no,
  (p_partkey % 1250) / 1000.0::DOUBLE - 0.125 AS cx, (p_partkey % 64) / 64.0::DOUBLE AS cy, (p_size % 16) / 16.0::DOUBLE AS w, (p_size % 8) / 8.0::DOUBLE AS h FROM part WHERE p_partkey % 10 <> 0)"""


def _label_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frames, and their label texts: one for each brand and size, with a short and a blank line at the end."""
    key, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, d, "part").withColumn("stem", F.concat_ws("_", "p_brand", "p_size"))
    boxes = part.filter("p_partkey % 10 <> 0").select("stem", key.alias("seq"), ((key % 1250) / F.lit(1000.0) - 0.125).alias("cx"), ((key % 64) / F.lit(64.0)).alias("cy"), ((size % 16) / F.lit(16.0)).alias("w"), ((size % 8) / F.lit(8.0)).alias("h"))
    frames = part.select("stem").distinct()
    texts = sinks.label_texts(frames, boxes).select("stem", F.when(F.col("label") != "", F.concat("label", F.lit("\n0 0.5\n \n"))).otherwise("").alias("value"))
    return frames, texts


@query(f"WITH {_LABEL_SQL} SELECT stem, line_no::INT AS line_no, round(greatest(0, least(1, cx)) * 1e6)::BIGINT AS cx, round(cy * 1e6)::BIGINT AS cy, round(w * 1e6)::BIGINT AS w, round(h * 1e6)::BIGINT AS h FROM l")
def q41_label_scan(spark: SparkSession, d: str) -> DataFrame:
    """Boxes written as label text and read back, clamped; in millionths, which the text has."""
    rows = files.label_rows(_label_texts(spark, d)[1])
    return rows.select("stem", "line_no", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("cx", "cy", "w", "h")])


@query(f"WITH {_LABEL_SQL} SELECT stem, line_no::INT AS line_no, round((cx - w / 2) * 1e6)::BIGINT AS x1, round((cy - h / 2) * 2e6)::BIGINT AS y1, round((cx + w / 2) * 1e6)::BIGINT AS x2, round((cy + h / 2) * 2e6)::BIGINT AS y2 FROM l")
def q42_label_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Label text as corners without clamping, in an image of a million by two million pixels."""
    frames, texts = _label_texts(spark, d)
    rows = files.pixel_boxes(files.label_rows(texts, clamped=False), frames.withColumn("width", F.lit(1_000_000)).withColumn("height", F.lit(2_000_000)))
    return rows.select("stem", "line_no", *[F.round(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"WITH {_LABEL_SQL}, f AS (SELECT DISTINCT p_brand || '_' || p_size AS stem FROM part) SELECT f.stem, (CASE WHEN count(l.stem) > 0 THEN count(l.stem) + 1 ELSE 0 END)::INT AS n_lines FROM f LEFT JOIN l ON f.stem = l.stem GROUP BY f.stem")
def q43_label_line_count(spark: SparkSession, d: str) -> DataFrame:
    """Lines that aren't blank, short ones too; 0 for empty texts."""
    return files.line_counts(*_label_texts(spark, d))


# ---------------------------------------------------------------- shape annotations and COCO records

_REGION_SQL = "r AS (SELECT p_brand AS source, p_partkey, p_brand || '_' || (p_partkey % 50) AS filename, (p_partkey % 40)::DOUBLE AS x, (p_size % 30)::DOUBLE AS y, p_size::DOUBLE AS w, (p_partkey % 20 + 1)::DOUBLE AS h, p_partkey % 3 = 0 AS body FROM part)"


def _region_texts(spark: SparkSession, d: str) -> DataFrame:
    """(path, value): for each brand one JSON object of entries by key, with lists of regions, and an entry without a file name."""
    key, size = F.col("p_partkey"), F.col("p_size")
    shape = F.struct(F.lit("rect").alias("name"), (key % 40).cast("double").alias("x"), (size % 30).cast("double").alias("y"), size.cast("double").alias("width"), (key % 20 + 1).cast("double").alias("height"))
    part = F.struct(F.when(key % 3 == 0, "body").otherwise("fluke").alias("body_part"))
    rows = table(spark, d, "part").select("p_brand", F.concat("p_brand", F.lit("_"), key % 50).alias("filename"), key.alias("seq"), F.struct(shape.alias("shape_attributes"), part.alias("region_attributes")).alias("region"))
    entries = rows.groupBy("p_brand", "filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "region"))), lambda s: s.region).alias("regions"))
    listed = entries.groupBy("p_brand").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("k_"), "filename").alias("key"), F.struct("filename", "regions").alias("value"))))).alias("m"))
    return listed.select(F.col("p_brand").alias("path"), F.to_json("m").alias("value"))


def _sized(entries: DataFrame, name: str) -> DataFrame:
    """Images of 128 x 64 pixels; one in ten has no size."""
    return entries.select(name).distinct().filter(~F.col(name).endswith("7")).select(name, F.lit(128).alias("width"), F.lit(64).alias("height"), F.lit(1).alias("orientation"))


_SHAPE_OUT = "greatest(0, least(1, (x1 / 128 + x2 / 128) / 2)) AS cx, greatest(0, least(1, (y1 / 64 + y2 / 64) / 2)) AS cy, greatest(0, least(1, x2 / 128 - x1 / 128)) AS w, greatest(0, least(1, y2 / 64 - y1 / 64)) AS h"


@query(f"""
WITH {_REGION_SQL}, s AS (SELECT *, bool_or(body) OVER (PARTITION BY filename) AS has_body FROM r WHERE right(filename, 1) <> '7'),
b AS (SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY p_partkey) - 1 AS seq, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM s WHERE body OR NOT has_body)
SELECT filename, seq::INT AS seq, {_SHAPE_OUT} FROM b
""")
def q44_shape_scan(spark: SparkSession, d: str) -> DataFrame:
    """Shape annotations in JSON: of each image the regions of the body, or all where none is; images without a known size are left out."""
    entries = shapes.region_rows(_region_texts(spark, d))
    return shapes.shape_boxes(entries, _sized(entries, "filename")).select("filename", "seq", "box.*")


@query(f"WITH {_REGION_SQL}, b AS (SELECT filename, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM r WHERE right(filename, 1) <> '7' GROUP BY filename) SELECT filename, {_SHAPE_OUT} FROM b")
def q45_union_box(spark: SparkSession, d: str) -> DataFrame:
    entries = shapes.region_rows(_region_texts(spark, d))
    return shapes.shape_boxes(entries, _sized(entries, "filename"), "union").select("filename", "box.*")


@query("""
WITH c AS (SELECT p_partkey, 'img' || p_partkey AS file_name, p_partkey % 3 AS mode, (p_partkey % 60)::DOUBLE AS a, (p_size)::DOUBLE AS b, (p_partkey % 60 + p_size)::DOUBLE AS c, (p_size + 9)::DOUBLE AS d FROM part WHERE p_partkey % 10 <> 7 AND p_partkey % 11 <> 0),
k AS (SELECT file_name, a AS x1, b AS y1, CASE WHEN mode = 0 THEN c ELSE a + c END AS x2, CASE WHEN mode = 0 THEN d ELSE b + d END AS y2 FROM c)
SELECT file_name, greatest(0, least(1, (x1 + x2) / 2 / 128)) AS cx, greatest(0, least(1, (y1 + y2) / 2 / 64)) AS cy, greatest(0, least(1, (x2 - x1) / 128)) AS w, greatest(0, least(1, (y2 - y1) / 64)) AS h FROM k
""")
def q46_coco_scan(spark: SparkSession, d: str) -> DataFrame:
    """COCO records as JSON lines: modes 0, others and none, boxes of fewer than four numbers, images without a size."""
    key, size = F.col("p_partkey"), F.col("p_size")
    box = F.array((key % 60).cast("double"), size.cast("double"), (key % 60 + size).cast("double"), (size + 9).cast("double"))
    one = F.struct(F.when(key % 11 == 0, F.slice(box, 1, 3)).otherwise(box).alias("bbox"), F.when(key % 3 != 2, key % 3).cast("int").alias("bbox_mode"), F.lit(0).alias("category_id"))
    lines = table(spark, d, "part").select(F.to_json(F.struct(F.concat(F.lit("img"), key).alias("file_name"), F.array(one).alias("annotations"))).alias("line"))
    records = lines.select(F.from_json("line", schema.COCO_RECORD).alias("r")).select("r.*")
    return shapes.coco_boxes(records, _sized(records, "file_name").drop("orientation")).select("file_name", "box.*")


@query("SELECT count(*) FILTER (WHERE p_partkey % 10 = 7) AS n_missing, count(*) FILTER (WHERE p_partkey % 10 <> 7) AS n_known FROM part")
def q47_missing_images(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.concat(F.lit("img"), "p_partkey").alias("file_name"))
    known, missing = shapes.with_missing(names, _sized(names, "file_name"), "file_name")
    return missing.crossJoin(known.agg(F.count("*").alias("n_known")))


# ---------------------------------------------------------------- names and listings


@query("""
SELECT p_partkey, 'TO' || (p_size % 5) || 'a_Sight' || (p_partkey % 9) AS scene, p_partkey % 40 AS x, p_size AS y, 'src' || (p_partkey % 4) || '_t640_o0.20_i1024_c0.' || lpad((p_size * 10)::VARCHAR, 3, '0') || '_n' || p_size AS cache_key, 'P' || p_partkey AS parent FROM part
""")
def q48_file_names(spark: SparkSession, d: str) -> DataFrame:
    """What names carry: group key, tile origin, parent, and the key of a prediction cache."""
    key, size = F.col("p_partkey"), F.col("p_size")
    stem = F.format_string("survey_TO%da_Sight%d_IMG_%d", size % 5, key % 9, key)
    tile = F.format_string("P%d_x%d_y%d_q", key, key % 40, size)
    origin = naming.tile_origin(tile)
    cache = naming.cache_key(F.concat(F.lit("src"), key % 4), F.lit(640), F.lit(0.2), F.lit(1024), size / F.lit(100.0), size)
    return table(spark, d, "part").select("p_partkey", naming.group_key(stem, r"_(TO\d+\w+?)_(Sight\w+|Misc|MISC)_IMG_(\d+)", 2).alias("scene"), origin.x.cast("long").alias("x"), origin.y.alias("y"), cache.alias("cache_key"), F.regexp_extract(tile, r"^(P\d+)_x", 1).alias("parent"))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Image paths .../<raw split>/images/<stem>.<extension>: several extensions for one stem."""
    key = F.col("p_partkey")
    raw = F.element_at(F.array(*[F.lit(s) for s in ("train", "valid", "test", "other")]), (key % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(e) for e in ("jpg", "PNG", "jpeg", "txt")]), (key % 5 % 4 + 1).cast("int"))
    path = F.concat_ws("/", F.lit("/data/src"), raw, F.lit("images"), F.concat(F.lit("i"), F.floor(key / 2), F.lit("."), ext))
    return table(spark, d, "part").select(path.alias("path"), F.concat(F.lit("i"), F.floor(key / 2)).alias("stem"), ext.alias("extension")).filter(F.col("extension").isin(*files.IMAGE_EXTENSIONS))


_LISTING_SQL = "f AS (SELECT 'i' || (p_partkey // 2) AS stem, ['train', 'valid', 'test', 'other'][p_partkey % 4 + 1] AS raw, ['jpg', 'PNG', 'jpeg', 'txt'][p_partkey % 5 % 4 + 1] AS ext FROM part), g AS (SELECT *, '/data/src/' || raw || '/images/' || stem || '.' || ext AS path, CASE ext WHEN 'jpg' THEN 1 WHEN 'jpeg' THEN 2 ELSE 6 END AS ord FROM f WHERE ext <> 'txt')"


@query(f"WITH {_LISTING_SQL} SELECT stem, arg_min(path, (ord, path)) AS path FROM g GROUP BY stem")
def q49_extension_probe(spark: SparkSession, d: str) -> DataFrame:
    return files.image_by_stem(_listing(spark, d))


@query(f"WITH {_LISTING_SQL} SELECT path, raw AS raw_split, CASE raw WHEN 'valid' THEN 'val' ELSE raw END AS split, CASE WHEN b.stem IS NULL THEN 0 ELSE b.n END AS n_boxes FROM g LEFT JOIN (SELECT 'i' || p_size AS stem, count(*) AS n FROM part GROUP BY 1) b ON g.stem = b.stem WHERE raw <> 'other'")
def q50_export_scan(spark: SparkSession, d: str) -> DataFrame:
    """A raw export by split: images with their labels by stem; those without are background."""
    splits = spark.createDataFrame([("train", "train"), ("valid", "val"), ("test", "test")], "raw_split string, split string")
    labels = table(spark, d, "part").select(F.concat(F.lit("i"), "p_size").alias("stem"))
    return files.labelled_frames(files.export_frames(_listing(spark, d), splits), labels).select("path", "raw_split", "split", "n_boxes")


@query("SELECT '/d/' || s || '/scene' || (conv_id % 50) || '/f' || conv_id || '_' || turn || '.jpg' AS path, s AS split, 'scene' || (conv_id % 50) AS scene FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'val' ELSE 'train' END AS s FROM conversations)")
def q51_scene_scan(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("conv_id") % 3 == 0, "val").otherwise("train")
    path = F.concat_ws("/", F.lit("/d"), split, F.concat(F.lit("scene"), F.col("conv_id") % 50), F.concat(F.lit("f"), "conv_id", F.lit("_"), "turn", F.lit(".jpg")))
    return files.scene_frames(table(spark, d, "conversations").select(path.alias("path"))).select("path", "split", "scene")


@query(f"WITH {_LISTING_SQL} SELECT DISTINCT 'i' || p_size AS stem FROM part WHERE 'i' || p_size IN (SELECT stem FROM g)")
def q52_labels_with_image(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "part").select(F.concat(F.lit("i"), "p_size").alias("stem")).distinct()
    return labels.join(_listing(spark, d), "stem", "left_semi")


@query("""
SELECT 'f' || (event_id % 997) AS frame, max_by(a, event_id) AS altitude_m FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) END AS a FROM events) WHERE a IS NOT NULL GROUP BY 1
""")
def q53_flight_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of a flight as text columns: bad numbers are skipped, of repeated names the last row counts."""
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.round("value", 2).cast("string"))
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/a/b/f"), F.col("event_id") % 997)).alias("filename"), F.concat(F.lit("f"), F.col("event_id") % 997).alias("frame"), text.alias("altitude_m"), F.col("event_id").alias("_n"))
    return files.logged_altitudes(rows)


@query("""
WITH l AS (SELECT 'f' || (event_id % 997) AS frame, max_by(value, event_id) AS altitude_m FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT e.event_id, l.altitude_m AS logged_altitude, coalesce(l.altitude_m, CASE WHEN e.event_id % 5 = 0 THEN 77.0::DOUBLE END, 120.0::DOUBLE) AS altitude FROM events e LEFT JOIN l ON l.frame = 'f' || (e.event_id % 1200)
""")
def q54_logged_altitude(spark: SparkSession, d: str) -> DataFrame:
    """Frames with the altitude of their flight log, else of the image, else a constant."""
    events = table(spark, d, "events")
    log = files.logged_altitudes(events.filter("event_id % 2 = 0").select(F.concat(F.lit("f"), F.col("event_id") % 997).alias("frame"), F.col("value").cast("string").alias("altitude_m"), F.col("event_id").alias("_n")))
    frames = telemetry.with_flight_log(events.select("event_id", F.concat(F.lit("f"), F.col("event_id") % 1200).alias("frame")), log)
    own = F.when(F.col("event_id") % 5 == 0, F.lit(77.0))
    return frames.select("event_id", "logged_altitude", flight.source_altitude(F.col("logged_altitude"), own, F.lit(120.0)).alias("altitude"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN p_size::DOUBLE END AS altitude FROM part")
def q55_xmp_altitude(spark: SparkSession, d: str) -> DataFrame:
    """The altitude in a file's XMP block, by its keys in their order."""
    first = F.concat(F.lit('x drone-dji:RelativeAltitude="-'), F.col("p_retailprice").cast("string"), F.lit('" GPSAltitude="5"'))
    other = F.concat(F.lit('y GPSAltitude="+'), F.col("p_size").cast("string"), F.lit('.0" z'))
    kind = F.col("p_size") % 3
    content = F.when(kind == 0, first).when(kind == 1, other).otherwise("nothing of the kind")
    return table(spark, d, "part").select("p_partkey", naming.xmp_altitude(F.encode(content, "UTF-8")).alias("altitude"))


# ---------------------------------------------------------------- registries

_SPLIT_ROWS = ", ".join(f"('{s}', '{ld}', '{st}', {x if x is not None else 'NULL'})" for s, ld, st, x, _ in registry.SPLIT_CONFIG)
_SOURCE_ROWS = ", ".join(f"('{s[0]}', {k}, '{s[1]}', '{s[2]}', {len(s[4])})" for k, s in enumerate(registry.SOURCES))


_SOURCE_NAMES = [s[0] for s in registry.SOURCES]


@query(f"""WITH s(name, ordinal, domain, format, n_splits) AS (VALUES {_SOURCE_ROWS}), d AS (SELECT doc_id, {_SOURCE_NAMES}[doc_id % {len(_SOURCE_NAMES)} + 1] AS name FROM documents)
SELECT doc_id, name, ordinal, domain, format, n_splits FROM d JOIN s USING (name) WHERE name IN ('dryad', 'dolphin', 'whaleshape')""")
def q56_source_registry(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the sources that are asked for, with what is registered of them."""
    names = F.array(*[F.lit(n) for n in _SOURCE_NAMES])
    docs = table(spark, d, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % len(_SOURCE_NAMES) + 1).cast("int")).alias("name"))
    return registry.selected(docs, ("dryad", "dolphin", "whaleshape"), "name").select("doc_id", "name", "ordinal", "domain", "format", F.size("splits").alias("n_splits"))


def _named_source(column: str) -> Column:
    names = F.array(*[F.lit(s[0]) for s in registry.SPLIT_CONFIG], F.lit("unregistered"))
    return F.element_at(names, (F.col(column) % (len(registry.SPLIT_CONFIG) + 1) + 1).cast("int"))


_NAMED_SOURCE_SQL = f"[{', '.join(repr(s[0]) for s in registry.SPLIT_CONFIG)}, 'unregistered'][{{}} % {len(registry.SPLIT_CONFIG) + 1} + 1]"


@query(f"WITH c(source, label_dir, strategy, stride) AS (VALUES {_SPLIT_ROWS}), d AS (SELECT doc_id, {_NAMED_SOURCE_SQL.format('doc_id')} AS source FROM documents) SELECT doc_id, d.source, label_dir, strategy, stride FROM d LEFT JOIN c ON d.source = c.source")
def q57_registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", _named_source("doc_id").alias("source"))
    return registry.with_split_config(docs).select("doc_id", "source", "label_dir", "strategy", "stride")


_LISTS = f"{list(registry.AERIAL)!r}", f"{list(registry.AERIAL + registry.SURFACE)!r}", f"{[s for s in registry.AERIAL if s != 'uav-porpoises']!r}"


@query(f"""
WITH v(variant, sources) AS (VALUES ('B', {_LISTS[0]}), ('E1', {_LISTS[1]}), ('E2', {_LISTS[2]}), ('E4_0', {_LISTS[0]}), ('E4_20', {_LISTS[0]})),
m AS (SELECT doc_id, {_NAMED_SOURCE_SQL.format('doc_id')} AS source, CASE WHEN n_chars % 5 = 0 THEN 'val' ELSE 'train' END AS split, (n_chars % 3 <> 0)::INT AS kept FROM documents)
SELECT variant, count(*) AS n_pos FROM v JOIN m ON list_contains(sources, source) AND kept = 1 AND split = 'train' GROUP BY variant
""")
def q58_variant_rows(spark: SparkSession, d: str) -> DataFrame:
    """Kept training rows of each variant's sources: lists joined, and one of them less a source."""
    manifest = table(spark, d, "documents").select("doc_id", _named_source("doc_id").alias("source"), F.when(F.col("n_chars") % 5 == 0, "val").otherwise("train").alias("split"), F.when(F.col("n_chars") % 3 != 0, 1).otherwise(0).alias("kept"))
    kept = curation.kept_rows(manifest, "train", [*registry.AERIAL, *registry.SURFACE])
    wanted = registry.variants(spark).select("variant", F.explode("sources").alias("s"))
    return kept.join(F.broadcast(wanted), F.col("source") == F.col("s")).groupBy("variant").agg(F.count("*").alias("n_pos"))  # some 30 rows


# ---------------------------------------------------------------- counters and negatives


@query("SELECT o_orderkey AS frame FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q59_empty_frames(spark: SparkSession, d: str) -> DataFrame:
    return negatives.empty_frames(fx.curation_frames(spark, d), fx.curation_boxes(spark, d)).select("frame")


@query("""
WITH f AS (SELECT doc_id, source, md5(text) AS content, n_chars % 300 AS base, lpad(doc_id::VARCHAR, 12, '0') AS path, n_chars % 4 AS n_boxes, doc_id % 9 = 0 AS missing, doc_id % 6 = 0 AS reoriented FROM documents),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY path) AS rn FROM f WHERE NOT missing) WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY source, path) AS nth FROM c) WHERE nth = 1),
x AS (SELECT source, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE NOT missing) AS present FROM f GROUP BY source),
y AS (SELECT source, count(*) AS collapsed FROM c GROUP BY source),
z AS (SELECT source, count(*) AS images, sum(n_boxes) AS boxes, count(*) FILTER (WHERE n_boxes = 0) AS backgrounds, count(*) FILTER (WHERE reoriented) AS reoriented FROM k GROUP BY source),
r AS (SELECT x.source, coalesce(images, 0) AS images, coalesce(boxes, 0) AS boxes, coalesce(backgrounds, 0) AS backgrounds, missing, present - coalesce(collapsed, 0) AS augmented, coalesce(collapsed, 0) - coalesce(images, 0) AS dup_skipped, coalesce(reoriented, 0) AS reoriented
  FROM x LEFT JOIN y ON x.source = y.source LEFT JOIN z ON x.source = z.source)
SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, sum(images)::BIGINT AS images, sum(boxes)::BIGINT AS boxes, sum(backgrounds)::BIGINT AS backgrounds, sum(missing)::BIGINT AS missing, sum(augmented)::BIGINT AS augmented, sum(dup_skipped)::BIGINT AS dup_skipped, sum(reoriented)::BIGINT AS reoriented FROM r GROUP BY ROLLUP (source)
""")
def q60_normalization_counters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "source", F.md5("text").alias("content"), (F.col("n_chars") % 300).alias("base"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), (F.col("n_chars") % 4).alias("n_boxes"),
        (F.col("doc_id") % 9 == 0).alias("missing"), (F.col("doc_id") % 6 == 0).alias("reoriented"),
    )
    return curation.normalization_counters(docs)


_POOL_SQL = """f AS (SELECT 'p' || p_partkey AS stem, 300 + p_size * 40 AS width, 200 + p_size * 25 AS height FROM part WHERE p_partkey % 3 = 0),
t AS (SELECT *, unnest([512, 1024]) AS tile FROM f),
x AS (SELECT *, unnest(CASE WHEN tile >= width THEN [0] ELSE list_distinct(list_concat(range(0, width - tile + 1, tile), [width - tile])) END) AS x FROM t),
y AS (SELECT *, unnest(CASE WHEN tile >= height THEN [0] ELSE list_distinct(list_concat(range(0, height - tile + 1, tile), [height - tile])) END) AS y FROM x),
pool AS (SELECT stem || '__full.jpg' AS image, 'full' AS kind, stem AS parent, width AS w, height AS h FROM f
  UNION ALL SELECT stem || '__t' || tile || '_x' || x || '_y' || y || '.jpg', 'tile' || tile, stem, least(tile, width), least(tile, height) FROM y
  UNION ALL SELECT 'val__v' || s_suppkey || '.jpg', 'validated', 'v' || s_suppkey || '.jpg', 640, 640 FROM supplier)"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("stem"), (300 + F.col("p_size") * 40).alias("width"), (200 + F.col("p_size") * 25).alias("height"))
    validated = table(spark, d, "supplier").select(F.concat(F.lit("v"), "s_suppkey", F.lit(".jpg")).alias("name"), F.lit(640).alias("w"), F.lit(640).alias("h"))
    return negatives.negative_pool(frames, [512, 1024], validated)


@query(f"WITH {_POOL_SQL} SELECT image, kind, parent, w, h FROM pool")
def q61_negative_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


@query(f"WITH {_POOL_SQL} SELECT kind, count(*) AS n FROM pool GROUP BY kind")
def q62_counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return negatives.counts_by(_pool(spark, d), "kind")


@query("""
WITH s AS (SELECT o_orderpriority AS source, sqrt(greatest(l_quantity, 0) * greatest(l_linenumber * 3.0::DOUBLE, 0)) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT source, quantile_cont(size, 0.5) AS p FROM s GROUP BY source)
SELECT source, round(p * 1000)::BIGINT AS p50, row_number() OVER (ORDER BY p, source)::INT AS place FROM m
""")
def q63_sources_by_median(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 3.0).alias("h"))
    return curation.sources_by_median(curation.box_scale(fx.curation_frames(spark, d), boxes)).select("source", F.round(F.col("p50") * 1000).cast("long").alias("p50"), "place")


@query("SELECT c.conv_id * 100 + c.turn AS id, c.conv_id AS task_id, c.text AS result, d.text AS data FROM conversations c JOIN documents d ON c.conv_id = d.doc_id WHERE c.turn % 3 <> 0")
def q64_completions(spark: SparkSession, d: str) -> DataFrame:
    """Completions of annotation tasks with the tasks' data, as two tables."""
    done = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("task_id"), F.col("text").alias("result"), F.when(F.col("turn") % 3 == 0, 1).when(F.col("turn") % 3 == 1, 0).alias("was_cancelled"))
    tasks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("project_id"), F.col("text").alias("data"))
    return annotation.completions(done, tasks).select("id", "task_id", "result", "data")


# ---------------------------------------------------------------- altitude benchmark

_ANIMALS_SQL = "a AS (SELECT p_partkey AS id, 20.0::DOUBLE + p_size * 8 AS native_px, 1.5::DOUBLE + (p_partkey % 34) / 2.0::DOUBLE AS length_m FROM part), h AS (SELECT altitude_m, (4.39::DOUBLE * 1e-6::DOUBLE) * altitude_m / (35.0::DOUBLE * 1e-3::DOUBLE) AS gsd FROM (SELECT unnest([60.0, 120.0, 200.0, 320.0])::DOUBLE AS altitude_m))"


def _animals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    animals = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.lit(20.0) + F.col("p_size") * 8).alias("native_px"), (F.lit(1.5) + (F.col("p_partkey") % 34) / F.lit(2.0)).alias("length_m"))
    altitudes = spark.createDataFrame([(60.0,), (120.0,), (200.0,), (320.0,)], "altitude_m double")
    return animals, altitudes.withColumn("gsd", flight.gsd(F.lit(4.39), F.col("altitude_m"), F.lit(35.0)))


@query(f"WITH {_ANIMALS_SQL}, s AS (SELECT id, altitude_m, native_px * least((length_m / gsd) / native_px, 1) AS apparent_px FROM a, h) SELECT id, altitude_m, apparent_px FROM s WHERE apparent_px >= 100")
def q65_animals_at_altitudes(spark: SparkSession, d: str) -> DataFrame:
    return planning.animals_at(*_animals(spark, d), 100.0).select("id", "altitude_m", "apparent_px")


@query(f"""
WITH {_ANIMALS_SQL}, s AS (SELECT altitude_m, round_even(native_px * least((length_m / gsd) / native_px, 1), 0) AS px FROM a, h WHERE native_px * least((length_m / gsd) / native_px, 1) >= 100),
c AS (SELECT altitude_m, count(*) AS n_animals, min(px) AS min_px, max(px) AS max_px FROM s GROUP BY altitude_m),
l AS (SELECT min(length_m) AS len_min_m, max(length_m) AS len_max_m, (list(length_m ORDER BY length_m))[count(*) // 2 + 1] AS len_median_m FROM a)
SELECT h.altitude_m, coalesce(n_animals, 0) AS n_animals, coalesce(min_px, 0) AS min_px, coalesce(max_px, 0) AS max_px, len_min_m, len_max_m, len_median_m FROM h LEFT JOIN c ON h.altitude_m = c.altitude_m, l
""")
def q66_altitude_manifest(spark: SparkSession, d: str) -> DataFrame:
    return planning.altitude_manifest(*_animals(spark, d), 100.0).drop("gsd_cm_px")


@query("WITH " + fx.MATCH_SQL + " SELECT frame, gt_idx FROM g WHERE greatest(x2 - x1, y2 - y1) >= 18 AND EXISTS (SELECT 1 FROM i WHERE i.frame = g.frame AND i.gt_idx = g.gt_idx)")
def q67_native_scale(spark: SparkSession, d: str) -> DataFrame:
    """Boxes large enough that a detection overlaps at native scale."""
    return planning.detected_at_native_scale(fx.truth(spark, d), fx.detections(spark, d), 18).select("frame", "gt_idx")


_HASHED = "('0x' || substr(md5('7|{k}|' || p_partkey), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


@query(f"SELECT p_partkey AS id, CASE WHEN {_HASHED.format(k=0)} < 0.2 THEN 8.0::DOUBLE + {_HASHED.format(k=1)} * 10.0::DOUBLE ELSE 1.5::DOUBLE + {_HASHED.format(k=1)} * 2.5::DOUBLE END AS length_m FROM part")
def q68_body_lengths(spark: SparkSession, d: str) -> DataFrame:
    return planning.body_lengths(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "mixture", 7)


@query("""
WITH n AS (SELECT o_custkey AS frame, count(*) AS n FROM orders GROUP BY o_custkey), c AS (SELECT *, greatest(ceil(sqrt(n * 8192 / 5460.0::DOUBLE)), 1)::INT AS cols FROM n)
SELECT frame, i, (i // cols)::INT AS row, (i % cols)::INT AS col FROM (SELECT *, unnest(range(n))::INT AS i FROM c)
""".replace("AS row,", 'AS "row",'))
def q69_grid_layout(spark: SparkSession, d: str) -> DataFrame:
    """Places of a frame's animals in a grid of about the image's proportions."""
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("frame")).agg(F.count("*").alias("n"))
    cells = counts.select("frame", F.posexplode(g.grid_cells(F.col("n").cast("int"), F.lit(8192), F.lit(5460))).alias("i", "c"))
    return cells.select("frame", "i", "c.row", F.col("c.column").alias("col"))


# ---------------------------------------------------------------- decisions and prediction


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size / 1000.0::DOUBLE END AS given, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS alt, CASE WHEN p_size % 5 <> 0 THEN p_size * 10.0::DOUBLE END AS exif, CASE WHEN p_partkey % 2 = 0 THEN 24.0::DOUBLE END AS focal FROM part)
SELECT p_partkey, CASE WHEN given IS NOT NULL THEN 'gsd' WHEN alt IS NOT NULL THEN 'altitude' WHEN exif IS NOT NULL THEN 'exif' ELSE 'none' END AS source,
  coalesce(given, (3.76::DOUBLE * 1e-6::DOUBLE) * alt / (70.0::DOUBLE * 1e-3::DOUBLE), (3.76::DOUBLE * 1e-6::DOUBLE) * exif / (coalesce(focal, 70.0::DOUBLE) * 1e-3::DOUBLE)) AS gsd FROM p
""")
def q70_gsd_cascade(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    out = flight.resolved_gsd(F.when(size % 4 == 0, size / F.lit(1000.0)), F.when(size % 3 == 0, F.col("p_retailprice")), F.when(size % 5 != 0, size * F.lit(10.0)), F.lit(3.76), F.lit(70.0), F.when(F.col("p_partkey") % 2 == 0, F.lit(24.0)))
    return table(spark, d, "part").select("p_partkey", out.alias("r")).select("p_partkey", "r.source", "r.gsd")


_BLIND_SQL = f"""WITH {fx.TELEMETRY_SQL},
p AS (SELECT *, last_value(CASE WHEN kind = 'altitude' THEN value END IGNORE NULLS) OVER w AS alt, last_value(CASE WHEN kind = 'gsd' THEN value END IGNORE NULLS) OVER w AS gsd
  FROM e WINDOW w AS (PARTITION BY flight ORDER BY ts, CASE WHEN kind = 'image' THEN 1 ELSE 0 END, event_id ROWS UNBOUNDED PRECEDING)),
i AS (SELECT * FROM p WHERE kind = 'image'),
b AS (SELECT flight, arg_min(512 * (1 + k % 4), (ts, event_id)) AS blind FROM i WHERE nullif(alt, 0) IS NULL AND nullif(gsd, 0) IS NULL GROUP BY flight)"""


def _swept(spark: SparkSession, d: str) -> DataFrame:
    return fx.telemetry(spark, d).withColumn("swept", (512 * (1 + F.col("k") % 4)).cast("int"))


@query(_BLIND_SQL + """ SELECT event_id, CASE WHEN nullif(alt, 0) IS NULL AND nullif(gsd, 0) IS NULL THEN 'blind_cached' ELSE 'known' END AS how, CASE WHEN nullif(alt, 0) IS NULL AND nullif(gsd, 0) IS NULL THEN blind END AS slice FROM i LEFT JOIN b ON i.flight = b.flight""")
def q71_blind_slices(spark: SparkSession, d: str) -> DataFrame:
    """Frames without geometry take the slice that a sweep of their flight's first one picked."""
    frames = telemetry.blind_slices(telemetry.latest_before(_swept(spark, d)))
    decided = telemetry.decisions(frames, blind=F.col("blind_slice"))
    cached = F.col("mode") == "blind_cached"
    return decided.select("event_id", F.when(cached, "blind_cached").otherwise("known").alias("how"), F.when(cached, F.col("slice")).alias("slice"))


@query(f"WITH {fx.TELEMETRY_SQL} SELECT event_id, 'fixed' AS mode, 1024 AS slice, 70::BIGINT AS tiles FROM e WHERE kind = 'image'")
def q72_fixed_mode(spark: SparkSession, d: str) -> DataFrame:
    """Fixed mode ignores geometry."""
    return telemetry.decisions(telemetry.latest_before(fx.telemetry(spark, d)), "fixed").select("event_id", "mode", "slice", "tiles")


@query(_BLIND_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY ts, event_id) AS n_frame FROM i) SELECT event_id, n.flight, alt AS topic_altitude, gsd AS topic_gsd, n_frame, blind AS blind_slice FROM n LEFT JOIN b ON n.flight = b.flight")
def q73_stream_frames(spark: SparkSession, d: str) -> DataFrame:
    """The telemetry as a stream with state, read in one batch and published as a table."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern may be a file or a folder
    kind = F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "click", "altitude").when(F.col("event_type") == "signup", "gsd").otherwise("other")
    value = F.when(F.col("event_type") == "signup", F.col("value") / F.lit(10000.0)).otherwise(F.col("value") + 30.0)
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select(F.col("user_id").alias("flight"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), value.alias("value"), "event_id", (512 * (1 + k % 4)).cast("int").alias("swept"))
    telemetry.publish(telemetry.enriched_stream(rows), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("event_id", "flight", "topic_altitude", "topic_gsd", "n_frame", "blind_slice")


@query("WITH " + fx.MATCH_SQL + " SELECT frame, count(*)::INT AS n, round(min(score) * 1e9)::BIGINT AS lo, round(max(score) * 1e9)::BIGINT AS hi, round(avg(score) * 1e6)::BIGINT AS mid FROM d GROUP BY frame")
def q74_frame_json(spark: SparkSession, d: str) -> DataFrame:
    """Frames' detections with a summary of their scores as JSON, read back."""
    dets = fx.detections(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("det_seq", "score"))).alias("detections")).withColumn("decision", F.lit("plain"))
    read = sinks.frame_json(dets).select("frame", F.from_json("json", "struct<scores: struct<n: int, min: double, mean: double, max: double>>").alias("j"))
    return read.select("frame", "j.scores.n", F.round(F.col("j.scores.min") * 1e9).cast("long").alias("lo"), F.round(F.col("j.scores.max") * 1e9).cast("long").alias("hi"), F.round(F.col("j.scores.mean") * 1e6).cast("long").alias("mid"))


def _detector(objects: DataFrame, floor_px: float):
    """A detector of known objects (frame, seq, box, score): those that lie in a tile whole, and are ``floor_px`` or more of a thousandth of it, each by its number."""

    def detect(tiles: DataFrame) -> DataFrame:
        own = objects.select(F.col("frame").alias("of"), F.col("det_seq"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")], "score")
        inside = (F.col("ox1") >= F.col("x")) & (F.col("oy1") >= F.col("y")) & (F.col("ox2") <= F.col("x") + F.col("tile_w")) & (F.col("oy2") <= F.col("y") + F.col("tile_h"))
        seen = (F.col("ox2") - F.col("ox1")) * 1024 / F.greatest("tile_w", "tile_h") >= floor_px
        met = tiles.join(own, (F.col("frame") == F.col("of")) & inside & seen)
        return met.select("frame", "x", "y", "det_seq", *[(F.col(f"o{c}") - F.col(c[0])).alias(c) for c in ("x1", "y1", "x2", "y2")], "score")

    return detect


_PLANNED_SQL = f"""{_TWO_SQL},
fr AS (SELECT c_custkey AS frame, (60 + 10 * (c_custkey % 27))::DOUBLE AS altitude FROM customer),
ge AS (SELECT *, (4.39::DOUBLE * 1e-6::DOUBLE) * altitude / (35.0::DOUBLE * 1e-3::DOUBLE) AS gsd FROM fr),
de AS (SELECT *, CASE WHEN (3.0::DOUBLE / gsd) / (8192::DOUBLE / 1024) < 45 THEN greatest(512, least(round_even((3.0::DOUBLE / gsd) * 1024 / 45.0::DOUBLE, 0), 8192))::INT END AS slice FROM ge),
sz AS (SELECT *, coalesce(slice, 8192) AS s, coalesce(slice, 8192) - floor(0.2::DOUBLE * coalesce(slice, 8192))::INT AS step FROM de),
tx AS (SELECT *, unnest(CASE WHEN s >= 8192 THEN [0] ELSE list_transform(range(0, ceil((8192 - s) / step::DOUBLE)::INT + 1), lambda k: least(k * step, 8192 - s)) END) AS tx FROM sz),
ti AS (SELECT *, unnest(CASE WHEN s >= 5460 THEN [0] ELSE list_transform(range(0, ceil((5460 - s) / step::DOUBLE)::INT + 1), lambda k: least(k * step, 5460 - s)) END) AS ty FROM tx)"""


def _planned_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "customer").select(F.col("c_custkey").alias("frame"), (60 + 10 * (F.col("c_custkey") % 27)).cast("double").alias("altitude"))
    return frames.withColumn("width", F.lit(8192)).withColumn("height", F.lit(5460)).withColumn("gsd", flight.gsd(F.lit(4.39), F.col("altitude"), F.lit(35.0)))


@query(_PLANNED_SQL + """ SELECT ti.frame, row_number() OVER (PARTITION BY ti.frame ORDER BY ty, tx, a.det_seq) AS det_seq, x1, y1, x2, y2, score FROM ti JOIN a ON ti.frame = a.frame
  AND x1 >= tx AND y1 >= ty AND x2 <= tx + least(s, 8192) AND y2 <= ty + least(s, 5460) AND (x2 - x1) * 1024 / least(s, 8192) >= 3 WHERE score >= 0.1::DOUBLE""")
def q75_adaptive_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The decision of each frame, its tiles, and a detector of known objects in them, from a confidence on."""
    return planning.adaptive_prediction(_planned_frames(spark, d), _detector(_two_models(spark, d)[0], 3.0), 0.1, seams=None, given_gsd=F.col("gsd"))


@query(_PLANNED_SQL + """,
ra AS (SELECT ti.frame, a.det_seq, x1, y1, x2, y2, score FROM ti JOIN a ON ti.frame = a.frame AND x1 >= tx AND y1 >= ty AND x2 <= tx + least(s, 8192) AND y2 <= ty + least(s, 5460) AND (x2 - x1) * 1024 / least(s, 8192) >= 3 WHERE score >= 0.1::DOUBLE),
rc AS (SELECT DISTINCT ti.frame, x1, y1, x2, y2 FROM ti JOIN c ON ti.frame = c.frame AND x1 >= tx AND y1 >= ty AND x2 <= tx + least(s, 8192) AND y2 <= ty + least(s, 5460) AND (x2 - x1) * 1024 / least(s, 8192) >= 2 WHERE score >= 0.05::DOUBLE)
SELECT ra.frame, x1, y1, x2, y2, score FROM ra WHERE EXISTS (SELECT 1 FROM rc WHERE rc.frame = ra.frame AND greatest(least(ra.x2, rc.x2) - greatest(ra.x1, rc.x1), 0) * greatest(least(ra.y2, rc.y2) - greatest(ra.y1, rc.y1), 0) > 0
  AND greatest(least(ra.x2, rc.x2) - greatest(ra.x1, rc.x1), 0) * greatest(least(ra.y2, rc.y2) - greatest(ra.y1, rc.y1), 0) / ((ra.x2 - ra.x1) * (ra.y2 - ra.y1) + (rc.x2 - rc.x1) * (rc.y2 - rc.y1) - greatest(least(ra.x2, rc.x2) - greatest(ra.x1, rc.x1), 0) * greatest(least(ra.y2, rc.y2) - greatest(ra.y1, rc.y1), 0)) >= 0.2::DOUBLE)""")
def q76_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Two models with tiles and floors of their own, agreed."""
    a, c = _two_models(spark, d)
    models = [{"detect": _detector(a, 3.0), "conf": 0.1}, {"detect": _detector(c, 2.0), "conf": 0.05}]
    return planning.ensemble(_planned_frames(spark, d), models, "consensus", seams=None, given_gsd=F.col("gsd")).select("frame", "x1", "y1", "x2", "y2", "score")


@query("SELECT c_custkey AS frame, name, pitch AS pitch_um, focal AS focal_mm FROM (SELECT c_custkey, ['phaseone_ixm_rs150f', 'dji_zenmuse_p1', 'unknown'][c_custkey % 3 + 1] AS name FROM customer) x LEFT JOIN (VALUES ('phaseone_ixm_rs150f', 3.76::DOUBLE, 70.0::DOUBLE), ('dji_zenmuse_p1', 4.39::DOUBLE, 35.0::DOUBLE)) k(key, pitch, focal) ON name = key")
def q77_camera_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.lit("phaseone_ixm_rs150f"), F.lit("dji_zenmuse_p1"), F.lit("unknown"))
    frames = table(spark, d, "customer").select(F.col("c_custkey").alias("frame"), F.element_at(names, (F.col("c_custkey") % 3 + 1).cast("int")).alias("name"))
    return flight.with_camera(frames.withColumn("camera", F.col("name"))).select("frame", "name", "pitch_um", "focal_mm")
