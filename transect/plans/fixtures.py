"""Canonical relations (frames, boxes, detections, telemetry ...) made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transect.session import table

WIDTH, HEIGHT = 8192, 5460


def line_boxes(rows: DataFrame) -> DataFrame:
    """Integer-valued boxes and scores of lineitem rows."""
    x1, y1 = ((F.col("l_partkey") % 8) * 10).cast("double"), ((F.col("l_suppkey") % 8) * 10).cast("double")
    return rows.select("*", x1.alias("x1"), y1.alias("y1"), (x1 + 10 + F.col("l_quantity") % 20).alias("x2"), (y1 + 10 + F.col("l_linenumber") * 3).alias("y2"), ((F.col("l_partkey") % 997) / F.lit(997.0)).alias("score"))


#: What boxes and scores are made of leads the order: rows that the first BOX_ORDER columns leave equal have one box and one score.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
BOX_ORDER = LINE_ORDER[:5]

BOXES_SQL = """b AS (SELECT *, ((l_partkey % 8) * 10)::DOUBLE AS x1, ((l_suppkey % 8) * 10)::DOUBLE AS y1,
  ((l_partkey % 8) * 10)::DOUBLE + 10 + l_quantity % 20 AS x2, ((l_suppkey % 8) * 10)::DOUBLE + 10 + l_linenumber * 3 AS y2, (l_partkey % 997) / 997.0::DOUBLE AS score
  FROM lineitem)"""


def curation_frames(spark: SparkSession, d: str) -> DataFrame:
    """Orders as frames; orders without lineitem are background."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("scene"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("domain"))


def curation_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = line_boxes(table(spark, d, "lineitem"))
    return b.select(F.col("l_orderkey").alias("frame"), "x1", "y1", "x2", "y2", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def _by_customer(spark: SparkSession, d: str) -> DataFrame:
    """frame (a customer) and the columns of its lineitem rows."""
    return table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("frame")), F.col("l_orderkey") == F.col("o_orderkey"))


def _numbered(rows: DataFrame, name: str, boxes=line_boxes) -> DataFrame:
    """rows by LINE_ORDER within their frame, with ``boxes``.

    Only BOX_ORDER is dealt out and sorted: rows equal in it have the same box, so which of them comes first shows in no column. Boxes are made
    after that, so what needs few of a relation's columns shuffles the same rows as what needs all, and Spark does it once.
    """
    few = rows.select("frame", *BOX_ORDER)
    return boxes(few.withColumn(name, F.row_number().over(Window.partitionBy("frame").orderBy(*BOX_ORDER)).cast("long"))).select("frame", name, "x1", "y1", "x2", "y2", "score")


def detections(spark: SparkSession, d: str) -> DataFrame:
    """frame (a customer), det_seq, box, score: lineitem rows with status F."""
    return _numbered(_by_customer(spark, d).filter("l_linestatus = 'F'"), "det_seq")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(_by_customer(spark, d).filter("l_linestatus = 'O'"), "gt_idx").drop("score")


def matching_frames(spark: SparkSession, d: str) -> DataFrame:
    """Customers, and suppliers as injected negatives."""
    injected = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("frame"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("frame")).unionByName(injected)


MATCH_SQL = (
    BOXES_SQL
    + f""",
m AS (SELECT o_custkey AS frame, b.* FROM b JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY {", ".join(LINE_ORDER)}) AS det_seq, x1, y1, x2, y2, score FROM m WHERE l_linestatus = 'F'),
g AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY {", ".join(LINE_ORDER)}) AS gt_idx, x1, y1, x2, y2 FROM m WHERE l_linestatus = 'O'),
o AS (SELECT d.frame, det_seq, gt_idx, greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS inter,
  (d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS areas FROM d JOIN g ON d.frame = g.frame),
i AS (SELECT frame, det_seq, gt_idx, inter / (areas - inter) AS iou FROM o WHERE inter > 0 AND inter / (areas - inter) >= 0.3)"""
)

_GREEDY = """,
r AS (SELECT d.frame, d.det_seq, d.score, coalesce(c.choices, []) AS choices, row_number() OVER (PARTITION BY d.frame ORDER BY d.score DESC, d.det_seq) AS rn
  FROM d LEFT JOIN c ON d.frame = c.frame AND d.det_seq = c.det_seq),
f AS (SELECT frame, 0::BIGINT AS rn, []::BIGINT[] AS used, NULL::BIGINT AS det_seq, NULL::BIGINT AS gt_idx, NULL::DOUBLE AS score FROM (SELECT DISTINCT frame FROM d)
  UNION ALL
  SELECT frame, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, det_seq, pick, score
  FROM (SELECT f.frame, r.rn, f.used, r.det_seq, r.score, list_filter(r.choices, lambda x: NOT list_contains(f.used, x))[1] AS pick FROM f JOIN r ON f.frame = r.frame AND r.rn = f.rn + 1)),
t AS (SELECT frame, det_seq, score, gt_idx FROM f WHERE rn > 0)"""

GREEDY_SQL = "WITH RECURSIVE " + MATCH_SQL + ",\nc AS (SELECT frame, det_seq, list(gt_idx ORDER BY iou DESC, gt_idx DESC) AS choices FROM i GROUP BY frame, det_seq)" + _GREEDY
CENTRE_SQL = (
    "WITH RECURSIVE "
    + MATCH_SQL
    + """,
c AS (SELECT d.frame, det_seq, list(gt_idx ORDER BY gt_idx) AS choices FROM d JOIN g ON d.frame = g.frame
  AND (d.x1 + d.x2) / 2 BETWEEN g.x1 AND g.x2 AND (d.y1 + d.y2) / 2 BETWEEN g.y1 AND g.y2 GROUP BY d.frame, det_seq)"""
    + _GREEDY
)
TOTALS_SQL = "n AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n_img, (SELECT count(*) FROM g) AS total_gt, (SELECT count(DISTINCT frame) FROM g) AS n_pos_frames)"


def images(spark: SparkSession, d: str) -> DataFrame:
    """Documents as images: path doc_id, content hash, source, split (the language), and a stem that many share."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5("text").alias("md5"), "source", F.col("lang").alias("split"), F.concat(F.lit("img_"), F.col("n_chars") % 100).alias("stem"))


IMAGES_SQL = "im AS (SELECT doc_id, md5(text) AS md5, source, lang AS split, 'img_' || (n_chars % 100) AS stem FROM documents)"


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Events: flight, ts, kind (image, altitude, gsd, dropped, other), value (m, or m/px), camera number, event_id."""
    kind = F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "click", "altitude").when(F.col("event_type") == "signup", "gsd").when(F.col("event_type") == "error", "dropped").otherwise("other")
    value = F.when(F.col("event_type") == "signup", F.col("value") / F.lit(10000.0)).otherwise(F.col("value") + 30.0)
    return table(spark, d, "events").select(F.col("user_id").alias("flight"), "ts", kind.alias("kind"), value.alias("value"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("camera"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id")


TELEMETRY_SQL = """e AS (SELECT user_id AS flight, ts, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'altitude' WHEN 'signup' THEN 'gsd' WHEN 'error' THEN 'dropped' ELSE 'other' END AS kind,
  CASE WHEN event_type = 'signup' THEN value / 10000.0::DOUBLE ELSE value + 30.0::DOUBLE END AS value, (json_extract_string(props, '$.k'))::INT % 4 AS camera, (json_extract_string(props, '$.k'))::INT AS k, event_id FROM events)"""
