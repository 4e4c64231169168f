"""Boxes that meet within a frame, where a frame may hold any number of them.

Most frames have few boxes, and a join on the frame is all they need. Frames with more than ``HOT_BOXES`` boxes on a side are dealt to cells:
a box belongs to a size class, whose cells are squares at least as long as its longer side, so it covers four of them at most; it
is also dealt to the cells of the larger classes that the frame has, to meet their boxes there. A pair is reported once, in the cell of the
larger one's class that holds the upper left corner of what they share. So no task has a whole hot frame, and boxes that lie far apart
never meet. Boxes without extent overlap nothing; null coordinates meet nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from transect.functions import geometry as g
from transect.session import prepare

HOT_BOXES = 2000
MAX_BROADCAST_FRAMES = 1_000_000
_D, _G = ("x1", "y1", "x2", "y2"), ("gx1", "gy1", "gx2", "gy2")


def hot_frames(*sides: DataFrame, most: int = HOT_BOXES, by: str = "frame") -> DataFrame | None:
    """(hot), the frames that have more than ``most`` rows on a side; None if there are none."""
    prepare(sides[0].sparkSession)
    found = None
    for side in sides:
        own = side.groupBy(F.col(by).alias("hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("hot")
        found = own if found is None else found.unionByName(own)
    return listed(found.distinct().checkpoint())


def listed(hot: DataFrame) -> DataFrame | None:
    """hot, to be broadcast if it is small; None if it is empty."""
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= MAX_BROADCAST_FRAMES else hot


def divided(rows: DataFrame, hot: DataFrame, by: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Rows of other frames, and of hot ones."""
    same = F.col(by) == F.col("hot")
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out by frame (or ``by``) to as many partitions as Spark is told to have: it would join small ones, but folds cost far
    more than their bytes say. It leaves rows that it has dealt out so already, joined partitions too, so those need it before they are numbered."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(by or ["frame"]))


def in_rows(rows: DataFrame, *by: str, alone: bool = True) -> GroupedData:
    """rows by frame (or ``by``), to fold each group in one row; with ``alone``, rows without a frame stay so."""
    by = list(by or ["frame"])
    return numbered_alone(dealt(rows, *by)).groupBy(*by, "_alone") if alone else dealt(rows, *by).groupBy(*by)


def numbered_alone(rows: DataFrame) -> DataFrame:
    """rows with ``_alone``: a number for each that has no frame."""
    return rows.withColumn("_alone", F.when(F.col("frame").isNull(), F.monotonically_increasing_id()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body has it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _class(x1: str, y1: str, x2: str, y2: str) -> Column:
    longer = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1))
    return F.when(longer > 0, F.least(F.greatest(F.ceil(F.log2(longer)), F.lit(-30)), F.lit(40)).cast("int"))


def _dealt(rows: DataFrame, classes: Column, box: tuple[str, ...], prefix: str) -> DataFrame:
    """rows in each cell of each of the classes that they touch."""
    size = F.pow(F.lit(2.0), F.col("_level"))
    out = rows.withColumn("_level", F.explode(classes))
    for low, high, name in ((box[0], box[2], "cx"), (box[1], box[3], "cy")):
        out = out.withColumn(f"{prefix}{name}", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    return out.withColumnRenamed("_level", f"{prefix}level")


def _levels(rows: DataFrame, frame: str) -> DataFrame:
    return rows.groupBy(F.col(frame).alias("_of")).agg(F.collect_set("_class").alias("_classes"))  # 71 at most


def overlapping(a: DataFrame, b: DataFrame, frame: str = "frame", gframe: str = "gframe") -> DataFrame:
    """Rows of a beside those of b (its frame and box under g-names) that overlap them strictly, by cells."""
    a, b = a.withColumn("_class", _class(*_D)).filter("_class IS NOT NULL"), b.withColumn("_class", _class(*_G)).filter("_class IS NOT NULL")
    own = F.array(F.col("_class"))
    larger = lambda: F.concat(own, F.filter(F.coalesce("_classes", F.expr("cast(array() AS array<int>)")), lambda c: c > F.col("_class")))
    mine = _dealt(a.join(_levels(b, gframe), F.col(frame) == F.col("_of"), "left").withColumn("_all", larger()).drop("_of", "_classes"), F.col("_all"), _D, "_a").withColumnRenamed("_class", "_ac").drop("_all")
    other = _dealt(b.join(_levels(a, frame), F.col(gframe) == F.col("_of"), "left").withColumn("_all", larger()).drop("_of", "_classes"), F.col("_all"), _G, "_b").withColumnRenamed("_class", "_bc").drop("_all")
    size = F.pow(F.lit(2.0), F.col("_alevel"))
    same = (F.col(frame) == F.col(gframe)) & (F.col("_alevel") == F.col("_blevel")) & (F.col("_acx") == F.col("_bcx")) & (F.col("_acy") == F.col("_bcy"))
    corner = (F.floor(F.greatest("x1", "gx1") / size) == F.col("_acx")) & (F.floor(F.greatest("y1", "gy1") / size) == F.col("_acy"))
    met = mine.join(other, same & (F.greatest("_ac", "_bc") == F.col("_alevel")) & g.overlaps(*_D, *_G) & corner)
    return met.drop("_ac", "_bc", "_alevel", "_acx", "_acy", "_blevel", "_bcx", "_bcy")


def centred_in(a: DataFrame, b: DataFrame, frame: str = "frame", gframe: str = "gframe") -> DataFrame:
    """Rows of a beside those of b that their centre lies in, edges included, by cells of b's classes."""
    b = b.withColumn("_class", F.coalesce(_class(*_G), F.lit(-30)))
    at = a.join(_levels(b, gframe), F.col(frame) == F.col("_of")).withColumn("_x", (F.col("x1") + F.col("x2")) / 2).withColumn("_y", (F.col("y1") + F.col("y2")) / 2)
    mine = _dealt(at.drop("_of"), F.col("_classes"), ("_x", "_y", "_x", "_y"), "_a").drop("_classes", "_x", "_y")
    other = _dealt(b, F.array("_class"), _G, "_b").drop("_class")
    same = (F.col(frame) == F.col(gframe)) & (F.col("_alevel") == F.col("_blevel")) & (F.col("_acx") == F.col("_bcx")) & (F.col("_acy") == F.col("_bcy"))
    return mine.join(other, same & g.centre_inside(*_D, *_G)).drop("_alevel", "_acx", "_acy", "_blevel", "_bcx", "_bcy")


def joined(a: DataFrame, b: DataFrame, centre: bool = False, most: int = HOT_BOXES) -> DataFrame:
    """Rows of a beside those of b in the same frame that they overlap, or that their centre lies in: by the frame, or by cells where it is hot."""
    met = g.centre_inside(*_D, *_G) if centre else g.overlaps(*_D, *_G)
    plain = lambda p, q: p.join(q, (F.col("frame") == F.col("gframe")) & met)
    hot = hot_frames(a, b.withColumnRenamed("gframe", "frame"), most=most)
    if hot is None:
        return plain(a, b)
    (a_few, a_many), (b_few, b_many) = divided(a, hot), divided(b, hot, "gframe")
    return plain(a_few, b_few).unionByName((centred_in if centre else overlapping)(a_many, b_many))


def separate(rows: DataFrame, by: str = "frame") -> DataFrame:
    """rows (frame, box, ...) with ``part``: rows of a frame whose boxes overlap are in one part, and so are parts whose hulls do, until none do.

    In each round a part joins the neighbour of least hashed number, where that is less than its own, so their number shrinks by a
    share of those that have neighbours, however long a chain of them is.
    """
    prepare(rows.sparkSession)
    numbered = rows.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    hulls, members, turn = numbered.select(F.col(by).alias("frame"), F.col("_id").alias("part"), *_D), numbered.select("_id", F.col("_id").alias("part")), 0
    while True:
        other = hulls.select(F.col("frame").alias("gframe"), F.col("part").alias("gpart"), *[F.col(c).alias(f"g{c}") for c in _D])
        met = overlapping(hulls, other).filter("part <> gpart")
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("to"))
        moves = met.groupBy("part").agg(F.min(key("gpart")).alias("least")).filter(F.col("least") < key("part")).select(F.col("part").alias("was"), "least.to").checkpoint()
        if moves.isEmpty():
            return numbered.join(members.withColumnRenamed("_id", "_of"), F.col("_id") == F.col("_of")).drop("_id", "_of")
        renamed = lambda x: x.join(moves, F.col("part") == F.col("was"), "left").withColumn("part", F.coalesce("to", "part")).drop("was", "to")
        members = renamed(members).checkpoint()
        ends = [F.min(c).alias(c) for c in _D[:2]] + [F.max(c).alias(c) for c in _D[2:]]
        hulls, turn = renamed(hulls).groupBy("frame", "part").agg(*ends).checkpoint(), turn + 1
