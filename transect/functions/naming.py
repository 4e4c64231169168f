"""Keys that file names and paths carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def augmentation_base(stem: Column) -> Column:
    """What comes before the first '.rf.'."""
    return F.split(stem, "\\.rf\\.", 2)[0]


def group_key(stem: Column, pattern: str, groups: int = 1, sep: str = "_") -> Column:
    """The pattern's groups, joined; raises where the pattern doesn't match."""
    found = F.concat_ws(sep, *[F.regexp_extract(stem, pattern, k) for k in range(1, groups + 1)])
    return F.when(stem.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit(f"no group {pattern} in "), stem)))


def season(stem: Column) -> Column:
    """The first token that starts with TO, else NA."""
    return F.coalesce(F.get(F.filter(F.split(stem, "_"), lambda t: t.startswith("TO")), F.lit(0)), F.lit("NA"))


def tile_origin(name: Column) -> Column:
    """struct(x, y) of '..._x12_y34...'; null without."""
    pattern = "_x(\\d+)_y(\\d+)"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).cast("int").alias("x"), F.regexp_extract(name, pattern, 2).cast("int").alias("y")))


def local_path(url: Column, key: str = "d") -> Column:
    """A query parameter, decoded; null without."""
    return F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))


def cache_key(model: Column, tile: Column, overlap: Column, imgsz: Column, conf: Column, n: Column) -> Column:
    return F.format_string("%s_t%d_o%.2f_i%d_c%.3f_n%d", model, tile, overlap, imgsz, conf, n)


def xmp_altitude(content: Column) -> Column:
    """Of a file's first 512 KiB: the first number in the 40 characters after the first known key that has one, without sign."""
    head = F.decode(F.substring(content, 1, 524288), "ISO-8859-1")
    # fixed values: the keys, in the order in which they count
    keys = ("drone-dji:RelativeAltitude", "RelativeAltitude", "GPSAltitude")
    after = [F.regexp_extract(head, f"(?s){key}(.{{0,40}})", 1) for key in keys]
    return F.coalesce(*[F.abs(F.nullif(F.regexp_extract(a, "([-+]?[0-9]+\\.?[0-9]*)", 1), F.lit("")).cast("double")) for a in after])
