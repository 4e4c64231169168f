"""Writers: label text, manifests, JSON tasks, dataset descriptors, stream reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_texts(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(stem, label): one text for each frame, with a line of class 0 and four shares to six places for each box, by seq; empty for a confirmed negative."""
    line = F.format_string("0 %.6f %.6f %.6f %.6f", "cx", "cy", "w", "h")
    texts = boxes.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x.line), "\n").alias("label"))
    return frames.select("stem").join(texts, "stem", "left").fillna("", "label")


def write_manifest(rows: DataFrame, folder: str, csv: bool = False) -> None:
    """Parquet, or CSV with a header for other tools."""
    if csv:
        rows.write.mode("overwrite").option("header", "true").csv(folder)
    else:
        rows.write.mode("overwrite").parquet(folder)


def write_json(rows: DataFrame, folder: str, json: str = "json") -> None:
    rows.select(json).write.mode("overwrite").text(folder)


def dataset_descriptor(root: str, names: Sequence[str] = ("animal",)) -> str:
    """The text that a training library reads to find a dataset."""
    lines = [f"path: {root}", "train: images/train", "val: images/val", "test: images/test", f"nc: {len(names)}", "names:", *[f"  {k}: {n}" for k, n in enumerate(names)]]
    return "\n".join(lines) + "\n"


def frame_json(frames: DataFrame) -> DataFrame:
    """(frame, json) of rows (frame, decision, detections): the decision, the detections and their summary."""
    scores = F.transform("detections", lambda d: d.score)
    n = F.size("detections")
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.greatest(n, F.lit(1))
    summary = F.struct(n.alias("n"), F.coalesce(F.array_min(scores), F.lit(0.0)).alias("min"), mean.alias("mean"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("max"))
    return frames.select("frame", F.to_json(F.struct("frame", "decision", "detections", summary.alias("scores"))).alias("json"))


def append_report(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a stream that appends report rows as CSV; gives its query."""
    return stream.writeStream.format("csv").option("header", "true").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
