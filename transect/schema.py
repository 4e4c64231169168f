"""Schemas of the relations that operators take and give, by the inventory's number."""

from __future__ import annotations

NORMALIZED = "source string, domain string, orig_split string, scene string, image string, n_boxes int"  # D8
SPLITS = "source string, stem string, split string, role string, group string, boxes int, kept int"  # D9
ALTITUDE_MANIFEST = "frame string, altitude_m double, gsd_cm_px double, n_animals int, min_px double, max_px double, len_min_m double, len_max_m double, len_median_m double"  # D16
CAMERA = "name string, pixel_pitch_um double, default_focal_mm double, sensor_w_mm double, sensor_h_mm double"  # D18
SOURCE_REGISTRY = "name string, ordinal int, domain string, format string, path string, splits map<string,string>"  # D20
SPLIT_CONFIG = "source string, label_dir string, strategy string, stride int, role string"  # D21
# D5: one region of a shape annotation
REGION = "struct<shape_attributes: struct<name: string, all_points_x: array<double>, all_points_y: array<double>, x: double, y: double, width: double, height: double, cx: double, cy: double, r: double, rx: double, ry: double>, region_attributes: map<string,string>>"
# D23, D24: annotation tasks, in percent of the image from the top left
RESULT = "array<struct<type: string, value: struct<x: double, y: double, width: double, height: double, rectanglelabels: array<string>>>>"
TASK = f"struct<data: struct<image: string>, annotations: array<struct<was_cancelled: boolean, result: {RESULT}>>>"
COCO_RECORD = "image_id string, file_name string, width int, height int, annotations array<struct<bbox: array<double>, bbox_mode: int, category_id: int>>"
