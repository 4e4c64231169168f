"""Operators over frames, boxes and detections: each takes DataFrames and returns one."""
