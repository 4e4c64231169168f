"""Telemetry streams: frames meet the latest altitude and ground sample distance."""
