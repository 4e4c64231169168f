"""Readers of annotation files, manifests and logs; each gives a DataFrame of a schema in ``transect.schema``."""
