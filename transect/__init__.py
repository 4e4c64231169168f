"""Spark-native curation and evaluation of box-annotated survey imagery."""
