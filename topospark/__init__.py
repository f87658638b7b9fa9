"""Spark-native analysis of the shape of point clouds."""

__version__ = "0.1.0"
