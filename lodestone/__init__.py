"""Lodestone: level-of-detail tiling of very large point and splat scenes on Spark."""

__version__ = "0.1.0"
