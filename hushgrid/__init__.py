"""Spark-native detection of hard-coded credentials, with operators for training-data pipelines."""

from __future__ import annotations

from .shipping import ship

__all__ = ["ship"]
