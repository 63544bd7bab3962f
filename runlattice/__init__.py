"""Spark-native analytics over large collections of experiments."""

from runlattice.schema import Axis, Feature, Param
from runlattice.session import build_session, checkpointed

__all__ = ["Axis", "Feature", "Param", "build_session", "checkpointed"]
