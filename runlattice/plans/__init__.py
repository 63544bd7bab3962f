"""Queries over the shared test tables, one per operator."""

from runlattice.plans import catalog, coverage, grids, learning, modelling, storage  # noqa: F401
from runlattice.plans.base import ORACLES, QUERIES
from runlattice.plans.modelling import training_rows

__all__ = ["ORACLES", "QUERIES", "training_rows"]
