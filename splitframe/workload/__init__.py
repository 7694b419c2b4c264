"""Registered queries over the test tables and their SQL counterparts."""

from . import q_align, q_bins, q_linear, q_matrix, q_prep, q_scalar, q_shares, q_sources, q_trees  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
