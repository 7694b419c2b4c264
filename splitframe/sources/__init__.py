"""Readers and writers."""

from .matrices import scan_dense_matrix, scan_lines, scan_npy, spread_columns
from .party import gen_party_tables, scan_aligned_pair, scan_party_csv, scan_party_parquet
from .stores import (
    load_linear,
    load_trees,
    save_linear,
    save_trees,
    scan_bins,
    scan_edges,
    scan_shares,
    sink_bins,
    sink_edges,
    sink_shares,
)

__all__ = [n for n in dir() if not n.startswith("_")]
