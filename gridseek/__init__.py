"""Search over collections of gridded point datasets, as DataFrame plans."""

from gridseek.functions.grid import Grid
from gridseek.operators.connect import connected
from gridseek.operators.coverage import top_k_coverage
from gridseek.operators.graph import overlap_graph
from gridseek.operators.overlap import STRATEGIES, top_k_overlap
from gridseek.operators.profile import profiles, source_profiles
from gridseek.sources.points import cells_of, read_csv_points, valid_points

__all__ = ["STRATEGIES", "Grid", "cells_of", "connected", "overlap_graph", "profiles", "read_csv_points", "source_profiles", "top_k_coverage", "top_k_overlap", "valid_points"]
