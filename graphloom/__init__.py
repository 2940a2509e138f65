"""graphloom: dependency-graph analytics on Spark DataFrames."""

from graphloom.model import DependencyGraph
from graphloom.options import AnalyzeOptions

__all__ = ["AnalyzeOptions", "DependencyGraph"]
