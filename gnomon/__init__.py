"""Metrics over related tables, planned on the driver and run by Spark."""

from gnomon.engine import Engine, Query, Rollup
from gnomon.model import (
    Avg, BoolDim, Calculated, Computed, Count, CountDistinct, Derived, Dim, EnumDim, Max, Measure, Min, PrimaryKey, Relation, StringDim, Sum, Table, TimeDim,
)

__all__ = [
    "Avg", "BoolDim", "Calculated", "Computed", "Count", "CountDistinct", "Derived", "Dim", "Engine", "EnumDim", "Max", "Measure", "Min", "PrimaryKey", "Query",
    "Relation", "Rollup", "StringDim", "Sum", "Table", "TimeDim",
]
