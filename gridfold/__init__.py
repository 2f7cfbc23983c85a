"""Grouped reductions and scans over array-shaped and tabular data, planned by Catalyst."""

from gridfold.functions.aggregates import REDUCTIONS, Reduction, is_supported
from gridfold.functions.udaf import GroupAgg, GroupScan, HolisticAgg, PandasScan
from gridfold.operators.dataset import Dataset
from gridfold.operators.large import group_mode, group_quantile
from gridfold.operators.reduce import group_reduce
from gridfold.operators.scans import group_scan
from gridfold.operators.sparse import sparse_reduce
from gridfold.options import OPTIONS, set_options
from gridfold.plans.keys import Bins, Codes, DatePart, Labels, Resample, RowBins, Tuples, overlapping, with_labels
from gridfold.sources.arrays import reduce_elementwise, to_array, to_long

__all__ = [
    "OPTIONS", "REDUCTIONS", "Bins", "Codes", "Dataset", "DatePart", "GroupAgg", "GroupScan", "HolisticAgg", "Labels", "PandasScan", "Reduction", "Resample", "RowBins", "Tuples",
    "group_mode", "group_quantile", "group_reduce", "group_scan", "is_supported", "overlapping", "reduce_elementwise", "set_options", "sparse_reduce", "to_array", "to_long", "with_labels",
]
