"""Labelled data: several variables over named dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.operators.reduce import group_reduce
from gridfold.plans.keys import Bins, Key, RowBins, as_key


class Dataset:
    """Variables of one table: ``dims`` are the columns that say where a row is, ``variables`` those that hold values.

    ``lacking`` names tables of variables that lack some of the dimensions, by their own.
    """

    def __init__(self, frame: DataFrame, dims: Sequence[str], variables: Sequence[str] | None = None, lacking: dict[str, tuple[DataFrame, Sequence[str]]] | None = None):
        self.frame, self.dims = frame, list(dims)
        self.variables = list(variables) if variables is not None else [c for c in frame.columns if c not in self.dims]
        self.lacking = lacking or {}

    def align(self, labels: DataFrame, on: Sequence[str]) -> Dataset:
        """This dataset with the columns of ``labels``, which must match its places in ``on`` exactly, one to one in each
        direction; else ValueError."""
        ours, theirs = self.frame.select(*on).distinct(), labels.select(*on)
        if theirs.groupBy(*on).count().filter("count > 1").limit(1).count():
            raise ValueError("labels repeat a place")
        if ours.join(theirs, list(on), "left_anti").limit(1).count() or theirs.join(ours, list(on), "left_anti").limit(1).count():
            raise ValueError("labels and data are not aligned")
        return Dataset(self.frame.join(labels, list(on)), self.dims, self.variables, self.lacking)

    def reduce(self, *keys: str | Key, func: Any, dim: str | Sequence[str] | None | type(...) = None, skipna: bool | None = None, **options: Any) -> DataFrame:
        """Each variable reduced over ``dim`` in each group, all in one pass; other dimensions are kept. ``dim`` None reduces all;
        with ``...`` so does it, but for the dimension that the one key is itself, unless that is binned.

        Without keys it is a plain reduction over ``dim``. Variables that lack the reduced dimension stay as they are,
        repeated for every group, in columns of their own name.
        """
        ks = [as_key(k) for k in keys]
        if dim is ... and len(ks) > 1:
            raise NotImplementedError("several keys need the dimensions by name")
        own_dim = {k.column for k in ks if dim is ... and not isinstance(k, Bins | RowBins)}
        gone = [d for d in self.dims if d not in own_dim] if dim is None or dim is ... else [dim] if isinstance(dim, str) else list(dim)
        if unknown := set(gone) - set(self.dims):
            raise ValueError(f"no such dimensions: {sorted(unknown)}")
        kept = [d for d in self.dims if d not in gone and d not in own_dim]
        whole = group_reduce(self.frame, self.variables, *ks, func=func, keep_dims=kept, skipna=skipna, **options)
        for name, (table, own) in self.lacking.items():
            shared = [d for d in own if d in kept or d in own_dim]
            if set(own) & set(gone):
                raise ValueError(f"{name} has a reduced dimension: put it into the table")
            whole = whole.join(table.select(*shared, name), shared, "left") if shared else whole.withColumn("_one", F.lit(1)).join(table.select(name).withColumn("_one", F.lit(1)), "_one").drop("_one")
        return whole
