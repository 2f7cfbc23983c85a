"""Options of the engine."""

from __future__ import annotations

from contextlib import AbstractContextManager
from dataclasses import dataclass, fields


@dataclass
class Options:
    #: Dense results have at most so many cells; beyond, they are refused.
    max_dense_cells: int = 10_000_000
    #: Discovered labels of a key that reach the driver to make a dense domain.
    max_domain: int = 100_000
    #: Domains up to so many labels are broadcast.
    broadcast_domain: int = 50_000


OPTIONS = Options()


class set_options(AbstractContextManager):  # noqa: N801
    """Set options from now on, or inside a ``with`` block."""

    def __init__(self, **values: float):
        if unknown := set(values) - {f.name for f in fields(Options)}:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        self.before = {k: getattr(OPTIONS, k) for k in values}
        for k, v in values.items():
            setattr(OPTIONS, k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            setattr(OPTIONS, k, v)
