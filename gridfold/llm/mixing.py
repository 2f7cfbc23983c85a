"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are dealt into blocks of ``block_rows``. With weight w, block j of a source (from 0) is released at
slot floor(j / w) and due by slot ceil((j + 1) / w); earliest deadline first fills every slot with one released block, so at
any slot each source is less than one block away from its share. The weights are the targets themselves, not rounded to a
period. When a source has no blocks left, the others share its weight in proportion; the ideal that blocks are released
and due by is piecewise linear over the whole run, so nothing begins anew and no deviation adds up. Slots are made in windows:
the driver holds counts by source and the blocks of one window. No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import materialise, shared_dir
from gridfold.llm.ranking import rank_within, unpacked

BLOCK_ROWS = 32
#: Blocks of a source whose slots are one row of the plan.
STRETCH = 1024
#: Slots that are made at once. Plans of one window are broadcast if they have few rows; longer ones, or of very many sources,
#: are joined by a shuffle.
WINDOW, BROADCAST_ROWS = 1 << 20, 20_000
#: Times so near to a whole slot are that slot: the ideal is computed in floating point.
NEAR = 1e-6

Weights = Callable[[dict], dict]


def by_temperature(power: float) -> Weights:
    """Weights in proportion to a power of the sources' rows: 1 keeps their shares, 0 makes all alike."""
    return lambda rows: {s: n**power for s, n in rows.items()}


class Fluid:
    """All sources flowing at once at their weights; those that are used up leave their weight to the others.

    With v the slots for each unit of weight, a source has had min(weight * v, blocks) of its blocks.
    """

    def __init__(self, blocks: np.ndarray, weights: np.ndarray):
        self.blocks, self.weights = blocks.astype(float), weights
        order = np.argsort(self.blocks / weights, kind="stable")
        self.ends = (self.blocks / weights)[order]
        self.gone = np.concatenate([[0], np.cumsum(self.blocks[order])])
        self.flowing = np.concatenate([np.cumsum(weights[order][::-1])[::-1], [0]])

    def when(self, had: np.ndarray, source: np.ndarray) -> np.ndarray:
        """The time at which these sources have had so many blocks."""
        v = had / self.weights[source]
        at = np.searchsorted(self.ends, v, side="left")
        return self.gone[at] + self.flowing[at] * v

    def had(self, time: int) -> np.ndarray:
        """What each source has had by then."""
        at = int(np.searchsorted(self.gone[:-1] + self.flowing[:-1] * self.ends, time, side="left"))
        v = (time - self.gone[at]) / self.flowing[at] if at < len(self.ends) else self.ends[-1]
        return np.minimum(self.weights * v, self.blocks)


def earliest_deadline_first(blocks: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each window of slots, the source and the number of the block in every slot, and the slots."""
    fluid, begins, total = Fluid(blocks, weights), np.cumsum(blocks) - blocks, int(blocks.sum())
    known = np.zeros(len(blocks), np.int64)  # blocks of each source that have been told when they are released
    release, due, number = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of those not yet released
    ready: list[int] = []
    for begin in range(0, total, window):
        end = min(begin + window, total)
        until = np.minimum(blocks, np.floor(fluid.had(end)).astype(np.int64) + 2)
        counts = np.maximum(until - known, 0)
        source = np.repeat(np.arange(len(blocks)), counts)
        j = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + known[source]
        known = known + counts
        release = np.concatenate([release, np.floor(fluid.when(j, source) + NEAR).astype(np.int64)])
        due = np.concatenate([due, np.ceil(fluid.when(j + 1, source) - NEAR).astype(np.int64)])
        number = np.concatenate([number, begins[source] + j])
        order = np.lexsort((number, release))
        release, due, number = release[order], due[order], number[order]
        # Equal deadlines go by source: the blocks are numbered by source, so that deadline and number are one integer.
        key = [d * total + b for d, b in zip(due.tolist(), number.tolist(), strict=True)]
        upto = np.searchsorted(release, np.arange(begin, end), side="right").tolist()
        begun, chosen = 0, []
        for until_here in upto:
            while begun < until_here or not ready:
                heapq.heappush(ready, key[begun])
                begun += 1
            chosen.append(heapq.heappop(ready) % total)
        release, due, number = release[begun:], due[begun:], number[begun:]
        block = np.array(chosen, np.int64)
        source = np.searchsorted(begins, block, side="right") - 1
        yield source, block - begins[source], np.arange(begin, end)


def plan(blocks: dict, weights: dict, window: int = WINDOW) -> Iterator[list[tuple]]:
    """For each window of slots: (source, stretch, first and last block, their slots) for the blocks of every stretch of ``STRETCH``
    blocks of a source. Sources without blocks have no rows."""
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (s is None, s))
    if not names:
        return
    counts, targets = np.array([blocks[s] for s in names], np.int64), np.array([float(weights[s]) for s in names])
    for source, block, slot in earliest_deadline_first(counts, targets, window):
        order = np.lexsort((block, source))
        source, block, slot = source[order], block[order], slot[order]
        new = np.ones(len(block), bool)
        new[1:] = (source[1:] != source[:-1]) | (block[1:] // STRETCH != block[:-1] // STRETCH)
        cuts = [*np.flatnonzero(new).tolist(), len(block)]
        yield [(names[source[a]], int(block[a]) // STRETCH, int(block[a]), int(block[b - 1]), slot[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]


def _plan_table(spark: SparkSession, windows: Iterator[list[tuple]], kind: str) -> DataFrame:
    """The plan as a table: that of several windows is written to the shared folder, window by window."""
    schema = f"of {kind}, stretch long, first long, last long, slots array<long>"
    rows, path = next(windows, []), None
    for more in windows:
        if path is None:
            path = f"{shared_dir(spark).rstrip('/')}/gridfold/plan-{uuid.uuid4().hex}"
            spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        spark.createDataFrame(more, schema).write.mode("append").parquet(path)
    if path:
        return spark.read.schema(schema).parquet(path)
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table  # at most WINDOW numbers


def schedule(docs: DataFrame, weights: dict | Weights, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """``docs`` with ``block`` (of its source), ``slot`` and ``in_block``: the mixed order is by slot, then in_block.

    Columns of ``docs`` of these three names are replaced. ``weights`` are the targets by source, or a function that makes them
    from the sources' row counts. Within a source, rows come in an order hashed from id and ``seed``. A null source is a source of
    its own; a null id is as good as any; repeated rows and rows with equal ids each get a place. A source without a positive
    weight raises ValueError. Any number of sources is scheduled. An empty table gives none.
    """
    order = [F.col(f"`{source_col}`"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), F.col(f"`{id_col}`")]
    ranked, counts = rank_within(docs.repartitionByRange(*order).sortWithinPartitions(*order), source_col, "mixing")
    found = counts.toArrow()
    rows = dict(zip(found["key"].to_pylist(), found["n"].to_pylist(), strict=True))
    target = weights(rows) if callable(weights) else weights
    if missing := [s for s in rows if not target.get(s, 0) > 0]:
        raise ValueError(f"no positive weight for {missing}")
    kind = docs.schema[source_col].dataType.simpleString()
    table = _plan_table(docs.sparkSession, plan({s: -(-n // block_rows) for s, n in rows.items()}, target, WINDOW), kind)
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block_rows))
    placed = placed.join(table, F.col("key").eqNullSafe(F.col("of")) & (F.floor(F.col("block") / STRETCH) == F.col("stretch")) & F.col("block").between(F.col("first"), F.col("last")))
    slot = F.get("slots", (F.col("block") - F.col("first")).cast("int"))
    return placed.select(*unpacked(docs.columns, ("block", "slot", "in_block")), "block", slot.alias("slot"), (F.col("rank") % block_rows).alias("in_block"))


def mix(docs: DataFrame, weights: dict | Weights, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all of them and with their columns, laid out in the mixed order; nulls and repeated rows as in
    :func:`schedule`.

    The rows are written once with a number; only number, id and source are ranked, and the rows get their places by number.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = materialise(docs.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("nth")), "mixing-rows")
    field = F.col("row").getField
    places = schedule(rows.select(F.col("nth").alias("of_nth"), field(id_col).alias("id"), field(source_col).alias("source")), weights, "source", "id", **options)
    mixed = rows.join(places.select("of_nth", "slot", "in_block"), F.col("nth") == F.col("of_nth")).repartitionByRange("slot", "in_block").sortWithinPartitions("slot", "in_block")
    return mixed.select(*unpacked(docs.columns))
