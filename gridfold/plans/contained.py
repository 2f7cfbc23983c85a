"""Sets of chunks that lie mostly within others, counted in grid cells without a row for each pair that shares something."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StructField, StructType

from gridfold.plans.stable import stable

#: Entries (a label in a chunk) that a block is made of: a 32nd of all, but no fewer and no more than these.
LEAST, MOST = 1 << 20, 1 << 23
#: Entries that a cell asks about at least, where blocks are split for the sake of parallel work.
ASKED = 1 << 14
#: Pairs in a batch that goes out.
BATCH = 1 << 16


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` (distinct, not null) with ``_id``, their place in order; counted in ranges, not in one task."""
    ranged = stable(chunks.repartitionByRange("chunk").withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each partition
    held = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy("chunk"))
    return ranged.withColumn("_in", place).join(held, "_part").select("chunk", (F.col("_before") + F.col("_in")).alias("_id"))


def laid_out(parts: list, cores: int) -> tuple[list[tuple], list[tuple]]:
    """Where the labels of each partition are indexed (part, its first block, over how many) and what each block is (block, lowest and highest
    chunk, chunks of its largest label, first cell, number of cells). Small partitions that follow each other share a block."""
    total = sum(p["entries"] for p in parts)
    size = min(MOST, max(LEAST, total // 32))
    places, blocks, room = [], [], 0
    for p in parts:
        if p["entries"] > size:
            over = -(-p["entries"] // size)
            places.append((p["part"], len(blocks), over))
            blocks += [[p["lo"], p["hi"], p["largest"]] for _ in range(over)]
            room = 0
            continue
        if p["entries"] > room:
            blocks.append([p["lo"], p["hi"], 0])
            room = size
        b = blocks[-1]
        b[:] = min(b[0], p["lo"]), max(b[1], p["hi"]), max(b[2], p["largest"])
        places.append((p["part"], len(blocks) - 1, 1))
        room -= p["entries"]
    cells, found = 0, []
    for k, (lo, hi, largest) in enumerate(blocks):
        asked = sum(p["entries"] for p in parts if p["lo"] <= hi and p["hi"] >= lo)
        split = max(-(-asked // (8 * size)), min(-(-2 * cores // len(blocks)), -(-asked // ASKED)))
        found.append((k, lo, hi, largest, cells, split))
        cells += split
    return places, found


def contained(df: DataFrame, label: str, chunk: str, least: float) -> DataFrame:
    """Pairs of labels of which at least the share ``least`` of the chunks of the first are chunks of the second, one at least. A label's
    chunks are one row. Labels are put into blocks, those of like ranges of chunks together; a block is indexed by chunk, and is asked by
    the labels that have enough chunks in its range. What is moved is the labels' chunks, once for each block they ask, never the pairs."""
    spark = df.sparkSession
    pairs = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(chunk).alias("chunk")).distinct()
    if isinstance(pairs.schema["chunk"].dataType, IntegralType):
        ids = pairs.select("label", F.col("chunk").cast("long").alias("_id"))
    else:
        ids = pairs.join(numbered(pairs.select("chunk").filter("chunk IS NOT NULL").distinct()), "chunk", "left").select("label", "_id")
    # A null chunk is one of a label's chunks, but no label shares it.
    sets = ids.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_id")).alias("chunks")).filter(F.size("chunks") > 0)
    sets = sets.withColumns({"lo": F.element_at("chunks", 1), "hi": F.element_at("chunks", -1)})
    span = F.floor(F.log2(F.col("hi").cast("double") - F.col("lo").cast("double") + 1))
    n_parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = sets.repartitionByRange(n_parts, span, "lo", F.xxhash64("label")).withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()})
    ranged = stable(ranged.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") * (least * (1 - 1e-9))))))  # not more than what the share asks for

    kind = pairs.schema["label"].dataType
    schema = StructType([StructField("label", kind), StructField("within", kind), StructField("containment", DoubleType())])
    sizes = ranged.groupBy("part").agg(F.sum(F.size("chunks")).alias("entries"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.size("chunks")).alias("largest"))
    parts = sorted(sizes.collect(), key=lambda r: r["part"])
    if not parts:
        return spark.createDataFrame([], schema)
    places, blocks = laid_out(parts, spark.sparkContext.defaultParallelism)
    place = F.broadcast(spark.createDataFrame(places, "part int, first long, over long"))
    block = F.broadcast(spark.createDataFrame(blocks, "block long, b_lo long, b_hi long, largest long, cell long, split long"))

    row = ["id", "label", "n", "need", "chunks"]
    own = ranged.join(place, "part").withColumn("block", F.col("first") + F.pmod(F.col("id"), F.col("over"))).join(block, "block")
    index = own.select(F.explode(F.sequence(F.col("cell"), F.col("cell") + F.col("split") - 1)).alias("cell"), F.lit(False).alias("asks"), *row)
    inside = F.size(F.filter("chunks", lambda c: c.between(F.col("b_lo"), F.col("b_hi"))))
    enough = (F.col("lo") >= F.col("b_lo")) & (F.col("hi") <= F.col("b_hi")) | (inside >= F.col("need"))
    asked = ranged.filter(F.size("chunks") >= F.col("need")).join(block, (F.col("lo") <= F.col("b_hi")) & (F.col("hi") >= F.col("b_lo")) & (F.col("largest") >= F.col("need")) & enough)
    asked = asked.select((F.col("cell") + F.pmod(F.col("id"), F.col("split"))).alias("cell"), F.lit(True).alias("asks"), *row)
    n_cells = blocks[-1][-2] + blocks[-1][-1]
    met = index.unionByName(asked).repartitionById(n_cells, F.col("cell").cast("int")).sortWithinPartitions("cell", "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, found = None, [], None
        for batch in batches:
            cell, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "asks"))
            cuts = [0, *(np.flatnonzero(np.diff(2 * cell + asks)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if not asks[a]:
                    if cell[a] != at:
                        at, rows, found = cell[a], [], None
                    rows.append(batch.slice(a, b - a))
                elif cell[a] == at:
                    if found is None:
                        found, rows = Index(rows), []
                    yield from found.ask(batch.slice(a, b - a), least)

    return met.mapInArrow(compare, schema)


class Index:
    """The labels of a block by their chunks."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.label = pa.concat_arrays([r.column("label") for r in rows])
        self.id = np.concatenate([r.column("id").to_numpy() for r in rows])
        sizes = np.concatenate([pc.list_value_length(r.column("chunks")).to_numpy() for r in rows])
        chunks = np.concatenate([r.column("chunks").flatten().to_numpy() for r in rows])
        order = np.argsort(chunks, kind="stable")
        chunks = chunks[order]
        #: Numbers of the labels, chunk by chunk and in order in each; key, starts: the chunks, and where the numbers of each begin.
        self.held = np.repeat(np.arange(len(self.id), dtype=np.int32), sizes)[order]
        first = np.flatnonzero(np.diff(chunks, prepend=chunks[:1] - 1)) if len(chunks) else np.zeros(0, int)
        self.key, self.starts = chunks[first], np.append(first, len(chunks))

    def within(self, keys: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """The labels that hold ``need`` or more of the chunks at these places of ``key``, and how many."""
        sizes = self.starts[keys + 1] - self.starts[keys]
        order = np.argsort(sizes, kind="stable")
        # A label with enough of them has one of all but need - 1; of those, the least common ones are looked at first.
        rare = len(keys) - need + 1
        lists = [self.held[self.starts[k] : self.starts[k + 1]] for k in keys[order[:rare]]]
        total, few = int(sizes.sum()), int(sizes[order[:rare]].sum())
        if total <= 16 * few + 1024:
            return self.counted([*lists, *(self.held[self.starts[k] : self.starts[k + 1]] for k in keys[order[rare:]])], total, need)
        some, n = self.counted(lists, few, 1)
        for left, k in zip(range(need - 1, 0, -1), keys[order[rare:]], strict=True):
            if not len(some := some[may := n + left >= need]):
                return some, n[may]
            held = self.held[self.starts[k] : self.starts[k + 1]]
            n = n[may] + (held[np.minimum(np.searchsorted(held, some), len(held) - 1)] == some)
        return some[n >= need], n[n >= need]

    def counted(self, lists: list[np.ndarray], total: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(lists)
        if 8 * total < len(self.id):
            some, n = np.unique(every, return_counts=True)
            return some[n >= need], n[n >= need]
        n = np.bincount(every)
        some = np.flatnonzero(n >= need)
        return some, n[some]

    def ask(self, rows: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
        label, ids, n, need = rows.column("label"), *(rows.column(c).to_numpy() for c in ("id", "n", "need"))
        ends = np.append(0, np.cumsum(pc.list_value_length(rows.column("chunks")).to_numpy()))
        chunks = rows.column("chunks").flatten().to_numpy()
        places = np.minimum(np.searchsorted(self.key, chunks), len(self.key) - 1)
        known = self.key[places] == chunks
        out, waiting = [], 0
        for k in range(len(ids)):
            keys = places[ends[k] : ends[k + 1]][known[ends[k] : ends[k + 1]]]
            if len(keys) >= need[k]:
                some, shared = self.within(keys, int(need[k]))
                good = (shared / n[k] >= least) & (self.id[some] != ids[k])
                out.append((np.full(int(good.sum()), k), some[good], shared[good] / n[k]))
                waiting += len(out[-1][0])
            if waiting >= BATCH or out and k == len(ids) - 1:
                a, b, share = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([label.take(pa.array(a)), self.label.take(pa.array(b)), pa.array(share)], ["label", "within", "containment"])
                out, waiting = [], 0
