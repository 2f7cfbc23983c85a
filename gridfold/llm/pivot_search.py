"""Exact top-k inner products by pivot-table elimination.

The inner product of two vectors is the product of their lengths and the cosine of their angle, and angles obey the triangle
inequality: the largest difference of a query's and a candidate's angles to one pivot bounds their angle from below, so their product
from above. Every vector keeps its angles to ``pivots`` pivots and belongs to the cell of the nearest one; for each cell and pivot the
least and largest angle are known, a table whose size depends on the pivots alone. A query first goes to its own cell, which gives it
a k-th best product, then only to cells that could hold a better one (or an equal one, of a smaller id). In a cell, candidates are
evaluated in the order of their bounds until these are below the k-th best. Candidates move once, in blocks of bounded size;
queries come to them as a stream. Nothing is dropped unless its bound rules it out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridfold.llm.common import materialise

PIVOTS = 32
#: Rows, those of least hashed id, from which the pivots are chosen: each the farthest from those before it.
SAMPLE = 4096
#: Candidates of a block, about.
BLOCK = 4096
#: Bounds have this much room for rounding, as a share of the product of the lengths.
ROOM = 1e-9


def quantised(vector: Column) -> Column:
    """Components as floor(256 x) of x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def angles(x: np.ndarray, length: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each vector to each pivot (of length 1); a vector of length 0 is at a right angle to all."""
    return np.arccos(np.clip(x @ pivots.T / np.where(length > 0, length, 1)[:, None], -1, 1))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` vectors of length 1, each at the largest angle to its nearest one among those before it."""
    length = np.sqrt((x * x).sum(1))
    x = x[length > 0] / length[length > 0][:, None]
    if not len(x):
        return np.eye(1, x.shape[1])
    chosen, near = [0], x @ x[0]
    while len(chosen) < n and near.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def block_top(q_id: int, q: np.ndarray, q_length: float, to_q: np.ndarray, floor: float, ids: np.ndarray, x: np.ndarray, lengths: np.ndarray, to_x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A query's ``k`` best candidates of a block, as ids and products, among those whose bound reaches ``floor``; and how many were
    evaluated. Candidates come in the order of their bounds, and the search ends where these are below the k-th best."""
    product = q_length * lengths
    bound = product * (np.cos(np.abs(to_x - to_q).max(1)) + ROOM)
    order = np.flatnonzero((bound >= floor) & (ids != q_id))
    order = order[np.argsort(-bound[order], kind="stable")]
    best_id, best, at, step = np.empty(0, ids.dtype), np.empty(0), 0, 8 * k
    while at < len(order) and not (len(best) == k and bound[order[at]] < best[-1]):
        some = order[at : at + step]
        best_id, best = np.concatenate([best_id, ids[some]]), np.concatenate([best, x[some] @ q])
        top = np.lexsort((best_id, -best))[:k]
        best_id, best, at, step = best_id[top], best[top], at + len(some), step * 2
    return best_id, best, at


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """What the queries found in each block: query_id, vec_id, score (double), and in ``evaluated``, on one row of each query and block,
    how many candidates were evaluated there. The best ``k`` of each query are among them."""
    spark = vectors.sparkSession
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    clean = vectors.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    clean = materialise(clean.filter(usable(F.col("v"))).withColumn("n_dim", F.size("v")), "pivot-search")
    found = spark.createDataFrame([], "query_id long, vec_id long, score double, evaluated long")
    for d in clean.groupBy("n_dim").agg(F.max("asks").alias("asked")).collect():  # one row for each length of vectors
        if d["asked"]:
            found = found.union(_of_length(clean.filter(F.col("n_dim") == d["n_dim"]).drop("n_dim"), k, pivots))
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """For each query row its ``k`` candidates (any other row) of largest inner product: query_id, rank, ``id_col``, score (double).

    Ties go to the smaller id; a query with fewer candidates gets all of them. Rows with a null id and vectors that are
    null, empty, or hold null or non-finite components take no part; vectors of different lengths do not meet.
    Repeated ids are each other's own row and do not meet either. An empty table gives none.
    """
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = search(vectors, is_query, k, id_col, vector_col, pivots).withColumn("rank", place).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _of_length(rows: DataFrame, k: int, n_pivots: int) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE).select("v").toArrow()  # at most SAMPLE rows
    points = farthest_first(_matrix(sample.column("v").combine_chunks()), n_pivots)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                length = np.sqrt((x * x).sum(1))
                to = angles(x, length, points)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(points)), pa.array(to.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length), lists, pa.array(to.argmin(1).astype(np.int32))], names=[*b.schema.names, "length", "angles", "cell"])

    table = materialise(rows.mapInArrow(described, "id long, v array<double>, asks boolean, length double, angles array<double>, cell int"), "pivot-table")
    edges = [f(F.col("angles")[i]).alias(f"{name}{i}") for f, name in ((F.min, "low"), (F.max, "high")) for i in range(len(points))]
    cells = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("short"), F.max("length").alias("long"), *edges).orderBy("cell").collect()  # one row for each pivot
    cell = np.array([c["cell"] for c in cells])
    low, high = (np.array([[c[f"{name}{i}"] for i in range(len(points))] for c in cells]) for name in ("low", "high"))
    short, long = (np.array([c[name] for c in cells]) for name in ("short", "long"))
    parts = np.array([-(-c["n"] // BLOCK) for c in cells])
    n_parts = F.element_at(F.create_map(*[F.lit(x) for c, n in zip(cell.tolist(), parts.tolist(), strict=True) for x in (c, n)]), F.col("cell"))
    candidates = table.select("cell", F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v", "length", "angles", F.lit(0.0).alias("floor"))
    asking, columns, schema = table.filter("asks"), candidates.columns, candidates.schema
    floorless = F.lit(float("-inf"))

    def sent(first: bool):
        """The queries with each block they go to: those of their own cell, or those of all others that may hold something better."""

        def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, length, to = b.column("cell").to_numpy(), b.column("length").to_numpy(), _matrix(b.column("angles")) if b.num_rows else None
                least, at, where = b.column("floor").to_numpy(), [], []
                for i in range(b.num_rows):
                    apart = np.maximum(low - to[i], to[i] - high).max(1)
                    cosine = np.cos(np.clip(apart, 0, np.pi))
                    bound = length[i] * (np.where(cosine >= 0, long, short) * cosine + ROOM * long)
                    for c in np.flatnonzero(cell == own[i] if first else (cell != own[i]) & (bound >= least[i])):
                        at += [i] * int(parts[c])
                        where += [(int(cell[c]), part) for part in range(int(parts[c]))]
                for begin in range(0, len(at), 4096):  # a query may go to very many blocks
                    some, to_some = pa.array(at[begin : begin + 4096], pa.int64()), where[begin : begin + 4096]
                    out = [pa.array([c for c, _ in to_some], pa.int32()), pa.array([p for _, p in to_some], pa.int32()), pa.array([True] * len(to_some))]
                    yield pa.RecordBatch.from_arrays([*out, *(b.column(x).take(some) for x in ("id", "v", "length", "angles", "floor"))], names=columns)

        return to_blocks

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's candidates come first and are held; its queries follow."""
        block, held = None, []
        for b in batches:
            where = list(zip(b.column("cell").to_pylist(), b.column("part").to_pylist(), b.column("asks").to_pylist(), strict=True))
            cuts = [i for i in range(len(where)) if i == 0 or where[i] != where[i - 1]]
            for begin, end in zip(cuts, [*cuts[1:], len(where)], strict=True):
                part = b.slice(begin, end - begin)
                ids, length = part.column("id").to_numpy(), part.column("length").to_numpy()
                x, to = _matrix(part.column("v")), _matrix(part.column("angles"))
                if where[begin][:2] != block:
                    block, held = where[begin][:2], []
                if not where[begin][2]:
                    held.append((ids, x, length, to))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(z) for z in zip(*held, strict=True))]
                floor, out = part.column("floor").to_numpy(), []
                for i in range(len(ids) if held else 0):
                    got, score, seen = block_top(int(ids[i]), x[i], length[i], to[i], floor[i], *held[0], k)
                    out.append((np.full(len(got), ids[i]), got, score, np.where(np.arange(len(got)) == 0, seen, 0)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "evaluated"])

    def together(queries: DataFrame, first: bool) -> DataFrame:
        moved = queries.select("id", "v", "length", "angles", "cell", "floor").mapInArrow(sent(first), schema)
        both = candidates.union(moved).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
        return both.mapInArrow(meet, "query_id long, vec_id long, score double, evaluated long")

    near = materialise(together(asking.withColumn("floor", floorless), True), "pivot-near")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    floors = near.withColumn("rank", place).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asking.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", floorless))
    return near.union(together(known, False))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
