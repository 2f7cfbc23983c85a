"""Near duplicates by ProbMinHash, banding and verification.

Each text is the set of its distinct word 5-shingles, weighted by 1 + log(count). Exponential arrivals with early termination
(``shingles.prob_min_hash``) give a signature; ``BANDS`` bands of ``ROWS`` components put texts into buckets. Texts with the
same shingles are one class, which has one representative. Representatives that share a bucket are candidates, and a
candidate pair is a link when what the signatures estimate, the probability Jaccard similarity of the two weighted sets, is at least
``threshold``: it is computed from all their shingles (64-bit hashes) and counts. A group is a connected component of links. With
signatures of 180 components, a pair of similarity 0.8 shares a bucket with a probability of 0.9999.

A bucket is not expanded into its pairs. First each of its members is compared with a few of them drawn at random; then
only members of a bucket that are still in different groups are compared, as only these can change a group. In a large bucket,
those are found by an exact filter. If shares a and b of the weights of two sets are in common, their similarity is at most
1 / (1 / a + 1 / b - 1): with the weight that is not in common for each weight that is, u and v, at most 1 / (1 + u + v). So, in
one order by rarity, two sets that are similar enough have a shingle in common before either is through with a share 1 -
``threshold`` of its weight, and what is before it, or is more than the other set can hold after it, gives u and v. Variants of
one text that are not similar enough do not meet: too much of them is theirs alone. Shingles with very many holders are split, so that no task meets more than ``HOT`` of them with the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridfold.llm import shingles
from gridfold.llm.common import Scratch, materialise
from gridfold.llm.components import components

BANDS, ROWS = 30, 6
THRESHOLD = 0.8
#: Members of a bucket that all its members are compared with first.
CENTRES = 3
#: In buckets of up to so many members, what is left is compared pair by pair; in larger ones, by rare shingles in common.
SMALL_BUCKET = 32
#: Holders of a rare shingle that are met with all others in one task.
HOT = 4096
#: Pairs are compared in runs of about so many bytes of text.
PAIR_BYTES = 1 << 20
#: Room for rounding in bounds.
ROOM = 1e-9
#: Texts are hashed in buffers of about so many bytes; texts with fewer distinct shingles are signed together.
BUFFER, FEW = 1 << 19, 256


def _signed(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and band keys of these texts: (rows, then each shingle's text, hash and count)."""
    rows = np.concatenate([s[0] for s in sets])
    first = np.cumsum([0, *(len(s[0]) for s in sets)])
    text = np.concatenate([s[1] + n for s, n in zip(sets, first, strict=False)])
    value, count = (np.concatenate([s[i] for s in sets]) for i in (2, 3))
    signature = shingles.prob_min_hash(text, value, 1 + np.log(count), len(rows), BANDS * ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(rows), BANDS)).copy()
    for i in range(ROWS):
        key = shingles.mixed(key + signature.reshape(len(rows), BANDS, ROWS)[:, :, i])
    return rows, key.view(np.int64)


def _only(texts: np.ndarray, sets: tuple[np.ndarray, np.ndarray, np.ndarray], at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of these texts, numbered anew; their rows begin at ``at``."""
    text, value, count = sets
    new = np.full(int(text[-1]) + 1 if len(text) else 0, -1)
    new[texts] = np.arange(len(texts))
    keep = new[text] >= 0
    return texts + at, new[text[keep]], value[keep], count[keep]


def _buffers(texts: pa.Array) -> Iterator[tuple[int, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Runs of about ``BUFFER`` bytes of lower-case texts, with where each begins, and their shingle sets."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at + len(some) < len(texts) and size < BUFFER:
            some.append((texts[at + len(some)].as_py() or "").lower().encode())
            size += len(some[-1])
        yield at, some, shingles.shingle_sets(some)
        at += len(some)


def sketches(laid: DataFrame) -> DataFrame:
    """For each (row, text): row, class (16 bytes, the same for the same weighted shingles), n and mass (number and weight of its
    shingles), bands."""
    schema = pa.schema([("row", pa.int64()), ("class", pa.binary()), ("n", pa.int32()), ("mass", pa.float64()), ("bands", pa.list_(pa.int64()))])

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_rows = batch.num_rows
        classes, sizes, masses = [], [np.zeros(0, int)], [np.zeros(0)]
        bands = np.zeros((n_rows, BANDS), np.int64)
        small: list = []
        for at, some, sets in _buffers(batch.column("text")):
            ends = np.searchsorted(sets[0], np.arange(len(some)), side="right")
            n = np.diff(np.concatenate([[0], ends]))
            classes += [xxhash.xxh128_digest(sets[1][e - k : e].tobytes() + sets[2][e - k : e].astype("<i8").tobytes()) for e, k in zip(ends, n, strict=True)]
            sizes.append(n)
            masses.append(np.bincount(sets[0], 1 + np.log(sets[2]), len(some)))
            if (large := np.flatnonzero(n >= FEW)).size:
                rows, keys = _signed([_only(large, sets, at)])
                bands[rows] = keys
            if (few := np.flatnonzero(n < FEW)).size:
                small.append(_only(few, sets, at))
        if small:
            rows, keys = _signed(small)
            bands[rows] = keys
        keys = pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        columns = [batch.column("row"), pa.array(classes, pa.binary()), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(masses)), keys]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                yield of_batch(batch.slice(i, 4096))

    return laid.mapInArrow(sketched, "row long, class binary, n int, mass double, bands array<long>")


def weighted_sets(laid: DataFrame) -> DataFrame:
    """For each (row, text): row as node, all its distinct shingles (64-bit hashes, in order) and their counts."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some, (text, value, count) in _buffers(batch.column("text")):
                cuts = pa.array(np.searchsorted(text, np.arange(len(some) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (value.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(some)), *lists], names=["node", "shingles", "counts"])

    return laid.mapInArrow(of_batches, "node long, shingles array<long>, counts array<int>")


def probability_jaccard(pair: np.ndarray, value: np.ndarray, x: np.ndarray, y: np.ndarray, n_pairs: int) -> np.ndarray:
    """The similarity of each pair of weighted sets: x and y are the weights of ``value`` in the two sets of ``pair`` (0: not in it;
    a value may come once for each set). The sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i), by sorting x / y."""
    order = np.lexsort((value, pair))
    pair, value, x, y = pair[order], value[order], x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (value[1:] != value[:-1])])) if len(pair) else np.zeros(0, int)
    pair, x, y = pair[first], np.add.reduceat(x, first) if len(first) else x, np.add.reduceat(y, first) if len(first) else y
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.lexsort((ratio, pair))
    pair, x, y, ratio = pair[order], x[order], y[order], ratio[order]
    starts = np.searchsorted(pair, np.arange(n_pairs + 1))
    sums = [np.concatenate([[0], np.cumsum(w)]) for w in (x, y)]
    after = sums[0][starts[pair + 1]] - sums[0][:-1]  # x from here on
    before = sums[1][:-1] - sums[1][starts[pair]]  # y before
    both = (x > 0) & (y > 0)
    return np.bincount(pair[both], x[both] / (after[both] + ratio[both] * before[both]), n_pairs)


def _possible(threshold: float, other: str) -> Column:
    """Whether two sets of these numbers (n) and weights (mass) of shingles can be similar enough, if what is before ``place``, with the
    weight ``before``, is not in common. Each shingle weighs at least 1."""
    common = F.least(F.col("n") - F.col("place"), F.col(f"{other}n") - F.col(f"{other}place"))

    def rate(side: str) -> Column:
        alone = F.greatest(F.col(f"{side}before"), F.col(f"{side}n") - common)
        return F.when(alone < F.col(f"{side}mass"), alone / (F.col(f"{side}mass") - alone)).otherwise(F.lit(float("inf")))

    return rate("") + rate(other) <= 1 / threshold - 1 + ROOM


def _links(pairs: DataFrame, laid: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of rows whose weighted shingle sets are similar enough, from their whole texts."""
    a, b = (laid.select(F.col("row").alias(x), F.col("text").alias(f"{x}_text")) for x in ("a", "b"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sides, size = ([], []), 0
                while at + len(sides[0]) < batch.num_rows and size < PAIR_BYTES:
                    here = at + len(sides[0])
                    for side, name in zip(sides, ("a_text", "b_text"), strict=True):
                        side.append((batch.column(name)[here].as_py() or "").lower().encode())
                        size += len(side[-1])
                n = len(sides[0])
                (p, v, x), (q, w, y) = (shingles.shingle_sets(side) for side in sides)
                x, y = 1 + np.log(x), 1 + np.log(y)
                found = probability_jaccard(np.concatenate([p, q]), np.concatenate([v, w]), np.concatenate([x, 0 * y]), np.concatenate([0 * x, y]), n)
                yield batch.select(["a", "b"]).slice(at, n).filter(pa.array(found >= threshold - ROOM))
                at += n

    return pairs.join(a, "a").join(b, "b").mapInArrow(compared, "a long, b long")


def _across(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes that share the key, are in different groups and may be similar enough, if the key is the first
    shingle they have in common (``place`` and ``before``: how many shingles, of what weight, come before it). One of the two is then
    in the lower half of what this may be; these, of one of the ``parts`` of the key, meet all others."""
    u = F.col("before") / (F.col("mass") - F.col("before"))
    rows = rows.withColumn("u", u)
    light = rows.filter(F.col("u") <= (1 / threshold - 1) / 2 + ROOM).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    other = rows.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "mass", "label", "place", "before", "u")])
    first = (F.col("u") < F.col("o_u")) | ((F.col("u") == F.col("o_u")) & (F.col("node") < F.col("o_node")))
    met = light.join(other, (light[key] == other[key]) & (light["part"] == other["part"]) & first & (F.col("label") != F.col("o_label")) & _possible(threshold, "o_"))
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))


def _prefixes(nodes: DataFrame, laid: DataFrame, threshold: float) -> DataFrame:
    """The nodes with each of their rarest shingles, up to a share 1 - ``threshold`` of their weight. Shingles that only one node holds
    only move the others on."""
    sets = weighted_sets(laid.select("row", "text").join(nodes.select(F.col("node").alias("row")), "row", "left_semi"))
    each = nodes.join(sets, "node").select("node", "label", "n", "mass", F.explode(F.arrays_zip("shingles", "counts")).alias("s"))
    each = each.select("node", "label", "n", "mass", F.col("s.shingles").alias("shingle"), (1 + F.log(F.col("s.counts"))).alias("w"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"))
    order = W.partitionBy("node").orderBy("holders", "shingle")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranked = each.join(common, "shingle").withColumns({"place": F.row_number().over(order) - 1, "before": before})
    ranked = ranked.filter((F.col("before") <= (1 - threshold) * F.col("mass") + ROOM) & (F.col("holders") > 1))
    return ranked.select("shingle", "node", "n", "mass", "label", "place", "before", F.ceil(F.col("holders") / HOT).alias("parts"))


def _grouped(laid: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``row``, ``class_id``, ``group_id`` and ``keep`` (the row of the group's least id) for each (row, id, text) of a written table."""
    wide = Scratch(laid.sparkSession, "sketches")
    sketch = wide.write(sketches(laid.select("row", "text")), "sketches")
    of = scratch.write(sketch.select("row", "class").join(laid.select("row", "id"), "row"), "ids")
    classes = of.groupBy("class").agg(F.min(F.struct("id", "row")).alias("least"))
    classes = scratch.write(classes.select("class", F.col("least.id").alias("class_id"), F.col("least.row").alias("node")), "classes")
    nodes = sketch.join(classes.select("node"), F.col("row") == F.col("node"))
    in_bands = wide.write(nodes.select("node", "n", "mass", F.explode("bands").alias("key")), "bands")
    drawn = [F.min_by(F.struct("node", "n", "mass"), F.xxhash64("node", F.lit(i), "key")).alias(f"c{i}") for i in range(CENTRES)]
    buckets = in_bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *drawn).filter("members > 1")
    buckets = buckets.select("key", "members", F.array_distinct(F.array(*[f"c{i}" for i in range(CENTRES)])).alias("centres"))
    met = scratch.write(in_bands.join(buckets, "key").withColumns({"place": F.lit(0), "before": F.lit(0.0)}), "buckets")
    shared = met.select(F.col("node").alias("row")).distinct()
    held = scratch.write(laid.select("row", "text").join(shared, "row", "left_semi"), "texts")  # all that is compared from here on
    wide.drop()
    whole = {"c_place": F.lit(0), "c_before": F.lit(0.0)}
    pairs = met.select("node", "n", "mass", "place", "before", F.explode("centres").alias("c")).select("*", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "n", "mass")]).withColumns(whole)
    pairs = pairs.filter((F.col("node") != F.col("c_node")) & _possible(threshold, "c_"))
    tried = scratch.write(pairs.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct(), "pairs")
    links = scratch.write(_links(tried, held, threshold), "links")
    labels = components(links, scratch)

    # What is left: pairs of a bucket in different groups, which no comparison has joined or kept apart yet.
    in_buckets = met.select("key", "members", "node", "n", "mass", "place", "before").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    divided = in_buckets.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    rest = scratch.write(in_buckets.join(divided, "key", "left_semi"), "rest")
    small = rest.filter(F.col("members") <= SMALL_BUCKET).withColumn("parts", F.lit(1).cast("long"))
    large = rest.filter(F.col("members") > SMALL_BUCKET).select("node", "n", "mass", "label").distinct()
    late = _across(small, "key", threshold).union(_across(_prefixes(large, held, threshold), "shingle", threshold))
    late = scratch.write(_links(late.distinct().join(tried, ["a", "b"], "left_anti"), held, threshold), "links")
    if not late.isEmpty():
        labels = components(links.union(late), scratch)

    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min(F.struct("class_id", "node")).alias("least"))
    named = named.join(least, "label").select("class", "class_id", F.col("least.class_id").alias("group_id"), F.col("least.node").alias("keep"))
    return of.join(named, "class").select("row", "id", "class_id", "group_id", "keep")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, class_id and group_id.

    ``class_id`` is the least id among the documents with the same shingles, as often; ``group_id`` the least id in the
    connected component of links. Words are runs without ASCII white space, in lower case; a text of fewer than five words has
    one shingle of all of them. Null texts count as empty, and empty texts are one class; a null id counts as the least.
    Repeated rows are in one class. Whole texts of any length are compared. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    laid = scratch.write(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row")), "texts")
    found = _grouped(laid, scratch, threshold).select(F.col("id").alias(id_col), "class_id", "group_id")
    found = materialise(found, "near-groups")
    scratch.drop()
    return found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: that of the least id (null first), and one of these if there are
    several. It is rows that stay or go, so texts of different groups stay also where they share an id."""
    whole = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row")), "near-dedup-rows")
    field = F.col("whole").getField
    scratch = Scratch(docs.sparkSession, "near-dedup")
    groups = _grouped(whole.select("row", field(id_col).cast("long").alias("id"), field(text_col).alias("text")), scratch, threshold)
    kept = materialise(groups.select("keep").distinct(), "near-dedup-kept")
    scratch.drop()
    return whole.join(kept, F.col("row") == F.col("keep"), "left_semi").select(*[field(c).alias(c) for c in docs.columns])
