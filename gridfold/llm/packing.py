"""Packing documents into sequences of at most ``capacity`` tokens by the linear grouping scheme.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the driver. There the large lengths are dealt
into groups of equal cardinality and rounded up within them; configurations of the few sizes are optimised by column
generation; actual lengths take the places of rounded ones; small pieces, and what rounding down leaves over, are best-fitted
into the space that remains. The outcome is a table of places (length, ranks, sequence, offset) whose size depends on the
capacity and the number of groups, not on the number of documents; pieces find their places in it by their rank
among the pieces of their length.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import materialise
from gridfold.llm.ranking import rank_within, unpacked

CAPACITY = 1024
END_ID = 2
#: Pieces up to this share of the capacity are small: they fill what configurations of two or more large pieces leave.
SMALL_SHARE = 0.45
GROUPS = 200
#: Pieces that are packed together where sequences are to follow an order, and the groups of such a plan.
WINDOW, WINDOW_GROUPS = 4096, 50
#: The two tokenizer libraries split text alike below this code point; texts beyond it go to the slower one.
LATIN_END = 0x250

#: Characters encoded at once.
PART = 1 << 18
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

Run = tuple[int, int]  # a length and how many pieces have it


class Encoder:
    """Token ids of whole texts by a byte-level BPE vocabulary in a ``tokenizers`` JSON file.

    Texts of Latin script are encoded by tiktoken with the same vocabulary and pattern, which gives the same ids several
    times faster; all others by ``tokenizers`` itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.slow = path, None

    def ids(self, text: str) -> np.ndarray:
        """All ids. Long texts are encoded in parts, cut before a space between two letters, where tokens end anyway."""
        parts, at = [], 0
        while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
            parts.append(np.array(self.encode(text[at : cut.start()]), "<u4"))
            at = cut.start()
        return np.concatenate([*parts, np.array(self.encode(text[at:]), "<u4")])

    def encode(self, text: str) -> list[int]:
        if text.isascii() or max(text) < chr(LATIN_END):
            return self.fast.encode(text, allowed_special="all")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every document: ``id_col``, the columns in ``keep``, piece, start, length, ids (binary: little-endian unsigned 32-bit).

    A document is the ids of its whole text (null: empty), then ``END_ID``. Only documents longer than the capacity
    are cut, into full pieces from the end, so that their first piece may be shorter.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            keys, rows, size = batch.columns[:-1], [], 0
            for i, text in enumerate(batch.columns[-1]):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([END_ID], "<u4"))
                buffer = ids.tobytes()
                ends = range(len(ids), 0, -capacity)
                for k, end in enumerate(reversed(ends)):
                    start = max(0, end - capacity)
                    rows.append((i, k, start, end - start, buffer[4 * start : 4 * end]))
                size += len(buffer)
                if size > 4 << 20:
                    yield _piece_batch(keys, rows, names)
                    rows, size = [], 0
            if rows:
                yield _piece_batch(keys, rows, names)

    names = [id_col, *keep]
    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), *[f"`{c}`" for c in keep], F.col(f"`{text_col}`").alias("_text"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(pieces, f"{own}, piece int, start long, length long, ids binary")


def _piece_batch(keys: list[pa.Array], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    at, *columns = zip(*rows, strict=True)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    own = [key.take(pa.array(at)) for key in keys]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*names, "piece", "start", "length", "ids"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each piece's place, gapless from offset 0 in every sequence.

    ``pieces`` needs a column ``length`` from 1 to ``capacity``; all its other columns are kept (but for columns of
    these two names, which are replaced). Pieces of one length are
    interchangeable and take their places in the order of the rows. An empty table gives none.
    """
    ranked, counts = rank_within(pieces, "length", "packing")
    histogram = {r["key"]: r["n"] for r in counts.collect()}  # at most `capacity` rows
    schema = "length long, first long, last long, sequence long, offset long"
    places = F.broadcast(pieces.sparkSession.createDataFrame(place_table(plan_bins(histogram, capacity, groups)), schema))
    placed = ranked.join(places, (F.col("key") == F.col("length")) & F.col("rank").between(F.col("first"), F.col("last")))
    return placed.select(*unpacked(pieces.columns, ("sequence_id", "offset")), (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_in_order(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, window: int = WINDOW, groups: int = WINDOW_GROUPS) -> DataFrame:
    """Like :func:`pack`, with sequences in the order of ``pieces`` by the columns ``order``.

    The pieces are cut in that order into windows of ``window`` pieces. Each window is packed on its own, and its sequences are
    numbered after those of the windows before it, by their earliest piece: the sequences up to the end of a window hold the
    pieces up to there and no others. Only the number of sequences of each window reaches the driver.
    """

    def planned(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        length = part.column("length").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        of = {int(x): np.flatnonzero(length == x) for x in np.unique(length)}
        for x, first, last, begin, at in place_table(plan_bins({x: len(rows) for x, rows in of.items()}, capacity, groups)):
            rows = of[x][first : last + 1]
            sequence[rows], offset[rows] = begin + np.arange(len(rows)), at
        _, earliest, own = np.unique(sequence, return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(earliest))
        return pa.table([part.column("row"), part.column("window"), pa.array(number[own]), pa.array(offset)], names=["row", "window", "sequence", "offset"])

    by = [F.col(f"`{c}`") for c in order]
    ranked, _ = rank_within(pieces.withColumn("_all", F.lit(0)).repartitionByRange(*by).sortWithinPartitions(*by), "_all", "packing")
    ranked = ranked.select("row", "rank", F.floor(F.col("rank") / window).alias("window"), F.col("row.length").alias("length"))
    kind = ranked.schema["row"].dataType.simpleString()
    placed = materialise(ranked.groupBy("window").applyInArrow(planned, f"row {kind}, window long, sequence long, offset long"), "windows")
    before, starts = 0, []
    for r in placed.groupBy("window").agg((F.max("sequence") + 1).alias("n")).orderBy("window").collect():
        starts.append((r["window"], before))
        before += r["n"]
    starts = F.broadcast(pieces.sparkSession.createDataFrame(starts, "window long, before long"))
    return placed.join(starts, "window").select(*unpacked(pieces.columns, ("sequence_id", "offset")), (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset")


def place_table(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each class of bins and each place in it: the length, the ranks that go there, the first bin, the offset."""
    taken: Counter[int] = Counter()
    table, sequence = [], 0
    for lengths, n in bins:
        offset = 0
        for length in lengths:
            table.append((length, taken[length], taken[length] + n - 1, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return table


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Classes of bins (the lengths in each, how many such bins) that hold every piece of the histogram once."""
    bins = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    small = int(capacity * SMALL_SHARE)
    large = [(x, n) for x, n in sorted(histogram.items(), reverse=True) if small < x < capacity and n]
    dealt = linear_groups(large, groups)
    sizes = [g[0][0] for g in dealt]  # each group's longest: what all its pieces count as
    demand = [sum(n for _, n in g) for g in dealt]
    stock = [list(reversed(g)) for g in dealt]  # the longest at the end
    for counts, times in configurations(sizes, demand, capacity):
        columns = [_take(stock[g], times) for g, c in enumerate(counts) for _ in range(c)]
        bins += _aligned(columns, times)
    rest = Counter({x: n for x, n in histogram.items() if x <= small and n})
    for g in stock:
        for x, n in g:
            rest[x] += n
    return best_fit(bins, rest, capacity)


def linear_groups(runs: list[Run], groups: int) -> list[list[Run]]:
    """Runs of falling length dealt into groups with equally many pieces (a length is cut where a group is full)."""
    total = sum(n for _, n in runs)
    if len(runs) <= groups:
        return [[r] for r in runs]
    dealt, room, left = [[]], -(-total // groups), total
    each = room
    for x, n in runs:
        while n:
            if not room:
                dealt.append([])
                room = min(each, left)
            k = min(n, room)
            dealt[-1].append((x, k))
            n, room, left = n - k, room - k, left - k
    return dealt


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (how many pieces of each size) and how often each is used, rounded down from the optimum of the
    linear programme; found by column generation, priced by an unbounded knapsack."""
    m = len(sizes)
    if not m:
        return []
    need = np.array(demand, float)
    basis = np.zeros((m, m))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    use = need / basis.diagonal()
    for _ in range(40 * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        column, worth = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratios = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        use = use - ratios[out] * step
        use[out] = ratios[out]
        basis[:, out] = column
        use = np.maximum(use, 0)
    left, chosen = list(demand), []
    for j in np.argsort(-use, kind="stable"):
        counts = [int(c) for c in basis[:, j]]
        times = min([int(use[j] + 1e-6), *(left[g] // c for g, c in enumerate(counts) if c)])
        if times:
            chosen.append((counts, times))
            left = [a - c * times for a, c in zip(left, counts, strict=True)]
    return chosen


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of most worth at these prices."""
    order = np.argsort(sizes)
    size, price = np.array(sizes)[order], prices[order]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(size[0], capacity + 1):
        k = fitting[c]
        worth = best[c - size[:k]] + price[:k]
        i = int(np.argmax(worth))
        if worth[i] > best[c - 1]:
            best[c], last[c] = worth[i], i
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            column[order[last[c]]] += 1
            c -= size[last[c]]
    return column, float(best[capacity])


def _take(stock: list[Run], n: int) -> list[Run]:
    """The ``n`` longest pieces of a group, taken out of it."""
    runs = []
    while n:
        x, k = stock.pop()
        if k > n:
            stock.append((x, k - n))
            k = n
        runs.append((x, k))
        n -= k
    return runs


def _aligned(columns: list[list[Run]], times: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins ``times`` long whose places are filled from one run after the other, as classes of equal bins."""
    cuts = sorted({0, times} | {int(e) for runs in columns for e in np.cumsum([n for _, n in runs])})
    ends = [np.cumsum([n for _, n in runs]) for runs in columns]
    return [(tuple(runs[int(np.searchsorted(e, a, side="right"))][0] for runs, e in zip(columns, ends, strict=True)), b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_fit(bins: list[tuple[tuple[int, ...], int]], rest: Counter[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``rest`` put, longest first, where the least space remains; new bins are opened where nothing has room."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, n in bins:
        by_room[capacity - sum(lengths)].append((lengths, n))
    rooms = sorted(by_room)
    for x in sorted(rest, reverse=True):
        left = rest[x]
        while left:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                room, (lengths, n) = capacity, ((), -(-left // (capacity // x)))
            else:
                room = rooms[at]
                lengths, n = by_room[room].pop()
            each = min(room // x, left)
            used = min(n, left // each)
            if used < n and room != capacity:
                by_room[room].append((lengths, n - used))
            if room != capacity and not by_room[room]:
                del by_room[room]
                rooms.pop(bisect.bisect_left(rooms, room))
            filled = room - each * x
            if filled not in by_room:
                bisect.insort(rooms, filled)
            by_room[filled].append((lengths + (x,) * each, used))
            left -= each * used
    return [b for room in sorted(by_room) for b in by_room[room]]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
