"""Chat transcripts to canonical turns: a hidden Markov model recovers who speaks.

The states are the roles; the observations are features of each line (a speaker marker, its place after a blank line, its
length, a question mark, its place in the block). Emissions and transitions are counted on labelled conversations, the latter
apart for lines that begin a block. Viterbi finds the likeliest roles. A conversation of any length is cut into chunks:
each chunk is summed up by the best score from every state before it to every state at its end, these matrices are combined
level by level, and once the states at the edges of a chunk are known it is decoded by itself. The result is that of
one Viterbi pass, and no task holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import materialise
from gridfold.llm.ranking import rank_within, unpacked

ROLES = ["system", "user", "assistant", "other"]
N = len(ROLES)
START = N  # the state before the first line
CHUNK = 256

# Names by which transcripts mark a speaker.
SPEAKERS = {
    "system": "system|context|instructions",
    "user": "user|human|customer|client|question|prompt|instruction|q|you|me",
    "assistant": "assistant|ai|bot|chatbot|agent|model|gpt|answer|response|a",
    "other": "tool|function|observation",
}


def _marker_pattern(names: str) -> str:
    return rf"(?i)^\s*(?:<\|(?:im_start\|>)?|\[|#+\s*|\*+)?\s*(?:{names})\s*(?:\|>|\]|\*+)?\s*(?:[:>]\**\s*|$)"


FEATURES = ["marker", "opens", "length", "asks", "place", "block_lines"]


def lines_of(transcripts: DataFrame, id_col: str, order_cols: list[str], text_col: str) -> DataFrame:
    """The lines of all transcripts with their features. A row of ``transcripts`` begins a block, as does a line after a blank one.

    A line is one however long it is. Rows that agree in ``order_cols`` go by a hash of their role and text; rows alike in these
    too are all there, each whole, one after the other.
    """
    role = [c for c in ("role",) if c in transcripts.columns]
    place = F.struct(*[F.col(c) for c in order_cols], F.xxhash64(*role, text_col).alias("_tie"))
    rows = transcripts.select(F.col(id_col).alias("conv"), place.alias("place_in"), F.monotonically_increasing_id().alias("twin"), *role, F.col(text_col).alias("text"))
    rows = rows.select("conv", "place_in", "twin", *role, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\\s*\n")).alias("nth", "block"))
    split = F.split("block", "\n")
    rows = rows.select(*[c for c in rows.columns if c != "block"], F.size(split).alias("n"), F.posexplode(split).alias("at", "line"))
    marker = F.lit("none")
    for role, names in SPEAKERS.items():
        marker = F.when(F.col("line").rlike(_marker_pattern(names)), role).otherwise(marker)
    length = F.least(F.floor(F.log2(F.char_length("line") + 1)), F.lit(12)).cast("string")
    return rows.withColumns({
        "marker": marker,
        "opens": (F.col("at") == 0).cast("string"),
        "length": length,
        "asks": F.rtrim("line").endswith("?").cast("string"),
        "place": F.least("at", F.lit(3)).cast("string"),
        "block_lines": F.least("n", F.lit(6)).cast("string"),
    })


@dataclass
class Model:
    """Log probabilities. emissions: (feature, value) to one for each role; transitions: [opens][role before, or START][role]."""

    emissions: dict[tuple[str, str], list[float]]
    unseen: dict[str, list[float]]
    transitions: list[list[list[float]]]


def ranked_lines(lines: DataFrame, name: str) -> DataFrame:
    """Lines with their rank in the conversation, by place in it; spread evenly also where a conversation is very long."""
    order = ["conv", "place_in", "twin", "nth", "at"]
    laid = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(rank_within(laid, "conv", name)[0].select(*unpacked(laid.columns), "rank"), name)


def train(ranked: DataFrame) -> Model:
    """Counts over all ranked lines with a ``role``; only tables of roles and feature values reach the driver."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("other")
    known = ranked.filter(F.col("role").isNotNull()).withColumn("role", role)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("p")
    seen = known.select("role", pairs).groupBy("role", "p.feature", "p.value").count().collect()
    before = known.select("conv", (F.col("rank") + 1).alias("rank"), F.col("role").alias("before"))
    steps = known.select("conv", "rank", "role", "opens").join(before, ["conv", "rank"], "left").groupBy("before", "role", "opens").count().collect()
    counts, totals = {}, {f: np.full(N, 1.0) for f in FEATURES}
    for r in seen:
        key = (r["feature"], r["value"])
        counts.setdefault(key, np.full(N, 0.2))[ROLES.index(r["role"])] += r["count"]
        totals[r["feature"]][ROLES.index(r["role"])] += r["count"]
    moves = np.full((2, N + 1, N), 0.1)
    for r in steps:
        moves[int(r["opens"] == "true"), START if r["before"] is None else ROLES.index(r["before"]), ROLES.index(r["role"])] += r["count"]
    # a marker names its speaker also where the labelled conversations had none
    emissions = {k: np.log(v / totals[k[0]]).tolist() for k, v in counts.items()}
    for role in ROLES:
        emissions.setdefault(("marker", role), [0.0 if role == x else -8.0 for x in ROLES])
    return Model(emissions, {f: np.log(0.2 / totals[f]).tolist() for f in FEATURES}, np.log(moves / moves.sum(2, keepdims=True)).tolist())


def _scores(model: Model, rows: dict | pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    emit = np.zeros((len(rows["opens"]), N))
    for f in FEATURES:
        emit += np.array([model.emissions.get((f, v), model.unseen[f]) for v in rows[f]])
    return emit, np.array([x == "true" for x in rows["opens"]], int)


def summary(model: Model, rows: dict | pd.DataFrame) -> np.ndarray:
    """The best score of a chunk from each state before it (START last) to each state of its last line."""
    emit, opens = _scores(model, rows)
    move = np.array(model.transitions)
    best = move[opens[0]] + emit[0]
    for t in range(1, len(emit)):
        best = (best[:, :, None] + move[opens[t]][None, :N]).max(1) + emit[t]
    return best


def decode(model: Model, rows: dict | pd.DataFrame, before: int, last: int) -> list[int]:
    """The best states of a chunk between the state before it and that of its last line (-1: any)."""
    emit, opens = _scores(model, rows)
    move = np.array(model.transitions)
    best, back = move[opens[0], before] + emit[0], []
    for t in range(1, len(emit)):
        reach = best[:, None] + move[opens[t], :N]
        back.append(reach.argmax(0))
        best = reach.max(0) + emit[t]
    path = [int(best.argmax()) if last < 0 else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _boundaries(matrices: list[np.ndarray], before: int, last: int) -> list[int]:
    """The best states at the ends of consecutive parts between two given states (last -1: any)."""
    best, back = matrices[0][before], []
    for m in matrices[1:]:
        reach = best[:, None] + m[:N]
        back.append(reach.argmax(0))
        best = reach.max(0)
    path = [int(best.argmax()) if last < 0 else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _edges(model: Model, lines: DataFrame) -> DataFrame:
    """conv, chunk, before, last: the states at the edges of each chunk of conversations with more than one."""
    matrix = "conv {0}, chunk long, best array<double>".format(lines.schema["conv"].dataType.simpleString())

    def chunk_summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv": [key[0]], "chunk": [key[1]], "best": [summary(model, rows.sort_values("rank")).ravel()]})

    def combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        total, *others = [np.reshape(b, (N + 1, N)) for b in rows["best"]]
        for m in others:
            total = (total[:, :, None] + m[None, :N]).max(1)
        return pd.DataFrame({"conv": [key[0]], "chunk": [key[1]], "best": [total.ravel()]})

    levels = [materialise(lines.groupBy("conv", "chunk").applyInPandas(chunk_summary, matrix), "chunks")]
    while not levels[-1].filter("chunk > 0").isEmpty():
        up = levels[-1].groupBy("conv", F.floor(F.col("chunk") / CHUNK).alias("parent")).applyInPandas(combined, matrix)
        levels.append(materialise(up, "chunks"))
    state = f"conv {lines.schema['conv'].dataType.simpleString()}, chunk long, before int, last int"
    edges = levels[-1].select("conv", "chunk", F.lit(START).alias("before"), F.lit(-1).alias("last"))

    def spread(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        before, last = int(rows["before"].iloc[0]), int(rows["last"].iloc[0])
        ends = _boundaries([np.reshape(b, (N + 1, N)) for b in rows["best"]], before, last)
        return pd.DataFrame({"conv": key[0], "chunk": rows["chunk"], "before": [before, *ends[:-1]], "last": ends})

    for below in reversed(levels[:-1]):
        known = edges.select(F.col("conv").alias("of"), F.col("chunk").alias("above"), "before", "last")
        parts = below.withColumn("parent", F.floor(F.col("chunk") / CHUNK))
        parts = parts.join(known, F.col("conv").eqNullSafe(F.col("of")) & (F.col("parent") == F.col("above")))
        edges = parts.groupBy("conv", "parent").applyInPandas(spread, state)
    return edges


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole conversations, whose lines come in the order of their rank, with where each begins."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        starts = np.flatnonzero(rows.column("rank").to_numpy() == 0)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
        held = rows.slice(starts[-1]) if len(starts) else None
    if held is not None:
        yield held, np.zeros(1, int)


def canonical(line: Column) -> Column:
    """A line without its speaker marker and without the delimiters of turns."""
    for names in SPEAKERS.values():
        line = F.regexp_replace(line, _marker_pattern(names), "")
    return F.regexp_replace(line, r"<\|(?:im_start|im_end)\|>", "")


def format_chat(ranked: DataFrame, model: Model, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns: ``id_col``, part, n_lines, n_turns, n_agree, rendered.

    One row for each ``CHUNK`` lines of a conversation; its text is the concatenation of ``rendered`` by ``part``. A turn is
    ``<|im_start|>role``, its lines, ``<|im_end|>``; lines of one role without another between are one turn. ``n_turns`` counts
    the turns that begin in the part, ``n_agree`` its lines whose role is the given one (0 without given roles). Null texts
    are one empty line; conversations with a null id are one; no conversations, no rows. Rows that agree in their place are
    ordered by ``lines_of``.
    """
    kind = ranked.schema["conv"].dataType.simpleString()
    given = F.col("role") if "role" in ranked.columns else F.lit(None).cast("string")
    lines = ranked.withColumns({"chunk": F.floor(F.col("rank") / CHUNK), "given": given, "shown": canonical(F.col("line"))}).select("conv", "chunk", "rank", "given", "shown", *FEATURES)
    several = lines.filter("chunk > 0").select(F.col("conv").alias("of")).distinct()
    long = lines.join(several, F.col("conv").eqNullSafe(F.col("of")), "left_semi")
    schema = f"`{id_col}` {kind}, part long, n_lines int, n_turns int, n_agree int, rendered string"

    def render(rows: dict | pd.DataFrame, before: int, last: int) -> tuple[int, int, int, str]:
        path = decode(model, rows, before, last)
        out, turns = [], 0
        for state, text in zip(path, rows["shown"], strict=True):
            if state != before:
                out.append(("" if before == START else "<|im_end|>\n") + f"<|im_start|>{ROLES[state]}\n")
                turns += 1
            out.append(f"{text}\n")
            before = state
        agree = sum(ROLES[s] == g for s, g in zip(path, rows["given"], strict=True))
        return len(path), turns, agree, "".join(out) + ("<|im_end|>\n" if last < 0 else "")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _conversations(batches):
            columns = {c: rows.column(c).to_pylist() for c in ["given", "shown", *FEATURES]}
            cuts = [*starts.tolist(), rows.num_rows]
            found = [render({c: v[a:b] for c, v in columns.items()}, START, -1) for a, b in zip(cuts, cuts[1:], strict=False)]
            n_lines, n_turns, n_agree, texts = zip(*found, strict=True)
            whole = [rows.column("conv").combine_chunks().take(pa.array(starts)), pa.array([0] * len(found), pa.int64()), *(pa.array(x, pa.int32()) for x in (n_lines, n_turns, n_agree)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(whole, names=[id_col, "part", "n_lines", "n_turns", "n_agree", "rendered"])

    # conversations of one chunk: a task decodes the many that it has in one go
    short = lines.join(several, F.col("conv").eqNullSafe(F.col("of")), "left_anti")
    laid = short.repartition("conv").sortWithinPartitions("conv", "rank")
    whole = laid.select("rank", "conv", "given", "shown", *FEATURES).mapInArrow(rendered, schema)
    if several.isEmpty():
        return whole
    edges = materialise(_edges(model, long), "edges").select(F.col("conv").alias("edge_of"), F.col("chunk").alias("edge_at"), "before", "last")
    ends = edges.groupBy(F.col("edge_of").alias("end_of")).agg(F.max("edge_at").alias("final"))
    told = long.join(edges, F.col("conv").eqNullSafe(F.col("edge_of")) & (F.col("chunk") == F.col("edge_at"))).join(ends, F.col("conv").eqNullSafe(F.col("end_of")))

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n_lines, turns, agree, text = render(rows.sort_values("rank"), int(rows["before"].iloc[0]), int(rows["last"].iloc[0]))
        closing = "<|im_end|>\n" if key[1] == rows["final"].iloc[0] else ""
        return pd.DataFrame({id_col: [key[0]], "part": [key[1]], "n_lines": [n_lines], "n_turns": [turns], "n_agree": [agree], "rendered": [text + closing]})

    return whole.union(told.groupBy("conv", "chunk").applyInPandas(part, schema))
