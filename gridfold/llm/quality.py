"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector over hashed text features is shared by all grades, and the
thresholds are ordered. The features of a text are the mean of its hashed words and, once each, hashed levels of its form
(share of capitals, digits, marks, repeated words, word length, size), so no vocabulary is kept. Scoring gives the expected
grade, for ranking, and the probability of the highest grades, for selection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm import shingles

#: Bits of a hashed feature.
BITS = 15
#: Labelled documents at most, of each grade, that a model is fitted on.
SAMPLE = 2000
#: Weight of a feature of form against the mean of the words.
FORM = 0.5
BUFFER = 1 << 20


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than grades


def _hash(name: str) -> int:
    return int(shingles.word_hashes([name.encode()])[0][0] >> np.uint64(64 - BITS))


def _levels(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


# The edges of the levels of each feature of form.
EDGES = {
    "upper": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "digit": [0.001, 0.005, 0.02, 0.05, 0.1, 0.3],
    "mark": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4],
    "again": [0.001, 0.01, 0.03, 0.1, 0.3, 0.6],
    "length": [2, 3, 4, 5, 6, 7, 9, 12, 20],
    "size": [5, 20, 50, 100, 200, 500, 1000, 3000, 10000],
}
_FORM_IDS = {name: np.array([_hash(f"{name}:{i}") for i in range(len(e) + 1)]) for name, e in EDGES.items()}


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and value, of every word and of the features of form of each text."""
    n_texts = len(texts)
    lowered = [t.lower() for t in texts]
    hashes, ends = shingles.word_hashes(lowered)
    sizes = np.diff(np.concatenate([[0], ends])).astype(float)
    of = np.repeat(np.arange(n_texts), sizes.astype(int))
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    text_of = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])

    def share(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.int64), text_of) / np.maximum(solid, 1)

    white = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    solid = np.add.reduceat((~white).astype(np.int64), text_of).astype(float)
    upper, lower = (buffer >= 65) & (buffer <= 90), (buffer >= 97) & (buffer <= 122)
    digit = (buffer >= 48) & (buffer <= 57)
    mark = ~white & ~upper & ~lower & ~digit & (buffer < 128)
    again = np.zeros(len(of), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    form = {
        "upper": share(upper),
        "digit": share(digit),
        "mark": share(mark),
        "again": np.bincount(of, again, n_texts) / np.maximum(sizes, 1),
        "length": solid / np.maximum(sizes, 1),
        "size": sizes,
    }
    ids = [(hashes >> np.uint64(64 - BITS)).astype(np.int64), *(_FORM_IDS[k][_levels(v, EDGES[k])] for k, v in form.items())]
    rows = [of, *[np.arange(n_texts)] * len(form)]
    values = [1 / sizes[of], *[np.full(n_texts, FORM)] * len(form)]
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values)


def probabilities(margin: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold."""
    return 1 / (1 + np.exp(np.clip(thresholds[None] - margin[:, None], -30, 30)))


def fit(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 300, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Maximum likelihood by Adam over all documents of the sample; thresholds are a first one and positive gaps."""
    n = len(grades)
    w = np.zeros(1 << BITS)
    raw = np.zeros(n_grades - 1)
    balance = n / (n_grades * np.maximum(np.bincount(grades, minlength=n_grades), 1))[grades]
    state = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(raw), np.zeros_like(raw))]
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        margin = np.bincount(rows, values * w[ids], n)
        padded = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            high, low = (1 / (1 + np.exp(margin - padded[grades + d])) for d in (1, 0))
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_margin = balance * (d_high - d_low) / n  # of the loss
        g_cut = np.zeros(n_grades + 1)
        np.add.at(g_cut, grades + 1, -balance * d_high / n)
        np.add.at(g_cut, grades, balance * d_low / n)
        g_cut = g_cut[1:-1]
        g_raw = np.cumsum(g_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
        g_w = np.bincount(ids, values * g_margin[rows], len(w)) + ridge * w
        for x, g, (m, v) in ((w, g_w, state[0]), (raw, g_raw, state[1])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w.astype(np.float32), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def _buffers(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column in runs of about ``BUFFER`` bytes, with where each run begins."""
    held, size, begin = [], 0, 0
    for i, text in enumerate(column):
        held.append((text.as_py() or "").encode())
        size += len(held[-1])
        if size > BUFFER:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


def train(docs: DataFrame, rated: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """A model from a bounded sample of the rated documents: at most ``SAMPLE`` of each grade (0 to ``n_grades`` - 1), those of
    least hashed id; only their features reach the driver. Null grades are left out. An id with several grades has the lowest;
    an id with several documents gives its least text. Without documents of two grades the
    model gives all documents the same expected grade."""
    chosen = None
    for g in range(n_grades):
        own = rated.filter(F.col(grade_col) == g).select(F.col(id_col).alias("_id"), F.lit(g).alias("_grade")).distinct().orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(SAMPLE)
        chosen = own if chosen is None else chosen.union(own)
    picked = F.broadcast(chosen.groupBy("_id").agg(F.min("_grade").alias("_grade")))  # at most SAMPLE for each grade
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id").groupBy("_id", "_grade").agg(F.min("_text").alias("_text")).select("_text", "_grade")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = batch.column(1).to_pylist()
            for begin, texts in _buffers(batch.column(0)):
                of, ids, values = features(texts)
                key = np.unique(of * (1 << BITS) + ids, return_inverse=True)
                total = np.bincount(key[1], values)
                cut = np.searchsorted(key[0] >> BITS, np.arange(len(texts) + 1))
                out = [[(key[0] & ((1 << BITS) - 1))[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)], [total[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)]]
                yield pa.RecordBatch.from_arrays([pa.array(grades[begin : begin + len(texts)], pa.int32()), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.float32()))], names=["grade", "ids", "values"])

    found = rows.mapInArrow(sparse, "grade int, ids array<int>, values array<float>").collect()
    found.sort(key=lambda r: (r["grade"], r["ids"], r["values"]))  # the same model however the rows were dealt
    grades = np.array([r["grade"] for r in found], int)
    if len(set(grades.tolist())) < 2:
        at = float(grades[0]) if len(grades) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), np.where(np.arange(n_grades - 1) < at, -30.0, 30.0))
    of = np.repeat(np.arange(len(found)), [len(r["ids"]) for r in found])
    ids, values = (np.concatenate([np.array(r[c], t) for r in found]) for c, t in (("ids", np.int64), ("values", float)))
    return fit(of, ids, values, grades, n_grades)


def score(docs: DataFrame, model: Model, tail: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of a grade of at least ``tail``) and ``grade`` (the likeliest), from whole
    texts. Every row is scored, repeated ones alike; an empty table stays empty. A null text counts as empty; columns of these
    names are replaced."""
    docs = docs.drop("expected_grade", "tail_probability", "grade")
    schema = docs.withColumns({"expected_grade": F.lit(0.0), "tail_probability": F.lit(0.0), "grade": F.lit(0)}).schema
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [np.zeros(0)]
            for _, texts in _buffers(batch.column(at)):
                of, ids, values = features(texts)
                margins.append(np.bincount(of, values * model.weights[ids], len(texts)))
            above = probabilities(np.concatenate(margins), model.thresholds)
            edges = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
            new = [above.sum(1), edges[:, tail], np.argmax(edges[:, :-1] - edges[:, 1:], 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=[*batch.schema.names, "expected_grade", "tail_probability", "grade"])

    return docs.mapInArrow(scored, schema)


def graded(quality: Column, toxic: Column) -> Column:
    """A rating of 0 (poor), 1 (good but toxic) or 2 (good) from two binary labels; null where either is."""
    return F.when(quality.isNull() | toxic.isNull(), F.lit(None)).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)
