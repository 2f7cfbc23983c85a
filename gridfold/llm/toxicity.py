"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained, one on ordinary text and one on toxic passages. A window of text is compressed once after the
ordinary dictionary and once after both; the bytes that the toxic one saves are the window's gain. Labels mark whole
documents, but toxic passages are a few words, so the toxic dictionary is trained on the words that set labelled toxic
documents apart: those holding byte n-grams that occur in many more toxic than ordinary documents, copies counted once.
A document's largest gain, the sum of its squared gains and its number of windows make a probability by a logistic curve
calibrated on labelled documents that neither dictionary has seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents at most, of each kind, that a model is fitted on.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 2000, 4000
#: Of these, one in so many calibrates and is kept from the dictionaries.
CALIBRATION = 4
#: Bytes of a window, of the dictionaries, and of the n-grams that find toxic words.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, GRAM = 48, 65536, 4096, 6
#: A gram or word is toxic from this many documents, this z, and this ratio of document frequencies on.
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 3, 4.0, 4.0
#: Texts are compressed in buffers of about so many bytes.
BUFFER = 1 << 20


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]  # of the features, the last of the constant


def plain(text: str | None) -> bytes:
    """Lower case, with one space for white space, and one at each end."""
    return f" {' '.join((text or '').lower().split())} ".encode()


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, and for each window its text, start and length: about ``width`` bytes, cut at spaces where
    there are any. The windows of a text cover it."""
    buffer = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    each = np.maximum(1, sizes // width)
    of = np.repeat(np.arange(len(texts)), each)
    k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    start = (ends - sizes)[of] + k * width
    spaces = np.append(np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32), len(buffer))
    cut = np.minimum(spaces[np.searchsorted(spaces, np.minimum(start, len(buffer)))], start + width)
    start = np.where(k > 0, np.minimum(cut, ends[of]), start)
    stop = np.append(start[1:], len(buffer))
    return buffer, of, start, stop - start


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=6, target_length=0, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def _sizes(compressor: zstandard.ZstdCompressor, buffer: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.int64)
    full = np.flatnonzero(length)
    segments = np.stack([start[full], length[full]], 1).astype(np.uint64)
    for i in range(0, len(full), 1 << 17):
        part = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, segments[i : i + (1 << 17)].tobytes()), threads=1)
        out[full[i : i + (1 << 17)]] = [len(x) for x in part]
    return out


class Scorer:
    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.compressors = (_compressor(model.ordinary), _compressor(model.toxic + model.ordinary)) if model.toxic and model.ordinary else None

    def features(self, texts: list[bytes]) -> np.ndarray:
        if self.compressors is None or not texts:
            return np.zeros((len(texts), 4)) + [0, 0, 0, 1]
        buffer, of, start, length = windows(texts)
        without, with_toxic = (_sizes(c, buffer, start, length) for c in self.compressors)
        gain = np.maximum(without - with_toxic, 0)
        most = np.zeros(len(texts), np.int64)
        np.maximum.at(most, of, gain)
        squares = np.bincount(of, gain.astype(float) ** 2, len(texts))
        return np.stack([most, np.sqrt(squares), np.log(np.bincount(of, minlength=len(texts))), np.ones(len(texts))], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _grams(text: bytes) -> np.ndarray:
    """The distinct n-grams of a text, as numbers, that have no space but at their ends."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found, inner = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(GRAM):
        found = (found << np.uint64(8)) | a[i : n + i]
        if 0 < i < GRAM - 1:
            inner &= a[i : n + i] != 32
    return np.unique(found[inner])


def _apart(toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """Which of these document counts set toxic text apart."""
    share = (toxic + ordinary) / (n_toxic + n_ordinary)
    z = (toxic / n_toxic - ordinary / n_ordinary) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_ordinary) + 1e-12)
    ratio = (toxic + 0.5) / (n_toxic + 1) / ((ordinary + 0.5) / (n_ordinary + 1))
    return (toxic >= LEAST_DOCS) & (z > LEAST_Z) & (ratio > LEAST_RATIO)


def _without_copies(texts: list[bytes]) -> list[bytes]:
    """One of each group of texts that share two of six smallest hashes of their word 5-grams."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = text.split()
        hashes = np.array([zlib.crc32(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))], np.uint64)
        least = [(k, int(((hashes * np.uint64(2654435761 + 2 * k * 40503)) & np.uint64(0xFFFFFFFF)).min())) for k in range(6)]
        if sum(x in seen for x in least) < 2:
            out.append(text)
        seen.update(least)
    return out


def _toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> Counter[bytes]:
    """Words, with spaces around, that set toxic text apart, and in how many of its documents they occur."""
    (g1, c1), (g0, c0) = (np.unique(np.concatenate([np.empty(0, np.uint64), *map(_grams, t)]), return_counts=True) for t in (toxic, ordinary))
    at = np.searchsorted(g0, g1)
    among = np.where(np.append(g0, 0)[at] == g1, np.append(c0, 0)[at], 0)
    telling = set(g1[_apart(c1, among, len(toxic), len(ordinary))].tolist())
    words, others = (Counter(w for t in texts for w in set(t.split())) for texts in (toxic, ordinary))
    found = {w: n for w, n in words.items() if len(w) < 64 and not telling.isdisjoint(_grams(b" " + w + b" ").tolist())}
    keep = _apart(np.array(list(found.values())), np.array([others[w] for w in found]), len(toxic), len(ordinary)) if found else []
    # a rare form of a telling stem may not stand out by itself: it counts if ordinary text does not have it
    return Counter({b" " + w + b" ": n for (w, n), k in zip(found.items(), keep, strict=True) if k or (n >= LEAST_DOCS and not others[w])})


def _dictionary(samples: list[bytes], size: int, fallback: bytes, **how: int) -> bytes:
    """What zstandard's trainer makes of the samples; the fallback where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return fallback[-size:]


def fit(labelled: list[tuple[str | None, int]]) -> Model:
    """A model from texts and their labels (1: toxic). Without texts of both kinds every score is the share of toxic ones."""
    texts, labels = [plain(t) for t, _ in labelled], np.array([y for _, y in labelled], int)
    rate = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-6), 1 - 1e-6)
    constant = Model(b"", b"", [0.0, 0.0, 0.0, float(np.log(rate / (1 - rate)))])
    if not 0 < labels.sum() < len(labels):
        return constant
    held = np.array([zlib.crc32(t) % CALIBRATION == 0 for t in texts])
    toxic, ordinary = (_without_copies([t for t, y, h in zip(texts, labels, held, strict=True) if y == kind and not h]) for kind in (1, 0))
    if not toxic or not ordinary or not (words := _toxic_words(toxic, ordinary)):
        return constant
    buffer, _, start, length = windows(ordinary)
    plain_samples = [buffer[a : a + n] for a, n in zip(start, length, strict=True) if n]
    every = [w for w, n in sorted(words.items()) for _ in range(n)]
    groups = max(1, len(every) // 8)
    toxic_samples = [b"".join(every[i::groups]) for i in range(groups)] * 4
    model = Model(
        _dictionary(plain_samples, ORDINARY_BYTES, b"".join(ordinary)),
        _dictionary(toxic_samples, TOXIC_BYTES, b"".join(sorted(words)), k=24, d=6),
        [],
    )
    scorer = Scorer(model)
    use = held if 0 < labels[held].sum() < held.sum() else np.ones(len(held), bool)
    model.weights = logistic(scorer.features([t for t, u in zip(texts, use, strict=True) if u]), labels[use])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> list[float]:
    """Weights of a logistic curve by Newton's method with a small ridge (none on the constant, the last column)."""
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled documents: at most ``TOXIC_SAMPLE`` and ``ORDINARY_SAMPLE`` of them, those
    of least hashed id, whose whole texts reach the driver. Null labels and labels of absent documents are left out. An id with
    both labels is toxic; an id with several documents gives its least text."""
    chosen = []
    for kind, n in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE)):
        own = labels.filter(F.col(label_col).cast("int") == kind).select(F.col(id_col).alias("_id"), F.lit(kind).alias("_label")).distinct()
        chosen.append(own.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(n))
    picked = F.broadcast(chosen[0].union(chosen[1]).groupBy("_id").agg(F.max("_label").alias("_label")))  # at most the two bounds
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    return fit([(r["_text"], r["_label"]) for r in sorted(rows, key=lambda r: (r["_id"], r["_text"] or ""))])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the probability from 0 to 1 that the whole text is toxic. Every row is scored, repeated ones
    alike; an empty table stays empty. A null text counts as empty; a column of that name is replaced."""
    docs = docs.drop(score_col)
    schema = docs.withColumn(score_col, F.lit(0.0)).schema
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column(at):
                held.append(plain(text.as_py()))
                size += len(held[-1])
                if size > BUFFER:
                    out.append(scorer.score(held))
                    held, size = [], 0
            out.append(scorer.score(held))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(scored, schema)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold, which is where crc32 of the id as text is a multiple of 5."""
    return labels.filter(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
