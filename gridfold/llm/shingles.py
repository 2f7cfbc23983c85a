"""Hashed word shingles of many texts at once, and ProbMinHash signatures of weighted shingle sets."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at once.
STRETCH = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = (np.ones(1, _U), np.ones(1, _U))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        _powers = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U), dtype=_U)]) for b in (_BASE, _BACK))
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts (runs without ASCII white space), and where each text's words end."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    white = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):  # a stretch of words at a time, or long texts would take many times their size
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + STRETCH)))
        begin, own = starts[at], buffer[starts[at] : stops[end - 1]]
        up, down = _power(len(own))
        total = np.concatenate([np.zeros(1, _U), np.cumsum((own.astype(_U) + _U(1)) * up[: len(own)], dtype=_U)])
        hashes[at:end] = mixed((total[stops[at:end] - begin] - total[starts[at:end] - begin]) * down[starts[at:end] - begin])
        at = end
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, text_ends)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, by text and hash.

    A shingle is ``words`` consecutive words; a text with fewer words has one shingle of all of them (also when it has none).
    """
    hashes, ends = word_hashes(texts)
    sizes = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(texts)), np.maximum(1, sizes - words + 1))
    first = np.concatenate([[0], np.cumsum(np.maximum(1, sizes - words + 1))[:-1]]) if len(texts) else np.zeros(0, int)
    start = (ends - sizes)[text] + np.arange(len(text)) - first[text]
    padded = np.concatenate([hashes, np.zeros(words, _U)])
    value = np.zeros(len(text), _U)
    for i in range(words):
        here = padded[np.minimum(start + i, len(padded) - 1)]
        value = value * _BASE + np.where(start + i < ends[text], here, _U(i + 1))
    value = mixed(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.concatenate([at, [len(text)]]))


def prob_min_hash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """ProbMinHash signatures, ``n_texts`` x ``size``: for each component the shingle that arrived there first.

    Every shingle arrives at the times of a Poisson process whose rate is its weight, each time at a random component; its
    times and components follow from its hash alone. A shingle is done when its next time is later than the last of the
    first arrivals at its text's components. Two signatures agree in a component with a probability that is the probability
    Jaccard similarity of their weighted sets; with equal weights, the Jaccard similarity.
    """
    first = np.full(n_texts * size, np.inf)
    owner = np.zeros(n_texts * size, _U)
    latest = np.full(n_texts, np.inf)
    time = np.zeros(len(text))
    turn = 0
    while len(text):
        turn += 1
        random = mixed(value + _U(turn * int(_BASE) % (1 << 64)))
        time = time - np.log(((random >> _U(12)).astype(float) + 0.5) * 2.0**-52) / weight
        on = time < latest[text]
        if not on.all():
            text, value, weight, time, random = text[on], value[on], weight[on], time[on], random[on]
            if not len(text):
                break
        place = text * size + (mixed(random ^ _BASE) % _U(size)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = time <= first[place]
        owner[place[won]] = value[won]
        here = text[np.concatenate([[True], text[1:] != text[:-1]])]
        latest[here] = first.reshape(n_texts, size)[here].max(1)
    return owner.reshape(n_texts, size)
