"""Exact and near duplicates against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.llm import exact_dedup, near_dedup, shingles
from gridfold.llm.common import Scratch
from gridfold.llm.components import components

SCHEMA = "doc_id long, text string, norm string, row int, salt int"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def fixture():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "a\t", "\nb"]) for _ in range(rng.randint(0, 4)))) for i in range(150)]
    rows += [(200 + i, "hot  text" + " " * (i % 3)) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, " "), (504, "x" * 100_000), (505, "x" * 100_000), (7, "same id"), (7, "same id"), (None, "no id")]
    return [(i, t, "n", 1, 2) for i, t in rows]


@pytest.mark.parametrize("partitions", [1, 16, 1000])
def test_report_like_brute_force(spark, partitions):
    rows = fixture()
    found = exact_dedup.exact_dedup_report(spark.createDataFrame(rows, SCHEMA), partitions=partitions).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = {}
    for r in found:
        best = min(by_sha[r["text_sha256"]])
        assert r["keep_id"] == best[2] and r["group_size"] == len(by_sha[r["text_sha256"]])
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == best[2]
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("partitions", [1, 1000])
def test_survivors_keep_their_columns(spark, partitions):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    found = exact_dedup.exact_dedup(df, partitions=partitions)
    assert found.columns == df.columns
    kept = found.collect()
    assert sorted(norm(r["text"]) for r in kept) == sorted({norm(t) for _, t, *_ in rows})
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.exact_dedup_report(df.limit(0)).count() == 0


def test_neighbours_of_the_sort_join_all_copies(spark, monkeypatch):
    """All pairs of copies that are not cut apart for their number are joined by the comparison of neighbours, and only these."""
    rows = fixture()
    monkeypatch.setattr(exact_dedup, "PART", 0.5)
    df, distinct = spark.createDataFrame(rows, SCHEMA), len({norm(t) for _, t, *_ in rows})
    sorted_rows, cut = exact_dedup.content_sort(df, "doc_id", "text", 1)
    assert not cut and sorted_rows.filter("not new").count() == len(rows) - distinct


def test_texts_with_very_many_copies_are_cut_by_need(spark):
    same, head = "the same text " * 30, "one head for all of them " * 20
    rows = [(i, same) for i in range(20_000)] + [(100_000 + i, f"{head}{i}") for i in range(9_000)] + [(200_000 + i, f"other {i % 900}") for i in range(1_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sorted_rows, cut = exact_dedup.content_sort(df, "doc_id", "text", 16)
    runs = sorted_rows.groupBy("salted", *exact_dedup.KEY).agg(F.count("id").alias("n"), F.sum(F.col("new").cast("int")).alias("texts")).collect()
    assert cut and len([r for r in runs if r["salted"]]) == -(-20_000 // (30_000 // 64)) and max(r["n"] for r in runs) < 1000
    found = exact_dedup.exact_dedup_report(df, partitions=16).collect()
    assert {(r["keep_id"], r["group_size"]) for r in found if r["doc_id"] < 100_000} == {(0, 20_000)}
    assert sum(r["kept"] for r in found) == 1 + 9_000 + 900 and exact_dedup.exact_dedup(df, partitions=16).count() == 9_901


def sets(text):
    """The weights of a text's shingles, as a set of pairs that tells classes apart."""
    w = (text or "").lower().split()
    return frozenset(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))).items())


def similarity(a, b):
    """The probability Jaccard similarity, term by term."""
    x, y = ({k: 1 + math.log(n) for k, n in s} for s in (a, b))
    every, both = {*x, *y}, [k for k in x if k in y]
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in both)


def brute_groups(rows):
    classes = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        classes.setdefault(sets(t), i)
    nodes, parent = list(classes.items()), {i: i for i in classes.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, i) in enumerate(nodes):
        for b, j in nodes[:k]:
            if len(dict(a).keys() & dict(b).keys()) >= 0.6 * min(len(a), len(b)) and similarity(a, b) >= 0.8 - 1e-9:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (classes[sets(t)], root(classes[sets(t)])) for i, t in rows}


def near_fixture():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for base in range(6):
        text = [word() for _ in range(120)]
        for edits in [0, 0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8] * (4 if base == 0 else 1):
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy).upper() if n % 5 == 0 else "  ".join(copy)))
            n += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(60):
        rows.append((n, passage + " " + " ".join(word() for _ in range(80))))
        n += 1
    for k in range(30):  # texts that repeat lines of their own, some of them often
        text = [word() for _ in range(100)]
        for again in (0, 1, 2, 20, 300)[: 2 + k % 4]:
            rows.append((n, " ".join(text + text[10 : 10 + k] * again)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, "few words"), (n + 3, "few  words"), (n + 4, "word " * 5000)]


def test_near_groups_like_brute_force(spark, monkeypatch):
    rows = near_fixture()
    want = brute_groups(rows)
    for small, hot in ((near_dedup.SMALL_BUCKET, near_dedup.HOT), (1, 3)):  # also with every bucket large, and its shingles split
        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
        monkeypatch.setattr(near_dedup, "HOT", hot)
        found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["class_id"], r["group_id"]) for r in found} == want


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = near_fixture()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, label int")
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {g for _, g in brute_groups(rows).values()}
    twice = near_dedup.near_groups(df.union(df)).collect()
    assert len(twice) == 2 * len(rows) and near_dedup.near_groups(df.limit(0)).count() == 0


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    value = np.concatenate([np.sort(a), np.sort(b)])
    s = shingles.prob_min_hash(np.repeat([0, 1], 400), value, np.ones(800), 2, 4000)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.03


def test_weighted_signatures_estimate_probability_jaccard():
    x, y = np.array([4.0, 1, 1]), np.array([1.0, 1, 2])
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(3)) for i in range(3))
    value = np.tile(shingles.mixed(np.arange(3).astype(np.uint64)), 2)
    s = shingles.prob_min_hash(np.repeat([0, 1], 3), value, np.concatenate([x, y]), 2, 20000)
    assert abs((s[0] == s[1]).mean() - want) < 0.02


def test_word_hashes_are_of_words():
    texts = [b"one two  three", b"", b" two\tone\n", "é two".encode()]
    hashes, ends = shingles.word_hashes(texts)
    assert ends.tolist() == [3, 3, 5, 7] and hashes[0] == hashes[4] and hashes[1] == hashes[3] == hashes[6] and len(set(hashes.tolist())) == 4


def test_long_texts_are_hashed_alike(monkeypatch):
    text = ("some words and others " * 300).encode()
    whole = shingles.word_hashes([text, b"x" * 5000, text])
    monkeypatch.setattr(shingles, "STRETCH", 64)
    parts = shingles.word_hashes([text, b"x" * 5000, text])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_null_ids_come_first(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (4, "g")]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"], r["group_id"]) for r in found} == {(None, None, None), (3, None, None), (4, 4, 4)}


def test_probability_jaccard_like_its_sum():
    rng = random.Random(4)
    weighted = [frozenset({rng.randrange(12): rng.choice([1, 1, 2, 50]) for _ in range(rng.randint(1, 10))}.items()) for _ in range(80)]
    pairs = [(a, b) for a in weighted[:40] for b in weighted[40:]]
    flat = [(p, k, 1 + math.log(n) if side == 0 else 0, 1 + math.log(n) if side else 0) for p, pair in enumerate(pairs) for side in (0, 1) for k, n in pair[side]]
    rng.shuffle(flat)
    found = near_dedup.probability_jaccard(*(np.array(c) for c in zip(*flat)), len(pairs))
    assert np.allclose(found, [similarity(a, b) for a, b in pairs])


def test_recall_at_the_threshold_on_repetitive_texts():
    """Pairs whose second text repeats passages very often, of a similarity just over the threshold, share a bucket."""
    rng = random.Random(6)
    texts, wanted = [], []
    for k in range(4000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 160))]
        other = words + [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(0, 12))] + words[20 : 20 + rng.randint(0, 6)] * rng.choice([1, 30, 1000])
        a, b = " ".join(words), " ".join(other)
        if len(wanted) < 60 and 0.8 <= similarity(sets(a), sets(b)) < 0.86:
            wanted.append(len(texts))
            texts += [a.encode(), b.encode()]
        if len(wanted) == 60:
            break
    text, value, count = shingles.shingle_sets(texts)
    _, bands = near_dedup._signed([(np.arange(len(texts)), text, value, count)])
    assert len(wanted) == 60 and np.mean([(bands[k] == bands[k + 1]).any() for k in wanted]) >= 0.98


def test_near_dedup_decides_by_row(spark):
    """Null ids and shared ids: one row of each group stays, whatever its id."""
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(None, one), (None, one), (3, one), (5, two), (5, "quite another text of some words"), (4, two)]
    kept = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(None, one), (4, two), (5, "quite another text of some words")], key=repr)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (503, 503)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert set(found.values()) == {0, 500} and found[200] == 0 and found[501] == 500
