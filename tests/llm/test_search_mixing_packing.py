"""Search, mixing, packing and the pipeline."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridfold.llm import mixing, packing, pivot_search, queries


# Search -------------------------------------------------------------------------------------------------------------


def test_search_like_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("inf")] + [0.0] * 5), (2004, [float("nan")] * 6), (2005, [0.0] * 6), (2006, [1.0, 2.0]), (2007, [3.0, 4.0]), (None, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, rank int")
    clean = df.filter(pivot_search.usable(F.col("embedding"))).withColumn("embedding", pivot_search.quantised(F.col("embedding")))
    found = defaultdict(list)
    for r in pivot_search.top_k(clean, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((int(r["score"]), r["vec_id"]))
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    for q, x in good:
        if q % 50 == 0:
            every = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:5]
            assert found.pop(q) == [(-s, i) for s, i in every]
    assert not found
    assert pivot_search.top_k(clean.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    two = pivot_search.top_k(clean.filter("vec_id in (2006, 2007)"), F.lit(True), 5).collect()
    assert len(two) == 2


def test_pivots_rule_out_other_clusters(spark):
    """On vectors in clusters most candidates are never evaluated, and what is found is what brute force finds; also with blocks of few
    candidates, and where a third of all vectors are one."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 24)) * 40
    x = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 4)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    pivot_search.BLOCK, before = 100, pivot_search.BLOCK
    found = pivot_search.search(df, F.col("vec_id") % 50 == 0, 5).collect()
    pivot_search.BLOCK = before
    best = defaultdict(list)
    for r in found:
        best[r["query_id"]].append((-r["score"], r["vec_id"]))
    for q in range(0, 3000, 50):
        score = x @ x[q]
        assert sorted(best[q])[:5] == sorted((-score[i], i) for i in range(3000) if i != q)[:5]
    assert sum(r["evaluated"] for r in found) < 0.5 * 60 * 2999


def test_bounds_are_never_below_the_product():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(500, 7)), rng.normal(size=7)
    x[::50], length = 0, None
    length = np.sqrt((x * x).sum(1))
    points = pivot_search.farthest_first(x, 10)
    to_x, to_q = pivot_search.angles(x, length, points), pivot_search.angles(q[None], np.array([np.sqrt(q @ q)]), points)[0]
    ids, score, seen = pivot_search.block_top(-1, q, np.sqrt(q @ q), to_q, -np.inf, np.arange(500), x, length, to_x, 5)
    want = np.lexsort((np.arange(500), -(x @ q)))[:5]
    assert ids.tolist() == want.tolist() and seen <= 500 and len(points) == 10


# Mixing -------------------------------------------------------------------------------------------------------------


def slots_of(blocks, weights, window):
    slots = defaultdict(list)
    for rows in mixing.plan(blocks, weights, window):
        for s, stretch, first, last, own in rows:
            assert len(own) == last - first + 1 and first // mixing.STRETCH == last // mixing.STRETCH == stretch and len(slots[s]) == first
            slots[s] += own
    assert sorted(t for ts in slots.values() for t in ts) == list(range(sum(blocks.values()))) and all(len(slots[s]) == n for s, n in blocks.items())
    return slots


LONG = [
    {"a": 1, "b": 1, "c": 1},
    {"hot": 19**0.5, **{str(i): 2**0.5 for i in range(19)}},
    {"a": 0.9, "b": 0.1},
    {"a": 1.0, "rare": 1e-4},
    {"pi": np.pi, "e": np.e, "root": 2**0.5, "tiny": 1e-3},
    {str(i): 1 + i**2 for i in range(23)},
]


@pytest.mark.parametrize("weights", LONG)
def test_less_than_one_block_from_the_given_weights_in_the_long_run(weights):
    """For the targets themselves, at every slot up to 100,000, whatever the window."""
    blocks, total = 100_000, sum(weights.values())
    slots = slots_of({s: int(blocks * w / total) + 2 for s, w in weights.items()}, weights, 30_000)
    t = np.arange(1, blocks - 2 * len(weights))
    for s, w in weights.items():
        assert np.abs(np.searchsorted(slots[s], t) - t * w / total).max() < 1 + 1e-6


def exact_slots(blocks, weights):
    """Earliest deadline first in fractions, slot by slot, with the ideal that flows until sources run out."""
    w = {s: Fraction(x) for s, x in weights.items()}
    had, release, due, at = dict.fromkeys(blocks, Fraction(0)), defaultdict(list), defaultdict(list), Fraction(0)
    while any(had[s] < n for s, n in blocks.items()):
        left = [s for s, n in blocks.items() if had[s] < n]
        rate = {s: w[s] / sum(w[x] for x in left) for s in left}
        step = min((math.floor(had[s]) + 1 - had[s]) / rate[s] for s in left)  # to the next whole block of any source
        for s in left:
            if had[s].denominator == 1 and len(release[s]) == had[s]:
                release[s].append(math.floor(at))
            had[s] += rate[s] * step
            if had[s].denominator == 1:
                due[s].append(math.ceil(at + step))
        at += step
    slots, done = defaultdict(list), dict.fromkeys(blocks, 0)
    for t in range(sum(blocks.values())):
        ready = [(due[s][done[s]], k, s) for k, s in enumerate(blocks) if done[s] < blocks[s] and release[s][done[s]] <= t]
        s = min(ready)[2]
        slots[s].append(t)
        done[s] += 1
    return slots


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("window", [7, 1 << 20])
def test_schedule_like_exact_fractions(seed, window):
    """Also as sources run out one after the other."""
    rng = np.random.default_rng(seed)
    blocks = {str(i): int(n) for i, n in enumerate(rng.integers(1, 40, 9))} | {"x": 120}
    weights = {s: float(rng.random() + 0.01) for s in blocks}
    assert slots_of(blocks, weights, window) == exact_slots(blocks, weights)


def test_sources_that_run_out_leave_their_weight():
    rng = np.random.default_rng(5)
    blocks = {str(i): int(n) for i, n in enumerate(rng.integers(1, 60, 60))} | {"big": 900}
    weights = {s: rng.random() + 0.1 for s in blocks} | {"big": 20.0}
    slots = slots_of(blocks, weights, 100)
    had, at = dict.fromkeys(blocks, 0.0), 0.0
    for t in range(1, sum(blocks.values()) + 1):
        while at < t - 1e-9:  # all flow until the slot or a source ends
            left = {s: weights[s] for s in blocks if had[s] < blocks[s] - 1e-9}
            rate = {s: w / sum(left.values()) for s, w in left.items()}
            step = min(t - at, min((blocks[s] - had[s]) / r for s, r in rate.items()))
            for s, r in rate.items():
                had[s] += r * step
            at += step
        assert all(abs(np.searchsorted(slots[s], t) - had[s]) < 1 + 1e-6 for s in blocks)


def test_plans_use_every_block_once():
    slots_of({"a": 12340, "b": 17, None: 400, "c": 1}, dict.fromkeys(["a", "b", "c", None], 1.0), 1000)
    assert list(mixing.plan({}, {})) == list(mixing.plan({"a": 0}, {"a": 1.0})) == []


def test_plans_of_several_windows_and_rows_that_are_all_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW", 40)
    rows = [(1, "a", "copy")] * 900 + [(i, "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, row string").repartition(3)
    placed = mixing.schedule(df, {"a": 0.75, "b": 0.25}, block_rows=8).collect()
    assert len({(r["slot"], r["in_block"]) for r in placed}) == len(rows) and {r["slot"] for r in placed} == set(range(113 + 38))
    assert Counter(map(tuple, mixing.mix(df, {"a": 0.75, "b": 0.25}, block_rows=8).collect())) == Counter(rows)


def test_schedule_and_mix_keep_every_row(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", None]), "t", 0, 0) for i in range(2000)] + [(5, "big", "t", 0, 0)] * 2 + [(None, "tiny", None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, rank int, slot int").repartition(5)
    placed = mixing.schedule(df, mixing.by_temperature(0.5), block_rows=8).collect()
    assert len(placed) == len(rows) and len({(r["slot"], r["in_block"]) for r in placed}) == len(rows)
    assert all(len({r["source"] for r in placed if r["slot"] == s}) == 1 for s in range(20))
    mixed = mixing.mix(df, mixing.by_temperature(0.5), block_rows=8)
    assert mixed.columns == df.columns
    assert Counter(map(tuple, mixed.collect())) == Counter(rows)
    assert mixing.schedule(df.limit(0), mixing.by_temperature(0.5)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(df, {"big": 1.0})


@pytest.mark.parametrize("broadcast_rows", [20_000, 10])
def test_schedule_of_many_sources(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast_rows)
    rows = [(i, f"host{i % 1500}" if i % 7 else None) for i in range(6000)]
    placed = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), mixing.by_temperature(0.5), block_rows=2).collect()
    assert Counter((r["doc_id"], r["source"]) for r in placed) == Counter(rows)
    assert len({(r["slot"], r["in_block"]) for r in placed}) == len(rows)
    sizes = Counter(s for _, s in rows)
    blocks = sum(-(-n // 2) for n in sizes.values())
    assert {r["slot"] for r in placed} == set(range(blocks))


# Packing ------------------------------------------------------------------------------------------------------------


def test_encoder_like_the_tokenizer():
    rng = random.Random(6)
    encoder, plain = packing.Encoder(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary())
    texts = ["".join(rng.choice("abcABC 019'sé\u0085 \n\t.,!-<|endoftext|>ßñ") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["<|endoftext|> a <|endoftext|>", "日本語 текст", "x" * 5000, "é" * 300, " " * 300, "I'll they've"]
    for t in texts:
        assert encoder.encode(t) == plain.encode(t, add_special_tokens=False).ids, t


def test_long_texts_are_encoded_alike(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "other", " 12 ", "\n\n", "  ", ". ", "é", "<|endoftext|>", " a"]) for _ in range(4000))
    encoder = packing.Encoder(packing.vocabulary())
    whole = encoder.ids(text).tolist()
    monkeypatch.setattr(packing, "PART", 50)
    assert encoder.ids(text).tolist() == whole == Tokenizer.from_file(packing.vocabulary()).encode(text, add_special_tokens=False).ids


def test_pieces_round_trip_and_fill_sequences(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 300)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "alpha " * 9000), (1003, "beta"), (1003, "beta")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, row int")
    pieces = packing.pack(packing.tokenize(df, packing.vocabulary())).collect()
    plain = Tokenizer.from_file(packing.vocabulary())
    docs = defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
    for i, t in rows:
        if i != 1003:
            own = sorted(docs[i], key=lambda p: p["piece"])
            ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own])
            assert ids.tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2]
            assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
            assert all(p["length"] == 1024 for p in own[1:]) and own[0]["length"] <= 1024
    assert len(docs[1003]) == 2
    bins = defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 1024
    assert packing.pack(packing.tokenize(df.limit(0), packing.vocabulary())).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_and_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5 + seed / 2, 1, 20000).astype(int), 1, 1024)
    histogram = dict(Counter(lengths.tolist()))
    bins = packing.plan_bins(histogram)
    held = Counter()
    for own, n in bins:
        assert sum(own) <= 1024
        for x in own:
            held[x] += n
    assert held == Counter(histogram)
    assert sum(n for _, n in bins) <= 1.01 * max(lengths.sum() / 1024, (lengths > 512).sum()) + 2


def test_groups_have_equal_cardinality():
    runs = [(x, 1 + x % 7) for x in range(1000, 500, -1)]
    dealt = packing.linear_groups(runs, 10)
    assert len({sum(n for _, n in g) for g in dealt[:-1]}) == 1 and sum(n for g in dealt for _, n in g) == sum(n for _, n in runs)


# Pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf).persist()
        assert kept.columns == docs.columns, name
        assert kept.join(docs, "doc_id", "left_anti").count() == 0 and kept.count() >= 0.5 * docs.count()
        if name == "mixing":
            assert kept.count() == docs.count()
        docs = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_pipeline_with_nulls_copies_and_no_rows(spark, tmp_path):
    """Against the plain rules: one of each group of equal or near texts stays, whole, and all of its tokens are packed."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    plain = [text(60) for _ in range(30)]
    long = text(5000)
    rows = [(i, t, "en", "a" if i % 3 else None, len(t)) for i, t in enumerate(plain)]
    rows += [(100, plain[0].replace(" ", "\n"), "en", "b", None), (101, " " + plain[1] + " ", None, "b", 1), (102, plain[2] + " end", "en", "b", 1)]
    rows += [(103, None, "en", "b", 1), (104, "", "en", "b", 1), (105, " \t", "en", None, None), (None, text(60), "en", "c", 1), (106, long, "en", "c", 1), (106, long, "en", "c", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (None, 1, None)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/a/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    firsts = [r["doc_id"] for r in found if r["piece"] == 0]
    # of equal texts the longest stays, then the least id: 101 for 1 and 105 for the empty ones; of near ones the least id
    assert sorted(firsts, key=str) == sorted([*(i for i in range(30) if i != 1), 101, 105, 106, None], key=str)
    assert {r["doc_id"] for r in found if r["piece"]} == {106}
    bins = Counter()
    for r in found:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 1024 and min(r["length"] for r in found) == 3  # the blank text that stays: two ids and the end
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_sequences_follow_the_mix(spark, monkeypatch):
    """However the rows come and whatever their lengths, prefixes of sequences hold the sources by their weights."""
    monkeypatch.setattr(packing.pack_in_order, "__defaults__", (1024, 256, 50))
    rng = random.Random(3)
    sizes = {"a": 1600, "b": 400, "c": 400}
    rows = [(i, s, "word " * (rng.randint(500, 1000) if s == "a" else rng.randint(5, 400))) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5, "doc_id")
    found = corpus_pipeline.packed(spark, docs, "").collect()
    assert set(found[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert sorted(r["doc_id"] for r in found if not r["piece"]) == list(range(len(rows)))
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"], rows[r["doc_id"]][1]))
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        own.sort()
        assert [a for a, *_ in own] == np.cumsum([0, *(n for _, n, _ in own)])[:-1].tolist() and sum(n for _, n, _ in own) <= 1024
    given, share = Counter(), {"a": 0.5, "b": 0.25, "c": 0.25}
    for k in range(len(bins)):
        given.update(s for *_, s in bins[k])
        if given["b"] < 300 and given["c"] < 300:
            for s, w in share.items():
                assert abs(given[s] - w * given.total()) < 256 + 32, (k, given)


def test_every_operator_has_its_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
