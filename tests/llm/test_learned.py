"""Operators 11 to 13 against brute force and held-out labels, on fixtures with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.llm import clusters, phrases, quality, spaces
from sheaf.llm.arrays import text_blocks

DATA = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, phrase string, n string, hash string, chunk string, score string, label string"


@pytest.fixture(autouse=True)
def no_pauses(monkeypatch):
    monkeypatch.setattr(spaces.release, "__defaults__", (0, 0.0))
    monkeypatch.setattr(phrases, "LEAST_PARTS", 4)


# 13 phrases


def brute_collocations(rows, max_words=3, least=10, top=2000, percent=50):
    """Straight from the contract; rows are (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                q = lang, p[i : i + m]
                if 100 * a >= percent * found[q]:
                    gone.add(q)
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, place = [], Counter()
    for lang, score, a, p, l, r in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, l, r, n[lang], -score))
    return sorted(ranked)


def some_texts(seed, rows=60):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "Ünder", "x-y", "a", "#", "a b"]
    joints = [" ", " ", " ", "\t", ". ", ",", "\n", "!?", "  "]
    made = ["".join(r.choice(vocabulary) + r.choice(joints) for _ in range(r.randint(0, 60))) for _ in range(rows)]
    return [*zip([r.choice(["en", "de", None, "und"]) for _ in made], made, strict=True), ("en", None), (None, None), ("en", ""), ("fr", " .,! "), ("en", made[0]), ("en", made[0])]


def got_collocations(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize(("max_words", "percent", "top"), [(3, 50, 2000), (2, 50, 5), (4, 30, 40)])
def test_collocations(spark, max_words, percent, top):
    rows = some_texts(3)
    df = spark.createDataFrame([(i, t, x, "p", "n", "h", "c", "s", "l") for i, (x, t) in enumerate(rows)], CLASHING).repartition(3)
    want = brute_collocations(rows, max_words, 10, top, percent)
    assert len({r[0] for r in want}) > 2 and got_collocations(df, max_words=max_words, percent=percent, top=top) == want


def test_collocations_whatever_the_bounds(spark, monkeypatch):
    """Few buckets, small blocks, flushes in every block, rounds of the ranking: they change nothing."""
    rows = some_texts(4)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute_collocations(rows, 3, 4, 15)
    for name, value in (("LEAST_BUCKETS", 64), ("MAX_BUCKETS", 64), ("CHUNK", 16), ("GATHER", 20), ("TEXT_BLOCK", 200), ("RANKED", 20)):
        monkeypatch.setattr(phrases, name, value)
    assert got_collocations(df, min_count=4, top=15) == want
    monkeypatch.setattr(phrases, "RANKED", 31)
    assert got_collocations(df, min_count=4, top=15) == want


def test_bitmaps_prune(spark):
    """What the second pass counts is what can be frequent, not all pairs of words."""
    r = random.Random(5)
    rows = [("en", " ".join(f"w{r.randint(0, 5000)}" if r.random() < 0.7 else "often seen" for _ in range(60))) for _ in range(150)]
    df = spark.createDataFrame(rows, "lang string, text string")
    found, totals = phrases.frequent_phrases(df)
    assert totals.collect() == [("en", sum(len(t.split()) for _, t in rows))]
    words = found.filter("words = 1").withColumn("hash", F.lit(0))
    assert 0 < words.count() < 50
    data = pa.array([t for _, t in rows])
    pairs = {(a, b) for _, t in rows for a, b in zip(t.split(), t.split()[1:], strict=False)}
    for _, end, raw, offsets in text_blocks(data):
        block = phrases.Words(raw, offsets, np.zeros(end, np.int64), np.zeros(1, np.uint64))
        every = phrases.Bitmap(np.full(8, 255, np.uint8))
        common = np.zeros(1 << 17, np.uint8)
        for h in block.first[np.isin(block.number, [i for i, w in enumerate(block.names.to_pylist()) if w in (b"often", b"seen")])]:
            at = int(h) & ((1 << 20) - 1)
            common[at >> 3] |= 1 << (at & 7)
        places, *_ = phrases.level(block, 2, [phrases.Bitmap(common)], [every])
        seen = {(block.names[block.number[p]].as_py().decode(), block.names[block.number[p + 1]].as_py().decode()) for p in places}
        assert seen == {("often", "seen"), ("seen", "often")} and len(pairs) > 1000


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).first()
    assert got["score"] == 1_000_000 * (big - 7) ** 2 // (big * (big + 1))


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).collect() == []
    with pytest.raises(ValueError, match="min_count"):
        phrases.collocations(df, min_count=0)


# 12 clusters


def brute_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, c, d in placed:
        own[c] += d
    return sorted((i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in placed)


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (8, 10), (60, 3), (400, 1)])
def test_clusters(spark, k, rounds):
    r = random.Random(k)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 2.25]) * (1 + i % 3) for _ in range(4)]) for i in range(120)]  # many ties
    rows += [(500, None), (501, []), (502, [1.0]), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan")] * 4), (505, [float("inf"), 0.0, 0.0, 0.0]), (7, rows[7][1]), (7, [9.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(3)
    got = sorted(tuple(r)[:5] + (r["centroid_sha256"],) for r in clusters.clustered(df, k, rounds, 4).collect())
    assert got == brute_clusters(rows, k, rounds, 4, 1024, 3)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id int, embedding array<double>")
    assert clusters.clustered(df).collect() == [] and clusters.clustered(df.limit(0)).collect() == []
    # out of the range whose distances fit
    assert clusters.clustered(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimensions=2).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), max_size=20), st.sampled_from([1, 1000, (1 << 27) // 9 - 1]))
def test_annulus(centroids, vectors, factor):
    """The nearest and the least number of equally near ones, also where norms tie and at the largest components."""
    values = np.array(centroids, np.int64) * factor
    asked = np.array(vectors, np.int64).reshape(-1, 2) * factor
    number, distance, _ = clusters.Centroids(values).nearest(asked)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(values.tolist())) for v in asked.tolist()]
    assert [*zip(distance.tolist(), number.tolist(), strict=True)] == want


def test_annulus_leaves_far_norms_out():
    rings = np.array([[100 * (i + 1), 0] for i in range(50)], np.int64)
    asked = np.array([[100 * (i + 1) + 3, 1] for i in range(50)], np.int64)
    assert clusters.Centroids(rings).nearest(asked)[2] == 50


# 11 quality


def brute_statistics(text):
    """A document's statistics, without numpy."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    chars = len(text)
    words, lines = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]", raw) if w], [x for x in raw.split(b"\n") if x]
    n = max(1, len(words))
    share = lambda f: sum(map(f, words)) / n
    kinds = {k: set(v) for k, v in quality.KINDS.items()}
    upper, marks, symbols = kinds["upper"], kinds["marks"], kinds["symbols"]
    most = max(Counter(words).values(), default=0)
    return [
        *(sum(b in kinds[k] for b in raw) / chars for k in quality.KINDS),
        sum(b >= 0xC0 for b in raw) / chars, math.log1p(chars), math.log1p(len(words)), math.log1p(len(lines)),
        sum(map(len, words)) / n, max(map(len, words), default=0), len(set(words)) / n, most / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / max(1, len(lines)), math.log1p(chars / max(1, len(lines))),
        share(lambda w: w[0] in upper), share(lambda w: len(w) > 1 and w[0] in upper and w[-1] in upper),
        share(lambda w: w[-1] in marks), share(lambda w: w[0] in symbols or w[-1] in symbols), share(lambda w: len(w) > 1 and w[-1] == w[-2] and w[-1] in marks | symbols),
    ]


def test_statistics(spark):
    texts = [None, "", " ", "x", "A b A b!! ##\n\nA b\nÉt 語 12 %%", "one two two two\n" * 50, "Z" * 5000, "a. B, C", "\n", "| a | b |", "😀😀 é"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: [r[s] for s in quality.STATISTICS] for r in quality.statistics(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_statistics(t)), t


def test_histogram_in_steps(monkeypatch):
    r = np.random.default_rng(1)
    data, offsets = r.integers(0, 256, 1000).astype(np.uint8), np.array([0, 0, 10, 10, 300, 301, 1000, 1000])
    want = [np.bincount(data[a:b], minlength=256).tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for step in (1, 7, 300, 5000):
        monkeypatch.setattr(quality, "STEP", step)
        assert quality.byte_counts(data, offsets).tolist() == want


def test_quality_of_held_out_documents(spark):
    """Labels that nothing was learned from: ranked and judged right nearly always, the same in each run."""
    sf_dir = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in quality.query(spark, sf_dir).collect()}
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    judged = [(found[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    held = [(f["score"], f["predicted"], q) for f, q in judged if f["held_out"]]
    assert len(held) > 50 and sum(p == q for _, p, q in held) >= 0.95 * len(held)
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert sum(a > b for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all(0 <= f["score"] <= 1 and f["predicted"] == (f["score"] >= 0.3) for f in found.values())


def test_rules(spark):
    """Rules as columns hold where their bounds do; the sum of the weights of those that hold makes the score."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    assert model.weights == quality.fit(docs.repartition(7), labels.repartition(3)).weights
    assert 0 < len(model.weights) < 100 and len(model.explained()) == len(model.weights)
    for row in quality.scored(docs, model).collect():
        total = model.intercept + sum(w for rule, w in model.weights.items() if all(a < row[n] <= b for n, a, b in rule))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_edges(spark):
    texts = ["good words of a text", None, "", "## %% !!", "good words of a text"]
    docs = spark.createDataFrame([(i if i < 4 else None, t, "x", 1.0, 2, "f", "p", "w", 0) for i, t in enumerate(texts)], "doc_id long, text string, letters string, score double, label int, features string, place string, weight string, part int")
    none = spark.createDataFrame([(None, 1), (3, None), (2, 7)], "doc_id long, label int")
    for labels, want in ((none, 0.5), (none.limit(0), 0.5), (none.unionByName(spark.createDataFrame([(0, 1)], "doc_id long, label int")), 1.0), (spark.createDataFrame([(0, 0), (0, 0)], "doc_id long, label int"), 0.0)):
        model = quality.fit(docs.select("doc_id", "text"), labels)
        assert [r["score"] for r in quality.scored(docs, model).collect()] == [want] * 5
    both = spark.createDataFrame([(0, 1), (0, 1), (3, 0), (1, 0), (1, 1), (77, 1)], "doc_id long, label int")
    assert quality.scored(docs, quality.fit(docs.select("doc_id", "text"), both)).count() == 5
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0).select("doc_id", "text"), both)).collect() == []
    assert [r[0] for r in docs.select(quality.held_out("doc_id")).collect()][4] is False


def test_quality_sample_is_bounded(spark):
    """At most so many rows, half of each label, with weights that restore their shares."""
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 3)) for i in range(600)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(600)], "doc_id long, label int")
    rows = quality.training_rows(docs, labels, 100).toPandas()
    assert len(rows) <= 100 and rows.groupby("label").size().max() <= 50 and rows.groupby("label").size().min() > 30
    assert rows[rows.label == 1].weight.sum() / rows.weight.sum() == pytest.approx(5 / 6)
