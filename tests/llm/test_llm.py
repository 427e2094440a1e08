"""The training-data operators against brute force, on fixtures with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm import arrays, decontaminate, fingerprint, language, near, pieces, queries, repeats, sharding, spaces, suffixes, tokens, urls, windows
from sheaf.llm.arrays import distinct_sorted, text_blocks, window_choice

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_key` string, part int"


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in enumerate(texts)]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "Δelta", "the", "of"]) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(autouse=True)
def no_pauses(monkeypatch):
    """Tests have no shuffle files to wait for."""
    monkeypatch.setattr(spaces.release, "__defaults__", (0, 0.0))
    monkeypatch.setattr(repeats, "LEAST_BUCKETS", 8)


@pytest.fixture(scope="module")
def texts():
    base, passage = words(300, 1), words(60, 2)
    edited_ = base.split()
    edited_[100] = "EDIT"
    return [
        base, base, " ".join(edited_), None, "", "  \n\t", "x", words(30, 3) + " " + passage, passage + " " + words(30, 4), words(10, 5) + " " + passage + " " + passage,
        "ab" * 400, "ab" * 300, words(4000, 6), "word " * 200, "é" * 90, "😀文字 " * 30, "a\u0301 ﬁ Straße ΣΑΣ", "á fi STRASSE σασ", None, base.upper(),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def lib_count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(docs, texts, library):
    for i, r in by_id(tokens.token_counts(docs)).items():
        t = texts[i] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), lib_count(library, t), lib_count(library, t) > 2048)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeilnorstuTHE'\n\t 019.,!$<|>éèÜßΣσİ中文़´😀½Ⅷ", max_size=60), st.integers(1, 9))
def test_token_chunks(library, text, chunk):
    counter = tokens.counter(public_tokenizers.path(tokens.VOCABULARY))
    want = lib_count(library, text)
    assert counter.count(text) == want == counter.count(text, chunk)


def test_token_specials_and_reset(library, monkeypatch):
    counter = tokens.counter(public_tokenizers.path(tokens.VOCABULARY))
    for text in ("<|endoftext|>a<|startoftext|> <|END", "a" * 3000, "'s't''re"):
        assert counter.count(text) == lib_count(library, text)
    monkeypatch.setattr(tokens, "MAX_STATES", 10)
    monkeypatch.setattr(tokens, "MAX_WORDS", 5)
    assert counter.count("some words that make the tables overflow now") == lib_count(library, "some words that make the tables overflow now")


def test_token_empty(empty):
    assert tokens.token_counts(empty).collect() == []


# 2 near-duplicates


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            line[j + 1], corner = (corner + 1 if x == y else max(line[j + 1], line[j])), line[j + 1]
    return line[-1]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6)), max_size=6))
def test_banded_alignment(a, edits):
    b = list(a)
    for at, value in edits:
        if value % 2:
            b.insert(min(at, len(b)), value)
        elif len(b) > 1:
            b.pop(min(at, len(b) - 1))
    m = lcs(a, b)
    want = m / (len(a) + len(b) - m)
    for dense in (0, 16, 1000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near, "DENSE", dense)
            got = near.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
            same = near.alike(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == (pytest.approx(want) if want >= near.THRESHOLD else 0.0) and same == (got > 0)


def brute_classes(pairs):
    grams = {}
    for k, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[k] = [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))]
    numbers = {g: i for i, g in enumerate({g for v in grams.values() for g in v})}
    root = {k: k for k, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(set)
    for k, v in grams.items():
        for g in v:
            where[g].add(k)
    for a, b in {(min(a, b), max(a, b)) for v in where.values() for a in v for b in v if a != b}:
        x, y = (np.array([numbers[g] for g in grams[k]], np.uint64) for k in (a, b))
        if near.similarity(x, y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: find(k) for k, _ in pairs}


def test_near_classes(docs, texts):
    got = by_id(near.near_classes(docs))
    assert {k: r["class_id"] for k, r in got.items()} == brute_classes([*enumerate(texts)])
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["class_id"] == k}


def test_near_fixture(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert {k: r["class_id"] for k, r in by_id(near.query(spark, DATA)).items()} == brute_classes(pairs)


def test_near_rest_of_a_bucket(spark):
    """Version chains of many clusters that share boilerplate: all similar pairs of a bucket are in one class."""
    boilerplate = [f"license{i}" for i in range(30)]
    texts = []
    for c in range(30):
        own = [f"c{c}w{i}" for i in range(20)]
        for at in (None, 2, 7, 12, 17):
            if at is not None:
                own = [*own[:at], f"c{c}edit{at}", *own[at + 1 :]]
            texts.append(" ".join(boilerplate + own))
    blob = np.frombuffer("".join(texts).encode(), np.uint8)
    grams, at, _ = near.shingles(blob, np.cumsum([0, *map(len, texts)]))
    sketch = near.order_sketches(grams, at, 1)[:, 0]
    similar = [(a, b) for b in range(len(texts)) for a in range(b) if sketch[a] == sketch[b] and near.similarity(grams[at[a] : at[a + 1]], grams[at[b] : at[b + 1]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed, links = near.classes(docs, sketches=1)[1:]
    got = {r["_key"]: r["_class"] for r in placed.collect()}
    assert {(r["v"], r["u"]) for r in links.collect()} <= {(a, b) for b in range(len(texts)) for a in range(b) if near.similarity(grams[at[a] : at[a + 1]], grams[at[b] : at[b + 1]])}
    assert len(similar) > 10 and [p for p in similar if got[p[0]] != got[p[1]]] == []
    assert all(c // 5 == k // 5 for k, c in got.items())


@pytest.mark.parametrize(("shared", "changed"), [(0.88, 50), (0.88, 15), (0.8, 50), (0.8, 15)])
def test_near_templates(spark, shared, changed):
    """Pairs among documents of one template, whose other pairs are just below the threshold: none is missed."""
    n, length = 150, 500
    template, texts = [f"t{i}" for i in range(int(length * shared))], []
    for c in range(n):
        own = [f"c{c}w{i}" for i in range(length - len(template))]
        texts += [" ".join(template + own), " ".join([*template, *own[:-changed], *(f"c{c}x{i}" for i in range(changed))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = by_id(near.near_classes(df))
    assert {k: r["class_id"] for k, r in out.items()} == {k: k - k % 2 for k in range(2 * n)} and all(r["n_links"] == 1 for r in out.values())


def test_cells(monkeypatch):
    """Common k-mers and the components of a cell against brute force, counted one by one and by matrix products."""
    r = random.Random(2)
    monkeypatch.setattr(near, "COLUMNS", 50)
    for _ in range(12):
        base, texts = [f"w{r.randint(0, 50)}" for _ in range(60)], []
        for _ in range(30):
            w = list(base) if r.random() < 0.7 else [f"w{r.randint(0, 30)}" for _ in range(r.randint(1, 80))]
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 5)}"
            texts.append(" ".join(w))
        blob = np.frombuffer("".join(texts).encode(), np.uint8)
        grams, at, _ = near.shingles(blob, np.cumsum([0, *map(len, texts)]))
        kmers = near.labelled_kmers(grams, at)
        kmers = kmers[np.lexsort((kmers, np.repeat(np.arange(30), np.diff(at))))]
        strays, others = np.array(sorted(r.sample(range(30), 12))), np.arange(30)
        sets = [set(kmers[at[i] : at[i + 1]].tolist()) for i in range(30)]
        assert near.common_counts(kmers, at, strays, others).tolist() == [[len(sets[i] & sets[j]) for j in others] for i in strays]
        found = []
        for small in (0, 1000):
            monkeypatch.setattr(near, "SMALL_CELL", small)
            found.append(near.cell_links(strays, others, np.arange(30), grams, kmers, at, 0.8))
        assert found[0] == found[1]
        roots = []
        for links in (found[0], [(i, j) for i in strays for j in others if i != j and near.similarity(grams[at[i] : at[i + 1]], grams[at[j] : at[j + 1]])]):
            root = list(range(30))
            for i, j in links:
                p, q = root[i], root[j]
                root = [min(p, q) if x in (p, q) else x for x in root]
            roots.append(root)
        assert roots[0] == roots[1]


def test_near_repeated_ids(spark, empty):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here now"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(r["class_size"] for r in near.near_classes(df).collect()) == [1, 1, 3, 3, 3]
    assert near.near_classes(empty).collect() == [] and near.deduplicated(empty).collect() == []


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_structured_texts_are_told_apart(spark, n):
    """Sequences that collide under any polynomial modulo a power of two."""
    texts = [" ".join(thue_morse(n, "a", "b")), " ".join(thue_morse(n, "b", "a"))]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    same = bool(near.similarity(*(np.array([int("".join(t[i : i + 10 : 2]), 36) for i in range(0, len(t) - 8, 2)], np.uint64) for t in texts)))  # long ones are alike indeed
    assert [r["class_size"] for r in near.near_classes(df).collect()] == [1 + same] * 2 and same == (n == 4096)
    assert near.near_classes(df).select("n_links").distinct().collect() == [(int(same),)]
    # two unlike words of n letters after 19 equal ones
    common = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(0, common + " " + "".join(thue_morse(n, "a", "b"))), (1, common + " " + "".join(thue_morse(n, "b", "a")))], "doc_id long, text string")
    assert [r["n_removed"] for r in windows.judged(df).collect()] == [0, 0]
    # as bytes: strings of 50 that only one text has
    pairs = [(0, "".join(thue_morse(n, "a", "b"))), (1, "".join(thue_morse(n, "b", "a")))]
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(suffixes.judged(spark.createDataFrame(pairs, "doc_id long, text string"))).items()}
    assert got == brute_bytes(pairs, 50)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=40), st.data())
def test_rolling_hash(values, data):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(arrays, "STEP", data.draw(st.sampled_from([1, 7, 1 << 16])))
        rolling_hash(values, data)


def rolling_hash(values, data):
    x = np.array(values, np.uint64)
    assert arrays.reduced(x).tolist() == [v % arrays.PRIME for v in values]
    y = arrays.reduced(x)
    assert arrays.times(y, y[::-1]).tolist() == [a * b % arrays.PRIME for a, b in zip(y.tolist(), y[::-1].tolist(), strict=True)]
    prefix = arrays.prefix_hash(x)
    assert prefix.tolist() == [sum(v * pow(arrays.BASE, t, arrays.PRIME) for t, v in enumerate(values[:n])) % arrays.PRIME for n in range(len(values) + 1)]
    k = data.draw(st.integers(1, len(values)))
    twice = arrays.prefix_hash(np.concatenate((x, x)))
    assert arrays.window_hash(twice, k)[: len(values) - k + 1].tolist() == arrays.window_hash(prefix, k).tolist()
    n = len(values)
    assert arrays.span_hash(twice, np.array([0]), np.array([k])) == arrays.span_hash(twice, np.array([n]), np.array([n + k]))


def test_word_digests():
    """Equal for texts of equal words, whatever parts them, and only for those."""
    texts = ["a b", " a\n\tb ", "ab", "a  b\x0b", "", " ", "b a", "é b", "a b c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = near.word_digests(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    assert [got.index(x) for x in got] == [0, 0, 2, 0, 4, 4, 6, 7, 8]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "u long, v long")
    out = {r["node"]: r["root"] for r in near.components(links).collect()}
    assert {out[i] for i in range(1, 41)} == {0} and out[101] == 100


# 3 sharding


def brute_place(x, n, seed):
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)

    def once(y):
        left, right = divmod(y, side)
        for i in range(sharding.ROUNDS):
            key = xxhash.xxh64_intdigest(struct.pack("<q", seed * 1_000_003 + i), seed=42)
            value = xxhash.xxh64_intdigest(struct.pack("<q", right), seed=key)
            value -= (value >> 63) << 64
            left, right = right, (left + value % side) % side
        return left * side + right

    y = once(x)
    while y >= n:
        y = once(y)
    return y


def test_sharding(docs, texts):
    out = by_id(sharding.shard(docs, 7))
    order = sorted(range(len(texts)))
    for x, i in enumerate(order):
        t = texts[i]
        place = brute_place(x, len(texts), 7)
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["shard"], out[i]["slot"]) == ((0 if t is None else len(t.encode())) + 16, zlib.crc32((t or "").encode()), place % 7, place // 7)


def test_shards_are_even(spark, empty):
    n = [r["n"] for r in sharding.query(spark, DATA).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).filter("m + 1 = n and d = n").collect()]
    assert len(n) == 40 and max(n) - min(n) <= 1
    assert sharding.shard(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 101])
def test_permutation(spark, n):
    out = sharding.permuted(spark.range(n).withColumnRenamed("id", "row_number"), n, 3)
    assert sorted(r["place"] for r in out.collect()) == list(range(n))


# 4 URLs


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"(/[^?#]*)?", rest[len(host) :])[0] or ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_urls(spark):
    cases = [None, "", "no scheme", "http://A.ORG/x?y=1#z", "http://example.org/es/1", "http://example.org/en/12", "http://m.example.org/en/2", "https://b.com/fr/", "https://b.com/de/", "http://xorg/", "http://org", "http://ORG/", "a://b://c/d", "http://é.com/fr/x?q", "http://c.com?x=/fr/", "http://long.net/" + "a1" * 5000]
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    for r in urls.classify(df).collect():
        host, path, rule, verdict = brute_rule(cases[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.classify(df.limit(0)).collect() == []
    assert {r["verdict"] for r in urls.classify(df.filter("page_id < 3")).collect()} == {"allow"}


def test_url_trees_learn(spark):
    got = urls.classify(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).filter("rule is not null")
    n, right = got.agg(F.count("*"), F.count_if((F.col("score") >= 0.5) == (F.col("verdict") == "allow"))).first()
    assert right / n > 0.75


def test_url_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("a",)], "t string")
    assert [r[0] for r in df.select(urls.entropy(F.col("t"))).collect()] == [1.0, 0.0, 0.0]


# 5 language


def test_language_held_out(spark):
    out = language.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = out.filter("held_out and length(text) > 60")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    assert out.filter("rejected and length(text) > 60").count() <= 2


def test_language_fit_is_reproducible(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = language.fit(df.repartition(3, "n_chars")), language.fit(df.repartition(7))
    assert np.isfinite(a.table).all() and (a.table == b.table).all() and (a.temperature, a.floor) == (b.temperature, b.floor)


def test_language_edges(docs, texts, empty):
    model = language.fit(docs)
    assert np.isfinite(model.table).all()
    out = by_id(language.predictions(docs, model))
    for i, t in enumerate(texts):
        letter = any(c.isalpha() for c in t or "")
        assert (out[i]["lang_pred"] == "und") == (not letter) and 0 <= out[i]["score"] <= 1
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.predictions(docs, nothing).collect()} == {"und"}
    assert language.predictions(empty, model).collect() == []
    assert language.confident(docs, model).columns == docs.columns


# 6 decontamination


def brute_hits(text, items, window):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = norm(text)
    hit, found = set(), set()
    for k, t in items:
        seq = norm(t)
        n = min(window, len(seq))
        for p in range(len(seq) - n + 1 if n else 0):
            for q in range(len(w) - n + 1):
                if w[q : q + n] == seq[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add(k)
    return len(w), len(hit), sorted(map(str, found))


def test_contamination(spark, docs, texts, empty):
    items = [(1, words(60, 2)), (2, "Word! word"), (3, "x"), (4, None), (5, ""), (6, words(60, 2)), (10, "é" * 90), (11, words(300, 1)[500:900])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (1 << 20, 300, 30):
        out = by_id(decontaminate.contamination(docs, bench, block_bytes=blocks))
        assert len(out) == len(texts)
        for i, t in enumerate(texts[:12] + texts[13:]):
            i = i if i < 12 else i + 1
            assert (out[i]["n_words"], out[i]["n_hit"], out[i]["items"]) == brute_hits(texts[i], items, 10)
    assert decontaminate.contamination(empty, bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("blocks", [4 << 20, 250, 30])
def test_repeated_items_count_once(spark, blocks):
    """An item_id of several rows is one item, and a null one is counted and not named: as the query's SQL has it."""
    w, v = words(12, 90), words(15, 91)
    bench = spark.createDataFrame([(7, w), (7, w), (7, v), (None, w), (8, w), (None, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, w), (2, v), (3, f"{w} and {v}"), (4, "none of it"), (5, None)], "doc_id long, text string")
    found = decontaminate.contamination(df, bench, block_bytes=blocks)
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {1: ["7", "8", None], 2: ["7"], 3: ["7", "8", None], 4: [], 5: []}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in df.collect()])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [tuple(r) for r in bench.collect()])
    want = con.sql(decontaminate.ORACLE).fetchall()
    assert sorted(tuple(r) for r in decontaminate.reported(found).collect()) == sorted(want)


def test_long_items_in_pieces(spark, monkeypatch):
    """An item cut in pieces has all its windows still, and no others."""
    item, other = words(400, 92), words(9, 93)
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    cut = item.split()
    texts = [item, " ".join(cut[37:90]), " ".join(cut[100:109]), other, f"{other} x {' '.join(cut[200:215])}", item + " " + item]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 60)
    assert decontaminate.items_of(bench, 10, "item_id", "text").count() > 20
    for blocks in (4 << 20, 200):
        out = by_id(decontaminate.contamination(df, bench, block_bytes=blocks))
        for i, t in enumerate(texts):
            assert (out[i]["n_words"], out[i]["n_hit"], out[i]["items"]) == brute_hits(t, [(1, item), (2, other)], 10)


def test_cleaned_of_benchmark(spark, docs, texts):
    bench = spark.createDataFrame([(1, words(60, 2))], "item_id long, text string")
    out = by_id(decontaminate.cleaned(docs, bench))
    assert words(60, 2) not in out[7]["text"] and words(30, 3) in out[7]["text"] and 9 not in out and out[0]["text"] == texts[0] and out[3]["text"] is None


def test_blocks_of_items_change_nothing(spark):
    """Repeated and null ids, equal word counts, spans of several blocks in one text, coverage over all blocks."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = " ".join(f"c{j}" for j in range(30))
    texts = [f"{items[0][1]} {items[1][1]} {clean}", f"{items[2][1]} {clean} {items[3][1]}", " ".join(t for _, t in items), clean, None, "", f"{items[4][1]} x {items[5][1]} y"]
    df = spark.createDataFrame([(i, t, k) for i, k in ((1, "A"), (1, "B"), (None, "C")) for t in texts], "doc_id long, text string, key string")
    results = []
    for blocks in (4 << 20, 250, 30):
        hit = sorted(map(repr, decontaminate.contamination(df, bench, block_bytes=blocks).select("doc_id", "n_words", "items", "longest", "spans", "n_hit").collect()))
        cut = sorted(map(repr, decontaminate.cleaned(df, bench, block_bytes=blocks).collect()))
        results.append((hit, cut))
        assert len(hit) == len(texts) * 3
    assert results[0] == results[1] == results[2]
    assert len(results[0][1]) == (len(texts) - 2) * 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_automaton(items, text):
    names = [*enumerate(" ".join(map(str, i)) for i in items)]
    machine = decontaminate.Automaton([(k, t.encode().split()) for k, t in names if t], 3)
    got, found = set(), set()
    number = {machine.word(n): n for n in range(len(machine.blob_at) - 1)}
    for a, b, owners, _ in machine.stream([number.get(str(x).encode(), -1) for x in text]):
        got |= set(range(a, b))
        found |= {str(machine.ids[k]) for k in owners}
    assert (len(text), len(got), sorted(found)) == brute_hits(" ".join(map(str, text)), names, 3)


# 7 fingerprints


def test_fingerprints(docs, texts):
    out = by_id(fingerprint.with_next(docs))
    prints = [fingerprint.fingerprint(t or "") for t in texts]
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t) // 2
        changed = t[: len(t) - n] + following[:n]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[i], fingerprint.fingerprint(changed))
        assert (r["near_edited"], r["near_next"]) == (float(prints[i] == fingerprint.fingerprint(changed)), float(prints[i] == prints[(i + 1) % len(texts)]))
        assert (r["group_id"], r["copies"]) == (prints.index(prints[i]), prints.count(prints[i]))
    assert prints[0] == prints[19] and prints[16] != prints[0]


def test_fingerprint_collisions_part(spark, docs, monkeypatch):
    kept = spark.createDataFrame([(1, "h", "head", "x"), (2, "h", "copy", "x"), (3, "h", "copy", "y"), (4, "h", "copy", "y")], "doc_id long, fingerprint string, role string, edge string")
    assert sorted((r["doc_id"], r["group_id"], r["copies"]) for r in fingerprint.compared(kept).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2)]


def test_fingerprint_small(spark, empty):
    assert fingerprint.with_next(empty).collect() == []
    single = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprint.with_next(single).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    twice = spark.createDataFrame([(5, "ab"), (5, "ab"), (6, None)], "doc_id long, text string")
    assert sorted(r["copies"] for r in fingerprint.with_next(twice).collect()) == [1, 2, 2]


# 8 and 10 repeats


def brute_bytes(pairs, length):
    seen, out = set(), {}
    for k, t in sorted(pairs):
        b = (t or "").encode()
        covered, mine = bytearray(len(b)), set()
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                covered[p : p + length] = b"\1" * length
            mine.add(b[p : p + length])
        seen |= mine
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[k] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


def brute_words(pairs, length):
    seen, out = set(), {}
    for k, t in sorted(pairs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        covered = [False] * len(w)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if key in seen:
                covered[p : p + length] = [True] * length
            seen.add(key)
        out[k] = (len(w), sum(covered), hashlib.sha256(" ".join(x for x, c in zip(w, covered, strict=True) if not c).encode()).hexdigest())
    return out


def test_suffixes(docs, texts, empty):
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(suffixes.judged(docs)).items()}
    assert got == brute_bytes([*enumerate(texts)], 50)
    assert suffixes.judged(empty).collect() == []
    cleaned = by_id(suffixes.cleaned(docs))
    assert cleaned[1]["text"] == "" and cleaned[0]["text"] == texts[0] and cleaned[3]["text"] is None


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_windows(docs, texts, batches):
    got = {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in by_id(windows.judged(docs, batches=batches)).items()}
    assert got == brute_words([*enumerate(texts)], 20)


def test_small_alphabet(spark):
    r = random.Random(5)
    pairs = [(i * 3, "".join(r.choice("ab ") for _ in range(r.randint(0, 120)))) for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    got = {k: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for k, x in by_id(suffixes.judged(df, 9)).items()}
    assert got == brute_bytes(pairs, 9)
    got = {k: (x["n_words"], x["n_removed"], x["kept_sha256"]) for k, x in by_id(windows.judged(df, 4)).items()}
    assert got == brute_words(pairs, 4)


def test_windows_cleaned(docs, texts, empty):
    out = by_id(windows.cleaned(docs))
    assert out[1]["text"] == "" and out[3]["text"] is None and out[0]["text"] == texts[0] and out[8]["text"] == words(30, 4)
    assert windows.cleaned(empty).columns == empty.columns and windows.judged(empty).collect() == []


def test_repeated_ids_come_in_text_order(spark):
    t = words(40, 9)
    df = spark.createDataFrame([(1, t), (1, t), (None, "short"), (2, t)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in windows.judged(df).collect()) == [0, 0, 40, 40]
    assert sorted(r["n_removed"] for r in suffixes.judged(df).collect()) == [0, 0, len(t.encode()), len(t.encode())]


def test_frequent_strings_fill_no_bucket(spark, monkeypatch):
    """A licence in every document, each with its own words around it: buckets stay even, and results are those of brute force."""
    licence = words(40, 77)
    pairs = [(i, f"{words(12, 1000 + i)} x{i} {licence} y{i} {words(12, 5000 + i)}") for i in range(400)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2).cache()
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(suffixes.judged(df)).items()}
    assert got == brute_bytes(pairs, 50)
    monkeypatch.setattr(repeats, "CROWD", 1)
    assert got == {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(suffixes.judged(df)).items()}
    blobs = repeats.anchor_blobs(df, suffixes.rule_for(), 64, "crowd")
    n = [r["n"] for r in blobs.groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
    assert max(n) <= 4 * sum(n) / 64


def test_index_is_reopened(spark, tmp_path):
    """An index opened again has all that was committed; what an append left that was cut short is not read."""
    rule, folder = windows.rule_for(4), str(tmp_path / "index")
    removed = []
    for i in range(5):
        index = windows.FingerprintIndex(spark, rule, 8, folder)
        assert index.version == len({r["version"] for r in spark.read.parquet(f"{folder}/manifest").collect()}) if i else index.version == 0
        (tmp_path / "index" / f"run-00099-{i}").mkdir(parents=True)  # of an append that did not end
        df = repeats.keyed(spark.createDataFrame([(i, words(30, i % 2))], "doc_id long, text string"), "doc_id", "text")
        removed.append(repeats.finished(index.append(df), rule, "text", ["doc_id"], "n_words long, n_removed long, kept_sha256 string", windows.digests).first()["n_removed"])
    assert removed == [0, 0, 30, 30, 30] and len(index.runs) <= windows.MAX_RUNS and index.version > 5
    with pytest.raises(ValueError, match="other windows"):
        windows.FingerprintIndex(spark, windows.rule_for(6), 8, folder)


def test_index_append_is_safe_to_repeat(spark, tmp_path):
    """A job that dies between the commit and its use of the result appends the batch again: same result, nothing new in the index."""
    rule, folder = windows.rule_for(4), str(tmp_path / "index")

    def batch(i, seeds):
        return repeats.keyed(spark.createDataFrame([(i * 10 + k, words(30, s)) for k, s in enumerate(seeds)], "doc_id long, text string"), "doc_id", "text")

    def removed(rows):
        return sorted(tuple(r) for r in repeats.finished(rows, rule, "text", ["doc_id"], "n_words long, n_removed long, kept_sha256 string", windows.digests).select("doc_id", "n_removed").collect())

    for i, seeds, want in ((0, [1, 2, 1], [(0, 0), (1, 0), (2, 30)]), (1, [2, 3], [(10, 30), (11, 0)]), (2, [3, 4], [(20, 30), (21, 0)])):
        windows.FingerprintIndex(spark, rule, 8, folder).append(batch(i, seeds), name=f"b{i}")  # its result is lost
        again = windows.FingerprintIndex(spark, rule, 8, folder)
        version = again.version
        assert removed(again.append(batch(i, seeds), name=f"b{i}")) == want and again.version == version
    index = windows.FingerprintIndex(spark, rule, 8, folder)
    assert removed(index.append(batch(0, [1, 2, 1]), name="b0")) == [(0, 0), (1, 0), (2, 30)]  # also after others and a compaction
    with pytest.raises(ValueError, match="already"):
        index.append(batch(2, [9]), name="other")
    with pytest.raises(ValueError, match="twice"):
        index.append(batch(7, [9]).unionByName(batch(7, [9])), name="twice")


def test_index_compacts(spark, monkeypatch):
    monkeypatch.setattr(windows, "MAX_RUNS", 2)
    rule = windows.rule_for(4)
    index = windows.FingerprintIndex(spark, rule, 8)
    parts = [[(i, words(30, i % 3))] for i in range(6)]
    removed = []
    for part in parts:
        df = repeats.keyed(spark.createDataFrame(part, "doc_id long, text string"), "doc_id", "text")
        out = repeats.finished(index.append(df), rule, "text", ["doc_id"], "n_words long, n_removed long, kept_sha256 string", windows.digests)
        removed.append(out.first()["n_removed"])
    assert removed == [0, 0, 0, 30, 30, 30] and len(index.runs) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_window_choice(values, width):
    h = np.array(values, np.uint64)
    from sheaf.llm.arrays import mix

    got = window_choice(h, width)
    key = (mix(h) >> np.uint64(24)).tolist()
    assert got.tolist() == [min(range(i, i + width), key=lambda j: (key[j], j)) for i in range(len(values) - width + 1)]
    assert distinct_sorted(got).tolist() == sorted(set(got.tolist()))


def test_text_blocks():
    column = pa.array(["ab", None, "", "cdé", "x" * 10])
    for block in (1, 3, 100):
        out = [bytes(d[o[i] : o[i + 1]]).decode() for a, b, d, o in text_blocks(column, block) for i in range(b - a)]
        assert out == ["ab", "", "", "cdé", "x" * 10]


# 9 pieces


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(public_tokenizers.path(pieces.MODEL))


PIECE_TEXT = st.text(alphabet="abcdeilnorst THE  \n019.,é中😀▁", max_size=120)


@settings(max_examples=100, deadline=None)
@given(st.lists(PIECE_TEXT, max_size=5), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_pieces_are_lossless(model, texts_, dropout):
    column = pa.array(texts_, pa.string())
    assert pieces.decode_column(model, pieces.encode_column(model, column, dropout)).to_pylist() == texts_


def test_pieces_like_the_library(model, texts):
    library_ = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    some = [t for t in texts if t is not None]
    assert pieces.encode_column(model, pa.array(some), 0.0).to_pylist() == library_.encode(some)


def test_pieces_heap(model, texts, monkeypatch):
    column = pa.array([t for t in texts if t is not None])
    want = pieces.encode_column(model, column, 0.3).to_pylist()
    monkeypatch.setattr(pieces, "LONG", 3)
    assert pieces.encode_column(model, column, 0.3).to_pylist() == want
    monkeypatch.setattr(pieces, "STEP", 40)
    assert pieces.encode_column(model, column, 0.3).to_pylist() == want


def test_dropout_by_document(model):
    """The first word of many texts is cut in many ways, and each of its merges is skipped somewhere."""
    word, n = "internationally", 2000
    got = pieces.encode_column(model, pa.array([f"{word} {i}" for i in range(n)]), 0.1).to_pylist()
    first = []
    for ids in got:
        k = next(k for k in range(1, len(ids) + 1) if len(pieces.decode_column(model, pa.array([ids[:k]], pa.list_(pa.int32()))).to_pylist()[0]) >= len(word))
        first.append(tuple(ids[:k]))
    assert len(set(first)) > 30

    plain = pieces.encode_column(model, pa.array([word]), 0.0).to_pylist()[0]
    assert 0.05 < sum(list(f) == plain for f in first) / n < 0.95


def test_pieces_vary(model):
    t = "international " * 60
    ids = pieces.encode_column(model, pa.array([t]), 0.3).to_pylist()[0]
    plain = pieces.encode_column(model, pa.array([t]), 0.0).to_pylist()[0]
    assert len(ids) > len(plain) and ids != pieces.encode_column(model, pa.array([t]), 0.3, seed=99).to_pylist()[0] and ids == pieces.encode_column(model, pa.array([t]), 0.3).to_pylist()[0]


def test_pieces_decide_late(model, monkeypatch):
    """An occurrence decides on a candidate when it is the next to merge, and on few others; agendas are shared until then."""
    asked, looked_up = [], []
    skipped, merges = pieces.skipped, pieces.Pieces.merges
    monkeypatch.setattr(pieces, "skipped", lambda key, place, dropout: (asked.append(len(place)), skipped(key, place, dropout))[1])
    monkeypatch.setattr(pieces.Pieces, "merges", lambda self, left, right: (looked_up.append(len(left)), merges(self, left, right))[1])
    texts_ = [words(200, i) for i in range(100)]
    ids = pieces.encode_column(model, pa.array(texts_), 0.1)
    merged = sum(len(t) + 1 for t in texts_) - len(ids.values)
    assert merged > 30_000
    assert sum(asked) < 1.5 * merged and sum(looked_up) < merged


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_text_hashes(some):
    data = np.frombuffer(b"".join(some), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int64)
    want = arrays.span_hash(arrays.prefix_hash(arrays.BYTE_VALUES[data]), offsets[:-1], offsets[1:])
    assert arrays.text_hashes(data, offsets).tolist() == want.tolist()


def test_pieces_frames(docs, texts, empty):
    out = by_id(pieces.decode(pieces.encode(docs)))
    assert {k: r["decoded"] for k, r in out.items()} == dict(enumerate(texts))
    assert all(r["lossless"] for r in pieces.encoded_and_checked(docs).collect())
    assert pieces.encode(empty).collect() == []


# pipeline and registered queries


CLASHES = ["_key", "_codes", "_windows", "_text", "_at", "_part", "tokens", "decoded", "lang_pred", "key", "c0", "c1", "TEXT", "part", "number", "_class", "class_id", "row", "removed", "spans"]


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_clashing_columns_keep_their_values(spark, texts, ids):
    """Every operator and stage that keeps columns, on a table with columns of all names that are made inside."""
    spark.conf.set("spark.sql.caseSensitive", "false")
    some = texts[:10]
    rows_ = [(i if ids == "unique" else i // 2, t, "en", "s", len(t or ""), *(f"{c}-{i}" for c in CLASHES)) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows_, ["doc_id", "text", "lang", "source", "n_chars", *(f"x{i}" for i in range(len(CLASHES)))]).toDF("doc_id", "text", "lang", "source", "n_chars", *CLASHES)
    bench = spark.createDataFrame([(1, words(60, 2), "b"), (2, "zz yy", "b")], "item_id long, text string, key string")
    model_ = language.fit(df)
    made = {
        "near": near.deduplicated(df), "suffixes": suffixes.cleaned(df), "windows": windows.cleaned(df), "confident": language.confident(df, model_),
        "decontaminate": decontaminate.cleaned(df, bench), "blocks": decontaminate.cleaned(df, bench, block_bytes=30),
        "encode": pieces.encode(df), "decode": pieces.decode(pieces.encode(df), tokens="tokens_"),
    }
    made |= {name: stage(spark, df, DATA) for name, stage in corpus_pipeline.STAGES[:-1] if name != "substrings"}
    values = {r[5]: tuple(r[5:]) for r in rows_}
    for name, out in made.items():
        assert out.columns[: len(df.columns)] == df.columns, name
        got = [tuple(r)[5 : len(df.columns)] for r in out.collect()]
        assert got and all(values[g[0]] == g for g in got), name
        assert len(got) == len(some) or name in ("near", "confident", "decontaminate", "blocks", "language", "near_duplicates", "decontamination"), name
    assert made["encode"].columns[-1] == "tokens_" and made["decode"].columns[-2:] == ["tokens_", "decoded_"]
    assert sorted(map(str, (r[-1] for r in made["decode"].collect()))) == sorted(map(str, some))
    for out in (tokens.token_counts(df), near.near_classes(df), sharding.shard(df, 3), language.predictions(df, model_), decontaminate.contamination(df, bench), fingerprint.with_next(df), suffixes.judged(df), windows.judged(df), pieces.encoded_and_checked(df)):
        assert len(out.collect()) == len(some)
    taken = ["page_id", "url", "host", "path", "label", "fold", "score", "_rule", "_suffix", "_domain", "_section", "_yes", "_n"]
    urls_ = df.toDF(*taken, *(f"h{i}" for i in range(len(df.columns) - len(taken))))
    assert len(urls.classify(urls_).collect()) == len(some)


def test_language_samples_distinct_texts(spark):
    """A group of copies counts once, rare languages stay, and the number of rows is bounded."""
    common = [("en", f"the {words(8, i)} and") for i in range(600)]
    for seed in range(3):
        rows_ = [("en", words(20, seed))] * 8000 + common + [("fr", f"le la les des une {i} bonjour") for i in range(20)]
        df = spark.createDataFrame(rows_, "lang string, text string").repartition(7)
        got = language.training_rows(df, "text", "lang", 200).collect()
        n = {k: len({r["key"] for r in got if r["lang"] == k}) for k in ("en", "fr")}
        assert n == {"en": 200, "fr": 40} and len(got) == 240
    assert set(language.fit(df, max_training=200).languages) == {"en", "fr"}
    alone = spark.createDataFrame([("en", "one text of many copies")] * 8000, "lang string, text string").repartition(4)
    assert len(language.training_rows(alone, "text", "lang", 3000).collect()) == 2 and language.fit(alone).languages == ["en"]


def test_url_sample_and_held_out_rules(spark):
    same = spark.createDataFrame([(i, "http://a.org/x") for i in range(3000)] + [(i, f"http://b.com/de/{i}") for i in range(40)], "page_id long, url string")
    assert {(r["host"], r["verdict"]) for r in urls.classify(same, max_training=30).collect()} == {("a.org", "allow"), ("b.com", "block")}
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = urls.classify(pages, held_out=True).filter(f"rule is not null and fold = {urls.FOLDS - 1}")
    by = {r["rule"]: (r["n"], r["right"] / r["n"]) for r in out.groupBy("rule").agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 0.5) == (F.col("verdict") == "allow")).alias("right")).collect()}
    assert all(share > 0.8 for n, share in by.values() if n >= 20)


def test_fingerprints_without_unique_ids(spark):
    df = spark.createDataFrame([(None, "Same"), (None, "same "), (3, "SAME"), (3, "other"), (3, "Other"), (4, None), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_chars"], r["group_id"], r["copies"]) for r in fingerprint.with_next(df).collect()), key=repr)
    assert got == sorted([(0, 4, None, 3), (0, 5, None, 3), (3, 4, None, 3), (3, 5, 3, 2), (3, 5, 3, 2), (4, 0, 4, 2), (4, 0, 4, 2)], key=repr)


def test_canonical_form():
    """Against a plain reading of the definition, character class by character class."""
    import unicodedata

    for text, want in (("  A\t\nb ", "a b"), ("ﬁ Ｆｕｌｌ", "fi full"), ("Straße", "strasse"), ("a\u0301", "á"), ("Å", "å"), ("x\u00a0\u2003y", "x y"), ("①½", "11⁄2"), ("", ""), ("\u3000", "")):
        assert fingerprint.canonical(text) == want and fingerprint.canonical(unicodedata.normalize("NFD", text)) == want
        assert fingerprint.fingerprint(text) == xxhash.xxh3_128_hexdigest(want.encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(PIECE_TEXT, min_size=1, max_size=4), st.sampled_from([0.1, 0.4]))
def test_dropout_agenda_by_brute_force(model, texts_, dropout):
    """Each segment by the plain agenda: among all adjacent pairs that merge and are not skipped, the best rank, the leftmost first."""
    spelt = {bytes(model.spelt[model.spelt_at[i] : model.spelt_at[i + 1]]): i for i in range(model.size)}
    for text, got in zip(texts_, pieces.encode_column(model, pa.array(texts_), dropout).to_pylist(), strict=True):
        want = []
        raw = text.encode()
        whose = int(pieces.span_hash(pieces.prefix_hash(pieces.BYTE_VALUES[np.frombuffer(raw, np.uint8)]), np.array([0]), np.array([len(raw)]))[0]) if raw else 0
        segments = [m[0] for m in re.finditer(r"^ +[^ ]*|^[^ ]+| +[^ ]*", text)]
        for k, segment in enumerate(segments):
            marked = (" " if k == 0 else "") + segment
            variant = pieces.mixed(whose ^ pieces.mixed(k + pieces.SEED * 0x9E3779B97F4A7C15 & pieces.MASK))
            key = pieces.mixed(variant + (pieces.SEED * 0xD1B54A32D192ED03 & pieces.MASK) & pieces.MASK)
            chars = [pieces.LITERAL_MARK if c == "\u2581" else pieces.MARK if c == " " else ord(c) for c in marked]
            symbols, edges, skips = [int(model.symbol_of[c]) for c in chars], list(range(len(chars) + 1)), {}
            while True:
                best = None
                for i in range(len(symbols) - 1):
                    place = edges[i], edges[i + 1], edges[i + 2]
                    found = model.pairs.get(symbols[i] << 32 | symbols[i + 1])
                    if found and place not in skips:
                        skips[place] = pieces.mixed(key ^ pieces.mixed(place[0] << 42 ^ place[1] << 21 ^ place[2])) >> 11 < dropout * (1 << 53)
                    if found and not skips[place] and (best is None or found[0] < best[0]):
                        best = found[0], i, found[1]
                if best is None:
                    break
                symbols[best[1] : best[1] + 2] = [best[2]]
                del edges[best[1] + 1]
            for s, a, b in zip(symbols, edges, edges[1:], strict=False):
                piece = "".join("\u2581" if c == pieces.LITERAL_MARK else " " if c == pieces.MARK else chr(c) for c in chars[a:b]).encode()
                want += [s] if s < model.size else [int(model.byte_ids[x]) for x in ("\u2581".encode() if piece == b" " and chars[a] == pieces.MARK and b"" not in spelt and s >= model.size else piece)]
        assert got == want


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    whole = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    classes = brute_classes(whole)
    ids = {r["doc_id"] for r in out}
    assert len(ids) == len(out) and all(r["lossless"] for r in out)
    assert ids <= {k for k, c in classes.items() if k == c} and len(ids) >= 0.95 * len(set(classes.values()))


def test_stages_by_brute_force(spark):
    """Every stage against brute force on its own input, the whole small fixture with passages of the benchmark put in."""
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    more = spark.createDataFrame([(10_000 + i, f"{words(25, 900 + i)} {t} {words(25, 950 + i)}", "en", "s", 1) for i, (_, t) in enumerate(items[:12])], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.unionByName(more.select(*[F.col(f.name).cast(f.dataType) for f in base.schema])).cache()
    stages, pairs = dict(corpus_pipeline.STAGES), lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = stages["language"](spark, docs, DATA).cache()
    model_ = language.fit(docs.filter(~language.held_out("doc_id")))
    judged = {r["doc_id"] for r in language.predictions(docs, model_, keep=["doc_id"]).filter("not rejected").collect()}
    assert set(pairs(kept)) == judged and len(judged) > 150

    first = stages["near_duplicates"](spark, kept, DATA).cache()
    classes = brute_classes([*pairs(kept).items()])
    assert pairs(first) == {k: pairs(kept)[k] for k, c in classes.items() if k == c}

    cut = stages["substrings"](spark, first, DATA).cache()
    want = brute_words([*pairs(first).items()], 20)
    got = pairs(cut)
    assert set(got) == {k for k, (n, removed, _) in want.items() if n > removed}
    assert all(hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)).encode()).hexdigest() == want[k][2] for k, t in got.items())

    clean = stages["decontamination"](spark, cut, DATA).cache()
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for _, t in items:
        w = norm(t)
        n = min(10, len(w))
        wins[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    least, expected = min([10, *wins]), {}
    for k, t in got.items():
        w = norm(t)
        hit = [False] * len(w)
        for n, some in wins.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in some:
                    hit[i : i + n] = [True] * n
        runs = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[h] for h in hit)) if m.end() - m.start() >= least]
        if sum(b - a for a, b in runs) <= decontaminate.MAX_COVERAGE * len(w):
            expected[k] = [x for i, x in enumerate(w) if not any(a <= i < b for a, b in runs)]
    assert {k: norm(t) for k, t in pairs(clean).items()} == expected and any(len(norm(got[k])) > len(v) for k, v in expected.items())

    encoded = {r["doc_id"]: r for r in stages["encoding"](spark, clean, DATA).collect()}
    column = pa.array([encoded[k]["tokens"] for k in sorted(encoded)], pa.list_(pa.int32()))
    back = pieces.decode_column(pieces.pieces(public_tokenizers.path(pieces.MODEL)), column).to_pylist()
    assert dict(zip(sorted(encoded), back, strict=True)) == pairs(clean) and all(r["n_tokens"] == len(r["tokens"]) and r["lossless"] for r in encoded.values())


def test_stages_on_edge_cases(spark, docs, empty):
    """Nulls, empty texts, ties, repeats, clashing columns; and no rows at all."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, DATA)
        assert out.collect() == [] and (name == "encoding" or out.columns == empty.columns)
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, DATA)
    got = df.collect()
    assert len(got) == len({r["doc_id"] for r in got}) > 3 and all(r["lossless"] for r in got)


def test_stages_keep_columns(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, DATA)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("release", ["true", "false"])
def test_checkpoint_drops_its_shuffle_files(spark, release):
    """They go with the query, not when the JVM happens to collect garbage; what else reads the plan makes them again."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.toString() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if "shuffle_" in f.toString()}
    spark.conf.set("spark.sheaf.release", release)
    try:
        before = files()
        counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        kept = spaces.checkpoint(counted)
        end = time.time() + 10
        while release == "true" and files() - before and time.time() < end:
            time.sleep(0.1)
        assert bool(files() - before) == (release == "false")
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, counted.collect()))
        assert spark.conf.get(spaces.ENDS_WITH_QUERY) == "false"
    finally:
        spark.conf.unset("spark.sheaf.release")


def test_workers_give_freed_memory_back():
    """Freed arrays under one that stays are what the C library keeps of its own accord."""

    def resident():
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024

    stays = []

    def run(batches):
        for batch in batches:
            blocks = [np.ones(1 << 12) for _ in range(4000)]  # 125 MB, in blocks too small for mappings of their own
            stays.append(blocks[-1])
            del blocks
            yield batch

    before = resident()
    assert list(arrays.tidied(run)(iter([1]))) == [1]
    assert resident() - before < 60


def test_encoding_needs_little_memory():
    """Work arrays are as long as a block; those that are done with go before others are made."""
    model = pieces.pieces(public_tokenizers.path(pieces.MODEL))
    column = pa.array([words(1200, i) for i in range(256)])
    pieces.encode_column(model, column.slice(0, 1))
    tracemalloc.start()
    try:
        pieces.encode_column(model, column)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 110
