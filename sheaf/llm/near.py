"""Operator 2: near-duplicate classes by Order MinHash, verified by banded alignment.

The k-mers are runs of SHINGLE words, labelled by their occurrence in the text (the first,
second, ... time that they appear), so that repeats count. Each of SKETCHES sketches takes the
LEAST labelled k-mers of smallest hash and keeps them in the order in which they stand in the
text: documents that share a sketch are likely to be close in edit distance, not only to have
common words. Documents that share one are candidates.

A candidate pair is verified by aligning both sequences of k-mers: with m k-mers matched in
order, the similarity is m / (a + b - m), and at THRESHOLD it is a near-duplicate. The band
of the alignment is as wide as that threshold lets the alignment stray, so it is exact.

Texts with equal words, told by a cryptographic digest of 128 bits of them, are one text from the
start, so copies are never compared. In a bucket
of a sketch every text meets two leaders (the least key and the least hashed key), not every
other text. That only saves comparisons: in a bucket that is still of more than one
component, matched members too, the pairs of different components are compared in blocks, see
`rest_links`, so no similar pair that shares a bucket is left apart. Classes are the
connected components of the verified links, found by alternating large and small stars with
checkpoints. A bucket's leaders are pre-aggregated and its members joined to them, which Spark
splits when a bucket is large.

Defined results: texts without words (null, empty, white space) are classes of their own;
texts of fewer words than a k-mer have one k-mer, all their words; repeated rows are copies;
equal or null doc_ids are told apart by their texts; an empty table gives an empty result;
columns may have any names, also those that are made here;
other columns are ignored by `classes` and kept by `deduplicated`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BYTE_VALUES, mix, prefix_hash, span_hash, text_blocks, tidied, word_spans
from .columns import box, boxed
from .repeats import keyed, unique_ids
from .spaces import checkpoint, release
from .squeeze import squeezed, texts_of

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, LEAST = 10, 2
#: Words, and texts at most, of a chunk of a bucket's rest; they decide on work only, as the two below do.
CHUNK, CHUNK_TEXTS = 150_000, 1000
#: Pairs of a k-mer up to which they are counted one by one, and columns of a matrix product.
FEW, COLUMNS = 64, 4096
#: Matches for each k-mer from which on an alignment is filled row by row.
DENSE = 16
#: Pairs of a cell up to which they are counted one by one.
SMALL_CELL = 200
SEPARATORS = b" \t\n\v\f\r"
IS_WORD = np.ones(256, np.bool_)
IS_WORD[list(SEPARATORS)] = False


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hashes, their offsets by document, word counts) of a block."""
    starts, ends, at = word_spans(data, offsets, IS_WORD)
    words = prefix_hash(span_hash(prefix_hash(BYTE_VALUES[data]), starts, ends))
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate(([0], np.cumsum(count)))
    begin = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], count)
    return span_hash(words, begin, np.minimum(begin + k, np.repeat(at[1:], count))), to, n


def word_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Cryptographic digests of the documents' words: only texts of equal words have equal ones, however they are made."""
    starts, _, at = word_spans(data, offsets, IS_WORD)
    keep = IS_WORD[data]
    later = np.ones(len(starts), np.bool_)
    later[at[:-1][np.diff(at) > 0]] = False
    keep[starts[later] - 1] = True  # one separator between words
    raw = np.where(IS_WORD[data], data, np.uint8(0x20))[keep].tobytes()
    to = np.concatenate(([0], np.cumsum(keep)))[offsets].tolist()
    return [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(to[:-1], to[1:], strict=True)]


def labelled_kmers(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers with their occurrence in the document; a document has each once."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = grams ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(same, kind="stable")
    new = np.concatenate(([True], same[order][1:] != same[order][:-1]))
    first = np.flatnonzero(new)
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = np.arange(len(grams)) - first[np.cumsum(new) - 1]
    return mix(grams + occurrence * np.uint64(0xA0761D6478BD642F))


def order_sketches(grams: np.ndarray, at: np.ndarray, sketches: int = SKETCHES, least: int = LEAST) -> np.ndarray:
    """A row of sketches for each document that has k-mers."""
    sizes = np.diff(at)
    heads = at[:-1][sizes > 0]
    labelled = labelled_kmers(grams, at)
    bits = np.uint64(max(18, len(grams).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(grams), dtype=np.uint64)
    out = np.empty((len(heads), sketches), np.uint64)
    for j in range(sketches):
        packed = (mix(labelled ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1)) & ~low) | place
        chosen = np.empty((len(heads), least), np.int64)
        for i in range(least):
            found = np.minimum.reduceat(packed, heads)
            chosen[:, i] = np.where(found < ~low, found & low, chosen[:, i - 1].astype(np.uint64) if i else found & low)
            packed[chosen[:, i]] = ~np.uint64(0)
        chosen.sort(axis=1)  # as they stand in the text
        value = np.full(len(heads), j + 1, np.uint64)
        for i in range(least):
            value = mix(value * np.uint64(0xE7037ED1A0B428DB) + grams[chosen[:, i]])
        out[:, j] = value
    return out


def matched(a: np.ndarray, b: np.ndarray, needed: int) -> int:
    """Length of the longest common subsequence of two k-mer sequences, or 0 if it is under `needed`; exact.

    From the alignment's end, `needed` bounds how far the places of matched k-mers stray: by so
    many that one text has and the other can do without. Matches inside that band are put in order
    one by one, or, where repeated k-mers make very many, the band is filled row by row.
    """
    if min(len(a), len(b)) < needed:
        return 0
    # what is equal at both ends matches
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    head = int(other[0]) if len(other) else n
    other = np.flatnonzero(a[head:][::-1][: n - head] != b[head:][::-1][: n - head])
    tail = int(other[0]) if len(other) else n - head
    if head + tail:
        m = head + tail + (matched(a[head : len(a) - tail], b[head : len(b) - tail], max(0, needed - head - tail)) if n > head + tail else 0)
        return m if m >= needed else 0
    low, high = -(len(a) - needed), len(b) - needed
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    first, last = np.searchsorted(sorted_b, a, "left"), np.searchsorted(sorted_b, a, "right")
    n = last - first
    ends = np.cumsum(n)
    if ends[-1] > DENSE * (len(a) + len(b)):
        return banded(a, b, needed, low, high)
    # the matches of each place in a, those in b from the last to the first, so that a rising run has one of each
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(last - 1 + ends - n, n) - np.arange(ends[-1])]
    inside = (j - i >= low) & (j - i <= high)
    places = j[inside]
    m = rising(places)
    return m if m >= needed else 0


def rising(places: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if (np.diff(places) > 0).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        t = bisect_left(tails, p)
        tails[t : t + 1] = [p]
    return len(tails)


def banded(a: np.ndarray, b: np.ndarray, needed: int, low: int, high: int) -> int:
    """matched, by all diagonals j - i = low .. high."""
    previous = np.zeros(high - low + 2, np.int32)  # over the diagonals, and one in front
    for i in range(len(a)):
        j = np.arange(low, high + 1) + i
        inside = (j >= 0) & (j < len(b))
        equal = np.zeros(len(j), np.bool_)
        equal[inside] = b[j[inside]] == a[i]
        # (i-1, j) is the next diagonal; (i-1, j-1) the same one; (i, j-1) the one before
        above = np.append(previous[2:], 0)
        current = np.maximum(above, previous[1:] + equal)
        current[j < 0] = 0
        previous[1:] = np.maximum.accumulate(current)
    most = int(previous.max())
    return most if most >= needed else 0


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """m / (a + b - m) for m k-mers matched in order; 0 if it is under the threshold."""
    total = len(a) + len(b)
    needed = int(np.ceil(threshold * total / (1 + threshold) - 1e-9))
    m = matched(a, b, max(1, needed))
    return m / (total - m) if m else 0.0


def alike(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the similarity is at least the threshold; exact, by bounds where they suffice.

    No more k-mers match in order than both texts have, and those of equal labels, in order, do match.
    """
    total = len(a) + len(b)
    needed = max(1, int(np.ceil(threshold * total / (1 + threshold) - 1e-9)))
    if min(len(a), len(b)) < needed:
        return False
    first, second = (labelled_kmers(x, np.array([0, len(x)])) for x in (a, b))
    both, x, y = np.intersect1d(first, second, assume_unique=True, return_indices=True)
    if len(both) < needed:
        return False
    return rising(y[np.argsort(x)]) >= needed or matched(a, b, needed) > 0


def sketched(docs: DataFrame, text_column: str, shingle: int, sketches: int) -> DataFrame:
    """_key, digest of the words, number of words, and sketches (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(1)):
                grams, at, n = shingles(data, offsets, shingle)
                some = np.diff(at) > 0
                values = order_sketches(grams, at, sketches) if some.any() else np.zeros((0, sketches), np.uint64)
                ends = np.concatenate(([0], np.cumsum(some) * sketches)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(word_digests(data, offsets), pa.binary()), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64)))],
                    ["_key", "_digest", "_words", "_sketches"],
                )

    return docs.select("_key", text_column).mapInArrow(tidied(run), "_key long, _digest binary, _words long, _sketches array<long>")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """pairs (leader, member) with whether they are near-duplicates; texts has _key and compressed _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kept: dict[bytes, np.ndarray] = {}

        def grams(z: bytes) -> np.ndarray:
            found = kept.get(z)
            if found is None:
                if len(kept) > 16:
                    kept.clear()
                data = np.frombuffer(unpack(z), np.uint8)
                found = kept[z] = shingles(data, np.array([0, len(data)]), shingle)[0]
            return found

        for batch in batches:
            near = [alike(grams(a.as_py()), shingles_of(b.as_py(), unpack, shingle), threshold) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["leader", "member", "near"])

    with_member = pairs.join(texts.select(F.col("_key").alias("member"), F.col("_text").alias("b")), "member")
    with_both = with_member.join(texts.select(F.col("_key").alias("leader"), F.col("_text").alias("a")), "leader")
    return with_both.select("leader", "member", "a", "b").mapInArrow(tidied(run), "leader long, member long, near boolean")


def shingles_of(z: bytes, unpack, shingle: int) -> np.ndarray:
    data = np.frombuffer(unpack(z), np.uint8)
    return shingles(data, np.array([0, len(data)]), shingle)[0]


def rest_links(buckets: DataFrame, content: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (u, v) that join different components of a bucket, exact but for links that others make needless.

    buckets has a row for each member of each sketch's bucket: _key, comp, words, band, sketch,
    and all_met, the members up to which the leaders' pairs are all pairs. In a bucket of several
    components every text outside the one with most words (the strays) meets every text of
    another component, as blocks: both sides are cut into chunks of about CHUNK words, and a
    cell of two chunks is worked on by one task, which counts the common labelled k-mers of all
    its pairs by a matrix product and aligns those that have enough, until its components are one.
    So no pair is ever a row, and no task has more than two chunks of a bucket.
    """
    weight = F.col("words") + CHUNK // CHUNK_TEXTS
    of_comp = buckets.groupBy("band", "sketch", "comp").agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min("all_met").alias("all_met"))
    split = of_comp.groupBy("band", "sketch").agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("comps"), F.min("all_met").alias("all_met"))
    split = split.filter("comps > 1 and n > all_met")
    split = checkpoint(split.select("band", "sketch", F.col("top.comp").alias("major"), F.ceil(F.col("w") / CHUNK).alias("chunks"), F.ceil((F.col("w") - F.col("top.w")) / CHUNK).alias("stray_chunks")))
    inside = buckets.join(split, ["band", "sketch"])
    mine, stray = F.pmod(F.xxhash64("_key"), "chunks"), F.pmod(F.xxhash64("_key", F.lit(1)), "stray_chunks")

    def cells(i, j, as_stray: bool):
        return F.struct(F.xxhash64("band", "sketch", i, j).alias("cell"), F.lit(as_stray).alias("stray"))

    to_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("stray_chunks") - 1), lambda j: cells(mine, j, False))
    to_strays = F.when(F.col("comp") != F.col("major"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda i: cells(i, stray, True))).otherwise(F.array().cast("array<struct<cell:bigint,stray:boolean>>"))
    placed = checkpoint(inside.select("_key", "comp", "words", F.explode(F.concat(to_all, to_strays)).alias("at")).select("_key", "comp", "words", "at.*"))
    groups = int((placed.agg(F.sum("words")).first()[0] or 0) // CHUNK) + 1
    rows = placed.join(content, "_key").select(F.pmod("cell", F.lit(groups)).alias("group"), "cell", "stray", "_key", "comp", "_text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell").combine_chunks()
        # a text that is in several cells is taken apart once
        keys, once, text = np.unique(table["_key"].to_numpy(), return_index=True, return_inverse=True)
        parts = [shingles(data, offsets, shingle)[:2] for _, _, data, offsets in text_blocks(texts_of(table["_text"].take(pa.array(once)).combine_chunks()))]
        grams = np.concatenate([g for g, _ in parts] or [np.zeros(0, np.uint64)])
        at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(to) for _, to in parts] or [np.zeros(0, np.int64)]))))
        kmers = labelled_kmers(grams, at) if len(grams) else grams
        kmers = kmers[np.lexsort((kmers, np.repeat(np.arange(len(keys)), np.diff(at))))]
        comp_of = table["comp"].to_numpy()[once]
        cell, stray = table["cell"].to_numpy(), table["stray"].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        found: set[tuple[int, int]] = set()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = text[a:b]
            links = cell_links(mine[stray[a:b]], mine[~stray[a:b]], comp_of, grams, kmers, at, threshold)
            found.update((max(keys[i], keys[j]), min(keys[i], keys[j])) for i, j in links)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return rows.groupBy("group").applyInArrow(run, "u long, v long").distinct()


def cell_links(strays: np.ndarray, others: np.ndarray, comp_of: np.ndarray, grams: np.ndarray, kmers: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The links of one cell, as pairs of texts: strays and others are numbers of texts, kmers are sorted within each text."""
    if not len(strays) or not len(others):
        return []
    sizes = np.diff(at)
    a, b = sizes[strays][:, None], sizes[others][None, :]
    needed = np.ceil(threshold * (a + b) / (1 + threshold) - 1e-9)
    x, y = np.nonzero((np.minimum(a, b) >= needed) & (comp_of[strays][:, None] != comp_of[others][None, :]))
    if not len(x):
        return []
    if len(x) <= SMALL_CELL:
        common = np.array([common_count(kmers[at[i] : at[i + 1]], kmers[at[j] : at[j + 1]]) for i, j in zip(strays[x].tolist(), others[y].tolist(), strict=True)])
    else:
        common = common_counts(kmers, at, strays, others)[x, y]
    enough = np.flatnonzero(common >= needed[x, y])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for k in enough[np.argsort(-common[enough], kind="stable")].tolist():
        i, j = int(strays[x[k]]), int(others[y[k]])
        p, q = find(int(comp_of[i])), find(int(comp_of[j]))
        if p != q and alike(grams[at[i] : at[i + 1]], grams[at[j] : at[j + 1]], threshold):
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays without repeats share."""
    place = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(place, len(b) - 1)] == a))


def common_counts(kmers: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many k-mers each text of left shares with each of right; a text has each k-mer once."""
    rows = []
    for side in (left, right):
        n = np.diff(at)[side]
        ends = np.cumsum(n)
        rows.append((np.repeat(np.arange(len(side)), n), kmers[np.arange(ends[-1]) - np.repeat(ends - n - at[side], n)]))
    _, column = np.unique(np.concatenate([k for _, k in rows]), return_inverse=True)
    (lr, lc), (rr, rc) = (rows[0][0], column[: len(rows[0][0])]), (rows[1][0], column[len(rows[0][0]) :])
    width = int(column.max()) + 1 if len(column) else 0
    nl, nr = np.bincount(lc, minlength=width), np.bincount(rc, minlength=width)
    out = np.zeros(len(left) * len(right), np.float32)
    order = np.argsort(rc, kind="stable")
    first = np.concatenate(([0], np.cumsum(nr)))
    # k-mers of few pairs one by one
    few = nl * nr <= FEW
    some = few[lc] & (nr[lc] > 0)
    n = nr[lc[some]]
    ends = np.cumsum(n)
    whose = order[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first[lc[some]], n)]
    if len(whose):
        out += np.bincount(np.repeat(lr[some], n) * len(right) + rr[whose], minlength=len(out)).astype(np.float32)
    out = out.reshape(len(left), len(right))
    # the others by matrix products
    many = np.flatnonzero(~few)
    number = np.full(width, -1)
    number[many] = np.arange(len(many))
    for a in range(0, len(many), COLUMNS):
        sides = []
        for r, c, n_ in ((lr, number[lc], len(left)), (rr, number[rc], len(right))):
            inside = (c >= a) & (c < a + COLUMNS)
            x = np.zeros((n_, min(COLUMNS, len(many) - a)), np.float32)
            x[r[inside], c[inside] - a] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (u, v): alternating large and small stars, each round checkpointed."""
    edges = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    while True:
        # it is done when every node has one edge, to a node that has none
        again = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u").unionByName(edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi"))
        if not again.limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpoint(large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct())


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxed docs with `_key`; _key, _head and _class of every document; the links (u, v).

    _head is the least key of the documents of equal words, _class the least key of its class;
    links are the verified pairs of different heads.
    """
    spark = docs.sparkSession
    text_column, id_column, docs = box(docs, text_column), box(docs, id_column), boxed(docs)
    docs = keyed(docs, id_column, text_column)
    rows = checkpoint(sketched(docs, text_column, shingle, sketches))
    # texts of equal words: one representative
    # aggregates that large groups are joined with are checkpointed, for Spark splits such a group only between plain shuffles
    heads = checkpoint(rows.filter("_words > 0").groupBy("_digest", "_words").agg(F.min("_key").alias("_head")))
    texts = checkpoint(rows.join(heads, ["_digest", "_words"]).select("_key", "_head", "_words", "_sketches"))
    members = texts.filter("_key = _head").select("_key", F.col("_words").alias("words"), F.posexplode("_sketches").alias("band", "sketch"))
    mixed = F.struct(F.xxhash64("_key").alias("h"), "_key")
    leaders = checkpoint(members.groupBy("band", "sketch").agg(F.min("_key").alias("l1"), F.min(mixed)["_key"].alias("l2"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    met = checkpoint(members.join(leaders, ["band", "sketch"]))
    pairs = met.select("_key", F.explode(F.array("l1", "l2")).alias("leader")).filter("_key <> leader").select(F.greatest("leader", "_key").alias("member"), F.least("leader", "_key").alias("leader")).distinct()
    content = checkpoint(squeezed(docs.select("_key", F.col(text_column).alias("_text")), "_text").join(met.select("_key").distinct(), "_key"))
    release(spark)
    judged = checkpoint(verified(pairs, content, shingle, threshold))
    links = judged.filter("near").select(F.col("member").alias("u"), F.col("leader").alias("v"))
    roots = components(links)
    # the rest: buckets of more than one component in which the leaders' pairs are not all pairs
    placed_in = checkpoint(met.join(roots.withColumnRenamed("node", "_key"), "_key", "left").select("_key", F.coalesce("root", "_key").alias("comp"), "words", "band", "sketch", F.expr("IF(l1 <> l2, 3, 2)").alias("all_met")))
    found = checkpoint(rest_links(placed_in, content, shingle, threshold))
    release(spark)
    if found.limit(1).count():
        links = links.unionByName(found)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
    named = texts.select("_key", "_head").join(roots, F.col("_head") == roots["node"], "left").select("_key", "_head", F.coalesce("root", "_head").alias("_class"))
    placed = rows.select("_key").join(named, "_key", "left").select("_key", F.coalesce("_head", "_key").alias("_head"), F.coalesce("_class", "_key").alias("_class"))
    return docs, placed, links


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size, n_links and kept (it is the class's first) of every document.

    n_links counts the verified links of the document's text with different texts, one for each
    text, however many copies there are; pairs of one class that were not compared don't count.
    """
    with_keys, placed, links = classes(docs, id_column, text_column)
    placed = checkpoint(placed)
    sizes = checkpoint(placed.groupBy("_class").agg(F.count("*").alias("class_size")))
    degrees = checkpoint(links.select(F.explode(F.array("u", "v")).alias("_head")).groupBy("_head").agg(F.count("*").alias("n_links")))
    out = placed.join(sizes, "_class").join(degrees, "_head", "left").select("_key", "_class", "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    kept = (F.col("_key") == F.col("_class")).alias("kept")
    id_column = box(docs, id_column)
    if unique_ids(with_keys, id_column):
        kind = with_keys.schema[id_column].dataType
        return out.select(F.col("_key").cast(kind).alias("doc_id"), F.col("_class").cast(kind).alias("class_id"), "class_size", "n_links", kept)
    names = with_keys.select("_key", F.col(id_column).alias("doc_id"))
    return out.join(names, "_key").join(names.select(F.col("_key").alias("_class"), F.col("doc_id").alias("class_id")), "_class").select("doc_id", "class_id", "class_size", "n_links", kept)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, all their columns, with the first document of each class only."""
    with_keys, placed, _ = classes(docs, id_column, text_column)
    gone = checkpoint(placed.filter("_key <> _class").select("_key"))
    return with_keys.join(gone, "_key", "left_anti").drop("_key").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all documents."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
