"""Operator 6: benchmark decontamination with a generalised suffix automaton.

The normalised test items become one generalised suffix automaton over word numbers. The
words of each document stream through it; the length of the longest match that ends at a
word tells which windows of the items occur there. Only stretches of a document whose
adjacent word pairs all occur in items are streamed, for no other word can lie in a window
of two words or more; the pairs are found with numpy.

Items are normalised as documents are: A-Z lower-cased, words are runs of ASCII digits and
letters and of all characters above ASCII. A window is `window` consecutive words of an item;
an item of fewer words, but not none, is one window.

The automaton goes to the executors as a broadcast, only for blocks of about BLOCK_BYTES of item
text: a larger test set is cut into blocks, one after the other, each with a pass over the
documents. Hits of all blocks are on the documents' own texts and are united by row, so results
don't depend on the blocks. Of an automaton the executors hold sorted arrays: its transitions,
suffix links and lengths, and the items of each window's state.

Defined results: null texts have no words and no hits; null items, and items without words,
have no windows; equal items all count, but an item_id once, however many rows it has; a null
item_id is counted as one item and left out of the joined ids; repeated documents, and those of equal or null ids, stay
rows of their own and are treated alike; with empty tables no document is hit; other columns,
whatever their names, are ignored by the contract's query and kept by `cleaned`.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_VALUES, prefix_hash, span_hash, text_blocks, tidied, word_spans
from .columns import boxed, named
from .numbering import row_numbers
from .repeats import keyed
from .spaces import checkpoint

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: Items of more text than this are cut in pieces that overlap by window - 1 words; `longest` sees no further than a piece.
ITEM_BYTES = 1 << 20
#: Spans longer than this many words are cut out; documents hit beyond this share are dropped.
MIN_SPAN, MAX_COVERAGE = 10, 0.8

IS_WORD = np.zeros(256, np.bool_)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Automaton:
    """A generalised suffix automaton over the word numbers of items (id, words)."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: list[object] = []
        number: dict[bytes, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        #: Transitions while building: by state and word number; and as a list for each state, to copy them.
        to: dict[int, int] = {}
        newest, word_of, before = array("i", [-1]), array("i"), array("i")

        def state(length: int) -> int:
            self.link.append(0)
            self.length.append(length)
            newest.append(-1)
            return len(self.link) - 1

        def connect(p: int, c: int, q: int) -> None:
            if (key := p << 32 | c) not in to:
                word_of.append(c)
                before.append(newest[p])
                newest[p] = len(word_of) - 1
            to[key] = q

        def clone(p: int, c: int, q: int) -> int:
            new = state(self.length[p] + 1)
            e = newest[q]
            while e >= 0:
                connect(new, word_of[e], to[q << 32 | word_of[e]])
                e = before[e]
            self.link[new], self.link[q] = self.link[q], new
            while p >= 0 and to.get(p << 32 | c) == q:
                to[p << 32 | c] = new
                p = self.link[p]
            return new

        def extend(last: int, c: int) -> int:
            found = to.get(last << 32 | c)
            if found is not None:
                return found if self.length[found] == self.length[last] + 1 else clone(last, c, found)
            new = state(self.length[last] + 1)
            p = last
            while p >= 0 and p << 32 | c not in to:
                connect(p, c, new)
                p = self.link[p]
            if p >= 0:
                q = to[p << 32 | c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else clone(p, c, q)
            return new

        flat, ends = array("i"), array("q", [0])
        for name, words in items:
            self.ids.append(name)
            last = 0
            for w in words:
                c = number.setdefault(w, len(number))
                flat.append(c)
                last = extend(last, c)
            ends.append(len(flat))
        keys, targets = np.fromiter(to.keys(), np.int64, len(to)), np.fromiter(to.values(), np.int32, len(to))
        to.clear()
        order = np.argsort(keys)
        self.keys, self.targets = array("q", keys[order].tobytes()), array("i", targets[order].tobytes())
        seq, sizes = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.diff(np.frombuffer(ends, np.int64))
        self.short_lengths = sorted({int(n) for n in sizes if 0 < n < window})
        #: Numbers of words that stand together, for a first look; and the words.
        inner = np.ones(max(0, len(seq) - 1), np.bool_)
        edges = np.frombuffer(ends, np.int64)[1:-1]
        inner[edges[(edges > 0) & (edges < len(seq))] - 1] = False
        self.pairs = np.unique(((seq[:-1].astype(np.int64) << 32) | seq[1:])[inner])
        words = [*number]
        self.blob, self.blob_at = b"".join(words), array("q", np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64))).tobytes())
        hashes = words_hash(words)
        self.numbers = np.argsort(hashes)
        self.hashes = hashes[self.numbers]
        #: The items of each window, by the window's state and length.
        del number, words
        del keys, targets, order, newest, word_of, before
        states, whose = array("q"), array("i")
        for k in range(len(sizes)):
            words_ = seq[ends[k] : ends[k + 1]].tolist()
            n = min(window, len(words_))
            for _, _, at, _ in self.windows(words_, [n] if n else []):
                states.append(at * (window + 1) + n)
                whose.append(k)
        keys, whose = np.array(states, np.int64), np.array(whose, np.int64)
        order = np.lexsort((whose, keys))
        keys, whose = keys[order], whose[order]
        new = np.ones(len(keys), np.bool_)
        new[1:] = (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])
        keys, whose = keys[new], whose[new].astype(np.int32)
        kinds, first = np.unique(keys, return_index=True)
        self.owner_keys, self.owner_at, self.owners = array("q", kinds.tobytes()), array("q", np.append(first, len(keys)).astype(np.int64).tobytes()), array("i", whose.tobytes())

    def word(self, n: int) -> bytes:
        return self.blob[self.blob_at[n] : self.blob_at[n + 1]]

    def step(self, state: int, c: int) -> int:
        """The next state, or -1."""
        key = state << 32 | c
        at = bisect_left(self.keys, key)
        return self.targets[at] if c >= 0 and at < len(self.keys) and self.keys[at] == key else -1

    def windows(self, words: list[int], lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, state, longest match) of each stretch of one of the lengths that occurs in the items; words are numbers."""
        state, matched = 0, 0
        for i, c in enumerate(words):
            after = self.step(state, c)
            while after < 0 and state:
                state = self.link[state]
                matched = self.length[state]
                after = self.step(state, c)
            state, matched = (after, matched + 1) if after >= 0 else (0, 0)
            at = state
            for n in lengths:  # from long to short
                if n <= matched:
                    while self.length[self.link[at]] >= n:
                        at = self.link[at]
                    yield i + 1 - n, i + 1, at, matched

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, array, int]]:
        """(start, end, items, longest match) of each item window that ends at some word."""
        for begin, end, at, matched in self.windows(words, [self.window, *reversed(self.short_lengths)]):
            key = at * (self.window + 1) + end - begin
            i = bisect_left(self.owner_keys, key)
            if i < len(self.owner_keys) and self.owner_keys[i] == key:
                yield begin, end, self.owners[self.owner_at[i] : self.owner_at[i + 1]], matched


def words_hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    return span_hash(prefix_hash(BYTE_VALUES[data]), starts, ends)


def normal_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), IS_WORD)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def hits(automaton: Automaton, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]], set[int], int, np.ndarray, np.ndarray, bytes]]:
    """For each row: its number, words, merged hit spans (in words), items, longest match, and the words' byte spans."""
    pairs, short_one = automaton.pairs, 1 in automaton.short_lengths
    for first, end, data, offsets in text_blocks(column):
        data = LOWER[data]
        starts, ends, at = word_spans(data, offsets, IS_WORD)
        known = np.full(len(starts), -1, np.int64)
        if len(automaton.hashes) and len(starts):
            h = span_hash(prefix_hash(BYTE_VALUES[data]), starts, ends)
            place = np.minimum(np.searchsorted(automaton.hashes, h), len(automaton.hashes) - 1)
            known = np.where(automaton.hashes[place] == h, automaton.numbers[place], -1)
        both = (known[:-1] << 32) | known[1:]
        chained = (known[:-1] >= 0) & (known[1:] >= 0)
        if len(pairs):
            place = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
            chained &= pairs[place] == both
        else:
            chained[:] = False
        inner = at[1:-1]
        chained[inner[(inner > 0) & (inner < len(starts))] - 1] = False  # pairs that cross documents
        # stretches of chained words, as [begin, end) in words; single words only if an item has one word
        edge = np.flatnonzero(np.diff(np.concatenate(([False], chained, [False])).astype(np.int8)))
        begins, stops = edge[::2], edge[1::2] + 1
        if short_one:
            alone = known >= 0
            alone[:-1] &= ~chained
            alone[1:] &= ~chained
            lone = np.flatnonzero(alone)
            begins, stops = np.concatenate((begins, lone)), np.concatenate((stops, lone + 1))
            order = np.argsort(begins, kind="stable")
            begins, stops = begins[order], stops[order]
        least = min([automaton.window, *automaton.short_lengths])
        keep = stops - begins >= least
        begins, stops = begins[keep], stops[keep]
        cut = np.searchsorted(begins, at)
        raw = data.tobytes() if len(begins) else b""
        for row in range(first, end):
            k = row - first
            spans: list[tuple[int, int]] = []
            items: set[int] = set()
            longest = 0
            for b, e in zip(begins[cut[k] : cut[k + 1]].tolist(), stops[cut[k] : cut[k + 1]].tolist(), strict=True):
                # equal hashes are not yet equal words
                words = [n if raw[x:y] == automaton.word(n) else -1 for n, x, y in zip(known[b:e].tolist(), starts[b:e].tolist(), ends[b:e].tolist(), strict=True)]
                for x, y, found, n in automaton.stream(words):
                    items.update(found)
                    longest = max(longest, n)
                    x, y = x + b - int(at[k]), y + b - int(at[k])
                    while spans and spans[-1][1] >= x:
                        p = spans.pop()
                        x, y = min(x, p[0]), max(y, p[1])
                    spans.append((x, y))
            yield row, int(at[k + 1] - at[k]), spans, items, longest, starts[at[k] : at[k + 1]] - offsets[k], ends[at[k] : at[k + 1]] - offsets[k]


def items_of(bench: DataFrame, window: int, item_column: str, item_text: str) -> DataFrame:
    """Distinct (item, text) rows to build automata of: normalised, and items of more than ITEM_BYTES in pieces, which have all their windows."""
    bound = ITEM_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, texts = [], []
            for row, text in enumerate(batch.column(1)):
                words = normal_words(text.as_py())
                # a piece ends with the word that fills it
                cut, size = 0, 0
                for i, w in enumerate(words):
                    size += len(w) + 1
                    if (size > bound and i + 1 - cut >= window) or i + 1 == len(words):
                        of.append(row)
                        texts.append(b" ".join(words[cut : i + 1]).decode())
                        cut, size = i + 2 - window, 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(texts, pa.string())], ["item", "text"])

    source = named(bench, item=item_column, text=item_text).filter("text is not null")
    pieces = source.mapInArrow(tidied(run), T.StructType([source.schema["item"], T.StructField("text", T.StringType())]))
    return checkpoint(pieces.distinct())


def block_count(items: DataFrame, block_bytes: int) -> int:
    """Blocks of about block_bytes of text that items (item, text) make."""
    return max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))


def automaton_of(items: DataFrame, window: int, block: int, blocks: int) -> Automaton:
    """The automaton of one block of items (item, text); only this block's items come to the driver."""
    part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
    return Automaton(((r["item"], w) for r in part.toLocalIterator() if (w := normal_words(r["text"]))), window)


SPANS = "array<struct<begin:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scanned(rows: DataFrame, automaton: Broadcast[Automaton], every: bool) -> DataFrame:
    """(key, n_words, items, longest, spans) of rows (key, text), of all or only of those that are hit."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, words, spans, items, longest = [], [], [], [], []
            for row, n, s, i, most, *_ in hits(automaton.value, batch.column(1)):
                if every or s:
                    kept.append(row)
                    words.append(n)
                    spans.append([{"begin": a, "end": b} for a, b in s])
                    ids = {automaton.value.ids[k] for k in i}
                    items.append(sorted({str(x) for x in ids if x is not None}) + [None] * (None in ids))
                    longest.append(most)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(spans, SPAN_TYPE)],
                ["key", "n_words", "items", "longest", "spans"],
            )

    return rows.mapInArrow(tidied(run), f"key {kind}, n_words long, items array<string>, longest int, spans {SPANS}")


def hit_rows(rows: DataFrame, items: DataFrame, window: int, blocks: int) -> tuple[DataFrame, int]:
    """The hits of all blocks on rows (key, text) of unique keys, united by key; and the fewest words of an item window.

    Blocks are built, sent, used and freed one after the other; what is kept of each pass are its hits.
    """
    found, least = None, window
    for block in range(blocks):
        automaton = automaton_of(items, window, block, blocks)
        least = min([least, *automaton.short_lengths])
        sent = rows.sparkSession.sparkContext.broadcast(automaton)
        del automaton
        part = checkpoint(scanned(rows, sent, False))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    gathered = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"), F.flatten(F.collect_list("spans")).alias("spans"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"begin": a, "end": b} for a, b in united([(x["begin"], x["end"]) for x in s])] for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, SPAN_TYPE)], batch.schema.names)

    return gathered.mapInArrow(merged, f"key long, items array<string>, longest int, spans {SPANS}"), least


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), longest and spans of every document, of which no row is lost."""
    items = items_of(bench, window, item_column, item_text)
    source = named(docs, doc_id=id_column, text=text_column)
    blocks = block_count(items, block_bytes)
    if blocks == 1:
        sent = docs.sparkSession.sparkContext.broadcast(automaton_of(items, window, 0, 1))
        found = scanned(source.withColumnRenamed("doc_id", "key"), sent, True).withColumnRenamed("key", "doc_id")
    else:
        numbered = keyed(source, "doc_id", "text").withColumnRenamed("_key", "key")
        hit, _ = hit_rows(numbered.select("key", "text"), items, window, blocks)
        nothing = docs.sparkSession.sparkContext.broadcast(Automaton([], window))
        counted = scanned(numbered.select("key", "text"), nothing, True).select("key", "n_words").join(numbered.select("key", "doc_id"), "key")
        found = counted.join(hit, "key", "left").select(
            "doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
        )
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.withColumn("n_hit", covered)


def cut_text(text: str, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """text without the bytes from each span's first word to its last."""
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def cleaned(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the hit spans of at least min_span words, and without documents hit beyond max_coverage of their words.

    Where items have fewer words than min_span, spans of that many words are cut as well. A text
    that no span is cut from stays as it is, byte for byte; from others the bytes from a span's
    first word to its last go. Spans are judged on the text as it comes, for all items together.
    """
    items = items_of(bench, window, item_column, item_text)
    blocks, place = block_count(items, block_bytes), docs.columns.index(text_column)
    if blocks == 1:
        automaton = automaton_of(items, window, 0, 1)
        least = min([min_span, *automaton.short_lengths])
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def judged(batch: pa.RecordBatch):
            return ((row, n, spans, starts, ends) for row, n, spans, _, _, starts, ends in hits(sent.value, batch.column(place)))

        rows = boxed(docs)
    else:
        numbered = row_numbers(boxed(docs), *boxed(docs).columns[place : place + 1], name="key")[0]
        hit, shortest = hit_rows(numbered.select("key", F.col(f"c{place}").alias("text")), items, window, blocks)
        least = min(min_span, shortest)
        rows = numbered.join(hit.select("key", "spans"), "key", "left").drop("key")

        def judged(batch: pa.RecordBatch):
            for row, (text, spans) in enumerate(zip(batch.column(place), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if spans:
                    data = LOWER[np.frombuffer(text.as_py().encode(), np.uint8)]
                    starts, ends, _ = word_spans(data, np.array([0, len(data)]), IS_WORD)
                    yield row, len(starts), [(s["begin"], s["end"]) for s in spans], starts, ends

    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            changed: dict[int, str] = {}
            keep = np.ones(batch.num_rows, np.bool_)
            for row, n, spans, starts, ends in judged(batch):
                spans = [s for s in spans if s[1] - s[0] >= least]
                if sum(b - a for a, b in spans) > max_coverage * n:
                    keep[row] = False
                elif spans:
                    changed[row] = cut_text(column[row].as_py(), spans, starts, ends)
            if changed:
                texts = column.to_pylist()
                for row, text in changed.items():
                    texts[row] = text
                column = pa.array(texts, column.type)
            columns = [column if i == place else batch.column(i) for i in range(width)]
            out = pa.RecordBatch.from_arrays(columns, batch.schema.names[:width])
            yield out if keep.all() else out.filter(pa.array(keep))

    return rows.mapInArrow(tidied(run), T.StructType(boxed(docs).schema.fields)).toDF(*docs.columns)


def reported(found: DataFrame) -> DataFrame:
    """What the contract's query has of `contamination`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all documents and items."""
    return reported(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS n, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM items, LATERAL (SELECT unnest(range(1, n - k + 2)) AS p)),
lens AS (SELECT DISTINCT k FROM wins),
places AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
found AS (SELECT doc_id, p, places.k, item_id FROM places JOIN wins ON places.k = wins.k AND places.win = wins.win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, k FROM found), LATERAL (SELECT unnest(range(p, p + k)) AS q) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
