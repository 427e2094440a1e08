"""Exact long repeats between documents: what operators 8 and 10 share.

A document is a sequence of units (bytes, or words). A window is `length` consecutive units of
it. Wanted are the windows whose content starts earlier: in a document of a smaller doc_id, or
(if `within`) earlier in the same one.

Only a part of all positions is sorted. Every window has an anchor, the least of its hashed
grams of `gram` units; equal windows have equal anchors at equal places. So:

1. Of each anchor in the corpus two hashes are shuffled: that of its gram, and that of its
   context, which is all that windows with this anchor may cover. Map tasks first merge equal
   ones, so a frequent passage sends one record from each task. Grams of one record are unique
   and their positions retire. A record whose context has an earlier equal is settled: all its
   windows start earlier. Only the first record of each context, where its gram has several
   contexts, is still open; these lie at the ends of repeats.
2. For the windows of open anchors rank pairs are shuffled: the ranks of the window's first
   and second half, in the manner of prefix doubling. The earliest of equal pairs stays, the
   others are removed.

Records travel as rows of packed arrays, one for each bucket of hashes; each bucket is sorted
in one task, and the number of buckets grows with the input, so that one holds BUCKET_BYTES of
it or so. No step has a row for each pair of anything, and no bucket fills with one frequent
string: what a map task settles itself needs no bucket of its gram and is dealt out by document;
rank pairs are dealt out by both ranks; and a gram that has more than CROWD contexts in one map
task is dealt out by context, with a single mark in the gram's bucket that it has several.
(Equal contexts that then don't meet are left open, and their windows meet in step 2.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_VALUES, distinct_sorted, mix, prefix_hash, span_hash, text_blocks, tidied, window_choice, window_hash, word_spans
from .numbering import row_numbers
from .spaces import checkpoint, release
from .squeeze import squeezed, texts_of

BUCKET_BYTES = 2 << 20
LEAST_BUCKETS = 256
#: Records that a map task gathers before it sends them.
GATHER = 1 << 19
#: Contexts of one gram in a map task from which on they are dealt out by context. It decides on work only.
CROWD = 16
#: The place of a mark in a bucket, and the bit of a gram's name that tells that it is dealt out by context.
MARK, CROWDED = -1, np.uint32(1 << 31)

BLOB = "bucket int, settled boolean, old boolean, n int, head binary, tail binary, ids binary, places binary"
CODES = "doc_id long, code long"


@dataclass(frozen=True)
class Rule:
    """length and gram in units; within: earlier starts in the same document count; separators: bytes that part words, None for bytes as units."""

    length: int
    gram: int
    within: bool
    separators: bytes | None

    @property
    def reach(self) -> int:
        """Units that a window may have before its anchor, or after the anchor's gram."""
        return self.length - self.gram

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(values, offsets of the documents in units, first bytes and end bytes of the units)."""
        if self.separators is None:
            return BYTE_VALUES[data], offsets, None, None
        is_word = np.ones(256, np.bool_)
        is_word[list(self.separators)] = False
        starts, ends, at = word_spans(data, offsets, is_word)
        return span_hash(prefix_hash(BYTE_VALUES[data]), starts, ends), at, starts, ends


def choices(rule: Rule, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hashes, each window's anchor by the window's start, which starts have a window inside one document)."""
    prefix = prefix_hash(values)
    n = len(values) - rule.length + 1
    if n <= 0:
        return prefix, np.zeros(0, np.int64), np.zeros(0, np.bool_)
    ends = np.repeat(at[1:], np.diff(at))
    return prefix, window_choice(window_hash(prefix, rule.gram), rule.reach + 1), np.arange(n) + rule.length <= ends[:n]


def anchor_records(rule: Rule, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row in the block, place, gram hash, context hash) of a block's anchors."""
    prefix, chosen, valid = choices(rule, values, at)
    anchors = distinct_sorted(chosen[valid])
    row = np.searchsorted(at, anchors, side="right") - 1
    low = np.maximum(at[row], anchors - rule.reach)
    high = np.minimum(at[row + 1], anchors + rule.length)
    context = mix(span_hash(prefix, low, high) + (anchors - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, anchors - at[row], span_hash(prefix, anchors, anchors + rule.gram), context


def rank_pairs(rule: Rule, values: np.ndarray, at: np.ndarray, open_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, rank of the first half, rank of the second half) of the windows whose anchor is open; open_at: their places in the block."""
    prefix, chosen, valid = choices(rule, values, at)
    is_open = np.zeros(len(values) + 1, np.bool_)
    is_open[open_at] = True
    starts = np.flatnonzero(is_open[chosen] & valid)
    row = np.searchsorted(at, starts, side="right") - 1
    half = rule.length // 2
    return row, starts - at[row], span_hash(prefix, starts, starts + half), span_hash(prefix, starts + half, starts + rule.length)


def pack(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), 1)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def later(rule: Rule, ids: np.ndarray, group: np.ndarray, first: np.ndarray, old: np.ndarray | bool = False) -> np.ndarray:
    """Of records sorted by group, age, doc_id and place (first: each group's first record): which have an earlier equal."""
    head = first[group]
    if rule.within:
        return np.arange(len(ids)) != head
    return (ids > ids[head]) | (np.broadcast_to(old, len(ids))[head] & ~np.broadcast_to(old, len(ids)))


class Gatherer:
    """Map side: gathers records and sends them by bucket, equal ones merged.

    spread says how buckets are dealt out: `gram` by head; `pair` by head and tail; `crowd` by
    head, but by both where a head has more than CROWD tails, with a mark in the head's bucket.
    """

    def __init__(self, rule: Rule, buckets: int, spread: str, old: bool = False, limit: int = GATHER):
        self.rule, self.buckets, self.spread, self.old, self.limit = rule, buckets, spread, old, limit
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, ids: np.ndarray, places: np.ndarray, head: np.ndarray, tail: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids):
            self.parts.append((ids, places, head, tail))
            self.n += len(ids)
        if self.n >= self.limit:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        if not self.n:
            return blob_batch([])
        ids, places, head, tail = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((places, ids, tail, head))
        ids, places, head, tail = ids[order], places[order], head[order], tail[order]
        new_head, new = changes(head), changes(head, tail)
        known = later(self.rule, ids, np.cumsum(new) - 1, np.flatnonzero(new))
        n = np.uint64(self.buckets)
        by_head, by_both = (head % n).astype(np.int64), (mix(head ^ mix(tail)) % n).astype(np.int64)
        name = (head // n).astype(np.uint32)
        bucket = by_both if self.spread == "pair" else by_head
        if self.spread != "pair":
            name &= ~CROWDED
        if self.spread == "crowd":
            of_head = np.cumsum(new_head) - 1
            crowded = np.bincount(of_head[new])[of_head] > CROWD
            marks = np.flatnonzero(new_head & crowded)
            bucket = np.where(crowded, by_both, by_head)
            # a mark stands for other contexts, so its tail is no context's own
            ids, places, head, tail, name = (np.concatenate((c, m)) for c, m in ((ids, ids[marks]), (places, np.full(len(marks), MARK)), (head, head[marks]), (tail, ~tail[marks]), (name, name[marks])))
            known, bucket = np.concatenate((known, np.zeros(len(marks), np.bool_))), np.concatenate((bucket, by_head[marks]))
            # in a bucket by context a record stays open whatever else is there
            name[: len(crowded)][crowded] |= CROWDED
        bucket = np.where(known, (mix(ids.astype(np.uint64)) % n).astype(np.int64), bucket)
        rows = []
        for which, settled in ((~known, False), (known, True)):
            if settled and self.old:
                continue
            at = np.flatnonzero(which)
            at = at[np.lexsort((places[at], ids[at], bucket[at]))]
            edges = np.flatnonzero(np.concatenate(([True], bucket[at][1:] != bucket[at][:-1], [True]))) if len(at) else []
            rows += [blob(int(bucket[at[a]]), settled, self.old, *(c[at[a:b]] for c in (ids, places, name, tail))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return blob_batch(rows)


def blob(bucket: int, settled: bool, old: bool, ids: np.ndarray, places: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple:
    """Records of one bucket as a row; the hashes of settled ones are not needed any more."""
    wide = np.int64 if len(places) and places.max() >= 1 << 31 else np.int32
    return bucket, settled, old, len(ids), b"" if settled else head.tobytes(), b"" if settled else tail.tobytes(), pack(np.diff(ids, prepend=0)), pack(places.astype(wide))


def blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [[] for _ in blob_schema()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, blob_schema(), strict=True)], schema=blob_schema())


def blob_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("old", pa.bool_()), ("n", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])


def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(settled, old, ids, places, head, tail) of a bucket's rows, end to end; head and tail of settled ones are 0."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for r in table.to_pylist():
        n, settled = r["n"], r["settled"]
        places = zstandard.decompress(r["places"])
        places = np.frombuffer(places, np.int64 if len(places) == 8 * n else np.int32).astype(np.int64)
        head = np.zeros(n, np.uint32) if settled else np.frombuffer(r["head"], np.uint32)
        tail = np.zeros(n, np.uint64) if settled else np.frombuffer(r["tail"], np.uint64)
        for o, x in zip(out, (np.full(n, settled), np.full(n, r["old"]), np.cumsum(unpack(r["ids"], np.int64)), places, head, tail), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def code_batch(ids: np.ndarray, codes: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "code": pa.array(codes, pa.int64())})


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.bool_)
    new = np.zeros(len(columns[0]), np.bool_)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def reduce_anchors(rule: Rule) -> Callable[[pa.Table], pa.Table]:
    """Reduce side of step 1: a code for each settled or open anchor, 4 * place + 2 * old + open; old ones are never settled anew."""

    def run(table: pa.Table) -> pa.Table:
        settled, old, ids, places, head, tail = unpacked(table)
        out_ids, out_codes = [ids[settled]], [4 * places[settled]]
        keep = np.flatnonzero(~settled)
        order = keep[np.argsort(head[keep], kind="stable")]
        group = np.cumsum(changes(head[order])) - 1
        order = order[(np.bincount(group)[group] > 1) | (head[order] >= CROWDED)] if len(order) else order
        if len(order):
            order = order[np.lexsort((places[order], ids[order], ~old[order], tail[order], head[order]))]
            h, t, i, p, o = (c[order] for c in (head, tail, ids, places, old))
            new_head, new = changes(h), changes(h, t)
            known = later(rule, i, np.cumsum(new) - 1, np.flatnonzero(new), o) & ~o
            of_head = np.cumsum(new_head) - 1
            contexts, fresh = np.bincount(of_head[new])[of_head], np.bincount(of_head[~o], minlength=of_head[-1] + 1)[of_head]
            is_open = ~known & ((contexts > 1) & (fresh > 0) | (h >= CROWDED))
            known, is_open = known & (p != MARK), is_open & (p != MARK)
            out_ids += [i[known], i[is_open]]
            out_codes += [4 * p[known], 4 * p[is_open] + 2 * o[is_open] + 1]
        return code_batch(np.concatenate(out_ids), np.concatenate(out_codes))

    return run


def reduce_pairs(rule: Rule) -> Callable[[pa.Table], pa.Table]:
    """Reduce side of step 2: places of the windows, not old ones, with an earlier equal."""

    def run(table: pa.Table) -> pa.Table:
        settled, old, ids, places, head, tail = unpacked(table)
        keep = np.flatnonzero(~settled)
        order = keep[np.lexsort((places[keep], ids[keep], ~old[keep], tail[keep], head[keep]))]
        h, t, i, p, o = (c[order] for c in (head, tail, ids, places, old))
        new = changes(h, t)
        known = later(rule, i, np.cumsum(new) - 1, np.flatnonzero(new), o) & ~o if len(order) else new
        return code_batch(np.concatenate((ids[settled], i[known])), np.concatenate((places[settled], p[known])))

    return run


#: Estimates from here on are Spark's way to say that it does not know.
UNKNOWN_BYTES = 1 << 55


def bucket_count(docs: DataFrame, text_column: str) -> int:
    """Buckets in proportion to the input's size: Spark's estimate of it, or where there is none the texts' bytes."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    return max(LEAST_BUCKETS, size // BUCKET_BYTES)


def anchor_blobs(docs: DataFrame, rule: Rule, buckets: int, spread: str) -> DataFrame:
    """Map side of step 1 over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gatherer(rule, buckets, spread)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offsets in text_blocks(batch.column(1)):
                values, at, _, _ = rule.units(data, offsets)
                row, place, head, tail = anchor_records(rule, values, at)
                yield from gather.add(ids[first + row], place, head, tail)
        yield gather.flush()

    return docs.select("doc_id", "text").mapInArrow(tidied(run), BLOB)


def by_bucket(blobs: DataFrame, reducer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return blobs.groupBy("bucket").applyInArrow(reducer, CODES)


def pair_blobs(pending: DataFrame, rule: Rule, buckets: int, old: bool = False) -> DataFrame:
    """Map side of step 2 over (doc_id, compressed text, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gatherer(rule, buckets, "pair", old)
        for whole in batches:
            for batch in pieces_of(whole):
                ids = batch.column(0).to_numpy()
                code_at, code = list_parts(batch.column(2))
                for first, end, data, offsets in text_blocks(texts_of(batch.column(1))):
                    values, at, _, _ = rule.units(data, offsets)
                    mine = code[code_at[first] : code_at[end]]
                    rows = np.repeat(np.arange(end - first), np.diff(code_at[first : end + 1]))
                    place = (mine >> 2) + at[rows]
                    row, place, head, tail = rank_pairs(rule, values, at, place[((mine & 1) == 1) & (place < at[rows + 1])])
                    yield from gather.add(ids[first + row], place, head, tail)
        yield gather.flush()

    return pending.mapInArrow(tidied(run), BLOB)


def covered_units(rule: Rule, at: np.ndarray, settled: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Marks of the units of a block that removed windows cover: those around settled anchors, and given windows."""
    n = int(at[-1])
    mark = np.zeros(n + 1, np.int32)
    row = np.searchsorted(at, settled, side="right") - 1
    np.add.at(mark, np.maximum(settled - rule.reach, at[row]), 1)
    np.add.at(mark, np.minimum(settled + rule.length, at[row + 1]), -1)
    np.add.at(mark, windows, 1)
    np.add.at(mark, windows + rule.length, -1)
    return np.cumsum(mark[:-1]) > 0


def lists(df: DataFrame, name: str) -> DataFrame:
    """The codes of each document as one array."""
    return df.groupBy(F.col("doc_id").alias("_key")).agg(F.collect_list("code").alias(name))


def pieces_of(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), column.flatten().to_numpy(zero_copy_only=False)


def unique_ids(docs: DataFrame, id_column: str) -> bool:
    """Whether the ids are whole numbers, unique and not null."""
    if not isinstance(docs.schema[id_column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return False
    counts = docs.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("n")).filter("n > 1 or id is null")
    return not counts.limit(1).count()


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Boxed docs with a long `_key` that is unique and ascends as (doc_id, text) does.

    It is the doc_id where those are whole numbers, unique and not null, and else a row number.
    """
    if unique_ids(docs, id_column):
        return docs.withColumn("_key", F.col(id_column).cast("long"))
    return row_numbers(docs, id_column, text_column, name="_key")[0]


def marked(docs: DataFrame, rule: Rule, id_column: str, text_column: str) -> DataFrame:
    """Boxed docs with compressed text, `_codes` and `_windows`: settled anchors, and removed windows of open ones."""
    spark = docs.sparkSession
    buckets = bucket_count(docs, text_column)
    docs = keyed(docs, id_column, text_column)
    source = docs.select(F.col("_key").alias("doc_id"), F.col(text_column).alias("text"))
    codes = checkpoint(lists(by_bucket(anchor_blobs(source, rule, buckets, "crowd"), reduce_anchors(rule)), "_codes"))
    release(spark)
    texts = squeezed(docs, text_column)
    pairs = pair_blobs(open_ones(texts, codes, text_column), rule, buckets)
    windows = checkpoint(lists(by_bucket(pairs, reduce_pairs(rule)), "_windows"))
    del pairs
    release(spark)
    return texts.join(codes, "_key", "left").join(windows, "_key", "left")


def open_ones(texts: DataFrame, codes: DataFrame, text_column: str) -> DataFrame:
    """What step 2 takes: texts of the documents with open anchors, and those."""
    some = codes.select("_key", F.filter("_codes", lambda c: c % 2 == 1).alias("codes")).filter(F.size("codes") > 0)
    return texts.select("_key", text_column).join(some, "_key").select(F.col("_key").alias("doc_id"), F.col(text_column).alias("text"), "codes")


def finished(rows: DataFrame, rule: Rule, text_column: str, kept_columns: list[str], extra: str, make: Callable) -> DataFrame:
    """Apply make to boxed rows block by block: the kept columns, and those of extra, which it makes."""
    fields = [rows.schema[c] for c in kept_columns]
    chosen = rows.select(*kept_columns, F.col(text_column).alias("_text"), "_codes", "_windows")
    schema = T.StructType(fields + T._parse_datatype_string(extra).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole):
                texts = texts_of(batch.column("_text"))
                (code_at, code), (win_at, win) = list_parts(batch.column("_codes")), list_parts(batch.column("_windows"))
                for first, end, data, offsets in text_blocks(texts):
                    _, at, starts, ends = rule.units(data, offsets)
                    mine = code[code_at[first] : code_at[end]]
                    anchor = (mine >> 2) + np.repeat(at[:-1], np.diff(code_at[first : end + 1]))
                    window = win[win_at[first] : win_at[end]] + np.repeat(at[:-1], np.diff(win_at[first : end + 1]))
                    covered = covered_units(rule, at, anchor[(mine & 1) == 0], window)
                    made = make(batch.slice(first, end - first), texts.slice(first, end - first), data, offsets, at, starts, ends, covered)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in kept_columns), *made], [f.name for f in schema])

    return chosen.mapInArrow(tidied(run), schema)
