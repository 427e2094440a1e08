"""Operator 13: phrase collocation mining by bucket-counted passes (PCY, DHP).

Texts are lower-cased (A-Z), split into pieces at BREAKS and these into words at spaces and
tabs. Phrases are runs of words inside a piece, counted for each language. Pass k counts the
k-word phrases that can be frequent exactly and, on the way, counts those of k + 1 words in hash
buckets. A bucket that stays under min_count holds no frequent phrase, so its bit in the bitmap
is 0. The next pass takes a phrase only if its bucket's bit is set and if both phrases that it
contains of one word less are frequent (Apriori), which a second bitmap of the frequent phrases'
hashes tells. Bitmaps only let too much through, never too little, and what they let through is
counted exactly, so results don't depend on them.

Both bitmaps of a length are broadcast; they have one bit for each of BUCKET_BYTES bytes of input,
LEAST_BUCKETS at least and MAX_BUCKETS (4 MB of bits) at most. Bucket counts stop at min_count, so
that a byte holds one. Map tasks gather counts over their input and send them as packed blocks, one
for each part of the hash space; the parts grow with the input, and each is added up in one task.
A frequent phrase comes once from each flush of a map task.

A phrase is scored for each cut into two as floor(SCALE * a * a / (l * r)); its lowest cut counts.
Products are decimals of 38 digits, so the scores are exact while a * a * SCALE has no more.
Phrases inside a longer frequent one of at least ABSORB percent of their count are dropped.
The ranking goes by rounds over salted shares of a language, so that no task sorts a whole one.

Defined results: a null text has no words; a null language is `und`, and so one with rows of that
name; repeated rows count again; equal scores and counts go by the phrase's bytes; a piece of one
word has no phrase; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BYTE_VALUES, mix, prefix_hash, span_hash, text_blocks, tidied, word_spans
from .columns import named
from .decontaminate import LOWER
from .repeats import UNKNOWN_BYTES
from .spaces import release, shared_dir

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
SCALE, ABSORB = 1_000_000, 50
BREAKS = b".,;:!?\n\v\f\r"
IS_WORD = np.ones(256, np.bool_)
IS_WORD[[*b" \t", *BREAKS]] = False
IS_BREAK = np.zeros(256, np.bool_)
IS_BREAK[[*BREAKS]] = True

#: Input bytes for a bucket, and the bounds of their number; they decide on work only, as all below do.
BUCKET_BYTES, LEAST_BUCKETS, MAX_BUCKETS = 32, 1 << 20, 1 << 25
#: Buckets of a block of counts.
CHUNK = 1 << 16
#: Input bytes for a part of the counts, and distinct phrases that a map task gathers.
PART_BYTES, LEAST_PARTS, GATHER = 2 << 20, 64, 1 << 19
TEXT_BLOCK = 1 << 21
#: Rows of a language that one task ranks.
RANKED = 200_000

COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("hash", pa.int64())])
TALLY = "part int, chunk int, blob binary"
FOUND = "lang string, phrase string, n long, hash long, chunk int, bits binary"


class Bitmap:
    """Bits by hash; their number is a power of two."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Words:
    """The words of a block of texts: number, language and hash of each, and which ones the next word follows in the piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, lang_hashes: np.ndarray):
        data = LOWER[data]
        starts, ends, at = word_spans(data, offsets, IS_WORD)
        inside = IS_WORD[data]
        lengths = ends - starts
        to = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(data[inside].tobytes())])
        coded = column.dictionary_encode()
        self.names = coded.dictionary
        self.number = coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        self.lang = langs[row].astype(np.int64)
        breaks = np.cumsum(IS_BREAK[data])
        self.joined = (breaks[starts[1:]] == breaks[ends[:-1] - 1]) & (row[1:] == row[:-1]) if len(starts) else np.zeros(0, np.bool_)
        blob = np.frombuffer(b"".join(self.names.to_pylist()), np.uint8)
        edges = np.concatenate(([0], np.cumsum(pc.binary_length(self.names).to_numpy(zero_copy_only=False))))
        self.hash = span_hash(prefix_hash(BYTE_VALUES[blob]), edges[:-1], edges[1:]) if len(self.names) else np.zeros(0, np.uint64)
        self.first = mix(lang_hashes[self.lang] + self.hash[self.number])

    def __len__(self) -> int:
        return len(self.number)

    def longer(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k-word phrases at each word, of those of k - 1 words; the last places have none."""
        n = max(0, len(self) - k + 1)
        return mix(hashes[:n] * np.uint64(0xE7037ED1A0B428DB) + self.hash[self.number[k - 1 :]])


def level(words: Words, k: int, frequent: list[Bitmap], buckets: list[Bitmap]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places and hashes of the k-word phrases that may be frequent, the same of k + 1 words for the buckets).

    frequent has the bitmaps of 1 .. k - 1 words, buckets those of 2 .. k words.
    """
    hashes, alive = words.first, np.ones(len(words), np.bool_)
    for j in range(2, k + 2):
        longer = words.longer(hashes, j)
        n = len(longer)
        both = alive[:n] & alive[1 : n + 1] & words.joined[j - 2 : j - 2 + n] if j > 2 else words.joined[:n].copy()
        if j == k + 1:
            places, after = np.flatnonzero(alive), np.flatnonzero(both)
            return places, hashes[places], after, longer[after]
        seen = np.flatnonzero(both)
        seen = seen[frequent[j - 2](hashes[seen]) & frequent[j - 2](hashes[seen + 1])]
        seen = seen[buckets[j - 2](longer[seen])]
        alive = np.zeros(n, np.bool_)
        alive[seen] = True
        hashes = longer
    raise AssertionError


def block_counts(words: Words, k: int, places: np.ndarray, hashes: np.ndarray, languages: pa.Array) -> pa.Table:
    """Exact counts of the k-word phrases at the given places; phrases are told apart by their words."""
    size = max(1, len(words.names))
    code = words.lang[places]
    for j in range(k):
        if j and len(code) and int(code.max()) >= (1 << 62) // size:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * size + words.number[places + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    at = places[first]
    parts = [words.names.take(pa.array(words.number[at + j])) for j in range(k)]
    phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
    return pa.Table.from_arrays([languages.take(pa.array(words.lang[at])), phrase.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(hashes[first].view(np.int64))], schema=COUNTS)


def summed(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    out = whole.group_by(["lang", "phrase"]).aggregate([("n", "sum"), ("hash", "min")])
    return out.rename_columns(["lang", "phrase", "n", "hash"]) if out.num_rows else COUNTS.empty_table()


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, COUNTS) as out:
        out.write_table(table.cast(COUNTS))
    return zstandard.compress(sink.getvalue(), 1)


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


def tally_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, chunks, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], ["part", "chunk", "blob"])


def dealt(table: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts as packed blocks, one for each part that has some."""
    part = (mix(table["hash"].to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    table, part = table.take(pa.array(order)), part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    for i in range(0, len(edges) - 1, 64):
        yield tally_batch([(int(part[a]), -1, packed(table.slice(a, b - a))) for a, b in zip(edges[i : i + 64], edges[i + 1 : i + 65], strict=False)])


def counting(k: int, parts: int, buckets: int, least: int, last: bool, known: Broadcast | None):
    """The map side of pass k over (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bits = ([Bitmap(b) for b in side] for side in (known.value if known is not None else ((), ())))
        tallies = np.zeros(0 if last else buckets, np.uint8)
        gathered: list[pa.Table] = []
        size = 0
        for batch in batches:
            coded = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
            languages, of = coded.dictionary, coded.indices.to_numpy()
            names = [x.encode() for x in languages.to_pylist()]
            ends = np.cumsum([len(x) for x in names], dtype=np.int64)
            lang_hashes = span_hash(prefix_hash(BYTE_VALUES[np.frombuffer(b"".join(names), np.uint8)]), np.concatenate(([0], ends[:-1])).astype(np.int64), ends)
            for first, end, data, offsets in text_blocks(batch.column(1), TEXT_BLOCK):
                words = Words(data, offsets, of[first:end], lang_hashes)
                places, hashes, _, longer = level(words, k, frequent, bits)
                table = block_counts(words, k, places, hashes, languages)
                if not last and len(longer):
                    at, n = np.unique(longer & np.uint64(buckets - 1), return_counts=True)
                    tallies[at] = np.minimum(tallies[at] + np.minimum(n, least).astype(np.int64), least)
                gathered.append(table)
                size += table.num_rows
                if size > GATHER:
                    gathered = [summed(gathered)]
                    if (size := gathered[0].num_rows) > GATHER // 2:
                        yield from dealt(gathered[0], parts)
                        gathered, size = [], 0
        if gathered:
            yield from dealt(summed(gathered), parts)
        for chunk in range(0, len(tallies), CHUNK):
            counts = tallies[chunk : chunk + CHUNK]
            if counts.any():
                yield tally_batch([(chunk // CHUNK % parts, chunk // CHUNK, zstandard.compress(counts.tobytes(), 1))])

    return tidied(run)


def adding(least: int, totals: bool):
    """The reduce side of a pass: the frequent phrases of one part, the bits of its buckets, and with `totals` all counts of a language summed up."""

    def run(table: pa.Table) -> pa.Table:
        counts, sums = [], {}
        for chunk, blob in zip(table["chunk"].to_pylist(), table["blob"], strict=True):
            if chunk < 0:
                counts.append(unpacked(blob.as_py()))
            else:
                new = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint8)
                have = sums.setdefault(chunk, np.zeros(len(new), np.uint8))
                np.minimum(have + new.astype(np.uint16), least, out=have, casting="unsafe")
        whole = summed(counts) if counts else COUNTS.empty_table()
        out = whole.filter(pc.greater_equal(whole["n"], least)).cast(COUNTS)
        columns = {c: out[c].to_pylist() for c in COUNTS.names}
        if totals and whole.num_rows:
            of = whole.group_by("lang").aggregate([("n", "sum")])
            columns["lang"] += of["lang"].to_pylist()
            columns["n"] += of["n_sum"].to_pylist()
            columns["phrase"] += [None] * of.num_rows
            columns["hash"] += [None] * of.num_rows
        n = len(columns["lang"])
        chunks = [*sums]
        return pa.table({
            **{f.name: pa.array(columns[f.name] + [None] * len(chunks), f.type) for f in COUNTS},
            "chunk": pa.array([None] * n + chunks, pa.int32()),
            "bits": pa.array([None] * n + [np.packbits(sums[c] >= least, bitorder="little").tobytes() for c in chunks], pa.binary()),
        })

    return run


def input_bytes(docs: DataFrame, text_column: str) -> int:
    """Spark's estimate of the input's size, or where there is none the texts' bytes."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < UNKNOWN_BYTES else docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0


def bucket_bitmap(found: DataFrame, buckets: int) -> np.ndarray:
    """The buckets that reached the count, as bits; `buckets` / 8 bytes come to the driver."""
    out = np.zeros(buckets // 8, np.uint8)
    for r in found.filter("chunk is not null").select("chunk", "bits").toLocalIterator():
        out[r["chunk"] * CHUNK // 8 :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_bitmap(frequent: DataFrame, buckets: int) -> np.ndarray:
    """A bit for the hash of each frequent phrase; made by Spark, `buckets` / 8 bytes come to the driver."""
    at = F.col("hash").bitwiseAND(buckets - 1)
    words = frequent.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, CAST(hash & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(buckets // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, lang_column: str = "lang", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of the phrases of 1 to max_words words that occur min_count times in a language, and (lang, n) of all words."""
    if not 0 < min_count < 256:
        raise ValueError("min_count must be between 1 and 255")
    spark = docs.sparkSession
    source = named(docs, lang=lang_column, text=text_column).withColumn("lang", F.col("lang").cast("string"))
    size = input_bytes(source, "text")
    buckets = min(MAX_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, size // BUCKET_BYTES).bit_length()))
    parts = max(LEAST_PARTS, size // PART_BYTES)
    folder = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"
    frequent, bits, tables, totals = [], [], [], None
    for k in range(1, max_words + 1):
        last = k == max_words
        known = spark.sparkContext.broadcast((tuple(frequent), tuple(bits))) if k > 1 else None
        tallies = source.mapInArrow(counting(k, parts, buckets, min_count, last, known), TALLY)
        tallies.groupBy("part").applyInArrow(adding(min_count, k == 1), FOUND).write.parquet(f"{folder}/{k}")
        if known is not None:
            known.destroy()
        release(spark)
        found = spark.read.parquet(f"{folder}/{k}")
        counted = found.filter("phrase is not null").select("lang", "phrase", F.lit(k).alias("words"), "n", "hash")
        tables.append(counted)
        if k == 1:
            totals = found.filter("phrase is null and chunk is null").groupBy("lang").agg(F.sum("n").alias("n"))
        if not last:
            frequent.append(phrase_bitmap(counted, buckets))
            bits.append(bucket_bitmap(found, buckets))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.drop("hash"), totals


def first_of(df: DataFrame, top: int) -> DataFrame:
    """df (lang, score, a, phrase, ...) with `rank`, of each language the first `top` by score, a (both descending) and phrase.

    Round by round a language's rows are ranked in shares of about RANKED rows, of which the first
    `top` can be among the language's first, until a share is a whole language.
    """
    order = "ORDER BY score DESC, a DESC, phrase"
    most = df.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while most > max(RANKED, 2 * top):
        shares = -(-most // max(RANKED, 2 * top))
        df = df.withColumn("share", F.pmod(F.xxhash64("phrase", F.lit(shares)), F.lit(shares))).withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, share {order})"))
        df = df.filter(F.col("place") <= top).drop("share", "place")
        most = shares * top
    return df.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT)")).filter(F.col("rank") <= top)


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of the phrases of two words or more in (lang, phrase, words, n), by their lowest cut."""
    word = F.split("phrase", " ")
    phrases = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = phrases.withColumns({"left_part": F.array_join(F.slice(word, 1, F.col("k")), " "), "right_part": F.array_join(F.slice(word, F.col("k") + 1, F.col("words")), " ")})
    for side, name in (("left_part", "l"), ("right_part", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    whole = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"({whole('a')} * {whole('a')} * {SCALE}) div ({whole('l')} * {whole('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def absorbed(frequent: DataFrame, percent: int = ABSORB) -> DataFrame:
    """(lang, phrase) of the phrases that lie inside a longer frequent one of at least this percentage of their count."""
    word = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(m, i))))")
    longer = frequent.filter("words > 2").withColumn("span", F.explode(spans))
    inner = longer.select("lang", F.array_join(F.slice(word, F.col("span.i"), F.col("span.m")), " ").alias("phrase"), F.col("n").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    return frequent.filter("words > 1").join(inner, ["lang", "phrase"]).filter(F.col("around") * 100 >= F.col("n") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, percent: int = ABSORB, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 to max_words words."""
    frequent, totals = frequent_phrases(docs, max_words, min_count, lang_column, text_column)
    kept = scored(frequent).join(absorbed(frequent, percent), ["lang", "phrase"], "left_anti")
    return first_of(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
t AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM t, (VALUES (1), (2), (3)) AS x(m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, phrase, f FROM g WHERE f >= 10),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 10),
cuts AS MATERIALIZED (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:m], ' ') AS right_part FROM c, LATERAL (SELECT unnest(range(1, m)) AS k)),
scores AS (SELECT cuts.*, g1.f AS l, g2.f AS r, (1000000::HUGEINT * a * a) // (g1.f::HUGEINT * g2.f) AS score
           FROM cuts JOIN often g1 ON g1.phrase = left_part AND g1.lang = cuts.lang JOIN often g2 ON g2.phrase = right_part AND g2.lang = cuts.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS around FROM c, LATERAL (SELECT unnest([1, 2]) AS i) WHERE m = 3 GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase AND m = 2 WHERE around IS NULL OR 100 * around < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""
