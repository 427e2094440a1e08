"""Operator 9: SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A merge-type (BPE) SentencePiece model is applied by its agenda: of all adjacent pairs whose
concatenation is a piece, the one with the best score merges, the leftmost first. When it is
its turn a keyed hash of the candidate's place decides whether it is skipped, with probability
DROPOUT; a skipped candidate never merges, later ones over the same characters are candidates
of their own. The key is made of the seed, the text's hash and the ordinal of the segment in it, so
that each occurrence of a word has decisions of its own, and a text is always cut alike.

Segments (spaces with what follows them) never merge with each other in such a vocabulary, so
the agendas of all distinct segments of a block run in step with numpy, one merge in each at a
time. The occurrences of a segment share its agenda as long as their decisions are the same;
where they differ those that skip go on with a copy. Long segments are cut where no piece spans the cut, and what is still long
has an agenda with a heap.

Decoding concatenates the pieces' bytes and takes the added first space off. It is lossless
for every text: a literal U+2581, which the model's spaces look like, is encoded by its bytes.

Defined results: null and empty texts have no tokens, a null text stays null when it is
decoded; repeated rows are encoded alike; an empty table gives an empty result; other columns
are kept by `encode` and ignored by the query. Without dropout the tokens are the library's
(but for texts with a literal U+2581).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrays import BYTE_VALUES, GOLDEN, MASK, mix, prefix_hash, span_hash, text_blocks, text_hashes, tidied  # noqa: F401 (tests)
from .columns import boxed, free_name, named

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
#: The mark of a space in pieces.
MARK = 0x2581
LITERAL_MARK = 0x110000
#: Segments of more symbols get a heap.
LONG = 64
#: The bits of a place in a segment of LONG symbols; what no rank above these bits reaches.
PLACE, FAR = np.int32(63), np.int32(0x7FFFFFFF)
#: Segments of like lengths: up to these.
WIDTHS = (4, 6, 8, 11, 15, 22, 36)
#: Bytes of text whose segments are worked on together; the more, the more of them are alike.
TOGETHER = 1 << 20
STEP = 1 << 18
TABLE = 1 << 12


class Pieces:
    """A merge-type model as arrays."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usable = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.size = n
        chars = sorted({c for p in usable for c in p})
        #: Symbols: pieces by their id; characters of pieces that are no piece themselves follow; other characters are n + (1 << 20) + code point.
        extra = [c for c in chars if c not in usable]
        self.extra = {n + i: ord(c) for i, c in enumerate(extra)}
        ids = dict(usable) | {c: n + i for i, c in enumerate(extra)}
        self.symbol_of = np.arange(0x110001, dtype=np.int32) + np.int32(n + (1 << 20))
        for c in chars:
            self.symbol_of[ord(c)] = ids[c]
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in usable.values()}, reverse=True))}
        keys, ranks, into = [], [], []
        joints = set()
        for p, i in usable.items():
            for k in range(1, len(p)):
                joints.add((p[k - 1], p[k]))
                if p[:k] in ids and p[k:] in ids:
                    keys.append(ids[p[:k]] << 32 | ids[p[k:]])
                    ranks.append(order[model.get_score(i)])
                    into.append(i)
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in usable):
            raise ValueError("a piece spans segments")
        self.joints = np.array(sorted(ord(a) << 32 | ord(b) for a, b in joints), np.int64)
        if len(order) > FAR >> 6:
            raise ValueError("too many scores")
        self.bits = max(16, (len(keys) * 4).bit_length())
        #: A slot is a pair's key, then rank and result.
        self.table = np.full(2 << self.bits, -1, np.int64)
        slots = self.slot(np.array(keys, np.int64))
        for key, rank, to, slot in zip(keys, ranks, into, slots.tolist(), strict=True):
            while self.table[slot] >= 0:
                slot = slot + 2 & self.table.size - 1
            self.table[slot], self.table[slot + 1] = key, rank << 38 | to
        self.pairs = dict(zip(keys, zip(ranks, into, strict=True), strict=True))
        spelt = [b""] * n
        for p, i in usable.items():
            spelt[i] = p.replace(chr(MARK), " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_at = np.concatenate(([0], np.cumsum([len(x) for x in spelt])))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(GOLDEN) >> np.uint64(64 - self.bits) << np.uint64(1)).view(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, above the bits of a place (FAR if they don't merge), and result of adjacent symbols."""
        keys = left.astype(np.int64) << 32 | right
        slot = self.slot(keys)
        have = self.table[slot]
        found = np.where(have == keys, self.table[slot + 1], FAR.astype(np.int64) << 32)
        at = np.flatnonzero((have != keys) & (have >= 0))
        keys, slot = keys[at], slot[at]
        while len(at):
            slot = slot + 2 & self.table.size - 1
            have = self.table[slot]
            hit = have == keys
            found[at[hit]] = self.table[slot[hit] + 1]
            more = ~hit & (have >= 0)
            at, keys, slot = at[more], keys[more], slot[more]
        return (found >> 32).astype(np.int32), found.astype(np.int32)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def place_hash(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A candidate's hash, by its characters' places in the whole segment."""
    return mix(start.astype(np.uint64) << np.uint64(42) ^ middle.astype(np.uint64) << np.uint64(21) ^ end.astype(np.uint64))


def skipped(key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    """The keyed hash's decisions for candidates."""
    return mix(key ^ place) >> np.uint64(11) < np.uint64(math.ceil(dropout * (1 << 53)))


def run_agendas(model: Pieces, symbols: np.ndarray, starts: np.ndarray, base: np.ndarray, of: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(result of each occurrence, symbols of the results, their sizes) of segments of LONG symbols at most (starts: offsets into symbols, with the end).

    base is the place of each segment's first symbol in the whole segment that it was cut from;
    of and keys are the occurrences' segments and keys. A state is what an agenda has come to, and
    has the occurrences that share it. States are the columns of matrices, and rows are places in the
    segment: a merge leaves its symbol at the place of its first character, so nothing moves.
    """
    size = np.diff(starts)
    used, width, room = len(size), int(size.max()), 2 * len(size)
    owner = np.repeat(np.arange(used), size)
    row = np.arange(len(symbols)) - np.repeat(starts[:-1], size)
    # best: rank and place of the pair with the next symbol, FAR if it doesn't merge; into: what it makes
    sym, best, into = np.full((width, room), -1, np.int32), np.full((width, room), FAR, np.int32), np.empty((width, room), np.int32)
    nxt, prv = np.empty((width, room), np.int8), np.empty((width, room), np.int8)
    nxt[:, :used], prv[:, :used] = np.arange(1, width + 1)[:, None], np.arange(-1, width - 1)[:, None]
    sym[row, owner] = symbols
    at = np.flatnonzero(owner[1:] == owner[:-1])
    found, to = model.merges(symbols[at], symbols[at + 1])
    best[row[at], owner[at]], into[row[at], owner[at]] = found | row[at].astype(np.int32), to
    base = base.astype(np.uint64)
    results, sizes, n_results = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    result = np.zeros(len(of), np.int64)
    who, state, key = np.arange(len(of)), of, keys
    count = np.bincount(of, minlength=used)
    while True:
        top = best[:, :used].min(axis=0)
        live = top < FAR
        on = np.flatnonzero(live)
        if 3 * len(on) < 2 * used or not len(on):
            # states that have come to their ends go
            done = np.flatnonzero(~live)
            last = sym[:, done].T
            there = last >= 0
            results.append(last[there])
            sizes.append(there.sum(axis=1))
            number = np.empty(used, np.int64)
            number[done], number[on] = np.arange(n_results, n_results + len(done)), np.arange(len(on))
            n_results += len(done)
            more = live[state]
            result[who[~more]] = number[state[~more]]
            if not len(on):
                break
            who, key, state = who[more], key[more], number[state[more]]
            used = len(on)
            for x in (sym, best, into, nxt, prv):
                x[:, :used] = x[:, on]
            base, size, count, top = base[on], size[on], count[on], top[on]
            live, on = np.ones(used, np.bool_), np.arange(used)
        first = (top[on] & PLACE).astype(np.int64)
        middle = nxt[first, on].astype(np.int64)
        end = nxt[middle, on].astype(np.int64)
        if dropout > 0:
            # every occurrence decides on the candidate that is its state's next one; those that skip it go on in a copy
            place = np.zeros(used, np.uint64)
            place[on] = place_hash(base[on] + first.view(np.uint64), base[on] + middle.view(np.uint64), base[on] + end.view(np.uint64))
            skip = np.flatnonzero(skipped(key, place[state], dropout) & live[state])
            if len(skip):
                whose = state[skip]
                n_skip = np.bincount(whose, minlength=used)
                split = np.flatnonzero((n_skip > 0) & (n_skip < count))
                whole = np.flatnonzero((n_skip == count) & live)
                best[top[whole] & PLACE, whole] = FAR
                merging = n_skip[on] < count[on]
                if len(split):
                    new = np.arange(used, used + len(split))
                    if used + len(split) > room:
                        room = 2 * (used + len(split))
                        sym, best, into, nxt, prv = (wider(x, used, room) for x in (sym, best, into, nxt, prv))
                    for x in (sym, best, into, nxt, prv):
                        x[:, used : used + len(split)] = x[:, split]
                    best[top[split] & PLACE, new] = FAR
                    count[split] -= n_skip[split]
                    base, size, count = np.concatenate((base, base[split])), np.concatenate((size, size[split])), np.concatenate((count, n_skip[split]))
                    renamed = np.arange(used)
                    renamed[split] = new
                    state[skip] = renamed[whose]
                    used += len(split)
                on, first, middle, end = on[merging], first[merging], middle[merging], end[merging]
        # flat places of the pairs' symbols
        sym_, best_, into_, nxt_, prv_ = (x.reshape(-1) for x in (sym, best, into, nxt, prv))
        left, right = first * room + on, middle * room + on
        sym_[left], sym_[right] = into_[left], -1
        best_[left], best_[right] = FAR, FAR
        nxt_[left] = end
        follows = np.flatnonzero(end < size[on])
        after = end[follows] * room + on[follows]
        prv_[after] = first[follows]
        before = prv_[left].astype(np.int64)
        leads = np.flatnonzero(before >= 0)
        before = before[leads]
        at = np.concatenate((before * room + on[leads], left[follows]))
        found, to = model.merges(sym_[at], sym_[np.concatenate((left[leads], after))])
        best_[at] = found | np.concatenate((before, first[follows])).astype(np.int32)
        into_[at] = to
    return result, np.concatenate(results), np.concatenate(sizes)


def wider(matrix: np.ndarray, used: int, room: int) -> np.ndarray:
    """The used columns of a matrix in one that has room for more."""
    out = np.empty((len(matrix), room), matrix.dtype)
    out[:, :used] = matrix[:, :used]
    return out


def in_parts(model: Pieces, symbols: np.ndarray, starts: np.ndarray, base: np.ndarray, of: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """run_agendas on parts of segments of like lengths, about STEP symbols or occurrences, whose arrays stay in the processor's caches; offsets instead of sizes.

    Segments of more than LONG symbols have agendas with heaps, one for each occurrence.
    """
    lengths = np.diff(starts)
    by_length = np.argsort(np.minimum(lengths, LONG + 1).astype(np.uint8), kind="stable")
    place = np.empty_like(by_length)
    place[by_length] = np.arange(len(by_length))
    of = place[of]
    begins, base, lengths = starts[:-1][by_length], base[by_length], lengths[by_length]
    offs = np.concatenate(([0], np.cumsum(lengths)))
    first = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(lengths)))))
    load = offs + first
    n, edges = int(np.searchsorted(lengths, LONG, side="right")), [0]
    while edges[-1] < n:
        a = edges[-1]
        alike = int(np.searchsorted(lengths, next((w for w in WIDTHS if w >= lengths[a]), LONG), side="right"))
        edges.append(max(a + 1, min(n, alike, int(np.searchsorted(load, load[a] + STEP, side="right")) - 1)))
    # the occurrences by their parts
    part = np.repeat(np.arange(len(edges)), np.diff([*edges, len(lengths)]))[of]
    order = np.argsort(part.astype(np.uint16) if len(edges) < 1 << 16 else part, kind="stable")
    of, keys = of[order], keys[order]
    result, out, sizes, before = np.zeros(len(of), np.int64), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    for a, b in zip(edges, edges[1:], strict=False):
        flat = symbols[np.arange(offs[a], offs[b]) + np.repeat(begins[a:b] - offs[a:b], lengths[a:b])]
        mine = slice(first[a], first[b])
        r, got, size = run_agendas(model, flat, offs[a : b + 1] - offs[a], base[a:b], of[mine] - a, keys[mine], dropout)
        result[order[mine]] = r + before
        out.append(got)
        sizes.append(size)
        before += len(size)
    for o in range(first[n], len(of)):
        s = of[o]
        out.append(one_agenda(model, symbols[begins[s] : begins[s] + lengths[s]], keys[o], int(base[s]), dropout))
        sizes.append([len(out[-1])])
        result[order[o]] = before
        before += 1
    return result, np.concatenate(out), np.cumsum(np.concatenate(sizes))


def mixed(x: int) -> int:
    """arrays.mix of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def one_agenda(model: Pieces, symbols: np.ndarray, key: np.uint64, base: int, dropout: float) -> np.ndarray:
    """The agenda of one long segment, with a heap."""
    sym = symbols.tolist()
    n = len(sym)
    prev, nxt, stop = list(range(-1, n - 1)), list(range(1, n + 1)), [base + i + 1 for i in range(n)]
    heap: list[tuple[int, int, int, int, int]] = []
    limit, plain = dropout * (1 << 53), int(key)

    def drops(start: int, middle: int, end: int) -> bool:
        """As `skipped` decides."""
        return mixed(plain ^ mixed(start << 42 ^ middle << 21 ^ end)) >> 11 < limit

    def offer(i: int) -> None:
        j = nxt[i]
        if i < 0 or j >= n:
            return
        found = model.pairs.get(sym[i] << 32 | sym[j])
        if found and not (dropout > 0 and drops(base + i, base + j, stop[j])):
            heapq.heappush(heap, (found[0], i, j, stop[j], found[1]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, end, into = heapq.heappop(heap)
        if not (alive[i] and alive[j] and nxt[i] == j and stop[j] == end and stop[i] == base + j):
            continue
        sym[i], stop[i], alive[j] = into, end, False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return np.array([s for s, a in zip(sym, alive, strict=True) if a], np.int32)


def place_weights(within: np.ndarray, salt: int) -> np.ndarray:
    """A pseudo-random number for each place in a segment; of a table, if no segment is very long."""
    n = int(within.max()) + 1
    places = np.arange(n) if n <= TABLE else within
    numbers = mix((2 * places + salt).view(np.uint64) * np.uint64(GOLDEN))
    return numbers[within] if n <= TABLE else numbers


def encode_block(model: Pieces, data: np.ndarray, offsets: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, offsets of the documents) of a block of texts."""
    docs = len(offsets) - 1
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = offsets - np.searchsorted(np.flatnonzero(data & 0xC0 == 0x80), offsets)
    some = np.diff(at) > 0
    # a mark before each text that is not empty
    total = len(codes) + int(some.sum())
    if not total:
        return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
    shift = np.concatenate(([0], np.cumsum(some)))
    bounds = at + shift
    added = np.zeros(total, np.bool_)
    added[bounds[:-1][some]] = True
    marked = np.empty(total, np.uint32)
    marked[~added] = codes
    del codes  # here and below: what is as long as the block goes before more of it is made
    marked[marked == MARK] = LITERAL_MARK
    mark = (marked == 0x20) | added
    marked[mark] = MARK
    cut = mark & np.concatenate(([True], ~mark[:-1]))
    cut |= added
    starts = np.flatnonzero(cut)
    ends = np.concatenate((starts[1:], [total]))
    del mark, cut, added
    of_doc = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(starts, bounds)
    ordinal = np.arange(len(starts)) - first[of_doc]
    variant = np.zeros(len(starts), np.uint64)
    if dropout > 0:
        whose = text_hashes(data, offsets)
        variant = mix(whose[of_doc] ^ mix(ordinal.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & MASK)))
    keys = mix(variant + np.uint64(seed * 0xD1B54A32D192ED03 & MASK))
    # distinct segments by two independent sums of hashed characters, each times a number of its place; their lengths count too
    value = mix(marked + np.uint64(1))
    within = np.arange(total) - np.repeat(starts, ends - starts)
    sums = np.add.reduceat(value * place_weights(within, 1), starts)
    _, chosen, inverse = np.unique(mix(sums + (ends - starts).astype(np.uint64)), return_index=True, return_inverse=True)
    others = np.add.reduceat(value * place_weights(within, 2), starts)
    if (others != others[chosen][inverse]).any():  # the first sum took unlike segments for equal
        _, chosen, inverse = np.unique(np.stack((sums, others)), axis=1, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
    del value, within, sums, others
    lengths = (ends - starts)[chosen]
    offs = np.concatenate(([0], np.cumsum(lengths)))
    flat = marked[np.arange(offs[-1]) - np.repeat(offs[:-1], lengths) + np.repeat(starts[chosen], lengths)]
    del marked
    # long segments are cut where no piece spans
    seg_start, seg_of = offs[:-1], np.arange(len(chosen))
    base = np.zeros(len(chosen), np.int64)
    if (lengths > LONG).any():
        joint = flat[:-1].astype(np.int64) << 32 | flat[1:]
        place = np.minimum(np.searchsorted(model.joints, joint), len(model.joints) - 1)
        free = np.concatenate(([False], model.joints[place] != joint)) & np.repeat(lengths > LONG, lengths)
        free[offs[:-1]] = True
        seg_start = np.flatnonzero(free)
        seg_of = np.searchsorted(offs, seg_start, side="right") - 1
        base = seg_start - offs[seg_of]
    # an occurrence of a segment is one of each of its parts
    part_at = np.concatenate((np.searchsorted(seg_of, np.arange(len(chosen))), [len(seg_of)]))
    parts = np.diff(part_at)[inverse]
    part_ends = np.cumsum(parts)
    of = np.arange(part_ends[-1]) - np.repeat(part_ends - parts - part_at[inverse], parts)
    mine, symbols, sym_at = in_parts(model, model.symbol_of[flat], np.concatenate((seg_start, [len(flat)])), base, of, np.repeat(keys, parts), dropout)
    ids, id_at = with_bytes(model, symbols, sym_at)
    # back to the occurrences
    counts = np.diff(id_at)[mine]
    ends_ = np.concatenate(([0], np.cumsum(counts)))
    out = ids[np.arange(ends_[-1]) - np.repeat(ends_[:-1] - id_at[mine], counts)]
    return out, ends_[np.concatenate(([0], part_ends))[first]]


def with_bytes(model: Pieces, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of symbols; those that are no piece are spelt in bytes."""
    odd = np.flatnonzero(symbols >= model.size)
    if not len(odd):
        return symbols, at
    distinct, which = np.unique(symbols[odd], return_inverse=True)
    spelt = []
    for s in distinct.tolist():
        code = model.extra.get(s, s - model.size - (1 << 20))
        spelt.append(chr(MARK if code == LITERAL_MARK else code).encode("utf-8", "surrogatepass"))
    lengths = np.array([len(b) for b in spelt])
    widths = np.ones(len(symbols), np.int64)
    widths[odd] = lengths[which]
    ends = np.cumsum(widths)
    ids = np.repeat(symbols, widths)
    for k in range(4):  # the bytes of a character, from its last
        some = lengths[which] > k
        byte = model.byte_ids[[b[-1 - k] if len(b) > k else 0 for b in spelt]]
        ids[ends[odd[some]] - 1 - k] = byte[which[some]]
    return ids, np.concatenate(([0], ends))[at]


def decode_block(model: Pieces, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts from token ids; the added first space is taken off."""
    widths = np.diff(model.spelt_at)[ids]
    ends = np.cumsum(widths)
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    data = model.spelt[np.arange(ends[-1]) - np.repeat(ends - widths, widths) + np.repeat(model.spelt_at[ids], widths)]
    offsets = np.concatenate(([0], ends))[at]
    some = np.diff(offsets) > 0
    keep = np.ones(len(data), np.bool_)
    keep[offsets[:-1][some]] = False
    return data[keep], offsets - np.concatenate(([0], np.cumsum(some)))


def encode_column(model: Pieces, column: pa.Array, dropout: float = DROPOUT, seed: int = SEED) -> pa.ListArray:
    """Token ids of each text of an Arrow column; null texts have none."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in text_blocks(column, TOGETHER):
        i, at = encode_block(model, data, offsets, dropout, seed)
        ids.append(i)
        sizes.append(np.diff(at))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))


def decode_column(model: Pieces, column: pa.ListArray) -> pa.Array:
    """Texts of token ids; null lists give null."""
    filled = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    at = np.asarray(filled.offsets).astype(np.int64)
    ids = np.asarray(filled.values)[at[0] : at[-1]]
    data, offsets = decode_block(model, ids, at - at[0])
    texts = pa.LargeStringArray.from_buffers(len(filled), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
    return pc.if_else(pc.is_valid(column), texts, pa.scalar(None, pa.large_string())) if column.null_count else texts


def encode(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, text_column: str = "text", name: str = "tokens") -> DataFrame:
    """docs with their token ids; a null text has null tokens. A name that docs have already gets underscores after it."""
    path = model or public_tokenizers.path(MODEL)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            tokens = encode_column(pieces(path), column, dropout, seed)
            if column.null_count:
                tokens = pc.if_else(pc.is_valid(column), tokens, pa.scalar(None, tokens.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, "made"])

    inner = boxed(docs)
    return inner.mapInArrow(tidied(run), T.StructType([*inner.schema.fields, T.StructField("made", T.ArrayType(T.IntegerType()))])).toDF(*docs.columns, free_name(docs, name))


def decode(encoded: DataFrame, model: str | None = None, tokens: str = "tokens", name: str = "decoded") -> DataFrame:
    """encoded with the texts of its token ids. A name that it has already gets underscores after it."""
    path = model or public_tokenizers.path(MODEL)
    place = encoded.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = decode_column(pieces(path), batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*batch.schema.names, "made"])

    inner = boxed(encoded)
    return inner.mapInArrow(tidied(run), T.StructType([*inner.schema.fields, T.StructField("made", T.StringType())])).toDF(*encoded.columns, free_name(encoded, name))


def encoded_and_checked(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, tokens and whether they decode to the text, of every document, in one pass."""
    path = model or public_tokenizers.path(MODEL)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256  # decoded bytes stay few
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                tokens = encode_column(pieces(path), part.column(1), dropout, seed)
                back = decode_column(pieces(path), tokens)
                same = pc.equal(back, pc.fill_null(part.column(1).cast(pa.large_string()), ""))
                yield pa.RecordBatch.from_arrays([part.column(0), pc.list_value_length(tokens).cast(pa.int64()), tokens, same], ["doc_id", "n_tokens", "tokens", "lossless"])

    return named(docs, doc_id=id_column, text=text_column).mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, tokens array<int>, lossless boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    return encoded_and_checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
