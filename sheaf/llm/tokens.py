"""Operator 1: token counts by a compiled finite-state transducer.

A word-ending BPE vocabulary is compiled, lazily, into a deterministic transducer over
symbols: its transitions carry the change of the number of emitted tokens. It rests on two
facts about BPE vocabularies in which every token encodes to itself: a token sequence is the
encoding of its concatenation exactly if every adjacent pair is, and so the last token of
every prefix's encoding is the one token that ends there and forms such a pair with the last
token of the prefix before it. A state holds the longest suffix of the input that may still
become a token, and for every position inside it the last token and the token count relative
to the present. States are interned; a transition is computed the first time it is taken, so
a text costs a table look-up for each symbol.

A text is cut into chunks of CHUNK characters. A chunk's state map sends the state before it to
the state after it and the number of tokens. The state before a chunk is what has been read of
an unfinished word; white space resets it, so a map is a head (which ends the word that comes
in), a constant number of tokens, and a tail (the state that it leaves), all but the head and the
tail the same for every state. State maps compose associatively and a text's count is the
prefix scan of its chunks' maps, pairwise and in rounds.

Defined results: a null text counts as empty (0 bytes, 0 tokens); strings of special tokens
inside a text are one token each, as the library's default has it; repeated rows are counted
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .arrays import tidied
from .columns import named

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a chunk: longer texts are counted by composed state maps.
CHUNK = 1 << 12
#: Compiled states and remembered words before the tables are emptied.
MAX_STATES, MAX_WORDS = 100_000, 250_000
#: White space of the vocabulary's pattern, as the inside of a class.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def category_class(kind: str) -> str:
    """Ranges of the code points whose general category is `kind`, for a class of the standard library's patterns."""
    has = regex.compile(rf"\p{{{kind}}}").match
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and has(chr(c)) is not None
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


class Transducer:
    """BPE of single words, as a lazily compiled deterministic transducer."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        #: Symbols are codes: a byte, or 256 + a byte at the end of a word; a spelling is a string of such codes.
        self.single = {b: vocab[x] for b, x in enumerate(byte_symbols())} | {256 + b: vocab[x + end] for b, x in enumerate(byte_symbols())}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        spelt = {t: chr(code) for code, t in self.single.items()}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            spelt.setdefault(z, spelt[x] + spelt[y])
        self.spelt = spelt
        #: Trie of the tokens: a node for every prefix of a token.
        self.step: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, word in spelt.items():
            node = 0
            for c in map(ord, word):
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.token_at.append(-1)
                node = self.step[node][c]
            self.token_at[node] = token
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget compiled states; 0 is the state before a word. A state has, for each live start (the oldest first), its node, the last token before it and the count there."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.known: dict[tuple, int] = {self.states[0]: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        if len(self.pairs) > 2 * MAX_STATES:
            self.pairs.clear()

    def encode(self, tokens: list[int]) -> list[int]:
        """Merge by rank, the leftmost first, until nothing merges."""
        while len(tokens) > 1:
            best = min((self.rank.get(p, (1 << 60, 0)) + (i,) for i, p in enumerate(zip(tokens, tokens[1:]))), key=lambda x: (x[0], x[2]))
            if best[0] == 1 << 60:
                break
            a, b = tokens[best[2]], tokens[best[2] + 1]
            out, i = [], 0
            while i < len(tokens):
                if i + 1 < len(tokens) and tokens[i] == a and tokens[i + 1] == b:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def joins(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of a's and b's concatenation."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = a < 0 or self.encode([self.single[ord(s)] for t in (a, b) for s in self.spelt[t]]) == [a, b]
        return found

    def advance(self, state: int, code: int) -> tuple[int, int]:
        """Compile one transition: the next state and the change of the token count."""
        live, last, gain = [], None, 0
        for node, before, count in self.states[state]:
            after = self.step[node].get(code)
            if after is None:
                continue
            live.append((after, before, count))
            token = self.token_at[after]
            if last is None and token >= 0 and self.joins(before, token):
                last, gain = token, count + 1
        # counts relative to the new position; a word may begin a token here as well
        to = (*((n, b, c - gain) for n, b, c in live if self.step[n]), (0, last, 0))
        found = self.known.get(to)
        if found is None:
            found = self.known[to] = len(self.states)
            self.states.append(to)
            self.next.append({})
        self.next[state][code] = found, gain
        return found, gain

    def count(self, word: bytes) -> int:
        """Tokens of a word; its last byte is the word-ending symbol."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total, table = 0, 0, self.next
        for c in word[:-1]:
            state, gain = table[state].get(c) or self.advance(state, c)
            total += gain
        code = 256 + word[-1]
        return total + (table[state].get(code) or self.advance(state, code))[1]


@lru_cache(1)
def classes() -> tuple[str, str]:
    """Letters and numbers, compiled once on the driver and sent with the tasks."""
    return category_class("L"), category_class("N")


@lru_cache(2)
def counter(path: str, letters: str | None = None, numbers: str | None = None) -> TokenCounter:
    """One compiled vocabulary for each Python worker, kept from task to task."""
    if letters is None or numbers is None:
        letters, numbers = classes()
    return TokenCounter(path, letters, numbers)


class StateMap:
    """What a chunk does to the lexer: head up to its first white space, tokens between, tail after its last one."""

    __slots__ = ("count", "head", "tail")

    def __init__(self, head: str, count: int | None = None, tail: str = ""):
        self.head, self.count, self.tail = head, count, tail  # count None: no white space inside


class TokenCounter:
    """Counts tokens of texts as the vocabulary's library does."""

    def __init__(self, path: str, letters: str, numbers: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        #: The vocabulary's own pattern (a fixed value), with classes spelt out.
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        self.space = re.compile(f"[{SPACE}]")
        self.memory: dict[str, int] = {}

    def normal(self, text: str) -> str:
        """Composed and lower-cased character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def lexed(self, text: str) -> int:
        memory, count, total = self.memory, self.machine.count, 0
        if len(memory) > MAX_WORDS:
            memory.clear()
        for word, n in Counter(self.words.findall(text)).items():
            tokens = memory.get(word)
            if tokens is None:
                tokens = count(word.encode())
                if len(word) < 64:
                    memory[word] = tokens
            total += tokens * n
        return total

    def chunk_map(self, chunk: str) -> StateMap:
        first = self.space.search(chunk)
        if first is None:
            return StateMap(chunk)
        last = len(chunk) - 1 - self.space.search(chunk[::-1]).start()
        return StateMap(chunk[: first.start()], self.lexed(chunk[first.start() : last]), chunk[last:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.count is None:
            return StateMap(a.head + b.head, b.count, b.tail)
        if b.count is None:
            return StateMap(a.head, a.count, a.tail + b.head)
        return StateMap(a.head, a.count + self.lexed(a.tail + b.head) + b.count, b.tail)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Compose neighbours pairwise until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        total = 0
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        for part in parts:
            part = self.normal(part)
            if len(part) <= chunk:
                total += self.lexed(part)
            else:
                whole = self.scan([self.chunk_map(part[i : i + chunk]) for i in range(0, len(part), chunk)])
                total += self.lexed(whole.head) + (whole.count or 0) + self.lexed(whole.tail)
        return total + len(parts) - 1


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind, (letters, numbers) = docs.schema[id_column].dataType, classes()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, letters, numbers).count
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = np.fromiter((count(x) if (x := t.as_py()) else 0 for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return named(docs, doc_id=id_column, text=text_column).mapInArrow(tidied(counted), f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
