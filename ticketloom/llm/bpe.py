"""Byte-level BPE over a rank file: encoding and decoding.

A text is cut by the tokenizer's pattern. Two tiers resolve a pre-token: a minimal perfect hash over
the vocabulary answers pre-tokens that are one token, and the rest are merged with a heap of
neighbour ranks over a linked list of bytes. Both tiers see each distinct pre-token of a slice once;
the pattern, too, only sees distinct stretches between single spaces.

Cases: null texts encode to no ids and decode to the empty string; invalid UTF-8 cannot occur in a
text; ids outside the vocabulary are an error; other columns pass through and columns named like an
output are replaced; rows are independent, so ties, repeated rows and missing ids need no rule.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, strings, texts_of

CACHE_ENTRIES = 150_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: a key's first hash picks a group, and the group's
    displacement sends its keys to places that no other key has. As many places as keys."""

    def __init__(self, keys: list[bytes], per_group: int = 3):
        self.keys, self.size = keys, len(keys)
        self.groups = max(1, self.size // per_group)
        members: list[list[int]] = [[] for _ in range(self.groups)]
        for i, key in enumerate(keys):
            members[self._hash(key)[0]].append(i)
        self.slots = [-1] * self.size
        self.displacement = [0] * self.groups
        free = None
        for group in sorted(range(self.groups), key=lambda g: -len(members[g])):
            ids = members[group]
            if len(ids) == 1:
                # single keys take the remaining places directly
                free = free if free is not None else iter([s for s in range(self.size) if self.slots[s] < 0])
                place = next(free)
                self.slots[place], self.displacement[group] = ids[0], -place - 1
            elif ids:
                seeds = [self._hash(keys[i])[1] for i in ids]
                d = 0
                while True:
                    places = {self._place(seed, d) for seed in seeds}
                    if len(places) == len(ids) and all(self.slots[p] < 0 for p in places):
                        break
                    d += 1
                self.displacement[group] = d
                for i, seed in zip(ids, seeds):
                    self.slots[self._place(seed, d)] = i

    def _hash(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.groups, h >> 64

    def _place(self, seed: int, displacement: int) -> int:
        x = (seed + displacement * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.size

    def find(self, key: bytes) -> int:
        """The key's number, or -1 when it is not a key."""
        group, seed = self._hash(key)
        d = self.displacement[group]
        i = self.slots[-d - 1 if d < 0 else self._place(seed, d)]
        return i if i >= 0 and self.keys[i] == key else -1


class Vocabulary:
    """One rank file in a Python worker, with a bounded cache of merged pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.whole = PerfectHash(self.tokens)
        self.pattern = regex.compile(pattern)
        self.bytes_array = pa.array(self.tokens, pa.binary())
        self.byte_id = [0] * 256
        for rank, token in enumerate(self.tokens):
            if len(token) == 1:
                self.byte_id[token[0]] = rank
        self.pairs = self._merges()
        # two generations: what is still in use moves on to the newer one
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _merges(self) -> dict[int, int]:
        """Rank of every merge of two tokens, by left * 2^32 + right; bounded by the vocabulary."""
        merges = {}
        for rank, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left = self.whole.find(token[:cut])
                if left >= 0 and (right := self.whole.find(token[cut:])) >= 0:
                    merges[left << 32 | right] = rank
        return merges

    def merge(self, raw: bytes) -> list[int]:
        """Merges the bytes of a pre-token, lowest rank first and leftmost among equals."""
        ids = list(map(self.byte_id.__getitem__, raw))
        n = len(ids)
        rank_of = self.pairs.get
        # heap entries are rank * n + place; an entry counts only while its pair still has that rank
        heap = [r * n + i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(pop(heap), n)
            left = ids[i]
            if left < 0 or (j := after[i]) == n or rank_of(left << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(rank << 32 | ids[k])) is not None:
                    push(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << 32 | rank)) is not None:
                push(heap, r * n + h)
        return [x for x in ids if x >= 0]

    def encode_pretoken(self, pretoken: str) -> list[int]:
        found = self.cache.get(pretoken)
        if found is None:
            found = self.older.get(pretoken)
            if found is None:
                raw = pretoken.encode()
                whole = self.whole.find(raw)
                found = [whole] if whole >= 0 else self.merge(raw)
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[pretoken] = found
        return found

    def encode_all(self, stretches: list[str]) -> list[list[int]]:
        # a space and letters are one pre-token; only other stretches need the pattern
        cut, one = self.pattern.findall, self.encode_pretoken
        return [one(s) if s[1:].isalpha() and s[0] == " " else [i for pretoken in cut(s) for i in one(pretoken)] for s in stretches]


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[(path, pattern)] = Vocabulary(path, pattern)
    return _LOADED[(path, pattern)]


def stretches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Cuts texts at spaces that stand alone between two characters that are not white space.

    No pre-token of the pattern crosses such a space, and the space itself opens the next pre-token.
    Texts with other white space around a space are one stretch. Returns the number of stretches per
    text, a code per stretch, and the distinct stretches.
    """
    mixed = np.asarray(pc.match_substring_regex(texts, r"^ | $|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b] | [\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"))
    split = pc.split_pattern(pc.if_else(pa.array(mixed), "", texts), " ")
    offsets = np.asarray(split.offsets).astype(np.int64)
    counts = np.diff(offsets)
    parts = split.flatten().dictionary_encode()
    codes = np.asarray(parts.indices).astype(np.int64)
    distinct = strings(parts.dictionary)
    first = np.zeros(len(codes), bool)
    first[offsets[:-1]] = True
    # a stretch that does not open its text carries the space before it
    spaced = np.unique(codes[~first])
    place = np.zeros(len(distinct), np.int64)
    place[spaced] = np.arange(len(spaced))
    names = [" " + distinct[i] for i in spaced.tolist()]
    opening = codes[offsets[:-1]]
    codes = np.where(first, 0, place[codes])
    codes[offsets[:-1]] = len(names) + np.arange(len(texts))
    whole = strings(texts) if mixed.any() else None
    names += [whole[i] if mixed[i] else distinct[opening[i]] for i in range(len(texts))]
    return counts, codes, names


def encode_slice(vocab, texts: pa.Array) -> pa.ListArray:
    """The ids of every text of a slice. `vocab.encode_all` encodes distinct stretches of text."""
    counts, codes, names = stretches(texts)
    encoded = vocab.encode_all(names)
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                     pa.array(np.fromiter(itertools.chain.from_iterable(encoded), np.int32, int(sizes.sum()))))
    taken = table.take(pa.array(codes))
    ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), taken.flatten())


def _with_column(names: list[str], made: str, fn):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (pa.record_batch([fn(b) if n == made else b.column(n) for n in names], names=names) for b in batches)

    return run


def _add(df: DataFrame, source: str, name: str, kind: T.DataType, size: int, fn) -> DataFrame:
    rest = df.drop(name) if name != source else df
    fields = [*[f for f in rest.schema.fields if f.name != name], T.StructField(name, kind)]
    names = [f.name for f in fields]

    def run(batches):
        return _with_column(names, name, fn)(slices(batches, source, size) if size else batches)

    return rest.mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of a text column. `path` must be readable on every executor."""
    return _add(docs, text, out, T.ArrayType(T.IntegerType(), False), 4 << 20, lambda b: encode_slice(vocabulary(path, pattern), texts_of(b, text)))


def decode_slice(vocab: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """Bytes of every id list: one gather of token bytes, cut at the lists' ends."""
    lists = pc.fill_null(ids, pa.scalar([], ids.type))
    flat = np.asarray(lists.flatten()).astype(np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= len(vocab.tokens)):
        raise ValueError("an id is not in the vocabulary")
    taken = vocab.bytes_array.take(pa.array(flat))
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(taken)).astype(np.int64))])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of an id column; a null list is empty."""
    return _add(df, ids, out, T.BinaryType(), 0, lambda b: decode_slice(vocabulary(path, pattern), b.column(ids)))
