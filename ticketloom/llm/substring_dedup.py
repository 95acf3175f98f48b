"""Substring deduplication with content-defined chunks.

A gear rolling hash (16 bits, so it depends on the last 16 bytes) is read at every word end. A word
end is a cut when its hash is the smallest among its `reach` neighbours on both sides, so cuts depend
on nearby bytes alone and find their places again after an insertion.

What is compared are windows: the fewest neighbouring chunks with at least `min_words` words, from
every chunk forwards and from every chunk backwards, so a repeated run of chunks that has so many
words is covered by repeated windows to both of its ends. Shorter runs are chance and stay. Each
repeated window keeps one copy, its first place in the smallest doc_id that holds it. A window whose
kept copy overlaps one that goes for the sake of another document has no whole copy left and is no
reason to cut anything. Otherwise no chunk of a kept copy is cut, and other copies are. A span goes on over windows whose kept copies lie in
one document in the same order without a gap, so each span has one whole copy, and that copy stays.

Windows cross one shuffle: they are dealt by ranges of (digest, document, place) and sorted, and one
ordered pass hands on those that repeat, with the first copy of their run. A window that a third of
all documents share lies in as many partitions as its size asks for; runs that a border cuts are joined
by what each partition says of its first and last run. Windows are compared by 93 bits of two hashes.

Cases: null texts stay null, empty ones empty; rows without doc_id are neither compared nor cut; rows
that share a doc_id are one document as a source of copies, and kept places hold for each of them;
what kept copies leave of a repeated run is cut if it still has `min_words` words; a long text without white space is one
word; an equal smallest hash is won by the left word; other columns pass through and columns named
like an output are replaced; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chain, mix, slices, store, texts_of

REACH = 2
MIN_WORDS = 20
OUTPUTS = ("n_chunks", "n_dropped_chunks", "dropped_words", "dropped", "kept_text")
_REPEATED, _BROKEN = "__repeated_windows", "__broken_windows"
#: A window's digest of 64 bits goes with a check of 29 bits from a second hash, its place and its width in one number.
CHECK_BITS, PLACE_BITS, WIDTH_BITS = 29, 29, 6

# Fixed value: one random-looking number per byte, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Chunks:
    """Chunks of a slice of texts: owner text, first and last byte, number of words, digest."""

    def __init__(self, texts: pa.Array, reach: int = REACH):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        self.data = memoryview(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        raw = np.frombuffer(self.data, np.uint8)
        self.offsets = offsets
        place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
        solid = ~_SPACE[raw]
        opens = solid & ((place == 0) | ~np.concatenate([[False], solid[:-1]]))
        last = np.zeros(len(raw), bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        closes = solid & (last | ~np.concatenate([solid[1:], [False]]))
        start, end = np.flatnonzero(opens), np.flatnonzero(closes)
        owner = np.searchsorted(offsets, start, side="right") - 1
        value = _gear(raw, place)[end]
        cut = np.ones(len(end), bool)
        for k in range(1, reach + 1):
            same = owner[k:] == owner[:-k]
            cut[k:] &= ~same | (value[k:] < value[:-k])
            cut[:-k] &= ~same | (value[:-k] <= value[k:])
        if len(owner):
            cut[-1] = True
            cut[:-1] |= owner[1:] != owner[:-1]
        to = np.flatnonzero(cut)
        of = np.concatenate([[0], to[:-1] + 1]).astype(np.int64)[:len(to)]
        self.owner, self.start, self.end, self.words = owner[to], start[of], end[to] + 1, to - of + 1
        data, digest = self.data, xxhash.xxh3_128_digest
        both = b"".join([digest(data[a:b]) for a, b in zip(self.start.tolist(), self.end.tolist())])
        self.digest, self.second = np.frombuffer(both, np.uint64).reshape(-1, 2).T.copy()


class Windows:
    """Windows of the chunks of a slice: owner text, first and last chunk, place of the first chunk in its text, digest."""

    def __init__(self, chunks: Chunks, min_words: int = MIN_WORDS):
        n, owner = len(chunks.owner), chunks.owner
        total = np.concatenate([[0], np.cumsum(chunks.words)])
        every = np.arange(n)
        forwards = np.searchsorted(total, total[:-1] + min_words) - 1  # last chunk of the window from each chunk on
        backwards = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # first chunk of the window up to each chunk
        inside, enough = forwards < n, backwards >= 0
        inside[inside] = owner[forwards[inside]] == owner[inside]
        enough[enough] = owner[backwards[enough]] == owner[enough]
        only = enough.copy()
        only[enough] = forwards[backwards[enough]] != every[enough]
        self.first, self.last = np.concatenate([every[inside], backwards[only]]), np.concatenate([forwards[inside], every[only]])
        order = np.lexsort((self.last, self.first))
        self.first, self.last = self.first[order], self.last[order]
        self.owner = owner[self.first]
        bounds = np.searchsorted(owner, np.arange(int(owner[-1]) + 2 if n else 1))
        self.place = self.first - bounds[self.owner]
        width = self.last - self.first + 1
        self.digest, second = (self._joined(mix(d), width) for d in (chunks.digest, chunks.second))
        # what tells windows of equal digests apart lies above their place and width
        check = (second.view(np.uint64) >> np.uint64(64 - CHECK_BITS)).astype(np.int64)
        self.packed = check << (PLACE_BITS + WIDTH_BITS) | self.place << WIDTH_BITS | width

    def _joined(self, digest: np.ndarray, width: np.ndarray) -> np.ndarray:
        made = np.zeros(len(self.first), np.uint64)
        for w in np.unique(width):
            at = width == w
            made[at] = chain(digest, int(w))[self.first[at]]
        return mix(made + width.astype(np.uint64)).view(np.int64)


def _gear(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: sum of GEAR[byte] shifted by its distance, modulo 2^16."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8):
        before = np.concatenate([np.zeros(min(width, len(h)), np.uint16), h[:-width]])
        h = h + np.where(place >= width, before << np.uint16(width), np.uint16(0))
    return h


def _members(reach: int, min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            windows = Windows(Chunks(texts_of(batch), reach), min_words)
            yield pa.record_batch([pa.array(windows.digest), batch.column("doc_id").take(pa.array(windows.owner)), pa.array(windows.packed)], names=["piece", "doc_id", "packed"])

    return run


_FOUND = ["piece", "doc_id", "place", "last", "first_doc", "first_place", "edge"]
_FOUND_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
_CLOSE = pa.struct([("many", pa.bool_())] + [(f"{e}_{n}", pa.int64()) for e in ("head", "tail") for n in ("piece", "check", "n", "doc", "place")])
_FOUND_SCHEMA = pa.schema([*zip(_FOUND, _FOUND_TYPES), ("part", pa.int32()), ("close", _CLOSE)])
HEAD, TAIL = 1, 2


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a sorted partition that are found twice or more, each with the first copy of its run.

    The first run of a partition (HEAD) may go on one before it, and a last window that stands alone
    (TAIL) may go on in the next; the closing row says what these runs are, so that they can be joined.
    Only the first window of a run and whether it has been handed on are remembered.
    """
    part = TaskContext.get().partitionId()

    def rows(piece, doc, packed, first_doc, first_place, edge):
        place = (packed >> WIDTH_BITS) & ((1 << PLACE_BITS) - 1)
        last = place + (packed & ((1 << WIDTH_BITS) - 1)) - 1
        columns = [pa.array(np.asarray(c), t) for c, t in zip((piece, doc, place.astype(np.int32), last.astype(np.int32), first_doc, np.asarray(first_place).astype(np.int32), edge), _FOUND_TYPES)]
        return pa.record_batch([*columns, pa.array(np.full(len(piece), part, np.int32)), pa.nulls(len(piece), _CLOSE)], schema=_FOUND_SCHEMA)

    head, state, in_head = None, None, True  # state: piece, check, rows so far, first row's doc and packed, whether it was handed on
    for batch in batches:
        piece, doc, packed = (np.asarray(batch.column(c)) for c in ("piece", "doc_id", "packed"))
        if not len(piece):
            continue
        check = packed >> (PLACE_BITS + WIDTH_BITS)
        new = np.concatenate([[state is None or (piece[0], check[0]) != state[:2]], (piece[1:] != piece[:-1]) | (check[1:] != check[:-1])])
        if state is None:
            state = (int(piece[0]), int(check[0]), 0, int(doc[0]), int(packed[0]), True)
            new[0] = False  # the first run goes on from an empty state
        elif new[0]:
            yield from _leave(state, in_head, rows, last=False)
            head, in_head = head or state[:5], False
        begins = np.flatnonzero(new)
        run = np.cumsum(new)
        # run 0 is the one that goes on from the state
        first_doc = np.concatenate([[state[3]], doc[begins]])
        first_packed = np.concatenate([[state[4]], packed[begins]])
        size = np.bincount(run, minlength=len(begins) + 1)
        is_head = (run == 0) & in_head
        if not is_head.any() and size[0] and not state[5]:
            yield rows(np.array([state[0]]), np.array([state[3]]), np.array([state[4]]), [state[3]], np.array([state[4] >> WIDTH_BITS & ((1 << PLACE_BITS) - 1)]), [0])
            state = (*state[:5], True)
        keep = is_head | (size[run] > 1) | ((run == 0) & (size[0] > 0))
        places = (first_packed >> WIDTH_BITS) & ((1 << PLACE_BITS) - 1)
        yield rows(piece[keep], doc[keep], packed[keep], first_doc[run[keep]], places[run[keep]], np.where(is_head[keep], HEAD, 0))
        state = (*state[:2], state[2] + int(size[0]), *state[3:])
        if len(begins):
            head, in_head = head or state[:5], False
            at = int(begins[-1])
            state = (int(piece[at]), int(check[at]), int(size[-1]), int(doc[at]), int(packed[at]), bool(size[-1] > 1))
    if state is None:
        return
    yield from _leave(state, in_head, rows, last=True)
    tail = state[:5]
    head = head or tail
    place = lambda p: p >> WIDTH_BITS & ((1 << PLACE_BITS) - 1)
    close = {"many": not in_head, **{f"{e}_{n}": v for e, (pc_, ck, n_, d, pk) in (("head", head), ("tail", tail)) for n, v in (("piece", pc_), ("check", ck), ("n", n_), ("doc", d), ("place", place(pk)))}}
    yield pa.record_batch([*(pa.nulls(1, t) for t in _FOUND_TYPES), pa.array([part], pa.int32()), pa.array([close], _CLOSE)], schema=_FOUND_SCHEMA)


def _leave(state, in_head: bool, rows, last: bool):
    """The lone last window of a partition, which is handed on only if the next partition goes on with it."""
    if last and not in_head and not state[5]:
        place = state[4] >> WIDTH_BITS & ((1 << PLACE_BITS) - 1)
        yield rows(np.array([state[0]]), np.array([state[3]]), np.array([state[4]]), [state[3]], np.array([place]), [TAIL])


def _joined_edges(closings: list) -> list[tuple[int, int, int, int]]:
    """(part, edge, first_doc, first_place) of the edge runs that hold two windows or more over all partitions; `closings` in order."""
    groups: list[list] = []  # key, rows, doc, place, members
    for c in closings:
        for edge, name in ((HEAD, "head"), (TAIL, "tail")) if c["many"] else ((HEAD, "head"),):
            key = (c[f"{name}_piece"], c[f"{name}_check"])
            if groups and groups[-1][0] == key and edge == HEAD:
                groups[-1][1] += c[f"{name}_n"]
                groups[-1][4].append((c["part"], edge))
            else:
                groups.append([key, c[f"{name}_n"], c[f"{name}_doc"], c[f"{name}_place"], [(c["part"], edge)]])
    return [(part, edge, doc, place) for _, n, doc, place, members in groups if n > 1 for part, edge in members]


def repeated_windows(docs: DataFrame, reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, place, last, piece, first_doc, first_place) of the windows of (doc_id, text) found more than once."""
    made = docs.mapInArrow(_members(reach, min_words), "piece bigint, doc_id bigint, packed bigint")
    order = ["piece", F.shiftright("packed", PLACE_BITS + WIDTH_BITS), "doc_id", "packed"]
    close = "struct<many boolean, " + ", ".join(f"{e}_{n} bigint" for e in ("head", "tail") for n in ("piece", "check", "n", "doc", "place")) + ">"
    found = made.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _repeated, f"piece bigint, doc_id bigint, place int, last int, first_doc bigint, first_place int, edge int, part int, close {close}")
    found = store(found, "substring-windows")
    edges = _joined_edges(found.where("close is not null").select("part", "close.*").orderBy("part").collect())
    # two rows per range partition at most
    known = F.broadcast(docs.sparkSession.createDataFrame(edges, "part int, edge int, __doc bigint, __place int"))
    joined = found.where("close is null").join(known, ["part", "edge"], "left").where((F.col("edge") == 0) | F.col("__doc").isNotNull())
    return joined.select("doc_id", "place", "last", "piece", F.coalesce("__doc", "first_doc").alias("first_doc"), F.coalesce("__place", "first_place").alias("first_place"))


def _broken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose kept copy overlaps a window of its document that another document keeps."""
    for batch in batches:
        found = []
        for doc, windows in zip(batch.column("doc_id").to_pylist(), batch.column(_REPEATED)):
            place, last, piece, source, first = (np.asarray(windows.values.field(n)) for n in ("place", "last", "piece", "first_doc", "first_place"))
            other = source != doc
            kept = ~other & (first == place)
            if other.any() and kept.any():
                size = int(last.max()) + 2
                ends = np.bincount(place[other], minlength=size) - np.bincount(last[other] + 1, minlength=size)
                before = np.concatenate([[0], np.cumsum(np.cumsum(ends) > 0)])
                found.append(piece[kept][before[last[kept] + 1] > before[place[kept]]])
        yield pa.record_batch([pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["piece"])


def _segments(first: np.ndarray, last: np.ndarray, doc: np.ndarray, shift: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, source) of runs of windows whose kept copies make one gapless run in one document; both ends never fall."""
    if not len(first):
        return []
    starts = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1]) | (first[1:] > last[:-1] + 1)])
    begin = np.flatnonzero(starts)
    return list(zip(first[begin].tolist(), last[np.append(begin[1:], len(last)) - 1].tolist(), doc[begin].tolist()))


def _cover(segments: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Disjoint pieces (first, last, source) of segments, sorted by first chunk, that cover the same chunks; the farthest one goes on."""
    at, i, far, source = 0, 0, -1, 0
    while True:
        while i < len(segments) and segments[i][0] <= at:
            if segments[i][1] > far:
                _, far, source = segments[i]
            i += 1
        if far >= at:
            yield at, far, source
            at = far + 1
        elif i < len(segments):
            at = segments[i][0]
        else:
            return


def _spans(segments: list[tuple[int, int, int]], stays: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """The parts (first, after, source) of segments outside `stays`, in gapless runs of at least `min_words` words."""
    parts = []
    for a, b, source in _cover(segments):
        edges = np.flatnonzero(np.diff(np.concatenate([[True], stays[a:b + 1], [True]]).astype(np.int8))) + a
        parts += [(x, y, source) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]
    kept, run, size = [], [], 0
    for part in parts:
        if run and run[-1][1] != part[0]:
            kept, run, size = kept + run if size >= min_words else kept, [], 0
        run.append(part)
        size += int(words[part[0]:part[1]].sum())
    return kept + run if size >= min_words else kept


def _cut(names: list[str], reach: int, min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            chunks = Chunks(texts, reach)
            windows = Windows(chunks, min_words)
            lists, gone_lists = batch.column(_REPEATED), batch.column(_BROKEN)
            ids = batch.column("doc_id").to_pylist()
            bounds, held = (np.searchsorted(x.owner, np.arange(len(texts) + 1)) for x in (chunks, windows))
            out = {n: [] for n in OUTPUTS}
            for doc in range(len(texts)):
                lo, hi = int(bounds[doc]), int(bounds[doc + 1])
                begin, stop = int(chunks.offsets[doc]), int(chunks.offsets[doc + 1])
                found = lists[doc]
                spans, dropped_chunks, dropped_words, pieces, at = [], 0, 0, [], begin
                if found.is_valid:
                    mine = slice(int(held[doc]), int(held[doc + 1]))
                    digest, first, last = windows.digest[mine], windows.place[mine], windows.last[mine] - lo
                    keys, sources, places = (np.asarray(found.values.field(n)) for n in ("piece", "first_doc", "first_place"))
                    if gone_lists[doc].is_valid:
                        whole = ~np.isin(keys, np.asarray(gone_lists[doc].values))
                        keys, sources, places = keys[whole], sources[whole], places[whole]
                if found.is_valid and len(keys):
                    order = np.argsort(keys)
                    keys, sources, places = keys[order], sources[order], places[order].astype(np.int64)
                    where = np.minimum(np.searchsorted(keys, digest), len(keys) - 1)
                    source, shift = sources[where], places[where] - first
                    repeated = keys[where] == digest
                    kept = repeated & (source == ids[doc]) & (shift == 0)
                    ends = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(ends, first[kept], 1)
                    np.add.at(ends, last[kept] + 1, -1)
                    stays = np.cumsum(ends)[:-1] > 0
                    gone = repeated & ~kept
                    for a, b, copy in _spans(_segments(first[gone], last[gone], source[gone], shift[gone]), stays, chunks.words[lo:hi], min_words):
                        start, after = int(chunks.start[lo + a]), int(chunks.start[lo + b]) if lo + b < hi else stop
                        pieces.append(bytes(chunks.data[at:start]))
                        spans.append({"start_byte": start - begin, "end_byte": int(chunks.end[lo + b - 1]) - begin, "first_doc_id": copy})
                        at, dropped_chunks, dropped_words = after, dropped_chunks + b - a, dropped_words + int(chunks.words[lo + a:lo + b].sum())
                pieces.append(bytes(chunks.data[at:stop]))
                for n, v in zip(OUTPUTS, (hi - lo, dropped_chunks, dropped_words, spans, b"".join(pieces).decode())):
                    out[n].append(v)
            made = {n: pa.array(out[n], _TYPES[n]) for n in OUTPUTS}
            yield pa.record_batch([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


_SPAN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start_byte", "end_byte", "first_doc_id")]))
_TYPES = {"n_chunks": pa.int64(), "n_dropped_chunks": pa.int64(), "dropped_words": pa.int64(), "kept_text": pa.string(),
          "dropped": pa.list_(pa.struct([(n, pa.int64()) for n in ("start_byte", "end_byte", "first_doc_id")]))}


def drop_repeated_substrings(docs: DataFrame, reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with n_chunks, n_dropped_chunks, dropped_words, dropped (byte spans, and the document that keeps the whole of each) and kept_text."""
    docs = docs.drop(*OUTPUTS, _REPEATED, _BROKEN)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    listed = F.collect_list(F.struct("place", "last", "piece", "first_doc", "first_place"))
    lists = store(repeated_windows(known, reach, min_words).groupBy(F.col("doc_id").alias("__id")).agg(listed.alias(_REPEATED)), "substring-lists")
    broken = lists.select(F.col("__id").alias("doc_id"), _REPEATED).mapInArrow(_broken, "piece bigint").distinct()
    # few windows are broken; the documents that hold them are told
    told = (lists.select("__id", F.explode(F.col(f"{_REPEATED}.piece")).alias("piece")).join(broken, "piece")
            .groupBy(F.col("__id").alias("__told")).agg(F.collect_set("piece").alias(_BROKEN)))
    lists = lists.join(told, lists["__id"] == told["__told"], "left").drop("__told")
    fields = [*docs.schema.fields, T.StructField("n_chunks", T.LongType()), T.StructField("n_dropped_chunks", T.LongType()), T.StructField("dropped_words", T.LongType()),
              T.StructField("dropped", _SPAN), T.StructField("kept_text", T.StringType())]
    return docs.join(lists, docs["doc_id"] == lists["__id"], "left").drop("__id").mapInArrow(_cut([f.name for f in fields], reach, min_words), T.StructType(fields))
