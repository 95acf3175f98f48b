"""Exact Jaccard join of n-gram sets and the groups its links form.

Index lists by position. A set of a size class is cut into positions (ranges of the n-gram hash).
Two linked sets differ in at most k = 6 * (largest size) / 37 n-grams in sum (for a similarity of
85 %), and every n-gram lies in one position, so with more than k positions some of them agree
entirely. The index list of (class, position) is skipped through in blocks: only sets whose whole
block content is equal meet, not all sets that share an n-gram. Positions empty in a set prove
nothing; there are a few more positions than k + 1 to make up for them, and a set with too many
empty ones also lists those. A set near the upper size of its class is listed in the next class too.

Answers from a similar set. In every list a head, the set nearest to the middle, is compared with the
others exactly. What is known of it bounds the rest: Jaccard distance is a metric, so two sets whose
distances to the head differ by more than the limit are not linked and are skipped. Sets already in one
group need no comparison at all, and sets that share fewer lists than a link needs are not linked. In
short lists what is left is compared in a second pass; in long ones only sets meet that share a rare
n-gram of their differences from a hub, of which linked sets must share some. The hub is the head or a
head linked with it that stands in more and longer lists, so most sets have one hub for all their long
lists. No link between different groups is lost, and a group of many copies costs one comparison a member.

Equal sets are one node. Lists are read in sorted runs from range partitions over (list, node), whose
borders come from the lists of some texts, so a list of any length is spread over tasks and never held in memory; run heads across partitions are
compared like other members.

Cases: null, empty and blank texts have an empty set and are their own component; a text with fewer
words than n is one n-gram of all its words; repeated rows and rows with equal sets are one group;
rows without doc_id have component null and take no part; other columns are not read, so their names
cannot clash; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, chain, mix, same_text, slices, store, texts_of
from .components import components

SHINGLE = 4
PERCENT = 85
CLASS_RATIO = 1.6
#: Members of a list up to this length are paired; those of longer ones meet by their differences from its head.
BRIEF = 32
#: Bytes of text that a task cuts into n-grams at once.
SLICE = 2 << 20


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of every text, sorted by owner and hash."""
    words = Words(texts, lower=True)
    hashes = mix(words.hashes())
    inside = same_text(words.owner, n)
    owner, grams = words.owner[:len(inside)][inside], chain(hashes, n)[inside]
    short = np.flatnonzero((words.per_text > 0) & (words.per_text < n))
    if len(short):
        starts = np.searchsorted(words.owner, short)
        whole = np.array([_fold(hashes[a:a + c]) for a, c in zip(starts.tolist(), words.per_text[short].tolist())], np.uint64)
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[new], grams[new]


def _fold(hashes: np.ndarray) -> np.uint64:
    return chain(mix(hashes + np.uint64(len(hashes))), len(hashes))[0]


def _set_digests(owner: np.ndarray, grams: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit digest per text; the digest does not depend on any order."""
    size = np.bincount(owner, minlength=texts)
    total = np.zeros(texts, np.uint64)
    np.add.at(total, owner, mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)))
    return size, mix(total + size.astype(np.uint64))


def size_classes(largest: int, ratio: float = CLASS_RATIO) -> list[int]:
    """Upper sizes of the classes, up to one that holds `largest`."""
    uppers = [8]
    while uppers[-1] < largest:
        uppers.append(int(uppers[-1] * ratio))
    return uppers


def positions_of(upper: int, percent: int) -> tuple[int, int]:
    """(k, positions) of a class: how many n-grams two linked sets differ in at most, and into how many positions sets are cut."""
    k = (100 - percent) * 2 * upper // (100 + percent)
    return k, k + 2 + k // 8


def list_keys(owner: np.ndarray, grams: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, list, tag) for every index list that a text's set stands in.

    The tag is the class and the number of lists of that class that a linked set must share. Every
    n-gram that only one of two sets has spoils one position at most. A set that is linked with one of
    size a has b <= 100 a / percent n-grams, and b <= the class's upper size, so at most
    (100 - percent) (a + b) / (100 + percent) positions differ, and all other filled ones agree.
    """
    uppers = np.array(size_classes(int(CLASS_RATIO * max(8, size.max(initial=0)))), np.int64)
    limits = [positions_of(int(u), percent) for u in uppers]
    parts = np.array([p[1] for p in limits])
    width = int(parts.max()) + 1
    own = np.searchsorted(uppers, size)
    spread = mix(grams + np.uint64(0x1234567))
    linkable = size * 100 >= percent * (size + 1)  # smaller sets have no linked set but an equal one
    texts, lists, tags = [], [], []
    for level, wanted in ((own, linkable), (own + 1, linkable & (size * 100 >= percent * (uppers[own] + 1)))):
        chosen = wanted[owner]
        if not chosen.any():
            continue
        level = np.minimum(level, len(uppers) - 1)
        who, gram, lv = owner[chosen], spread[chosen], level[owner[chosen]]
        place = who * width + ((gram >> np.uint64(32)) * parts[lv].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, gram = place[order], gram[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        text, position = place[first] // width, place[first] % width
        differ = (100 - percent) * (size + np.minimum(size * 100 // percent, uppers[level])) // (100 + percent)
        need = np.bincount(text, minlength=len(size)) - differ
        texts.append(text)
        lists.append(mix(np.add.reduceat(mix(gram), first) + mix((level[text] * (1 << 32) + position).astype(np.uint64))))
        tags.append(level[text] << 24 | np.maximum(need[text], 1))
        # sets with so many empty positions that no filled one must agree list the empty ones as well
        needy = np.flatnonzero(wanted & (need < 1))
        if len(needy):
            grid = np.repeat(needy, width) * width + np.tile(np.arange(width), len(needy))
            grid = grid[(grid % width < parts[level[grid // width]]) & ~np.isin(grid, place[first])]
            texts.append(grid // width)
            lists.append(mix((level[grid // width] * (1 << 32) + grid % width).astype(np.uint64) + np.uint64(0xE000000000000000)))
            tags.append(level[grid // width] << 24 | 1)
    empty = np.empty(0, np.int64)
    return (np.concatenate(texts), np.concatenate(lists), np.concatenate(tags)) if texts else (empty, empty.view(np.uint64), empty)


_RUN = ["list", "node", "size", "tag", "head", "edge"]


def _nodes(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            size, digest = _set_digests(*shingle_sets(texts_of(batch), shingle), batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(size), pa.array(digest.view(np.int64))], names=["doc_id", "n_shingles", "node"])

    return run


def _same_set(shingle: int):
    """Keeps the rows whose text has the set that the node stands for (ids may repeat)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            _, digest = _set_digests(*shingle_sets(texts_of(batch), shingle), batch.num_rows)
            yield batch.filter(pa.array(digest.view(np.int64) == np.asarray(batch.column("node"))))

    return run


def _places(lists: np.ndarray, nodes: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted (list, node) bounds are not above each (list, node)."""
    low, high = (np.searchsorted(bounds[0], lists, side) for side in ("left", "right"))
    place = high.astype(np.int32)
    for start in np.unique(low[low < high]).tolist():  # lists that a bound cuts
        rows = np.flatnonzero((low == start) & (high > start))
        place[rows] = start + np.searchsorted(bounds[1][start:high[rows[0]]], nodes[rows], "right")
    return place


def _bounds(texts: DataFrame, shingle: int, percent: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, node) pairs that cut the index into about equal ranges, from the lists of some of the texts. They decide
    which task reads a row and nothing else; Spark's own ranges would cut all texts into lists a second time."""
    some = texts.sample(1 / 16, seed=1).mapInArrow(_listed(shingle, percent), _LISTED).select("list", "node")
    keys = sorted(map(tuple, some.orderBy(F.rand(1)).limit(64 * parts).collect()))
    cuts = np.array([keys[len(keys) * i // parts] for i in range(1, parts)] if keys else [], np.int64).reshape(-1, 2)
    return cuts[:, 0], cuts[:, 1]


_LISTED = "list bigint, node bigint, size int, tag int, place int"


def _listed(shingle: int, percent: int, bounds: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            owner, grams = shingle_sets(texts_of(batch), shingle)
            size, digest = _set_digests(owner, grams, batch.num_rows)
            text, lists, tags = list_keys(owner, grams, size, percent)
            lists, nodes = lists.view(np.int64), digest[text].view(np.int64)
            place = _places(lists, nodes, bounds)
            yield pa.record_batch([*map(pa.array, (lists, nodes, size[text].astype(np.int32), tags.astype(np.int32), place))], names=[*_RUN[:4], "place"])

    return run


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the lists of a sorted partition that hold two nodes or more, each with the first node
    of its run. The heads of the first and the last run, which may go on in a neighbouring partition,
    are marked as edges. Only the head and the last row of a run are remembered."""

    def rows(lists, nodes, sizes, tags, heads, edge):
        return pa.record_batch([*map(pa.array, (lists, nodes, sizes, tags, heads)), pa.array(np.full(len(lists), edge))], names=_RUN)

    state = None  # list, head, size and tag of the head, last node, whether the head has been written
    for batch in batches:
        lists, nodes, sizes, tags = (np.asarray(batch.column(n)) for n in _RUN[:4])
        if not len(lists):
            continue
        if state is None:
            yield rows(lists[:1], nodes[:1], sizes[:1], tags[:1], nodes[:1], True)
            state = (lists[0], nodes[0], sizes[0], tags[0], nodes[0], False)
        starts = lists != np.concatenate([[state[0]], lists[:-1]])
        run, begin = np.cumsum(starts), np.flatnonzero(starts)
        run_list, run_head, run_size, run_tag = (np.concatenate([[s], a[begin]]) for s, a in zip(state[:4], (lists, nodes, sizes, tags)))
        written = np.zeros(len(run_list), bool)
        written[0] = state[5]
        member = (nodes != run_head[run]) & (starts | (nodes != np.concatenate([[state[4]], nodes[:-1]])))
        used = np.zeros(len(run_list), bool)
        used[run[member]] = True
        head = used & ~written
        yield rows(lists[member], nodes[member], sizes[member], tags[member], run_head[run][member], False)
        yield rows(run_list[head], run_head[head], run_size[head], run_tag[head], run_head[head], False)
        state = (lists[-1], run_head[-1], run_size[-1], run_tag[-1], nodes[-1], bool(written[-1] | used[-1]))
    if state is not None:
        yield rows(*(np.array([v]) for v in state[:2]), *(np.array([v], np.int32) for v in state[2:4]), np.array([state[1]]), True)


def _paired_sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram) of the sets of text_a and of text_b."""
    owner, grams = shingle_sets(texts_of(batch, "text_b"), shingle)
    # rows come sorted by a: each of its runs is cut into shingles once and repeated per pair
    a = np.asarray(batch.column("a"))
    new = np.concatenate([[True], a[1:] != a[:-1]])
    owner_a, grams_a = shingle_sets(texts_of(batch, "text_a").take(pa.array(np.flatnonzero(new))), shingle)
    bounds = np.searchsorted(owner_a, np.arange(int(new.sum()) + 1))
    which = np.cumsum(new) - 1
    sizes_a = np.diff(bounds)[which]
    pair = np.repeat(np.arange(batch.num_rows), sizes_a)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes_a) - sizes_a, sizes_a) + np.repeat(bounds[which], sizes_a)
    return pair, grams_a[at], owner, grams


def _in_pair(grams: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return mix(grams ^ mix(pair.astype(np.uint64)))


def _compare(shingle: int, percent: int):
    """Exact sizes of the intersections of (text_a, text_b) pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", SLICE), "text_b", SLICE):
            pair, grams_a, owner, grams = _paired_sets(batch, shingle)
            sizes_a, sizes = (np.bincount(x, minlength=batch.num_rows) for x in (pair, owner))
            both = np.isin(_in_pair(grams, owner), _in_pair(grams_a, pair))
            shared = np.bincount(owner[both], minlength=batch.num_rows)
            union = sizes_a + sizes - shared
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(100 * shared >= percent * union), pa.array(1 - shared / np.maximum(union, 1))], names=["a", "b", "linked", "distance"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`texts` has one text per node."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked, distance) of pairs of nodes."""
    both = _with_texts(pairs, texts).select("a", "b", "text_a", "text_b")
    return store(both.mapInArrow(_compare(shingle, percent), "a bigint, b bigint, linked boolean, distance double"), "jaccard-verified")


_APART = ["a", "b", "size", "group", "known"]


def _differences(shingle: int, percent: int):
    """Per pair the n-grams that only one of (text_a, text_b) has, those of b first (the last `gone` are those of a), whether the
    two are linked, and how many of the last ones in order need not be looked at: see `_linked_by_difference`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", SLICE), "text_b", SLICE):
            pair, grams_a, owner, grams = _paired_sets(batch, shingle)
            of_a, of_b = _in_pair(grams_a, pair), _in_pair(grams, owner)
            only_a, only_b = ~np.isin(of_a, of_b), ~np.isin(of_b, of_a)
            row, gram = np.concatenate([owner[only_b], pair[only_a]]), np.concatenate([grams[only_b], grams_a[only_a]])
            sizes_a, sizes, differ, gone = (np.bincount(x, minlength=batch.num_rows) for x in (pair, owner, row, pair[only_a]))
            union = (sizes_a + sizes + differ) // 2
            linked, distance = 100 * (union - differ) >= percent * union, differ / np.maximum(union, 1)
            half = (differ * (100 + percent) + (100 - percent) * (sizes_a - sizes)) // (2 * (100 + percent))
            far = np.maximum(differ - (100 - percent) * (sizes + 100 * sizes // percent) // (100 + percent) - 1, 0)
            skip = np.maximum(half, far)
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(differ)]), pa.int32()), pa.array(gram[np.argsort(row, kind="stable")].view(np.int64)))
            yield pa.record_batch([*batch.select(_APART).columns, pa.array(linked), pa.array(distance), *(pa.array(v.astype(np.int32)) for v in (skip, np.where(linked, skip, far), gone)), made],
                                  names=[*_APART, "linked", "distance", "skip", "least", "gone", "grams"])

    return run


def _may_link(percent: int):
    """Whether nodes x and y of one list are in different groups and neither their sizes nor their distances to its head tell them apart."""
    limit = (100 - percent) / 100 + 1e-9
    return ((F.col("x_group") != F.col("y_group")) & (F.abs(F.col("x_distance") - F.col("y_distance")) <= limit)
            & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size")))


def _offered(made: DataFrame) -> DataFrame:
    """One row per n-gram that another node may have to meet: all that a node has and its head has not; what it lacks, if some
    of that is looked at for any partner, or, for partners linked with the head only, what such partners offer of that."""
    new = F.size("grams") - F.col("gone")
    lacked = F.slice("grams", new + 1, F.col("gone"))
    wanted = made.where("linked and gone > skip").select("head", F.explode(lacked).alias("gram")).groupBy("head").agg(F.collect_set("gram").alias("wanted"))
    some = F.when((F.col("gone") > F.col("least")) & F.col("wanted").isNotNull(), F.array_intersect(lacked, "wanted")).otherwise(F.array().cast("array<bigint>"))
    shown = F.when(F.col("gone") > F.col("skip"), F.col("grams")).otherwise(F.concat(F.slice("grams", F.lit(1), new), some))
    rows = made.join(wanted, "head", "left").select(*[c for c in made.columns if c not in ("grams", "known")], new.alias("new"), F.posexplode(shown).alias("place", "gram"))
    return rows.withColumn("lacks", F.col("place") >= F.col("new")).drop("new", "place")


def _linked_by_difference(apart: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) of linked nodes of different groups that meet at one head h, where `linked` tells which nodes are known to
    be linked with h. A node that turns out to be linked with h gives its link with h, too.

    With D(x) the n-grams that only one of x and h has, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    n-grams. Nodes linked with h are in one group; of two others one at least, y, is not linked with h. With
    c = (100 - percent) / (100 + percent), |D(y)| > c (|h| + |y|), and a link asks for at most c (|x| + |y|)
    differences; so x and y share more than s = (|D(x)| + c (|h| - |x|)) / 2 n-grams of D(x), which is over
    zero. D(x) and D(y) differ where x and y do, and |x| <= 100 |y| / percent, so they share at least
    |D(y)| - c (|x| + |y|) of D(y) as well, whoever is linked with h. In any order of the n-grams of a head, each
    node may leave out its last ones, one fewer than it shares: the first n-gram that the pair shares is kept by both.

    What a node has and h has not comes first, then what it lacks, the rarest first in either. Few nodes have the
    former in common, and D(x) without them is mostly no more than may be left out; only nodes for which it is more
    offer what they lack, and others what they lack of that. So near copies meet by what was changed in both, not by
    the text they have in common.
    """
    pairs = apart.withColumnsRenamed({"head": "a", "node": "b", "linked": "known"})
    made = _with_texts(pairs, texts).select(*_APART, "text_a", "text_b").mapInArrow(
        _differences(shingle, percent), "a bigint, b bigint, size int, group bigint, known boolean, linked boolean, distance double, skip int, least int, gone int, grams array<bigint>")
    made = store(made.withColumnsRenamed({"a": "head", "b": "node"}), "jaccard-differences")
    offered = _offered(made)
    common = offered.groupBy("head", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # n-grams that no other node changed are the rarest and meet nothing: places are counted from the other end
    frequent = W.partitionBy("head", "node", "lacks").orderBy(F.col("n").desc(), F.col("gram").desc())
    ranked = offered.join(common, ["head", "gram"]).withColumn("from_end", F.row_number().over(frequent) + F.when(F.col("lacks"), 0).otherwise(F.col("gone")))
    ranked = ranked.where("from_end > least or lacks and gone <= skip").withColumn("rare", F.col("from_end") > F.col("skip")).drop("n", "skip", "least", "gone", "lacks", "from_end")
    ranked = store(ranked, "jaccard-ranked")
    left, right = (rows.select("head", "gram", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "group", "linked", "distance", "rare")])
                   for s, rows in (("x", ranked.where("rare")), ("y", ranked.where("not linked"))))
    met = left.join(right, ["head", "gram"]).where((F.col("x_linked") | (F.col("y_rare") & (F.col("x_node") < F.col("y_node")))) & _may_link(percent))
    met = met.select("head", F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    for s in "ab":
        met = met.join(made.select("head", F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("grams").alias(f"grams_{s}")), ["head", s])
    differ = F.size("grams_a") + F.size("grams_b") - 2 * F.size(F.array_intersect("grams_a", "grams_b"))
    linked = (100 + percent) * differ <= (100 - percent) * (F.col("size_a") + F.col("size_b"))
    to_head = made.where("linked and not known").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return store(met.where(linked).select("a", "b").unionByName(to_head).distinct(), "jaccard-linked")


def _central(members: DataFrame) -> DataFrame:
    """Members of lists with the list's length and a head that stands in many long lists: of near copies of one text,
    the one nearest to it. So a node has few heads, and most of a group is linked with its head. `weight` is the head's."""
    lengths = members.groupBy("list").agg(F.count(F.lit(1)).alias("length"))
    sized = members.join(lengths, "list")
    weight = sized.groupBy("node").agg(F.sum("length").alias("weight"))
    heads = sized.select("list", "node").join(weight, "node").groupBy("list").agg(F.max(F.struct("weight", "node")).alias("top"))
    return sized.join(heads.select("list", F.col("top.node").alias("head"), F.col("top.weight").alias("weight")), "list")


def _hubs(members: DataFrame, first: DataFrame) -> DataFrame:
    """(head, weight, hub) of every head: the heaviest head that it is linked with, where heavier than itself. A hub stands
    in none of the lists whose head it replaces, or it would be their head. Nearly all near copies of one text have one hub."""
    weights = members.select("head", "weight").distinct()
    own = weights.select("head", F.struct("weight", F.col("head").alias("hub")).alias("top"))
    over = first.where("linked").select(F.col("a").alias("hub"), F.col("b").alias("head")).join(weights.withColumnRenamed("head", "hub"), "hub")
    over = over.join(weights.select("head"), "head", "left_semi").select("head", F.struct("weight", "hub").alias("top"))
    return own.unionByName(over).groupBy("head").agg(F.max("top").alias("top")).select("head", "top.weight", "top.hub")


def linked_nodes(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, component) over the distinct sets that are linked with another one."""
    texts, parts = docs.select("text"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = texts.mapInArrow(_listed(shingle, percent, _bounds(texts, shingle, percent, parts)), _LISTED)
    runs = store(listed.repartitionById(parts, F.col("place")).drop("place").sortWithinPartitions("list", "node").mapInArrow(
        _runs, "list bigint, node bigint, size int, tag int, head bigint, edge boolean"), "jaccard-lists")
    # runs that a partition border cuts: their heads are members of the first head's run
    edges = runs.where("edge").groupBy("list").agg(F.min("node").alias("head"), F.count_distinct("node").alias("n")).where("n > 1").select("list", "head")
    across = runs.where("edge").select("list", "node", "size", "tag").distinct().join(edges, "list")
    members = store(_central(runs.where("not edge").select(*_RUN[:4]).unionByName(across.select(*_RUN[:4])).distinct()), "jaccard-members")
    pairs = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()

    # one document stands for each node that has to be compared
    stand_in = nodes.groupBy("node").agg(F.min("doc_id").alias("__id")).join(members.select("node").distinct(), "node", "left_semi")
    found = docs.join(stand_in, docs["doc_id"] == stand_in["__id"]).select("node", "text").mapInArrow(_same_set(shingle), "node bigint, text string")
    texts = store(found.groupBy("node").agg(F.min("text").alias("text")), "jaccard-texts")

    first = _verified(pairs, texts, shingle, percent)
    groups = components(first.where("linked"))
    labelled = members.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    open_lists = labelled.groupBy("list").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.min("head").alias("head")).where("lo <> hi")
    open_lists = open_lists.select("list", "head").join(_hubs(members, first), "head")  # one row per list: a head of very many members is no hot key
    far = first.select(F.col("a").alias("head"), F.col("b").alias("node"), "linked", "distance")
    around = labelled.drop("head", "weight").join(open_lists, "list").join(far, ["head", "node"], "left").select(
        "list", "length", "head", "hub", "weight", "node", "size", "tag", "group", F.coalesce("distance", F.lit(0.0)).alias("distance"))
    around = store(around, "jaccard-open")
    # A linked pair shares at least `need` lists of a class. In any order of all lists, each set may therefore
    # leave out its first need - 1: the last list that the pair shares is kept by both. Long lists come first, those
    # of the lightest hubs before others, so that a set is left with few hubs; then the longest of the short ones.
    kind, need = F.shiftright("tag", 24), F.col("tag").bitwiseAND(0xFFFFFF)
    around = around.withColumns({"class": kind, "need": need})
    is_long = F.col("length") > BRIEF
    dearest = W.partitionBy("node", "class").orderBy(is_long.desc(), F.when(is_long, F.struct("weight", "hub")), F.col("length").desc(), "list")
    short = store(around.withColumn("nth", F.row_number().over(dearest)).where("nth >= need").drop("tag", "nth"), "jaccard-short")
    brief = short.where(F.col("length") <= BRIEF)
    left, right = (brief.select("list", "class", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "need", "group", "distance")]) for s in "xy")
    near = (left.join(right, ["list", "class"]).where((F.col("x_node") < F.col("y_node")) & _may_link(percent))
            .groupBy("class", F.col("x_node").alias("a"), F.col("y_node").alias("b")).agg(F.max(F.greatest("x_need", "y_need")).alias("need")))
    of_node = around.groupBy("node", "class").agg(F.collect_set("list").alias("lists"))
    both = near.join(of_node.select(F.col("node").alias("a"), "class", F.col("lists").alias("lists_a")), ["a", "class"]).join(
        of_node.select(F.col("node").alias("b"), "class", F.col("lists").alias("lists_b")), ["b", "class"])
    rest = both.where(F.size(F.array_intersect("lists_a", "lists_b")) >= F.col("need")).select("a", "b").distinct()
    rest = rest.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    second = _verified(rest, texts, shingle, percent)
    apart = short.where((F.col("length") > BRIEF) & (F.col("node") != F.col("head"))).select(F.col("hub").alias("head"), "node", "size", "group").distinct()
    apart = apart.join(far.where("linked").select("head", "node", "linked"), ["head", "node"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    third = _linked_by_difference(apart, texts, shingle, percent)
    return components(first.where("linked").select("a", "b").unionByName(second.where("linked").select("a", "b")).unionByName(third))


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that links lead to."""
    nodes = store(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _nodes(shingle), "doc_id bigint, n_shingles bigint, node bigint"), "jaccard-nodes")
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    filled = nodes.where("n_shingles > 0 and doc_id is not null")
    groups = linked_nodes(known, filled, shingle, percent)
    smallest = filled.groupBy("node").agg(F.min("doc_id").alias("first"))
    named = smallest.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    ids = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(ids, "group").select("node", "component_id")
    joined = nodes.join(named, (nodes["node"] == named["node"]) & (nodes["n_shingles"] > 0) & nodes["doc_id"].isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that have no doc_id, no words, or the smallest doc_id of their group."""
    gone = jaccard_groups(docs, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
