"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts.

Two models, one of toxic and one of ordinary texts, predict a word letter by letter from up to
`order - 1` letters before it (word borders are letters too), so inflected and rare expressions share
what their stems have shown. Contexts of the longer orders are counted per class; the shortest orders
are continuation counts (in how many longer n-grams an n-gram ends) shared by both classes, which all
sparse contexts back off to.

A word's evidence is its toxic minus its ordinary log-likelihood. A text is described by the sums of
its words' evidence and of the part of it above a margin, both divided by the number of words, and by
the largest such part; a logistic curve over these, fitted on labelled rows kept out of the counts,
gives the score. In each class every fifth row in the order of a hash is kept out, so both classes
take part from two rows each on.

The labelled rows are a bounded sample (`max_per_class`, chosen by a hash of doc_id) and the model a
bounded table (`max_entries`; rarer n-grams are left to the backoff), so both are safe to broadcast.
All documents are scored whole, in one scan without a shuffle.

Cases: null and empty texts have no evidence (0) and get the score of that; rows without doc_id are
scored and never learned from; labels that are null or neither 0 nor 1 are ignored; a doc_id with
both labels counts as toxic; repeated rows are scored row by row; without rows of both classes every
score is 0; where a class has one labelled text only, that one is counted and the curve is the mean
evidence alone, so texts with evidence above 0 are predicted toxic; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, Words, mix, sample_by_hash, slices, store, strings, texts_of

# Fixed value: characters that do not belong to a word at its ends.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

MAX_PER_CLASS = 10_000
MAX_ENTRIES = 1 << 19
ORDER = 5
SHARED_ORDERS = 2
DISCOUNT = 0.75
#: Evidence of a word (in nats) that counts as more than chance.
MARGIN = 1.0
OUTPUTS = ("score", "predicted")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The curve where none can be fitted: only evidence above 0 gives a score of 0.5.
PLAIN_CURVE = np.array([1.0, 0.0, 0.0, -1e-9])


class BareWords:
    """Words of a slice, lower-cased and without punctuation at the ends, as codes of distinct words."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        bare = pc.ascii_trim(words.distinct, characters=PUNCTUATION).dictionary_encode()
        codes = np.asarray(bare.indices).astype(np.int64)[words.codes]
        full = (np.asarray(pc.binary_length(bare.dictionary)) > 0)[codes]
        self.owner, self.codes = words.owner[full], codes[full]
        self.distinct: list[str] = strings(bare.dictionary)


class Letters:
    """Letter n-grams of words: for every letter after a word's opening mark, the hash of the n-gram that ends there."""

    def __init__(self, words: list[str], order: int):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letter = mix(points + np.uint64(17))
        hashes, self.keys, self.contexts, self.reaches = np.zeros(len(points), np.uint64), [], [], []
        inner = place > 0
        for n in range(1, order + 1):
            before = np.concatenate([[np.uint64(0)], hashes[:-1]]) + np.uint64(n)
            hashes = mix(before * _STEP + letter)
            self.keys.append(hashes[inner])
            self.contexts.append(before[inner] * _STEP)
            self.reaches.append((place >= n - 1)[inner])
        self.word = word[inner]


def _count_ngrams(order: int):
    """Rows (n, key, context, suffix, ordinary, toxic); suffix is the key without the first letter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = BareWords(texts_of(batch))
            toxic = np.asarray(batch.column("toxic"))[words.owner] == 1
            per_word = [np.bincount(words.codes[toxic == bool(c)], minlength=len(words.distinct)) for c in (0, 1)]
            letters = Letters(words.distinct, order)
            for n in range(order):
                there = letters.reaches[n]
                unique, at, code = np.unique(letters.keys[n][there], return_index=True, return_inverse=True)
                counts = [np.bincount(code, weights=p[letters.word[there]], minlength=len(unique)).astype(np.int64) for p in per_word]
                suffix = letters.keys[n - 1] if n else np.zeros(len(there), np.uint64)
                longs = [pa.array(x[there][at].view(np.int64)) for x in (letters.contexts[n], suffix)]
                yield pa.record_batch([pa.array(np.full(len(unique), n + 1, np.int32)), pa.array(unique.view(np.int64)), *longs, *map(pa.array, counts)],
                                      names=["n", "key", "context", "suffix", "ordinary", "toxic"])

    return run


_NGRAMS = "n int, key bigint, context bigint, suffix bigint, ordinary bigint, toxic bigint"


@dataclass
class Level:
    """One order of the models: discounted probabilities of n-grams and backoff weights of contexts, (class, entry)."""

    keys: np.ndarray
    direct: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, context: np.ndarray, counts: np.ndarray, discount: float) -> Level:
        order = np.argsort(key)
        key, context, counts = key[order], context[order], counts[:, order]
        contexts, code = np.unique(context, return_inverse=True)
        total = np.stack([np.bincount(code, weights=c, minlength=len(contexts)) for c in counts])
        kinds = np.stack([np.bincount(code, weights=c > 0, minlength=len(contexts)) for c in counts])
        seen = np.maximum(total, 1)
        taken = np.stack([np.bincount(code, weights=np.minimum(c, discount), minlength=len(contexts)) for c in counts])
        weight = np.where(total > 0, np.where(kinds > 0, taken / seen, 1.0), 1.0)
        return cls(key, np.maximum(counts - discount, 0) / seen[:, code], contexts, weight)

    def extend(self, p: np.ndarray, keys: np.ndarray, contexts: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The next longer estimate from the shorter one; letters without so long a context keep theirs."""
        at, found = _find(self.contexts, contexts)
        known = found & reach
        q = p * np.where(known, self.weight[:, at], 1.0)
        at, found = _find(self.keys, keys)
        return q + np.where(found & known, self.direct[:, at], 0.0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys in a sorted array that is not empty, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    levels: list[Level]
    letters: int
    curve: np.ndarray = field(default_factory=PLAIN_CURVE.copy)

    def letter_probabilities(self, letters: Letters) -> np.ndarray:
        """(class, letter): the probability of each letter after those before it; ordinary first."""
        p = np.full((2, len(letters.word)), 1.0 / self.letters)
        for n, level in enumerate(self.levels):
            p = level.extend(p, letters.keys[n], letters.contexts[n], letters.reaches[n])
        return p

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        letters = Letters(words, len(self.levels))
        p = self.letter_probabilities(letters)
        return np.bincount(letters.word, weights=np.log(p[1]) - np.log(p[0]), minlength=len(words))

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean evidence, mean evidence above the margin, largest such evidence, and 1."""
        words = BareWords(texts)
        evidence = self.word_evidence(words.distinct)[words.codes] if len(words.codes) else np.empty(0)
        strong = np.maximum(evidence - MARGIN, 0)
        n = np.maximum(np.bincount(words.owner, minlength=len(texts)), 1)
        largest = np.zeros(len(texts))
        np.maximum.at(largest, words.owner, strong)
        means = [np.bincount(words.owner, weights=x, minlength=len(texts)) / n for x in (evidence, strong)]
        return np.column_stack([*means, largest, np.ones(len(texts))])

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def learning_rows(labels: DataFrame, max_per_class: int) -> DataFrame:
    """(doc_id, toxic) of the labelled sample: at most about `max_per_class` rows a class."""
    clean = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    return sample_by_hash(clean.where("toxic = 0"), "doc_id", max_per_class).unionByName(
        sample_by_hash(clean.where("toxic = 1"), "doc_id", max_per_class))


def _most_frequent(ngrams: DataFrame, limit: int) -> DataFrame:
    """All n-grams from the smallest count on that leaves at most `limit` of them."""
    total = F.col("ordinary") + F.col("toxic")
    bins = ngrams.groupBy(F.least(total, F.lit(10_000)).alias("total")).count().collect()
    kept, least = 0, 10_001
    for row in sorted(bins, key=lambda r: -r["total"]):
        kept += row["count"]
        if kept > limit:
            break
        least = row["total"]
    return ngrams.where(total >= least)


def fit_counts(marked: DataFrame, max_entries: int = MAX_ENTRIES, order: int = ORDER, shared_orders: int = SHARED_ORDERS, discount: float = DISCOUNT) -> Model | None:
    """The two models of (text, toxic) rows, or None without rows of both classes."""
    ngrams = store(marked.select("text", "toxic").mapInArrow(_count_ngrams(order), _NGRAMS).groupBy("n", "key", "context", "suffix")
                   .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "toxicity-ngrams")
    ends = ngrams.groupBy((F.col("n") - 1).alias("n"), F.col("suffix").alias("key")).agg(F.count(F.lit(1)).alias("longer"))
    table = _most_frequent(ngrams, max_entries).join(ends, ["n", "key"], "left").select("n", "key", "context", "ordinary", "toxic", F.coalesce("longer", F.lit(0)).alias("longer")).toPandas()
    if not table["ordinary"].sum() or not table["toxic"].sum():
        return None
    levels = []
    for n in range(1, order + 1):
        rows = table[table["n"] == n]
        if not len(rows):
            break
        names = ["longer", "longer"] if n <= min(shared_orders, order - 1) else ["ordinary", "toxic"]
        levels.append(Level.of(rows["key"].to_numpy(np.int64).view(np.uint64), rows["context"].to_numpy(np.int64).view(np.uint64), rows[names].to_numpy(float).T, discount))
    return Model(levels, len(levels[0].keys) + 1)


def _logistic(design: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic curve, by Newton steps with a small ridge on scaled columns."""
    scale = np.maximum(np.abs(design).max(axis=0), 1e-9)
    x, beta = design / scale, np.zeros(design.shape[1])
    ridge = 1e-2 * np.eye(len(beta))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta), -5, 5)
    return beta / scale


_FEATURES = ["mean", "strong", "largest", "one"]


def _features(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = model.features(texts_of(batch)).T
            yield pa.record_batch([batch.column("toxic"), *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=["toxic", *_FEATURES])

    return run


def folds(rows: list[tuple[int, int, bool, int]]) -> tuple[list[tuple[int, int]], bool]:
    """(doc_id, 1 for the curve and 0 for the counts) of (doc_id, toxic, has words, hash), and whether both classes have words in both parts."""
    out, whole = [], True
    for toxic in (0, 1):
        for filled in (True, False):
            ranked = sorted((h, i) for i, t, f, h in rows if (t, f) == (toxic, filled))
            alone = filled and len(ranked) < 2
            whole &= not alone
            out += [(i, int(n % 5 == 0 and not alone)) for n, (_, i) in enumerate(ranked)]
    return out, whole


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_entries: int = MAX_ENTRIES) -> Model | None:
    """Counts four fifths of each class of the sample and fits the curve on the last fifths."""
    sample = learning_rows(labels, max_per_class).select(F.col("doc_id").alias("__id"), "toxic")
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    filled = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D\p{Punct}]"), F.lit(False))
    rows = marked.select("__id", "toxic", filled.alias("filled")).groupBy("__id", "toxic").agg(F.max("filled")).withColumn("hash", F.xxhash64(F.lit("fold"), F.col("__id"))).collect()
    parts, whole = folds([tuple(r) for r in rows])
    part = docs.sparkSession.createDataFrame(parts, "__part_id bigint, part int")
    marked = marked.join(F.broadcast(part), F.col("__id") == F.col("__part_id"))
    model = fit_counts(marked.where("part = 0"), max_entries)
    if model is not None and whole:
        seen = marked.where("part = 1").select("toxic", "text").mapInArrow(_features(model), "toxic int, " + ", ".join(f"{n} double" for n in _FEATURES)).toPandas()
        model.curve = _logistic(seen[_FEATURES].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def _score(names: list[str], model, slice_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=slice_bytes):
            score = model.value.score(texts_of(batch)) if model is not None else np.zeros(batch.num_rows)
            made = {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.record_batch([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_entries: int = MAX_ENTRIES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents with score and predicted. `labels` holds the (doc_id, toxic) rows to learn from;
    texts are scored `slice_bytes` at a time (less memory, more work on words that slices share)."""
    model = fit(docs, labels, max_per_class, max_entries)
    rest = docs.drop(*OUTPUTS)
    fields = [*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    shipped = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    return rest.mapInArrow(_score([f.name for f in fields], shipped, slice_bytes), T.StructType(fields))
