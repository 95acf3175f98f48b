"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted with partial aggregation: the raw one over all documents, the target one over
trusted documents (label quality = 1). The trusted ids come from a sample whose size is a parameter
(`max_trusted`), which makes them safe to broadcast; texts are never shuffled. A document's score is
the mean log ratio target / raw over its n-grams, and every document is decided by one fixed limit.

Cases: null and empty texts have no words and fail the base rules; rows without doc_id are counted
in the raw multinomial and scored like others; repeated rows are scored row by row; without trusted
documents the ratio is 0 everywhere; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chain, mix, same_text, sample_by_hash, slices, texts_of

# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

BUCKETS = 1 << 14
MAX_TRUSTED = 20_000
MIN_RATIO = -0.1

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def _repeated_words(words: Words, n_texts: int) -> np.ndarray:
    """Words per text that lie in a window of WINDOW words found at least twice in that text."""
    n = len(words.codes)
    if n < WINDOW:
        return np.zeros(n_texts, np.int64)
    starts = np.flatnonzero(same_text(words.owner, WINDOW))
    marks = chain(mix(words.codes.astype(np.uint64) + np.uint64(1)), WINDOW)[starts]
    marks = mix(marks + mix(words.owner[starts].astype(np.uint64) + np.uint64(7)))
    order = np.argsort(marks, kind="stable")
    equal = marks[order][1:] == marks[order][:-1]
    if equal.any():
        # Equal hashes are only believed when the words are equal.
        left, right = starts[order[:-1][equal]], starts[order[1:][equal]]
        same = words.owner[left] == words.owner[right]
        for k in range(WINDOW):
            same &= words.codes[left + k] == words.codes[right + k]
        edges = np.zeros(n + 1, np.int64)
        hits = np.unique(np.concatenate([left[same], right[same]]))
        np.add.at(edges, hits, 1)
        np.add.at(edges, hits + WINDOW, -1)
        covered = np.cumsum(edges[:-1]) > 0
        return np.bincount(words.owner[covered], minlength=n_texts)
    return np.zeros(n_texts, np.int64)


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    split = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    lines = split.flatten().dictionary_encode()
    worded = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(lines.dictionary))) > 0
    codes = np.asarray(lines.indices).astype(np.int64)
    full = worded[codes]
    owner, codes = owner[full], codes[full]
    distinct = np.unique(owner * max(1, len(worded)) + codes)
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct // max(1, len(worded)), minlength=len(texts))


def base_counts(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    size = np.asarray(pc.utf8_length(words.distinct)).astype(np.int64)
    return {
        "n_words": words.per_text,
        "word_chars": np.bincount(words.owner, weights=size[words.codes], minlength=len(texts)).astype(np.int64) if len(words.codes) else np.zeros(len(texts), np.int64),
        "n_symbols": np.asarray(pc.count_substring_regex(texts, SYMBOLS)).astype(np.int64),
        "n_dup_lines": _duplicate_lines(texts),
        "n_repeat_words": _repeated_words(words, len(texts)),
    }


def _buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and owner of every unigram and bigram."""
    one = mix(words.hashes())
    two = chain(one, 2)
    inside = same_text(words.owner, 2)
    return (np.concatenate([one, two[inside]]) % np.uint64(buckets)).astype(np.int64), np.concatenate([words.owner, words.owner[:len(two)][inside]])


def _count(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            places, owner = _buckets(Words(texts_of(batch)), buckets)
            raw += np.bincount(places, minlength=buckets)
            target += np.bincount(places[np.asarray(batch.column("trusted"))[owner]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """log target / raw per bucket, both smoothed by one count per bucket; at most `buckets` rows reach the driver."""
    ids = sample_by_hash(trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted is not null").distinct(), "__trusted", max_trusted)
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__trusted"), "left")
    counts = (marked.select("text", F.col("__trusted").isNotNull().alias("trusted"))
              .mapInArrow(_count(buckets), "bucket bigint, raw bigint, target bigint")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if counts["target"].sum() else np.zeros(buckets)


def _score(names: list[str], ratios: np.ndarray, min_ratio: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            words = Words(texts)
            made = base_counts(texts, words)
            places, owner = _buckets(words, len(ratios))
            grams = np.bincount(owner, minlength=len(texts))
            ratio = np.bincount(owner, weights=ratios[places], minlength=len(texts)) / np.maximum(grams, 1)
            failed = (made["n_words"] < MIN_WORDS) | (100 * made["n_repeat_words"] > MAX_REPEAT_PERCENT * made["n_words"])
            made |= {"base_failed": failed, "ratio": ratio, "kept": ~failed & (ratio >= min_ratio)}
            yield pa.record_batch([pa.array(made[n]) if n in made else batch.column(n) for n in names], names=names)

    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED, min_ratio: float = MIN_RATIO) -> DataFrame:
    """The documents with the base counts, base_failed, ratio and kept. `trusted` holds the doc_id of trusted documents."""
    ratios = log_ratios(docs, trusted, buckets, max_trusted)
    made = [*BASE.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    rest = docs.drop(*[f.name for f in made])
    fields = [*rest.schema.fields, *made]
    return rest.mapInArrow(_score([f.name for f in fields], ratios, min_ratio), T.StructType(fields))
