"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ticketloom.llm import bpe, components, jaccard_join, license_scan, line_dedup, lm_scoring, packing, quality_rules, substring_dedup, topk, toxicity

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string"


def words(n, seed, vocabulary=4000):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, a long text, and columns named like outputs and helpers."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id " * 30), (4, " ".join(words(6000, 1))), (5, "same text here " * 12), (5, "same text here " * 12),
            (6, "same text here " * 12), (None, None), (7, "x" * 9000), (8, "één ünï 　 漢字\n\nß " * 9)]
    return spark.createDataFrame([(i, t, "a", 1, True, 0.5) for i, t in rows], DOCS + ", kept string, n_words int, n_lines boolean, score double").coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(MULTI, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- quality rules -------------------------------------------------------------------------------

def base_by_hand(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    covered = {j for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_quality_base_counts_by_hand(spark, odd):
    trusted = spark.createDataFrame([(4,), (None,), (8,)], "doc_id bigint")
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    got = [r for r in quality_rules.quality_rules(odd, trusted).collect()]
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            n, *rest = base_by_hand(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
            assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n) and not (r["base_failed"] and r["kept"])


def test_quality_ratio_by_hand_and_without_trusted(spark, none):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], DOCS)
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    ratios = quality_rules.log_ratios(docs, trusted, buckets=1 << 16)
    # six n-grams, "a" twice; the target has three of them
    size = 1 << 16
    seen = sorted(set(np.round(ratios, 12)))
    expected = {round(math.log(t / (size + 3)) - math.log(r / (size + 6)), 12) for t, r in ((1, 1), (2, 3), (2, 2), (1, 2))}
    assert set(seen) == expected
    assert not quality_rules.log_ratios(docs, trusted.where("false"), buckets=64).any()
    assert quality_rules.quality_rules(none, trusted).count() == 0


# --- byte-level BPE ------------------------------------------------------------------------------

def test_bpe_equals_the_library_and_round_trips(tiktoken_encoding):
    rnd = random.Random(5)
    letters = " \n\t  ab cd'st've12½Ⅷéñ漢\x1c\x85\xa0 　\v\f\r🤦🏼_-!#"
    texts = ["", " ", "  ", "a ", " a", "x" * 3000, " " * 500, "ab " * 500] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    vocab = bpe.vocabulary(MULTI, public_tokenizers.PATTERN)
    got = bpe.encode_slice(vocab, pa.array(texts))
    assert got.to_pylist() == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert bpe.decode_slice(vocab, got).to_pylist() == [t.encode() for t in texts]
    sliced = pa.array(["skip", *texts[:50]]).slice(1)
    assert bpe.encode_slice(vocab, sliced).to_pylist() == got.to_pylist()[:50]


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(3000)) and sorted(table.slots) == list(range(3000))
    assert all(table.find(f"x{i}".encode()) == -1 for i in range(500))


def test_bpe_frames(odd, none, tiktoken_encoding):
    vocab = MULTI, public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(odd, *vocab), *vocab).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == tiktoken_encoding.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(none, *vocab), *vocab).count() == 0


def test_decode_refuses_unknown_ids():
    vocab = bpe.vocabulary(MULTI, public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        bpe.decode_slice(vocab, pa.array([[60_000]], pa.list_(pa.int32())))


# --- packing -------------------------------------------------------------------------------------

@pytest.mark.parametrize("histogram", [{}, {1: 1}, {5: 7}, {1023: 3, 1: 2}, {512: 5, 300: 9, 212: 9}, {k: 1 + k % 7 for k in range(1, 1024)}])
def test_packs_hold_every_length_once_and_fit(histogram):
    patterns = packing.pack_histogram(dict(histogram), 1024)
    got = Counter()
    for packs, lengths in patterns:
        assert packs > 0 and sum(lengths) <= 1024
        for length in lengths:
            got[length] += packs
    assert got == Counter(histogram)


def test_packing_pieces_are_gapless(odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PLAIN)
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(odd, PLAIN, public_tokenizers.PATTERN).toPandas()
    by_sequence = got.sort_values("offset").groupby("sequence_id")
    assert (by_sequence["length"].sum() <= 1024).all()
    for _, g in by_sequence:
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
    texts = Counter((None if pd.isna(i) else i, t) for i, t in odd.select("doc_id", "text").toPandas().replace({np.nan: None}).itertuples(index=False))
    wanted = Counter()
    for (doc, text), times in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for start in range(0, len(ids), 1024):
            wanted[(doc, start, min(1024, len(ids) - start), zlib.crc32(ids[start:start + 1024].tobytes()), len(ids))] += times
    rows = Counter((None if pd.isna(r.doc_id) else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples())
    assert rows == wanted
    assert packing.pack_documents(none, PLAIN, public_tokenizers.PATTERN).count() == 0


def test_packing_ids_are_the_library_s_around_white_space():
    from tokenizers import Tokenizer

    vocab, tokenizer = packing.LibraryVocabulary(PLAIN, public_tokenizers.PATTERN), Tokenizer.from_file(PLAIN)
    tokenizer.encode_special_tokens = True
    rnd = random.Random(8)
    letters = ["a", "Bc", "7", "42", "!", "'s", "'", "é", "字", "़", "\x00", "\u200d", "<|endoftext|>"]
    spaces = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", "\u200b", "\ufeff"]
    texts = ["", " ", "a ", " a", "\n"] + ["".join(rnd.choice(letters if rnd.random() < 0.6 else spaces) for _ in range(rnd.randint(1, 30))) for _ in range(6_000)]
    texts += [rnd.choice(spaces).join(rnd.choice(letters) for _ in range(9)) for _ in range(2_000)]
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert vocab.ranked is not None and [ids.tolist() for ids in vocab.ids_of(texts)] == want
    assert sum(bool(packing._SPACES.search(t)) for t in texts) not in (0, len(texts))


# --- line dedup ----------------------------------------------------------------------------------

def lines_by_hand(rows, min_points=40, min_documents=5, keeper=max):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for doc, text in rows:
        if doc is not None and text is not None:
            for line in text.split("\n"):
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if doc is None or len(key(p)) < min_points or len(holders[key(p)]) < min_documents or keeper(holders[key(p)]) == doc]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_by_hand(spark, batches, fanout):
    rnd = random.Random(3)
    pool = [" ".join(words(9, s)) for s in range(12)] + ["short line", "É" * 40, "é" * 40]
    rows = [(i, "\n".join(rnd.choice(("  ", "")) + rnd.choice((str.upper, str))(rnd.choice(pool)) for _ in range(rnd.randint(0, 6)))) for i in range(40)]
    rows += [(None, pool[0]), (41, None), (42, ""), (43, "\n\n"), (7, pool[1]), (44, "\n".join([pool[2]] * 3)), (44, "\n".join([pool[2]] * 3))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", line string").repartition(3)
    got = line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=str) == lines_by_hand(rows)
    assert {r["line"] for r in got} == {"x"}
    first = line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout, keep="smallest").collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in first), key=str) == lines_by_hand(rows, keeper=min)


def test_line_dedup_empty(none, odd):
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert line_dedup.drop_repeated_lines(odd).count() == odd.count()


# --- licence scan --------------------------------------------------------------------------------

def test_every_template_is_found_among_everyday_words(spark):
    """3,000 English words around a notice hold every indexed word, so no word may be left out of the vote."""
    common = license_scan.TemplateIndex().words
    english = "the of a that was he on with his they at one had by but what some we out other were all there when up how said an each she".split()
    rnd = random.Random(7)
    filler = [rnd.choice(english + common) for _ in range(3000 - len(common))] + common
    rows = []
    for i, (_, text, _) in enumerate(license_scan.TEMPLATES):
        rnd.shuffle(filler)
        rows.append((i, " ".join([*filler[:1500], ".", text, ".", *filler[1500:]])))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, (label, got[i])


# --- substring dedup -----------------------------------------------------------------------------

def test_cuts_resist_insertions():
    text = " ".join(words(3000, 8))
    both = substring_dedup.Chunks(pa.array([text, "some new words " + text[:9000] + " inserted " + text[9000:]]))
    first, second = (set(both.digest[both.owner == i].tolist()) for i in (0, 1))
    assert len(first & second) > 0.98 * len(first)
    plain = substring_dedup.Chunks(pa.array([text]))
    assert plain.digest.tolist() == both.digest[both.owner == 0].tolist() and int(plain.words.sum()) == 3000


def test_gear_hash_by_hand():
    raw = np.frombuffer(b"the quick brown fox jumps over", np.uint8)
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFF
        want.append(h)
    assert substring_dedup._gear(raw, np.arange(len(raw))).tolist() == want


def test_substring_dedup_cuts_repeats_and_leaves_the_rest(spark, odd, none):
    passage = " ".join(words(60, 77))
    rows = [(i, f"{' '.join(words(80, 100 + i))} {passage} {' '.join(words(80, 200 + i))}") for i in range(1, 9)]
    clean = [(i, " ".join(words(150, 300 + i, 10**6))) for i in range(20, 30)]
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeated_substrings(spark.createDataFrame(rows + clean, DOCS)).collect()}
    texts = dict(rows + clean)
    assert got[1]["kept_text"] == texts[1] and all(got[i]["kept_text"] == t for i, t in clean)
    for i in range(2, 9):
        assert got[i]["dropped_words"] >= 30 and passage not in got[i]["kept_text"] and {s["first_doc_id"] for s in got[i]["dropped"]} == {1}
        raw = texts[i].encode()
        assert sum(len(raw[s["start_byte"]:s["end_byte"]].split()) for s in got[i]["dropped"]) == got[i]["dropped_words"]
    rows = substring_dedup.drop_repeated_substrings(odd).collect()
    assert len(rows) == odd.count() and substring_dedup.drop_repeated_substrings(none).count() == 0
    assert all(r["kept_text"] == (r["text"] or "") for r in rows if r["doc_id"] is None)


def test_substring_dedup_cuts_only_what_stays_elsewhere_whole(spark):
    """Nearly all chunks of five words in chance order repeat, but runs of 20 words only where they were copied."""
    chance = [(i, " ".join(words(200, 500 + i, 5))) for i in range(150)]
    assert all(r["kept_text"] == r["text"] and not r["dropped"] for r in substring_dedup.drop_repeated_substrings(spark.createDataFrame(chance, DOCS)).collect())
    rnd, rows = random.Random(3), list(chance)
    for i in range(150, 250):  # pieces of earlier documents, which are themselves made of pieces
        parts = [" ".join(words(rnd.randrange(40), 900 + i, 5))]
        for _ in range(rnd.randrange(1, 5)):
            old = rows[rnd.randrange(len(rows))][1].split()
            a = rnd.randrange(max(1, len(old) - 60))
            parts.append(" ".join(old[a:a + rnd.randrange(10, 60)]))
        rows.append((i, " ".join(parts)))
    rows += [(i, rows[200][1]) for i in (300, 301)] + [(302, "one two three four five six seven eight " * 40)]
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeated_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    stays = {i: f" {' '.join(r['kept_text'].split())} " for i, r in got.items()}
    spans = [(i, r["text"].encode()[s["start_byte"]:s["end_byte"]].decode(), s["first_doc_id"]) for i, r in got.items() for s in r["dropped"]]
    assert len(spans) > 100 and all(f" {' '.join(text.split())} " in stays[copy] for _, text, copy in spans)
    assert got[300]["dropped_words"] == got[301]["dropped_words"] >= 0.8 * len(rows[200][1].split()) and got[302]["dropped_words"] > 200


# --- language-model scoring ----------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_by_hand(spark, order):
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 12)))) for i in range(25)] + [(90, None), (91, " "), (92, "zzz a b"), (92, "zzz a b"), (None, "a b c")]
    tokens = [(t or "").split() for _, t in rows]
    grams = lambda t: Counter(tuple(t[i:i + n]) for n in range(1, order + 1) for i in range(len(t) - n + 1))
    corpus = sum((grams(t) for t in tokens), Counter())
    total = sum(map(len, tokens))
    wanted = []
    for (doc, _), t in zip(rows, tokens):
        own, score = grams(t), 0.0
        count = lambda g: corpus[g] - own[g]
        for i in range(len(t)):
            for n in range(order, 0, -1):
                g = tuple(t[max(0, i - n + 1):i + 1])
                if len(g) == n and (n == 1 or count(g) > 0):
                    score += math.log(max(count(g), 1) / max(total - len(t), 1) if n == 1 else count(g) / count(g[:-1])) + (order - n) * math.log(0.4)
                    break
        wanted.append((doc, len(t), round(score, 6) if t else None))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = lm_scoring.score_documents(docs, order, block_bytes=40, shard_bytes=60).collect()
    assert sorted(((r["doc_id"], r["n_words"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in got), key=str) == sorted(wanted, key=str)


def test_lm_scoring_odd_rows(odd, none):
    assert lm_scoring.score_documents(odd).count() == odd.count() and lm_scoring.score_documents(none).count() == 0


# --- Jaccard join --------------------------------------------------------------------------------

def groups_by_hand(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    usable = [i for i, (doc, _) in enumerate(rows) if sets[i] and doc is not None]
    for x, i in enumerate(usable):
        for j in usable[:x]:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in usable:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted(((doc, len(sets[i]), least[find(i)] if i in set(usable) else doc) for i, (doc, _) in enumerate(rows)), key=str)


def near_rows():
    rnd = random.Random(11)
    rows, doc = [], 0
    for family, size in enumerate([3, 5, 8, 12, 25, 40, 90, 200, 400, 700]):
        base = words(size, family)
        chain = list(base)
        for copy in range(7):
            text = list(chain if copy % 2 else base)
            for _ in range(rnd.randint(0, 1 + size // 40)):
                text[rnd.randrange(len(text))] = f"edit{rnd.randrange(9)}"
            if copy % 3 == 0:
                chain = text  # a chain of edits: ends are linked through the middle only
            rows.append((doc := doc + 1, " ".join(text) if copy != 5 else " ".join(text).upper()))
    shared = " ".join(words(57, 999))
    rows += [(doc + 1 + i, shared + " " + " ".join(words(40 + i, 500 + i))) for i in range(12)]
    return rows + [(None, rows[0][1]), (990, None), (991, ""), (992, " \n"), (993, rows[8][1]), (993, rows[8][1])]


@pytest.mark.parametrize("parts", [1, 5])
def test_jaccard_groups_by_hand(spark, parts):
    rows = near_rows()
    random.Random(parts).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", node int").repartition(parts)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs).collect()), key=str)
    assert got == groups_by_hand(rows)


def test_every_link_shares_a_list():
    rnd = random.Random(2)
    for trial in range(60):
        n = rnd.choice([6, 7, 9, 14, 33, 60, 150, 420])
        base = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        for edits in range(1, n // 6 + 2):
            other = base.copy()
            other[rnd.sample(range(n), min(edits, n))] = [rnd.getrandbits(64) for _ in range(min(edits, n))]
            other = np.unique(np.concatenate([other, np.array([rnd.getrandbits(64) for _ in range(rnd.choice([0, 0, edits // 3]))], np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if 100 * shared < 85 * (len(base) + len(other) - shared):
                continue
            owner = np.repeat([0, 1], [len(base), len(other)])
            text, lists, tags = jaccard_join.list_keys(owner, np.concatenate([base, other]), np.array([len(base), len(other)]), 85)
            common = set(lists[text == 0].tolist()) & set(lists[text == 1].tolist())
            kept = np.isin(lists, list(common))
            classes = Counter((tags[kept & (text == 0)] >> 24).tolist())
            need = {c: max(int(t) & 0xFFFFFF for t in tags[kept & (tags >> 24 == c)]) for c in classes}
            assert common and any(classes[c] >= need[c] for c in classes), (n, edits)


def test_jaccard_one_hot_group_and_empty(spark, none, odd):
    base = words(120, 1)
    rows = [(i, " ".join(base[:60] + [f"v{i}"] + base[60:])) for i in range(300)]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert jaccard_join.jaccard_groups(none).count() == 0
    assert jaccard_join.drop_copies(odd).count() == odd.count() - 1


def edited(base, edits, rnd):
    text = list(base)
    for _ in range(edits):
        text[rnd.randrange(len(text))] = f"edit{rnd.randrange(300)}"
    return text


def test_jaccard_compares_near_copies_by_what_was_changed(spark, monkeypatch):
    """Near copies that are not linked with the middle of their group once met in pairs: their number grew as the square of the group."""
    rnd = random.Random(5)
    base, popular = words(100, 77), [f"new{i}" for i in range(3)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        text = edited(base, rnd.choice([1, 2, 3, 3, 4, 4]), rnd)
        if i % 4 == 0:
            text[40:43] = popular  # a change that very many of them share
        if i % 7 == 0:
            text = edited(rnd.choice(rows)[1].split(), 1, rnd)  # linked through another copy, if at all
        rows.append((i, " ".join(text)))
    compared, store = Counter(), jaccard_join.store

    def counted(df, name):
        kept = store(df, name)
        compared[name] += kept.count()
        return kept

    monkeypatch.setattr(jaccard_join, "store", counted)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()), key=str)
    assert got == groups_by_hand(rows)
    assert len({r[2] for r in got}) > 50 and max(Counter(r[2] for r in got).values()) > 50
    assert compared["jaccard-verified"] < 12 * len(rows)


def test_jaccard_near_copies_differ_from_one_hub(spark, monkeypatch):
    """The differences of a near copy were once written for the heads of all lists it kept: 1.6 a copy here, 5.4 on check_h at the pipeline's limits."""
    rnd = random.Random(8)
    base = words(150, 71)
    rows = [(i, " ".join(edited(base, rnd.choice([2, 3, 4, 5]), rnd))) for i in range(400)]
    kept, store = {}, jaccard_join.store

    def remembered(df, name):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(jaccard_join, "store", remembered)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()), key=str)
    assert got == groups_by_hand(rows)
    made = kept["jaccard-differences"]
    nodes, pairs = made.select("node").distinct().count(), made.select("head", "node").distinct().count()
    assert nodes > 200 and pairs < 1.2 * nodes


def test_link_with_a_hub_is_found_with_the_differences(spark):
    """A hub need not have been compared with all that meet at it; a link with it counts as one, a known one is not given again."""
    base = words(60, 3)
    texts = {0: base, 1: base[:59], 2: base[:58], 3: base[:30] + words(30, 4)}
    rows = [(0, 1, 56, 0, True, 1 / 57), (0, 2, 55, 2, False, 2 / 57), (0, 3, 57, 3, False, 0.6)]
    apart = spark.createDataFrame(rows, "head bigint, node bigint, size int, group bigint, linked boolean, distance double")
    nodes = spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "node bigint, text string")
    got = jaccard_join._linked_by_difference(apart, nodes, 4, 85)
    assert [tuple(r) for r in got.collect()] == [(0, 2)]


@pytest.mark.parametrize("percent", [85, 80])
def test_links_by_difference_are_the_links(spark, percent):
    """Nodes around a head of their own list: linked pairs of different groups, found without comparing all pairs."""
    rnd = random.Random(percent)
    texts, rows, sets = {}, [], {}
    for h in range(4):
        base = words(60 + 30 * h, 40 + h)
        for i in range(45):
            text = edited(base, rnd.randint(0, 6), rnd)
            if i % 3 == 0:
                text += words(rnd.randint(0, 12), 90 + i % 5)
            if i % 5 == 0:
                text = text[rnd.randint(0, 9):]
            node = h * 100 + i
            texts[node] = " ".join(text)
            sets[node] = {tuple(text[k:k + 4]) for k in range(len(text) - 3)}

    def distance(a, b):
        return 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    def linked(a, b):
        return 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])

    for node in texts:
        head = node // 100 * 100
        if node != head:
            near = linked(node, head)
            rows.append((head, node, len(sets[node]), head if near else node, near, distance(node, head)))
    apart = spark.createDataFrame(rows, "head bigint, node bigint, size int, group bigint, linked boolean, distance double").repartition(3)
    got = jaccard_join._linked_by_difference(apart, spark.createDataFrame(sorted(texts.items()), "node bigint, text string"), 4, percent)
    group = {r[1]: r[3] for r in rows}
    links = {(a, b) for a in group for b in group if a < b and a // 100 == b // 100 and group[a] != group[b] and linked(a, b)}
    assert len(links) > 20 and {tuple(sorted(r)) for r in got.collect()} == links


@pytest.mark.parametrize("percent", [85, 80])
def test_links_far_from_a_head_are_found(spark, percent):
    """Texts of families that share half of their words with the head: links of shorter and longer ones, none of them with the head."""
    rnd = random.Random(100 + percent)
    common = words(60, 21)
    texts = {0: common + words(40, 22)}
    for family in range(6):
        own = words(rnd.randint(25, 70), 200 + family)
        for i in range(14):
            text = edited(common + own, rnd.choice([0, 0, 1, 2]), rnd)
            texts[len(texts)] = text[rnd.choice([0, 0, 4, 9]):] + words(rnd.choice([0, 0, 3, 8]), 300 + i % 3)
    sets = {n: {tuple(t[k:k + 4]) for k in range(len(t) - 3)} for n, t in texts.items()}
    rows = [(0, n, len(sets[n]), n, False) for n in texts if n]
    apart = spark.createDataFrame(rows, "head bigint, node bigint, size int, group bigint, linked boolean").repartition(3)
    got = jaccard_join._linked_by_difference(apart, spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "node bigint, text string"), 4, percent)
    links = {(a, b) for b in sets for a in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert len(links) > 60 and not any(0 in link for link in links) and {tuple(sorted(r)) for r in got.collect()} == links


def test_jaccard_near_copies_offer_what_others_may_have_to_meet(spark, monkeypatch):
    """All differences of a near copy were once a row each, those that need not be looked at too: 154,624 on check_h at the pipeline's limits."""
    rnd = random.Random(12)
    base = words(150, 72)
    rows = [(i, " ".join(edited(base, rnd.choice([3, 4, 5, 6]), rnd))) for i in range(400)]
    kept, store = {}, jaccard_join.store

    def remembered(df, name):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(jaccard_join, "store", remembered)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()), key=str)
    assert got == groups_by_hand(rows)
    made = kept["jaccard-differences"]
    assert made.count() == made.select("head", "node").distinct().count() > 200
    differences = made.agg(F.sum(F.size("grams"))).first()[0]
    assert jaccard_join._offered(made).count() < 0.75 * differences


def test_places_follow_the_order_of_lists_and_nodes():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(-4, 4, (500, 2))
    bounds = np.array(sorted(map(tuple, rnd.integers(-4, 4, (23, 2)).tolist())))
    got = jaccard_join._places(keys[:, 0], keys[:, 1], (bounds[:, 0], bounds[:, 1]))
    assert got.tolist() == [sum(tuple(b) <= tuple(k) for b in bounds.tolist()) for k in keys.tolist()]
    none = np.empty(0, np.int64)
    assert not jaccard_join._places(keys[:, 0], keys[:, 1], (none, none)).any()


def test_jaccard_by_differences_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BRIEF", 1)
    rows = near_rows()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS).repartition(4)).collect()), key=str)
    assert got == groups_by_hand(rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


# --- exact top-k ---------------------------------------------------------------------------------

def test_top_k_by_hand(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).astype("float32").tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [(300, None), (320, [None, 1.0]), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, rows[0][1]), (380, [1.0, 2.0]), (400, []), (20, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, row int").repartition(4)
    got = topk.top_k(df, F.expr("vec_id % 20 = 0"), 5, candidate_block=37, query_block=3, pivots=6).collect()
    usable = [(i, np.array([math.floor(64 * float(np.float32(x))) for x in v] + [0] * (8 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for i, v in usable:
        if i % 20 == 0:
            best = sorted(((-int(v @ w), j) for j, w in usable if j != i))[:5]
            wanted += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(wanted)


def test_top_k_empty_and_few(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(empty, F.expr("vec_id % 20 = 0"), 5).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two, F.expr("vec_id % 20 = 0"), 5).collect()] == [(0, 1, 1, 64 * 128)]


# --- toxicity ------------------------------------------------------------------------------------

def toxic_rows(n=600):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        text, bad = words(rnd.randint(5, 60), i, 900), i % 4 == 0
        for _ in range(1 + len(text) // 10 if bad else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(["grumble", "Snarl!", "growl,"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out_accuracy_and_odd_rows(spark, odd):
    rows, labels = toxic_rows()
    extra = [(i, 0) for i in range(3)] + [(None, 1), (5, None), (6, 7)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text").where("doc_id is null"))
    learned = spark.createDataFrame([r for r in labels if r[0] % 5] + extra, "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs.selectExpr("*", "'x' as score"), learned).collect()
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 5 == 0]
    assert len(got) == docs.count() and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_without_labels(spark, none, odd):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.toxicity(odd, empty).collect()} == {0.0}
    assert toxicity.toxicity(none, empty).count() == 0


@pytest.mark.parametrize("n_toxic, n_clean", [(2, 400), (10, 400), (1, 1), (1, 30), (2, 2), (3, 1)])
def test_toxicity_with_few_labels(spark, n_toxic, n_clean):
    """However few rows a class has, toxic texts are found and ordinary ones stay."""
    texts = {1: "vile scum filth", 0: "kind help order"}
    for start in (0, 1000, 2000, 3000):
        rows = [(start + i, int(i < n_toxic)) for i in range(n_toxic + n_clean)]
        docs = spark.createDataFrame([(i, texts[t]) for i, t in rows] + [(9001, texts[1]), (9002, texts[0]), (9003, ""), (9004, None)], DOCS)
        got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int")).collect()}
        assert (got[9001], got[9002], got[9003], got[9004]) == (1, 0, 0, 0), (start, got[9001], got[9002], got[9003])


def test_letter_probabilities_sum_to_one(spark):
    rows = [(0, "ab ba aca"), (1, "abba dab"), (0, "b bab a"), (1, "deb a ab")]
    model = toxicity.fit_counts(spark.createDataFrame(rows, "toxic int, text string"))
    for stem in ("", "a", "b", "ab", "ba", "de", "zz"):
        # every letter of the vocabulary after the stem, the closing mark, and one letter never seen
        words = [stem + letter for letter in "abcde"] + [stem + "?"]
        letters = toxicity.Letters(words, len(model.levels))
        p = model.letter_probabilities(letters)
        after = [np.flatnonzero(letters.word == i)[len(stem)] for i in range(len(words))]
        closing = np.flatnonzero(toxicity.Letters([stem], len(model.levels)).word == 0)[-1]
        total = p[:, after].sum(axis=1) + model.letter_probabilities(toxicity.Letters([stem], len(model.levels)))[:, closing]
        assert total == pytest.approx([1.0, 1.0])


# --- substring dedup over many partitions ---------------------------------------------------------

def _windows_by_hand(rows):
    """(doc, place, last, piece) -> (first doc, first place) of the windows found twice or more, by a dictionary."""
    held = defaultdict(list)
    for doc, text in rows:
        w = substring_dedup.Windows(substring_dedup.Chunks(pa.array([text])))
        for place, last, digest, packed in zip(w.place.tolist(), w.last.tolist(), w.digest.tolist(), w.packed.tolist()):
            held[digest, packed >> 35].append((doc, place, last))
    return Counter((doc, place, last, key[0], *min(found)[:2]) for key, found in held.items() if len(found) > 1 for doc, place, last in found)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_repeated_windows_equal_a_dictionary(spark, partitions):
    """Hot passages that cross partition borders, windows that two neighbouring partitions share, and unique texts."""
    rnd = random.Random(9)
    passages = [words(70, s) for s in range(6)]
    rows = [(i, " ".join(words(30, 1000 + i) + passages[0 if i % 3 else rnd.randrange(6)] + words(30, 5000 + i))) for i in range(90)]
    rows += [(i, " ".join(words(60, 9000 + i))) for i in range(200, 230)] + [(500, rows[0][1]), (500, rows[1][1]), (7, rows[7][1])]
    names = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        got = substring_dedup.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        found = Counter((r["doc_id"], r["place"], r["last"], r["piece"], r["first_doc"], r["first_place"]) for r in got.collect())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert found == _windows_by_hand(rows) and len(found) > 500


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_runs_of_windows_over_batches_and_partitions(size, monkeypatch):
    """Every way in which short runs can lie over batch and partition borders."""
    rnd = random.Random(size)
    pack = lambda check, place: check << 35 | place << 6 | 3
    for _ in range(60):
        rows = sorted((rnd.randrange(4), rnd.randrange(2), rnd.randrange(3), place) for place in rnd.sample(range(50), rnd.randint(1, 12)))
        cuts = sorted(rnd.sample(range(1, len(rows)), min(len(rows) - 1, rnd.randint(0, 3))))
        closings, out = [], []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            monkeypatch.setattr(substring_dedup.TaskContext, "get", classmethod(lambda cls, part=part: type("At", (), {"partitionId": lambda self: part})()))
            batches = [pa.record_batch([pa.array([r[0] for r in rows[i:min(i + size, b)]], pa.int64()), pa.array([r[2] for r in rows[i:min(i + size, b)]], pa.int64()),
                                        pa.array([pack(r[1], r[3]) for r in rows[i:min(i + size, b)]], pa.int64())], names=["piece", "doc_id", "packed"]) for i in range(a, b, size)]
            for made in substring_dedup._repeated(iter(batches)):
                for r in made.to_pylist():
                    (closings if r["close"] else out).append({"part": r["part"], **r["close"]} if r["close"] else r)
        edges = {(part, edge): (doc, place) for part, edge, doc, place in substring_dedup._joined_edges(closings)}
        got = Counter()
        for r in out:
            if r["edge"] == 0 or (r["part"], r["edge"]) in edges:
                doc, place = (r["first_doc"], r["first_place"]) if r["edge"] == 0 else edges[r["part"], r["edge"]]
                got[r["piece"], r["doc_id"], r["place"], r["last"], doc, place] += 1
        groups = defaultdict(list)
        for piece, check, doc, place in rows:
            groups[piece, check].append((doc, place))
        want = Counter((key[0], doc, place, place + 2, *members[0]) for key, members in groups.items() if len(members) > 1 for doc, place in members)
        assert got == want
