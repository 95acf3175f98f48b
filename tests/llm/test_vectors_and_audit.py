"""Vector near duplicates, filter interaction audit and vector codes against brute force, odd tables and skew."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import filter_audit, q_vectors, vector_codes, vector_dedup
from ticketloom.llm.queries import ORACLE, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, v, lab in rows], VECTORS)


# ---- near duplicates


def brute_links(ids, matrix, limit):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    linked = unit @ unit.T >= limit
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        fresh = np.array([min([label[i], *label[linked[i]]]) for i in range(len(ids))])
        if (fresh == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), label)}
        label = fresh


def noisy_copies(rng, centre, cosines):
    out = []
    for c in cosines:
        noise = rng.standard_normal(len(centre))
        noise -= noise @ centre * centre
        out.append(c * centre + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise))
    return out


def test_near_duplicates_equal_brute_force(spark):
    """Exact copies, a hot group cut into blocks, chains and loose vectors."""
    rng = np.random.default_rng(3)
    rows = [v / np.linalg.norm(v) for v in rng.standard_normal((150, 32))]
    rows += noisy_copies(rng, rows[0], rng.uniform(0.995, 1, 120))  # all within the limit of each other
    rows += [rows[1]] * 5 + [rows[1] * 3] * 2
    step = noisy_copies(rng, rows[2], [0.985])[0]
    rows += [step, *noisy_copies(rng, step, [0.985])]
    matrix = np.array(rows, np.float32).astype(float)
    ids = [int(i) for i in rng.permutation(len(matrix)) + 10]
    got = vector_dedup.near_duplicates(vectors_frame(spark, zip(ids, matrix, [None] * len(ids))), block=16).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(ids, matrix, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_and_no_false_links(spark):
    rng = np.random.default_rng(5)
    centres = [v / np.linalg.norm(v) for v in rng.standard_normal((1_500, 64))]
    near = [noisy_copies(rng, c, [x])[0] for c, x in zip(centres, rng.uniform(0.90, 1, len(centres)))]
    matrix = np.array(centres + near, np.float32).astype(float)
    want = brute_links(list(range(len(matrix))), matrix, 0.95)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(vectors_frame(spark, ((i, v, 0) for i, v in enumerate(matrix)))).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values()) > 1_000


def test_table_plan_keeps_recall_at_any_size():
    for n in (10, 10**4, 10**7, 10**10):
        hashes, tables = vector_dedup.table_plan(n)
        near = vector_dedup.same_cell(np.sqrt(0.1))
        assert 1 - (1 - near**hashes) ** tables >= vector_dedup.RECALL and n * vector_dedup.same_cell(np.sqrt(2)) ** hashes <= 0.1
    assert vector_dedup.table_plan(10**10)[1] < 400


def test_near_duplicates_odd_rows(spark):
    rows = [(1, [1, 0], None), (1, [1, 0], None), (2, [2, 0], 1), (3, [1], 1), (4, None, 1), (5, [], 1), (6, [0, 0], 1), (7, [1, None], 1),
            (8, [float("nan"), 1], 1), (9, [float("inf"), 1], 1), (None, [1, 0], 1), (10, [0, -1e-30], 1), (11, [-0.0, -3e30], 1), (12, [1, 0, 0, 0, 0], 1)]
    frame = vectors_frame(spark, rows).withColumn("n_links", F.lit("x"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(frame).collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9)]
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (12, 4, 1, False), (10, 1, 10, True), (11, 1, 10, False), (None, 0, None, True), *alone], key=str)
    empty = vector_dedup.near_duplicates(frame.where("false"))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0


def test_block_roots_follow_links():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, sizes = np.zeros((60, 1), np.int64), np.arange(1, 61)
    links, label = vector_dedup.compare_block(x, codes, sizes, 0, None, 0.6)
    linked = x @ x.T >= 0.6
    np.fill_diagonal(linked, False)
    assert (links == linked @ sizes).all()
    assert (label == vector_dedup.roots(60, *np.nonzero(linked))).all()
    # met in an earlier table: nothing is new
    assert vector_dedup.compare_block(x, np.zeros((60, 2), np.int64), sizes, 1, None, 0.6)[0].sum() == 0


# ---- filter audit


def brute_audit(docs, labels):
    rows = []
    for doc_id, text, part in docs:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        same = [d for d, t, _ in docs if (t or "") == text and d is not None]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                 any(c in "#$%&*|" for c in text), doc_id is not None and doc_id > min(same)]
        rows.append((part or "", {n for n, f in zip("ABCDE", fails) if f}, *labels.get(doc_id, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                earlier = set(order[:step - 1])
                removed = [r for r in mine if name in r[1] and not r[1] & earlier]
                out[part, order, step] = [sum(not r[1] & (earlier | {name}) for r in mine), len(removed), sum(name in r[1] and bool(r[1] & earlier) for r in mine),
                                          sum(r[1] == {name} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)]
    share = {}
    for (part, order, step), row in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row, share[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def audited(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    long = [" ".join(f"w{k}" for k in rng.integers(0, 500, 260)) for _ in range(12)]
    dull = " ".join(["same", "words", "again"] * 90)
    texts = [*long, dull, f"{long[0]} #tag", "SHOUT " * 5, f"{dull} A$ B C D E F", "", None, long[0] + " ", "x\x0by z ÄÖ " + long[1]]
    docs = [(i, texts[int(k)], str(s) if s else None) for i, (k, s) in enumerate(zip(rng.integers(0, len(texts), 90), rng.integers(0, 3, 90)), 5)]
    docs += [(200 + i, long[3], "1") for i in range(40)]  # a hot text
    docs += [(5, docs[0][1], docs[0][2]), (None, long[3], "1"), (None, None, None), (1, long[4], "late"), (300, long[4], "late")]
    labels = [(i, int(q), int(t)) for i, (q, t) in enumerate(zip(rng.integers(0, 2, 80), rng.integers(0, 2, 80)), 5)]
    assert audited(spark, docs, labels + [(None, 1, 1), (999, 1, 1), (205, None, None)]) == brute_audit(docs, {i: (q, t) for i, q, t in labels})


def test_audit_of_nothing_and_label_repeats(spark):
    assert audited(spark, [], []) == {}
    got = audited(spark, [(1, None, None)], [(1, 0, 1), (1, 1, 0), (1, 0, 0)])
    assert len(got) == 600 and {k[0] for k in got} == {""}
    assert got["", "ABCDE", 1] == (0, 1, 0, 1, 1, 1, 120) and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_sketch_clears_unique_texts_and_keeps_every_repeat(spark):
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = [(k % 7, digest(f"once {k}")) for k in range(20_000)] + [(k % 7, digest(f"twice {k % 300}")) for k in range(600)] + [(k % 7, digest("hot")) for k in range(3_000)]
    found = filter_audit.possible_repeats(spark.createDataFrame(rows, "task long, digest binary").repartition(5)).collect()
    digests = {bytes(r["digest"]) for r in found}
    assert {digest(f"twice {k}") for k in range(300)} | {digest("hot")} <= digests
    assert len(digests) < 301 + 0.02 * 20_000
    assert len(found) == len({(r["task"], bytes(r["digest"])) for r in found})
    # a text in one task only is still one that repeats
    alone = [(0, digest("a")), (0, digest("a")), (0, digest("b"))]
    assert [bytes(r["digest"]) for r in filter_audit.possible_repeats(spark.createDataFrame(alone, "task long, digest binary").coalesce(1)).collect()] == [digest("a")]


# ---- codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) by plain loops over Python integers, and the digest."""
    kept = [(i, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * size:(p + 1) * size])
    books = [[cut(v, p) for _, v, _ in sorted(kept)[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((away(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [(nearest(cut(v, p), book)[1], cut(v, p)) for _, v, _ in kept]
            for k in range(len(book)):
                members = [x for e, x in mine if e == k]
                if members:
                    books[p] = [*books[p][:k], tuple(sum(c) // len(members) for c in zip(*members)), *books[p][k + 1:]]
    found = [(i, lab, [nearest(cut(v, p), books[p]) for p in range(parts)]) for i, v, lab in kept]
    total = {}
    for _, lab, near in found:
        total[lab] = total.get(lab, 0) + sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in near), min(sum(d for d, _ in near), 2**63 - 1), min(total[lab], 2**63 - 1), digest) for i, lab, near in found)


@pytest.mark.parametrize("scale", [1.0, 1e6])  # the second needs Python integers
def test_codes_equal_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    matrix = np.round(rng.standard_normal((120, 16)) * scale, 2 if scale == 1 else -5)  # many ties
    rows = [(int(i), list(v), int(lab) if lab else None) for i, v, lab in zip(rng.permutation(120) + 3, matrix, rng.integers(0, 3, 120))]
    rows += [(0, None, 1), (1, [None, *matrix[0][1:]], 1), (2, [float("nan"), *matrix[0][1:]], 1)]
    frame = vectors_frame(spark, rows).withColumn("code", F.lit("x"))
    got = vector_codes.compress(frame)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.drop("label").collect()) == brute_codes(rows)


def test_orchard_search_is_exact_with_ties():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 16, 40):
        entries = rng.integers(-4, 5, (n, 3))
        x = rng.integers(-5, 6, (500, 3))
        best, least = vector_codes.Codebook(entries).nearest(x)
        away = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()


def test_codes_odd_tables(spark):
    few = vectors_frame(spark, [(2, [1, 2, 3], None), (1, [1], None), (2, [1, 2, 3], 5), (None, [0, 0, 9], 5), (4, [], 5), (5, [3e38, -3e38], 6), (6, None, 6)])
    rows = vector_codes.compress(few).collect()
    assert len(rows) == 6 and all(len(r["code"]) == 16 for r in rows) and len({r["codebooks_sha256"] for r in rows}) == 1
    assert all(r["error"] == 0 for r in rows)  # fewer vectors than entries: each is an entry
    assert vector_codes.compress(few.where("vec_id = 6")).count() == 0 and vector_codes.compress(few.where("false")).count() == 0


def test_queries_are_registered():
    for name in ("op11_vector_near_dedup", "op12_filter_audit", "op13_vector_codes"):
        assert name in QUERIES and name in ORACLE
    assert q_vectors.op13_vector_codes
