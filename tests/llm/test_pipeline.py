"""The pipeline's stages: order, columns, what goes and what stays, empty input."""

from __future__ import annotations

import corpus_pipeline
from ticketloom.llm.common import store


def test_stages_and_their_columns(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(store(stage(spark, seen[-1], sf_dir), f"test-{name}"))
    for frame in seen[1:-1]:
        assert frame.columns == columns and frame.where("n_chars <> length(text)").count() == 0
    counts = [frame.count() for frame in seen[:-1]]
    assert counts[0] >= counts[1] == counts[2] > counts[3] == counts[4] > 0.7 * counts[0]
    packed = seen[-1]
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_take_empty_and_odd_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.where("false")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a b", None, "s", 3), (3, "a b", None, "s", 3)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.count() == 5, name
        assert {r["text"] for r in out.where("doc_id = 1 or doc_id is null").collect()} == {None}


def test_near_copies_from_four_fifths_on_go(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text, more = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 108), ("b", 24)))
    fewer = " ".join(f"c{i}" for i in range(108))
    texts = {1: text, 2: f"{text} {more}", 3: fewer, 4: f"{fewer} {more} b24 b25 b26"}  # 104/128 and 104/131 shared runs of five words
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == [1, 3, 4]


def test_a_repeated_line_survives_with_its_copies(spark, sf_dir):
    """Lines are kept where copies are kept: no long line of the input vanishes from groups of copies."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    line = lambda name, n=14: " ".join(f"{name}{i}" for i in range(n))
    copies = [(i, f"{line('long')}\n{line('shared')}\nshort {line('tail')}") for i in (4, 9, 11, 12, 30, 31)]
    others = [(i, f"{line('shared')}\n{line(f'own{i}', 60)}") for i in (2, 6, 13, 14, 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in copies + others], schema)
    lines = store(corpus_pipeline.drop_lines(spark, docs, sf_dir), "test-lines")
    kept = corpus_pipeline.drop_near_copies(spark, lines, sf_dir).collect()
    left = {part for r in kept for part in (r["text"] or "").split("\n")}
    assert {part for _, t in copies + others for part in t.split("\n")} <= left
