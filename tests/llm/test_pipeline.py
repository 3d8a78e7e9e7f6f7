"""Every stage of the pipeline against what its operator and a plain version say, each on its own input."""

import corpus_pipeline
import pytest

from tallyward.llm import decontaminate, line_dedup, ordinal
from tallyward.llm.staging import keep

from ..conftest import SMALL_TABLES
from . import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL_TABLES}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = keep(stage(spark, docs, SMALL_TABLES), name)
        out.append((name, docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_and_take_effect(stages):
    for _, docs, made in stages[:-1]:
        assert made.columns == docs.columns and made.schema == docs.schema
    counts = [made.count() for _, _, made in stages]
    assert stages[0][1].count() >= counts[0] > 0
    assert counts[1] == counts[0] > counts[2] >= counts[3] > 0


def test_quality(spark, stages):
    _, docs, made = stages[0]
    labels = spark.read.parquet(f"{SMALL_TABLES}/labels.parquet")
    scored = ordinal.graded(docs, ordinal.train(docs, labels)).where("kept")
    assert set(texts(made)) == {r.doc_id for r in scored.collect()}


def test_lines(stages):
    _, docs, made = stages[1]
    left = brute.lines_left(texts(docs), line_dedup.BLOCK_WORDS)
    assert texts(made) == left
    assert made.where("n_chars != char_length(text)").count() == 0


def test_near_copies(stages):
    _, docs, made = stages[2]
    assert set(texts(made)) == {i for i, (_, c) in brute.near_groups(texts(docs), 80).items() if i == c}


def test_leaks(spark, stages):
    _, docs, made = stages[3]
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{SMALL_TABLES}/benchmark.parquet"))
    assert set(texts(docs)) - set(texts(made)) == {r.doc_id for r in found.collect()}


def test_packing(stages):
    _, docs, made = stages[4]
    assert {r.doc_id for r in made.select("doc_id").distinct().collect()} == set(texts(docs))


def test_run(spark, stages):
    def rows(df):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())

    assert rows(corpus_pipeline.run(spark, SMALL_TABLES)) == rows(stages[-1][2])


def test_rows_that_share_an_id_keep_their_texts(spark):
    """Odd rows through every stage: an id with two texts, clashing names, nulls, an empty table."""
    block = "a line of eight words that others hold\n" * 2
    rows = [
        (1, block + "own line 1"), (2, block + "own line 2"), (2, "a wholly different text that only this row has at all"),
        (3, None), (4, ""), (None, block), (5, block + "own line 2"),
    ]
    docs = spark.createDataFrame([(*r, "x", "y", "z", 0) for r in rows], "doc_id long, text string, _text string, row string, left string, n_chars int")
    made = corpus_pipeline.lines(spark, docs, SMALL_TABLES)
    assert made.columns == docs.columns
    own = sorted((r.doc_id, r.text) for r in made.where("doc_id is not null and text is not null").collect())
    assert [t for i, t in own if i == 2] == sorted(["a wholly different text that only this row has at all", "own line 2"]) or (
        (2, "a wholly different text that only this row has at all") in own and len([t for i, t in own if i == 2]) == 2
    )
    assert made.where("doc_id is null").first().text == block and made.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), SMALL_TABLES).count() == 0, name
        assert stage(spark, docs, SMALL_TABLES).count() >= 0, name
