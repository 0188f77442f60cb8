"""The pipeline's rows on the smallest tables, stage by stage, against plain Python."""

import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from panelsift.llm import pii
from panelsift.llm.common import read_table
from tests.llm.test_jaccard import brute_force, shingle_set

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_keeps_and_encodes_what_plain_python_does(spark):
    docs = read_table(spark, FOLDER, "documents")
    kept = [r for r in corpus_pipeline.keep_quality(spark, docs, FOLDER).collect()]
    assert kept and set(kept[0].asDict()) == set(docs.columns)
    least = {d: c for d, _, c in brute_force([(r.doc_id, r.text) for r in kept])}
    items = [s for r in read_table(spark, FOLDER, "benchmark").collect() if len(s := shingle_set(r.text)) and len(r.text.split()) >= 5]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {}
    for r in kept:
        own = shingle_set(r.text)
        if least[r.doc_id] == r.doc_id and not any(10 * len(own & s) >= 8 * len(s) for s in items):
            expected[r.doc_id] = library.encode(pii.mask(r.text))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == expected


def words(seed, n=80):
    rnd = random.Random(seed)
    return " ".join("the" if i % 6 == 0 else rnd.choice("abcdefgh") * rnd.randint(2, 6) + str(rnd.randint(0, 99)) for i in range(n))


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string{extra}")


def test_an_id_with_two_texts_is_two_documents(spark):
    a, b, c = words(1), words(2), words(3)
    rows = [(5, a, "x"), (5, b, "x"), (6, b, "x"), (7, c, "x"), (7, c, "y"), (8, a + " end", "x"), (9, "", "x"), (9, None, "x"),
            (10, "", "x"), (None, a, "x"), (None, a, "x")]
    kept = corpus_pipeline.one_per_group(spark, table(spark, rows), FOLDER).collect()
    found = sorted((r.doc_id or 0, r.text or "") for r in kept)
    assert found == sorted([(5, a), (5, b), (7, c), (9, ""), (10, ""), (0, a), (0, a)])


CLASH = ", quality string, key int, content string, kept int, component_id string, n_shingles string, n_words string, ids string"


@pytest.mark.parametrize("stage", range(4))
def test_stages_return_the_columns_they_got(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = table(spark, [(1, words(1), "x", "own", 7, "c", 1, "d", "n", "w", "i"), (2, words(2), "x", "own", 7, "c", 1, "d", "n", "w", "i")], CLASH)
    made = run(spark, docs, FOLDER)
    assert made.columns == docs.columns
    rows = made.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2] and all(tuple(r)[2:] == ("x", "own", 7, "c", 1, "d", "n", "w", "i") for r in rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_rows(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, table(spark, []), FOLDER).collect() == []
    rows = run(spark, table(spark, [(1, None, None), (2, "", "x"), (None, None, None)]), FOLDER).collect()
    assert len(rows) == (0 if stage == 0 else 3)
