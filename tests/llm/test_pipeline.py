import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headwise.llm.common import write_and_read
from tests.llm import brute
from tests.llm.test_text_operators import leaks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents after each stage, beginning with planted rows among a whole small table."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    base = docs.filter("length(text) > 800 and lang = 'en'").orderBy("doc_id").first().text
    words = base.split()
    passage = " ".join(words[20:90])
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    fresh = [f"then the {i} and of the river they ran over" for i in range(40)]
    planted = [
        (90001, None), (90002, ""), (90003, "12345 ... !!!"), (90004, base), (90005, base + " the end of it"),
        (90006, " ".join(fresh[:8]) + " " + passage), (90007, " ".join(fresh[8:16]) + " " + item),
        (90008, "the same row of the table and of the house that is here"), (90008, "the same row of the table and of the house that is here"),
        (None, "a text without an id that is about the house and the river of the land"),
    ]
    rows = spark.createDataFrame([(i, t, None, "p", 0) for i, t in planted], docs.schema)
    docs = write_and_read(docs.union(rows).repartition(4), "planted")
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = write_and_read(stage(spark, docs, FOLDER), "test-stage")
        results.append(docs)
    return results


def texts(docs):
    return sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)


def test_stages_keep_the_columns(kept):
    assert all(docs.columns == kept[0].columns for docs in kept[1:5])


def test_unknown_languages_go_and_clean_documents_stay(kept):
    gone = {str(k) for k in texts(kept[0])} - {str(k) for k in texts(kept[1])}
    letters = [k for k in texts(kept[0]) if k[1] and any(map(str.isalpha, k[1]))]
    assert {90001, 90002, 90003} == {i for i, _ in texts(kept[0]) if i in (90001, 90002, 90003)}
    assert len(gone) == len({str(k) for k in texts(kept[0])} - {str(k) for k in letters})


def test_one_document_of_each_group_stays(kept):
    before = [k for k in texts(kept[1]) if k[0] is not None]
    groups = brute.near_groups(dict(before).items(), 5, 80)
    assert sorted(i for i, _ in texts(kept[2]) if i is not None) == sorted(set(groups.values()))
    assert sum(i is None for i, _ in texts(kept[2])) == 1


def test_repeated_passages_stay_once(kept):
    before = sorted(texts(kept[2]), key=lambda k: (k[0] is not None, k[0] or 0))
    after = {i: t for i, t in texts(kept[3])}
    for (i, text), (words, left) in zip(before, brute.kept_words(before, 20)):
        if words and not left:
            assert i not in after
        else:
            assert after[i] == (text if len(words) == len(left) else b" ".join(left).decode())
    assert len(after[90006].split()) < 150


def test_leaks_go(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = texts(kept[3])
    hit = leaks(before, items)
    assert {i for i, _ in texts(kept[4])} == {i for i, _ in before if not hit[i][1]}
    assert hit[90007][1] > 0


def test_every_document_is_packed(kept):
    pieces = kept[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in texts(kept[4])}
    used = kept[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in used) <= 2048


def test_run_applies_all_stages_to_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_a_text_goes_through_passages_once(spark, monkeypatch):
    docs = brute.documents(spark, ["one text of a few words", None]).withColumnRenamed("source", "a.b")
    seen = []
    real = corpus_pipeline.substring.remove_repeats
    monkeypatch.setattr(corpus_pipeline.substring, "remove_repeats", lambda packed: seen.append(packed.schema) or real(packed))
    out = corpus_pipeline.first_passages(spark, docs, FOLDER)
    assert out.columns == docs.columns and out.count() == 2
    assert "text" not in seen[0]["_row"].dataType.fieldNames()
    plain = corpus_pipeline.first_passages(spark, docs.select("doc_id", "text"), FOLDER)
    assert plain.columns == ["doc_id", "text"] and plain.count() == 2
