"""The pipeline's stages on odd rows, and their decisions against the operators' own brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import STAGES, run
from pseudospark.sources.files import Workspace

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", STAGES[:-1])
def test_filters_keep_columns_and_odd_rows(spark, docs, no_docs, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert {3, 4, 5, 8, 10, 11} <= set(ids) and ids.count(None) == 2
    assert stage(spark, no_docs, SF).count() == 0


CLASHING = (
    "__doc __digest __lines __gone __covered_doc __covered_digest __places __row __score score line_count removed_lines deduplicated "
    "__number number digest __id __of of_id of_digest n n_words places window kept component_id lines row part"
).split()


@pytest.mark.parametrize("name, stage", STAGES)
def test_columns_with_names_of_the_stages_own(spark, docs, name, stage):
    """They change no result and come out as they went in."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = plain.withColumns({c: F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    want, out = stage(spark, plain, SF), stage(spark, more, SF)
    assert sorted(map(str, out.select("doc_id", *want.columns[1:]).collect())) == sorted(map(str, want.collect()))
    if name != STAGES[-1][0]:
        assert out.columns == more.columns
        for r in out.collect():
            assert all(r[c] == (c if r.doc_id is None else f"{c}/{r.doc_id}") for c in CLASHING)


def test_one_of_each_group_stays(spark, docs):
    ids = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and 9 not in ids


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """What is gone is a row, not all rows of its id; a text of its own stays, under whatever id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (6, b + " more"), (7, c), (7, None), (7, None), (7, ""), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()]
    expected = [(1, a), (5, b), (7, c), (7, None), (7, ""), (None, a), (None, a)]
    assert sorted(left, key=str) == sorted(expected, key=str)


def test_benchmark_passages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    marked = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat("text", F.lit(" " + item)))
    out = corpus_pipeline.drop_contaminated(spark, docs.unionByName(marked), SF)
    assert out.where("doc_id >= 10000").count() == 0 and out.count() > 0.7 * docs.count()


def test_run(spark, tmp_path, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(corpus_pipeline, "Workspace", lambda spark: Workspace(spark, str(scratch)))
    out = run(spark, SF)
    # Only what the stages gave is left.
    left = {re.sub("-[0-9a-f]{32}$", "", p.name) for p in next(scratch.iterdir()).iterdir() if any(p.iterdir())}
    assert left == {name.replace(" ", "_") for name, _ in STAGES}
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} == set(out.columns)
    kept = out.select("doc_id").distinct()
    assert kept.count() == out.count() and kept.join(docs, "doc_id").count() == out.count() > 0.5 * docs.count()
