"""Token counts against the library, and what the cache spares."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from pseudospark.llm import token_counts as module  # noqa: E402
from pseudospark.llm.token_counts import Counts, TokenCache, token_counts, tokenizer_version  # noqa: E402
from pseudospark.sources import files  # noqa: E402

WORDS, BYTES, PIECES = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SF_DIR = "/root/testdata/sf0.001"


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(processor.encode(text))
    tokenizer = tokenizers.Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture
def cache(spark, workspace):
    return TokenCache(spark, workspace.path("cache"))


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_all_documents(spark, workspace, cache, path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    count = library(path)
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, path, cache, workspace).collect()}
    expected = {}
    for r in docs.collect():
        n = count(r.text or "")
        expected[r.doc_id] = (len((r.text or "").encode()), n, n > 2048)
    assert found == expected


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_random_texts(path):
    rng = random.Random(4)
    marks = list("ab 1\n\t\r\x0b\x0ćé'stre\x85\xa0　\x1c中İΣςſĶ") + ["<|endoftext|>", "<|startoftext|>", "'ll", "  ", "<s>"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(3000)]
    counts, count = Counts(path), library(path)
    assert counts.of([t.encode() for t in texts]) == [count(t) for t in texts]


def test_only_words_are_counted_apart():
    assert Counts(WORDS).separable
    assert not Counts(BYTES).separable and not Counts(PIECES).separable


def test_words_forgotten_in_between(monkeypatch):
    monkeypatch.setattr(module, "CACHED", 3)
    counts, count = Counts(WORDS), library(WORDS)
    for text in ["one two three four five", "one six", "two two seven", "one two three four five six seven"]:
        assert counts.of([text.encode()]) == [count(text)]


def test_odd_rows(docs, workspace, cache):
    count = library(WORDS)
    found = sorted(token_counts(docs, WORDS, cache, workspace, limit=100).select("doc_id", "n_tokens", "over_limit").collect(), key=str)
    expected = sorted(((r.doc_id, count(r.text or ""), count(r.text or "") > 100) for r in docs.collect()), key=str)
    assert [tuple(r) for r in found] == expected


def test_no_documents(no_docs, workspace, cache):
    assert token_counts(no_docs, WORDS, cache, workspace).count() == 0
    assert token_counts(no_docs, WORDS, cache, workspace).count() == 0


def numbers(frame):
    return {r.doc_id: r.n_tokens for r in frame.collect()}


def test_only_distinct_misses_are_encoded(spark, workspace, cache):
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three"), (4, None), (5, "")], schema)
    second = spark.createDataFrame([(6, "three"), (7, "four five six"), (8, "four five six"), (9, None)], schema)
    version = tokenizer_version(WORDS)
    assert numbers(token_counts(first, WORDS, cache, workspace)) == {1: 2, 2: 2, 3: 1, 4: 0, 5: 0}
    assert cache.read(version).count() == 3
    assert numbers(token_counts(second, WORDS, cache, workspace)) == {6: 1, 7: 3, 8: 3, 9: 0}
    assert cache.read(version).count() == 4
    batches = files.glob(spark, f"{cache.path}/version=*/batch=*")
    assert numbers(token_counts(second, WORDS, cache, workspace)) == {6: 1, 7: 3, 8: 3, 9: 0}
    assert files.glob(spark, f"{cache.path}/version=*/batch=*") == batches


def test_stored_counts_are_believed(spark, workspace, cache):
    """A count in the cache is used, so the text is not encoded again; another tokenizer has counts of its own."""
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    version = tokenizer_version(WORDS)
    stored = spark.sql("SELECT sha2('one two', 256) AS digest, 77L AS n_tokens")
    cache.append(version, stored, "planted")
    assert numbers(token_counts(docs, WORDS, cache, workspace)) == {1: 77}
    cache.append(version, stored, "planted-twice")
    assert numbers(token_counts(docs, WORDS, cache, workspace)) == {1: 77}
    assert numbers(token_counts(docs, BYTES, cache, workspace)) == {1: 2}


def test_many_misses_beside_known_ones(spark, workspace, cache, monkeypatch):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('word ', id % 10) AS text")
    token_counts(docs.where("doc_id < 3"), WORDS, cache, workspace)
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    count = library(WORDS)
    assert numbers(token_counts(docs, WORDS, cache, workspace)) == {i: count(f"word {i % 10}") for i in range(50)}
    assert cache.read(tokenizer_version(WORDS)).count() == 10
