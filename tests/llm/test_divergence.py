"""Divergence of sources against a plain dense calculation."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pseudospark.llm import divergence as module
from pseudospark.llm.divergence import divergence, scaled, source_divergence, term_counts

COLUMNS = "doc_id long, text string, lang string, source string, number int, terms long, total long, block long"


def rows():
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Ünï", "ünï", "中文", "it's", "x1y", "ABC", "abc"]
    out = []
    for i in range(150):
        lang, source = rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "é", "Z"])
        if rng.random() < 0.4:
            lang, source = "en", "a"  # a hot group
        out.append((i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(40))), lang, source))
    out += [(200, None, "en", "silent"), (201, "", "en", "empty"), (202, "common wa", None, None), (None, "wa wb", "en", None)]
    out += [(203, "rare words only", "xx", "a"), (204, "others here", "xx", "b")]  # a language without kept terms
    out += [(205, "wa wa wa", "en", "b")] * 3  # repeated rows
    out += [(206, " ".join(["wa", "wc"] * 20_000), "de", "long")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows()], COLUMNS)


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(rows, ranks=200):
    docs = [(lang or "", source or "", words_of(text)) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        used = Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted(w for w, n in used.items() if n >= 3)
        groups = sorted({s for _, s, _ in own})
        counts = {g: Counter(w for _, s, ws in own if s == g for w in ws if used[w] >= 3) for g in groups}
        counts[None] = sum((counts[g] for g in groups), Counter())

        def p(g, w):
            return 1 + 1_000_000_000 * (counts[g][w] + 1) // (sum(counts[g].values()) + len(kept))

        def f(p, q):
            return (p - q) * (p - q) // q

        for g in groups:
            pairs = [(-sum(f(p(g, w), p(h, w)) for w in kept), h.encode()) for h in groups if h != g]
            terms = [(-f(p(g, w), p(None, w)), w.encode()) for w in kept if counts[g][w] and p(g, w) > p(None, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out |= {(lang, g, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("postings, places", [(16_384, 4_000_000), (7, 4_000_000), (20, 9), (3, 1)])
def test_against_dense_sums(docs, workspace, monkeypatch, postings, places):
    """In one block, and cut into many blocks of terms and ranges of groups."""
    monkeypatch.setattr(module, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(module, "PLACES", places)
    found = source_divergence(docs, workspace)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    collected = [tuple(r) for r in found.collect()]
    assert len(collected) == len(set(collected))
    assert set(collected) == expected(rows())


def test_term_ranks(docs, workspace):
    assert {tuple(r) for r in source_divergence(docs, workspace, term_ranks=2).collect()} == expected(rows(), 2)


def test_counts_sent_on_early(docs, monkeypatch):
    whole = {tuple(r) for r in term_counts(docs).collect()}
    monkeypatch.setattr(module, "COUNTED", 5)
    assert {tuple(r) for r in term_counts(docs).collect()} == whole


def test_no_documents(spark, workspace):
    assert source_divergence(spark.createDataFrame([], COLUMNS), workspace).count() == 0


def test_only_silent_documents(spark, workspace):
    silent = spark.createDataFrame([(1, None, "en", "a"), (2, " 12 ", "en", "b")], "doc_id long, text string, lang string, source string")
    found = {tuple(r) for r in source_divergence(silent, workspace).collect()}
    assert found == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_scaled_is_exact():
    rng = random.Random(9)
    for _ in range(2000):
        whole = rng.randrange(1, 10 ** rng.randrange(1, 16))
        count = rng.randrange(1, whole + 1)
        assert int(scaled(count, whole)) == 1 + 10**9 * count // whole
    assert int(divergence(np.int64(10**9 + 1), np.int64(1))) == 10**18
