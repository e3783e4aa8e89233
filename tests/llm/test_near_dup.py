"""Near-duplicates against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pseudospark.llm import components, near_dup
from pseudospark.llm.components import connected_components
from pseudospark.llm.near_dup import EMPTY, estimate, near_duplicates, registers
from pseudospark.llm.words import mix


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute_force(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    """Families of edited copies, some below the threshold to the original, exact copies and short texts."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 120]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = [w if rng.random() > rng.choice([0, 0.02, 0.05, 0.1]) else rng.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, rows[0][1].upper()) for i in range(5)]
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_components(spark, workspace, corpus, n):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df, workspace, shingle=n).collect()} == brute_force(corpus, n)


def test_families_over_several_blocks(spark, workspace, corpus, monkeypatch):
    """Blocks of few nodes: what one block cannot join is found between blocks."""
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 4)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(100)]
    rows = corpus + [
        (1000 + i, " ".join(w if rng.random() > 0.05 else f"x{rng.randrange(50)}" for w in base)) for i in range(60)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df, workspace, shingle=2).collect()} == brute_force(rows, 2)


def test_odd_rows(docs, no_docs, workspace):
    found = near_duplicates(docs, workspace, shingle=2)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(found.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [
        (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True),
        (8, 8, True), (9, 8, False), (10, 10, True), (11, 11, True), (None, None, True), (None, None, True),
    ]
    assert [r.n_shingles for r in got if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    assert near_duplicates(no_docs, workspace).count() == 0


def test_registers_and_estimates():
    draw = np.random.default_rng(1)
    pool = np.unique(mix(draw.integers(0, 2**63, 6000, dtype=np.uint64)))
    draw.shuffle(pool)
    a, b = np.sort(pool[:3000]), np.sort(pool[600:3600])
    ra, rb = registers(a), registers(b)
    assert abs(estimate(ra, rb, np.array(3000), np.array(3000)) - 2400 / 3600) < 0.12
    assert estimate(ra, ra, np.array(3000), np.array(3000)) == pytest.approx(1, abs=1e-3)
    assert (registers(a[:0]) == EMPTY).all()
    # A register holds the leading zeros of a bucket's least hash and the bits after its leading one.
    one = np.array([(5 << 56) | (0b0001_1010_1010_1011 << 40)], dtype=np.uint64)
    assert registers(one)[5] == (3 << 10 | 0b1010101010)


@pytest.mark.parametrize("task_links", [200_000, 20])
def test_connected_components(spark, workspace, monkeypatch, task_links):
    """Contracted by one task, and by several with rounds after them."""
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(7, 7), (None, 3)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    neighbours = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    expected = {}
    for node in sorted(neighbours):
        todo = [node]
        while todo:
            i = todo.pop()
            if i not in expected:
                expected[i] = node
                todo.extend(neighbours[i])
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    assert {tuple(r) for r in connected_components(df, workspace).collect()} == set(expected.items())
    assert connected_components(df.limit(0), workspace).count() == 0


def test_links_held_in_turns(monkeypatch):
    """A task that holds few links at a time leaves stars that join what its links join."""
    monkeypatch.setattr(components, "HELD_LINKS", 3)
    batches = [pa.RecordBatch.from_pydict({"a": [i, i + 1], "b": [i + 1, i + 2]}) for i in range(0, 20, 2)]
    stars = [tuple(r.values()) for b in components._contracted(iter(batches)) for r in b.to_pylist()]
    joined = {0}
    while more := {x for link in stars for x in link if joined & set(link)} - joined:
        joined |= more
    assert joined == set(range(21)) and all(a > b for a, b in stars)


def similar_pairs(draw, sizes, copies):
    """Pairs of random sets at a Jaccard similarity of 0.8 or a little more: hashes in common, and those of one only."""
    for common, left, right in sizes:
        for _ in range(copies):
            pool = mix(draw.integers(0, 2**63, common + left + right, dtype=np.uint64))
            yield np.sort(pool[: common + left]), np.sort(np.r_[pool[:common], pool[common + left :]])


def test_small_sets_always_share_a_key():
    sizes = [(4, 0, 1), (5, 0, 1), (8, 1, 1), (8, 0, 2), (9, 1, 1), (12, 0, 3), (12, 1, 2), (13, 0, 3), (16, 1, 3), (16, 2, 2)]
    for a, b in similar_pairs(np.random.default_rng(3), sizes, 300):
        assert set(near_dup.small_keys(a, 0.8)) & set(near_dup.small_keys(b, 0.8))
    for a, b in similar_pairs(np.random.default_rng(4), [(2, 0, 1), (3, 1, 1), (4, 0, 4), (9, 2, 3)], 100):
        assert set(near_dup.small_keys(a, 0.5)) & set(near_dup.small_keys(b, 0.5))


def test_very_short_texts(spark, workspace):
    """Pairs of texts that differ by one word at the end: 4 and 5 shingles, of which bands lost about one in 65."""
    rows = []
    for i in range(1500):
        words = [f"w{i}x{k}" for k in range(6)]
        rows += [(2 * i, " ".join(words[:5])), (2 * i + 1, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(df, workspace, shingle=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(i, i - i % 2) for i in range(3000)]
