"""Sharding by its law, and top-k against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pseudospark.llm.sharding import Tree, shard_of, sharded
from pseudospark.llm.topk import block_top, top_inner_products


def placed(spark, tree, n=4000):
    rows = spark.range(n).select("id", shard_of(F.col("id").cast("string"), tree).alias("shard"))
    return {r.id: r.shard for r in rows.collect()}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    tree = Tree.even(40)
    before = placed(spark, tree)
    assert set(before.values()) == set(range(40))
    for shard in range(40, 43):
        tree = tree.grown()
        after = placed(spark, tree)
        moved = {i for i in after if after[i] != before[i]}
        assert moved and {after[i] for i in moved} == {shard}
        before = after


def test_weights_rule_shares_and_confine_movement(spark):
    light = Tree(((((0, 1.0), (1, 1.0)),), (((2, 2.0),), ((3, 4.0), (4, 0.0)))))
    heavy = Tree(((((0, 1.0), (1, 1.0)),), (((2, 2.0),), ((3, 8.0), (4, 0.0)))))
    a, b = placed(spark, light, 8000), placed(spark, heavy, 8000)
    count = Counter(a.values())
    assert 4 not in count
    for shard, weight in ((0, 1), (1, 1), (2, 2), (3, 4)):
        assert math.isclose(count[shard] / 8000, weight / 8, abs_tol=0.02)
    # The first region kept its weight: nothing moves inside it, and nothing moves into it.
    assert all(a[i] == b[i] for i in a if b[i] in (0, 1))
    assert any(a[i] in (0, 1, 2) and b[i] == 3 for i in a)


def test_table(docs, no_docs, workspace):
    rows = sharded(docs, Tree.even(40), workspace).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id == 2}) == 1
    assert sharded(no_docs, Tree.even(40), workspace).count() == 0


def brute_force(rows, modulus, k):
    kept = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None
                   and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for q, a in kept:
        if q % modulus == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_search(spark, workspace, monkeypatch):
    monkeypatch.setattr("pseudospark.llm.topk.CANDIDATE_ROWS", 40)
    monkeypatch.setattr("pseudospark.llm.topk.QUERY_ROWS", 8)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.3, 1.0]) for _ in range(40)]) for i in range(150)]
    rows += [(150 + i, [0.5] * 40) for i in range(60)]  # ties
    rows += [(300, None), (310, [None] * 40), (320, [float("nan")] * 40), (330, [float("inf")] * 40), (None, [1.0] * 40)]
    rows += [(340, []), (350, []), (360, [1.0]), (370, [2.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in top_inner_products(df, workspace, query_modulus=10, k=5).collect()}
    assert got == brute_force(exact, 10, 5)
    assert top_inner_products(df.limit(0), workspace, query_modulus=10).count() == 0


def test_bounds_lose_nothing_at_any_size():
    draw = np.random.default_rng(3)
    for scale in (3, 10**5, 10**8, 10**12):
        vectors = draw.integers(-scale, scale, (200, 50)).astype(float)
        ids = np.arange(200)
        found = defaultdict(list)
        for q, i, s in block_top(vectors[:20], ids[:20], vectors, ids, 7):
            found[q].append((-s, i))
        for q in range(20):
            a = [int(x) for x in vectors[q]]
            scores = sorted((-sum(x * int(y) for x, y in zip(a, vectors[i])), i) for i in range(200) if i != q)[:7]
            assert found[q] == [(max(-(2**63 - 1), min(2**63, s)), i) for s, i in scores]
