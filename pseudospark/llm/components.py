"""Connected components over a table of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pseudospark.sources.files import Workspace

#: Links that one task contracts, and the most that it holds at a time.
TASK_LINKS = 200_000
HELD_LINKS = 400_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of a task's links: each node with the smallest one that the links join it to."""
    above: dict[int, int] = {}
    held = 0

    def root(node: int) -> int:
        top = node
        while (up := above.get(top, top)) != top:
            top = up
        while (up := above.get(node, node)) != top and up != node:
            above[node], node = top, up
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(node, root(node)) for node in above]
        columns = zip(*[p for p in pairs if p[0] != p[1]])
        a, b = list(columns) or ((), ())
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            above.setdefault(x, x)
            above.setdefault(y, y)
            if x != y:
                above[max(x, y)] = min(x, y)
        held += batch.num_rows
        if held > HELD_LINKS:
            yield stars()
            held = 0
    yield stars()


def _with_least(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``edges`` (a, b) and the least ``b`` of each ``a``. Both sides are tables, so that a skewed join can be split."""
    least = workspace.save(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    return edges.join(least, "a")


def connected_components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, component`` for each node of ``links`` (a, b; both long); a component is named by its smallest node.

    Tasks first contract the links they hold, as many tasks as the counted links need. Where that is more than one, rounds
    follow: each links the larger neighbours of a node to its smallest neighbour, then the smaller ones, until only stars
    around the smallest nodes are left. Links may repeat, run either way and join a node to itself; a null on
    either side links nothing. No links give no rows.
    """
    seen = Observation()
    linked = links.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    linked = workspace.save(linked.observe(seen, F.count(F.lit(1)).alias("n")), "links")
    tasks = -(-(seen.get.get("n") or 0) // TASK_LINKS)
    following = workspace.save(linked.coalesce(max(1, tasks)).mapInArrow(_contracted, "a long, b long"), "contracted")
    edges = following
    while tasks > 1:
        both = workspace.save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        larger = workspace.save(
            _with_least(both, workspace)
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
            .where("a <> b")
            .distinct(),
            "larger",
        )
        pairs = _with_least(larger, workspace)
        following = workspace.save(
            pairs.select("a", F.col("least").alias("b"))
            .unionByName(pairs.select(F.col("b").alias("a"), F.col("least").alias("b")))
            .where("a <> b")
            .distinct(),
            "stars",
        )
        # A star's leaf has one link only, and none of its own leaves.
        hubs = following.select(F.col("b").alias("a")).distinct()
        tangled = following.groupBy("a").count().where("count > 1").limit(1).count()
        if not tangled and not following.join(hubs, "a", "left_semi").limit(1).count():
            break
        edges = following
    nodes = following.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(following.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
