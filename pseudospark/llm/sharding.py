"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards; a node weighs what its shards weigh. A row descends the tree: at each node every
child draws a number from the hash of the row's key and the child's name, an exponential variable with the child's
weight as its rate, and the least draw wins. A child wins in proportion to its weight, and its draw depends on nothing
else, so a changed weight moves rows only into or out of the subtrees whose weights changed. A grown shard comes as a
region of its own, and then takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudospark.operators.ordered import numbered
from pseudospark.sources.files import Workspace

RACK_SHARDS = 4
REGION_RACKS = 2
#: What a row takes besides its text, in bytes.
ROW_BYTES = 16
DRAW_BITS = 48


@dataclass(frozen=True)
class Tree:
    """Weights of shards by region and rack: ``regions[r][k]`` are (shard, weight) pairs."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int) -> "Tree":
        """A tree over shards 0, 1, ... of equal weight, filled rack by rack."""
        racks = [tuple((s, 1.0) for s in range(a, min(shards, a + RACK_SHARDS))) for a in range(0, shards, RACK_SHARDS)]
        return Tree(tuple(tuple(racks[a : a + REGION_RACKS]) for a in range(0, len(racks), REGION_RACKS)))

    def grown(self, weight: float = 1.0) -> "Tree":
        """With one more shard, in a region of its own."""
        following = 1 + max((s for region in self.regions for rack in region for s, _ in rack), default=-1)
        return Tree((*self.regions, ((((following, weight),),))))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Name and weight of each node's children; the root is the empty name, a leaf's name ends in its shard."""
        out: dict[str, list[tuple[str, float]]] = {"": []}
        for r, region in enumerate(self.regions):
            out[""].append((f"r{r}", sum(w for rack in region for _, w in rack)))
            out[f"r{r}"] = [(f"r{r}k{k}", sum(w for _, w in rack)) for k, rack in enumerate(region)]
            for k, rack in enumerate(region):
                out[f"r{r}k{k}"] = [(f"r{r}k{k}s{s}", w) for s, w in rack]
        return {node: [(c, w) for c, w in kids if w > 0] for node, kids in out.items()}


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key (a string)."""
    children = tree.children()
    table = F.create_map(
        *[
            item
            for node, kids in children.items()
            for item in (F.lit(node), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in kids]))
        ]
    )

    def draw(child: Column) -> Column:
        digest = F.substring(F.md5(F.concat(child["name"], F.lit("/"), key)), 1, DRAW_BITS // 4)
        share = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << DRAW_BITS)
        return F.struct((-F.log(share) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node: Column = F.lit("")
    for _ in range(3):
        node = F.array_min(F.transform(F.element_at(table, node), draw))["name"]
    return F.regexp_extract(node, "s([0-9]+)$", 1).cast("int")


def sharded(
    docs: DataFrame, tree: Tree, workspace: Workspace, *, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``.

    The id and the tree alone decide the shard; ``grown_shard`` is the one in the tree grown by a shard. Rows with equal
    ids share a shard, and a null id is placed like an empty one. ``slot`` counts a shard's rows from 0 in the order of
    id and checksum, rows equal in both in any order. ``size`` is the text's UTF-8 length plus 16; a null text has none
    and the checksum of an empty one. Other columns are ignored; an empty table gives no rows.
    """
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    placed = docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, tree.grown()).alias("grown_shard"),
        # Rows equal in all else still get places of their own, so that many of them spread over slices.
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("__row")], workspace)
    return rows.select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("row_number") - 1).cast("long").alias("slot"), "grown_shard"
    )
