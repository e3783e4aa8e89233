"""MinHash near-duplicates with HyperMinHash registers.

Each text becomes its set of word shingles, hashed to 64 bits. The set's sketch has one 16-bit register per bucket: the
count of leading zeros of the bucket's least hash and the bits after its leading one. Registers, empty ones filled from
others, are cut into bands; texts that share a band are candidates. The sketches' Jaccard estimate, corrected for
registers that agree by chance, keeps candidates apart that are not of one family, and rejects pairs far below the
threshold; every link is confirmed on the full sets. Small sets, whose registers are too few to be independent, share
keys of their least hashes instead: two that are similar always have one in common, and are compared without sketches.

Work on pairs never grows with the square of what shares a band: equal sets are one node; a band's members meet its
smallest node only, which gives families; inside a family, blocks of bounded size are compared, first each by itself
(with the family's smallest node in every block), then those nodes that are not in the family's largest component with
all others. Every pair of a family that is not joined otherwise is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudospark.llm.components import connected_components
from pseudospark.llm.tables import saved_broadcast
from pseudospark.llm.words import SPACED, find_words, gram_hashes, mix, pieces, text_column
from pseudospark.sources.files import Workspace

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
EMPTY = 0xFFFF
BANDS = 40
#: At similarity 0.8 a pair shares none of 40 bands of 5 independent registers with probability 1.3e-7.
BAND_ROWS = 5
#: Estimates are this far off with probability below 1e-4 (four standard deviations at 256 buckets).
MARGIN = 0.1
#: Candidates of a lower estimate are of different families.
FAMILY = 0.4
#: Sets of at most so many shingles meet by exact keys, each of so many hashes.
SMALL = 19
KEY_HASHES = 4
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1_000_000
_FILL_ROUNDS = 64


def shingle_sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than n words, but not none, is one shingle."""
    data, offsets = text_column(batch, "text")
    for first, last in pieces(offsets):
        words = find_words(data, offsets[first : last + 1], SPACED)
        hashes = gram_hashes(words, n)
        whole = words.text[: len(hashes)] == words.text[n - 1 :]
        texts, hashes = words.text[: len(hashes)][whole], hashes[whole]
        ends = np.searchsorted(texts, np.arange(last - first + 1))
        word_ends = np.searchsorted(words.text, np.arange(last - first + 1))
        for k in range(last - first):
            own = hashes[ends[k] : ends[k + 1]]
            if not len(own) and word_ends[k + 1] > word_ends[k]:
                few = words.hash[word_ends[k] : word_ends[k + 1]]
                own = np.zeros(1, np.uint64)
                for h in few:
                    own = mix(own + h)
            yield np.unique(own)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rest = hashes[first] << np.uint64(BUCKET_BITS)
        zeros = np.minimum(53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1], 52).astype(np.uint64)
        mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
        out[bucket[first]] = (zeros << np.uint64(MANTISSA_BITS)) | mantissa
    return out


def _donors() -> np.ndarray:
    place = np.arange(_FILL_ROUNDS * BUCKETS, dtype=np.uint64)
    return (mix(place + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64).reshape(_FILL_ROUNDS, BUCKETS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands (rows: sketches), over registers whose empty buckets are filled from other buckets."""
    filled = sketches.copy()
    empty = sketches == EMPTY
    for donors in _donors():
        if not empty.any():
            break
        lent = sketches[:, donors]
        take = empty & (lent != EMPTY)
        filled[take] = lent[take]
        empty &= ~take
    if empty.any():
        least = sketches.min(axis=1)
        filled[empty] = np.broadcast_to(least[:, None], filled.shape)[empty]
    rows = filled[:, : BANDS * BAND_ROWS].reshape(len(filled), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for i in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return keys


def _least_common(n: int, threshold: float) -> int:
    """Shingles that a set of n has in common with each that is similar to it, at least."""
    return -(-round(100 * threshold) * n // 100)


@lru_cache(maxsize=1000)
def _chosen(prefix: int, length: int) -> np.ndarray:
    return np.array(list(combinations(range(prefix), length)))


def small_keys(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of a small set's sorted hashes, one of which it shares with each small set that is similar to it.

    Similar sets have at least c hashes in common, so the k least of these are among the n - c + k least of either. A key
    is made of k of those hashes: four, or one where the threshold lets sets be similar that have fewer in common.
    """
    n, length = len(hashes), KEY_HASHES if round(100 * threshold) > 75 else 1
    common = _least_common(n, threshold)
    # Below four, sets with so many in common are equal, and one node.
    if n > SMALL or common < length:
        return np.zeros(0, np.uint64)
    chosen = hashes[_chosen(n - common + length, length)]
    keys = np.full(len(chosen), BANDS + 1, np.uint64)
    for i in range(length):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
    return keys


def chance_matches(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of these sizes agree."""
    upper = 2.0 ** -np.arange(40)

    def zeros(n):
        load = np.asarray(n, float)[..., None] / BUCKETS
        return np.exp(-load * upper / 2) - np.exp(-load * upper)

    return (zeros(na) * zeros(nb)).sum(axis=-1) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (last axis: registers), corrected for agreement by chance."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=-1)
    chance = chance_matches(na, nb)
    return (equal / np.maximum(used, 1) - chance) / (1 - chance)


def _sketch_columns(n: int, threshold: float):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches, keys = [], [], [], []
            for hashes in shingle_sets(batch, n):
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                sketches.append(registers(hashes).tobytes() if len(hashes) else None)
                keys.append(small_keys(hashes, threshold).tobytes() if 0 < len(hashes) <= SMALL else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sketches, pa.binary()),
                    pa.array(keys, pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sketch", "keys"],
            )

    return sketch


def _bands(threshold: float):
    """Bands of the sets that may be similar to one above the small ones, and exact keys of the small sets."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _least_common(SMALL + 1, threshold)
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                nodes = part.column(0).to_numpy()
                large = np.flatnonzero(part.column(1).to_numpy() >= least)
                packed = part.column(2).take(pa.array(large)).to_pylist()
                sketches = np.frombuffer(b"".join(packed), np.uint16).reshape(-1, BUCKETS)
                banded = band_keys(sketches).view(np.int64).ravel()
                small = [np.frombuffer(k or b"", np.int64) for k in part.column(3).to_pylist()]
                found = np.concatenate([banded, *small])
                node = np.r_[np.repeat(nodes[large], BANDS), np.repeat(nodes, [len(k) for k in small])]
                exact = np.arange(len(found)) >= len(banded)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(node), pa.array(exact)], ["band", "node", "exact"])

    return bands


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        a, b = (
            np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            for c in ("sketch_a", "sketch_b")
        )
        na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_a", "n_b"))
        parts = [slice(i, i + 1024) for i in range(0, len(batch), 1024)]
        value = np.concatenate([estimate(a[s], b[s], na[s], nb[s]) for s in parts])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(value)], ["a", "b", "estimate"]
        )


class _Block:
    """Nodes of one block with sketches and, where links are to be confirmed, full sets; finds a spanning forest."""

    def __init__(self, nodes, labels, sizes, sketches, sets, threshold: float):
        self.nodes, self.sets, self.threshold = nodes, sets, threshold
        self.size = np.array(sizes)
        self.sketch = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, BUCKETS)
        #: Hashes of the small sets, filled up by values that agree with nothing; none without full sets.
        self.few = None if sets is None else self._few()
        first: dict[int, int] = {}
        self.parent = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def _few(self) -> np.ndarray:
        own = np.flatnonzero(self.size <= SMALL)
        self.small = self.size <= SMALL
        self.row = np.cumsum(self.small) - 1
        few = np.zeros((len(own), SMALL), np.uint64)
        for k, i in enumerate(own):
            few[k, : len(self.sets[i])] = self.sets[i]
        return few

    def exact(self, part: np.ndarray, close: np.ndarray) -> None:
        """Put the true similarity in place of the estimate for pairs of small sets."""
        rows, columns = np.flatnonzero(self.small[part]), np.flatnonzero(self.small)
        if not len(rows):
            return
        a = self.few[self.row[part[rows]]]
        common = np.zeros((len(rows), len(columns)), np.int64)
        for k in range(SMALL):
            one = a[:, k][:, None, None]
            common += ((self.few[None] == one) & (one != 0)).any(axis=2)
        sizes = self.size[part[rows]][:, None] + self.size[columns][None, :]
        close[np.ix_(rows, columns)] = common / (sizes - common)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def similar(self, i: int, j: int) -> bool:
        if self.sets is None:
            return True
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        place = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[place] == a).sum())
        return 100 * common >= round(100 * self.threshold) * (len(a) + len(b) - common)

    def links(self, role: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that join nodes of role 1 with each other and with the rest, as far as nothing else joins them."""
        columns = np.arange(len(role))
        rows = np.flatnonzero(role == 1)
        floor = self.threshold if self.sets is None else self.threshold - MARGIN
        for first in range(0, len(rows), 16):
            part = rows[first : first + 16]
            close = estimate(
                self.sketch[part][:, None, :], self.sketch[columns][None, :, :],
                self.size[part][:, None], self.size[columns][None, :],
            )
            if self.sets is not None:
                self.exact(part, close)
                least = np.minimum(self.size[part][:, None], self.size[columns][None, :])
                most = np.maximum(self.size[part][:, None], self.size[columns][None, :])
                close[least < (self.threshold - 1e-9) * most] = -1
            close[(role[columns] == 1)[None, :] & (columns[None, :] <= part[:, None])] = -1
            at, other = np.nonzero(close >= floor)
            for k in np.argsort(-close[at, other], kind="stable"):
                i, j = int(part[at[k]]), int(columns[other[k]])
                a, b = self.root(i), self.root(j)
                if a != b and self.similar(i, j):
                    self.parent[a] = b
                    yield int(self.nodes[i]), int(self.nodes[j])


KEYS = ("family", "block", "part")


def _block_links(threshold: float):
    """Links inside runs of rows with equal keys."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work() -> pa.RecordBatch:
            role, node, label, size, sketch, packed = list(zip(*held))[len(KEYS) :]
            sets = None if packed[0] is None else [np.frombuffer(p, np.uint64) for p in packed]
            block = _Block(np.array(node), label, size, sketch, sets, threshold)
            found = list(block.links(np.array(role)))
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[0][: len(KEYS)] != row[: len(KEYS)]:
                    if len(held) > 1:
                        yield work()
                    held.clear()
                held.append(row)
        if len(held) > 1:
            yield work()

    return link


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Links among the rows of each block: role 1 with all, the others only with those."""
    return (
        rows.select(*KEYS, "role", "node", "label", "n", "sketch", "hashes")
        .repartition(*KEYS)
        .sortWithinPartitions(*KEYS, "node")
        .mapInArrow(_block_links(threshold), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, workspace: Workspace, *, shingle: int = 5, threshold: float = 0.8, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts with a Jaccard similarity of ``threshold`` or more (to two decimal places) over their distinct shingles of
    ``shingle`` words are linked; a component is named by the smallest id in it and keeps that row. Words are lower-cased
    (A-Z) runs without ASCII white space. A text of fewer words than a shingle is one shingle; null texts and texts
    without words have none and are linked with nothing. Rows that repeat an id carry one document: they share a
    component if they lead classes of equal sets, and all rows with the component's id are kept. A row without id takes
    no part: its component is null and it is kept. Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketched = workspace.save(
        source.mapInArrow(
            _sketch_columns(shingle, threshold), "doc_id long, n_shingles long, digest binary, sketch binary, keys binary"
        ),
        "sketches",
    )
    nodes = workspace.save(
        sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")),
        "nodes",
    )
    families = _families(nodes, workspace, threshold).join(nodes.select("node", "n"), "node")
    links = _links(source, families, workspace, shingle, threshold)
    component = connected_components(links, workspace) if links is not None else None

    classes = nodes.select("digest", "node")
    if component is not None:
        classes = classes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        classes = classes.withColumn("component", F.col("node"))
    classes = workspace.save(classes.select("digest", "component"), "classes")
    # Rows without a set have no digest and meet nothing; a salted stand-in keeps them apart.
    rows = sketched.select("doc_id", "n_shingles", "digest")
    with_set = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").join(classes, "digest")
    alone = rows.where("digest IS NULL OR doc_id IS NULL").withColumn("component", F.col("doc_id"))
    return (
        with_set.select("doc_id", "n_shingles", "component")
        .unionByName(alone.select("doc_id", "n_shingles", "component"))
        .select(
            "doc_id",
            "n_shingles",
            F.col("component").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
        )
    )


def _families(nodes: DataFrame, workspace: Workspace, threshold: float) -> DataFrame:
    """``node, component`` of nodes that share bands with others, directly or over others, and look alike.

    A band's members are held against its smallest node; those that differ from it are then compared in blocks. Small
    sets that share an exact key are one family whatever their estimates.
    """
    sketches = nodes.select("node", "n", "sketch")
    bands = nodes.select("node", "n", "sketch", "keys").mapInArrow(_bands(threshold), "band long, node long, exact boolean")
    shared = bands.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last")
    shared = workspace.save(shared.select("band", "center"), "shared")
    members = workspace.save(bands.join(shared, "band").where("node <> center"), "members")
    kin = members.where("exact").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    members = members.where(~F.col("exact"))
    pairs = workspace.save(members.select(F.col("node").alias("a"), F.col("center").alias("b")).distinct(), "pairs")
    half = pairs.join(
        sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b"
    )
    judged = (
        workspace.save(half, "pairs")
        .join(sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
        .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        .mapInArrow(_estimates, "a long, b long, estimate double")
    )
    judged = workspace.save(judged.groupBy("a", "b").agg(F.max("estimate").alias("estimate")), "judged")
    near = judged.where(F.col("estimate") >= FAMILY).select("a", "b")
    far = judged.where(F.col("estimate") < FAMILY).select(F.col("a").alias("node"), F.col("b").alias("center"))
    rest = workspace.save(members.join(far, ["node", "center"]).select("band", "node"), "rest")
    sizes = rest.groupBy("band").agg(_blocks(F.count(F.lit(1)), F.lit(0)).alias("blocks"), F.count(F.lit(1)).alias("size"))
    sizes = saved_broadcast(sizes.where("size > 1").drop("size"), workspace, "sizes")
    own = F.pmod(F.hash("node"), "blocks")
    pairs = (
        rest.join(sizes, "band")
        .select("node", F.col("band").alias("family"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", "family", F.least("own", "other").alias("block"), F.greatest("own", "other").alias("part"), "own")
        .withColumn("role", (F.col("own") == F.col("block")).cast("int"))
    )
    pairs = workspace.save(pairs, "rest_pairs").join(sketches, "node")
    rows = pairs.withColumns({"label": F.col("node"), "hashes": F.lit(None).cast("binary")})
    near = near.unionByName(kin)
    return connected_components(near.unionByName(workspace.save(_compared(rows, FAMILY), "alike")), workspace)


def _with_sets(source: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """``places`` (node and its keys) with the node's sketch and set, made from its text again."""
    keys = [c for c in places.columns if c != "node"]
    found = source.withColumnRenamed("doc_id", "node").join(places, "node").select("node", *keys, "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(shingle_sets(batch, shingle))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([registers(s).tobytes() for s in made], pa.binary()),
                    pa.array([s.tobytes() for s in made], pa.binary()),
                ],
                [*batch.schema.names[:-1], "sketch", "hashes"],
            )

    types = ", ".join(f"{c} {t}" for c, t in found.drop("text").dtypes)
    return found.mapInArrow(sets, f"{types}, sketch binary, hashes binary").where("length(hashes) > 0")


def _blocks(nodes: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(F.lit(1.0), nodes / BLOCK_NODES, shingles / BLOCK_SHINGLES)).cast("int")


def _links(source: DataFrame, families: DataFrame, workspace: Workspace, shingle: int, threshold: float) -> DataFrame | None:
    """Confirmed links that join up each component, or None if there are no families."""
    families = workspace.save(families, "families")
    if families.isEmpty():
        return None
    sizes = families.groupBy("component").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    sizes = saved_broadcast(sizes, workspace, "sizes")
    located = workspace.save(
        families.join(sizes, "component").select(
            "node", "n", F.col("component").alias("family"), "blocks", F.pmod(F.hash("node"), "blocks").alias("own")
        ),
        "located",
    )
    places = located.select(
        "node",
        "n",
        "family",
        F.explode(
            F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
        ).alias("block"),
    )
    places = saved_broadcast(places, workspace, "places")
    rows = _with_sets(source, places, shingle).withColumns(
        {"part": F.lit(0), "role": F.lit(1), "label": F.col("node")}
    )
    links = workspace.save(_compared(rows, threshold), "links")

    wide = located.where("blocks > 1")
    if wide.isEmpty():
        return links
    joined = connected_components(links, workspace)
    labelled = workspace.save(
        wide.join(joined, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled"
    )
    counts = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    whole = counts.groupBy("family").agg(
        F.max_by("label", F.struct("rows", "label")).alias("main"),
        (F.sum("rows") - F.max("rows")).alias("rest"),
        _blocks(F.sum("rows") - F.max("rows"), F.sum("n") - F.max("n")).alias("parts"),
    )
    whole = saved_broadcast(whole.where("rest > 0"), workspace, "open")
    still = labelled.join(whole, "family")
    rest = still.where(F.col("label") != F.col("main"))
    first = still.select(
        "node", "n", "family", "label", F.col("own").alias("block"), F.lit(0).alias("role"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    second = rest.select(
        "node", "n", "family", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("role"), F.pmod(F.hash("node", F.lit(1)), "parts").alias("part"),
    )
    places = workspace.save(first.unionByName(second), "places")
    return links.unionByName(workspace.save(_compared(_with_sets(source, places, shingle), threshold), "links"))
