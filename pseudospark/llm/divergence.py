"""How far the vocabulary of each source diverges from that of the other sources of its language.

The counts are a sparse matrix of groups (language and source) by terms. For each term the groups that use it are listed once
(the term-major index). A group's row of results is accumulated as in Gustavson's matrix product: its terms are looked
up in the index, and what each posting adds is scattered into a dense array with one place per peer, so no pair of
postings ever becomes a row. Terms that a group or a peer does not use still count, with their baseline probabilities;
they are summed by distinct counts, and what the scatter replaces is taken off again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pseudospark.llm.words import pieces, text_column
from pseudospark.sources.files import Workspace

SCALE = 1_000_000_000
#: A term is kept in a language if so many of its documents use it.
LEAST_DOCUMENTS = 3
#: Ranks of terms that are reported.
TERM_RANKS = 200
#: Entries that a task counts before it sends them on.
COUNTED = 200_000
#: Least postings of one block of the index; a block has no fewer than the dense rows it fills have places.
BLOCK_POSTINGS = 16_384
#: Places of all dense arrays that one task fills.
PLACES = 4_000_000

#: Words are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term, and documents that use it. Null fields are empty text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                terms = list(n)
                columns = [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([in_docs[t] for t in terms], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = text_column(batch, "text")
            for first, last in pieces(offsets):
                for k in range(first, last):
                    words = data[offsets[k] : offsets[k + 1]].tobytes().translate(_WORDS).split()
                    n, in_docs = held.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                    before = len(n)
                    own = Counter(words)
                    n.update(own)
                    in_docs.update(own.keys())
                    size += len(n) - before
                    if size > COUNTED:
                        yield from flushed()
                        size = 0
        yield from flushed()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / whole) in whole numbers, by long division to the base of 1000."""
    count, whole = np.broadcast_arrays(np.asarray(count, np.int64), np.asarray(whole, np.int64))
    result, rest = count // whole, count % whole
    for _ in range(3):
        rest = rest * 1000
        result, rest = result * 1000 + rest // whole, rest % whole
    return 1 + result


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _probability(count: Column, total: Column, terms: Column) -> Column:
    """As ``scaled``, for columns: exact in decimals."""
    whole = (total + terms).cast("decimal(38,0)")
    return (F.lit(1) + F.floor(_div((count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole))).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


class _Block:
    """Postings of some terms, with the groups of their language: sums over these terms for pairs of groups."""

    def __init__(self, starts: np.ndarray, peers: np.ndarray, counts: np.ndarray, totals: np.ndarray, terms: int):
        self.starts, self.peers, self.totals, self.terms = starts, peers, totals, terms
        self.counts = counts
        self.probability = scaled(counts + 1, totals[peers] + terms)
        self.baseline = scaled(np.ones(len(totals), np.int64), totals + terms)
        # Distinct counts of each peer, with the number of its terms that have them.
        order = np.lexsort((counts, peers))
        p, c = peers[order], counts[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        self.distinct_peer, self.distinct_times = p[first], np.diff(np.append(first, len(p)))
        self.distinct_probability = self.probability[order][first]
        self.used = np.bincount(peers, minlength=len(totals)).astype(np.int64)
        # The group-major side: postings of each group, and the term each belongs to.
        self.term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.by_group = np.argsort(peers, kind="stable")
        self.group_starts = np.searchsorted(peers[self.by_group], np.arange(len(totals) + 1))

    def row(self, group: int) -> np.ndarray:
        """Sums of ``divergence`` over the block's terms between a group and each peer."""
        size, n_terms = len(self.totals), len(self.starts) - 1
        own, base = self.baseline[group], self.baseline
        both_absent = divergence(own, base)
        # As if the group used none of the terms: peers' terms by their distinct counts, all others at both baselines.
        row = (n_terms - self.used) * both_absent
        np.add.at(row, self.distinct_peer, self.distinct_times * divergence(own, self.distinct_probability))
        mine = self.by_group[self.group_starts[group] : self.group_starts[group + 1]]
        if not len(mine):
            return row
        # As if no peer used the group's terms.
        ps, times = np.unique(self.probability[mine], return_counts=True)
        for p, n in zip(ps, times):
            row += n * (divergence(p, base) - both_absent)
        # The scatter: each posting of the group's terms, less what stood for it so far.
        begin, length = self.starts[self.term[mine]], np.diff(self.starts)[self.term[mine]]
        at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        p, peer, q = np.repeat(self.probability[mine], length), self.peers[at], self.probability[at]
        add = divergence(p, q) - divergence(p, base[peer]) - divergence(own, q) + both_absent[peer]
        np.add.at(row, peer, add)
        return row


def _accumulated(key: tuple, groups: pa.Table, index: pa.Table) -> pa.Table:
    """All rows of one (language, range of groups, block of terms)."""
    lang, first, _ = (k.as_py() for k in key)
    order = np.argsort(groups["number"].to_numpy(), kind="stable")
    totals = groups["total"].to_numpy()[order]
    terms, size = groups["terms"][0].as_py(), groups["range_size"][0].as_py()
    postings = index["postings"].combine_chunks()
    flat = postings.flatten()
    starts = np.zeros(len(postings) + 1, np.int64)
    np.cumsum(postings.value_lengths().to_numpy(), out=starts[1:])
    block = _Block(starts, flat.field("number").to_numpy().astype(np.int64), flat.field("n").to_numpy(), totals, terms)
    numbers = range(first * size, min(len(totals), (first + 1) * size))
    rows = [block.row(g) for g in numbers]
    return pa.table(
        {
            "lang": pa.array([lang] * len(rows), pa.string()),
            "number": pa.array(list(numbers), pa.int32()),
            "row": pa.array(rows, pa.list_(pa.int64())),
        }
    )


def source_divergence(docs: DataFrame, workspace: Workspace, *, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``docs``.

    Part ``pair``: the other sources of the language, ``value`` being the sum over its kept terms of floor((p - q)^2 / q), p the
    scaled probability of a term in the group and q in the peer. Part ``term``: the group's terms whose p is above the
    language's q, up to ``term_ranks``. Ranks run from 1 in each group and part, greater values first, ties by item. Null
    lang, source and text are empty text; a group without terms takes part; a language without kept terms has values
    of 0. Other columns are ignored, repeated rows count as documents.
    """
    counts = workspace.save(term_counts(docs), "counts")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    kept = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"),
        F.sum("n").alias("lang_n"),
        F.collect_list(F.struct("source", "n")).alias("postings"),
    )
    kept = workspace.save(kept.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "kept")

    in_lang = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"), F.sum(F.size("postings")).alias("n_postings")
    )
    posting = kept.select("lang", "term", "lang_n", F.explode("postings").alias("p"))
    posting = posting.select("lang", "term", "lang_n", "p.source", "p.n")
    totals = posting.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.lit(0).cast("long")
    groups = (
        named.distinct()
        .join(totals, ["lang", "source"], "left")
        .join(in_lang, "lang", "left")
        .select(
            "lang",
            "source",
            numbered.alias("number"),
            F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_groups"),
            *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total", "n_postings")],
        )
    )
    groups = workspace.save(groups, "groups")
    pairs = _pairs(groups, posting, workspace)
    found = pairs.unionByName(_terms(groups, posting, term_ranks))
    return found.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order))


def _terms(groups: DataFrame, posting: DataFrame, ranks: int) -> DataFrame:
    known = groups.select("lang", "source", "total", "terms", "lang_total")
    p = _probability(F.col("n"), F.col("total"), F.col("terms"))
    q = _probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rows = posting.join(known, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    value = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), value.cast("long").alias("value"))
    return _ranked(rows, "term").where(F.col("rank") <= ranks)


def _pairs(groups: DataFrame, posting: DataFrame, workspace: Workspace) -> DataFrame:
    """Every pair of groups of a language. The index is cut into blocks of terms, and the groups of a language with very
    many sources into ranges, each of which reads all blocks."""
    size = F.greatest(F.lit(1), F.expr(f"{PLACES} div n_groups")).cast("int")
    shaped = groups.select(
        "lang", "source", "number", "total", "terms", size.alias("range_size"),
        F.expr(f"1 + n_postings div greatest({BLOCK_POSTINGS}, n_groups * n_groups)").alias("n_blocks"),
        F.expr(f"(n_groups - 1) div greatest(1, {PLACES} div n_groups)").alias("last_range"),
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_range")))
    members = (
        shaped.where("terms > 0")
        .withColumn("block", blocks)
        .withColumn("range", ranges)
        .select("lang", "range", "block", "number", "total", "terms", "range_size")
    )
    numbers = shaped.select("lang", "source", "number", "n_blocks", "last_range")
    block = F.pmod(F.xxhash64("term"), F.col("n_blocks"))
    index = (
        posting.join(numbers, ["lang", "source"])
        .groupBy("lang", "term", "n_blocks", "last_range")
        .agg(F.collect_list(F.struct("number", "n")).alias("postings"))
        .select("lang", block.alias("block"), ranges.alias("range"), "postings")
    )
    at = ["lang", "range", "block"]
    rows = (
        members.groupBy(*at)
        .cogroup(index.groupBy(*at))
        .applyInArrow(_accumulated, "lang string, number int, row array<long>")
    )
    sums = (
        rows.select("lang", "number", F.posexplode("row").alias("peer", "value"))
        .groupBy("lang", "number", "peer")
        .agg(F.sum("value").alias("value"))
    )
    names = groups.select("lang", "source", "number")
    peers = names.select("lang", F.col("number").alias("peer"), F.col("source").alias("item"))
    # Every pair stands in the result, also those of languages that keep no term.
    pairs = names.join(peers, "lang").where("number <> peer").join(sums, ["lang", "number", "peer"], "left")
    return _ranked(
        pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")), "pair"
    )
