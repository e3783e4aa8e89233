"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item, or all words of a shorter item. Of the k-gram hashes in each
window the least is kept as a fingerprint, so two texts that share a window share a fingerprint. A document's
fingerprints are looked up in a bitmap of fixed size that holds those of the benchmark; around each one found, the
document's windows are spelled out and joined with the benchmark's windows by their words, so every hit is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudospark.llm.tables import saved_broadcast
from pseudospark.llm.words import ALPHANUMERIC, Words, find_words, gram_hashes, pieces, text_column
from pseudospark.sources.files import Workspace

WINDOW = 10
GRAM = 5
#: The bitmap of fingerprints has this many bits (8 MB), whatever the benchmark's size; when it fills up, more windows
#: are spelled out in vain, and the result stays the same.
BITMAP_BITS = 26
_CHUNK_BITS = 15  # bits in one chunk of bitmap_construct_agg


def _selected(grams: np.ndarray, text: np.ndarray, words: int) -> np.ndarray:
    """Whether each k-gram is a least one of a window of ``words`` words that lies in one text."""
    span = words - GRAM + 1
    windows = len(grams) - span + 1
    if windows <= 0:
        return np.zeros(len(grams), bool)
    least = grams[:windows].copy()
    for i in range(1, span):
        np.minimum(least, grams[i : i + windows], out=least)
    least[text[:windows] != text[words - 1 : words - 1 + windows]] = 0
    bound = np.zeros(len(grams), np.uint64)
    for i in range(span):
        np.maximum(bound[i : i + windows], least, out=bound[i : i + windows])
    return grams <= bound


def _fingerprints(words: Words, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Window length, places and hashes of fingerprints: winnowed ones of full windows, whole hashes of short ones."""
    grams = gram_hashes(words, GRAM)
    if len(grams):
        place = np.flatnonzero(_selected(grams, words.text, WINDOW))
        yield WINDOW, place, grams[place]
    for length in short:
        whole = gram_hashes(words, length) ^ np.uint64(length)
        place = np.flatnonzero(words.text[: len(whole)] == words.text[length - 1 :]) if len(whole) else whole
        yield length, place, whole[place]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item: digest of its words, windows and fingerprints (as bitmap places). Items without words give none."""
    for batch in batches:
        data, offsets = text_column(batch, "text")
        rows: list[tuple] = []
        for k in range(len(batch)):
            words = find_words(data, offsets[k : k + 2], ALPHANUMERIC)
            n = len(words.hash)
            if not n:
                continue
            length = min(n, WINDOW)
            digest = hashlib.blake2b(words.spelled(0, n), digest_size=16).digest()
            windows = list(dict.fromkeys(words.spelled(i, length) for i in range(n - length + 1)))
            found = [h for size, _, h in _fingerprints(words, [length] if length < WINDOW else []) if size == length]
            bits = np.unique(np.concatenate(found) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            rows.append((batch.column(0)[k].as_py(), digest, length, windows, bits.tolist()))
        columns = list(zip(*rows)) or [()] * 5
        types = [batch.schema.field(0).type, pa.binary(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
        columns[3] = [[w.decode() for w in windows] for windows in columns[3]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "item", "length", "windows", "bits"]
        )


def _document_windows(bitmap, short: list[int]):
    """Of each document: one row with its number of words, and one for each window that may be the benchmark's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            data, offsets = text_column(batch, "text")
            for first, last in pieces(offsets):
                words = find_words(data, offsets[first : last + 1], ALPHANUMERIC)
                count = np.bincount(words.text, minlength=last - first)
                found: dict[tuple[int, bytes], list[int]] = {}
                for length, place, hashes in _fingerprints(words, short):
                    at = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    place = place[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    if length == WINDOW:
                        place = np.unique(place[:, None] - np.arange(WINDOW - GRAM + 1)[None, :])
                        place = place[(place >= 0) & (place + WINDOW <= len(words.hash))]
                        place = place[words.text[place] == words.text[place + WINDOW - 1]]
                    for i in place.tolist():
                        found.setdefault((int(words.text[i]), words.spelled(i, length)), []).append(i)
                begins = np.searchsorted(words.text, np.arange(last - first))
                text = [*range(last - first), *(t for t, _ in found)]
                size = len(text) - (last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first).take(pa.array(text)),
                        batch.column(1).slice(first, last - first).take(pa.array(text)),
                        pa.array([*count.tolist(), *[None] * size], pa.int64()),
                        pa.array([*[None] * (last - first), *(w.decode() for _, w in found)], pa.string()),
                        pa.array(
                            [*[None] * (last - first), *([i - int(begins[t]) for i in at] for (t, _), at in found.items())],
                            pa.list_(pa.int64()),
                        ),
                    ],
                    ["doc_id", "digest", "n_words", "window", "places"],
                )

    return scan


def text_digest(text: Column) -> Column:
    """What tells apart rows with the same id."""
    return F.xxhash64(text)


def contamination(
    docs: DataFrame, benchmark: DataFrame, workspace: Workspace, *, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, digest, n_words, n_hit, item_ids, hit_words`` for each document; ``digest`` is ``text_digest`` of its text.

    Words are lower-cased (A-Z) runs of digits, ASCII letters and characters beyond ASCII. ``item_ids`` are the ids, as
    sorted strings, of the items (``item_id``, ``text``) with a window in the document, ``hit_words`` the sorted places
    of the document's words inside any occurrence of such a window. Null and empty texts have no words and items without
    words no window; an empty benchmark hits nothing. Rows that repeat id and text are one document and come once, a
    null id is an id like another, an item without id hits words but is not listed. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = workspace.save(
        benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(
            _item_windows, "item_id string, item binary, length int, windows array<string>, bits array<long>"
        ),
        "items",
    )
    bits = F.explode("bits").alias("bit")
    chunk = F.expr(f"shiftright(bit, {_CHUNK_BITS})").alias("chunk")
    chunks = items.select(bits).groupBy(chunk).agg(F.expr(f"bitmap_construct_agg(bit & {(1 << _CHUNK_BITS) - 1})").alias("map"))
    bitmap = bytearray(1 << (BITMAP_BITS - 3))
    size = 1 << (_CHUNK_BITS - 3)
    for row in chunks.collect():  # at most 2,048 rows of 4 KB
        bitmap[row.chunk * size : (row.chunk + 1) * size] = row.map
    short = sorted(r.length for r in items.where(F.col("length") < WINDOW).select("length").distinct().collect())

    # Items of the same words are one class, so that a copied item does not multiply hits.
    members = items.select("item", "item_id").where("item_id IS NOT NULL").distinct()
    classes = items.select("item", "length", F.explode("windows").alias("window")).distinct()
    windows = saved_broadcast(
        classes.groupBy("window", "length").agg(F.collect_list("item").alias("items")), workspace, "windows"
    )
    body = F.col(text).cast("string")
    scanned = docs.select(F.col(id).alias("doc_id"), text_digest(body).alias("digest"), body.alias("text")).mapInArrow(
        _document_windows(spark.sparkContext.broadcast(bytes(bitmap)), short),
        f"doc_id {docs.schema[id].dataType.simpleString()}, digest long, n_words long, window string, places array<long>",
    )
    span = F.transform("places", lambda p: F.sequence(p, p + F.col("length") - 1))
    # The row that brings a document's number of words has no window: it gets a key that no window has, and that is no hot
    # one (windows begin with a word).
    own_key = F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest").cast("string"))
    scanned = scanned.withColumn("window", F.coalesce("window", own_key))
    judged = scanned.join(windows, "window", "left").groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("length").isNotNull(), F.flatten(span)))))).alias("hit_words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    judged = workspace.save(judged, "judged")
    listed = (
        judged.select("doc_id", "digest", F.explode("items").alias("item"))
        .join(saved_broadcast(members, workspace, "members"), "item")
        .groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    same = [F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), F.col("d.digest") == F.col("l.digest")]
    return judged.alias("d").join(listed.alias("l"), same[0] & same[1], "left").select(
        "d.doc_id",
        "d.digest",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        "hit_words",
    )
