"""Token counts by a digest cache: texts are encoded only if no stored count answers for their digest.

The cache is a folder of Parquet batches, one partition for each tokenizer version (the digest of its file and of the way
its texts are normalised). Counts are joined to documents by digest alone, so texts move only to find one copy of each
text that is not known yet.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudospark.llm.words import pieces, text_column
from pseudospark.operators.resolve import BROADCAST_BYTES, attach, measure
from pseudospark.sources import files
from pseudospark.sources.files import Workspace

#: Bytes of text that are encoded at once.
GROUP_BYTES = 1 << 20
#: Words whose counts a task keeps at hand.
CACHED = 300_000
#: Part of a tokenizer's version: raised when texts are normalised or counted in another way.
METHOD = "1"


def _drops_spaces(settings: dict) -> bool:
    """Whether white space only separates: the tokenizer removes it and joins nothing across it, nor across added tokens."""
    before = settings.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    split = steps[0] if steps else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    # Each way to match must be a plain one that cannot hold white space.
    plain = r"'[a-z]{1,2}|\[\\p\{L\}\]\+?|\[\\p\{N\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+?"
    drops = drops and all(re.fullmatch(plain, way) for way in pattern.split("|"))
    normal = settings.get("normalizer") or {}
    kinds = {n.get("type") for n in normal.get("normalizers", [normal] if normal else [])}
    no_prefix = all(not step.get("add_prefix_space") and not step.get("use_regex") for step in steps[1:])
    added = all(
        not (re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
        for t in settings.get("added_tokens", [])
    )
    return drops and no_prefix and added and kinds <= {"NFC", "Replace", "Lowercase"} and not settings.get("truncation")


class Counts:
    """Numbers of tokens by one tokenizer file: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    def __init__(self, path: str):
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.separable = False
            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self._count = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.separable = _drops_spaces(json.load(file))
        self._count = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[int]:
        """Counts of whole texts, as the library gives them."""
        return self._count(texts) if texts else []

    def of(self, texts: list[bytes]) -> list[int]:
        """Counts of UTF-8 texts. Where white space only separates, words are counted once and their counts summed."""
        if not self.separable:
            return self.whole([t.decode("utf-8", "replace") for t in texts])
        words = [Counter(t.split()) for t in texts]
        missing = list(set().union(*words).difference(self.known))
        if len(self.known) + len(missing) > CACHED:
            self.known = {w: self.known[w] for w in set().union(*words).intersection(self.known)}
        self.known.update(zip(missing, self.whole([w.decode("utf-8", "replace") for w in missing])))
        return [sum(n * self.known[w] for w, n in own.items()) for own in words]


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    return Counts(path)


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the method here."""
    with open(path, "rb") as file:
        return hashlib.sha256(METHOD.encode() + b"\0" + file.read()).hexdigest()


class TokenCache:
    """Stored token counts by text digest, in one folder for all tokenizer versions."""

    def __init__(self, spark, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, version: str) -> DataFrame | None:
        """``digest, n_tokens`` of one tokenizer version, or None if there are none. A digest stands once for each batch
        that stored it; two writers at a time store the same count twice, which reading evens out."""
        batches = files.glob(self.spark, f"{self.path}/version={version}/batch=*/_SUCCESS")
        if not batches:
            return None
        folders = [marker.rsplit("/", 1)[0] for marker in batches]
        stored = self.spark.read.schema("digest string, n_tokens long").parquet(*folders)
        return stored if len(folders) == 1 else stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, version: str, counts: DataFrame, name: str) -> DataFrame:
        """Store a batch under a name of its own; readers see it once it is complete."""
        folder = f"{self.path}/version={version}/batch={name}"
        counts.write.parquet(folder)
        return self.spark.read.schema("digest string, n_tokens long").parquet(folder)


def token_counts(
    docs: DataFrame,
    path: str,
    cache: TokenCache,
    workspace: Workspace,
    *,
    id: str = "doc_id",
    text: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """``doc_id, digest, n_bytes, n_tokens, over_limit`` for each row of ``docs``, in no order.

    ``path`` names a tokenizer file that all executors have: special strings inside texts are handled as its library does
    by default, none are added, nothing is cut. Every whole text is counted; a null one is normalised to the empty text.
    Distinct texts that ``cache`` does not know for this version of the tokenizer are encoded once and appended to it. Ids
    are passed on as they are, nulls and repeats included; other columns are ignored.
    """
    version = tokenizer_version(path)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(id).alias("doc_id"), content.alias("text"))
    digest = F.sha2("text", 256).alias("digest")
    rows = workspace.save(
        texts.select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes")), "digests"
    )
    asked = workspace.save(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "asked")
    known = cache.read(version)
    missing = asked.select("digest")
    if known is not None:
        known = workspace.save(known.join(asked.select("digest"), "digest", "left_semi"), "known")
        missing = workspace.save(missing.join(known, "digest", "left_anti"), "missing")
    counted = _counted(texts.select(digest, "text"), missing, known is not None, path)
    if known is None:
        counts = cache.append(version, counted, workspace.path("batch").rsplit("/", 1)[1])
    elif missing.isEmpty():
        counts = known
    else:
        counts = known.unionByName(cache.append(version, counted, workspace.path("batch").rsplit("/", 1)[1]))
    found, _ = attach(rows, ["digest"], counts, ["digest"], "n_tokens", "n_tokens", asked, measure(counts, "digest"))
    return found.select("doc_id", "digest", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _counted(texts: DataFrame, missing: DataFrame, some_known: bool, path: str) -> DataFrame:
    """``digest, n_tokens`` of one copy of each missing text. Copies are dropped before the shuffle as well as after."""
    few = some_known and measure(missing, "digest") <= BROADCAST_BYTES
    if few:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if some_known and not few:
        texts = texts.join(missing, "digest", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for batch in batches:
            data, offsets = text_column(batch, "text")
            for first, last in pieces(offsets, GROUP_BYTES):
                numbers = counts.of([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(first, last)])
                column = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([column, pa.array(np.array(numbers, np.int64))], ["digest", "n_tokens"])
        counts.known.clear()

    return texts.mapInArrow(count, "digest string, n_tokens long")
