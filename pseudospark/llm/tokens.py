"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each piece of the model is a vocabulary entry with its bytes mapped to characters of their own, scored by its negative
rank, so that the best-scored merge is the one of the lowest rank; text is taken as it is. Pre-tokens are encoded one by
one. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudospark.llm.words import pieces, text_column

#: Pre-tokens whose ids a task keeps at hand.
CACHED = 150_000
#: Bytes of text that are encoded at once.
GROUP_BYTES = 1 << 20
#: Bytes are shown to sentencepiece as the 256 characters from here on: letters that it treats like any other.
FIRST_CHARACTER = 0x4E00
_TO_CHARACTERS = {b: FIRST_CHARACTER + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model. Fields by number, as its public schema names them:

    model: 1 pieces, 2 trainer, 3 normalizer; piece: 1 text, 2 score, 3 type (1 normal, 2 unknown); trainer: 3 type
    (2 BPE), 4 vocabulary size, 40-43 ids of unknown, begin, end, padding; normalizer: 1 name, 3 dummy prefix,
    4 remove extra white space, 5 escape white space.
    """
    unknown = len(tokens)
    pieces = [
        _bytes(1, _bytes(1, token.decode("latin-1").translate(_TO_CHARACTERS).encode()) + _score(-rank) + _number(3, 1))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + _score(-unknown) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, unknown + 1)
    trainer += _number(40, unknown) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


def _score(value: float) -> bytes:
    return _varint(2 << 3 | 5) + struct.pack("<f", value)


def _narrow(pattern: str):
    """``findall`` of a pattern for texts of the first 256 characters, with its classes spelled out for ``re``, which is
    faster there. None if the pattern has other escapes than letters, numbers and white space."""
    import regex

    if re.sub(r"\\p\{[LN]\}|\\[sS]", "", pattern).count("\\"):
        return None
    every = [chr(i) for i in range(256)]
    classes = {c: "".join(f"\\x{ord(x):02x}" for x in every if regex.fullmatch(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|[^\\]", pattern):
        inside = part == "[" or inside and part != "]"
        out.append(part if part not in classes else classes[part] if inside else f"[{classes[part]}]")
    return re.compile("".join(out)).findall


class ByteBpe:
    """Encoder and decoder over one rank file; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.wide = regex.compile(pattern).findall
        self.narrow = _narrow(pattern) or self.wide
        self.known: dict[str, bytes] = {}
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def _pretokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pretokens = [self._pretokens(text) for text in texts]
        missing = list(set().union(*pretokens).difference(self.known))
        learned = self.known
        if len(self.known) + len(missing) > CACHED:
            # The store is emptied; what these texts need of it is kept until they are done.
            learned = {p: self.known[p] for p in set().union(*pretokens).intersection(self.known)}
            self.known = learned if len(learned) + len(missing) <= CACHED else {}
        if missing:
            mapped = [p.encode().decode("latin-1").translate(_TO_CHARACTERS) for p in missing]
            for pretoken, ids in zip(missing, self.processor.encode(mapped, num_threads=1)):
                learned[pretoken] = struct.pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(learned.__getitem__, p)) for p in pretokens]

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        length = self.length[numbers]
        shift = self.begin[numbers] - (np.cumsum(length) - length)
        return self.bytes[np.repeat(shift, length) + np.arange(int(length.sum()))].tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, *, id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` for each row of ``docs``, in no order.

    Every whole text is cut into matches of ``pattern``, each encoded by the ranks in the file at ``path`` (a file that
    all executors have), without special tokens, and decoded again. The digests are those of the ids as little-endian
    unsigned 32-bit integers and of the decoded bytes. ``ids`` (array of int) is left out unless ``with_ids``. A null
    text is empty and has no tokens. Ids are passed on as they are, nulls and repeats included; other columns are
    ignored. What a pattern leaves unmatched is not encoded.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            data, offsets = text_column(batch, "text")
            for first, last in pieces(offsets, GROUP_BYTES):
                texts = [str(data[offsets[k] : offsets[k + 1]], "utf-8", "replace") for k in range(first, last)]
                packed = bpe.encode(texts)
                columns = [
                    batch.column(0).slice(first, last - first),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        # The worker goes on to other tasks; the model stays, what this task has learned does not.
        bpe.known.clear()

    types = f"doc_id {docs.schema[id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(encode, types + (", ids array<int>" if with_ids else ""))


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """``encodings`` (with ``ids``) with the decoded ``text``; null ids give a null text, unknown ids are an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [
                None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")
                for ids in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    types = ", ".join(f"`{c}` {t}" for c, t in encodings.dtypes)
    return encodings.mapInArrow(decode, f"{types}, decoded string")
