"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and cut into overlapping chunks that cover all of it; learned filters run over each chunk,
each filter's largest value over the whole text is kept, and a logistic unit combines them into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pseudospark.llm.training import Sample, labelled_sample, predictions
from pseudospark.llm.words import pieces, text_column

EMBEDDING = 8
#: A chunk is three strides of four bytes; the next one begins a stride later.
STRIDE = 4
SPAN = 3
FILTERS = 16
PADDING = 256
EPOCHS = 12
BATCH = 32
RATE = 0.01
#: Bytes that are convolved at once; longer texts are worked on in parts that overlap by a chunk.
PART_BYTES = 1 << 20


@dataclass
class Network:
    embedding: np.ndarray  # 257 x EMBEDDING
    filters: np.ndarray  # STRIDE * EMBEDDING x SPAN * FILTERS
    bias: np.ndarray
    weight: np.ndarray
    intercept: np.ndarray

    def convolved(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded strides, and each filter's value at each chunk."""
        strides = self.embedding[symbols].reshape(-1, STRIDE * EMBEDDING)
        part = strides @ self.filters
        n = len(strides) - SPAN + 1
        value = part[:n, :FILTERS].copy()
        for k in range(1, SPAN):
            value += part[k : k + n, k * FILTERS : (k + 1) * FILTERS]
        return strides, value

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weight + self.intercept


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts one after another, each filled up to whole strides and one chunk; where each begins, in strides."""
    strides = np.array([max(SPAN, -(-len(t) // STRIDE)) for t in texts])
    begin = np.r_[0, np.cumsum(strides)]
    symbols = np.full(int(begin[-1]) * STRIDE, PADDING, np.uint16)
    for text, at in zip(texts, begin):
        symbols[at * STRIDE : at * STRIDE + len(text)] = text
    return symbols, begin


def _pooled(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    symbols, begin = _padded(texts)
    _, value = network.convolved(symbols)
    bounds = np.column_stack([begin[:-1], begin[1:] - SPAN + 1]).ravel()
    return np.maximum.reduceat(value, bounds[:-1] if bounds[-1] == len(value) else bounds, axis=0)[::2]


def trained(sample: Sample, seed: int = 7) -> Network:
    """A network fitted to a sample by Adam; with fewer than two labels it gives the share of label 1."""
    draw = np.random.default_rng(seed)
    parameters = [
        draw.normal(0, 0.5, (257, EMBEDDING)),
        draw.normal(0, 0.3, (STRIDE * EMBEDDING, SPAN * FILTERS)),
        np.zeros(FILTERS),
        draw.normal(0, 0.1, FILTERS),
        np.zeros(1),
    ]
    parameters = [p.astype(np.float32) for p in parameters]
    network = Network(*parameters)
    texts = [np.frombuffer(t, np.uint8) for t in sample.texts]
    if len(set(sample.labels.tolist())) == 2:
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        step = 0
        for epoch in range(EPOCHS):
            order = draw.permutation(len(texts))
            for first in range(0, len(order), BATCH):
                chosen = order[first : first + BATCH]
                step += 1
                slopes = _slopes(network, [texts[i] for i in chosen], sample.labels[chosen])
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, s, (m, v) in zip(parameters, slopes, moments):
                    m += 0.1 * (s - m)
                    v += 0.001 * (s * s - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    else:
        network.weight[:] = 0
    network.intercept += np.float32(sample.prior_shift)
    return network


def _slopes(network: Network, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    symbols, begin = _padded(texts)
    strides, value = network.convolved(symbols)
    best = np.stack([a + value[a : b - SPAN + 1].argmax(axis=0) for a, b in zip(begin, begin[1:])])
    pooled = np.take_along_axis(value, best, axis=0) + network.bias
    active = np.maximum(pooled, 0)
    odds = active @ network.weight + network.intercept
    error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels)[:, None] / len(texts)
    back = error * network.weight * (pooled > 0)  # texts x filters
    filters, embedding = np.zeros_like(network.filters), np.zeros_like(network.embedding)
    by_byte = symbols.reshape(-1, STRIDE)
    for k in range(SPAN):
        own = network.filters[:, k * FILTERS : (k + 1) * FILTERS]
        filters[:, k * FILTERS : (k + 1) * FILTERS] = np.einsum("tfe,tf->ef", strides[best + k], back)
        spread = back[:, :, None, None] * own.T.reshape(FILTERS, STRIDE, EMBEDDING)[None]
        np.add.at(embedding, by_byte[best + k], spread)
    return [
        embedding + 1e-4 * network.embedding,
        filters + 1e-4 * network.filters,
        back.sum(axis=0),
        (error * active).sum(axis=0) + 1e-3 * network.weight,
        error.sum(keepdims=True)[0],
    ]


def scorer(network: Network, batch: pa.RecordBatch) -> np.ndarray:
    """Log-odds of label 1 for each text of a batch."""
    data, offsets = text_column(batch, "text")
    pooled = np.full((len(batch), FILTERS), -np.inf, np.float32)
    for first, last in pieces(offsets, PART_BYTES):
        if last - first == 1:
            text = data[offsets[first] : offsets[last]]
            for at in range(0, max(1, len(text)), PART_BYTES):
                part = text[at : at + PART_BYTES + (SPAN - 1) * STRIDE]
                pooled[first] = np.maximum(pooled[first], _pooled(network, [part])[0])
        else:
            texts = [data[offsets[k] : offsets[k + 1]] for k in range(first, last)]
            pooled[first:last] = _pooled(network, texts)
    return network.log_odds(pooled)


def quality_scores(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text``).

    The network learns ``labels.quality`` from a bounded sample of rows that are not held out (crc32 of the id as text,
    modulo ``modulus``, is not ``remainder``), and scores every whole text; a null text is empty, and an empty one has
    the score of padding. A null id is not held out. Repeated rows are scored each by itself; other columns are ignored;
    an empty table gives no rows, and labels of fewer than two kinds give every text the share of label 1.
    """
    network = trained(labelled_sample(docs, labels, "quality", modulus=modulus, remainder=remainder))
    return predictions(docs, lambda: partial(scorer, network), modulus=modulus, remainder=remainder)
