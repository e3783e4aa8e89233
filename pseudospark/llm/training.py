"""Bounded samples of labelled texts, and what the text scorers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bounds of a training sample: rows of each label, and bytes of a text; longer texts are not learned from.
ROWS_PER_LABEL = 1500
TEXT_BYTES = 32_768
#: A row is predicted to have label 1 from this score on.
PREDICTED_FROM = 0.3


def held_out(id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % modulus == remainder, F.lit(False))


@dataclass
class Sample:
    """Texts with labels 0 and 1, and how many rows of each label there were to draw from."""

    texts: list[bytes]
    labels: np.ndarray
    totals: tuple[int, int]

    @property
    def prior_shift(self) -> float:
        """What is added to log-odds learned on the sample for them to hold for all labelled rows."""
        drawn = [max(1, int((self.labels == v).sum())) for v in (0, 1)]
        return float(np.log((self.totals[1] + 1) / (self.totals[0] + 1)) - np.log(drawn[1] / drawn[0]))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, *, modulus: int, remainder: int, rows_per_label: int = ROWS_PER_LABEL
) -> Sample:
    """At most ``rows_per_label`` texts of each label, chosen by a hash of their id among rows that are not held out.

    An id with several labels has the one that most of its rows have, 1 in a tie; null labels and null ids are left out.
    """
    known = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    )
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    drawn = [known.where(F.col("label") == v).orderBy(order, "doc_id").limit(rows_per_label) for v in (0, 1)]
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .where(F.octet_length("text") <= TEXT_BYTES)
        .join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
        .dropDuplicates(["doc_id"])
        .select("doc_id", "label", "text")
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    return Sample([r.text.encode() for r in rows], np.array([r.label for r in rows], int), (totals.get(0, 0), totals.get(1, 0)))


def with_scores(docs: DataFrame, make_scorer: Callable, column: str) -> DataFrame:
    """``docs`` and one more column: the score of its ``text``, worked out per Arrow batch.

    ``make_scorer`` is called once in a task and gives a function from a batch, with a column ``text``, to scores.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            odds = np.asarray(scorer(batch), float)
            value = pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, column])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def predictions(docs: DataFrame, make_scorer: Callable, *, modulus: int, remainder: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return with_scores(source, make_scorer, "score").select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"),
    )


def fit_logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by Newton's method with an L2 penalty on the weights."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])
