"""From raw documents to token ids: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from contextvars import ContextVar
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudospark.llm import toxicity
from pseudospark.llm.decontamination import contamination, text_digest
from pseudospark.llm.line_dedup import without_repeated_lines
from pseudospark.llm.near_dup import near_duplicates
from pseudospark.llm.tables import free_names, read_table, saved_broadcast
from pseudospark.llm.tokens import encoded
from pseudospark.llm.training import PREDICTED_FROM, labelled_sample, with_scores
from pseudospark.sources.files import Workspace

TOKENIZER = "byte_bpe_50k.tiktoken"

#: Where a stage that ``run`` applies keeps its scratch tables; by itself it takes a workspace of its own.
_SCRATCH: ContextVar[Workspace | None] = ContextVar("scratch", default=None)


def _workspace(spark: SparkSession) -> Workspace:
    return _SCRATCH.get() or Workspace(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold of prediction; null and empty texts stay."""
    sample = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "toxic", modulus=4, remainder=2)
    (score,) = free_names(docs, "score")
    scored = with_scores(docs, partial(toxicity.scorer, toxicity.trained(sample)), score)
    return scored.where(F.col(score) < PREDICTED_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a document of which nothing but blanks is left goes as a whole.

    A column ``n_chars`` is the length of the text that is left.
    """
    count, removed, text = free_names(docs, "line_count", "removed_lines", "deduplicated")
    done = without_repeated_lines(docs, _workspace(spark), names=(count, removed, text))
    left = (F.size(removed) == 0) | (F.trim(F.regexp_replace(text, r"\s+", " ")) != "")
    return done.where(left).select(
        *[
            F.col(text).alias("text")
            if c == "text"
            else F.length(text).cast("long").alias("n_chars")
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates over five-word shingles; of rows that repeat id and text, one.

    Rows that repeat an id with different texts are different documents, each judged by its own text.
    """
    workspace = _workspace(spark)
    named = docs.where("doc_id IS NOT NULL").select("doc_id", text_digest(F.col("text")).alias("digest"))
    repeated = workspace.save(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if repeated.isEmpty():
        judged = near_duplicates(docs, workspace)
        gone = saved_broadcast(judged.where(~F.col("kept")).select("doc_id").distinct(), workspace, "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # Numbers in order of id and text take the place of ids, so that the smallest id still stays.
    order = ["doc_id", "digest"]
    number, of_id, of_digest = free_names(docs, "number", "of_id", "of_digest")
    numbers = named.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = workspace.save(numbers.withColumn(number, F.monotonically_increasing_id()), "numbers")
    numbers = numbers.withColumnsRenamed({"doc_id": of_id, "digest": of_digest})
    same = (F.col("doc_id") == F.col(of_id)) & (text_digest(F.col("text")) == F.col(of_digest))
    numbered = workspace.save(docs.join(numbers, same, "left").drop(of_id, of_digest), "numbered")
    judged = near_duplicates(numbered, workspace, id=number)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias(number)).distinct()
    left = numbered.join(saved_broadcast(gone, workspace, "gone"), number, "left_anti")
    once = left.where(F.col(number).isNotNull()).dropDuplicates([number])
    return once.unionByName(left.where(F.col(number).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words (or a whole shorter item) with the benchmark."""
    workspace = _workspace(spark)
    of_id, of_digest = free_names(docs, "of_id", "of_digest")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"), workspace)
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias(of_id), F.col("digest").alias(of_digest))
    hit = saved_broadcast(hit, workspace, "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (text_digest(F.col("text")) == F.col(of_digest))
    return docs.join(hit, same, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    import public_tokenizers

    return encoded(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL can express neither the learned scores nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, its scratch tables deleted."""
    workspace = Workspace(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        scratch = workspace.part()
        token = _SCRATCH.set(scratch)
        try:
            docs = workspace.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        finally:
            _SCRATCH.reset(token)
            scratch.release()
    return docs
