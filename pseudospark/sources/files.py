"""Shared-storage paths: the scratch workspace and small file-system helpers."""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Of tables in Parquet. Most of their bytes are digests and random letters, which the default does not make smaller.
COMPRESSION = "zstd"

_FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By session: the number of writers, and the setting they found.
_writers: dict[str, tuple[int, str | None]] = {}
_lock = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables written in the block leave no shuffle files: Spark deletes them at the end of the write, which nothing reads
    them after. Elsewhere they stay until the driver happens to collect its garbage."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        number, before = _writers.get(session) or (0, spark.conf.get(_FREES_SHUFFLES, None))
        _writers[session] = (number + 1, before)
        spark.conf.set(_FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            number, before = _writers.pop(session)
            if number > 1:
                _writers[session] = (number - 1, before)
            elif before is None:
                spark.conf.unset(_FREES_SHUFFLES)
            else:
                spark.conf.set(_FREES_SHUFFLES, before)


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, hadoop_path = _resolve(spark, pattern)
    return sorted(status.getPath().toString() for status in (fs.globStatus(hadoop_path) or []))


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a place that is free; the folder above it is made."""
    fs, source_path = _resolve(spark, source)
    target_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(target_path.getParent())
    if not fs.rename(source_path, target_path):
        raise OSError(f"could not rename {source} to {target}")


def size(spark: SparkSession, pattern: str) -> int:
    """Bytes of all files under the paths that match."""
    fs, hadoop_path = _resolve(spark, pattern)
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in (fs.globStatus(hadoop_path) or []))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written by the driver; the folder above it is made."""
    fs, hadoop_path = _resolve(spark, path)
    out = fs.create(hadoop_path)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


class Workspace:
    """A fresh scratch folder on storage that every executor sees.

    Intermediate tables that a plan reads more than once are written here, which also cuts their lineage: a lost executor
    costs a re-read, never another draw of a random value. The folder lies below ``spark.checkpoint.dir``; a temporary
    folder of this machine serves only where that is unset and Spark runs in local mode.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        base = root or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="pseudospark-")
        self.root = f"{base.rstrip('/')}/pseudospark-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        """A path not handed out before."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as a table scan."""
        path = self.path(name)
        with shuffles_freed(self.spark):
            df.write.parquet(path, compression=COMPRESSION)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self) -> "Workspace":
        """A workspace inside this one, which can be released by itself."""
        return Workspace(self.spark, self.root)

    @contextmanager
    def kept_if_done(self) -> Iterator["Workspace"]:
        """A part for the tables of one result; deleted at once if the block fails."""
        scratch = self.part()
        try:
            yield scratch
        except BaseException:
            scratch.release()
            raise

    def release(self) -> None:
        """Delete this workspace, once nothing reads from it any more."""
        delete(self.spark, self.root)
