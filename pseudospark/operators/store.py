"""The mapping store: (namespace, original value) -> pseudonym, first writer wins.

A store is a folder of Parquet batches, ``generation=G.N/batch_id=B/namespace_name=X``, whose files are cut into N buckets by
a hash of the key, and once more below ``reverse/``, cut by a hash of the pseudonym. Few keys read the files of their own
buckets only; many are joined bucket by bucket, so that the requests are shuffled and the store is not. A batch is
written to a staging folder, checked there, and then moved to its places, the reverse one first, so neither readers nor
streams ever see an unfinished one. Readers take the newest generation; compaction starts a new one. One writer per
store at a time: plain Parquet has no unique constraint.
"""

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pseudospark.functions.generators import GENERATORS, fixed_length, generate, with_affixes
from pseudospark.functions.text import is_blank, packed, unpacked
from pseudospark.operators.resolve import BROADCAST_BYTES, broadcast_if_small, text_bytes
from pseudospark.schemas import PSEUDONYM_COLUMNS, PSEUDONYM_SCHEMA
from pseudospark.sources import files
from pseudospark.sources.files import Workspace

KEYS = ["namespace_name", "original_value"]
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
BUCKETS = 8
#: A batch of so many keys is written by one task; larger ones are dealt to tasks by bucket.
ONE_TASK_ROWS = 20_000
#: Rows of so many bytes each are written to their buckets by the tasks that read them, where buckets are few: to deal them
#: would move and store whole texts twice more, and spare some files.
WIDE_ROW_BYTES = 512
FEW_BUCKETS = 64
#: A task that writes dealt rows sorts about so many bytes. Of each row, so many come to its measured keys.
TASK_BYTES = 128 * 1024 * 1024
ADDED_BYTES = 128
#: Compaction cuts the store into batches of about so many rows, by time.
SLICE_ROWS = 50_000_000
MOST_SLICES = 64
#: A catalogue of so many namespaces is kept on the driver, so that it is read once; of so many it is part of the plan.
LOCAL_NAMESPACES = 2_000
INLINE_NAMESPACES = 32


@dataclass(frozen=True)
class Layout:
    """One of the two ways in which a store's rows are cut into buckets."""

    folder: str
    keys: tuple[str, str]
    hash: str

    def hashed(self) -> Column:
        return F.xxhash64(*self.keys)

    def bucket(self, buckets: int) -> Column:
        """The bucket that Spark writes a row to."""
        return F.pmod(F.hash(self.hashed()), F.lit(buckets))


BY_KEY = Layout("", ("namespace_name", "original_value"), "key_hash")
BY_PSEUDONYM = Layout("reverse/", ("namespace_name", "pseudonym_value"), "pseudonym_hash")


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per (namespace, value), with the number of times it was asked for.

    Partial aggregation collapses repeated values before the shuffle, so a value in a third of all rows costs one row per
    task.
    """
    return requests.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def pick_misses(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Requested keys that have no mapping yet."""
    return requests.join(hits.select(*KEYS), KEYS, "left_anti")


def first_reverse(mappings: DataFrame, *also: str) -> DataFrame:
    """One row per (namespace, pseudonym): the earliest original, smallest first among equals.

    Pseudonyms are not unique, and joining on them directly would multiply rows.
    """
    return (
        mappings.groupBy(*also, "namespace_name", "pseudonym_value")
        .agg(F.min(F.struct("created_at", "original_value")).alias("first"))
        .select(
            "namespace_name",
            "pseudonym_value",
            F.col("first.original_value").alias("original_value"),
            F.col("first.created_at").alias("created_at"),
        )
    )


def observed(seen: Observation) -> dict:
    """What an observation saw while its table was written; nothing if there was nothing to do."""
    return {name: value for name, value in seen.get.items() if value is not None}


@dataclass(frozen=True)
class Buckets:
    """The buckets that some keys fall into, gathered by an aggregate of bits while the keys are written."""

    layout: Layout
    number: int

    def metrics(self) -> list[Column]:
        bucket = self.layout.bucket(self.number)
        words = range((self.number + 63) // 64)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (bucket % 64).cast("int"))
        return [F.bit_or(F.when(F.floor(bucket / 64) == w, bit)).alias(f"buckets{w}") for w in words]

    def wanted(self, stats: dict) -> list[int]:
        masks = [stats.get(f"buckets{w}", 0) for w in range((self.number + 63) // 64)]
        return [b for b in range(self.number) if masks[b // 64] >> (b % 64) & 1]


@dataclass(frozen=True)
class Batch:
    """A published batch and the times of its rows, in microseconds."""

    folder: str
    least: int | None
    greatest: int | None


@dataclass(frozen=True)
class Upserted:
    """Every requested key with its pseudonym; ``is_new`` tells the ones this call stored.

    ``cells`` counts the requests, repeated ones each time, and ``missing`` those among them without a value. ``sizes`` has the
    measured bytes of the mappings of each namespace that the caller named (and of all, under None), ``unlike`` those of them
    where a stored pseudonym is not the computed one (and None if one computed by row is not).
    """

    mappings: DataFrame
    requested: int
    created: int
    cells: int
    missing: int
    scratch: Workspace
    sizes: dict[str | None, int] = field(default_factory=dict)
    unlike: frozenset[str | None] = frozenset()

    def release(self) -> None:
        """Delete the intermediate tables, once nothing reads ``mappings`` any more."""
        self.scratch.release()


@dataclass(frozen=True)
class Requests:
    """Distinct requests, stored, with what has to be known about them before anything is written.

    A null value stands for the cells that have none; it gets no pseudonym.
    """

    table: DataFrame
    stats: dict
    buckets: list[int]

    @property
    def keys(self) -> int:
        return self.stats.get("keys", 0)

    @property
    def cells(self) -> int:
        return self.stats.get("cells", 0)

    @property
    def missing(self) -> int:
        return self.stats.get("missing", 0)

    @property
    def bytes(self) -> int:
        return self.stats.get("bytes", 0)

    @property
    def methods(self) -> list[str]:
        named = [name for name in GENERATORS if self.stats.get(f"method {name}")]
        return named + ([self.stats["other method"]] if "other method" in self.stats else [])

    def check(self) -> None:
        """Names may come from the data, so they are counted, not printed."""
        if self.stats.get("blank"):
            raise ValueError("Blank values get no pseudonym.")
        if self.stats.get("unknown"):
            raise ValueError(f"{self.stats['unknown']} values are in namespaces that do not exist.")
        if self.stats.get("bad_length"):
            raise ValueError(
                f"{self.stats['bad_length']} values are in namespaces with a length their method does not allow."
            )


class MappingStore:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        workspace: Workspace | None = None,
        broadcast_bytes: int = BROADCAST_BYTES,
        buckets: int = BUCKETS,
    ):
        """``buckets`` holds for a new store; ``compact`` changes it. A bucket of a layout should fit a task's memory."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.workspace = workspace or Workspace(spark)
        self.broadcast_bytes = broadcast_bytes
        self.buckets = buckets
        self._known_settings: tuple[DataFrame, DataFrame, list[dict] | None] | None = None

    # -- files -------------------------------------------------------------------------------------------------------

    def _committed(self) -> list[str]:
        """Batch folders of the newest generation that has any."""
        markers = files.glob(self.spark, f"{self.path}/generation=*/batch_id=*/_SUCCESS")
        folders = [m.rsplit("/", 1)[0] for m in markers]
        newest = max((f.rsplit("/", 2)[1] for f in folders), default=None)
        return [f for f in folders if f.rsplit("/", 2)[1] == newest]

    def _generation(self, folders: list[str] | None = None) -> str:
        """Name of the newest generation, ``generation=G.N``."""
        folders = self._committed() if folders is None else folders
        return folders[0].rsplit("/", 2)[1] if folders else f"generation=000000.{self.buckets}"

    def _in(self, layout: Layout, folder: str) -> str:
        """Where a batch of the store lies in a layout."""
        return f"{self.path}/{layout.folder}" + "/".join(folder.rsplit("/", 2)[1:])

    def _free(self, batch_id: str) -> str:
        """A batch folder that is not taken. What a batch holds of earlier ones is left out before, by key."""
        folder = f"{self.path}/{self._generation()}/batch_id={quote(batch_id, safe='')}"
        return folder if not files.exists(self.spark, f"{folder}/_SUCCESS") else f"{folder}-{uuid.uuid4().hex}"

    def _save(self, rows: DataFrame, layout: Layout, folder: str, buckets: int) -> None:
        """Write rows that carry the layout's hash as one file for each task, namespace and bucket."""
        name = _table_name()
        writer = (
            rows.write.partitionBy("namespace_name")
            .bucketBy(buckets, layout.hash)
            .sortBy(layout.hash)
            .option(f"parquet.bloom.filter.enabled#{layout.keys[1]}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("compression", files.COMPRESSION)
            .option("path", folder)
        )
        with files.shuffles_freed(self.spark):
            writer.saveAsTable(name)
        # Spark writes buckets by way of a table. Dropping it leaves the files.
        self.spark.sql(f"DROP TABLE {name}")

    def _stage(
        self,
        rows: DataFrame | None,
        staged: str,
        place: str,
        buckets: int,
        drawn: list[tuple[DataFrame, Callable[[DataFrame], DataFrame]]] | None = None,
        expected: int | None = None,
        namespaces: list[str] | None = None,
        counted: list[str] | None = None,
        placed: bool = False,
        size: int = 0,
        follows: Column | None = None,
    ) -> dict:
        """Write one batch in both layouts below ``staged``; returns what was seen of its stored rows.

        ``namespaces`` are measured and ``counted`` are counted by themselves. ``placed`` rows lie in tasks by their key's hash
        already. ``size`` is the measured size of the keys of ``expected`` rows.

        The first layout's tasks draw the pseudonyms; the second is made of the rows as they are stored. Tasks get rows by
        their hash, so that each writes few buckets, and a large bucket is split over several tasks; wide rows stay where
        they are. ``drawn`` has the keys of each kind of rows, which are dealt by themselves, and what adds the rest to dealt
        ones. ``follows`` is the pseudonym of all rows as it follows from their keys, where unlike keys have unlike ones: then
        the second layout's rows are dealt as keys as well.
        """
        few = expected is not None and expected <= ONE_TASK_ROWS
        wide = bool(expected) and size >= expected * WIDE_ROW_BYTES and buckets <= FEW_BUCKETS

        def by_hash(keys: DataFrame, hashed: Column) -> DataFrame:
            """Rows of unlike hashes need no rebalance, which goes by the bytes that are moved, not by what they become."""
            return keys.repartition(self._tasks(expected, size, buckets), hashed)

        def dealt(frame: DataFrame, layout: Layout) -> DataFrame:
            hashed = frame.withColumn(layout.hash, layout.hashed())
            if few:
                return hashed.coalesce(1)
            if wide:
                return hashed
            if "pseudonym_value" not in frame.columns:
                return by_hash(frame, layout.hashed()).withColumn(layout.hash, layout.hashed())
            small = hashed.withColumn("pseudonym_value", packed(F.col("pseudonym_value")))
            spread = small.hint("rebalance", F.col(layout.hash))
            return spread.withColumn("pseudonym_value", unpacked(F.col("pseudonym_value")))

        if placed:
            mappings = rows.withColumn(BY_KEY.hash, BY_KEY.hashed())
        elif drawn is None:
            mappings = dealt(rows, BY_KEY)
        else:
            mappings = reduce(DataFrame.unionByName, [complete(dealt(keys, BY_KEY)) for keys, complete in drawn])
        first = f"{staged}/{BY_KEY.folder}{place}"
        self._save(mappings.select(BY_KEY.hash, *PSEUDONYM_COLUMNS), BY_KEY, first, buckets)
        stored = self.spark.read.schema(PSEUDONYM_SCHEMA).option("basePath", first).parquet(first)
        seen = Observation()
        metrics = [
            F.count(F.lit(1)).alias("rows"),
            F.unix_micros(F.min("created_at")).alias("least"),
            F.unix_micros(F.max("created_at")).alias("greatest"),
            *size_metrics(namespaces),
            *[F.count(F.when(F.col("namespace_name") == n, 1)).alias(f"rows{i}") for i, n in enumerate(counted or [])],
        ]
        if follows is None or few or wide:
            reverse = dealt(stored, BY_PSEUDONYM)
        else:
            complete = drawn[0][1]
            reverse = complete(by_hash(stored.select(*KEYS), F.xxhash64(KEYS[0], follows)))
            reverse = reverse.withColumn(BY_PSEUDONYM.hash, BY_PSEUDONYM.hashed())
        reverse = reverse.select(BY_PSEUDONYM.hash, *PSEUDONYM_COLUMNS).observe(seen, *metrics)
        self._save(reverse, BY_PSEUDONYM, f"{staged}/{BY_PSEUDONYM.folder}{place}", buckets)
        stats = observed(seen)
        if expected is not None and stats.get("rows", 0) != expected:
            raise RuntimeError(f"{expected} keys were missing but {stats.get('rows', 0)} were stored.")
        times = f"{stats.get('least', '')}.{stats.get('greatest', '')}"
        files.write_text(self.spark, f"{staged}/{BY_PSEUDONYM.folder}{place}/_times.{times}", "")
        return stats

    def _tasks(self, rows: int, size: int, buckets: int) -> int:
        """Into how many tasks rows are dealt by hash, so that each has rows of one bucket, or all rows of some buckets (where
        their number can be shared out)."""
        least = min(self.spark.sparkContext.defaultParallelism, -(-rows // ONE_TASK_ROWS))
        tasks = max(least, -(-(size + rows * ADDED_BYTES) // TASK_BYTES))
        if tasks >= buckets:
            return -(-tasks // buckets) * buckets
        shares = next(n for n in range(tasks, buckets + 1) if buckets % n == 0)
        return shares if shares <= 4 * tasks else tasks

    def _write(self, folder: str, rows: DataFrame | None, counted: list[str] | None = None, **options) -> dict:
        """Stage one batch and publish it. ``counted`` names all its namespaces, where they are few and known."""
        place = "/".join(folder.rsplit("/", 2)[1:])
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        try:
            stats = self._stage(rows, staged, place, _bucket_number(place), counted=counted, **options)
            if counted is not None:
                self._change({n: stats.get(f"rows{i}", 0) for i, n in enumerate(counted)}, place)
            else:
                stored = self.spark.read.schema(PSEUDONYM_SCHEMA).parquet(f"{staged}/{BY_KEY.folder}{place}")
                self._change(_counts(stored), place)
            self._move(staged, place)
        finally:
            files.delete(self.spark, staged)
        self._announce()
        return stats

    def _move(self, staged: str, place: str) -> None:
        """Publish what is staged; readers go by the first layout, which is moved last."""
        for layout in (BY_PSEUDONYM, BY_KEY):
            target = f"{self.path}/{layout.folder}{place}"
            if files.exists(self.spark, target):  # left by a writer that did not finish
                files.delete(self.spark, target)
            files.rename(self.spark, f"{staged}/{layout.folder}{place}", target)

    def _change(self, counts: "DataFrame | dict[str, int]", place: str) -> None:
        """Write down by how many rows each namespace will have changed once ``place`` is published (or deleted)."""
        path = f"{self.path}/_staged/changes/{quote(place, safe='')}"
        if place.startswith("deleted/") and files.exists(self.spark, path):
            return  # a deletion that was stopped before it was through knows what there was
        files.delete(self.spark, path)
        if isinstance(counts, dict):
            lines = [json.dumps({"namespace_name": name, "n": n}) + "\n" for name, n in counts.items() if n]
            files.write_text(self.spark, f"{path}/change.json", "".join(lines))
        else:
            counts.where("n <> 0").write.json(path)

    def _announce(self) -> None:
        """Move the changes that came true to where streams see them, also those of a writer that was stopped before it
        could; forget those of batches that never came."""
        for staged in files.glob(self.spark, f"{self.path}/_staged/changes/*"):
            place = unquote(staged.rsplit("/", 1)[1])
            target = f"{self.path}/changes/{uuid.uuid4().hex}"
            if place.startswith("deleted/"):
                done = not files.glob(self.spark, f"{self.path}/{place.removeprefix('deleted/')}")
            else:
                done = files.exists(self.spark, f"{self.path}/{place}")
            if done:
                files.rename(self.spark, staged, target)
            elif not place.startswith("deleted/"):
                files.delete(self.spark, staged)

    # -- reading -----------------------------------------------------------------------------------------------------

    def read(self, namespaces: list[str] | None = None) -> DataFrame:
        """All mappings, or those of some namespaces (pruned by partition)."""
        return _of(self._scan(self._committed()).select(*PSEUDONYM_COLUMNS), namespaces)

    def read_batches(self, batches: list[Batch], namespace: str) -> DataFrame:
        """One namespace's mappings of some batches."""
        return _of(self._scan([b.folder for b in batches]).select(*PSEUDONYM_COLUMNS), [namespace])

    def batches(self, namespace: str | None = None) -> list[Batch]:
        """The published batches (that hold a namespace) with the times of their rows, newest first."""
        folders = self._committed()
        if not folders:
            return []
        generation = self._generation(folders)
        if namespace is not None:
            own = f"{self.path}/{generation}/batch_id=*/namespace_name={self._escaped(namespace)}"
            holding = {f.rsplit("/", 2)[1] for f in files.glob(self.spark, own)}
            folders = [f for f in folders if f.rsplit("/", 1)[1] in holding]
        marks = files.glob(self.spark, f"{self.path}/{BY_PSEUDONYM.folder}{generation}/batch_id=*/_times.*")
        times = {m.rsplit("/", 2)[1]: [int(t) if t else None for t in m.rsplit(".", 2)[1:]] for m in marks}
        found = [Batch(f, *times[f.rsplit("/", 1)[1]]) for f in folders]
        return sorted(found, key=lambda b: (b.greatest is not None, b.greatest), reverse=True)

    def stream(self) -> DataFrame:
        """New mappings as they are committed. Start the query again after a compaction."""
        generation = f"{self.path}/{self._generation()}"
        return self.spark.readStream.schema(PSEUDONYM_SCHEMA).parquet(generation).select(*PSEUDONYM_COLUMNS)

    def changes(self) -> DataFrame:
        """A stream of changes in the number of stored rows, ``namespace_name, n``: batches, deletions and compactions.

        Their sums since the store began are its counts, so nobody has to list it.
        """
        files.write_text(self.spark, f"{self.path}/changes/opened.json", "")
        schema = "namespace_name string, n long"
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", True).json(f"{self.path}/changes")

    def _scan(self, folders: list[str], layout: Layout = BY_KEY, wanted: list[int] | None = None) -> DataFrame:
        """The rows of some batches, or of some of their buckets, which are told by the files' names."""
        if not folders:
            return self.spark.createDataFrame([], PSEUDONYM_SCHEMA)
        places = [self._in(layout, f) for f in folders]
        # The schema is given, so a namespace called "001" stays text.
        reader = self.spark.read.schema(PSEUDONYM_SCHEMA).option("basePath", places[0].rsplit("/", 1)[0])
        if wanted is not None and len(wanted) < _bucket_number(folders[0]):
            names = ",".join(f"{b:05d}" for b in wanted) or "none"
            reader = reader.option("pathGlobFilter", f"*_{{{names}}}.c*")
        return reader.parquet(*places)

    @contextmanager
    def _bucketed(self, layout: Layout, folders: list[str], namespaces: list[str] | None) -> Iterator[DataFrame]:
        """The store as a table that Spark knows to be bucketed, so that joins on the hash do not shuffle it.

        Its columns have names of their own (``stored_...``). The table is known inside the block only.
        """
        base = self._in(layout, folders[0]).rsplit("/", 1)[0]
        found = [f for folder in folders for f in files.glob(self.spark, f"{self._in(layout, folder)}/namespace_name=*")]
        spaces = {f: unquote(f.rsplit("namespace_name=", 1)[1]) for f in found}
        name = _table_name()
        columns = ", ".join(f"{c} {PSEUDONYM_SCHEMA[c].dataType.simpleString()}" for c in PSEUDONYM_COLUMNS[1:])
        self.spark.sql(
            f"CREATE TABLE {name} ({layout.hash} long, {columns}, batch string, namespace_name string) USING parquet "
            f"PARTITIONED BY (batch, namespace_name) CLUSTERED BY ({layout.hash}) SORTED BY ({layout.hash}) "
            f"INTO {_bucket_number(folders[0])} BUCKETS LOCATION {_literal(base)}"
        )
        try:
            parts = [
                f"PARTITION (batch = 'b{i}', namespace_name = {_literal(space)}) LOCATION {_literal(folder)}"
                for i, (folder, space) in enumerate(spaces.items())
                if namespaces is None or space in namespaces
            ]
            if parts:
                self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(parts)}")
            rows = self.spark.table(name)
            yield rows.select(*[F.col(c).alias(f"stored_{c}") for c in (layout.hash, *PSEUDONYM_COLUMNS)])
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    # -- finding keys ------------------------------------------------------------------------------------------------

    def buckets_of(self, layout: Layout = BY_KEY) -> "Buckets":
        """What to observe while keys are written, to know the buckets they fall into."""
        return Buckets(layout, _bucket_number(self._generation()))

    def reverse_map(
        self,
        wanted: DataFrame,
        size: int,
        scratch: Workspace,
        namespaces: list[str] | None = None,
        buckets: list[int] | None = None,
    ) -> tuple[DataFrame, dict]:
        """The first original of every wanted (namespace, pseudonym), one row each, stored in ``scratch``; with its sizes.

        ``wanted`` is a stored table of distinct requests and ``size`` its measured size. ``namespaces`` names the
        partitions to read and ``buckets`` their buckets, where the caller knows them.
        """
        keys, folders = list(BY_PSEUDONYM.keys), self._committed()
        seen = Observation()
        metrics = size_metrics(namespaces, *keys, "original_value")

        def saved(found: DataFrame) -> DataFrame:
            return scratch.save(found.observe(seen, *metrics), "originals")

        if size <= self.broadcast_bytes or not folders:
            stored = _of(self._scan(folders, BY_PSEUDONYM, buckets), namespaces)
            asked = F.broadcast(wanted.where(F.length(keys[1]) >= 0).select(*keys))
            return saved(first_reverse(stored.join(asked, keys, "left_semi"))), observed(seen)
        with self._bucketed(BY_PSEUDONYM, folders, namespaces) as stored:
            asked = wanted.select(*keys, BY_PSEUDONYM.hashed().alias(BY_PSEUDONYM.hash)).hint("merge")
            found = stored.join(asked, _meets(BY_PSEUDONYM), "left_semi")
            found = found.toDF(*[c.removeprefix("stored_") for c in found.columns])
            return saved(first_reverse(found, BY_PSEUDONYM.hash)), observed(seen)

    def reverse_many(self, requests: DataFrame) -> DataFrame:
        """The first mapping behind every requested (namespace, pseudonym); unknown ones are absent.

        Reads the buckets of the requested pseudonyms, in the layout that is cut by them.
        """
        scratch = self.workspace.part()
        seen = Observation()
        buckets = self.buckets_of(BY_PSEUDONYM)
        wanted = requests.select(*BY_PSEUDONYM.keys).distinct()
        wanted = scratch.save(
            wanted.observe(seen, text_bytes(*BY_PSEUDONYM.keys).alias("bytes"), *buckets.metrics()), "wanted"
        )
        stats = observed(seen)
        found, _ = self.reverse_map(wanted, stats.get("bytes", 0), scratch, None, buckets.wanted(stats))
        return found

    def reverse_one(self, namespace: str, pseudonym: str) -> DataFrame:
        """The mapping behind one pseudonym, or no row: one bucket of one namespace, its filter at the scan."""
        folders = self._committed()
        bucket = None
        if folders:
            value = F.pmod(F.hash(F.xxhash64(F.lit(namespace), F.lit(pseudonym))), F.lit(_bucket_number(folders[0])))
            bucket = [self.spark.range(1).select(value.alias("bucket")).first()["bucket"]]
        stored = self._scan(folders, BY_PSEUDONYM, bucket).select(*PSEUDONYM_COLUMNS)
        return (
            stored.where((F.col("namespace_name") == namespace) & (F.col("pseudonym_value") == pseudonym))
            .orderBy("created_at", "original_value")
            .limit(1)
        )

    # -- writing -----------------------------------------------------------------------------------------------------

    def seed(self, mappings: DataFrame, batch_id: str) -> None:
        """Bring in existing mappings (with their pseudonyms and times) that the store does not have yet.

        Of several rows for one key the earliest is kept. Calling again, with whatever mappings, adds those whose keys are
        still missing.
        """
        rest = F.struct("created_at", "pseudonym_value", "last_updated_at")
        first = mappings.groupBy(*KEYS).agg(F.min(rest).alias("first")).select(*KEYS, "first.*")
        folders = self._committed()
        if not folders:
            self._write(self._free(batch_id), first)
            return
        scratch = self.workspace.part()
        try:
            seen, missed, buckets = Observation(), Observation(), self.buckets_of()
            n = F.count(F.lit(1)).alias("n")
            metrics = [n, text_bytes(*KEYS).alias("bytes"), *buckets.metrics()]
            first = scratch.save(first.observe(seen, *metrics), "seeded")
            stats = observed(seen)
            if stats.get("bytes", 0) <= self.broadcast_bytes:
                stored = self._scan(folders, BY_KEY, buckets.wanted(stats))
                known = stored.join(F.broadcast(first.where(F.length("original_value") >= 0).select(*KEYS)), KEYS, "left_semi")
                rest = scratch.save(pick_misses(first, known).observe(missed, n), "unknown")
                count = observed(missed).get("n", 0)
            else:
                with self._bucketed(BY_KEY, folders, None) as stored:
                    asked = first.withColumn(BY_KEY.hash, BY_KEY.hashed())
                    # Most often all keys are unknown or none is, which the keys alone tell.
                    keys = asked.select(BY_KEY.hash, *KEYS).hint("merge")
                    rest, count = first, keys.join(stored, _meets(BY_KEY), "left_anti").count()
                    if 0 < count < stats["n"]:
                        small = asked.withColumn("pseudonym_value", packed(F.col("pseudonym_value"))).hint("merge")
                        rest = small.join(stored, _meets(BY_KEY), "left_anti").select(*first.columns)
                        rest = rest.withColumn("pseudonym_value", unpacked(F.col("pseudonym_value")))
                        rest = scratch.save(rest, "unknown")
            if count:
                self._write(self._free(batch_id), rest, expected=count)
        finally:
            scratch.release()

    def upsert(self, requests: DataFrame, catalog: DataFrame, batch_id: str | None = None) -> Upserted:
        """Return the pseudonym of every requested (namespace, original value), creating the missing ones.

        An existing pseudonym is never replaced. Calling again with the same ``batch_id`` is a no-op that returns the same
        mappings.
        """
        with self.workspace.kept_if_done() as scratch:
            own = scratch.part()
            asked = self.save_requests(distinct_requests(requests), catalog, own)
            if asked.missing:
                raise ValueError("Blank values get no pseudonym.")
            done = self.upsert_requests(asked, catalog, scratch, batch_id)
            own.release()  # the mappings are read from where they were found or stored
            return done

    def save_requests(self, requests: DataFrame, catalog: DataFrame, scratch: Workspace) -> Requests:
        """Store distinct requests (``n`` counting repeated ones), and see in the same pass what there is to know of them."""
        value, method = F.col("original_value"), F.col("method")
        given = value.isNotNull()
        needed = fixed_length(method)
        bad_length = given & needed.isNotNull() & (needed != F.coalesce("length", F.lit(0)))
        seen, buckets = Observation(), self.buckets_of()
        metrics = [
            F.sum("n").alias("cells"),
            F.sum(F.when(value.isNull(), F.col("n"))).alias("missing"),
            F.count(value).alias("keys"),
            text_bytes(*KEYS).alias("bytes"),
            F.max(given & is_blank(value)).alias("blank"),
            F.count(F.when(given & method.isNull(), 1)).alias("unknown"),
            F.count(F.when(bad_length, 1)).alias("bad_length"),
            *[F.max(given & (method == name)).alias(f"method {name}") for name in GENERATORS],
            F.max(F.when(given & ~method.isin(list(GENERATORS)), method)).alias("other method"),
            *buckets.metrics(),
        ]
        judged = self._with_settings(requests, catalog).observe(seen, *metrics)
        table = scratch.save(judged.select(*KEYS, "n"), "requests")
        stats = observed(seen)
        return Requests(table, stats, buckets.wanted(stats))

    def upsert_requests(
        self,
        asked: Requests,
        catalog: DataFrame,
        scratch: Workspace,
        batch_id: str | None = None,
        namespaces: list[str] | None = None,
        computed: dict[str, Callable[[Column], Column]] | None = None,
        by_row: bool = False,
    ) -> Upserted:
        """As ``upsert``, for requests that ``save_requests`` stored. Intermediate tables go to ``scratch``.

        ``namespaces`` names the partitions to read, where the caller knows them, and ``computed`` has the functions of those
        whose pseudonyms follow from the original. ``by_row`` holds all stored pseudonyms against ``with_computed``.
        """
        asked.check()
        counts = {"requested": asked.keys, "cells": asked.cells, "missing": asked.missing}
        folders = self._committed()
        misses, hits, sizes, unlike = asked.table.where(F.col("original_value").isNotNull()), None, {}, frozenset()
        n_misses = asked.keys
        if n_misses and folders:
            own = catalog if by_row else None
            matched, stats = self._match(asked, folders, namespaces, computed or {}, scratch, own)
            misses = matched.where(F.col("pseudonym_value").isNull()).select(*KEYS, "n")
            hits = matched.where(F.col("pseudonym_value").isNotNull())
            n_misses = stats.get("misses", 0)
            sizes = sizes_of(stats, namespaces)
            unlike = frozenset(name for i, name in enumerate([*(computed or {}), *[None] * by_row]) if stats.get(f"unlike{i}"))

        found = (hits if hits is not None else self._scan([])).select(*PSEUDONYM_COLUMNS, F.lit(False).alias("is_new"))
        rest = {"scratch": scratch, "unlike": unlike, **counts}
        if n_misses == 0:
            return Upserted(found, created=0, sizes=sizes, **rest)
        size = asked.bytes * n_misses // asked.keys
        folder, stats = self._mint(misses, asked.methods, catalog, batch_id or uuid.uuid4().hex, n_misses, size, namespaces)
        created = self._scan([folder]).select(*PSEUDONYM_COLUMNS, F.lit(True).alias("is_new"))
        mappings = created if hits is None else found.unionByName(created)
        drawn = sizes_of(stats, namespaces)
        sizes = {name: sizes.get(name, 0) + size for name, size in drawn.items()}
        return Upserted(mappings, created=n_misses, sizes=sizes, **rest)

    def settings_of(self, catalog: DataFrame, names: list[str]) -> dict[str, dict]:
        """The catalogue's rows of some namespaces, which the caller named."""
        self._settings(catalog)
        local = self._known_settings[2]
        rows = catalog.where(F.col("name").isin(names)).toArrow().to_pylist() if local is None else local
        return {row["name"]: row for row in rows if row["name"] in names}

    def _with_settings(self, rows: DataFrame, catalog: DataFrame, namespace: str = "namespace_name") -> DataFrame:
        """``rows`` with ``method, length, prefix, suffix`` of their namespaces, nulls where there is none."""
        own = self._own_settings(catalog, namespace)
        if own is None:
            return rows.join(self._settings(catalog).withColumnRenamed("namespace_name", namespace), namespace, "left")
        return rows.withColumn("__settings", own).select(*rows.columns, "__settings.*")

    def _own_settings(self, catalog: DataFrame, namespace: str = "namespace_name") -> Column | None:
        """``method, length, prefix, suffix`` of a row's namespace as part of the plan, if the namespaces are few and known."""
        self._settings(catalog)
        local = self._known_settings[2]
        if local is None or not 0 < len(local) <= INLINE_NAMESPACES:
            return None
        names = {
            "method": ("pseudonym_generation_method", "string"),
            "length": ("pseudonym_length", "long"),
            "prefix": ("pseudonym_prefix", "string"),
            "suffix": ("pseudonym_suffix", "string"),
        }
        entries = [
            (F.lit(row["name"]), F.struct(*[F.lit(row[c]).cast(kind).alias(n) for n, (c, kind) in names.items()]))
            for row in {row["name"]: row for row in local}.values()
        ]
        return F.try_element_at(F.create_map(*[c for entry in entries for c in entry]), F.col(namespace))

    def computes(self, asked: Requests, catalog: DataFrame) -> bool:
        """Whether all pseudonyms of some requests follow from their originals, by settings that are few and known."""
        self._settings(catalog)
        local = self._known_settings[2]
        if local is None or len({row["name"] for row in local}) < len(local):
            return False
        return all(name in GENERATORS and GENERATORS[name].deterministic for name in asked.methods)

    def with_computed(
        self, rows: DataFrame, catalog: DataFrame, methods: list[str], namespace: str, original: str, result: str
    ) -> DataFrame:
        """``rows`` with the pseudonyms of their originals as ``result``, where ``computes`` says so; null for a null original."""
        settings = ["method", "length", "prefix", "suffix"]
        known = self._with_settings(rows.select("*", F.col(namespace).alias("__space")), catalog, "__space")
        text = generate(F.col("method"), F.col(original), F.col("length"), methods)
        text = with_affixes(text, F.col("prefix"), F.col("suffix"))
        return known.withColumn(result, F.when(F.col(original).isNotNull(), text)).drop("__space", *settings)

    def _settings(self, catalog: DataFrame) -> DataFrame:
        """The namespaces' settings, to be broadcast if they are small. A catalogue table is a snapshot and read once."""
        if self._known_settings is None or self._known_settings[0] is not catalog:
            some = catalog.limit(LOCAL_NAMESPACES + 1).toArrow()
            local = some.to_pylist() if some.num_rows <= LOCAL_NAMESPACES else None
            settings = (catalog if local is None else self.spark.createDataFrame(some)).select(
                F.col("name").alias("namespace_name"),
                F.col("pseudonym_generation_method").alias("method"),
                F.col("pseudonym_length").cast("long").alias("length"),
                F.col("pseudonym_prefix").cast("string").alias("prefix"),
                F.col("pseudonym_suffix").cast("string").alias("suffix"),
            )
            if local is None:
                names = ("namespace_name", "method", "prefix", "suffix")
                settings = broadcast_if_small(settings, *names, limit=self.broadcast_bytes)
            else:
                settings = F.broadcast(settings)
            self._known_settings = (catalog, settings, local)
        return self._known_settings[1]

    def _match(
        self,
        asked: Requests,
        folders: list[str],
        namespaces: list[str] | None,
        computed: dict[str, Callable[[Column], Column]],
        scratch: Workspace,
        by_row: DataFrame | None = None,
    ) -> tuple[DataFrame, dict]:
        """Each requested key with its stored mapping or nulls, stored, and what was seen of them.

        ``by_row`` is the catalogue, if all pseudonyms are to be held against computed ones.
        """
        rest = ["created_at", "pseudonym_value", "last_updated_at"]
        wanted = asked.table.where(F.length("original_value") >= 0)
        seen = Observation()
        unlike = [
            F.count(F.when((F.col(KEYS[0]) == name) & (F.col("pseudonym_value") != build(F.col(KEYS[1]))), 1))
            for name, build in computed.items()
        ]
        if by_row is not None:
            unlike.append(F.count(F.when(F.col("pseudonym_value") != F.col("__computed"), 1)))
        metrics = [
            F.count(F.when(F.col("pseudonym_value").isNull(), 1)).alias("misses"),
            *size_metrics(namespaces),
            *[count.alias(f"unlike{i}") for i, count in enumerate(unlike)],
        ]

        def saved(matched: DataFrame) -> DataFrame:
            found = matched.select(*KEYS, "n", *[f"first.{c}" for c in rest])
            columns = found.columns
            if by_row is not None:
                found = self.with_computed(found, by_row, asked.methods, *KEYS, "__computed")
            return scratch.save(found.observe(seen, *metrics).select(*columns), "matched")

        if asked.bytes <= self.broadcast_bytes:
            # Few requests against a large store: the requests travel, their buckets are read, and only matching rows
            # leave the scan; the requests' partitions prune the store's.
            stored = _of(self._scan(folders, BY_KEY, asked.buckets), namespaces)
            hits = stored.join(F.broadcast(wanted.select(*KEYS)), KEYS, "left_semi")
            both = wanted.select(*KEYS, "n").unionByName(hits.select(*KEYS, *rest), allowMissingColumns=True)
            found = F.when(F.col("pseudonym_value").isNotNull(), F.struct(*rest))
            matched = both.groupBy(*KEYS).agg(F.max("n").alias("n"), F.min(found).alias("first"))
            return saved(matched), observed(seen)
        with self._bucketed(BY_KEY, folders, namespaces) as stored:
            # Only the requests are shuffled; grouped by the hash as well, the aggregate needs no shuffle either.
            hashed = wanted.withColumn(BY_KEY.hash, BY_KEY.hashed()).hint("merge")
            found = F.struct(*[F.col(f"stored_{c}").alias(c) for c in rest])
            found = F.when(F.col("stored_pseudonym_value").isNotNull(), found)
            joined = hashed.join(stored, _meets(BY_KEY), "left")
            matched = joined.groupBy(BY_KEY.hash, *KEYS).agg(F.max("n").alias("n"), F.min(found).alias("first"))
            return saved(matched), observed(seen)

    def _mint(
        self, misses: DataFrame, methods: list[str], catalog: DataFrame, batch_id: str, expected: int, size: int, namespaces
    ) -> tuple[str, dict]:
        """Generate and store the pseudonyms of new keys, each covered exactly once. Returns the batch folder."""
        folder = self._free(batch_id)
        now = F.lit(datetime.now(timezone.utc))
        own = self._own_settings(catalog)

        def settled(keys: DataFrame) -> DataFrame:
            return self._with_settings(keys, catalog).withColumn("created_at", now).withColumn("last_updated_at", now)

        def pseudonym(wanted: list[str], method: Column, length: Column, prefix: Column, suffix: Column) -> Column:
            return with_affixes(generate(method, F.col("original_value"), length, wanted), prefix, suffix)

        settings = ("method", "length", "prefix", "suffix")
        # Settings that are part of the plan are added where rows are written, so that the keys alone are moved.
        keys = misses.select(*KEYS)
        rows = settled(keys)
        # A Python function sees every row of its frame, so each random method gets a frame of its own.
        computed = [m for m in methods if m in GENERATORS and GENERATORS[m].deterministic]
        branches = [[m] for m in methods if m not in computed] + ([computed] if computed else [])
        drawn = []
        for wanted in branches:
            value = pseudonym(wanted, *[F.col(s) for s in settings])
            mine = rows.where(F.col("method").isin(wanted)) if len(branches) > 1 else rows
            if own is None:
                drawn.append((mine, lambda dealt, value=value: dealt.withColumn("pseudonym_value", value)))
            else:
                moved = mine.select(*KEYS)
                drawn.append((moved, lambda dealt, value=value: settled(dealt).withColumn("pseudonym_value", value)))
        follows = None
        if own is not None and len(branches) == 1 and computed and all(GENERATORS[m].distinct for m in computed):
            follows = pseudonym(computed, *[own[s] for s in settings])
        local = self._known_settings[2]
        known = namespaces or ([row["name"] for row in local] if local is not None and len(local) <= INLINE_NAMESPACES else None)
        return folder, self._write(
            folder, None, known, drawn=drawn, expected=expected, namespaces=namespaces, size=size, follows=follows
        )

    # -- maintenance -------------------------------------------------------------------------------------------------

    def _escaped(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)

    def delete_namespace(self, name: str) -> None:
        """Drop a namespace's partition from every batch of every generation, in both layouts."""
        own = f"namespace_name={self._escaped(name)}"
        folders = self._committed()
        if folders:
            lost = _counts(_of(self._scan(folders), [name])).first()
            place = f"deleted/{self._generation(folders)}/batch_id=*/{own}"
            self._change({name: -lost["n"] if lost else 0}, place)
        for layout in (BY_KEY, BY_PSEUDONYM):
            for folder in files.glob(self.spark, f"{self.path}/{layout.folder}generation=*/batch_id=*"):
                files.delete(self.spark, f"{folder}/{own}")
        self._announce()

    def compact(self, buckets: int | None = None, slice_rows: int = SLICE_ROWS) -> None:
        """Rewrite many small batches as one new generation, keeping the first writer's row of every key.

        The new generation has ``buckets`` (as many as before if not given) and batches of about ``slice_rows`` rows that
        follow each other in time, so that pages read the newest ones only. The old generation stays for readers that
        still use it, until ``drop_superseded``.
        """
        folders = self._committed()
        if not folders:
            return
        generation = self._generation(folders)
        number = int(generation.split("=")[1].split(".")[0]) + 1
        buckets = buckets or _bucket_number(generation)
        rest = F.struct("created_at", "pseudonym_value", "last_updated_at")
        scratch, seen = self.workspace.part(), Observation()
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        name = f"generation={number:06d}.{buckets}"
        try:
            # Each batch has a key once, so no key's rows are many: they meet by the hash, where the first layout wants them.
            small = self.read().withColumn("pseudonym_value", packed(F.col("pseudonym_value")))
            met = small.withColumn(BY_KEY.hash, BY_KEY.hashed()).repartition(F.col(BY_KEY.hash))
            met = met.withColumn("pseudonym_value", unpacked(F.col("pseudonym_value")))
            first = met.groupBy(BY_KEY.hash, *KEYS).agg(F.min(rest).alias("first")).select(*KEYS, "first.*")
            if self.read().count() <= slice_rows:
                place = f"{name}/batch_id=compacted-0000"
                self._stage(first, staged, place, buckets, placed=True)
                first = self.spark.read.schema(PSEUDONYM_SCHEMA).parquet(f"{staged}/{BY_KEY.folder}{place}")
            else:
                first = scratch.save(first.observe(seen, F.count(F.lit(1)).alias("n")), "compacted")
                bounds = _bounds(first, observed(seen).get("n", 0), slice_rows)
                for i, (after, until) in enumerate(zip([None, *bounds], [*bounds, None])):
                    at = F.col("created_at")
                    rows = first if after is None else first.where(at > after)
                    rows = rows if until is None else rows.where((at <= until) | at.isNull() if after is None else at <= until)
                    self._stage(rows, staged, f"{name}/batch_id=compacted-{i:04d}", buckets)
            before = _counts(self.read()).select("namespace_name", (-F.col("n")).alias("n"))
            change = _counts(first).unionByName(before).groupBy("namespace_name").agg(F.sum("n").alias("n"))
            self._change(change, name)
            self._move(staged, name)
        finally:
            files.delete(self.spark, staged)
            scratch.release()
        self._announce()

    def drop_superseded(self) -> None:
        """Delete all generations but the newest."""
        current = self._generation()
        for layout in (BY_KEY, BY_PSEUDONYM):
            for folder in files.glob(self.spark, f"{self.path}/{layout.folder}generation=*"):
                if folder.rsplit("/", 1)[1] < current:
                    files.delete(self.spark, folder)


def _table_name() -> str:
    return f"pseudospark_{uuid.uuid4().hex}"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bucket_number(place: str) -> int:
    """The number of buckets, which a generation's name tells."""
    return int(place.split("generation=")[-1].split("/")[0].split(".")[1])


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("namespace_name").agg(F.count(F.lit(1)).alias("n"))


def _of(rows: DataFrame, namespaces: list[str] | None) -> DataFrame:
    return rows if namespaces is None else rows.where(F.col("namespace_name").isin(namespaces))


def _meets(layout: Layout) -> Column:
    """The condition of a join by buckets: on the hash alone, which is how the store is cut. Unlike keys of one hash are
    told apart by comparisons that are no join keys, as those would have the store shuffled."""
    condition = F.col(layout.hash) == F.col(f"stored_{layout.hash}")
    for key in layout.keys:
        condition = condition & (F.col(key) <= F.col(f"stored_{key}")) & (F.col(key) >= F.col(f"stored_{key}"))
    return condition


def size_metrics(namespaces: list[str] | None, *columns: str) -> list[Column]:
    """Measured bytes of mappings, in all and for each namespace that the caller named."""
    named = columns or (*KEYS, "pseudonym_value")
    found = F.col("pseudonym_value").isNotNull()
    own = [found & (F.col("namespace_name") == name) for name in namespaces or []]
    return [
        text_bytes(*named, where=condition).alias(label)
        for label, condition in [("bytes", found), *((f"bytes{i}", c) for i, c in enumerate(own))]
    ]


def sizes_of(stats: dict, namespaces: list[str] | None) -> dict[str | None, int]:
    """Bytes by namespace; those of all mappings under None."""
    sizes = {name: stats.get(f"bytes{i}", 0) for i, name in enumerate(namespaces or [])}
    return {None: stats.get("bytes", 0), **sizes}


def _bounds(rows: DataFrame, count: int, slice_rows: int) -> list[datetime]:
    """Times that cut rows into slices of about ``slice_rows``; at most ``MOST_SLICES`` - 1 of them."""
    slices = min(MOST_SLICES, -(-count // max(1, slice_rows)))
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx(F.unix_micros("created_at"), shares, 10_000).alias("at")).first()["at"]
    return [EPOCH + timedelta(microseconds=t) for t in sorted(set(found or []))]
