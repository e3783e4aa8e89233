"""Joining a wide table to a key -> value mapping without moving more rows than needed."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
# Per-row cost of a broadcast hash table entry beyond the text itself.
ROW_OVERHEAD = 64
# At most this many keys can each hold 1/1000 of all rows, so their number has a bound by counting.
HOT_SHARES = (1000, 100, 10)
# Hot keys may always take this much, whatever earlier mappings of a plan left of its limit.
HOT_KEY_BYTES = 8 * 1024 * 1024
# Most parts into which the rows of a hot key are split where its value does not fit a broadcast.
MOST_PARTS = 4096


def text_bytes(*columns: str, where: Column | None = None) -> Column:
    """Measured size of a table's text columns (in some of its rows), for broadcast decisions."""
    sizes = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c in columns]
    size = reduce(lambda a, b: a + b, sizes) + ROW_OVERHEAD
    return F.coalesce(F.sum(size if where is None else F.when(where, size)), F.lit(0))


def measure(df: DataFrame, *columns: str) -> int:
    return df.agg(text_bytes(*columns).alias("bytes")).first()["bytes"]


def broadcast_if_small(df: DataFrame, *columns: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring ``df``; otherwise leave the join to shuffle."""
    return F.broadcast(df) if measure(df, *columns) <= limit else df


def _hashable(df: DataFrame) -> list[Column]:
    return [
        F.col(field.name)
        for field in df.schema.fields
        if not any(kind in field.dataType.simpleString() for kind in ("map<", "variant"))
    ]


def _hot_keys(counts: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """The keys that hold at least a shuffle partition's share of all rows, or the largest of them that fit ``limit``."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for share in sorted({partitions, *HOT_SHARES}, reverse=True):
        hot = counts.where(F.col("n") * share >= F.lit(total)).select(*keys)
        size = measure(hot, *keys)
        if size == 0:
            return None
        if size <= limit:
            return hot
    return None


def _parts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``__hash, __parts`` of the hot keys: as many parts as a key's rows would fill shuffle partitions.

    Keys are told by their hash, so that the table is small however long they are: each holds a share of all rows, which
    bounds their number. Another key of the same hash is split as well, which does no harm.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    shares = max(partitions, *HOT_SHARES)
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") * partitions / F.lit(max(1, total))) + 1).cast("int")
    hot = counts.where(F.col("n") * shares >= F.lit(total)).select(F.xxhash64(*keys).alias("__hash"), parts.alias("__parts"))
    return hot.groupBy("__hash").agg(F.max("__parts").alias("__parts"))


def attach(
    df: DataFrame,
    keys: list[str],
    mapping: DataFrame,
    mapping_keys: list[str],
    value: str,
    result: str,
    counts: DataFrame,
    size: int,
    limit: int = BROADCAST_BYTES,
) -> tuple[DataFrame, bool]:
    """Left-join ``mapping`` (one row per key) and add its ``value`` column as ``result``.

    The last of ``keys`` is null in rows that have nothing to look up. ``counts`` (key columns and ``n``) tells how often
    each key occurs, ``size`` is the measured size of ``mapping``. Returns the frame and whether the row order was kept.

    * A mapping that measures small is broadcast: ``df`` is not shuffled at all.
    * Otherwise the hot keys are found. If their mapping measures small it is broadcast, and only the rest joins by
      shuffle; else their rows are split into parts in proportion to their number, and their mapping is copied to each.
    * Rows that have nothing left to look up travel under their task and content instead of all under the null key.
    """

    def renamed(frame: DataFrame, tag: str, *others: str | Column) -> DataFrame:
        return frame.select(*[F.col(k).alias(f"__{tag}{i}") for i, k in enumerate(mapping_keys)], *others)

    def narrowed(frame: DataFrame, tag: str, name: str) -> DataFrame:
        return renamed(frame, tag, F.col(value).alias(name))

    def matches(tag: str) -> Column:
        pairs = [F.col(k) == F.col(f"__{tag}{i}") for i, k in enumerate(keys)]
        return reduce(lambda a, b: a & b, pairs)

    def drop(frame: DataFrame, tag: str) -> DataFrame:
        return frame.drop(*[f"__{tag}{i}" for i in range(len(mapping_keys))])

    if size <= limit:
        small = F.broadcast(narrowed(mapping, "small", result))
        return drop(df.join(small, matches("small"), "left"), "small"), True

    own_columns = _hashable(df)
    wide = df
    is_open = F.col(keys[-1]).isNotNull()
    salt, salts = F.lit(0), F.array(F.lit(0))
    cold_keys = [f"__cold{i}" for i in range(len(mapping_keys))]
    cold_side = narrowed(mapping, "cold", "__found")
    hot = _hot_keys(counts, mapping_keys, max(limit, HOT_KEY_BYTES))
    hot_mapping = None
    if hot is not None:
        hot_mapping = mapping.join(F.broadcast(hot), mapping_keys, "left_semi")
        if measure(hot_mapping, *mapping_keys, value) > limit:
            hot_mapping = None
    if hot_mapping is None:
        split = F.broadcast(_parts(counts, mapping_keys))
        wide = wide.withColumn("__hash", F.xxhash64(*keys)).join(split, "__hash", "left").drop("__hash")
        cold_side = cold_side.withColumn("__hash", F.xxhash64(*cold_keys)).join(split, "__hash", "left").drop("__hash")
        # By the row's place, which is the same when its task runs again.
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts")).cast("int")
        salt = F.when(F.col("__parts").isNotNull(), place).otherwise(salt)
        salts = F.when(F.col("__parts").isNotNull(), F.sequence(F.lit(0), F.col("__parts") - 1)).otherwise(salts)
    else:
        hot_side = F.broadcast(narrowed(hot_mapping, "hot", "__hot"))
        wide = drop(wide.join(hot_side, matches("hot"), "left"), "hot")
        is_open = is_open & F.col("__hot").isNull()
    # Keys and salt decide the partition: rows without an open key get a salt that spreads them, also where their content
    # repeats. It matches at most the mapping of their own hot key, found already. The others' salts are small numbers,
    # which hardly add to what is moved.
    settled = F.xxhash64(F.spark_partition_id(), *own_columns)
    wide = wide.withColumn("__salt", F.when(is_open, salt.cast("long")).otherwise(settled)).drop("__parts")
    cold_side = cold_side.withColumn("__cold_salt", F.explode(salts.cast("array<long>"))).drop("__parts")
    on_salt = F.col("__salt") == F.col("__cold_salt")
    joined = wide.join(cold_side, on_salt & matches("cold"), "left")
    found = F.col("__found") if hot_mapping is None else F.coalesce("__hot", "__found")
    joined = drop(joined.withColumn(result, found), "cold")
    return joined.drop("__salt", "__cold_salt", "__found", "__hot"), False
