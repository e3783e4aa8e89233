import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pseudospark.functions.generators import GENERATORS, Generator, generate, register_generator

HASH_VECTORS = [
    ("test", "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08"),
    ("longer Value with an Emoji 👷‍♂️", "74B63BF6DC88DB9A3E54DC7EB2691749F50A3E6F04DC5D1F5EFE54D70EE21759"),
]


def drawn(spark, method, length, n=400):
    values = spark.range(n).select(F.col("id").cast("string").alias("v"))
    column = generate(F.lit(method), F.col("v"), F.lit(length), [method])
    return [r[0] for r in values.select(column).collect()]


@pytest.mark.parametrize("value, expected", HASH_VECTORS)
def test_sha256_vectors(spark, value, expected):
    method = "Sha256HexEncoded"
    df = spark.createDataFrame([(value,)], "v string")
    column = generate(F.lit(method), F.col("v"), F.lit(64), [method])
    assert df.select(column).first()[0] == expected


@pytest.mark.parametrize("length", [1, 16, 17, 30, 31, 32, 64, 97])
@pytest.mark.parametrize(
    "method, pattern", [("FullRandomHexEncoded", "^[0-9a-f]*$"), ("FullRandomBase62Encoded", "^[0-9A-Za-z]*$")]
)
def test_free_length(spark, method, pattern, length):
    values = drawn(spark, method, length)
    assert all(len(v) == length and re.match(pattern, v) for v in values)
    if length >= 16:
        assert len(set(values)) == len(values)


def test_base62_uses_its_digits_evenly(spark):
    text = "".join(drawn(spark, "FullRandomBase62Encoded", 500))
    counts = [text.count(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    mean = len(text) / 62
    assert sum(counts) == len(text)
    # 61 degrees of freedom: 140 is beyond the 1e-6 quantile.
    assert sum((c - mean) ** 2 / mean for c in counts) < 140


@pytest.mark.parametrize("method, version", [("Uuid4", "4"), ("Uuid7", "7")])
def test_uuids(spark, method, version):
    values = drawn(spark, method, 36)
    pattern = f"^[0-9a-f]{{8}}-[0-9a-f]{{4}}-{version}[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$"
    assert all(re.match(pattern, v) for v in values)
    assert len(set(values)) == len(values)


def test_uuid7_starts_with_the_time(spark):
    import time

    value = drawn(spark, "Uuid7", 36, 1)[0]
    millis = int(value.replace("-", "")[:12], 16)
    assert abs(millis - time.time() * 1000) < 60_000


@pytest.mark.parametrize("length", [1, 16, 32, 100])
@pytest.mark.parametrize("method", ["Unspecified", "SecureRandomBase64UrlEncoded"])
def test_base64url(spark, method, length):
    values = drawn(spark, method, length)
    assert all(len(v) == -(-(8 + length) * 4 // 3) for v in values)
    assert all(re.match("^[0-9A-Za-z_-]*$", v) for v in values)
    raw = [base64.urlsafe_b64decode(v + "=" * (-len(v) % 4)) for v in values]
    assert all(len(r) == 8 + length for r in raw)
    assert len({r[:4] for r in raw}) == 1
    if length >= 16:
        assert len({r[8:] for r in raw}) == len(raw)


def test_dispatch_by_column(spark):
    methods = {"Sha256HexEncoded": 64, "Uuid4": 36, "FullRandomHexEncoded": 20, "FullRandomBase62Encoded": 9}
    rows = [(m, n, f"value {i}") for m, n in methods.items() for i in range(20)]
    df = spark.createDataFrame(rows, "m string, n long, v string")
    got = df.select("m", "n", "v", generate(F.col("m"), F.col("v"), F.col("n"), methods).alias("p")).collect()
    assert len(got) == len(rows)
    for row in got:
        assert len(row.p) == row.n
        if row.m == "Sha256HexEncoded":
            assert row.p == hashlib.sha256(row.v.encode()).hexdigest().upper()


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        generate(F.lit("x"), F.lit("v"), F.lit(1), ["NoSuchMethod"])


def test_own_generator(spark):
    register_generator("Reversed", Generator(lambda value, length: F.reverse(value), deterministic=True))
    try:
        df = spark.createDataFrame([("abc",)], "v string")
        assert df.select(generate(F.lit("Reversed"), F.col("v"), F.lit(3), ["Reversed"])).first()[0] == "cba"
        with pytest.raises(ValueError):
            register_generator("Reversed", GENERATORS["Reversed"])
    finally:
        GENERATORS.pop("Reversed")


@pytest.mark.parametrize("method, length", [("Uuid4", 12), ("Uuid7", 37), ("Sha256HexEncoded", 10)])
def test_fixed_lengths_are_checked(spark, method, length):
    made = spark.range(1).select(generate(F.lit(method), F.lit("x"), F.lit(length), [method]).alias("p"))
    with pytest.raises(Exception, match=f"{method} always has length"):
        made.collect()


def test_documents_without_a_text(spark, tmp_path):
    """A null text and blank ones are rows as in the SQL, not errors."""
    from compare import normalized
    from pseudospark.suite import generation

    import duckdb

    texts = ["word " * 300, "word " * 300, None, None, "", " \t", "  x", "\u2003"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(path)
    found = generation.gen_sha256(spark, str(tmp_path))
    cursor = duckdb.connect()
    cursor.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    wanted = cursor.execute(generation.ORACLE["gen_sha256"]).fetchall()
    mine = normalized(found.columns, [tuple(r) for r in found.collect()])
    assert mine == normalized(["original_value", "pseudonym_value"], wanted) and sum(mine.values()) == 6
