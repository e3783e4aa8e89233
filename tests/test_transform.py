import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pseudospark import ColumnMapping, MappingStore, depseudonymize, pseudonymize
from pseudospark.plans.transform import job_counters, split_blank, usable_mappings
from pseudospark.suite.common import namespaces


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest().upper()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_in_place(spark, store, catalog):
    df = spark.createDataFrame([("1", "secret")], "id string, value string")
    result = pseudonymize(df, [ColumnMapping("value", "hashed")], catalog, store)
    assert rows(result.df) == [("1", sha("secret"))]
    assert (result.rows, result.missing, result.order_kept) == (1, 0, True)
    assert df.columns == result.df.columns


def test_missing_values_pass_through_and_count(spark, store, catalog):
    data = [("1", "secret"), ("2", ""), ("3", "NA"), ("4", "null"), ("5", None)]
    df = spark.createDataFrame(data, "id string, value string")
    result = pseudonymize(df, [ColumnMapping("value", "hashed")], catalog, store)
    assert rows(result.df) == [("1", sha("secret")), ("2", ""), ("3", "NA"), ("4", "null"), ("5", None)]
    assert (result.rows, result.missing) == (5, 4)
    assert store.read().count() == 1


def test_own_placeholders(spark, store, catalog):
    df = spark.createDataFrame([("1", "NA"), ("2", "N/A")], "id string, value string")
    result = pseudonymize(df, [ColumnMapping("value", "hashed")], catalog, store, placeholders=("N/A",))
    assert rows(result.df) == [("1", sha("NA")), ("2", "N/A")]


def test_source_names_are_exact_and_first(spark, store, catalog):
    df = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string").toDF("id", "ID", "id")
    result = pseudonymize(df, [ColumnMapping("id", "hashed"), ColumnMapping(2, "hashed", target="id")], catalog, store)
    assert result.df.columns == ["id", "ID", "id", "id"]
    assert rows(result.df) == [(sha("a"), "b", "c", sha("c"))]
    with pytest.raises(ValueError, match="no column 'Id'"):
        pseudonymize(df, [ColumnMapping("Id", "hashed")], catalog, store)


def test_unknown_namespace(spark, store, catalog):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(ValueError, match="no namespace 'nowhere'"):
        pseudonymize(df, [ColumnMapping("x", "nowhere")], catalog, store)
    with pytest.raises(ValueError, match="no namespace 'nowhere'"):
        depseudonymize(df, [ColumnMapping("x", "nowhere")], catalog, store)
    by_column = spark.createDataFrame([("a", "A"), ("b", "elsewhere")], "x string, n string")
    for direction in (pseudonymize, depseudonymize):
        with pytest.raises(ValueError, match="do not exist"):
            direction(by_column, [ColumnMapping("x", namespace_column="n")], catalog, store)


def test_usable_mappings():
    kept = usable_mappings(
        [ColumnMapping("a", " "), ColumnMapping("", "A"), ColumnMapping("b", "B", target="  "), ColumnMapping(0, "A")]
    )
    assert kept == [ColumnMapping("b", "B"), ColumnMapping(0, "A")]
    with pytest.raises(ValueError, match="No usable column mapping"):
        usable_mappings([ColumnMapping("a", None)])


def test_split_blank(spark):
    df = spark.createDataFrame([("x",), (" ",), (None,), ("NA",)], "original_value string")
    usable, rejected = split_blank(df)
    assert [r[0] for r in usable.collect()] == ["x", "NA"]
    assert [r[0] for r in rejected.collect()] == [" ", None]


def test_reverse(spark, store, catalog):
    df = spark.createDataFrame([("1", "secret"), ("2", ""), ("3", "NA"), ("4", "null")], "id string, value string")
    mapped = [ColumnMapping("value", "ns")]
    hidden = store.workspace.save(pseudonymize(df, mapped, catalog, store).df, "hidden")
    assert hidden.where("id = '1'").first().value != "secret"
    back = depseudonymize(hidden, mapped, catalog, store)
    assert sorted(rows(back.df)) == sorted(rows(df))
    assert back.missing == 3
    # Another namespace knows nothing about these pseudonyms, so they stay.
    elsewhere = depseudonymize(hidden, [ColumnMapping("value", "A")], catalog, store)
    assert sorted(rows(elsewhere.df)) == sorted(rows(hidden))


def test_reverse_of_a_shared_pseudonym_takes_the_first(spark, store, catalog):
    store.seed(
        spark.sql(
            "SELECT 'A' namespace_name, v original_value, 'same' pseudonym_value, t created_at, t last_updated_at"
            " FROM VALUES ('z', timestamp'2024-01-01'), ('y', timestamp'2024-01-02'), ('x', timestamp'2024-01-02') AS d(v, t)"
        ),
        "seed",
    )
    df = spark.createDataFrame([("same",), ("same",)], "v string")
    assert rows(depseudonymize(df, [ColumnMapping("v", "A")], catalog, store).df) == [("z",), ("z",)]


def test_empty_input(spark, store, catalog):
    df = spark.createDataFrame([], "id string, value string")
    result = pseudonymize(df, [ColumnMapping("value", "A")], catalog, store)
    assert rows(result.df) == [] and result.rows == 0
    assert rows(depseudonymize(df, [ColumnMapping("value", "A")], catalog, store).df) == []


def test_stored_exception_beats_the_hash(spark, store, catalog):
    """Of a hash namespace one original was brought in under another pseudonym."""
    store.seed(
        spark.sql(
            "SELECT 'hashed' namespace_name, 'b' original_value, 'imported' pseudonym_value,"
            " timestamp'2024-01-01' created_at, timestamp'2024-01-01' last_updated_at"
        ),
        "seed",
    )
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    assert rows(pseudonymize(df, [ColumnMapping("v", "hashed")], catalog, store).df) == [(sha("a"),), ("imported",)]


def test_counters(spark):
    df = spark.createDataFrame([("a", "NA"), ("", "b"), (" ", None)], "x string, y string")
    mapped = [ColumnMapping("x", "A"), ColumnMapping("y", "A"), ColumnMapping("y", "B", target="t")]
    assert tuple(job_counters(df, mapped).first()) == (3, 2 + 2 + 2)


@pytest.mark.parametrize("limit", [0, 3000, 64 << 20], ids=["shuffle", "hot keys", "broadcast"])
def test_against_brute_force(spark, workspace, catalog, limit):
    """Skewed random data, several mappings, all ways of joining; there and back."""
    rng = random.Random(limit)
    values = ["hot"] * 300 + ["", "NA", None] * 60 + [f"v{rng.randint(0, 150)}" for _ in range(500)]
    spaces = ["A"] * 5 + ["B", "C", "hashed"]
    data = [(i, rng.choice(values), rng.choice(values), rng.choice(spaces)) for i in range(1500)]
    df = spark.createDataFrame(data, "i int, x string, y string, n string").repartition(5)
    store = MappingStore(spark, workspace.path("store"), workspace, broadcast_bytes=limit)
    mapped = [
        ColumnMapping("x", "A"),
        ColumnMapping("y", "hashed", target="y_hash"),
        ColumnMapping("y", "A", target="y_pseudonym"),
        ColumnMapping("x", namespace_column="n", target="x_pseudonym"),
    ]
    result = pseudonymize(df, mapped, catalog, store)
    hidden = workspace.save(result.df, "hidden")
    known = {(r.namespace_name, r.original_value): r.pseudonym_value for r in store.read().collect()}

    def replaced(space, value):
        return value if value in ("", "NA", None) else known[space, value]

    expected = {
        i: (i, replaced("A", x), y, n, replaced("hashed", y), replaced("A", y), replaced(n, x)) for i, x, y, n in data
    }
    got = hidden.collect()
    assert len(got) == len(data)
    assert {r.i: tuple(r) for r in got} == expected
    assert all(known["hashed", v] == sha(v) for s, v in known if s == "hashed")
    asked = {(s, v) for _, x, y, n in data for s, v in (("A", x), ("hashed", y), ("A", y), (n, x))}
    assert set(known) == {(s, v) for s, v in asked if v not in ("", "NA", None)}
    assert result.rows == len(data)
    assert result.missing == sum((x in ("", "NA", None)) * 2 + (y in ("", "NA", None)) * 2 for _, x, y, _ in data)
    assert result.order_kept == (limit > 3000)

    back = depseudonymize(
        hidden,
        [ColumnMapping("x", "A"), ColumnMapping("y_pseudonym", "A"), ColumnMapping("x_pseudonym", namespace_column="n")],
        catalog,
        store,
    ).df
    for row in back.select("i", "x", "y", "y_pseudonym", "x_pseudonym").collect():
        _, x, y, _ = data[row.i]
        assert (row.x, row.y, row.y_pseudonym, row.x_pseudonym) == (x, y, y, x)


def test_whole_rows_of_every_type_survive(spark, store, catalog):
    df = spark.sql("SELECT 7L AS k, 1.5D AS d, array('a') AS l, map('a', 1) AS m, named_struct('s', 'x') AS s, 'v' AS v")
    store.broadcast_bytes = 0
    result = pseudonymize(df, [ColumnMapping("k", "A", target="p"), ColumnMapping("v", "A")], catalog, store).df
    assert result.select("k", "d", "l", "m", "s").collect() == df.select("k", "d", "l", "m", "s").collect()
    assert result.select("p").dtypes == [("p", "string")]


def test_changed_input_stops_the_job(spark, store, catalog):
    """A value that the first reading did not see never reaches the output."""
    df = spark.range(200).select(F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID")).alias("v"))
    result = pseudonymize(df, [ColumnMapping("v", "A")], catalog, store)
    with pytest.raises(Exception, match="input changed"):
        result.df.collect()


@pytest.mark.parametrize("limit", [0, 64 << 20], ids=["shuffle", "broadcast"])
def test_namespace_column_of_another_type(spark, workspace, limit):
    from pseudospark.suite.common import namespaces

    catalog = namespaces(spark, **{"1": ("Sha256HexEncoded", 64, "one-"), "2": ("Sha256HexEncoded", 64, "two-")})
    store = MappingStore(spark, workspace.path("store"), workspace, broadcast_bytes=limit)
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, None)], "n int, v string")
    mapped = [ColumnMapping("v", namespace_column="n"), ColumnMapping("v", "1", target="t")]
    result = pseudonymize(df, mapped, catalog, store).df
    x = sha("x")
    assert sorted(rows(result), key=str) == [(1, "one-" + x, "one-" + x), (2, "two-" + x, "one-" + x), (2, None, None)]
    back = depseudonymize(result, [ColumnMapping("v", namespace_column="n")], catalog, store).df
    assert sorted(rows(back.select("n", "v")), key=str) == [(1, "x"), (2, "x"), (2, None)]


def test_namespace_column_wins_over_a_fixed_name(spark, store, catalog):
    df = spark.createDataFrame([("hashed", "x")], "n string, v string")
    result = pseudonymize(df, [ColumnMapping("v", "A", namespace_column="n")], catalog, store).df
    assert rows(result) == [("hashed", sha("x"))]


def test_namespace_column_may_be_replaced_too(spark, store, catalog):
    df = spark.createDataFrame([("hashed", "x")], "n string, v string")
    mapped = [ColumnMapping("n", "hashed"), ColumnMapping("v", namespace_column="n")]
    assert rows(pseudonymize(df, mapped, catalog, store).df) == [(sha("hashed"), sha("x"))]


def test_requests_are_aggregated_once(spark):
    """One shuffle whichever namespaces share a column or a value; a value counts once for each mapped cell."""
    from pseudospark.plans.transform import _bind, requested_values

    df = spark.createDataFrame([("x", "y", 1), ("x", "x", 2), (None, "z", 3)], "_c0 string, _c1 string, _c2 long")
    mapped = [ColumnMapping(0, "A"), ColumnMapping(0, "B", "b"), ColumnMapping(1, "B"), ColumnMapping(1, "B", "c")]
    asked = requested_values(df, _bind(mapped, df.columns), ("na",))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    found = sorted((r.namespace_name, str(r.value), r.n) for r in asked.collect())
    assert found == [("A", "None", 1), ("A", "x", 2), ("B", "None", 1), ("B", "x", 4), ("B", "y", 2), ("B", "z", 2)]


def test_replaced_column_does_not_travel_beside_its_key(spark):
    """A number that is replaced in place is moved as its text only; one that stays is moved as it is."""
    from pseudospark.plans.transform import _bind, _split_sources

    df = spark.createDataFrame([(1, 2)], "_c0 long, _c1 long")
    mapped = [ColumnMapping(0, "A"), ColumnMapping(1, "A", "copy")]
    assert _split_sources(df, _bind(mapped, df.columns)) == {"_c0"}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("others", [0, 40])
def test_rows_that_name_a_hash_namespace_are_computed(spark, workspace, others):
    """Nothing is sent to the driver or joined for them, unless the store holds another pseudonym for some original; with many
    namespaces only their settings are."""
    more = {f"other {i}": ("Sha256HexEncoded", 64) for i in range(others)}
    catalog = namespaces(spark, plain=("Sha256HexEncoded", 64), fixed=("Sha256HexEncoded", 64, "pre-", "-suf"), drawn=("Uuid4", 36), **more)
    store = MappingStore(spark, workspace.path("store"), workspace)
    data = [("plain", "a", 1), ("fixed", "a", 2), ("fixed", "b", 3), ("nowhere", "NA", 4), (None, None, 5), ("plain", "a", 6), ("drawn", "", 7)]
    df = workspace.save(spark.createDataFrame(data, "n string, v string, id long"), "input")
    mapped = [ColumnMapping("v", namespace_column="n")]

    def expected(n, v):
        return v if v in ("NA", "", None) else sha(v) if n == "plain" else f"pre-{sha(v)}-suf"

    for _ in range(2):  # a fresh store, then known keys
        result = pseudonymize(df, mapped, catalog, store)
        assert plan_of(result.df).count("Join") == (1 if others else 0) and result.order_kept
        assert (result.rows, result.missing) == (7, 3)
        assert {r.id: (r.n, r.v) for r in result.df.collect()} == {i: (n, expected(n, v)) for n, v, i in data}
    assert {(r.namespace_name, r.original_value, r.pseudonym_value) for r in store.read().collect()} == {
        (n, v, expected(n, v)) for n, v, _ in data if v in ("a", "b")
    }


def test_rows_that_name_a_hash_namespace_follow_the_store(spark, workspace):
    """One imported pseudonym, or one drawn at random, and all of them are joined."""
    catalog = namespaces(spark, plain=("Sha256HexEncoded", 64), drawn=("Uuid4", 36))
    store = MappingStore(spark, workspace.path("store"), workspace)
    mapped = [ColumnMapping("v", namespace_column="n")]
    df = workspace.save(spark.createDataFrame([("plain", "a"), ("plain", "b")], "n string, v string"), "input")
    store.seed(
        spark.sql(
            "SELECT 'plain' namespace_name, 'b' original_value, 'imported' pseudonym_value,"
            " current_timestamp() created_at, current_timestamp() last_updated_at"
        ),
        "import",
    )
    for _ in range(2):
        result = pseudonymize(df, mapped, catalog, store)
        assert sorted(rows(result.df)) == [("plain", sha("a")), ("plain", "imported")]
    both = workspace.save(spark.createDataFrame([("plain", "c"), ("drawn", "c")], "n string, v string"), "both")
    found = dict(rows(pseudonymize(both, mapped, catalog, store).df))
    assert found["plain"] == sha("c") and len(found["drawn"]) == 36
    assert dict(rows(pseudonymize(both, mapped, catalog, store).df)) == found
