import pytest

from pseudospark import MappingStore, NamespaceCatalog
from pseudospark.operators.catalog import unknown_namespaces, validated


@pytest.fixture
def stored(spark, workspace):
    return NamespaceCatalog(spark, workspace.path("catalog"))


def definition(name, method="Uuid4", length=36, **more):
    return {"name": name, "pseudonym_generation_method": method, "pseudonym_length": length, **more}


def test_create_get_and_duplicate(stored):
    stored.create(**definition("one", description="first"))
    row = stored.get("one").first()
    assert (row.description, row.pseudonym_length) == ("first", 36)
    assert row.created_at is not None and row.created_at == row.last_updated_at
    assert stored.get("two").isEmpty()
    with pytest.raises(ValueError, match="'one' is taken"):
        stored.create(**definition("one", description="second"))
    assert stored.load().count() == 1


@pytest.mark.parametrize(
    "method, length, message",
    [
        ("Uuid4", 0, "not positive"),
        ("FullRandomHexEncoded", -1, "not positive"),
        ("Uuid4", 35, "length 36"),
        ("Uuid7", 32, "length 36"),
        ("Sha256HexEncoded", 32, "length 64"),
    ],
)
def test_invalid_definitions(stored, method, length, message):
    with pytest.raises(ValueError, match=message):
        stored.create(**definition("x", method, length))
    assert stored.load().count() == 0


def test_blank_name(stored):
    with pytest.raises(ValueError, match="blank"):
        stored.create(**definition("  "))


def test_init_overrides_nothing(stored):
    configured = definition("development", "SecureRandomBase64UrlEncoded", 16, pseudonym_prefix="dev-")
    stored.init([configured])
    outcome = stored.init([{**configured, "pseudonym_length": 99}, definition("new"), definition("new", "Uuid7")])
    assert [r.outcome for r in outcome.orderBy("name").collect()].count("exists") == 2
    loaded = {r.name: r for r in stored.load().collect()}
    assert loaded["development"].pseudonym_length == 16 and loaded["development"].pseudonym_prefix == "dev-"
    assert loaded["new"].pseudonym_generation_method == "Uuid4"


def test_delete_takes_the_pseudonyms_along(spark, stored, workspace):
    stored.init([definition("A"), definition("B")])
    store = MappingStore(spark, workspace.path("store"), workspace)
    asked = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y")], "namespace_name string, original_value string")
    store.upsert(asked, stored.load())
    stored.delete("B", store)
    assert [r.name for r in stored.load().collect()] == ["A"]
    assert [(r.namespace_name, r.original_value) for r in store.read().collect()] == [("A", "x")]
    with pytest.raises(ValueError, match="no namespace 'B'"):
        stored.delete("B", store)


def test_validated_and_unknown(spark, catalog):
    assert validated(catalog).where("violation IS NOT NULL").count() == 0
    asked = spark.createDataFrame([("A",), ("x",), ("x",)], "namespace_name string")
    assert [tuple(r) for r in unknown_namespaces(asked, catalog).collect()] == [("x",)]


def test_tied_definitions_store_one_name(spark, stored):
    columns = "name string, description string, pseudonym_generation_method string, pseudonym_length long, pseudonym_prefix string, pseudonym_suffix string, position int"
    rows = [("tied", d, "Uuid4", 36, None, None, 0) for d in ("b", "a", "a")]
    outcome = stored.add(spark.createDataFrame(rows, columns), ["position"]).collect()
    assert {(r["description"], r["outcome"]) for r in outcome} == {("a", "created"), ("b", "exists")}
    assert [r["description"] for r in stored.get("tied").collect()] == ["a"]
