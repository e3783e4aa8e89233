import json

import pytest

from pseudospark.plans.fhir_batch import create_pseudonyms, judged_requests
from pseudospark.schemas import RULE_SCHEMA


def document(namespace=None, original=None, kind="Parameters"):
    named = [("namespace", namespace), ("originalValue", original)]
    return json.dumps(
        {"resourceType": kind, "parameter": [{"name": n, "valueString": v} for n, v in named if v is not None]}
    )


@pytest.fixture
def ask(spark):
    def build(*documents):
        return spark.createDataFrame(list(enumerate(documents)), "id int, document string")

    return build


def test_create_in_an_existing_namespace(ask, store, catalog):
    asked = ask(document("emptyNamespace", "ein Wert „ü“ \"q\""))
    reply = create_pseudonyms(asked, "document", catalog, store).first().reply
    stored = store.read().first()
    assert json.loads(reply) == {
        "resourceType": "Parameters",
        "parameter": [
            {"name": "namespace", "valueString": "emptyNamespace"},
            {"name": "originalValue", "valueString": "ein Wert „ü“ \"q\""},
            {"name": "pseudonymValue", "valueString": stored.pseudonym_value},
        ],
    }


def test_bad_requests_fail_alone(ask, store, catalog):
    asked = ask(
        None, "{not json", document("A", "x", kind="Patient"), document("A"), document(None, "x"), document("A", " \t"),
        document("nowhere", "x"), document("A", "NA"),
    )
    rows = create_pseudonyms(asked, "document", catalog, store).orderBy("id").collect()
    assert [r.status_code for r in rows] == [400, 400, 400, 400, 400, 400, 404, 200]
    assert [r.diagnostics for r in rows][:3] == ["Received malformed or missing resource"] * 3
    assert rows[6].diagnostics == "the namespace 'nowhere' could not be found."
    issue = json.loads(rows[5].reply)["issue"][0]
    assert issue["severity"] == "error" and "missing or blank" in issue["diagnostics"]
    assert [(r.namespace_name, r.original_value) for r in store.read().collect()] == [("A", "NA")]
    assert rows[7].pseudonym_value == store.read().first().pseudonym_value


def test_access_is_judged_before_the_namespace(spark, ask, catalog):
    rules = spark.createDataFrame([("A", [], ["w"], []), ("nowhere", [], ["w"], [])], RULE_SCHEMA)
    asked = ask(document("A", "x"), document("B", "x"), document("nowhere", "x"), document("closed", "x"))

    def codes(**caller):
        judged = judged_requests(asked, "document", catalog, rules, **caller)
        return [r.status_code for r in judged.orderBy("id").collect()]

    assert codes(roles=["w"]) == [200, 403, 404, 403]
    assert codes(roles=["boss"], admin_roles=["boss"]) == [200, 200, 404, 404]
    assert codes(roles=[]) == [403, 403, 403, 403]
    everywhere = rules.unionByName(spark.createDataFrame([("*", [], ["all"], [])], RULE_SCHEMA))
    judged = judged_requests(asked, "document", catalog, everywhere, roles=["all"])
    assert [r.status_code for r in judged.orderBy("id").collect()] == [200, 200, 404, 404]
