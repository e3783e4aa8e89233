import random

import pytest

from pseudospark.operators import access
from pseudospark.schemas import RULE_SCHEMA

ROLES = [f"r{i}" for i in range(6)]


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULE_SCHEMA)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def allowed(df, rule_rows, roles, permission, **options):
    return sorted(r.name for r in access.accessible(df, "name", rule_rows, roles, permission, **options).collect())


def test_wildcard_grants_reading_everywhere_but_no_writing(spark):
    given = rules(spark, ("*", ["global-read"], [], []))
    both = names(spark, "ns1", "any-other-namespace")
    assert allowed(both, given, ["global-read"], "read") == ["any-other-namespace", "ns1"]
    assert allowed(both, given, ["global-read"], "write") == []


def test_reading_does_not_allow_reverse_lookup(spark):
    given = rules(spark, ("ns1", ["ns1-read"], None, ["ns1-reverse-lookup"]))
    both = names(spark, "ns1", "ns2")
    assert allowed(both, given, ["ns1-read"], "read") == ["ns1"]
    assert allowed(both, given, ["ns1-read"], "reverse_lookup") == []
    assert allowed(both, given, ["ns1-reverse-lookup"], "reverse_lookup") == ["ns1"]
    assert allowed(both, given, [], "read") == []


def test_admins_and_disabled_access_control(spark):
    given = rules(spark)
    one = names(spark, "ns1")
    assert allowed(one, given, ["boss"], "write", admin_roles=["boss"]) == ["ns1"]
    assert allowed(one, given, ["boss"], "write") == []
    assert allowed(one, given, [], "write", enabled=False) == ["ns1"]


def test_effective_roles(spark):
    given = rules(
        spark,
        ("*", ["b", "a"], None, ["x"]),
        ("ns1", ["a", "Z"], ["w"], []),
        ("ns1", ["c"], ["w", "v"], None),
        ("gone", ["q"], [], []),
    )
    got = {r.name: tuple(map(tuple, r[1:])) for r in access.effective_roles(names(spark, "ns1", "ns2"), given).collect()}
    assert got == {"ns1": (("Z", "a", "b", "c"), ("v", "w"), ("x",)), "ns2": (("a", "b"), (), ("x",))}
    empty = access.effective_roles(names(spark, "ns1"), rules(spark)).first()
    assert [list(c) for c in empty[1:]] == [[], [], []]


@pytest.mark.parametrize("seed", range(4))
def test_jobs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    spaces = ["n0", "n1", "n2", "n3"]

    def some(values, k):
        return rng.sample(values, rng.randint(0, k))

    given = [(rng.choice([*spaces, "*"]), some(ROLES, 2), some(ROLES, 2), some(ROLES, 2)) for _ in range(4)]
    jobs = [(i, rng.randint(0, 1), [("c", None, s) for s in some(spaces, 3)], some([*ROLES, "admin"], 3)) for i in range(60)]
    df = spark.createDataFrame(
        jobs,
        "id int, direction int,"
        " column_mappings array<struct<source_column string, target_column string, namespace string>>, roles array<string>",
    )
    expected = set()
    for i, direction, mapped, roles in jobs:
        if "admin" in roles:
            continue
        for _, _, space in mapped:
            granted = {role for r in given if r[0] in ("*", space) for role in r[2 + direction]}
            if not granted & set(roles):
                expected.add((i, space, "reverse_lookup" if direction else "write"))
    got = access.denied_job_namespaces(df, rules(spark, *given), ["admin"]).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
