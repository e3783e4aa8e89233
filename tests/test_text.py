import pytest
from pyspark.sql import functions as F

from pseudospark.functions.text import is_blank, is_missing

# Tab to carriage return, next line, and the Unicode separators.
CODES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES = "".join(map(chr, CODES))


def expected(value, placeholders):
    if value is None:
        return True
    trimmed = value.strip(SPACES)
    return trimmed == "" or any(trimmed.lower() == p.lower() for p in placeholders)


VALUES = [
    None, "", " ", SPACES, "x", "NA", "na", " Na\t", " null　", "NULL", "NULLX", "XNULL", "N", "n", "NA NA",
    "0", "!", "~", "\x7f", "é", "​", "O", "o", "M", "m", "nul", "N/A", "-", "a b", "kK", "\U0001f477",
    "Nancy", "  Nancy", "null and void", "\x1c",
]


@pytest.mark.parametrize(
    "placeholders", [("NA", "NULL"), (), ("N/A",), ("-", ".", "?"), (" x ",), ("é",), ("(none)", "[x]")]
)
def test_missing(spark, placeholders):
    usable = [p for p in placeholders if p == p.strip()]
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for row in df.select("v", is_missing(F.col("v"), placeholders).alias("m")).collect():
        assert row.m == expected(row.v, usable), repr(row.v)


def test_blank(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for row in df.select("v", is_blank(F.col("v")).alias("b")).collect():
        assert row.b == expected(row.v, ()), repr(row.v)


def test_own_placeholders_replace_the_default(spark):
    df = spark.createDataFrame([("NA",), ("N/A",)], "v string")
    assert [r[0] for r in df.select(is_missing(F.col("v"), ("N/A",))).collect()] == [False, True]


def test_packed_texts_come_back(spark):
    """Digests take half the room while they are moved, whatever stands around them."""
    from pseudospark.functions.text import packed, unpacked

    digest = "0123456789ABCDEF" * 4
    texts = [None, "", "ä-" + digest + "\n-t", digest + "A", digest.lower(), digest[:15], digest + "😀" + digest, "x", "😀" + digest]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    back = rows.select("i", "t", packed(F.col("t")).alias("p")).select("i", "t", "p", unpacked(F.col("p")).alias("u"))
    found = back.orderBy("i").collect()
    assert [r.u for r in found] == texts
    assert len(found[2].p.run) == 32 and not found[4].p.run
