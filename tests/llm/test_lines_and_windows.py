"""Line dedup and decontamination against brute force."""

import hashlib
import random
import re

import pytest

from pseudospark.llm.decontamination import GRAM, WINDOW, contamination
from pseudospark.llm.line_dedup import without_repeated_lines


def test_repeated_windows(spark, workspace):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " ", "cc"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    seen, gone = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if "".join(window).strip(" "):
                if window in seen:
                    gone.setdefault(i, set()).update(range(at, at + 3))
                seen.add(window)
    found = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), workspace).collect()
    assert len(found) == len(rows)
    for r in found:
        lines = r.text.split("\n")
        assert r.removed_lines == sorted(gone.get(r.doc_id, ())), r.doc_id
        assert r.deduplicated == "\n".join(x for k, x in enumerate(lines) if k not in gone.get(r.doc_id, ()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_rows_of_lines(docs, no_docs, workspace, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("pseudospark.llm.line_dedup.BROADCAST_BYTES", -1)
    found = without_repeated_lines(docs, workspace).collect()
    assert len(found) == docs.count() and found[0].score == 0.5
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[7].removed_lines == [1, 2, 3, 4] and by_id[7].deduplicated == "intro\noutro"
    assert by_id[6].removed_lines == [] and by_id[3].deduplicated is None and by_id[3].line_count == 0
    assert without_repeated_lines(no_docs, workspace).count() == 0


def words(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(WINDOW, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in range(1, WINDOW + 1):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        yield id, len(w), sorted(hit), sorted(str(f) for f in found if f is not None)


def test_every_window_is_found(spark, workspace):
    """Texts over few words, so that fingerprints tie and windows overlap; items shorter than a window and than a gram."""
    rng = random.Random(8)
    few, many = ["A", "b", "é"], [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(few, k=n))) for i, n in enumerate([0, 9, 10, 11, 14, 7])]
    items += [(100 + i, ", ".join(rng.choices(many, k=n))) for i, n in enumerate([1, GRAM - 1, GRAM, 9, 10, 15, 40])]
    items += [(200, items[-1][1]), (None, items[-2][1]), (201, None), (202, "?!")]
    docs = [(i, " ".join(rng.choices(few, k=rng.randrange(40)))) for i in range(40)]
    for i in range(60):
        w = rng.choices(many, k=rng.randrange(60))
        part = (rng.choice(items)[1] or "").split(", ")
        at, first = rng.randrange(len(w) + 1), rng.randrange(max(1, len(part) // 2))
        docs.append((100 + i, " ".join(w[:at] + part[first : first + rng.randrange(1, 30)] + w[at:])))
    found = contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        workspace,
    ).collect()
    got = sorted((r.doc_id, r.n_words, r.hit_words, r.item_ids) for r in found)
    assert got == sorted(brute_force(docs, items))
    assert all(r.n_hit == len(r.hit_words) for r in found)


def test_odd_rows_of_windows(spark, docs, no_docs, workspace):
    items = spark.createDataFrame([(1, "four five six"), (2, None)], "item_id long, text string")
    found = contamination(docs, items, workspace).collect()
    assert len(found) == len({(r.doc_id, r.text) for r in docs.collect()})
    assert {r.doc_id for r in found if r.n_hit} == {1, 2}
    assert {r.n_words for r in found if r.doc_id in (3, 4, 5)} == {0}
    assert contamination(docs, items.limit(0), workspace).where("n_hit > 0").count() == 0
    assert contamination(no_docs, items, workspace).count() == 0
    assert hashlib.sha256(b"").hexdigest()  # the digest of no items, as the query gives it
