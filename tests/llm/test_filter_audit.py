"""The filter audit against filters applied one after the other in plain Python."""

import sys
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import helpers as H  # noqa: E402

from comarca.llm import filter_audit  # noqa: E402

LONG = "w" + " word%d" * 150


def fails(rows):
    """Per row: the letters of the filters that fail it."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = H.words(text)
        told = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text),
            any((t or "") == text and i is not None and doc is not None and i < doc for i, t, _ in rows),
        ]
        out.append({f for f, hit in zip("ABCDE", told) if hit})
    return out


def brute(rows, good, toxic):
    failed, out = fails(rows), []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        total, steps = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                total[letter] += len(gone)
                steps.append((
                    part, "".join(order), step, len(left), len(gone), sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


ROWS = [
    (1, None, "en"), (2, "", None), (3, "", "en"), (4, LONG % tuple(range(150)), "en"), (5, LONG % tuple(range(150)), "de"),
    (5, LONG % tuple(range(150)), "de"), (6, LONG % (("same",) * 0 + tuple([7] * 150)), "de"), (7, "ALL CAPITALS " * 80, "de"),
    (8, "a | b", ""), (None, "a | b", "en"), (None, None, "fr"), (9, "é" * 90 + "ABCDEFGHIJ", "fr"), (10, "x " * 100_000, "fr"),
    (11, "tab\tand\x0bvertical\x85next", "fr"), (12, "A" + "b" * 9, "fr"), (13, "AB" + "b" * 9, "fr"),
]
LABELS = [(1, 1, 0, "x"), (2, 0, 1, "x"), (4, 1, None, "x"), (5, None, 1, "x"), (5, 1, 0, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")]


def audited(spark, rows, labels):
    docs = spark.createDataFrame(
        [(*r, "s", 1, "b", 2.0) for r in rows], "doc_id long, text string, lang string, source string, mask int, digest string, n double"
    )
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.fail_masks(docs, marks)).collect())


def test_walk_holds_every_subset():
    cells = np.random.default_rng(0).integers(0, 50, (32, 2))
    states = filter_audit.walk(cells)
    for subset in range(32):
        assert (states[subset] == cells[[m for m in range(32) if not m & subset]].sum(0)).all()


def test_audit_equals_plain_filters(spark):
    good = {i for i, q, _, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in LABELS if t == 1 and i is not None}
    got = audited(spark, ROWS, LABELS)
    assert got == brute(ROWS, good, toxic)
    assert len(got) == 600 * 4  # en, de, fr and the empty part


def test_audit_empty_and_wrong(spark):
    assert audited(spark, [], LABELS) == []
    assert audited(spark, ROWS[:2], []) == brute(ROWS[:2], set(), set())
    with pytest.raises(ValueError):
        filter_audit.audit(spark.range(1), "AAB")
