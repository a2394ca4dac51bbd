"""Each operator against plain Python, on a small table and on odd rows."""

import hashlib
import json
import random
import re
import sys
import time
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import helpers as H  # noqa: E402

import corpus_pipeline  # noqa: E402
from comarca.llm import (  # noqa: E402
    boosting, licenses, line_dedup, mixing, near_dups, neighbours, pieces, pii, quality_model, quality_rules, url_filters,
)
from comarca.llm.frames import load  # noqa: E402
from comarca.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [(r[0], r[1]) for r in load(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- nearest neighbours -------------------------------------------------------------------------------------------


def best(rows, k, every):
    rows = {i: np.array(v, float) for i, v in rows}
    return {
        q: sorted(((-float(v @ rows[q]), i) for i, v in rows.items() if i != q))[:k] for q in rows if q % every == 0
    }


def test_neighbours_recall(spark):
    table = load(spark, FOLDER, "embeddings")
    want = best([(r["vec_id"], r["embedding"]) for r in table.collect()], 20, 20)
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert got.keys() == want.keys()
    hits = sum(len({x[1] for x in want[q]} & {x[2] for x in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for rows in got.values():
        rows = sorted(rows)
        assert [r[0] for r in rows] == list(range(1, 21)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("kind", ["equal", "outlier", "lognormal", "mild", "copies"])
def test_index_recall_whatever_the_lengths(kind):
    """At least 0.9 of the true neighbours from a share of each class, also where lengths differ."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4_000, 32))
    x /= np.sqrt((x**2).sum(1))[:, None]
    if kind == "outlier":
        x[17] *= 10
    elif kind in ("lognormal", "mild"):
        x *= np.exp((1.0 if kind == "lognormal" else 0.1) * rng.normal(size=4_000))[:, None]
    elif kind == "copies":
        x[1_000:] = x[np.arange(3_000) % 3]
    index, hits, seen = neighbours.Index(x, small=256), 0, 0
    asked = range(0, 4_000, 40)
    for q in asked:
        rows, products, verified = index.search(x[q], 20, np.arange(4_000) == q)
        assert q not in rows and np.allclose(products, x[rows] @ x[q], atol=1e-12)
        true = x @ x[q]
        true[q] = -np.inf
        hits += (np.sort(products)[::-1][:20] >= np.sort(true)[::-1][19] - 1e-12).sum()
        seen += verified
    assert hits >= 0.95 * 20 * len(asked)
    assert seen <= 0.6 * len(asked) * 4_000
    assert sum(len(c[1]) for c in index.classes) == 4_000


def test_neighbours_of_repeated_ids(spark):
    """Rows of one id count once, the smallest vector, however many they are and whatever their vectors."""
    rows = [(0, [1.0, 0.0])] * 300 + [(0, [0.5, 2.0])] + [(i, [float(i), 1.0]) for i in range(1, 5)]
    got = collect(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3))
    assert got == [(0, 1, 4, 4.0), (0, 2, 3, 3.5), (0, 3, 2, 3.0)]


def test_neighbours_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], "a"), (20, [0.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"),
        (3, None, "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"), (6, [None, 1.0], "a"),
        (7, [], "a"), (None, [1.0, 1.0], "a"), (8, [1.0, 2.0, 3.0], "a"), (9, [-1.0, 5.0], "a"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    assert collect(neighbours.nearest(table)) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, -1.0)]
    assert neighbours.nearest(table.limit(0)).collect() == []


# --- licenses ---------------------------------------------------------------------------------------------------


def test_automaton():
    spelled = lambda t: np.array([licenses.word_hash(w) for w in t.split()], np.uint64)
    machine = licenses.Automaton("a [[b [[c]]]] {{1-2}} d")
    for text, good in [("a x d", 1), ("a b x y d", 1), ("a b c x d", 1), ("a d", 0), ("a x y z d", 0), ("x a x d", 0)]:
        assert machine.accepts_at(spelled(text), 0, len(text.split())) == bool(good), text
    with pytest.raises(ValueError):
        licenses.Automaton("{{0-2}} a")
    with pytest.raises(ValueError):
        licenses.parse("[[a")


def test_license_odd_rows(spark):
    rows = [(1, None), (2, "Released under the MIT License. MIT license"), (3, "all rights reserved"), (4, "mit\nlicense ge")]
    got = collect(licenses.scan_licenses(H.documents(spark, rows)))
    assert got == [
        (1, 0, 0, None, None, "", "", 0.0), (2, 7, 2, 3, 5, "mit", "mit,mit-notice", 1.0),
        (3, 3, 0, None, None, "", "reserved", 1.0), (4, 3, 1, 0, 0, "mit", "mit", 0.5),
    ]
    assert licenses.scan_licenses(H.documents(spark, [])).collect() == []
    assert len(licenses.scan_licenses(H.documents(spark)).collect()) == len(H.ODD)


# --- quality classifier ---------------------------------------------------------------------------------------------


def test_machine_identity():
    rng = np.random.default_rng(0)
    x, v, w = rng.normal(size=(3, quality_model.SIZE)), rng.normal(size=(quality_model.SIZE, 2)), rng.normal(size=quality_model.SIZE)
    x[:, 40:] = 0
    pairs = [sum(v[i] @ v[j] * r[i] * r[j] for i in range(40) for j in range(i)) for r in x]
    assert np.allclose(quality_model.Machine(0.5, w, v).raw(x), 0.5 + x @ w + pairs)


def test_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality_classifier"](spark, folder).join(load(spark, folder, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_classifier_odd_rows(spark):
    docs = H.documents(spark)
    for labels in ([], [(1, 1, "x"), (2, None, "x"), (None, 0, "x"), (77, 0, "x"), (4, 0, "x"), (4, 1, "x")]):
        weights = quality_model.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"))
        assert len(quality_model.score_quality(docs, weights).collect()) == len(H.ODD)
    assert quality_model.score_quality(docs.limit(0), weights).collect() == []


def test_classifier_of_a_repeated_labelled_id(spark):
    """Rows that repeat a labelled id count once in the sample, whatever their number."""
    base = [(k, f"some words {k} of a text") for k in range(40)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    once = quality_model.train(docs(base), marks)
    assert np.allclose(quality_model.train(docs(base + [base[3]] * 3000), marks), once)
    assert len(quality_model.train(docs(base + [(3, f"other {k}") for k in range(3000)]), marks)) == len(once)


# --- near duplicates ------------------------------------------------------------------------------------------------


def test_near_duplicates(spark, small):
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(load(spark, FOLDER, "documents")).collect()}
    want = H.components(small)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(H.shingles(t)) for (i, t), r in ((x, got[x[0]]) for x in small))
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_of_one_text(spark):
    base = [f"w{k}" for k in range(150)]
    rows = []
    for n in range(120):  # edits of growing weight around one text: more than one chunk, some not linked
        w = list(base)
        for k in range(n % 12):
            w[(17 * n + 11 * k) % 150] = f"e{n}-{k}"
        rows.append((n, " ".join(w)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), chunk=16)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == H.components(rows)


def test_near_duplicates_odd_rows(spark):
    got = collect(near_dups.near_duplicates(H.documents(spark, [*H.ODD, (None, "a b")])).select("doc_id", "n_shingles", "component_id", "kept"))
    assert [r for r in got if r[0] in (1, 2, 3)] == [(i, 0, i, True) for i in (1, 2, 3)]
    assert [r for r in got if r[0] in (5, 6)] == [(5, 1, 5, True), (6, 1, 5, False)]
    # a row without an id is linked like others: it has the set of 5 and 6
    assert [r for r in got if r[0] is None] == [(None, 1, 5, False)] and len(got) == len(H.ODD) + 1
    assert near_dups.near_duplicates(H.documents(spark, [])).collect() == []


def test_links_of_ids_with_several_texts(spark):
    """An id of two texts holds the links of both; rows without an id link what they are near to."""
    a, b, c, d = ([f"{x}{k}" for k in range(60)] for x in "abcd")
    rows = [
        (5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*a, "more"])), (10, " ".join([*b, "more"])),
        (20, " ".join([*c, "one"])), (None, " ".join(c)), (21, " ".join(["one", *c])), (None, " ".join(d)), (None, " ".join([*d, "z"])), (30, ""),
    ]
    got = collect(near_dups.near_duplicates(H.documents(spark, rows)).select("doc_id", "component_id", "kept"))
    assert got == collect(spark.createDataFrame(
        [(5, 5, True), (5, 5, True), (9, 5, False), (10, 5, False), (20, 20, True), (None, 20, False), (21, 20, False),
         (None, None, True), (None, None, True), (30, 30, True)], "doc_id long, component_id long, kept boolean"))
    left = collect(near_dups.drop_near_duplicates(H.documents(spark, rows)).select("doc_id", "text"))
    assert [r for r in left if r[0] is not None] == [(20, rows[4][1]), (30, ""), *[r for r in left if r[0] == 5]]
    assert sum(r[0] == 5 for r in left) == 1
    assert [r[1] in (rows[7][1], rows[8][1]) for r in left if r[0] is None] == [True]


def test_drop_near_duplicates_leaves_columns_alone(spark):
    docs = spark.createDataFrame(
        [(1, "some words here", 7, "a", 0.5, 3), (2, "some words here", 8, "b", 1.5, 4), (3, "others", 9, "c", 2.5, 5)] * 2,
        "doc_id long, text string, _row int, _ID string, `_hash` double, `n` int",
    )
    got = near_dups.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert collect(got) == [(1, "some words here", 7, "a", 0.5, 3), (3, "others", 9, "c", 2.5, 5)]


def test_estimate():
    rng = np.random.default_rng(3)
    for same in (0.2, 0.6, 0.9):
        both, rest = int(2000 * same), 2000 - int(2000 * same)
        x = rng.integers(0, 1 << 63, both + 2 * rest).astype(np.uint64)
        a, b = x[: both + rest], np.concatenate((x[:both], x[both + rest :]))
        ra, rb = near_dups.registers(a), near_dups.registers(b)
        guess = near_dups.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([len(a)]), np.array([len(b)]))
        assert abs(guess[0] - both / (both + 2 * rest)) < 0.15
        assert (np.maximum(ra, rb) == near_dups.registers(np.union1d(a, b))).all()
        assert (near_dups.sketches([a, b]) == np.stack([ra, rb])).all()


def test_drop_near_duplicates_keeps_one_row(spark):
    long = [f"w{k}" for k in range(100)]
    rows = [
        (5, " ".join(long)), (9, " ".join([*long, "x"])), (7, "other text here"), (7, "quite another one"), (None, " ".join(long)),
        (None, "only without id"), (None, "only without id"), (None, "Only  without id"), (3, ""), (4, ""), (None, ""), (2, None),
    ]
    got = collect(near_dups.drop_near_duplicates(H.documents(spark, rows + rows)).select("doc_id", "text"))
    assert [r for r in got if r[0] == 5] == [rows[0]] and not [r for r in got if r[0] == 9]
    assert sum(r[0] == 7 for r in got) == 1
    assert sum(r[0] is None and r[1] != "" for r in got) == 1 and sum(r == (None, "") for r in got) == 1
    assert [r[0] for r in got if r[0] in (2, 3, 4)] == [2, 3, 4]
    small = [(r["doc_id"], r["text"]) for r in load(spark, FOLDER, "documents").collect()]
    docs = load(spark, FOLDER, "documents")
    want = H.components(small, 80, 5)
    got = near_dups.drop_near_duplicates(docs.unionByName(docs), shingle=5, percent=80)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(r for r in small if want[r[0]] == r[0])


# --- personal data ---------------------------------------------------------------------------------------------------


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[ -]", "", m[0])]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@pytest.mark.parametrize("text", [
    "a@b.c@d.e x@y @z.w a@@b.c %@a.b-", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111-1111 1111 41111111111111112",
    "+1 (555) 555-0100+49 30 1234567 +1 2", "joe@mail.example.com.", "1.2.3", "ÄÖ é@x.y 漢a@b.cd",
])
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = dict((r[0], r[1]) for r in load(spark, folder, "documents").select("doc_id", "text").collect())
    for r in QUERIES["op5_personal_data"](spark, folder).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(r["spans"].split(","))


def test_pii_odd_rows(spark):
    docs = H.documents(spark)
    got = {r["doc_id"]: r for r in pii.find_pii(docs, pii.train(docs)).collect()}
    assert got[1]["spans"] == "" and got[9]["n_email"] == got[9]["n_phone"] == 1
    assert got[9]["redacted"].endswith("mail me at [email] or [phone]")
    assert pii.find_pii(docs.limit(0), pii.train(docs.limit(0))).collect() == []
    assert pii.mask("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[ip]f"


@pytest.fixture(scope="module")
def trees(spark):
    """A model of the test corpus, and one of an empty table."""
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    return [json.loads(pii.train(d)) for d in (docs, docs.limit(0))]


@pytest.mark.parametrize("before, value, after, kind", [
    ("write to ", "joe (at) example dot com", " now", "email"), ("", "jane.doe[at]mail.example[dot]org", ". Thanks", "email"),
    ("call ", "0049 30 1234567", "", "phone"), ("Phone: ", "(212) 555-0187", " or write", "phone"),
    ("password=", "Abc123xyzQwerty9988", "", "secret"), ("token ", "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8", " end", "secret"),
    ("key: ", "Zk9" * 61, " end", "secret"), ("the host ", "2001:db8::1", " answers", "ip"),
    ("card ", "4111.1111.1111.1111", " paid", "card"),
])
def test_added_spans(trees, before, value, after, kind):
    text = before + value + after
    for model in trees:
        assert pii.added_spans([text], [pii.base_spans(text)], model) == [[(kind, len(before), len(before) + len(value))]]


@pytest.mark.parametrize("text", [
    "on 2021-03-14 at 12:30:45 version 10.2.3", "state-of-the-art and well-thought-out-designs", "a run of 1,234,567,890 rows",
    "look at the small-scale picture", "Internationalisation", "isbn 978-3-16-148410-0", "order 4111.1111.1111.1112", "",
])
def test_look_alikes_stay(trees, text):
    for model in trees:
        assert pii.added_spans([text], [pii.base_spans(text)], model) == [[]]


def test_pii_long_text(trees):
    text = "mail joe@example.com or joe (at) example dot com " * 20_000
    begin = time.time()
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], trees[0])[0]
    assert len(base) == len(added) == 20_000 and time.time() - begin < 30
    run = "a" * 1_000_000
    assert [s[1:] for s in pii.candidates(run)] == [(0, len(run))]
    spans = [("email", 0, 5), ("ip", 3, 9), ("card", 20, 30)]
    assert pii.uncovered([("phone", 5, 7), ("phone", 9, 20), ("secret", 10, 21), ("secret", 30, 31)], spans) == [("phone", 9, 20), ("secret", 30, 31)]
    for k in range(300):  # chosen spans never overlap, and nothing that passes is left without a conflict
        rng = np.random.default_rng(k)
        many = sorted({("ip", int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 20), rng.integers(1, 9, 20))})
        took = pii.chosen(many, rng.random(len(many)), [0.3] * 5)
        assert all(x[2] <= y[1] for x, y in zip(sorted(took), sorted(took)[1:]))


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:500], y[:500])
    scores = boosting.predict(model, x[500:])
    assert ((scores > 0.5) == y[500:]).mean() > 0.9
    assert (y[500:][scores >= boosting.calibrated_cut(scores, y[500:], 0.98)]).mean() >= 0.98
    assert boosting.calibrated_cut(np.array([0.5, 0.5]), np.array([1.0, 0.0]), 0.9) == 2.0


def test_boosting_of_a_table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 4)).round(2).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<float>, y int").repartition(3).persist()
    want = boosting.predict(boosting.fit(x, y.astype(float), rounds=7), x)
    for small in (0, 1000):  # histograms of all tasks, and one task; the margins are written down once in between
        model = boosting.fit_frame(rows, 4, rounds=7, small=small)
        assert np.abs(boosting.predict(model, x) - want).max() < 1e-5
    for y in (0, 1):
        assert boosting.fit_frame(rows.where(F.col("y") == y), 4, small=0)["trees"] == []
    assert boosting.fit_frame(rows.limit(0), 4) == {"start": 0.0, "trees": []}
    kinds = spark.createDataFrame([([0.0], 1)] * 99 + [([0.0], 0)] + [([1.0], 0)] * 3, "x array<float>, y int")
    cuts = boosting.calibrated_cuts(kinds, {"start": 2.0, "trees": [[0, 0.5, 1.0, 0.5]]}, 3)
    assert cuts[0] == pytest.approx(1 / (1 + np.exp(-3))) and cuts[1:] == [2.0, 2.0]


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 2)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghXYZ0123456789") for _ in range(rng.randint(16, 30)))
    docs = [(i if i % 7 else None, " ".join(word() for _ in range(110))) for i in range(200)]
    labels = {}
    for i, t in docs:
        key = f"{i}:{hashlib.sha256(t.encode()).hexdigest()}"
        own = random.Random(key)
        labels |= {f"{key}:{k}": y for k, (_, y) in enumerate([r for _ in range(pii.PLANTED) for r in pii.planted(t, own)])}
        labels |= {f"{key}:{c}": pii.evidence(t, *c) for c in pii.uncovered(pii.candidates(t), pii.base_spans(t))}
    assert len(labels) > 22_000
    own = random.Random(0)
    plain = [y for _ in range(pii.EXAMPLES) for _, y in pii.planted("the text goes on here " * 3, own)]
    fitted = [y for k, y in labels.items() if hashlib.sha256(k.encode()).digest()[0] % 5] + [y for k, y in enumerate(plain) if k % 5]
    share = (sum(fitted) + 1) / (len(fitted) + 2)
    for rows in (docs, docs + docs[:50]):  # repeated rows count once
        model = json.loads(pii.train(H.documents(spark, rows)))
        assert model["start"] == pytest.approx(np.log(share / (1 - share)), abs=1e-12) and len(model["trees"]) == 2


# --- url filters ---------------------------------------------------------------------------------------------------


def test_url_patterns(spark):
    assert url_filters.tokens_of("^utm_source=") == ["utm", "source"]
    assert url_filters.tokens_of("||casino*.example.org^") == ["example", "org"]
    assert url_filters.tokens_of("*ab*cd/ef") == ["ef"] or url_filters.tokens_of("*ab*cd/ef") == []
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?utm_source=a"), (5, "x://a.example.com/en/"),
        (6, "http://a.net/fr/?p"), (7, "http://a.de/b?utm_source=f"), (7, "http://a.de/b?utm_source=f"), (8, "http://b.example.org/?utm_source=f"),
        (9, "http://com"), (None, "http://ads.x.de/"),
    ]
    table = spark.createDataFrame([(i, u, "y") for i, u in rows], "page_id long, url string, host string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(table).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (5, "a.example.com", "/en/", "example.com/en/", "block"),
        (6, "a.net", "/fr/", "net/fr/", "block"), (7, "a.de", "/b", None, "block"), (8, "b.example.org", "/", None, "allow"),
        (9, "com", "", None, "allow"), (None, "ads.x.de", "/", None, "block"),
    }
    assert url_filters.judge_urls(table.limit(0)).collect() == []
    with pytest.raises(ValueError):
        url_filters.judge_urls(table, patterns=[("block", "*a*")]).collect()


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_pfair_deviation():
    blocks, weights = {"a": 40, "b": 13, "c": 7, "d": 1}, {"a": 5, "b": 3, "c": 2, "d": 1}
    order = {}
    for s, first, end, begin, w, period, places in mixing.phases(blocks, weights):
        for j in range(end - first):
            order[begin + j // w * period + places[j % w]] = s
    assert sorted(order) == list(range(sum(blocks.values())))
    done, left, at, shares = dict.fromkeys(blocks, 0), dict(blocks), 0, None
    for t in sorted(order):
        live = {s for s, n in left.items() if n}
        if live != shares:
            shares, at, done = live, 0, dict.fromkeys(blocks, 0)
        done[order[t]] += 1
        left[order[t]] -= 1
        at += 1
        total = sum(weights[s] for s in shares)
        assert all(abs(done[s] - at * weights[s] / total) < 1 for s in shares)


def test_mix(spark, small):
    got = mixing.mix_report(load(spark, FOLDER, "documents"), block_rows=4, bucket_rows=20).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in small)
    assert len({(r["slot"], r["seat"]) for r in got}) == len(got)
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    docs = H.documents(spark).unionByName(H.documents(spark, [(None, "t")]).replace("s", None, subset=["source"]))
    assert len(mixing.mix_sources(docs).collect()) == len(H.ODD) + 1
    assert mixing.mix_report(docs.limit(0)).collect() == []


def plain_mix(counts, weights):
    """Source of each slot by looking at every source in every slot, exact fractions throughout."""
    left, behind, out = {s: n for s, n in counts.items() if n}, {s: Fraction(0) for s in counts}, []
    while left:
        total, done, owed = sum(weights[s] for s in left), dict.fromkeys(left, 0), dict(behind)
        t = 0
        while min(left[s] - done[s] for s in left) > 0:
            ready = [s for s in left if done[s] * total // weights[s] <= t]
            best = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), -owed[s], s))
            out.append(best)
            done[best] += 1
            t += 1
        for s in list(left):
            behind[s] += Fraction(t * weights[s], total) - done[s]
            left[s] -= done[s]
            if not left[s]:
                del left[s]
    return out


def slots_of(found):
    return {
        begin + j // w * period + places[j % w]: s for s, first, end, begin, w, period, places in found for j in range(end - first)
    }


def test_phases_equal_a_plain_schedule():
    rng = np.random.default_rng(3)
    for _ in range(40):
        names = [f"s{k}" for k in range(int(rng.integers(1, 6)))]
        counts = {s: int(rng.integers(0, 40)) for s in names}
        weights = {s: int(2 ** rng.integers(0, 4)) for s in names}
        got = slots_of(mixing.phases(counts, weights))
        assert [got[t] for t in range(len(got))] == plain_mix(counts, weights)


def test_many_sources():
    counts = {f"host{k}": 3 + k % 7 for k in range(5000)}
    begin = time.time()
    got = slots_of(mixing.phases(counts, dict.fromkeys(counts, 1)))
    assert sorted(got) == list(range(sum(counts.values()))) and time.time() - begin < 60
    firsts = [got[t] for t in range(15000)]  # every host has three blocks at least, so each has had three by then
    assert set(np.unique(firsts, return_counts=True)[1]) == {3}


def test_weights_are_exact():
    assert mixing.whole_weights({"a": 0.0004, "b": 1}) == {"a": 1, "b": 2500}
    assert mixing.whole_weights({"a": Fraction(1, 997), "b": Fraction(1, 991)}) == {"a": 991, "b": 997}
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 0})
    with pytest.raises(ValueError):
        mixing.phases({"a": 900, "b": 900}, {"a": 10**12 + 1, "b": 10**12 - 1}, most=1000)
    assert len(slots_of(mixing.phases({"a": 900, "b": 9}, {"a": 10**12 + 1, "b": 3}))) == 909


def test_mix_rows_equal_a_plain_mix(spark, small):
    docs = load(spark, FOLDER, "documents")
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "text", F.lit(0)).alias("h")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: ((r["h"] % 2**64 >> 8) % 50, r["h"], r["doc_id"])):
        by.setdefault(r["source"], []).append(r["doc_id"])
    counts = {s: -(-len(x) // 4) for s, x in by.items()}
    want, used = [], dict.fromkeys(by, 0)
    for s in plain_mix(counts, {s: mixing.TARGETS.get(s, 1) for s in by}):
        want += by[s][4 * used[s] : 4 * used[s] + 4]
        used[s] += 1
    bucket_rows = -(-len(rows) // 50)
    assert -(-len(rows) // bucket_rows) == 50
    got = [r["doc_id"] for r in mixing.mix_sources(docs, block_rows=4, bucket_rows=bucket_rows).collect()]
    assert got == want
    report = mixing.mix_report(docs, block_rows=4, bucket_rows=bucket_rows).orderBy("slot", "seat").collect()
    assert [r["doc_id"] for r in report] == want


def test_mix_leaves_columns_alone(spark):
    docs = spark.createDataFrame([(k, f"t{k}", f"s{k % 3}", k, k, k) for k in range(50)], "doc_id long, text string, source string, _hash int, _slot int, row int")
    got = mixing.mix_sources(docs)
    assert got.columns == docs.columns and sorted(got.collect()) == sorted(docs.collect())


def test_mix_of_a_hot_id(spark):
    docs = spark.createDataFrame([(None if k % 3 else k, f"t{k}", "s") for k in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix_report(docs, bucket_rows=100).collect()
    assert len({(r["slot"], r["seat"]) for r in got}) == len(got) == 3000


# --- lines ----------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, small):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(load(spark, FOLDER, "documents"), min_words=3, letters=False).collect()}
    assert got == H.kept_lines(small)


def test_line_dedup_edits(spark):
    line = "a b c d e f g h i j".split()
    rows = [(5, " ".join(line)), (6, "x y z\nx  y z\nx y\nx y")]
    rows += [(10 + k, " ".join(line[:k] + ["Q"] + line[k + 1 :])) for k in range(10)]
    rows += [(30 + k, " ".join(line[:k] + line[k + 1 :])) for k in range(10)] + [(50, " ".join([*line, "new", "words"]))]
    rows += [(60, "b a c d e f g h i j"), (4, " ".join([*line, "new"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_words=3, letters=False).collect()}
    assert got == H.kept_lines(rows)


def test_line_dedup_odd_rows(spark):
    docs = H.documents(spark, [*H.ODD, (None, "some words of a null id"), (70, "some words of a null id")])
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(H.ODD) + 2
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["text"] == "" and by[3]["text"] == " \n\t"
    assert by[None]["text"] == "some words of a null id" and by[70]["text"] == "" and by[70]["n_removed"] == 1
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_line_dedup_of_ids_with_several_texts(spark):
    rows = [(8, "one line of its own here\nshared words of two"), (8, "shared words of two\nanother line that stays"), (9, "shared words of twos")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"] for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted("\n".join(got).split("\n")) == ["", "another line that stays", "one line of its own here", "shared words of two"]
    again = [r["text"] for r in line_dedup.dedup_lines(docs.repartition(3)).collect()]
    assert sorted(again) == sorted(got)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_line_dedup_of_a_hot_id(spark, doc_id):
    """A third of the rows share one id: each keeps its own lines, and no row carries those of others."""
    word = lambda r, k: hashlib.md5(f"{r}/{k}".encode()).hexdigest()
    rows = [(doc_id if r % 3 == 0 else 1000 + r, "\n".join(word(r, k) for k in range(5))) for r in range(600)]
    rows.append((5000, rows[0][1] + "\n" + word(1, 0) + "x\nlast"))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] != 5000) == sorted(t for _, t in rows[:-1])
    assert [r["text"] for r in got if r["doc_id"] == 5000] == ["last"]


def test_line_dedup_leaves_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a b c\nd", 1, 2, 3, 4)], "doc_id long, text string, _id int, row int, kept int, N_lines int")
    got = line_dedup.dedup_lines(docs).collect()[0].asDict()
    assert got == {"doc_id": 1, "text": "a b c\nd", "_id": 1, "row": 2, "kept": 3, "n_lines": 2, "n_removed": 0}
    names = ("lines", "removed")
    assert line_dedup.dedup_lines(docs, counts=names).columns == [*docs.columns, *names]
    kept = corpus_pipeline.drop_lines(spark, docs, "").collect()[0]
    assert kept["N_lines"] == 4 and kept["_id"] == 1


def whole_lines(rows, near_words=8):
    """Plain version of all of line dedup: every line that holds a word; short ones by characters."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((t or "").split("\n")):
            first.setdefault(tuple(H.words(line)), (i, no))

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    def near(a, b):
        short = min(len(a), len(b)) < near_words
        return one_edit(" ".join(a), " ".join(b)) if short else one_edit(a, b)

    lines = [w for w in first if w]
    gone = {a for a in lines for b in lines if first[b] < first[a] and near(a, b)}
    out = {}
    for i, t in rows:
        at = [(no, line, tuple(H.words(line))) for no, line in enumerate((t or "").split("\n"))]
        kept = [line for no, line, w in at if not w or (first[w] == (i, no) and w not in gone)]
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_line_dedup_of_short_lines(spark):
    rng = np.random.default_rng(5)
    rows = [
        (1, "Les.\nErheed. Titionly.\n\nAre is anwh reenen."), (2, "Les.\nAre, is anwh reenen.\nErheed.  Titionly.\nErheed. Titionlyx."),
        (3, "a b c d e f g\nÄb 漢字\n😀"), (4, "a bc d e f g\na b c d e f gh\nÄb 漢\nÄb 漢子\nb"), (5, "c1 c2 c3 c4 c5 c6 c7c8\n\n 😀x"),
        (6, "c1 c2 c3 c4 c5 c6 c7 c8\na b c d e f h\nb a c d e f g\na\nab\nabc\nxabc"), (7, None), (8, ""), (9, "a c"),
    ]
    for k in range(60):  # every place of an edit, in lines of one to five characters and of some words
        lines = ["".join(rng.choice(list("abé漢 "), rng.integers(1, 6))) for _ in range(4)]
        base = list("one two three four")
        base[int(rng.integers(len(base)))] = str(rng.choice(list("xyz")))
        rows.append((100 + k, "\n".join([*lines, "".join(base), "".join(base[k % 18 :]) + str(k % 7)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, **line_dedup.WHOLE).collect()}
    assert got == whole_lines(rows)
    assert got[2] == "" and line_dedup.dedup_lines(docs.limit(0), **line_dedup.WHOLE).collect() == []


def test_line_dedup_query_is_whole(spark, small):
    got = {r["doc_id"]: r["text"] for r in QUERIES["op8_line_dedup"](spark, FOLDER).collect()}
    assert got == whole_lines(small)


# --- pieces ---------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, small):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = [*H.ODD, (None, "null id"), (40, " a  b\nc\t x 12é　漢😀 ▁ "), (41, "ab" * 400), (42, "\n\n"), (43, "  "), (44, "a\x7f߿ࠀ￿𐀀b ߿ࠀ￿")]
    # few dictionary words, so that most pass as rare ones
    for rows, most in ((small, pieces.DICTIONARY), (odd, 3)):
        encoded = pieces.encode(H.documents(spark, rows), dictionary=most)
        got = [(r["doc_id"], r["ids"], r["round_trip"], r["decoded"]) for r in pieces.decode(encoded).collect()]
        want = [(i, model.encode(t or ""), True, (t or "").replace("▁", " ")) for i, t in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert pieces.encode(H.documents(spark, [])).collect() == []


def test_folds(spark):
    table = [("ab", 1, -1.0), ("bc", 2, -3.0), ("abc", 3, -2.0), ("a", 4, -5.0), ("b", 5, -5.0), ("c", 6, -0.5)]
    model = spark.createDataFrame(table, "piece string, id int, score double")
    words = spark.createDataFrame([("abc",), ("bcb",), ("abx",)], "word string").repartition(2, "word")
    rows = pieces.lattice(words, ["word"], model, 3)
    assert {r["word"]: r["cuts"] for r in pieces.fold_merges(rows).collect()} == {"abc": [0], "bcb": [0, 2], "abx": [0, 2]}
    assert {r["word"]: r["cuts"] for r in pieces.fold_viterbi(rows).collect()} == {"abc": [0, 2], "bcb": [0, 2], "abx": [0, 2]}


# --- quality rules --------------------------------------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    w = H.words(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += line in seen and bool(H.words(line))
        seen.add(line)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
    base = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(repeated), base


def test_quality_rules(spark, small):
    docs = H.documents(spark, [*((i + 100, t) for i, t in small), *H.ODD])
    rows = quality_rules.quality_rules(docs).collect()
    want = sorted([(i + 100, *plain_rules(t)) for i, t in small] + [(i, *plain_rules(t)) for i, t in H.ODD])
    assert sorted(tuple(r)[:7] for r in rows) == want
    assert all(r["kept"] is False for r in rows if r["base_failed"])
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []
    assert not quality_rules.within_bands(5000, 0.02, 0.02) and quality_rules.within_bands(5000, 0.45, 0.47)


def test_quality_rules_noise_inside_long_text(spark, small):
    import base64

    rng = np.random.default_rng(2)
    prose = "\n".join(t for _, t in small if t and quality_rules.dup_lines(t) == 0)[:40_000]
    noise = base64.b64encode(rng.bytes(20_000)).decode()
    rows = [(1, prose[:30_000])]
    rows += [(2 + k, prose[:at] + noise[:n] + prose[at:end]) for k, (n, at, end) in enumerate([(15_000, 9000, 15_000), (4096, 5001, 26_000), (4096, 0, 3000)])]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(H.documents(spark, rows)).collect()}
    assert got[1]["kept"] and [got[i]["kept"] for i in (2, 3, 4)] == [False] * 3
    assert not any(r["base_failed"] for r in got.values()) and got[2]["ratio"] < 0.7


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, small):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(set(ids)) == len(ids) and set(ids) <= {i for i, _ in small} and all(r["round_trip"] for r in rows)


def test_stages_odd_rows(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = H.documents(spark).select(columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).collect() == [], name
        got = stage(spark, docs, FOLDER)
        assert got.count() <= len(H.ODD)
        if name != "sentencepiece":
            assert got.columns == columns
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, H.documents(spark, [(1, "a b c\nd"), (2, "a b c"), (3, None)]), "").collect()}
    assert cut == {1: "a b c\nd", 3: None}
