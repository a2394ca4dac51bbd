"""Language identification against a plain version with dictionaries, and on held-out documents."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from comarca.llm import language_id
from comarca.llm.frames import load
from comarca.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return regex.findall(r"[\p{L}\p{M}]+", (text or "").lower())


def grams(word, n):
    padded = f" {word} "
    return [g for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) != " "]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 4 == 2


class Plain:
    def __init__(self, rows):
        self.n = defaultdict(Counter)
        for doc, text, lang in rows:
            if lang is not None and not held(doc):
                for w in words(text):
                    self.n[lang, 0][w] += 1
                    for size in range(1, 6):
                        for g in grams(w, size):
                            self.n[lang, size][g] += 1
        self.langs = sorted({k[0] for k in self.n})
        self.sum = {k: sum(c.values()) for k, c in self.n.items()}

    def cost(self, lang, kind, item):
        n = self.n[lang, kind][item]
        return min(-math.log10(n / self.sum[lang, kind]), 7.0) if n else 7.0

    def judge(self, text):
        found = words(text)
        if not found or not self.langs:
            return "und", 0.0
        total = dict.fromkeys(self.langs, 0.0)
        for w in found:
            if any(self.n[lang, 0][w] for lang in self.langs):
                kind, items = 0, [w]
            else:
                for kind in range(5, 0, -1):
                    items = [g for g in grams(w, kind) if any(self.n[lang, kind][g] for lang in self.langs)]
                    if items:
                        break
            for lang in self.langs:
                total[lang] += sum(self.cost(lang, kind, i) for i in items) / len(items) if items else 7.0
        mean = {lang: t / len(found) for lang, t in total.items()}
        best = min(self.langs, key=lambda lang: (round(mean[lang], 9), lang))
        return best, 1 / sum(10 ** (-(m - mean[best]) * math.sqrt(len(found))) for m in mean.values())


ROWS = [
    (1, None, "en"), (2, "", "fr"), (3, "1234 !? 56", None), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"),
    (7, "der Hund und die Katze", "de"), (8, "THE CATS and thecat", None), (9, "chats, chiens!", None), (10, "Zürich über", "de"),
    (11, "漢字 かな", "ja"), (12, "漢字", None), (13, "xyzzy qqq", None), (None, "the house", "en"), (None, "la maison", None),
    (14, "the " * 30_000 + "end", None), (15, "x" * 200_000, None), (16, "été l'été", "fr"), (17, "été", None),
    (4, "the cat and the dog", "en"), (4, "le chat", None), (18, "Ω", None), (19, "hello", ""), (20, "hello hell", None),
]


def table(spark, rows):
    full = [(i, t, lang, "s", 1, 0.5) for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, clean int, score double")


def test_equals_plain_version(spark):
    docs = table(spark, ROWS)
    got = language_id.identify(docs, language_id.train(docs)).collect()
    plain = Plain(ROWS)
    want = [(i, held(i), *plain.judge(t)) for i, t, _ in ROWS]
    rounded = lambda rows: sorted((str(r[0]), r[1], r[2], round(r[3], 5)) for r in rows)
    assert rounded(got) == rounded(want)


def test_nothing_learned(spark):
    docs = table(spark, [(i, t, None) for i, t, _ in ROWS])
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(got) == len(ROWS) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), language_id.train(docs.limit(0))).collect() == []


def test_labels_are_no_input(spark):
    docs = table(spark, ROWS)
    model = language_id.train(docs)
    other = table(spark, [(i, t, "zz") for i, t, _ in ROWS])
    assert sorted(map(str, language_id.identify(docs, model).collect())) == sorted(map(str, language_id.identify(other, model).collect()))


def test_model_is_bounded(spark):
    docs = load(spark, FOLDER, "documents")
    model = language_id.train(docs, rows=50, entries=6_000)
    assert sum(len(t[2]) for t in model.tables) <= 6_000 and model.langs == ["de", "en", "es", "fr"]
    with pytest.raises(ValueError):
        language_id.train(docs, entries=10)


def test_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_language_id"](spark, FOLDER).collect()}
    rows = load(spark, FOLDER, "documents").select("doc_id", "lang").collect()
    assert got.keys() == {r["doc_id"] for r in rows}
    assert all(got[r["doc_id"]]["held_out"] == held(r["doc_id"]) for r in rows)
    told = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if held(r["doc_id"])]
    assert len(told) > 200 and np.mean(told) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())
