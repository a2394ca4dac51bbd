"""Language identification with word-first backoff.

Every word that some language knows is scored by its log frequency in each language. An unseen word falls back to its
character n-grams, the longest first: the first length of which some language knows an n-gram decides. A text's score
per language is the mean over its words; the lowest cost wins.

Words are maximal runs of letters and marks, lower-cased; n-grams are taken from the word between two spaces.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from comarca.llm.frames import with_text
from comarca.llm.words import SLICE, mix, slices

LONGEST = 5  # characters of the longest n-grams
TRAIN_ROWS = 4_000  # about so many labelled rows of each language are counted, those of smallest hash
ENTRIES = 1_000_000  # at most so many counts make the model, over all languages
PENALTY = 7.0  # cost of a word or n-gram that a language does not have: one in ten million
UNKNOWN = "und"
_SPACE = np.uint32(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """Words of a slice of cleaned texts as code points: each word with one space before and behind it."""

    def __init__(self, data, offsets):
        text = data.tobytes().decode("utf-8", "replace")
        self.points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        firsts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # first code point of every text
        inside = self.points != _SPACE
        edge = np.zeros(len(inside) + 1, bool)
        edge[firsts] = True
        start = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1])))
        stop = inside & (edge[1:] | np.concatenate((~inside[1:], [True])))
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, firsts)

    def hashes(self):
        """64-bit hash of every word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(sizes.max()) - 1, _STEP))))
        terms = powers[place] * (self.points[place + np.repeat(self.starts, sizes)].astype(np.uint64) + np.uint64(1))
        return mix(np.add.reduceat(terms, begin) ^ (sizes.astype(np.uint64) << np.uint64(40)))

    def grams(self, words, n):
        """Hashes of the ``n``-grams of the given words, and for each the index into ``words``."""
        sizes = self.ends[words] - self.starts[words] + 2
        begin = np.cumsum(sizes) - sizes
        # words between spaces, laid end to end
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.repeat(self.starts[words] - 1, sizes) + place
        inner = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
        points = np.where(inner, self.points[np.where(inner, at, 0)] if len(self.points) else 0, _SPACE).astype(np.uint64)
        good = np.flatnonzero(place + n <= np.repeat(sizes, sizes))
        total = np.zeros(len(good), np.uint64)
        for k in range(n):
            total = total * _STEP + points[good + k] + np.uint64(1)
        good_owner = owner[good]
        if n == 1:  # a space alone tells nothing
            told = points[good] != _SPACE
            total, good_owner = total[told], good_owner[told]
        return mix(total ^ (np.uint64(n) << np.uint64(56))), good_owner


def cleaned(text):
    """Lower-cased letters and marks, all else one space; null texts are empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")


# --- learning ---------------------------------------------------------------------------------------------------------


def held_out(doc_id):
    """Every fourth row by crc32 of its id; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _summed(keys, counts):
    """Distinct ``keys`` and the sum of ``counts`` of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts


def _counts(sample: DataFrame, longest) -> DataFrame:
    """``lang, kind, hash, n`` of the words (kind 0) and n-grams (kind n) of ``sample(lang, clean)``."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, data, offsets in slices(batch.column("clean")):
                runs = Runs(data, offsets)
                hashes, texts = runs.hashes(), langs[row : row + len(offsets) - 1]
                owner = np.repeat(np.arange(len(texts)), np.diff(runs.first))
                for lang in sorted(set(texts)):
                    own = np.flatnonzero(texts[owner] == lang) if len(owner) else owner
                    if not len(own):
                        continue
                    # n-grams are taken from each different word once, with its count
                    keys, first, n = np.unique(hashes[own], return_index=True, return_counts=True)
                    tables = [(0, keys, n)]
                    for size in range(1, longest + 1):
                        grams, word = runs.grams(own[first], size)
                        tables.append((size, *_summed(grams, n[word])))
                    for kind, found, times in tables:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), kind, np.int32)),
                             pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["lang", "kind", "hash", "n"],
                        )

    parts = sample.select("lang", "clean").mapInArrow(count, "lang string, kind int, hash long, n long")
    return parts.groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, rows=TRAIN_ROWS, entries=ENTRIES, longest=LONGEST) -> "Model":
    """Learn from ``documents(doc_id, text, lang)`` that are not held out and have a ``lang``.

    Of a language with more than ``rows`` rows, those of the smallest hashes are counted, about ``rows`` of them; the
    counting is a Spark aggregate, so that copies of a row, which share a hash, burden no single task. A language
    keeps its most frequent words and n-grams, so many that all languages together have at most ``entries``; what is
    as rare as the first that does not fit is left out. Blank languages are values like others.
    """
    known = with_text(documents, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    most = entries // (longest + 1)
    sizes = known.groupBy("lang").agg(F.count("*").alias("_rows")).limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages do not fit in {entries} entries")
    # at most one row for each language that the model has room for
    sizes = F.broadcast(documents.sparkSession.createDataFrame(sizes, "lang string, _rows long"))
    spread = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 52)).cast("double")
    sample = known.join(sizes, "lang").where(spread * F.col("_rows") < F.lit(float(rows << 52)))
    counts = _counts(sample.select("lang", cleaned(F.col("text")).alias("clean")), longest).persist()
    try:
        kinds = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total")).collect()  # some rows a language
        langs = sorted({r["lang"] for r in kinds})
        each = entries // (max(len(langs), 1) * (longest + 1))
        # how many entries of each language and kind have which count: the groups are no larger than the counts differ
        ranks = counts.groupBy("lang", "kind", "n").agg(F.count("*").alias("have"))
        above = W.partitionBy("lang", "kind").orderBy(F.desc("n"))
        fits = ranks.withColumn("upto", F.sum("have").over(above)).where(F.col("upto") <= each)
        least = fits.groupBy("lang", "kind").agg(F.min("n").alias("least"))
        kept = counts.join(least, ["lang", "kind"]).where("n >= least").select("lang", "kind", "hash", "n").toPandas()
    finally:
        counts.unpersist()
    totals = {(r["lang"], r["kind"]): r["total"] for r in kinds}
    return Model(langs, kept, totals, longest)


# --- scoring ----------------------------------------------------------------------------------------------------------


class Model:
    """Costs by hash for words and each length of n-grams, as what each language saves against the penalty.

    A cost is -log10 of the relative frequency. One row per hash lists the languages that have it, so the model has no
    more numbers than counts were kept, whatever the number of languages.
    """

    def __init__(self, langs, counts, totals, longest):
        self.langs, self.longest, self.tables = langs, longest, []
        column = {lang: k for k, lang in enumerate(langs)}
        for kind in range(longest + 1):
            own = counts[counts["kind"] == kind]
            hashes = own["hash"].to_numpy(np.int64).view(np.uint64)
            keys, sizes = np.unique(hashes, return_counts=True)
            order = np.argsort(hashes, kind="stable")
            share = own["n"].to_numpy(float) / np.array([totals[lang, kind] for lang in own["lang"]], float)
            saved = np.minimum(-np.log10(share), PENALTY) - PENALTY
            columns = np.array([column[lang] for lang in own["lang"]], np.int32)
            self.tables.append((keys, np.concatenate(([0], np.cumsum(sizes))), columns[order], saved[order].astype(np.float32)))

    def find(self, kind, hashes):
        """Rows of ``hashes`` in the table of a kind, -1 for those it lacks."""
        keys = self.tables[kind][0]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def saved(self, kind, rows, owner, owners):
        """``float64[owners, languages]``: what the given table rows save, added up by ``owner``."""
        _, first, columns, saved = self.tables[kind]
        sizes = first[rows + 1] - first[rows]
        at = np.arange(int(sizes.sum())) + np.repeat(first[rows] - (np.cumsum(sizes) - sizes), sizes)
        cells = np.repeat(owner, sizes) * len(self.langs) + columns[at]
        return np.bincount(cells, saved[at], owners * len(self.langs)).reshape(owners, len(self.langs))

    def totals(self, runs: Runs):
        """Sum over each text's words of what each language saves: by the word, else by its longest known n-grams."""
        texts = len(runs.first) - 1
        hashes, owner = runs.hashes(), np.repeat(np.arange(texts), np.diff(runs.first))
        at = self.find(0, hashes)
        known, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out = self.saved(0, at[known], owner[known], texts)
        # a word that occurs often is looked at once
        _, first, back = np.unique(hashes[unseen], return_index=True, return_inverse=True)
        todo, found = unseen[first], np.zeros((len(first), len(self.langs)))
        left = np.arange(len(todo))
        for n in range(self.longest, 0, -1):
            if not len(left):
                break
            grams, word = runs.grams(todo[left], n)
            row = self.find(n, grams)
            word, row = word[row >= 0], row[row >= 0]
            seen = np.bincount(word, minlength=len(left))
            told = seen > 0
            found[left[told]] = (self.saved(n, row, word, len(left)) / np.maximum(seen, 1)[:, None])[told]
            left = left[~told]
        for k in range(len(self.langs)):
            out[:, k] += np.bincount(owner[unseen], found[back, k], texts)
        return out

    def judge(self, data, offsets):
        """Index of the cheapest language (-1 without words) and its share of trust, for every text of a slice."""
        runs = Runs(data, offsets)
        n = np.diff(runs.first)
        if not self.langs or not len(runs.starts):
            return np.full(len(n), -1), np.zeros(len(n))
        mean = np.round(self.totals(runs) / np.maximum(n, 1)[:, None], 9)
        best = mean.argmin(1)  # ties go to the language that sorts first
        # odds of the means, sharper the more words there are
        odds = 10.0 ** (-(mean - mean.min(1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None])
        return np.where(n > 0, best, -1), np.where(n > 0, 1 / odds.sum(1), 0.0)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``SCHEMA`` for every row of ``documents(doc_id, text)``, from its whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned. A
    text that is letters, but of no known word or n-gram, goes to the language that sorts first, with an even share
    as its score. Repeated rows are judged each; ties go to the language that sorts first.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays, at most ENTRIES hashes and savings, some 24 bytes each
    rows = with_text(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), cleaned(F.col("text")).alias("clean"),
    )

    def run(batches):
        model = Model.__new__(Model)
        vars(model).update(shared.value)
        names = np.array([*model.langs, UNKNOWN], object)
        size = SLICE * 16 // max(len(model.langs), 16)  # unseen words take one number a language
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            for row, data, offsets in slices(batch.column("clean"), size):
                best, score = model.judge(data, offsets)
                count = len(best)
                told = lettered[row : row + count]
                best, score = np.where(told, best, -1), np.where(told & (best >= 0), score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, count), batch.column("held_out").slice(row, count),
                     pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, SCHEMA)
