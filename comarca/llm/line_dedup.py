"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words, within one word inserted, deleted or replaced. Deleting each word in turn
gives a line's variants: two lines of equal length differ in one word exactly where they share the variant of the same
place, and a line is another one with a word inserted exactly where it is a variant of it. Variants and whole
lines meet as hashed keys, so a key's earliest line is all that its other lines need: no pairs are made.

A replaced word is most of a short line, so lines below eight words are compared as sequences of characters instead
(their words joined by single spaces), within one character, by the same join. Lines of exactly eight words take part
in both, since a lost space leaves seven.

Only lines that can have a partner emit variants: of two lines within one edit, the first or the second half of the
shorter one's length is the same, so lines that share neither half with another line are left out without loss.
What is left after deletion is compared by two independent 64-bit hashes and the place, which verifies the distance.
Whole lines are the same when three 64-bit hashes are: of the line and of each of its halves.

A row is known by its id and a hash of its text, so no list outgrows one text, whatever ids repeat or are null.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from comarca.llm.frames import fresh, with_text
from comarca.llm.words import NOT_SPACE, Words, mix, slices
from comarca.session import durable

MIN_WORDS = 1  # lines of fewer words stay as they are
NEAR_WORDS = 8  # lines of fewer words are compared by characters, or for equality only
WHOLE = {"min_words": 1, "letters": True}  # every line that holds a word takes part, short ones by characters
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Sums:
    """Hashes of any run of words, from running sums of the words' hashes times powers of an odd base."""

    def __init__(self, hashes, base):
        n = len(hashes) + 1
        self.power, self.back = (self._powers(b, n) for b in (base, pow(base, -1, 1 << 64)))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashes * self.power[:-1], out=self.sums[1:])

    @staticmethod
    def _powers(base, n):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def run(self, a, b):
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def without(self, a, b, i):
        """Words a..b except word i."""
        return self.run(a, i) + self.power[i - a] * self.run(i + 1, b)


class Letters:
    """Characters of lines of words ``a..b`` joined by single spaces: hashes, and each line's first and end one."""

    def __init__(self, words, a, b):
        n = b - a
        lines = np.cumsum(n) - n
        w = np.arange(int(n.sum())) + np.repeat(a - lines, n)
        sizes = words.ends[w] - words.starts[w] + 1  # each word and a space
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(words.starts[w] - begin, sizes)
        space = np.zeros(len(at), bool)
        space[begin + sizes - 1] = True
        at[space] = 0
        data = np.where(space, np.uint8(32), words.data[at]) if len(at) else np.zeros(0, np.uint8)
        head = (data & 0xC0) != 0x80
        head[begin] = True
        starts = np.flatnonzero(head)
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        bits = data.astype(np.uint64) << (8 * np.minimum(place, 7)).astype(np.uint64)
        codes = np.add.reduceat(bits, starts) if len(starts) else bits
        self.hashes = mix(codes ^ np.uint64(0x9FB21C651E98DF25))
        ends = np.searchsorted(starts, np.append(begin, len(data)))
        self.a, self.b = ends[lines], ends[lines + n] - 1


def split_lines(data, offsets):
    """Words of a slice of texts, line by line, and each line's text and number in it."""
    cuts = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
    owner = np.searchsorted(offsets, cuts[:-1], "right") - 1
    return Words(data, cuts, NOT_SPACE), owner, np.arange(len(owner)) - np.searchsorted(owner, owner)


class Lines:
    """Lines of a slice of texts that take part: text, number in it, first and end word, hash."""

    def __init__(self, data, offsets, min_words):
        words, owner, number = split_lines(data, offsets)
        n = words.counts
        self.words, self.hashes = words, words.hashes()
        part = n >= min_words
        self.owner, self.number, self.n = owner[part], number[part], n[part]
        self.a, self.b = words.first[:-1][part], words.first[1:][part]
        self.sums = Sums(self.hashes, _BASES[0])
        self.line = mix(self.sums.run(self.a, self.b) ^ self.n.astype(np.uint64)).astype(np.int64)
        # the first occurrence within each text
        order = np.lexsort((self.number, self.line, self.owner))
        again = np.zeros(len(order), bool)
        again[1:] = (self.line[order][1:] == self.line[order][:-1]) & (self.owner[order][1:] == self.owner[order][:-1])
        self.first = np.ones(len(order), bool)
        self.first[order[again]] = False

    def find(self, owner, number):
        """Indices of lines by text and number, all of which take part."""
        span = int(self.number.max(initial=0)) + 1
        return np.searchsorted(self.owner * span + self.number, owner * span + number)

    def letters(self, keep):
        """``Letters`` of the lines that ``keep`` marks."""
        return Letters(self.words, self.a[keep], self.b[keep])


_KEYS = ["k0", "k1", "k2", "k3", "more"]


def _half_keys(sums, a, b, domain):
    """Keys of halves; the two lowest bits tell the half and whether it is one of words (0) or of characters (1)."""
    n = b - a
    for size in (n, n - 1):  # as one of equal lengths or the shorter one; as the longer one
        half = size // 2
        for side, begin, end in ((0, a, a + half), (1, b - (size - half), b)):
            h = mix(sums.run(begin, end) ^ mix((size * 4 + 2 * domain + side).astype(np.uint64)))
            yield ((h & ~np.uint64(3)) | np.uint64(2 * domain + side)).astype(np.int64)


def _first_lines(documents, min_words, near_words, letter_words):
    """``doc_id, row, no, line, k0..k3, more``: each text's different lines, and the keys of their halves where near ones count.

    Lines that are compared by words and by characters have the keys of the latter in ``more``.
    """

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                lines = Lines(data, offsets, min_words)
                keep = lines.first
                n = lines.n[keep]
                near, small = n >= near_words, n <= letter_words
                letters = lines.letters(np.flatnonzero(keep)[small])
                words = np.stack([*_half_keys(lines.sums, lines.a[keep], lines.b[keep], 0)])
                spelled = np.stack([*_half_keys(Sums(letters.hashes, _BASES[0]), letters.a, letters.b, 1)])
                both, short = near & small, ~near & small
                words[:, short] = spelled[:, short[small]]
                keys = [pa.array(k, mask=~(near | small)) for k in words]
                ends = np.concatenate(([0], np.cumsum(both) * 4))
                offset = pa.array(ends, pa.int32(), mask=np.append(~both, False))
                keys.append(pa.ListArray.from_arrays(offset, pa.array(spelled[:, both[small]].T.ravel())))
                at = pa.array(row + lines.owner[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at), batch.column("row").take(at),
                        pa.array(lines.number[keep], pa.int32()), pa.array(lines.line[keep]), *keys,
                    ],
                    ["doc_id", "row", "no", "line", *_KEYS],
                )

    schema = "doc_id long, row long, no int, line long, " + ", ".join(f"{k} long" for k in _KEYS[:4]) + ", more array<long>"
    return _rows(documents).mapInArrow(run, schema)


def _rows(documents):
    return with_text(documents, "doc_id", "text").withColumn("row", F.xxhash64("text"))


def _deleted(sums, other, a, b, first, second):
    """Both hashes and the place of each variant of the sequence ``a..b``, then of the whole (place -1)."""
    # a shared first half leaves the edit to the second, and the other way round
    a, b, n = np.array([a]), np.array([b]), b - a
    at = a + np.arange(0 if second else (n - 1) // 2, n if first else n // 2)
    return (
        np.append(sums.without(a, b, at), sums.run(a, b)), np.append(other.without(a, b, at), other.run(a, b)),
        np.append(at - a, -1),
    )


def _variants(texts, min_words, letter_words):
    """``h, c, i, doc_id, row, no`` of the wanted lines of ``texts(doc_id, row, text, wanted)``; i is -1 for whole lines.

    ``wanted`` holds 16 times a line's number and one bit of its sides, once for each side.
    """

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                lines = Lines(data, offsets, min_words)
                other = Sums(lines.hashes, _BASES[1])
                small = np.flatnonzero(lines.first & (lines.n <= letter_words))
                letters = lines.letters(small)
                spelled = [Sums(letters.hashes, base) for base in _BASES]
                parts = []
                wanted = batch.column("wanted").slice(row, len(offsets) - 1)
                asked = wanted.flatten().to_numpy()
                texts = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
                sides = np.zeros(len(lines.n), np.int64)
                np.bitwise_or.at(sides, lines.find(texts, asked >> 4), asked & 15)
                for k in np.flatnonzero(sides):
                    side, found = int(sides[k]), []
                    if side & 3:
                        found.append(_deleted(lines.sums, other, lines.a[k], lines.b[k], side & 1, side & 2))
                    if side & 12:
                        x = np.searchsorted(small, k)
                        found.append(_deleted(*spelled, letters.a[x], letters.b[x], side & 4, side & 8))
                    parts += [(*f, np.full(len(f[2]), k)) for f in found]
                if parts:
                    h, c, i, k = (np.concatenate(p) for p in zip(*parts))
                    at = pa.array(row + lines.owner[k])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(mix(h).astype(np.int64)), pa.array(mix(c).astype(np.int64)), pa.array(i, pa.int32()),
                            batch.column("doc_id").take(at), batch.column("row").take(at),
                            pa.array(lines.number[k], pa.int32()),
                        ],
                        ["h", "c", "i", "doc_id", "row", "no"],
                    )

    return texts.mapInArrow(run, "h long, c long, i int, doc_id long, row long, no int")


def _near_lines(variants):
    """``row, no`` of every line that has an earlier one within one edit."""
    place = F.struct("doc_id", "row", "no")
    leads = variants.groupBy("h", "c", "i").agg(F.min(place).alias("lead"))
    whole, part = F.when(F.col("i") < 0, F.col("lead")), F.when(F.col("i") >= 0, F.col("lead"))
    keys = leads.groupBy("h", "c").agg(F.min(whole).alias("whole"), F.min(part).alias("part"))
    same = variants.where("i >= 0").join(leads, ["h", "c", "i"]).where(F.col("lead") < place).select("row", "no")
    other = F.when(F.col("i") < 0, F.col("part")).otherwise(F.col("whole"))
    moved = variants.join(keys.where("whole is not null and part is not null"), ["h", "c"]).where(other < place).select("row", "no")
    return same.unionByName(moved).distinct()


def dedup_lines(
    documents: DataFrame, near=True, min_words=MIN_WORDS, near_words=NEAR_WORDS, letters=True, counts=("n_lines", "n_removed")
) -> DataFrame:
    """All columns of ``documents(doc_id, text)`` with ``text`` cut to its kept lines, and the two ``counts``: lines, removed ones.

    The order of lines is (doc_id, hash of the text, place in the text), null ids first. A line goes where an earlier
    one is equal (as words) or, from ``near_words`` words on, within one edit, kept or not; with ``letters``, also where
    one of the two has fewer words and they are within one character. Lines of fewer than ``min_words`` words always
    stay. Null texts stay null with 0 lines, texts of any length are read whole. Rows that repeat an id and its text count as
    one place: they keep the same lines. Of rows that repeat an id with other texts, each is a place. Input columns named
    like ``counts`` are replaced, all others stay as they are.
    """
    if near and near_words < max(2, min_words):
        raise ValueError("near lines need at least two words and min_words")
    documents = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in [n.lower() for n in counts]])
    letter_words = near_words if near and letters else 0
    lines = _first_lines(documents, min_words, near_words if near else 1 << 30, letter_words)
    same = ["line", "k0", "k1"]
    types = durable(
        lines.groupBy(*same).agg(
            F.min(F.struct("doc_id", "row", "no")).alias("place"), *[F.first(k).alias(k) for k in _KEYS[2:]]
        )
    )
    kept = types.select("place.*")
    if near:
        keys = F.array(*_KEYS[:4])
        keys = F.when(F.col("more").isNull(), keys).otherwise(F.concat(keys, "more"))
        halves = types.where("k0 is not null").select("place.*", F.explode(keys).alias("key"))
        # the keys of one line differ, so that two rows of a key are two lines
        shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        side = F.expr("cast(no as long) * 16 + shiftleft(1L, cast(key & 3 as int))")
        wanted = halves.join(shared, "key").groupBy("doc_id", "row").agg(F.collect_list(side).alias("wanted"))
        wanted = durable(wanted).toDF("_id", "_row", "wanted")
        asked = _rows(documents).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
        gone = _near_lines(_variants(asked.select("doc_id", "row", "text", "wanted"), min_words, letter_words))
        kept = kept.join(gone, ["row", "no"], "left_anti")
    a, b, c, d = fresh(documents, "row", "id", "at", "kept")
    kept = kept.groupBy("doc_id", "row").agg(F.collect_list("no").alias("kept")).select("doc_id", "row", "kept").toDF(b, c, d)
    place = F.col("doc_id").eqNullSafe(F.col(b)) & (F.col(a) == F.col(c))
    joined = documents.withColumn(a, F.xxhash64("text")).join(kept, place, "left")
    return _cut(joined, documents.schema, min_words, d, counts)


def _cut(joined, schema, min_words, kept, counts):
    names = [f.name for f in schema]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + "".join(f", `{n}` long" for n in counts)

    def run(batches):
        for batch in batches:
            at = names.index("text")
            texts, held = batch.column(at), batch.column(len(names))
            for row, data, offsets in slices(texts):
                rows = len(offsets) - 1
                words, owner, number = split_lines(data, offsets)
                part = words.counts >= min_words
                owner, number = owner[part], number[part]
                bounds = np.searchsorted(owner, np.arange(rows + 1))
                cut, total, removed = [], [], []
                for t in range(rows):
                    text = texts[row + t].as_py()
                    gone = set(number[bounds[t] : bounds[t + 1]].tolist()).difference(held[row + t].as_py() or ())
                    parts = text.split("\n") if text else []
                    cut.append(text if not gone else "\n".join(p for k, p in enumerate(parts) if k not in gone))
                    total.append(len(parts))
                    removed.append(len(gone))
                columns = batch.slice(row, rows).columns[: len(names)]
                columns[at] = pa.array(cut, texts.type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts]
                )

    return joined.select(*[F.col(f"`{n}`") for n in names], kept).mapInArrow(run, out)
