"""Quality rules: counts of words, symbols and repeats, and bands of zstandard ratios.

A text is compressed as a whole and in fixed chunks. Repetitive text packs too well, noise too badly; what is
usual depends on the length, so each length class has limits of its own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from comarca.llm.frames import with_text
from comarca.llm.words import NOT_SPACE, Words, slices, table, windows

CHUNK = 2048
#: From so many bytes on: least and most ratio (packed / raw) of the whole text, least ratio of its most
#: repetitive chunk, most ratio of its noisiest one. Texts below the first length are not judged by ratios.
#: Chunks of prose (6,000 rows of sf0.1, from 1,024 bytes on) reach 0.58, those of base64 have 0.76 or more.
BANDS = [
    (256, 0.30, 0.95, 0.00, 0.95),
    (1024, 0.25, 0.80, 0.20, 0.72),
    (4096, 0.20, 0.75, 0.20, 0.68),
    (16384, 0.15, 0.70, 0.20, 0.68),
]
_SYMBOLS = table(lambda b: b in b"#*$%&|<>")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, chunk_ratio double, kept boolean"
)


def repeat_words(words: Words, size=8):
    """Per text: words inside ``size``-word windows that occur twice or more in it."""
    texts = len(words.offsets) - 1
    runs, at = windows(words.hashes(), words.first, size)
    if not len(at):
        return np.zeros(texts, np.int64)
    owner = np.searchsorted(words.first, at, "right") - 1
    key = runs + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at[again], 1)
    np.add.at(edges, at[again] + size, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(" \t\n\v\f\r"))
        seen.add(line)
    return n


def ratios(raw: bytes, packer, chunk=CHUNK):
    """Packed size over size of the whole text, and the least and the most over its chunks (1.0 for no text)."""
    if not raw:
        return 1.0, 1.0, 1.0
    whole = len(packer.compress(raw)) / len(raw)
    if len(raw) <= chunk:
        return whole, whole, whole
    # a tail shorter than half a chunk goes with the last full one
    cuts = list(range(0, len(raw) - chunk // 2, chunk))
    parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
    found = [len(packer.compress(p)) / len(p) for p in parts]
    return whole, min(found), max(found)


def within_bands(size, whole, chunk, most_chunk=None, bands=BANDS):
    """Whether all ratios lie within the limits of the length class; ``chunk`` stands for both ends if it is alone."""
    limits = [b for b in bands if size >= b[0]]
    if not limits:
        return True
    _, least, most, low, high = limits[-1]
    return least <= whole <= most and chunk >= low and (chunk if most_chunk is None else most_chunk) <= high


def quality_rules(documents: DataFrame, bands=BANDS, level=3, chunk=CHUNK) -> DataFrame:
    """One row per row of ``documents(doc_id, text)``, see ``SCHEMA``.

    Null and empty texts have no words, fail the base rule (under 20 words) and have ratios of 1. Repeated rows
    are judged each. ``chunk_ratio`` is that of the most repetitive chunk; the noisiest one counts for ``kept``. Every text is read whole; a task holds one slice of texts at a time.
    """

    def judge(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for row, data, offsets in slices(texts):
                words = Words(data, offsets, NOT_SPACE)
                n = words.counts
                chars = words.inside & ((data & 0xC0) != 0x80)
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (chars, _SYMBOLS[data])]
                chars, symbols = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
                repeats = repeat_words(words)
                raws = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                dups = [dup_lines(r.decode("utf-8", "replace")) for r in raws]
                packed = [ratios(r, packer, chunk) for r in raws]
                failed = (n < 20) | (100 * repeats > 30 * n)
                fine = np.array([within_bands(len(r), *p, bands=bands) for r, p in zip(raws, packed)], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, len(n)), *(pa.array(x, pa.int64()) for x in (n, chars, symbols, dups, repeats)),
                        pa.array(failed), *(pa.array(x, pa.float64()) for x in list(zip(*packed))[:2]), pa.array(fine & ~failed),
                    ],
                    SCHEMA_NAMES,
                )

    return with_text(documents, "doc_id", "text").mapInArrow(judge, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
