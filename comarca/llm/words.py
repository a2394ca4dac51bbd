"""Arrow helpers: words, hashes and shingles of many texts at once, as numpy arrays.

Texts are worked on as UTF-8 bytes. All separators used here are ASCII, so a byte table decides what
belongs to a word, and a word never ends inside a character. Batches are cut into slices of about
``SLICE`` bytes, whole texts each, so memory is bounded by the longest text and not by the batch.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def table(members) -> np.ndarray:
    """A lookup of 256 booleans: True where ``members(byte)`` holds."""
    return np.array([bool(members(b)) for b in range(256)])


#: Words of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = table(lambda b: b != 32 and not 9 <= b <= 13)
#: Words of lower-cased text, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
LETTERS = table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
NOT_NEWLINE = table(lambda b: b != 10)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _LOWER[data]


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column, size=SLICE, most=None):
    """``(first row, bytes, offsets from 0)`` of consecutive rows holding about ``size`` bytes, ``most`` rows at most."""
    data, offsets = texts_of(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        last = min(last, row + (most or rows))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n):
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


class Words:
    """Words of a slice of texts: starts and ends in bytes, and the first word of each text."""

    def __init__(self, data, offsets, members):
        self.data, self.offsets = data, offsets
        inside = members[data]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        full = np.diff(offsets) > 0
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self):
        return len(self.starts)

    @property
    def counts(self):
        return np.diff(self.first)

    def owners(self):
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        terms = _power(int(sizes.max()))[place]
        terms *= self.data[self.inside].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(terms, begin) ^ (sizes.astype(np.uint64) << np.uint64(40)))


def word_hash(word: str) -> int:
    """The hash that ``Words.hashes`` gives ``word``."""
    data = np.frombuffer(word.encode(), np.uint8)
    every = np.ones(256, bool)
    return int(Words(data, np.array([0, len(data)]), every).hashes()[0])


def windows(hashes, first, size):
    """Hash of every run of ``size`` words within a text, and the index of the run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= room)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k]
    return mix(total), at


def shingle_sets(words: Words, size):
    """Per text: the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    hashes = words.hashes()
    runs, at = windows(hashes, words.first, size)
    bounds = np.searchsorted(at, words.first)
    for i, count in enumerate(words.counts):
        if count >= size:
            yield np.unique(runs[bounds[i] : bounds[i + 1]])
        elif count:
            total = np.zeros(1, np.uint64)
            for h in hashes[words.first[i] : words.first[i + 1]]:
                total = total * np.uint64(0xD6E8FEB86659FD93) + h
            yield mix(total ^ np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)
