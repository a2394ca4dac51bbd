"""Plain Python versions of what the operators compute."""

import re

SPACES = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Null, empty, blank, tiny, very long and repeated texts.
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b"), (6, "a b"), (7, "x" * 5000), (8, "one two three four " * 3000),
    (8, "one two three four " * 3000), (9, "ÄÖ 漢字 😀 é\n\nmail me at joe@example.com or +1 (555) 555-0100"), (10, "B a"),
]


def documents(spark, rows=ODD):
    """Documents with extra columns whose names clash with what operators add."""
    full = [(i, t, "en", "s", len(t or ""), "x", 1.5) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept double"
    return spark.createDataFrame(full, schema)


def words(text):
    return re.findall(SPACES, text or "")


def shingles(text, size=3):
    w = words((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def components(rows, percent=85, size=3):
    sets = [(i, shingles(t, size)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                i2, j2 = sorted((find(i), find(j)))
                up[j2] = i2
    return {i: find(i) for i in up}


def kept_lines(rows, min_words=3, near_words=8):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((t or "").split("\n")):
            first.setdefault(tuple(words(line)), (i, no))

    def near(a, b):
        if min(len(a), len(b)) < near_words or abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    lines = [w for w in first if len(w) >= min_words]
    gone = {a for a in lines for b in lines if a != b and first[b] < first[a] and near(a, b)}
    out = {}
    for i, t in rows:
        keep = []
        for no, line in enumerate((t or "").split("\n")):
            w = tuple(words(line))
            if len(w) < min_words or (first[w] == (i, no) and w not in gone):
                keep.append(line)
        out[i] = None if t is None else "\n".join(keep)
    return out
