"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise interactions
of all features cost time linear in their number.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from comarca.llm.frames import with_text
from comarca.llm.quality_rules import repeat_words
from comarca.llm.words import NOT_SPACE, Words, lower, slices, table

WORDS = 2048  # hashed word features
SLICE_ROWS = 1_000  # texts whose features are held at once, 25 KB each
TRAIN_ROWS = 12_000  # at most so many labelled rows are fitted, those of smallest hashed id
RANK = 8
EPOCHS = 12
CUT = 0.3
STATISTICS = [
    "words", "bytes", "word_bytes", "upper", "digits", "punctuation", "symbols", "marks", "non_ascii", "lines",
    "line_words", "distinct", "repeated", "stopped", "longest",
]
SIZE = WORDS + len(STATISTICS)
_UPPER = table(lambda b: 65 <= b <= 90)
_DIGIT = table(lambda b: 48 <= b <= 57)
_PUNCTUATION = table(lambda b: b in b".,;:!?'\"()-")
_SYMBOL = table(lambda b: b in b"#*$%&|<>{}[]=_~^\\/@")
_MARK = table(lambda b: b in b"!?")
_STOP = table(lambda b: b in b".!?")


def _sums(flags, offsets):
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def features(data, offsets) -> np.ndarray:
    """``float32[texts, SIZE]``: shares of hashed words (square roots) and statistics of about 0 to 1."""
    texts = len(offsets) - 1
    small = Words(lower(data), offsets, NOT_SPACE)
    n, size = small.counts.astype(np.float64), np.diff(offsets).astype(np.float64)
    words, chars = np.maximum(n, 1), np.maximum(size, 1)
    hashes = small.hashes()
    slot = (hashes >> np.uint64(20)).astype(np.int64) % WORDS
    owner = small.owners()
    counts = np.bincount(owner * WORDS + slot, minlength=texts * WORDS).reshape(texts, WORDS)
    lines = _sums(data == 10, offsets) + 1
    sizes = (small.ends - small.starts).astype(np.float64)
    key = hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, at = np.unique(key, return_index=True)
    longest = np.zeros(texts)
    np.maximum.at(longest, owner, sizes)
    stops = np.bincount(owner, _STOP[data[small.ends - 1]] if len(small) else None, texts)
    statistics = [
        np.log1p(n) / 12, np.log1p(size) / 14, np.minimum(np.bincount(owner, sizes, texts) / words / 16, 2),
        _sums(_UPPER[data], offsets) / chars, _sums(_DIGIT[data], offsets) / chars,
        _sums(_PUNCTUATION[data], offsets) / chars, _sums(_SYMBOL[data], offsets) / chars,
        _sums(_MARK[data], offsets) / chars, _sums(data >= 128, offsets) / chars, np.log1p(lines) / 8,
        np.log1p(n / lines) / 8, np.bincount(owner[at], minlength=texts) / words,
        repeat_words(small) / words, np.minimum(stops / words, 1), np.log1p(longest) / 8,
    ]
    out = np.empty((texts, SIZE), np.float32)
    out[:, :WORDS] = np.sqrt(counts / words[:, None])
    out[:, WORDS:] = np.stack(statistics, 1)
    return out


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, b, w, v):
        self.b, self.w, self.v = b, w, v

    def raw(self, x):
        mixed = x @ self.v
        return self.b + x @ self.w + 0.5 * ((mixed**2).sum(1) - (x**2) @ (self.v**2).sum(1))

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -30, 30)))

    def pack(self) -> np.ndarray:
        return np.concatenate(([self.b], self.w, self.v.ravel())).astype(np.float64)

    @classmethod
    def unpack(cls, flat, rank=RANK):
        flat = np.asarray(flat, np.float32)
        return cls(flat[0], flat[1 : SIZE + 1], flat[SIZE + 1 :].reshape(SIZE, rank))


def fit(x, y, rank=RANK, epochs=EPOCHS, rate=0.02, decay=1e-4, seed=7) -> Machine:
    """Adam on the log loss, both classes given equal weight in sum up to a factor of 3."""
    rng = np.random.default_rng(seed)
    b, w, v = np.zeros(1), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, rank))
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Machine(np.log(share / (1 - share)), w, v * 0)
    balance = np.clip((y == 1).sum() / max((y == 0).sum(), 1), 1 / 3, 3)
    weight = np.where(y == 1, 1.0, balance)
    parts = [b, w, v]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 128)):
            z, m = x[at].astype(np.float64), Machine(parts[0][0], parts[1], parts[2])
            mixed = z @ parts[2]
            gap = (m.score(z) - y[at]) * weight[at] / len(at)
            grads = [
                np.array([gap.sum()]), z.T @ gap + decay * parts[1],
                z.T @ (gap[:, None] * mixed) - ((z**2).T @ gap)[:, None] * parts[2] + decay * parts[2],
            ]
            step += 1
            for p, g, a, c in zip(parts, grads, first, second):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    return Machine(parts[0][0], parts[1], parts[2])


def held_out(doc_id):
    """Every fifth row by crc32 of its id; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, most=TRAIN_ROWS) -> list[float]:
    """Fit on at most ``most`` labelled rows that are not held out; returns the packed weights.

    Contradictory or repeated labels of a document count as one label, the smaller; null labels are left out. Of the rows
    that repeat a labelled id, the text of least hash is fitted, so the sample has at most ``most`` rows.
    The sample is fitted in one task of bounded size, and only the weights come back.
    """
    marked = with_text(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # ``chosen`` has at most ``most`` rows of two numbers
    sample = with_text(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(
        F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")
    )

    def extract(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column("text"), 1 << 19, SLICE_ROWS):
                x = features(data, offsets)
                rows = [x[i].astype(np.float16).tobytes() for i in range(len(x))]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), batch.column("quality").slice(row, n), pa.array(rows, pa.binary())],
                    ["doc_id", "quality", "x"],
                )

    rows = sample.mapInArrow(extract, "doc_id long, quality int, x binary")

    def learn(batches):
        rows = pd.concat([pd.DataFrame({"doc_id": [], "quality": [], "x": []}), *batches])
        rows = rows.sort_values("doc_id")
        x = np.array([np.frombuffer(b, np.float16) for b in rows["x"]], np.float32).reshape(-1, SIZE)
        yield pd.DataFrame({"weights": [fit(x, rows["quality"].to_numpy(np.float64)).pack().tolist()]})

    return rows.repartition(1).mapInPandas(learn, "weights array<double>").first()[0]


def score_quality(documents: DataFrame, weights) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``documents(doc_id, text)``.

    Null texts are scored as empty ones, texts of any length whole, and rows that repeat an id each.
    """
    return apply_model(with_text(documents, "doc_id", "text"), weights).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def apply_model(documents: DataFrame, weights) -> DataFrame:
    """All columns of ``documents`` and ``score``; the columns' own types stay as they are."""
    name = "score"
    shared = documents.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))  # SIZE * (RANK + 1) numbers
    kept = [c for c in documents.columns if c != name]
    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", score double"

    def run(batches):
        machine = Machine.unpack(shared.value)
        for batch in batches:
            for row, data, offsets in slices(batch.column(batch.schema.get_field_index("text")), 1 << 19, SLICE_ROWS):
                x = features(data, offsets)
                part = batch.slice(row, len(x))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(machine.score(x))], [*kept, name])

    return source.mapInArrow(run, schema)
